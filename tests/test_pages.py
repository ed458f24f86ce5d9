"""Pages: parsing, units, budgets and observations."""

from pyspark.sql import functions as F

from mistveil.operators import agent, budget
from mistveil.operators import html as W


def by_tag(html, url="https://a.example/x/"):
    return [(n["tag"], n) for n in W.parse_page(url, html)]


def only(html, tag):
    return [n for t, n in by_tag(html) if t == tag]


def test_implied_end_tags():
    nodes = by_tag("<ul><li>a<li>b</ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table>")
    assert [t for t, _ in nodes] == ["ul", "li", "#text", "li", "#text", "p", "#text", "p", "#text", "table", "tr", "td", "#text", "td", "#text", "tr", "td", "#text"]
    ul = nodes[0][1]["node"]
    assert {n["parent"] for t, n in nodes if t == "li"} == {ul}


def test_stripped_and_markers():
    nodes = by_tag("<head><title>t</title></head><script>s</script><iframe><p>in</p></iframe><svg><text>x</text></svg><p>out</p>")
    assert [(t, n["marker"]) for t, n in nodes] == [("iframe", "iframe_skipped"), ("svg", "svg_skipped"), ("p", None), ("#text", None)]


def test_landmarks_keep_controls_only():
    nodes = by_tag("<header><p>gone</p><a href='/h'>kept</a></header><nav>gone</nav><main><nav><p>stays</p></nav></main>")
    assert [(t, n["text"]) for t, n in nodes] == [("a", None), ("#text", "kept"), ("main", None), ("nav", None), ("p", None), ("#text", "stays")]


def test_hidden():
    assert [t for t, _ in by_tag("<div style='display: none'><p>x</p></div><p hidden>y</p><div hidden><a href=x>z</a></div>")] == ["div", "a"]


def test_secrets():
    for field in ("type=password", "name=userOtp", "id=card_cvv", "autocomplete=cc-exp-month", "name=pin2", "autocomplete=one-time-code"):
        assert only(f"<input {field} value=x>", "input")[0]["secret"], field
    for field in ("name=pin_code", "name=spinner", "name=opinion", "type=text"):
        assert not only(f"<input {field} value=x>", "input")[0]["secret"], field
    assert only("<input type=password value=x>", "input")[0]["fields"] == []


def test_names_states_hints():
    n = only("<label for=q>Ask <b>us</b></label><input id=q required type=checkbox checked>", "input")[0]
    assert n["name"] == "Ask us" and n["state"] == {"checked": True, "required": True} and n["role"] == "checkbox"
    a = only("<h2>Contact us</h2><div itemtype='https://schema.org/ContactPoint'><a href='mailto:x@y.example' aria-label=' Mail '>m</a></div>", "a")[0]
    assert a["near_contact_heading"] and a["in_contact_markup"] and not a["in_ugc_block"] and a["name"] == "Mail"
    assert only("<div class='user comment'><p>x</p></div>", "#text")[0]["in_ugc_block"]
    assert not only("<div class='commentary'><p>x</p></div>", "#text")[0]["in_ugc_block"]
    f = only("<form action='https://b.example/post'><input name=a></form>", "input")[0]
    assert f["form_origin"] == "https://b.example"


def test_deep_and_empty_pages():
    assert W.parse_page(None, None) == [] and W.parse_page("x", "") == []
    assert len(W.parse_page("x", "<div>" * 3000 + "t")) == 3001


def test_units_and_inline_data(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>" + "w" * 4500 + "</p><img src='data:image/png;base64,AA' alt=' pic '><a href='mailto:a@b.example'>m</a>"), (2, None, None)], "page_id long, url string, html string")
    units = W.numbered_units(W.units_of(W.nodes_of(pages))).orderBy("unit").collect()
    assert [(u.field, len(u.text)) for u in units] == [("text", 2000), ("text", 2000), ("text", 600), ("src", 13), ("accessible_name", 3), ("href", 18), ("text", 1)]
    assert units[3].text == "[inline-data]" and units[5].is_mailto


def test_prune_keeps_ancestors_and_flags(spark):
    nodes = spark.createDataFrame(
        [(1, 0, None, 5, None, None, False, False), (1, 1, 0, 2, None, None, False, False), (1, 2, 1, 2, None, None, False, False), (1, 3, 0, 4, None, None, False, False), (1, 4, 3, 4, None, None, True, False), (1, 5, 0, 5, "svg_skipped", None, False, False), (2, 0, None, 0, None, None, False, False)],
        "page_id long, node int, parent int, last int, marker string, image string, interactive boolean, in_viewport boolean",
    ).withColumns({"secret": F.lit(False), "image_omitted": F.lit(None).cast("string")})
    chosen = spark.createDataFrame([(1, 2, "text", True), (1, 3, "text", False), (2, 0, "text", True)], "page_id long, node int, field string, kept boolean")
    got = {(r.page_id, r.node): r.trimmed for r in budget.prune(nodes, chosen).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): False, (1, 5): False, (2, 0): False}


def test_images(spark):
    box = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("w").alias("w"), F.col("h").alias("h"))
    rows = [(1, 0, "img", None, True, True, 0, 0, 100, 100, True), (1, 1, "img", None, True, True, 0, 0, 200, 100, True), (1, 2, "img", None, True, False, 0, 900, 900, 900, True), (1, 3, "img", None, True, True, 0, 0, 50, 50, False), (1, 4, "img", "too_small", True, True, 0, 0, 5, 5, True)]
    nodes = spark.createDataFrame(rows, "page_id long, node int, image string, image_omitted string, visible boolean, in_viewport boolean, x int, y int, w int, h int, available boolean").withColumn("box", box)
    got = {r.node: (r.outcome, r.place) for r in budget.select_images(nodes, limit=2).collect()}
    assert got == {1: ("selected", 1), 0: ("selected", 2), 2: ("over_limit", 3), 3: ("missing", None)}


def test_blocked_observation(spark):
    pages = spark.createDataFrame([(1, "t", "u", "ABCPE1234F"), (2, "t", "u", "fine")], "page_id long, task string, url string, title string")
    nodes = spark.createDataFrame([(1, 0, {"text": "x"}), (2, 0, {"text": "mail a@b.example"})], "page_id long, node int, content map<string,string>")
    got = {r.page_id: (r.status, r.dom is None) for r in agent.assemble(pages, nodes, by=["page_id"]).collect()}
    assert got == {1: ("blocked", True), 2: ("ok", False)}
    assert agent.to_wire(agent.assemble(pages, nodes, by=["page_id"]), by=["page_id"]).count() == 1


def test_content_merges_windows_and_hides_secrets(spark):
    nodes = spark.createDataFrame([(1, 0, False), (1, 1, True)], "page_id long, node int, secret boolean")
    results = spark.createDataFrame([(1, 0, "text", 1, "x" * 50 + "tail"), (1, 0, "text", 0, "head "), (1, 1, "value", 0, "hunter2"), (1, 1, "placeholder", 0, "pw")], "page_id long, node int, field string, window int, text string")
    got = {r.node: r.content for r in agent.contents(results, nodes, by=["page_id"]).collect()}
    assert got == {0: {"text": "head tail"}, 1: {"placeholder": "pw", "value": "[SECRET]"}}


def test_budget_is_applied_below_python(spark, folder):
    """Content is cut before a tagger sees it: its filter stands beneath the Python node."""
    from mistveil.operators import detect as D

    nodes = W.nodes_of(spark.read.parquet(f"{folder}/pages.parquet"))
    units = W.numbered_units(W.units_of(nodes)).join(nodes.select("page_id", "node", "visible", "inside_interactive"), ["page_id", "node"]).withColumn("distance", F.lit(0))
    kept = budget.select_units(units, by=["page_id"], max_chars=500, max_units=10).where("kept").withColumn("origin", F.lit("https://x.example"))
    tagged = D.with_spans(kept, D.tagger(lambda texts: [[] for _ in texts]))
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython [tag(") :]
    assert "Window" in below and "Filter" in below
