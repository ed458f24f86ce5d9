"""Web pages as node tables and content units.

Parsing is a small Python function per page, run in Arrow batches; everything
after it is relational. Without a browser there is no layout: a page's nodes
count as visible unless the markup itself hides them, and boxes are null.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import window_texts

#: Fixed values of HTML and of the rules for nodes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STRIPPED = frozenset(("head", "script", "style", "noscript", "template"))
MARKERS = {"iframe": "iframe_skipped", "canvas": "canvas_skipped", "svg": "svg_skipped", "video": "video_skipped"}
INTERACTIVE_TAGS = ("a", "button", "input", "select", "textarea", "summary", "details")
INTERACTIVE_ROLES = ("button", "link", "checkbox", "radio", "menuitem", "tab", "switch")
NATIVE_ROLES = {"a": "link", "button": "button", "nav": "navigation", "header": "banner", "footer": "contentinfo", "main": "main", "img": "img", "textarea": "textbox"}
FLAGS = (("error", r"error|invalid"), ("disabled", r"disabled"), ("active", r"\b(?:active|selected|current)\b"), ("hidden", r"\bhidden\b|d-none|invisible"))
SECRET_AUTOCOMPLETE = ("current-password", "new-password", "one-time-code", "cc-csc", "cc-number")
SECRET_WORDS = frozenset(("otp", "cvv", "cvc", "pin"))
#: Start tags that end an open element of these tags.
CLOSES = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",))}

NODE = (
    "node int, parent int, tag string, role string, text string, href string, src string, value string, placeholder string, name string, type string, attr_name string, "
    "class string, marker string, secret boolean, visible boolean, interactive boolean, inside_interactive boolean, image string, state map<string,boolean>, flags array<string>, "
    "in_landmark boolean, near_contact_heading boolean, in_contact_markup boolean, in_ugc_block boolean, form_origin string, fields array<string>, last int"
)
_NAMES = [part.strip().split(" ")[0] for part in re.sub(r"<[^>]*>", "", NODE).split(",")]


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    """Builds a tree with the implied end tags of lists, tables and paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.root.attrs.update({k: v or "" for k, v in attrs})
            return
        closes = CLOSES.get(tag, ())
        if closes and len(self.open) > 1 and self.open[-1].tag in closes:
            self.open.pop()
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def is_secret(attrs: dict[str, str]) -> bool:
    """Password fields, secret autocomplete values, and names with a word like otp, cvv, cvc or pin (but not a pin code)."""
    auto = attrs.get("autocomplete", "").lower()
    if attrs.get("type", "").lower() == "password" or any(x in SECRET_AUTOCOMPLETE or x.startswith("cc-exp") for x in auto.split()):
        return True
    for key in ("name", "id"):
        parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", attrs.get(key, ""))]
        for at, part in enumerate(parts):
            if part in SECRET_WORDS and not (part == "pin" and parts[at + 1 : at + 2] == ["code"]):
                return True
    return False


def _hidden(el: Element) -> bool:
    style = re.sub(r"\s+", "", el.attrs.get("style", "").lower())
    return "hidden" in el.attrs or "display:none" in style or "visibility:hidden" in style or (el.tag == "input" and el.attrs.get("type", "").lower() == "hidden")


def _interactive(el: Element) -> bool:
    return el.tag in INTERACTIVE_TAGS or el.attrs.get("role") in INTERACTIVE_ROLES


def _role(el: Element) -> str | None:
    if el.attrs.get("role"):
        return el.attrs["role"]
    if el.tag == "input":
        kind = el.attrs.get("type", "text").lower()
        return kind if kind in ("checkbox", "radio") else "button" if kind in ("button", "submit") else "textbox"
    return NATIVE_ROLES.get(el.tag)


def _state(el: Element) -> dict[str, bool] | None:
    a, state = el.attrs, {}
    if el.tag in ("input", "select", "textarea", "button") and "disabled" in a:
        state["disabled"] = True
    if el.tag == "input" and a.get("type", "").lower() in ("checkbox", "radio"):
        state["checked"] = "checked" in a
    if el.tag == "input" and "readonly" in a:
        state["readonly"] = True
    if el.tag in ("input", "select", "textarea") and "required" in a:
        state["required"] = True
    if el.tag == "option" and "selected" in a:
        state["selected"] = True
    if a.get("aria-expanded") in ("true", "false"):
        state["expanded"] = a["aria-expanded"] == "true"
    return state or None


def _accessible_name(el: Element, by_id: dict, labels: dict) -> str:
    named = (by_id[i].text().strip() for i in el.attrs.get("aria-labelledby", "").split() if i in by_id)
    if found := " ".join(filter(None, named)):
        return found
    if el.attrs.get("aria-label", "").strip():
        return el.attrs["aria-label"].strip()
    if el.attrs.get("id") in labels and (found := labels[el.attrs["id"]].text().strip()):
        return found
    up = el
    while up is not None and up.tag != "label":
        up = up.parent
    if up is not None and (found := up.text().strip()):
        return found
    return el.attrs.get("alt", "").strip() or el.attrs.get("title", "").strip()


def parse_page(url: str | None, html: str | None) -> list[dict]:
    """The kept nodes of a page in document order; null or empty pages have none."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    by_id, labels, controlled, inner = {}, {}, set(), {}
    todo, order = [tree.root], []
    while todo:
        el = todo.pop()
        order.append(el)
        by_id.setdefault(el.attrs.get("id"), el)
        if el.tag == "label" and el.attrs.get("for"):
            labels.setdefault(el.attrs["for"], el)
        controlled.update(el.attrs.get("aria-controls", "").split())
        todo.extend(c for c in reversed(el.children) if not isinstance(c, str))
    for el in reversed(order):  # children before parents
        inner[el] = any(_interactive(c) or inner[c] for c in el.children if not isinstance(c, str))
    nodes: list[dict] = []
    start = {"parent": None, "landmark": False, "heading": False, "contact": False, "ugc": False, "main": False, "form": None, "active": False}
    work = [(tree.root, start)]
    while work:
        item, up = work.pop()
        hints = lambda c: {"in_landmark": c["landmark"], "near_contact_heading": c["heading"], "in_contact_markup": c["contact"], "in_ugc_block": c["ugc"]}
        if isinstance(item, str):
            if item.strip() and not (up["landmark"] and not up["of_interactive"]) and not up["hidden"]:
                nodes.append(dict.fromkeys(_NAMES) | hints(up) | {"node": len(nodes), "parent": up["parent"], "tag": "#text", "text": item, "visible": True, "interactive": False, "inside_interactive": up["active"], "secret": False, "fields": ["text"]})
            continue
        el, a = item, item.attrs
        if el.tag in STRIPPED:
            continue
        if el.tag in MARKERS:
            nodes.append(dict.fromkeys(_NAMES) | {"node": len(nodes), "parent": up["parent"], "tag": el.tag, "marker": MARKERS[el.tag], "visible": True, "interactive": False, "inside_interactive": up["active"], "secret": False, "fields": []})
            continue
        hidden, interactive = _hidden(el), _interactive(el)
        live = a.get("aria-live") not in (None, "off")
        if hidden and not (interactive or inner[el] or el.tag == "details" or a.get("id") in controlled or live):
            continue
        here = dict(up)
        here["landmark"] = up["landmark"] or el.tag in ("header", "footer") or a.get("role") in ("banner", "contentinfo") or (el.tag == "nav" and not up["main"])
        here["main"] = up["main"] or el.tag in ("main", "article")
        here["contact"] = up["contact"] or bool(re.search(r"schema\.org/(?:ContactPoint|Organization)\b", a.get("itemtype", ""), re.I))
        ugc = re.search(r"schema\.org/(?:Review|Comment|UserComments)\b", a.get("itemtype", ""), re.I) or re.search(r"\b(?:comment|review|forum-post|user-post)\b", a.get("class", ""), re.I)
        here["ugc"] = up["ugc"] or bool(ugc)
        here["heading"] = up["heading"]
        here["of_interactive"], here["hidden"], here["active"] = interactive, hidden or up.get("hidden", False), up["active"] or interactive
        if el.tag == "form":
            target = urlsplit(urljoin(url or "", a.get("action", "")))
            here["form"] = f"{target.scheme}://{target.netloc}" if target.scheme and target.netloc else None
        if el is not tree.root and not (here["landmark"] and not interactive):
            secret = is_secret(a)
            name = _accessible_name(el, by_id, labels)
            value = "" if secret else el.text() if el.tag == "textarea" else a.get("value", "") if el.tag == "input" else ""
            style_url = re.search(r"background(?:-image)?\s*:[^;]*url\(", a.get("style", ""), re.I)
            kept = {"value": value, "placeholder": a.get("placeholder", ""), "href": a.get("href", ""), "src": a.get("src", ""), "name": name}
            fields = [f for f, v in zip(("value", "placeholder", "href", "src", "accessible_name"), kept.values(), strict=True) if v.strip()]
            flags = [f for f, p in FLAGS if any(re.search(p, c, re.I) for c in a.get("class", "").split())]
            nodes.append(
                dict.fromkeys(_NAMES) | hints(here) | {k: v or None for k, v in kept.items()}
                | {"node": len(nodes), "parent": up["parent"], "tag": el.tag, "role": _role(el), "type": a.get("type"), "attr_name": a.get("name"), "class": a.get("class"), "secret": secret, "visible": not here["hidden"], "interactive": interactive, "inside_interactive": here["active"], "image": "img" if el.tag == "img" else "background" if style_url else None, "state": _state(el), "flags": flags or None, "form_origin": here["form"] if el.tag in ("input", "select", "textarea", "button") else None, "fields": fields}
            )
            here["parent"] = nodes[-1]["node"]
        # Children after a contact heading are near it.
        batch, near = [], here["heading"]
        for child in el.children:
            batch.append((child, here | {"heading": near} if not isinstance(child, str) else here))
            if not isinstance(child, str) and re.fullmatch("h[1-6]", child.tag) and re.search("contact|support|help", child.text(), re.I):
                near = True
        work.extend(reversed(batch))
    for n in nodes:
        n["last"] = n["node"]
    for n in reversed(nodes):  # numbers below a node are larger, so its own is complete when it is passed on
        if n["parent"] is not None:
            nodes[n["parent"]]["last"] = max(nodes[n["parent"]]["last"], n["last"])
    return nodes


def nodes_of(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a kept node: page_id, page_url and the columns of NODE.

    Pages are dealt by id first: parsing costs far more than that exchange,
    and a few large row groups would otherwise be as many long tasks. The
    number of parts is given, as parts small in bytes would be merged again.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf(_array_type())
    def parse(urls: pd.Series, pages_: pd.Series) -> pd.Series:
        return pd.Series([parse_page(u, h) for u, h in zip(urls, pages_, strict=True)])

    return pages.select(*{id, url, html}).repartition(parts, id).select(F.col(id), F.col(url).alias("page_url"), F.inline(parse(F.col(url), F.col(html))))


def _array_type() -> str:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(NODE + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(NODE[at:i].strip())
            at = i + 1
    return "array<struct<" + ",".join(f"`{p.split(' ')[0]}`:{p.split(' ')[1]}" for p in parts) + ">>"


def units_of(nodes: DataFrame, *, id: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a content unit: page, node, field, window (number of the window of a long text), text, hints, is_mailto, and the node's columns in keep.

    Inline data is replaced; empty values give no unit.
    """
    inline = lambda c: F.when(c.rlike("^(data|blob):"), "[inline-data]").otherwise(c)
    value = F.create_map(
        F.lit("text"), F.col("text"), F.lit("value"), F.col("value"), F.lit("placeholder"), F.col("placeholder"),
        F.lit("href"), inline(F.col("href")), F.lit("src"), inline(F.col("src")), F.lit("accessible_name"), F.col("name"),
    )
    hints = F.struct("in_landmark", "near_contact_heading", "in_contact_markup", "in_ugc_block")
    fields = nodes.select(id, "page_url", "node", *keep, hints.alias("hints"), value.alias("_value"), F.posexplode("fields").alias("field_at", "field"))
    filled = fields.withColumn("_text", F.col("_value")[F.col("field")]).where("_text <> ''")
    windows = F.when(F.col("field") == "text", window_texts(F.col("_text"))).otherwise(F.array("_text"))
    mailto = (F.col("field") == "href") & F.lower("_text").startswith("mailto:")
    return filled.select(id, "page_url", "node", *keep, "field_at", "field", "hints", mailto.alias("is_mailto"), F.posexplode(windows).alias("window", "text"))


def title_of(html: Column) -> Column:
    """Text of a page's first title element, spaces collapsed; the five entities of markup are read. Empty if there is none."""
    text = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_level_units(pages: DataFrame, task: str, *, id: str = "page_id") -> DataFrame:
    """Units of a page as a whole, numbered after its content: its task (node -1), URL (-2, as href) and title (-3)."""
    unit = lambda i, field, text: F.struct(F.lit(-i).alias("node"), F.lit(field).alias("field"), F.lit((1 << 30) + i).alias("unit"), text.alias("text"))
    each = F.array(unit(1, "text", F.lit(task)), unit(2, "href", F.coalesce("url", F.lit(""))), unit(3, "text", title_of(F.col("html"))))
    return pages.select(id, F.col("url").alias("page_url"), F.explode(each).alias("_u")).select(id, "page_url", "_u.*", F.lit(0).alias("window"), F.lit(False).alias("is_mailto"))


def in_viewport(box: Column, width: Column, height: Column) -> Column:
    """Whether a box overlaps the viewport, half-open."""
    return (box["x"] < width) & (box["x"] + box["w"] > 0) & (box["y"] < height) & (box["y"] + box["h"] > 0)


def rounded(value: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(value + 0.5).cast("int")


def keeps_hidden(snapshot: Column) -> Column:
    """keep / strip / keep_hidden for a snapshot of layout flags."""
    hidden = snapshot["display_none"] | snapshot["visibility_hidden"] | snapshot["zero_size"] | snapshot["off_document"]
    excepted = snapshot["interactive"] | snapshot["has_interactive"] | snapshot["toggle_target"] | snapshot["aria_live"] | snapshot["hidden_label"]
    return F.when(~hidden, "keep").when(excepted, "keep_hidden").otherwise("strip")


def class_flags(classes: Column) -> Column:
    """Semantic flags of a class attribute, in order of first mention."""
    each = F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c != "")
    flags = F.transform(each, lambda c: F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(f)) for f, p in FLAGS])))
    return F.array_distinct(F.flatten(flags))


def numbered_units(units: DataFrame, *, id: str = "page_id") -> DataFrame:
    """units with unit: 0, 1, ... in document order, per page."""
    order = Window.partitionBy(id).orderBy("node", "field_at", "window")
    return units.withColumn("unit", F.row_number().over(order) - 1)
