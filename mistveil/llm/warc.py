"""WARC archives: write pages with revisit records, read them back by boundary chains.

Reading starts from every place where the magic "WARC/1." stands, in parallel
over splits of the files. Most are record starts, some lie inside payloads.
Each candidate names the offset where its successor must start; only those
reachable from the start of their file are records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

MAGIC = "WARC/1."
CRLF, BLANK = "\r\n", "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"

#: Digits of base 32 as conv() and as RFC 4648 write them.
_CONV_DIGITS, _RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary or string column as 32 upper-case base32 characters."""
    hexed = F.sha1(payload.cast("binary"))
    fifths = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*fifths), _CONV_DIGITS, _RFC_DIGITS)


def _header(name: str, value: Column) -> Column:
    """A header line; a null value gives none. Line ends inside the value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def _page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record a row, each Spark task its own file.

    Of rows with equal payloads (UTF-8 html; null: empty) of at least
    min_revisit_bytes, those with the largest id are responses and the others
    revisit it. Rows that share id and payload get records of the same type; what
    is null leaves its header out; payloads of any length are written whole; an empty table makes no record; other columns
    are not read.
    Writing goes through Spark's text writer, so any store that Spark reaches will do.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    hashed = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumns({"bytes": F.octet_length("payload"), "digest": base32_sha1(F.col("payload"))})
    equal = hashed.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    equal = stored(equal.where("n > 1").select("digest", "keeper"), "equal-payloads")
    joined = hashed.join(equal, "digest", "left")
    revisits = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    block = F.concat(F.lit(HTTP_HEAD + BLANK), F.when(revisits, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _page_urn(F.col("id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisits, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(revisits, _page_urn(F.col("keeper")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(BLANK),
        F.col("block"),
    )
    joined.withColumn("block", block).select(record.alias("value")).write.option("lineSep", BLANK).text(path)


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("head"), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, in order of (file, block, row)."""
    found = spark.read.option("lineSep", MAGIC).text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _in_file(first: int, last: int):
    return Window.partitionBy("file").orderBy("block", "row").rowsBetween(first, last)


def _placed(segments: DataFrame) -> DataFrame:
    """Adds start, the offset of the magic in front of a segment; the first segment of a file has none and gets -7.

    Sizes are summed per block of a file first, so a task sees the segments of one block, or one number a block.
    """
    size = F.col("size") + len(MAGIC)
    blocks = segments.groupBy("file", "block").agg(F.sum(size).alias("of_block"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("of_block").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = rows.join(blocks, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return rows.withColumn("start", F.col("earlier") + F.col("inside") - len(MAGIC)).drop("earlier", "inside", "_file", "_block")


def _payload_columns(content: Column) -> dict[str, Column]:
    """Size and digest of what follows the HTTP headers in a record's content (binary)."""
    http = F.octet_length(F.substring_index(content.cast("string"), BLANK, 1)) + len(BLANK)
    payload = F.substring(content, http + 1, F.octet_length(content))
    return {"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload)}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row a magic: file, start, next_start (null if no header follows), and what the record says if it is one."""
    head = F.substring_index("value", BLANK, 1)
    seen = _segments(spark, path).withColumn("head", head).withColumn("size", F.octet_length("value"))
    length = F.expr("try_cast(length AS bigint)")
    seen = seen.withColumn("length", _field("Content-Length")).withColumn("length", length).withColumn("head_size", F.octet_length("head") + len(BLANK))
    valid = F.col("head").rlike(r"^[01]\r\n") & (F.col("head_size") <= F.col("size")) & (F.col("length") >= 0)
    whole = valid & (F.col("head_size") + F.col("length") <= F.col("size"))
    content = F.substring(F.col("value").cast("binary"), F.col("head_size") + 1, F.col("length").cast("int"))
    seen = seen.withColumn("content", F.when(whole, content))
    read = seen.select(
        "file", "block", "row", "size", "head_size", F.when(valid, F.col("length")).alias("length"), F.coalesce(whole, F.lit(False)).alias("whole"),
        *[_field(n).alias(c) for n, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "url"))],
        *[v.alias(k) for k, v in _payload_columns(F.col("content")).items()],
    )
    placed = _placed(read).where(F.col("start") >= 0)
    following = F.col("start") + len(MAGIC) + F.col("head_size") + F.col("length") + len(BLANK)
    return placed.withColumn("next_start", F.when(F.col("length").isNotNull(), following)).drop("row")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from the start of their file reaches.

    Candidates of one block of a file whose successor is the next candidate
    form runs. A run leads to one offset, so pointer jumping needs only the runs: it doubles the jumps
    until no further run is reached.
    """
    order = Window.partitionBy("file", "block").orderBy("start")
    linked = found.withColumn("follows", F.coalesce(F.lag("next_start").over(order) == F.col("start"), F.lit(False)))
    first = F.max(F.when(~F.col("follows"), F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = stored(linked.withColumn("run", first).drop("follows", "block"), "warc-candidates")
    exits = runs.groupBy("file", "run").agg(F.max_by("next_start", "start").alias("exit"))
    # Where runs lead to, and which run that place belongs to.
    targets = exits.select("file", F.col("exit").alias("start")).where("start IS NOT NULL").unionByName(runs.where("start = 0").select("file", "start")).distinct()
    entries = targets.join(runs.select("file", "start", "run"), ["file", "start"]).join(exits, ["file", "run"])
    entries = stored(entries.select("file", "start", "run", "exit"), "warc-entries")
    jumps = entries.select("file", "start", F.col("exit").alias("to"))
    reached = stored(entries.where("start = 0").select("file", "start"), "warc-reached")
    count = reached.count()
    while count:
        step = reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start")).join(entries.select("file", "start"), ["file", "start"], "left_semi")
        reached = stored(reached.unionByName(step).distinct(), "warc-reached")
        if (now := reached.count()) == count:
            break
        count = now
        onward = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("then"))
        jumps = stored(jumps.join(onward, ["file", "to"]).select("file", "start", F.col("then").alias("to")), "warc-jumps")
    entered = reached.join(entries, ["file", "start"]).groupBy("file", "run").agg(F.min("start").alias("entered"))
    return runs.join(entered, ["file", "run"]).where("start >= entered").drop("entered", "run")


def _split_payloads(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """Payload columns of records whose payload holds the magic: their segments are put together again."""
    files = broken.select("file").distinct()
    parts = _segments(spark, path).join(files, "file", "left_semi").withColumn("size", F.octet_length("value"))
    parts = _placed(parts).join(broken.select("file", "start", "next_start", "head_size", "length"), ["file", "start"], "left")
    so_far = _in_file(Window.unboundedPreceding, Window.currentRow)
    columns = ("next_start", "head_size", "length")
    owner = F.last(F.when(F.col("next_start").isNotNull(), F.struct("start", *columns)), ignorenulls=True).over(so_far)
    owned = parts.withColumn("owner", owner).where(F.col("start") < F.col("owner.next_start"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "value")))
    joined = owned.groupBy("file", "owner").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), MAGIC).cast("binary").alias("bytes"))
    content = F.substring(F.col("bytes"), F.col("owner.head_size") + 1, F.col("owner.length").cast("int"))
    cut = joined.where(F.octet_length("bytes") >= F.col("owner.head_size") + F.col("owner.length")).withColumn("content", content)
    return cut.select("file", F.col("owner.start").alias("start"), *[v.alias(k) for k, v in _payload_columns(F.col("content")).items()])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under path: file, start, length, record_type, record_id, refers_to, url, payload_bytes, payload_digest.

    The payload is what follows the HTTP headers; its size and digest come from
    the bytes read. A record that ends after its file does is left out; an
    empty folder gives no rows. Files need not come from write_warc().
    """
    records = stored(reachable(candidates(spark, path)), "warc-records")
    broken = stored(records.where("NOT whole"), "warc-broken")
    columns = ("file", "start", "length", "record_type", "record_id", "refers_to", "url", "payload_bytes", "payload_digest")
    complete = records.where("whole").select(*columns)
    if broken.isEmpty():
        return complete
    mended = broken.drop("payload_bytes", "payload_digest").join(_split_payloads(spark, path, broken), ["file", "start"])
    return complete.unionByName(mended.select(*columns))


def pages_of(records: DataFrame) -> DataFrame:
    """Rows of read_warc() as pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has its response's payload; one whose response is not there
    stays, with null payload columns. Records without a page's id have none.
    """
    number = lambda c: F.when(F.regexp_like(c, F.lit(r"^<urn:page:-?\d+>$")), F.regexp_extract(c, r"(-?\d+)>$", 1)).cast("long")
    pages = records.withColumns({"page_id": number(F.col("record_id")), "refers_to": number(F.col("refers_to"))})
    own = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = pages.where("record_type = 'response'").select(*own)
    full = responses.where("page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    revisits = pages.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(full, "refers_to", "left")
    return responses.unionByName(revisits.select(*own))
