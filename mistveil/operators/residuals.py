"""What identifiers are left in observations: every string of a JSON value, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import public_score
from ..functions.spans import pattern_spans, piece
from ..sources.tables import written

#: Fixed value: keys whose values are pixels, not text.
SKIPPED_KEYS = ("images",)


def strings_of(rows: DataFrame, *, by: list[str], json: str = "json", skipped: tuple[str, ...] = SKIPPED_KEYS) -> DataFrame:
    """One row a string in a JSON text: by, path ("$.a[0].b"), text; values under a key of skipped, at any depth, are left out.

    Each round explodes one level of all values at once; there are as many
    rounds as levels in the deepest value. Keys are no strings. Null and
    malformed texts give no rows.
    """
    level = rows.select(*by, F.lit("$").alias("path"), F.try_parse_json(json).alias("_v")).where("_v IS NOT NULL")
    found = None
    while True:
        kind = F.schema_of_variant("_v")
        typed = written(level.withColumn("_kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")), "level")
        texts = typed.where("_kind = 'string'").select(*by, "path", F.variant_get("_v", "$", "string").alias("text"))
        found = texts if found is None else found.unionByName(texts)
        inner = typed.where("_kind IN ('object', 'array')")
        if not inner.limit(1).count():
            return found
        inner.createOrReplaceTempView("_mistveil_level")
        names = ", ".join(f"r.`{c}`" for c in by)
        apart = rows.sparkSession.sql(f"SELECT {names + ', ' if by else ''}r.path AS _path, r._kind AS _of, e.pos AS _pos, e.key AS _key, e.value AS _v FROM _mistveil_level r, LATERAL variant_explode(r._v) e")
        rows.sparkSession.catalog.dropTempView("_mistveil_level")
        step = F.when(F.col("_of") == "object", F.concat(F.lit("."), F.col("_key"))).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        kept = apart.where((F.col("_of") == "array") | ~F.col("_key").isin(*skipped)) if skipped else apart
        level = kept.select(*by, F.concat("_path", step).alias("path"), "_v")


def residual_kind(text: Column, span: Column, origin: Column) -> Column:
    """The kind of a span left in a text: its type, or EMAIL_LIKELY_PUBLIC for addresses that the page's origin makes probably public."""
    public = (span["type"] == "EMAIL") & (public_score(piece(text, span), origin) > 0)
    return F.when(public, "EMAIL_LIKELY_PUBLIC").otherwise(span["type"])


def residual_scan(rows: DataFrame, *, by: list[str], json: str = "json", origin: Column | None = None) -> DataFrame:
    """Per row of by: kind and n of what is left in the strings of its JSON, and kind null with the number of strings looked at. No values.

    origin is an expression over columns of by: the origin of the observation's page.
    """
    strings = written(strings_of(rows, by=by, json=json), "strings")
    spans = strings.select(*by, "text", (F.lit("") if origin is None else origin).alias("_origin"), F.explode(pattern_spans(F.col("text"))).alias("_s"))
    hits = spans.groupBy(*by, residual_kind(F.col("text"), F.col("_s"), F.col("_origin")).alias("kind")).agg(F.count("*").alias("n"))
    scanned = strings.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(None).cast("string").alias("kind"), "n")
    return hits.unionByName(scanned)
