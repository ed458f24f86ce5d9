"""Quality classifier: hierarchical empirical Bayes over document, path and host.

A logistic model turns rates of the text into a probability. Means of these
per host and per path of a host become posteriors: sparse paths are drawn to
their host, sparse hosts to the global mean, as strongly as the spread between
groups says. A document's score combines its own evidence with the posterior
of its path, its own part of that left out.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import measure_quality, ratios
from .toxicity import labelled_sample


def evidence(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, keys: dict[str, Column], usable: Column, max_labels: int) -> DataFrame:
    """id, the keys, and p: the probability that the text is good, from its rates alone; 0.5 without labels of both kinds."""
    marked = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *[v.alias(k) for k, v in keys.items()])
    rates = measure_quality(marked)
    short = F.greatest(F.lit(0.0), 1 - F.col("n_words") / 50)
    dense = F.array(*[v for k, v in ratios().items() if k != "n_words"], F.log1p("n_words"), short)
    table = stored(rates.select("id", *keys, dense.alias("features")), "rates")
    sample = labelled_sample(labels, id=id, label=label, usable=usable, max_labels=max_labels)
    known = table.join(F.broadcast(sample), table["id"] == F.col("_mv_id")).select("features", F.col("_mv_label").cast("double").alias("label"))
    known = stored(known, "learned").select(array_to_vector("features").alias("features"), "label")
    if known.agg(F.count_distinct("label")).first()[0] < 2:
        return table.select("id", *keys, F.lit(0.5).alias("p"))
    model = LogisticRegression(regParam=1e-4, maxIter=50).fit(known)
    told = model.transform(table.withColumn("features", array_to_vector("features")))
    return told.select("id", *keys, vector_to_array("probability")[1].alias("p"))


def _strength(groups: DataFrame, around: str) -> float:
    """Pseudo-count of the prior by the method of moments: how much groups spread around it beyond what their sizes explain."""
    m, off, n = F.col(around), F.col("s") / F.col("n") - F.col(around), F.col("n")
    spread, noise = groups.agg(F.sum(n * off * off) / F.sum(n), F.sum(m * (1 - m)) / F.sum(n)).first()
    level = groups.agg(F.sum(n * m * (1 - m)) / F.sum(n)).first()[0]
    if not level:
        return 1.0
    return float(min(max(level / max(spread - noise, 1e-6) - 1, 1.0), 1e4))


def _logit(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(safe / (1 - safe))


def score_quality(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", host: Column, path: Column, sites: DataFrame | None = None, label: str = "quality", usable: Column | None = None, max_labels: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row a row of docs: id, host, path, evidence, host_posterior, path_posterior, score, kept.

    host and path: columns over docs; null is a group of its own. sites: id,
    host, path of those documents that have a better known place. usable: which
    rows of labels may be learned from (all by default), at most max_labels of
    them; all rows count for the posteriors. Repeated rows each count; null ids
    stay null and have no label; null and empty texts have evidence like any
    other; texts of any length are read whole; other columns of docs are not
    read, whatever their names; empty docs: no rows.
    """
    scored = stored(evidence(docs, labels, id=id, text=text, label=label, keys={"host": host.cast("string"), "path": path.cast("string")}, usable=F.lit(True) if usable is None else usable, max_labels=max_labels), "evidence")
    if sites is not None:
        placed = sites.select(F.col("id").alias("_mv_id"), F.col("host").alias("_host"), F.col("path").alias("_path"))
        better = scored.join(placed, F.col("id") == F.col("_mv_id"), "left")
        known = F.col("_mv_id").isNotNull()
        scored = stored(better.select("id", "p", *[F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("host", "path")]), "placed")
    mean = scored.agg(F.avg("p")).first()[0] or 0.5
    keyed = scored.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    paths = stored(keyed.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("mean", F.lit(mean))
    hosts = stored(hosts, "hosts")
    k_host = _strength(hosts, "mean")
    hosts = hosts.select("host", ((k_host * mean + F.col("s")) / (k_host + F.col("n"))).alias("host_posterior"))
    groups = stored(paths.join(hosts, "host"), "groups")
    k_path = _strength(groups, "host_posterior")
    joined = keyed.join(groups, ["host", "path"])
    drawn = lambda s, n: (k_path * F.col("host_posterior") + s) / (k_path + n)
    others = drawn(F.greatest(F.col("s") - F.col("p"), F.lit(0.0)), F.col("n") - 1)
    logit = _logit(F.col("p")) + _logit(others) - _logit(F.lit(mean))
    out = joined.withColumn("path_posterior", drawn(F.col("s"), F.col("n"))).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select(F.col("id").alias(id), "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept"))


def sites_of_pages(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """id, host, path for each document whose id ends the URL of a page; path is the URL's first folder. Of several pages the smallest host counts."""
    number = F.regexp_extract(url, r"/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))
    folder = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)/", 1)
    found = pages.where(number != "").groupBy(number.cast("long").alias("id")).agg(F.min(F.struct(host.alias("host"), folder.alias("path"))).alias("at"))
    return found.select("id", "at.host", "at.path")
