"""Importance resampling toward a target: hashed n-gram counts, an integer gain a bucket, Gumbel scores, top draws.

Texts are read in blocks of bounded size. A block has a dictionary of its
distinct words; an n-gram is a tuple of their ids, packed into one integer, so
counting works on integers alone. The bytes of each distinct tuple are put
together and hashed once a block, and the buckets go back to the tuple's places
by its number. A dictionary of all documents would send every word of the
corpus through a shuffle for the same buckets; blocks need none. The buckets
of a text are stored, so that neither counting them nor weighing texts reads
or hashes words again.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import digest, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of texts in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def blocks(batch: pa.RecordBatch, column: str):
    """The rows of a batch as slices with about BLOCK_BYTES of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def hashed_runs(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words a text, buckets of all its runs of 1 to n words, where each text's buckets start and end)."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    words, doc = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")
    coded, doc = words.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)]
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # the bytes of each distinct run, and for each place the number of the run that starts there
    runs, number = spelled, ids
    found, owners = [], []
    for length in range(1, n + 1):
        m = max(0, len(doc) - length + 1)
        whole = doc[:m] == doc[length - 1 :]  # runs do not go on into the next text
        if length > 1:
            tuples = number[:m][whole] * len(spelled) + ids[length - 1 :][whole]
            coded_tuples, distinct = pd.factorize(tuples)
            runs = [runs[t // len(spelled)] + b" " + spelled[t % len(spelled)] for t in distinct.tolist()]
            number = np.zeros(m, np.int64)
            number[whole] = coded_tuples
        spot = np.fromiter((crc32(r) % buckets for r in runs), np.int64, len(runs))
        found.append(spot[number[:m][whole]])
        owners.append(doc[:m][whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts))
    return np.bincount(doc, minlength=len(texts)), np.concatenate(found)[order], np.concatenate([[0], np.cumsum(counts)])


def _hashed(texts: DataFrame, n: int, buckets: int, name: str) -> DataFrame:
    """Stored rows of texts (_id, _text, _d1, _d2): n_words and buckets, the buckets of a text's runs as binary."""
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def read(batches):
        for batch in batches:
            for part in blocks(batch, "_text"):
                words, found, ends = hashed_runs(part.column("_text"), n, buckets)
                data = pa.py_buffer(found.astype(width).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((ends * width.itemsize).astype("<i4").tobytes()), data])
                kept = [part.column(c) for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int64()), packed], names=[*[c for c in part.schema.names if c != "_text"], "n_words", "buckets"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "_text")
    return stored(texts.mapInArrow(read, f"{kept + ', ' if kept else ''}n_words long, buckets binary"), name)


def bucket_counts(hashed: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how often each bucket comes in stored texts; a task sends one row a bucket."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                n += np.bincount(np.frombuffer(data.as_buffer(), width), minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["bucket", "n"])

    return hashed.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket floor(1000 * ln of how much likelier it is in the target), with add-one counts; as many rows as buckets, whatever the data."""
    sides = [bucket_counts(d, buckets).withColumnRenamed("n", name) for d, name in ((source, "s"), (target, "t"))]
    rows = sides[0].join(sides[1], "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[rows["bucket"]], t[rows["bucket"]] = rows["s"], rows["t"]
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _noise(id: Column, seed: int) -> Column:
    """floor of 1000 times standard Gumbel noise, drawn by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 2, buckets: int = 10_000, seed: int = 7, min_words: int = 20, percent: int = 25) -> DataFrame:
    """One row a document: id, n_features, weight, score, rank, and _d1, _d2, a digest of its text.

    Of the documents with at least min_words words, floor(percent * N / 100) with the highest scores are
    drawn and ranked from 1; others have a null rank. Ties go to the smaller id, null ids last, then to the
    digest; equal rows are interchangeable. Null and empty texts have no features and weight 0, as has every
    text where documents and target are both empty of words. No documents give no rows; without target texts
    all buckets are rated against none. Very long texts are blocks of their own. Columns other than id and
    text are not looked at.
    """
    hashed = _hashed(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *[h.alias(f"_d{i + 1}") for i, h in enumerate(digest(F.col(text)))]), n, buckets, "hashed")
    wanted = _hashed(target.select(F.col(text).alias("_text")), n, buckets, "target")
    gain = docs.sparkSession.sparkContext.broadcast(gains(hashed, wanted, buckets))  # `buckets` numbers
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    @F.pandas_udf("long")
    def weigh(packed: pd.Series) -> pd.Series:
        return pd.Series([int(gain.value[np.frombuffer(b, width)].sum()) // max(1, len(b) // width.itemsize) for b in packed], dtype="int64")

    weighed = hashed.select("_id", "_d1", "_d2", "n_words", F.floor(F.length("buckets") / width.itemsize).alias("n_features"), weigh("buckets").alias("weight"))
    scored = stored(weighed.withColumn("score", F.col("weight") + _noise(F.col("_id"), seed)), "scored")
    eligible = F.col("n_words") >= min_words
    drawn = scored.where(eligible).count() * percent // 100
    placed = numbered(scored.where(eligible), [F.desc("score"), F.asc_nulls_last("_id"), "_d1", "_d2"], name="_place")
    ranked = placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop("_place")
    both = ranked.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("_id").alias(id), "n_features", "weight", "score", "rank", "_d1", "_d2")


def resample(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents drawn by importance_scores(), with their columns.

    Rows are found again by id and text; if rows equal in both lie on either side of the cut, all of them stay.
    """
    drawn = importance_scores(docs, target, id=id, text=text, **settings).where("rank IS NOT NULL").select(F.col(id).alias("_drawn_id"), "_d1", "_d2").distinct()
    own = digest(F.col(text))
    return docs.join(drawn, F.col(id).eqNullSafe(F.col("_drawn_id")) & own[0].eqNullSafe(F.col("_d1")) & own[1].eqNullSafe(F.col("_d2")), "left_semi")
