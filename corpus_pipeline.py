"""The corpus pipeline: filter, deduplicate, decontaminate and mix documents.

run() applies STAGES one after another; each stage's result is written as
Parquet to the shared folder and read again by the next. All stages but the
last return the columns of documents; the last adds copy, the number of the
copy of a document that the mix repeats.
"""

from __future__ import annotations

from mistveil.llm.common import stored, table
from mistveil.llm.decontaminate import drop_contaminated
from mistveil.llm.lines import dedup_lines
from mistveil.llm.mixing import mix
from mistveil.llm.quality_rules import keep_good
from mistveil.llm.simhash import near_dedup


def quality_rules(spark, docs, sf_dir):
    """Documents that break a rule go.

    Null and empty texts have no words and go; texts of any length are read whole; rows that repeat are judged each;
    an empty table gives no rows; other columns stay as they are, whatever their names.
    """
    return keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines that many documents hold stay in one of them, the largest id.

    Null texts become empty and stay; texts of any length are split whole; rows equal in id and text are treated alike,
    null is an id; an empty table gives no rows; n_lines and n_dropped of docs stay as they are.
    """
    return dedup_lines(docs).select(*docs.columns)


def simhash_dedup(spark, docs, sf_dir):
    """Of each group of near-duplicates one document stays: the smallest id, null last, then the smallest digest of its text.

    Null and empty texts are one group; texts of any length count whole; of repeated rows one stays; an empty table gives
    no rows; other columns stay as they are, whatever their names.
    """
    return near_dedup(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; texts of any length are searched whole; rows that repeat go or stay together;
    an empty table on either side takes nothing away; other columns stay as they are.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Documents as often as the mix takes them, with copy (a column of that name is replaced).

    Null texts have size 0 and a null source is a source; texts of any length count whole; repeated rows draw alike;
    an empty table gives no rows.
    """
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Fingerprint components and edit distances are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
