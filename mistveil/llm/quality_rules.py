"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the row itself, so that the rules
run inside the scan's stage: no shuffle, no user functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, ratio

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "at", "this", "from", "or", "by", "an", "not",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "sur", "au", "en", "avec", "pas", "il",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "dem", "ein", "eine", "nicht", "auf", "sich", "als", "auch", "für", "in",
    "el", "los", "las", "y", "del", "se", "con", "por", "una", "su", "al", "lo", "como", "es", "no", "mi", "sus", "para",
)

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("not_repeating", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("few_symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("few_repeated_lines", "dup_line_ratio", high=0.5),
    Rule("few_capitals", "capital_ratio", high=0.5),
)


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def normalized(text: Column) -> Column:
    """The words of a text, a space after each."""
    ended = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    return F.ltrim(F.regexp_replace(ended, SPACES, " "))


def n_repeat_words(norm: Column, width: int = 3) -> Column:
    """Words inside windows of width words that the text holds at least twice.

    Windows are sorted with their positions, so that equal ones are neighbours.
    Texts whose windows are all different are told by a hash set before that.
    """
    windows = F.regexp_extract_all(norm, F.lit("(?=(" + " ".join(["[^ ]++"] * width) + "))[^ ]++ "), F.lit(1))

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))

        def repeated(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(x["g"] == F.get(s, j)["g"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(same(x, i, i - 1) | same(x, i, i + 1), x["p"]))
            return F.size(F.array_distinct(F.flatten(F.transform(F.array_compact(marked), lambda p: F.sequence(p, p + (width - 1))))))

        return let(placed, repeated)

    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))).cast("long")


def measures(text: Column, norm: Column, stop_words=STOP_WORDS) -> dict[str, Column]:
    """The counts of a text, by name; null counts as empty. norm: a column that holds normalized(text)."""
    whole = F.coalesce(text, F.lit(""))
    n_words = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return {
        "n_words": n_words.cast("long"),
        "word_chars": (F.length(norm) - n_words).cast("long"),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(norm),
        "n_lines": (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_capitals": F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter(F.split(norm, " "), lambda w: w.isin(*dict.fromkeys(stop_words)))).cast("long"),
    }


def ratios() -> dict[str, Column]:
    """Measures that the rules may name, over the columns that measures() gives."""
    c = F.col
    return {
        "n_words": c("n_words").cast("double"),
        "repeat_ratio": ratio(c("n_repeat_words"), c("n_words")),
        "mean_word_chars": ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": ratio(c("n_symbols"), c("word_chars")),
        "stop_ratio": ratio(c("n_stop_words"), c("n_words")),
        "dup_line_ratio": ratio(c("n_dup_lines"), c("n_lines")),
        "capital_ratio": ratio(c("n_capitals"), c("word_chars")),
    }


def compile_rules(rules) -> dict[str, Column]:
    """A boolean column for each rule."""
    known, out = ratios(), {}
    for r in rules:
        bounds = [known[r.measure] >= r.low] * (r.low is not None) + [known[r.measure] <= r.high] * (r.high is not None)
        out[r.name] = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
    return out


def _judged(docs: DataFrame, text: str, rules) -> DataFrame:
    """measure_quality() with a row number _mv_at.

    A filter that uses _mv_at stays above the counts: pushed below them, it
    would compute them anew for each rule that names them.
    """
    counts = measures(F.col(text), F.col("_mv_norm"))
    added = {*counts, "base_failed", "failed_rules", "kept", "_mv_norm", "_mv_at"}
    kept = [c for c in docs.columns if c not in added]
    normal = docs.withColumn("_mv_norm", normalized(F.col(text)))
    counted = normal.select(*kept, *[v.alias(k) for k, v in counts.items()], F.monotonically_increasing_id().alias("_mv_at"))
    failed = F.array_compact(F.array(*[F.when(~passes, F.lit(name)) for name, passes in compile_rules(rules).items()]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.withColumn("base_failed", base).withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def measure_quality(docs: DataFrame, *, text: str = "text", rules=RULES) -> DataFrame:
    """docs with its counts, base_failed, failed_rules and kept.

    Null and empty texts have no words and fail; texts of any length are
    counted whole; repeated rows are judged each on its own; an empty table
    gives no rows; columns of docs with the names that this adds are replaced.
    """
    return _judged(docs, text, rules).drop("_mv_at")


def keep_good(docs: DataFrame, *, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    Null and empty texts do not pass; long texts, repeated rows and an empty
    table as in measure_quality(); columns of any names stay as they are.
    """
    marked = docs.select(F.struct(*docs.columns).alias("_mv_row"), F.col(text).alias("text"))
    return _judged(marked, "text", rules).where("kept AND _mv_at >= 0").select("_mv_row.*")
