"""LM scoring: a hidden Markov model over word classes, trained by Baum-Welch over all training documents.

Words map to classes: the most frequent words have a class each, all others
share hashed classes, and the end of a text has its own. The model emits
classes; inside a shared class a word has its add-one share of the class:

    P(text) = forward(classes) * product of P(word | class)

The number of classes grows with the square root of the vocabulary, so what
goes to the tasks stays small while word counts, a grouped aggregation over
all training documents, grow with the corpus. A bounded lexicon of the most
frequent words goes to the tasks; counts of all other words come by a join.
Every round of Baum-Welch sees all training documents, each as one sequence.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, id_crc, stored, words

#: The token at the end of each text; a space, so that no word equals it.
END = " "


@dataclass(frozen=True)
class Settings:
    """lexicon bounds what is broadcast; own and shared: classes for each unit of the square root of the vocabulary (own ones at most lexicon).

    Training stops after `rounds`, or once the mean log10 probability of a
    token has risen by less than `gain` in one. A round goes `stretch` times
    as far as Baum-Welch would, in the logarithms of the parameters, which
    takes fewer rounds to the same maximum; where that lowers the probability,
    the plain step is taken instead.
    """

    lexicon: int = 65_536
    own: float = 2.0
    shared: float = 1.0
    states: int = 8
    rounds: int = 40
    gain: float = 2e-3
    stretch: float = 1.8
    prior: float = 20.0
    seed: int = 7

    def classes(self, vocabulary: int) -> Classes:
        root = max(vocabulary, 1) ** 0.5
        return Classes(max(1, min(self.lexicon, ceil(self.own * root))), max(1, ceil(self.shared * root)))


@dataclass(frozen=True)
class Classes:
    own: int
    shared: int

    @property
    def n(self) -> int:
        return self.own + self.shared + 1

    @property
    def kind(self) -> str:
        """How a class is stored."""
        return "<u2" if self.n <= 1 << 16 else "<u4"

    def shared_class(self, word: bytes) -> int:
        return self.own + crc32(word) % self.shared


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, as bytes."""
    return (text or "").encode("utf-8", "replace").lower().split()


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """word, c over all rows of docs, END included."""
    exploded = docs.select(F.explode(F.array_append(words(ascii_lower(F.col(text))), END)).alias("word"))
    return exploded.groupBy("word").agg(F.count("*").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most `most`, falling by count.

    Words are counted by sixteenths of powers of two of their count, which
    gives a bounded table; the largest whole classes that fit are taken, so no
    more than `most` rows reach the driver from all tasks together.
    """
    level = F.floor(F.log2("c") * 16)
    lowest, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > most:
            break
        lowest = r.level
    rows = [] if lowest is None else counts.where(level >= lowest).collect()
    return sorted(rows, key=lambda r: (-r.c, r.word))


# --- Sequences, many at a time: rows of a batch are padded to the longest. ---


def batches(sequences: list[np.ndarray], cells: int = 3_000_000, block: int = 1024, at_once: int = 250_000, many: int = 700):
    """Matrices (longest, n) of sequences of like length, and their lengths in falling order; of `block` steps at most at_once cells or many sequences."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        chosen = order[at : at + max(1, min(cells // longest, max(many, at_once // min(longest, block))))]
        matrix = np.zeros((longest, len(chosen)), np.uint32)
        for k, i in enumerate(chosen):
            matrix[: len(sequences[i]), k] = sequences[i]
        yield chosen, matrix, np.array([len(sequences[i]) for i in chosen])
        at += len(chosen)


def forward_log10(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion."""
    out, emit, ones = np.zeros(len(sequences)), np.ascontiguousarray(model.emit.T), np.ones(len(model.start))
    for chosen, matrix, lengths in batches(sequences):
        total, alpha = np.zeros(len(chosen)), None
        for t in range(len(matrix)):
            live = int((lengths > t).sum())
            alpha = (np.tile(model.start, (live, 1)) if alpha is None else alpha[:live] @ model.move) * emit.take(matrix[t, :live], axis=0)
            scale = alpha @ ones
            alpha *= (1 / scale)[:, None]
            total[:live] += np.log10(scale)
        out[chosen] = total
    return out


def expected_counts(model: Hmm, sequences: list[np.ndarray], block: int = 1024, kind: type = np.float64) -> tuple[Hmm, float]:
    """Baum-Welch counts of starts, moves and emissions over whole sequences, and the log10 probability of all.

    kind is the number type of single steps, which are scaled to sum to one;
    all that is added up over a sequence is in doubles.

    Only what stands at the bounds of blocks of steps is kept on the way
    forward; a block is computed again when the way back comes to it. So the
    memory of a long text does not grow by its length times the states.
    """
    k, n_classes = model.emit.shape
    emit, first_state, move = np.ascontiguousarray(model.emit.T, kind), model.start.astype(kind), model.move.astype(kind)
    back = np.ascontiguousarray(move.T)
    start, ahead, out, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes)), 0.0
    ones = np.ones(k, kind)
    for _, matrix, lengths in batches(sequences, block=min(block, 1024)):
        steps, n = matrix.shape
        lives = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()  # how many go on at a step

        def forward(first: int, last: int, before, matrix=matrix, lives=lives):
            alpha, scales = np.zeros((last - first, lives[first], k), kind), np.ones((last - first, lives[first]), kind)
            for t in range(first, last):
                live = lives[t]
                a = emit.take(matrix[t, :live], axis=0)
                a *= first_state if t == 0 else before[:live] @ move
                scales[t - first, :live] = scale = a @ ones
                before = np.multiply(a, (1 / scale)[:, None], out=alpha[t - first, :live])
            return alpha, scales

        firsts, before, here = list(range(0, steps, block)), {0: None}, None
        for first in firsts:
            here = forward(first, min(first + block, steps), before[first])
            before[first + block] = here[0][-1].copy()
            total += np.log10(here[1]).sum(dtype=np.float64)
        beta = np.ones((n, k), kind)
        for first in reversed(firsts):
            last = min(first + block, steps)
            alpha, scales = here if first == firsts[-1] else forward(first, last, before[first])
            for t in range(last - 1, first - 1, -1):
                live = lives[t]
                b = beta[:live]
                if t:
                    seen = emit.take(matrix[t, :live], axis=0)
                    seen *= (1 / scales[t - first, :live])[:, None]
                    seen *= b
                    ahead += (alpha[t - 1 - first, :live] if t > first else before[first][:live]).T @ seen
                alpha[t - first, :live] *= b  # from here on the posterior of the state
                if t:
                    np.matmul(seen, back, out=beta[:live])
            if first == 0:
                start += alpha[0].sum(axis=0, dtype=np.float64)
            cells = (matrix[first:last, : lives[first]].reshape(-1, 1).astype(np.int64) * k + np.arange(k)).ravel()
            out += np.bincount(cells, alpha.ravel(), n_classes * k).reshape(n_classes, k).T
    return Hmm(start, model.move * ahead, out), total


def updated(counts: Hmm, base: np.ndarray, prior: float) -> Hmm:
    """The model of given counts; base: class frequencies, which prior counts per state are spread by."""
    k = len(counts.start)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Hmm(norm(counts.start + 1.0 / k), norm(counts.move + 1.0 / k), norm(counts.emit + prior * base))


def stretched(before: Hmm, after: Hmm, times: float) -> Hmm:
    """A model beyond the step from one to the next: each parameter changed by its ratio to the power of times, made to sum to one again."""

    def beyond(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.maximum(y * (y / x) ** (times - 1), 1e-25)  # still a number in single precision
        return z / z.sum(axis=-1, keepdims=True)

    return Hmm(*(beyond(getattr(before, part), getattr(after, part)) for part in ("start", "move", "emit")))


def climb(model: Hmm, step, n: int, s: Settings) -> Hmm:
    """The model after rounds of training; step(model) gives its plain successor and its own log10 probability over n tokens."""
    last, plain = None, None
    for _ in range(s.rounds):
        after, now = step(model)
        if last is not None and now < last:  # too far: back to the plain step
            model, last, plain = plain, None, None
            continue
        if last is not None and now - last < s.gain * n:
            return after
        model, last, plain = stretched(model, after, s.stretch), now, after
    return model if plain is None else plain


def starting_point(base: np.ndarray, s: Settings) -> Hmm:
    """The class frequencies in each state, told apart by seeded noise; states tend to stay."""
    rng = np.random.default_rng(s.seed)
    emit = base * np.exp(rng.normal(0, 1, (s.states, len(base))))
    stay = np.full((s.states, s.states), 0.1 / s.states) + 0.9 * np.eye(s.states)
    return Hmm(np.full(s.states, 1 / s.states), stay / stay.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


# --- Jobs ---

ENCODED = "row long, id string, held_out boolean, n_tokens long, known long, common double, classes binary, rare array<struct<word:string,n:long>>"


def _encode(docs: DataFrame, lexicon, c: Classes) -> DataFrame:
    """Classes of each text, the sum of log10(c + 1) and the number over tokens in the lexicon, and the other words with their counts."""

    def run(frames):
        at, class_of, log_count = lexicon.value
        get, unknown = at.get, len(class_of)
        classes_of = np.append(class_of, 0)
        logs = np.append(log_count, 0.0)
        for frame in (f.iloc[i : i + 256] for f in frames for i in range(0, len(f), 256)):
            out = []
            for row, id_, held, text in frame.itertuples(index=False):
                found = tokens_of(text)
                place = np.fromiter((get(w, unknown) for w in found), np.int64, len(found))
                classes = classes_of[place]
                missing = np.flatnonzero(place == unknown)
                rare = Counter()
                if len(missing):
                    others = [found[i] for i in missing]
                    classes[missing] = np.fromiter(map(c.shared_class, others), np.int64, len(others))
                    rare.update(others)
                end = get(END.encode(), unknown)
                sequence = np.append(classes, c.n - 1).astype(c.kind).tobytes()
                known = len(found) - len(missing) + (end != unknown)
                out.append((row, id_, held, len(found) + 1, known, float(logs[place].sum() + logs[end]), sequence, [{"word": w.decode("utf-8", "replace"), "n": n} for w, n in rare.items()]))
            yield pd.DataFrame(out, columns=["row", "id", "held_out", "n_tokens", "known", "common", "classes", "rare"])

    return docs.mapInPandas(run, ENCODED)


def _by_length(encoded: DataFrame, most_tokens: int = 2_500_000) -> DataFrame:
    """The rows of encoded dealt out so that tasks get texts of like length, and about most_tokens tokens each: long recursions then run for many texts at once."""
    level = F.floor(F.log2("n_tokens"))
    parts, first = F.lit(1), F.lit(0)
    total = 0
    for r in encoded.groupBy(level.alias("level")).agg(F.sum("n_tokens").alias("tokens")).orderBy("level").collect():
        n = ceil(r.tokens / most_tokens)
        parts, first = F.when(level == r.level, n).otherwise(parts), F.when(level == r.level, total).otherwise(first)
        total += n
    return encoded.repartitionById(total, (first + F.pmod(F.xxhash64("row"), parts)).cast("int")) if total else encoded


def _train(learned: DataFrame, model: Hmm, base: np.ndarray, s: Settings, kind: str) -> tuple[Hmm, float]:
    """One round of Baum-Welch over all rows, and their log10 probability before it: each task sums its counts, Spark adds them up, the driver gets one number a parameter."""
    held = learned.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    k, n = s.states, len(base)

    def run(frames):
        current, total = Hmm(*held.value), np.zeros(k + k * k + k * n + 1)
        for frame in frames:
            got, log = expected_counts(current, [np.frombuffer(b, kind) for b in frame.classes], kind=np.float32)
            total += np.concatenate([got.start, got.move.ravel(), got.emit.ravel(), [log]])
        if total.any():
            yield pd.DataFrame({"i": np.flatnonzero(total).astype("int32"), "x": total[total != 0]})

    summed = learned.select("classes").mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    held.unpersist()
    flat = np.zeros(k + k * k + k * n + 1)
    flat[summed.i.to_numpy()] = summed.x.to_numpy()
    return updated(Hmm(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, n)), base, s.prior), float(flat[-1])


def score_texts(docs: DataFrame, training, *, id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row a row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training: a boolean column over docs, true for rows to learn from (null:
    false). Null texts are empty: one token, the end. Without training rows
    all counts are zero. Repeated rows count and score each on their own. A
    text of any length is one sequence. Null ids stay null; an empty table
    gives no rows; other columns of docs are not read, whatever their names.
    """
    s, spark = settings, docs.sparkSession
    rows = docs.select(F.col(id).cast("string").alias("id"), (~F.coalesce(training, F.lit(False))).alias("held_out"), F.col(text).cast("string").alias("text"))
    counts = stored(count_tokens(rows.where("NOT held_out"), "text"), "token-counts")
    n, v, texts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()

    frequent = most_frequent(counts.where(F.col("word") != END), s.lexicon)
    c = s.classes(v)
    own = [r.word.encode("utf-8", "replace") for r in frequent[: c.own]]
    top = [(r.word.encode("utf-8", "replace"), r.c) for r in frequent] + [(END.encode(), texts)] * bool(texts)
    class_of = {w: i for i, w in enumerate(own)} | {END.encode(): c.n - 1}
    lexicon_classes = np.array([class_of[w] if w in class_of else c.shared_class(w) for w, _ in top], np.int64)
    lexicon = ({w: i for i, (w, _) in enumerate(top)}, lexicon_classes, np.log10(np.array([n_ for _, n_ in top], float) + 1))

    # Tokens and types of each class: sizes of the classes, and shares inside the shared ones.
    bucket = F.lit(c.own) + F.crc32(F.col("word").cast("binary")) % c.shared
    alone = spark.createDataFrame([(w.decode("utf-8", "replace"),) for w in own] + [(END,)], "word string")  # at most lexicon + 1 rows
    in_class = counts.join(F.broadcast(alone), "word", "left_anti").groupBy(bucket.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    sizes, shares = np.zeros(c.n), np.zeros(c.n)
    shares[c.own : -1] = 1.0
    for r in in_class:
        sizes[r.k], shares[r.k] = r.c, r.c + r.types + 1
    for (_, count), k in zip(top, lexicon_classes, strict=True):
        sizes[k] += count if k < c.own or k == c.n - 1 else 0
    base = (sizes + 1) / (sizes + 1).sum()
    # log10(c + 1) over all words less these is log10 P(word | class): words with a class of their own have probability 1.
    minus = np.log10(np.where(shares > 0, shares, sizes + 1))

    sc = spark.sparkContext
    encoded = _encode(rows.select(F.monotonically_increasing_id().alias("row"), "*"), sc.broadcast(lexicon), c)
    unsorted = stored(encoded, "encoded-texts")
    encoded = stored(_by_length(unsorted), "encoded")
    discard(unsorted)
    learned, model = encoded.where("NOT held_out"), starting_point(base, s)
    if n:
        model = climb(model, lambda m: _train(learned, m, base, s, c.kind), n, s)
    held = sc.broadcast((model.start, model.move, model.emit, minus))

    def forward(frames):
        *arrays, less = held.value
        hmm = Hmm(*arrays)
        for frame in frames:
            found = [np.frombuffer(b, c.kind) for b in frame.classes]
            inside = np.array([less[x].sum() for x in found])
            yield frame.drop(columns="classes").assign(path=forward_log10(hmm, found) - inside)

    paths = encoded.select("row", "id", "held_out", "n_tokens", "known", "common", "classes").mapInPandas(forward, "row long, id string, held_out boolean, n_tokens long, known long, common double, path double")
    rare = encoded.select("row", F.inline("rare")).join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum("n").alias("seen"))
    both = paths.join(rare, "row", "left")
    logs = F.col("common") + F.coalesce("logs", F.lit(0.0))
    kind = docs.schema[id].dataType
    return both.select(
        F.col("id").cast(kind).alias(id), "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("path") + logs).alias("score"),
    )


def training_rows(doc_id):
    """The contract's split: crc32 of the id as text, modulo 7, is not 2."""
    return id_crc(doc_id) % 7 != 2
