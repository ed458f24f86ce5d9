"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

The CGK random walk copies a token to the output at each step and moves on by
a random bit of (step, token). Sequences at a small edit distance stay in step
most of the time, so their embeddings are close in Hamming distance, and
samples of coordinates agree. Windows of the items' own sizes are embedded;
windows with an equal sample in one of several repeats are candidates, and a
candidate counts if the whole item lies in the document within its edit
budget. How many repeats reach the wanted recall is measured on edited items.

An item of n words and k edits leaves n - 1 - 2 k of its neighbouring pairs of
words as they are. Windows with fewer pairs of the benchmark's are not
embedded; that loses nothing.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: ASCII signs separate words; other characters belong to them.
_TO_SPACE = bytes(x if x > 127 or chr(x).isalnum() else 32 for x in range(256))
MATCH = "array<struct<item:string,distance:int,item_words:int,start:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    """recall: what the repeats are to reach together for items at their edit budget; block_items, block_chars: how much of the benchmark is held at a time."""

    similarity: float = 0.8
    recall: float = 0.99
    sampled: int = 2
    most_repeats: int = 400
    block_items: int = 20_000
    block_chars: int = 16_000_000
    seed: int = 11

    def budget(self, size: int) -> int:
        return int(size * (1 - self.similarity) + 1e-9)


class Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word) - (1 << 63)
        return out


def split_words(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased, without signs."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def hashed_words(text: str | None, cache: Hashes) -> np.ndarray:
    found = split_words(text)
    return np.fromiter(map(cache.__getitem__, found), np.int64, len(found))


class Walk:
    """One repeat: a CGK walk, and which of its steps are sampled for a window of each size."""

    def __init__(self, sizes: np.ndarray, sampled: int, rng: np.random.Generator):
        odd = lambda: np.int64(rng.integers(-(2**62), 2**62) * 2 + 1)
        self.turn, self.weights, self.sizes = odd(), [odd() for _ in range(sampled)], sizes
        # The walk moves by half a token a step: 2 * size steps take in about size tokens.
        self.chosen = np.array([np.floor(rng.random() * 2 * sizes) for _ in range(sampled)], np.int64)

    def keys(self, tokens: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """A key for the window at each start, kinds naming its size; what lies behind a window counts as padding."""
        if len(kinds) > 1 and (np.diff(kinds) < 0).any():
            order, out = np.argsort(kinds, kind="stable"), np.empty(len(kinds), np.int64)
            out[order] = self.keys(tokens, starts[order], kinds[order])
            return out
        edges = np.searchsorted(kinds, np.arange(len(self.sizes) + 1))  # windows of a size lie together
        sampled = defaultdict(list)
        for j, k in zip(*np.nonzero(np.broadcast_to(np.diff(edges) > 0, self.chosen.shape)), strict=True):
            sampled[int(self.chosen[j, k])].append((slice(edges[k], edges[k + 1]), self.weights[j]))
        at, ends = starts.astype(np.int64), starts + self.sizes[kinds]
        out = self.sizes[kinds] * self.turn
        for t in range(max(sampled, default=-1) + 1):
            seen = tokens.take(at, mode="clip") * self.turn
            seen ^= seen >> 29
            seen *= at < ends
            for part, weight in sampled.get(t, ()):
                out[part] += seen[part] * weight
            seen >>= t % 61
            seen &= 1
            at += seen
        out ^= out >> 31
        return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words with so many of them, chosen at random, replaced, left out or followed by another one."""
    out, chosen = [], dict.fromkeys(rng.permutation(len(words))[:edits].tolist())
    for i, word in enumerate(words.tolist()):
        kind = rng.integers(3) if i in chosen else 3
        if kind != 1:
            out.append(int(rng.integers(1 << 60)) if kind == 0 else word)
        if kind == 2:
            out.append(int(rng.integers(1 << 60)))
    return np.array(out, np.int64)


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token and the next one."""
    out = tokens[:-1] * np.int64(0x2545F4914F6CDD1D) + tokens[1:]
    out ^= out >> 31
    return out


def edit_matches(pattern: dict[int, int], size: int, text: list[int]) -> tuple[int, int]:
    """Least edits between the whole pattern and any part of text, and where that part ends (bit-parallel)."""
    full = (1 << size) - 1
    top = 1 << (size - 1)
    up, down, score, best, end = full, 0, size, size, 0
    for at, token in enumerate(text):
        x = pattern.get(token, 0) | down
        diagonal = (((up + (x & up)) ^ up) | x) & full
        right_down = up & diagonal
        right_up = (down | ~(up | diagonal)) & full
        score += bool(right_up & top) - bool(right_down & top)
        shifted = (right_up << 1) & full
        down = shifted & diagonal
        up = ((right_down << 1) | ~(shifted | diagonal)) & full
        if score < best:
            best, end = score, at + 1
    return best, end


class Index:
    """Benchmark items by the keys of their windows."""

    def __init__(self, items: list[tuple[str, str]], settings: Settings):
        self.settings, self.cache = settings, Hashes()
        self.ids, self.words, self.patterns, self.reversed = [], [], [], []
        for id_, text in items:
            words = hashed_words(text, self.cache)
            if not len(words):
                continue
            forward, backward = defaultdict(int), defaultdict(int)
            for i, w in enumerate(words.tolist()):
                forward[w] |= 1 << i
                backward[w] |= 1 << (len(words) - 1 - i)
            self.ids.append(id_)
            self.words.append(words)
            self.patterns.append(dict(forward))
            self.reversed.append(dict(backward))
        self.lengths = np.unique([len(w) for w in self.words]).astype(np.int64)
        self.budgets = np.array([settings.budget(int(n)) for n in self.lengths], np.int64)
        self.widest = int((self.lengths + self.budgets).max(initial=0))
        self.grams = self._grams()
        bits = max(16, sum(map(len, self.grams)).bit_length() + 6)
        self.mask = (1 << bits) - 1
        self.known = {one: np.zeros(1 << bits, bool) for one in {n == 1 for n in self.lengths.tolist()}}
        for n, grams in zip(self.lengths.tolist(), self.grams, strict=True):
            self.known[n == 1][grams & self.mask] = True
        rng = np.random.default_rng(settings.seed)
        self.walks = [Walk(self.lengths, settings.sampled, rng) for _ in range(self._repeats())] if self.words else []
        self.tables = [self._table(walk) for walk in self.walks]

    def _grams(self) -> list[np.ndarray]:
        """For each size the pairs of words of its items, sorted; of items of one word that word."""
        out = [[] for _ in self.lengths]
        for words in self.words:
            out[int(np.searchsorted(self.lengths, len(words)))].append(words if len(words) == 1 else pairs_of(words))
        return [np.unique(np.concatenate(x)) for x in out]

    def _joined(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All sequences in one array, each followed by padding, and where they start."""
        pad = np.zeros(self.widest + 2, np.int64)
        bounds = np.cumsum([0, *[len(x) + len(pad) for x in sequences]])
        return np.concatenate([y for x in sequences for y in (x, pad)] or [pad]), bounds

    def _repeats(self, tries: int = 64, walks: int = 128) -> int:
        """The least number of repeats by which edited items, as far off as their budgets allow, are met with the wanted recall."""
        rng = np.random.default_rng([self.settings.seed, 1])
        chosen = rng.integers(len(self.words), size=tries)
        pairs = [(self.words[i], edited(self.words[i], self.settings.budget(len(self.words[i])), rng)) for i in chosen]
        tokens, bounds = self._joined([x for pair in pairs for x in pair])
        kinds = np.searchsorted(self.lengths, [len(a) for a, _ in pairs])
        met = np.zeros(tries)
        for _ in range(walks):
            keys = Walk(self.lengths, self.settings.sampled, rng).keys(tokens, bounds[:-1], np.repeat(kinds, 2))
            met += keys[::2] == keys[1::2]
        missed = 1 - (met + 0.5) / (walks + 1)
        for n in range(1, self.settings.most_repeats):
            if 1 - (missed**n).mean() >= self.settings.recall:
                return n
        return self.settings.most_repeats

    def _table(self, walk: Walk) -> tuple[np.ndarray, dict[int, list[int]]]:
        tokens, bounds = self._joined(self.words)
        out = defaultdict(list)
        kinds = np.searchsorted(self.lengths, [len(w) for w in self.words])
        for item, key in enumerate(walk.keys(tokens, bounds[:-1], kinds).tolist()):
            out[key].append(item)
        return np.array(sorted(out), np.int64), dict(out)

    def _windows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes (their numbers) of the windows that hold enough pairs of items of that size."""
        starts, kinds = [], []
        grams = {False: pairs_of(tokens), True: tokens}
        sums = {one: np.concatenate([[0], np.cumsum(table[grams[one] & self.mask], dtype=np.int32)]) for one, table in self.known.items()}
        for kind, (size, budget) in enumerate(zip(self.lengths.tolist(), self.budgets.tolist(), strict=True)):
            one = size == 1
            span, need = (1, 1) if one else (size + budget - 1, size - 1 - 2 * budget)
            total = sums[one]
            found = np.flatnonzero(total[span:] - total[:-span] >= need) if len(total) > span else np.zeros(0, np.int64)
            for at in range(0, len(found), 65_536):  # the same for this size alone
                some = found[at : at + 65_536]
                seen = grams[one][some[:, None] + np.arange(span)]
                own = self.grams[kind]
                spots = np.minimum(np.searchsorted(own, seen), len(own) - 1)
                some = some[(own[spots] == seen).sum(axis=1) >= need]
                starts.append(some)
                kinds.append(np.full(len(some), kind))
        return (np.concatenate(starts), np.concatenate(kinds)) if starts else (np.zeros(0, np.int64),) * 2

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """The items found in each text, once each: the closest, then the first."""
        docs = [hashed_words(t, self.cache) for t in texts]
        found: list[dict] = [{} for _ in docs]
        if not self.words:
            return [[] for _ in docs]
        tokens, bounds = self._joined(docs)
        starts, kinds = self._windows(tokens)
        candidates = set()
        if len(starts):
            owners = np.searchsorted(bounds, starts, "right") - 1
            for walk, (held, table) in zip(self.walks, self.tables, strict=True):
                keys = walk.keys(tokens, starts, kinds)
                for at in np.flatnonzero(held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys).tolist():
                    candidates.update((int(owners[at]), item, int(starts[at])) for item in table[int(keys[at])])
        for doc, item, start in sorted(candidates):
            hit = self.verify(docs[doc], item, start - int(bounds[doc]))
            if hit and (item not in found[doc] or (hit["distance"], hit["start"]) < (found[doc][item]["distance"], found[doc][item]["start"])):
                found[doc][item] = hit
        return [[f[i] for i in sorted(f)] for f in found]

    def verify(self, words: np.ndarray, item: int, start: int) -> dict | None:
        """The item in words around start, if whole and within its edit budget."""
        size = len(self.words[item])
        budget = self.settings.budget(size)
        low, high = max(0, start - 2 * budget), max(0, start + size + 2 * budget)
        region = words[low:high].tolist()
        # Each word of the item that the region lacks is an edit.
        present = set(region)
        if sum(map(present.__contains__, self.words[item].tolist())) < size - budget:
            return None
        distance, end = edit_matches(self.patterns[item], size, region)
        if distance > budget:
            return None
        # The same from the end backwards gives the start.
        _, back = edit_matches(self.reversed[item], size, region[:end][::-1])
        return {"item": self.ids[item], "distance": distance, "item_words": size, "start": low + end - back, "end": low + end}


def _blocks(benchmark: DataFrame, id: str, text: str, s: Settings):
    """Lists of at most about block_items items and block_chars characters that together are the whole benchmark."""
    items = benchmark.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, ceil(n / s.block_items), ceil(chars / s.block_chars))
    for k in range(parts):  # a block at a time is on the driver
        yield [(r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()]


def matches(text: Column, items: list[tuple[str, str]], session, settings: Settings) -> Column:
    """The items found in a text, as an array."""
    held = session.sparkContext.broadcast((uuid.uuid4().hex, items, settings.__dict__))

    @F.pandas_udf(MATCH)
    def find(batches: pd.Series) -> pd.Series:
        name, rows, options = held.value
        if name not in _KEPT:
            while len(_KEPT) >= MOST_KEPT:
                _KEPT.pop(next(iter(_KEPT)))
            _KEPT[name] = Index(rows, Settings(**options))
        out, at = [], 0
        while at < len(batches):  # as many texts at a time as have some 250,000 words together
            end, size = at, 0
            while end < len(batches) and (end == at or size < 1_500_000):
                size += len(batches.iloc[end] or "")
                end += 1
            out += _KEPT[name].search(list(batches.iloc[at:end]))
            at = end
        return pd.Series(out)

    return find(text)


#: The indexes of the last blocks of a worker, by the name of their broadcast.
MOST_KEPT = 2
_KEPT: dict = {}


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row a document row and item found in it: id, item_id, distance, item_words, start, end (word positions).

    An item is found if its words, lower-cased and without punctuation, lie in
    the text within (1 - similarity) * words edits. Items without words and
    null texts match nothing; repeated rows match each on their own; null ids
    stay null; a text may be of any length and is searched whole; other
    columns of docs and benchmark are not read, whatever their names; an empty
    table on either side gives no rows. The benchmark is searched in blocks of
    bounded size, all documents against each.
    """
    kind = benchmark.schema[item_id].dataType
    out = None
    for items in _blocks(benchmark, item_id, item_text, settings):
        rows = docs.select(F.col(id).alias("_mv_id"), matches(F.col(text).cast("string"), items, docs.sparkSession, settings).alias("_mv_found"))
        found = rows.select(F.col("_mv_id").alias(id), F.inline("_mv_found"))
        part = found.select(id, F.col("item").cast(kind).alias(item_id), "distance", "item_words", "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of docs in which no item is found; nothing is shuffled.

    Null and empty texts stay; rows that repeat stay or go together; columns
    of any names stay as they are; an empty table on either side leaves docs
    as it is. A benchmark of several blocks takes as many passes, each over
    the rows that the one before has left.
    """
    before = None
    for items in _blocks(benchmark, item_id, item_text, settings):
        docs = docs if before is None else stored(docs, "decontaminated")
        before = items
        docs = docs.where(F.size(matches(F.col(text).cast("string"), items, docs.sparkSession, settings)) == 0)
    return docs
