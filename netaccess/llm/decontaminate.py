"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased and every run of characters other than letters, digits and underscores
becomes one space. Every window of ``WINDOW`` characters of an item (all of a shorter item) has a budget of
``EDIT_SHARE`` of its length in edits. A place in a text within k edits of a window of m characters shares at
least m - q + 1 - k q of its q-grams, all on k + 1 neighbouring diagonals. Shared q-grams are gathered by item in
bands of 2 (k + 1) diagonals, each overlapping half of the next; in each band the windows whose own q-grams reach
the bound are verified by alignment within the band, all windows at once.

A text is contaminated if any window of any item is found. Items of under ``LEAST_CHARS`` characters are too short
for edits: they are found as they are, between word borders, anywhere in a text. Those of under ``LEAST_WORDS`` words that stand
in more than ``COMMON_TEXTS`` texts and ``COMMON_SHARE`` of all, counted first, are everyday words ("yes", "the end") and no
sign of a leak: they match nothing. Null and empty texts and items match nothing.

Shared q-grams are spelt out one by one for at most ``MOST_PAIRS`` of them at a time. An item that shares more with a text,
as long rows of one character do, has them counted by diagonal instead (rare q-grams one by one, frequent ones by a product
of Fourier transforms); its windows are then sought band by band until all are found, so that ``edits`` is the least of those
seen by then. A text of n characters and an item of m take memory like n + m and time like (n + m) log (n + m) but for
windows that have to be aligned. Equal texts get equal matches; repeated items are each reported. An empty table on either
side gives no match. Columns of other names pass through the filter untouched.

The benchmark is taken in slices of at most ``SLICE_CHARS`` characters, one pass over the texts each, so
what is broadcast is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netaccess.llm.common import map_arrow

Q = 10
WINDOW = 120
EDIT_SHARE = 0.05
LEAST_CHARS, LEAST_WORDS = 24, 3
COMMON_TEXTS, COMMON_SHARE = 10, 0.01
MOST_PAIRS = 4_000_000
SLICE_CHARS = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
ALIGN_WINDOWS = 4096
BETWEEN = re.compile(r"\W+")


def normalise(text: str | None) -> str:
    return BETWEEN.sub(" ", text.lower()).strip() if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def qgram_hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the Q = 10 characters from each position: 2 and 8 built by doubling."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        b1, b2, b4 = BASE, BASE * BASE, BASE * BASE * BASE * BASE
        h2 = mixed[:-1] * b1 + mixed[1:]
        h4 = h2[:-2] * b2 + h2[2:]
        h8 = h4[:-4] * b4 + h4[4:]
        h = h8[:n] * b2 + h2[8 : 8 + n]
        return h ^ (h >> np.uint64(29))


class WindowIndex:
    """Benchmark items and the sorted q-grams that lead to them; windows are ranges of an item."""

    def __init__(self, items: list[tuple[int, str]], common: frozenset[str] = frozenset()):
        self.item: list[int] = []
        self.codes: list[np.ndarray] = []
        self.whole: dict[str, list[int]] = {}
        self.lengths: dict[str, set[int]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if 0 < len(text) < LEAST_CHARS:
                words = text.split(" ")
                if text in common:
                    continue
                self.whole.setdefault(text, []).append(item_id)
                self.lengths.setdefault(words[0], set()).add(len(words))
            elif text:
                self.item.append(item_id)
                self.codes.append(codes(text))
        chars = np.array([len(c) for c in self.codes], np.int64)
        self.size = np.minimum(chars, WINDOW)
        self.budget = np.minimum((EDIT_SHARE * self.size).astype(np.int64), np.maximum(0, (self.size - Q) // Q))
        self.need = self.size - Q + 1 - self.budget * Q
        self.longest = int(chars.max(initial=0))
        grams = [qgram_hashes(c) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item_of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.least = int(self.need.min()) if len(self.need) else 0

    def short_items(self, text: str) -> dict[int, tuple[int, int]]:
        """Short items that stand in the text between word borders."""
        found: dict[int, tuple[int, int]] = {}
        words = text.split(" ") if self.whole else []
        for i, word in enumerate(words):
            for n in self.lengths.get(word, ()):
                for item in self.whole.get(" ".join(words[i : i + n]), ()):
                    found[item] = (1, 0)
        return found

    def matches(self, raw: str | None) -> dict[int, tuple[int, int]]:
        """Item -> (windows found, least edits of a window)."""
        text = normalise(raw)
        found = self.short_items(text)
        if len(text) < Q or not self.codes:
            return found
        row = codes(text)
        h = qgram_hashes(row)
        place = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(place) < self.least:
            return found
        slot = np.searchsorted(self.gram, h[place])
        slot[slot == len(self.gram)] = 0
        hit = self.gram[slot] == h[place]
        place, slot = place[hit], slot[hit]
        if len(place) < self.least:
            return found
        best: dict[int, np.ndarray] = {}
        for first, item_of, at_of in self.shares(slot, row, h, best):
            self.search(row, place, slot, first, item_of, at_of, best)
        for own, least in best.items():
            n = int((least <= self.budget[own]).sum())
            if n:
                before, edits = found.get(self.item[own], (0, WINDOW))
                found[self.item[own]] = (before + n, min(edits, int(least.min())))
        return found

    def shares(self, slot: np.ndarray, row: np.ndarray, h: np.ndarray, best: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """The index in parts that share at most ``MOST_PAIRS`` q-grams with a text; items that share more are searched here and now."""
        slots, times = np.unique(slot, return_counts=True)
        reps = self.first[slots + 1] - self.first[slots]
        if (reps * times).sum() <= MOST_PAIRS:
            yield self.first, self.item_of, self.at
            return
        entries = np.repeat(self.first[slots] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        pairs = np.bincount(self.item_of[entries], np.repeat(times, reps), len(self.codes)).astype(np.int64)
        for own in np.flatnonzero(pairs > MOST_PAIRS).tolist():
            self.search_dense(own, row, h, best)
        part = np.cumsum(np.where(pairs > MOST_PAIRS, 0, pairs)) // max(1, MOST_PAIRS)
        for k in np.unique(part[(pairs > 0) & (pairs <= MOST_PAIRS)]):
            kept = (part == k) & (pairs > 0) & (pairs <= MOST_PAIRS)
            own = kept[self.item_of]
            yield np.concatenate([[0], np.cumsum(own)])[self.first], self.item_of[own], self.at[own]

    def search(self, row: np.ndarray, place: np.ndarray, slot: np.ndarray, first: np.ndarray, item_of: np.ndarray, at_of: np.ndarray, best: dict[int, np.ndarray]) -> None:
        """Bands of q-grams shared with the text, spelt out one by one."""
        reps = first[slot + 1] - first[slot]
        flat = np.repeat(first[slot], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        item, at = item_of[flat], at_of[flat]
        diagonal = np.repeat(place, reps) - at
        span = len(row) + self.longest + 3
        key = item * span + (diagonal + self.longest) // (self.budget[item] + 1) + 1
        key, at, diagonal = np.concatenate([key, key - 1]), np.tile(at, 2), np.tile(diagonal, 2)
        groups, group, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = (count >= self.need[groups // span])[group]
        key, at, diagonal = key[keep], at[keep], diagonal[keep]
        order = np.lexsort((at, key))
        key, at, diagonal = key[order], at[order], diagonal[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
        for a, b in zip(starts, [*starts[1:], len(key)]):
            own, band = int(key[a] // span), int(key[a] % span) - 1
            self.verify(own, band * (int(self.budget[own]) + 1) - self.longest, at[a:b], diagonal[a:b], row, best)

    def search_dense(self, own: int, row: np.ndarray, h: np.ndarray, best: dict[int, np.ndarray]) -> None:
        """Bands of one item whose shared q-grams are counted by diagonal, not spelt out."""
        gram = qgram_hashes(self.codes[own])
        n, m, k = len(h), len(gram), int(self.budget[own])
        counts = shared_by_diagonal(h, gram)  # of diagonal d at d + m - 1
        edges = np.concatenate([[0], np.cumsum(counts)])
        # bands as everywhere: 2 (k + 1) diagonals, each overlapping half of the next
        bands = np.arange((-(m - 1) + self.longest) // (k + 1) - 1, (n - 1 + self.longest) // (k + 1) + 1)
        low = bands * (k + 1) - self.longest
        total = edges[np.clip(low + 2 * (k + 1) + m - 1, 0, n + m - 1)] - edges[np.clip(low + m - 1, 0, n + m - 1)]
        places = np.arange(m)
        # likely bands first, as the search ends when all windows are found
        for start in low[np.argsort(-total, kind="stable")][: int((total >= self.need[own]).sum())].tolist():
            at, diagonal = [], []
            for d in range(start, start + 2 * (k + 1)):
                inside = places[max(0, -d) : max(0, min(m, n - d))]
                hit = inside[h[inside + d] == gram[inside]]
                at.append(hit)
                diagonal.append(np.full(len(hit), d))
            at, diagonal = np.concatenate(at), np.concatenate(diagonal)
            order = np.argsort(at, kind="stable")
            self.verify(own, start, at[order], diagonal[order], row, best)
            if own in best and (best[own] <= k).all():
                return

    def verify(self, own: int, low: int, at: np.ndarray, diagonal: np.ndarray, row: np.ndarray, best: dict[int, np.ndarray]) -> None:
        """Align the windows whose own q-grams in the band from diagonal ``low`` on reach the bound; ``at`` ascends."""
        k, size = int(self.budget[own]), int(self.size[own])
        if own not in best:
            best[own] = np.full(len(self.codes[own]) - size + 1, k + 1)
        least = best[own]
        window = np.arange(len(least))
        enough = np.searchsorted(at, window + size - Q, "right") - np.searchsorted(at, window, "left") >= self.need[own]
        if not enough.any():
            return
        lines, hits = np.unique(diagonal, return_counts=True)
        for d in lines[hits >= size - Q + 1].tolist():
            least[equal_windows(self.codes[own], row, d, size)] = 0
        left = np.flatnonzero(enough & (least > k))
        for i in range(0, len(left), ALIGN_WINDOWS):
            some = left[i : i + ALIGN_WINDOWS]
            least[some] = np.minimum(least[some], banded_edits(self.codes[own], some, size, row, low, low + 2 * k + 1, k))


def shared_by_diagonal(text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each diagonal d = place in text - place in item, at d + len(item) - 1, the number of equal pairs."""
    n, m = len(text), len(item)
    out = np.zeros(n + m - 1, np.int64)
    grams, code = np.unique(np.concatenate([text, item]), return_inverse=True)
    a, b = code[:n], code[n:]
    of_text, of_item = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    from_text, from_item = np.searchsorted(a[of_text], np.arange(len(grams) + 1)), np.searchsorted(b[of_item], np.arange(len(grams) + 1))
    products = np.diff(from_text) * np.diff(from_item)
    width = 1 << (n + m).bit_length()
    many = 8 * width  # beyond so many pairs a transform is cheaper
    spectrum, any_many = np.zeros(width // 2 + 1, complex), False
    for g in np.flatnonzero(products).tolist():
        x, y = of_text[from_text[g] : from_text[g + 1]], of_item[from_item[g] : from_item[g + 1]]
        if products[g] > many:
            any_many = True
            u, v = np.zeros(width), np.zeros(width)
            u[x], v[m - 1 - y] = 1, 1
            spectrum += np.fft.rfft(u) * np.fft.rfft(v)
        else:
            for k in range(0, len(y), max(1, 1_000_000 // len(x))):
                some = y[k : k + max(1, 1_000_000 // len(x))]
                out += np.bincount((x[:, None] - some[None, :] + m - 1).ravel(), minlength=n + m - 1)
    if any_many:
        out += np.rint(np.fft.irfft(spectrum, width)[: n + m - 1]).astype(np.int64)
    return out


def equal_windows(item: np.ndarray, text: np.ndarray, diagonal: int, size: int) -> np.ndarray:
    """Starts of the windows of the item that the text repeats on the diagonal."""
    start, end = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if end - start < size:
        return np.empty(0, np.int64)
    equal = np.concatenate([[0], np.cumsum(item[start:end] == text[start + diagonal : end + diagonal])])
    return start + np.flatnonzero(equal[size:] - equal[:-size] == size)


def banded_edits(item: np.ndarray, windows: np.ndarray, size: int, text: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Least edits of each window of the item against any part of the text with its alignment on diagonals low - k to high + k; over k: k + 1."""
    step = np.arange(high - low + 2 * k + 1)
    at = windows[:, None] + (low - k) + step
    framed = np.concatenate([[0], text.astype(np.int64) + 1, [0]])
    outside = lambda j: (j < 0) | (j > len(text))
    edits = np.where(outside(at), 10 * WINDOW, 0)
    for i in range(size):
        wanted = item[windows + i].astype(np.int64)[:, None] + 1
        cell = edits + (framed[np.clip(at + 1, 0, len(text) + 1)] != wanted)
        cell[:, :-1] = np.minimum(cell[:, :-1], edits[:, 1:] + 1)
        at += 1
        cell[outside(at)] = 10 * WINDOW
        edits = np.minimum.accumulate(cell - step, axis=1) + step
        edits[outside(at)] = 10 * WINDOW
    return np.minimum(edits.min(axis=1), k + 1)


def benchmark_slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items of one slice after another; slices are dealt by hash and hold ``SLICE_CHARS`` characters on average at most."""
    narrow = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    chars = narrow.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(2 * chars / SLICE_CHARS)) if chars > SLICE_CHARS else 1
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in narrow.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def common_items(docs: DataFrame, items: list[tuple[int, str]]) -> frozenset[str]:
    """The normalised items of a word or two that stand in too many texts to be a sign; as many at most as the slice has."""
    short = {t for _, raw in items if 0 < len(t := normalise(raw)) < LEAST_CHARS and t.count(" ") + 1 < LEAST_WORDS}
    if not short:
        return frozenset()
    texts = sorted(short)
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex(list(enumerate(texts))))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            seen: dict[int, int] = {-1: len(batch["text"])}
            for value in batch["text"]:
                for k in index.value.short_items(normalise(value.as_py())):
                    seen[k] = seen.get(k, 0) + 1
            yield {"k": list(seen), "n": list(seen.values())}

    rows = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, StructType([StructField("k", LongType()), StructField("n", LongType())]))
    found = dict(rows.groupBy("k").agg(F.sum("n").alias("n")).collect())
    index.destroy()
    most = max(COMMON_TEXTS, COMMON_SHARE * found.get(-1, 0))
    return frozenset(texts[k] for k, n in found.items() if k >= 0 and n > most)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, edits: one row for each text and item found in it."""
    schema = StructType([StructField(n, LongType()) for n in ("doc_id", "item_id", "n_windows", "edits")])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in benchmark_slices(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, common_items(docs, items)))

        def run(batches: Iterator[dict], index=index) -> Iterator[dict]:
            for batch in batches:
                rows: dict[str, list] = {f.name: [] for f in schema}
                for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    for item, (n, edits) in index.value.matches(value.as_py()).items():
                        for name, x in zip(rows, (doc_id, item, n, edits)):
                            rows[name].append(x)
                yield rows

        part = map_arrow(narrow, run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item; every column passes through."""
    for items in benchmark_slices(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, common_items(docs, items)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.names.index("text"))
                yield batch.filter(pa.array([not index.value.matches(v.as_py()) for v in text], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
