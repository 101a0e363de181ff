"""Language-model scores from a hierarchical Pitman-Yor model seated by Gibbs sampling.

Restaurants: one for each context word of the whole vocabulary (the end token is a context and a dish as well); all
share one parent, the restaurant of single words, whose base is uniform over the words of the corpus.

1. Words are counted over all training rows. The ``FREQUENT`` most frequent have numbers of their own; any other
   word is named by 30 bits of its hash. Every text is coded once and written.
2. Pairs (context, dish) of all training rows are counted and gathered by context. A task seats the restaurants it
   holds: customers of each dish are first seated one after another, then in every sweep customers are taken away
   and seated again. A customer of a dish with c customers at t tables sat alone with probability
   S(c-1, t-1) / S(c, t) (generalised Stirling numbers); it opens a table with odds (theta + d T) P(dish) against
   c - 1 - d t. The tables of each word become customers of the parent, which is seated in the same way.
3. Given the parent, contexts are seated again beside all places where their pairs occur, in training and held-out
   rows; after ``BURN_IN`` sweeps the predictive probabilities of ``SAMPLES`` sweeps are averaged, and their
   logarithms are summed by document. Contexts are dealt into ``SLICES`` rounds, to bound what lies on disk.

Contexts with over 1 / ``HOT_PARTS`` of all tokens are split by dish; a part takes its tables, scaled by its share of
the customers, for those of the whole. Words other than the frequent ones share their parent's probability in
2^``TAIL_BITS`` groups by hash, evenly. Discounts are estimated from the numbers of pairs met once and twice; the
strength is a parameter. For dishes of over ``EXACT`` customers the chance to have sat alone is taken as d t / c.

Null and empty texts have one token, the end. Long texts are scored whole. Ties in frequency do not matter. Repeated
rows, also of one doc_id, are each scored. Without training rows all counts are 0 and every probability is the
base's. A text that is certain (where all texts are empty) has score 0 and perplexity 1; an empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from netaccess.llm.common import ascii_words, hash_words, in_fold, map_arrow, mix64
from netaccess.runtime import discard, materialize

FOLDS, HELD_OUT = 7, 2
FREQUENT, TAIL_BITS = 1 << 18, 16
BURN_IN, SAMPLES, STEPS = 2, 3, 3
STRENGTH, FIRST_DISCOUNT, EXACT_SEATS, EXACT = 2.0, 0.8, 32, 48
HOT_PARTS, SALTS, SLICES, BLOCK_BITS = 1_000, 64, 4, 12
FLUSH_WORDS, FLUSH_PAIRS, PIECE = 200_000, 1_000_000, 400_000
#: The end token's key among words: no word is empty.
END_WORD = b""
#: Codes: frequent words by number, the end, and from here on other words by hash.
END, TAIL = FREQUENT, 1 << 30
SYMBOLS = FREQUENT + 1 + (1 << TAIL_BITS)


def narrow(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), in_fold(doc_id, FOLDS, HELD_OUT).alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """word, c for every word: its count in training rows (0: only held-out rows have it); tasks send each word once
    for every ``FLUSH_WORDS`` distinct ones."""
    schema = StructType([StructField("word", BinaryType()), StructField("c", LongType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter = Counter()
        for batch in batches:
            for value, held in zip(batch["text"], batch["held_out"].to_pylist()):
                words = ascii_words(value.as_py())
                if held:
                    for w in words:
                        counts.setdefault(w, 0)
                else:
                    counts.update(words)
                    counts[END_WORD] += 1
                if len(counts) >= FLUSH_WORDS:
                    yield {"word": list(counts), "c": list(counts.values())}
                    counts = Counter()
        yield {"word": list(counts), "c": list(counts.values())}

    return map_arrow(docs.select("text", "held_out"), run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def tail_codes(words: list[bytes]) -> np.ndarray:
    return (TAIL | (hash_words(words) >> np.uint64(34)).astype(np.int64)).astype(np.int32)


def symbol_of(code: np.ndarray) -> np.ndarray:
    """Index into the parent's probabilities."""
    return np.where(code < TAIL, code, FREQUENT + 1 + ((code & (TAIL - 1)) >> (30 - TAIL_BITS)))


def draws(keys: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers fixed by key and step, so that a task that runs again seats its customers as before."""
    with np.errstate(over="ignore"):
        x = mix64(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each group after seating all its customers from none; weight: (theta + d T) P(dish)."""
    tables = np.minimum(customers, 1).astype(float)
    live = np.flatnonzero(customers > 1)
    seated, step = 1, 0
    while len(live):
        jump = 1 if seated < EXACT_SEATS else max(1, seated // 16)
        size = np.minimum(jump, customers[live] - seated)
        t, w = tables[live], weight[live]
        mean = size * (w / (seated - discount * t + w))
        u = draws(keys[live], sweep * 1_000 + step)
        # the mean number of new tables, rounded up or down at random: exact for one customer
        tables[live] = np.minimum(t + np.floor(mean + u), customers[live])
        seated += jump
        step += 1
        live = live[customers[live] > seated]
    return tables


@lru_cache(maxsize=8)
def alone(discount: float) -> np.ndarray:
    """S(c-1, t-1) / S(c, t) for c, t up to ``EXACT``: the chance that one of c customers at t tables sits alone."""
    s = np.zeros((EXACT + 1, EXACT + 1))
    out = np.ones((EXACT + 1, EXACT + 1))
    s[1, 1] = 1.0
    for c in range(2, EXACT + 1):
        for t in range(1, c + 1):
            s[c, t] = s[c - 1, t - 1] + (c - 1 - discount * t) * s[c - 1, t]
            out[c, t] = s[c - 1, t - 1] / s[c, t]
        s[c] /= s[c].max()  # only ratios of a row and the one before count
    return out


def sitting_alone(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    few = c <= EXACT
    p = discount * t / np.maximum(c, 1)
    p[few] = alone(round(discount, 6))[c[few], t[few].astype(np.int64)]
    return np.where(t > 1, np.minimum(p, 1.0), 0.0)


def discount_of(ones: float, twos: float) -> float:
    return round(float(np.clip(ones / max(1.0, ones + 2 * twos), 0.1, 0.95)), 6)


class Restaurants:
    """Restaurants side by side: ``owner`` of each (restaurant, dish) group, its customers c, its keys for draws and the parent's p."""

    def __init__(self, owner: np.ndarray, c: np.ndarray, p: np.ndarray, discount: float, keys: np.ndarray, whole: np.ndarray | None = None):
        self.owner, self.c, self.p, self.discount, self.keys = owner, c, p, discount, keys
        self.n = int(owner.max(initial=-1)) + 1
        own = np.bincount(owner, c, self.n)
        #: customers of the whole restaurant, of which these may be a part
        self.customers = own if whole is None else np.maximum(whole, own)
        self.scale = self.customers / np.maximum(own, 1.0)
        start = np.bincount(owner, np.minimum(c, 1), self.n) * self.scale
        self.t = seat(c, (STRENGTH + discount * start)[owner] * p, discount, keys, 0)
        self.step = 1
        self.live = np.flatnonzero(c > 1)

    def tables(self) -> np.ndarray:
        return np.bincount(self.owner, self.t, self.n) * self.scale

    def sweep(self) -> None:
        """``STEPS`` customers of every dish with several are taken away and seated again."""
        live, d = self.live, self.discount
        c = self.c[live]
        for _ in range(STEPS if len(live) else 0):
            t = self.t[live]
            left = draws(self.keys[live], 10_000 + 2 * self.step) < sitting_alone(c, t, d)
            t = t - left
            weight = (STRENGTH + d * np.maximum(self.tables()[self.owner[live]] - left, 0.0)) * self.p[live]
            t = t + (draws(self.keys[live], 10_001 + 2 * self.step) < weight / (weight + np.maximum(c - 1 - d * t, 0.0)))
            self.t[live] = np.clip(t, 1, c)
            self.step += 1

    def predictive(self) -> np.ndarray:
        new = (STRENGTH + self.discount * self.tables())[self.owner] * self.p
        return (np.maximum(self.c - self.discount * self.t, 0.0) + new) / (STRENGTH + self.customers)[self.owner]

    def averaged(self) -> np.ndarray:
        """Mean predictive probability of each group after burning in."""
        total = np.zeros(len(self.c))
        for k in range(BURN_IN + SAMPLES):
            self.sweep()
            if k >= BURN_IN:
                total += self.predictive() / SAMPLES
        return total


def parent_probabilities(tables: np.ndarray, words: np.ndarray) -> np.ndarray:
    """P(word) of the parent restaurant by symbol; ``words``: how many words share the symbol."""
    c, n = np.round(tables).astype(np.int64), np.maximum(words, 1).astype(float)
    base = n / n[words > 0].sum() if (words > 0).any() else n
    d = discount_of(float((c == 1).sum()), float((c == 2).sum()))
    rooms = Restaurants(np.zeros(len(c), np.int64), c, base, d, np.arange(len(c)))
    return rooms.averaged() / n


def pairs_of(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """context << 32 | dish of every token of texts laid end to end, each closed by the end token."""
    before = np.concatenate([[END], codes[:-1]]) if len(codes) else codes
    before[np.cumsum(lengths)[:-1]] = END
    return before.astype(np.int64) << 32 | codes.astype(np.int64)


def dealt(pair: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The number by which a pair is gathered: one for a context, ``SALTS`` for a hot one."""
    u = pair >> 32
    at = u * SALTS
    some = np.flatnonzero(hot[np.minimum(u, END)] & (u < TAIL))
    at[some] += mix64((pair[some] & 0xFFFFFFFF).astype(np.uint64)).astype(np.int64) % SALTS
    with np.errstate(over="ignore"):
        return (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def coded_pieces(batch: dict) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Codes of whole texts laid end to end, their lengths and the rows they come from, about ``PIECE`` codes at a time."""
    blobs = batch["codes"]
    first = 0
    while first < len(blobs):
        held, total, last = [], 0, first
        while last < len(blobs) and (not held or total < PIECE):
            held.append(blobs[last].as_py())
            total += len(held[-1]) // 4
            last += 1
        yield np.frombuffer(b"".join(held), "<i4"), np.array([len(b) // 4 for b in held], np.int64), slice(first, last)
        first = last


def gathered(rows: DataFrame, schema: StructType, fn) -> DataFrame:
    """``fn`` on the arrays of all rows (pair, v) of a partition; partitions hold whole groups."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pair, v = [], []
        for batch in batches:
            pair.append(batch["pair"].to_numpy(zero_copy_only=False))
            v.append(batch["v"].to_numpy(zero_copy_only=False))
        if pair:
            yield fn(np.concatenate(pair), np.concatenate(v))

    return map_arrow(rows.repartition("g").select("pair", "v"), run, schema)


def restaurants_of(pair: np.ndarray, c: np.ndarray, p: np.ndarray, discount: float, counts: np.ndarray, hot: np.ndarray) -> Restaurants:
    """The context restaurants of sorted distinct pairs."""
    u = pair >> 32
    first = np.append(True, u[1:] != u[:-1])
    whole = np.where(u[first] <= END, np.where(hot[np.minimum(u[first], END)], counts[np.minimum(u[first], END)], 0), 0)
    return Restaurants(np.cumsum(first) - 1, c, p[symbol_of(pair & 0xFFFFFFFF)], discount, pair, whole.astype(float))


def seat_pairs(coded: DataFrame, model, slice_at: int) -> DataFrame:
    """symbol, t: tables by dish over the contexts of one slice; -1 and -2: numbers of pairs met once and twice."""
    rows = StructType([StructField("g", LongType()), StructField("pair", LongType()), StructField("v", LongType())])

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        hot = model.value["hot"]
        held, n = [], 0
        for batch in batches:
            for codes, lengths, _ in coded_pieces(batch):
                pair = pairs_of(codes, lengths)
                held.append(pair[dealt(pair, hot) % SLICES == slice_at])
                n += len(held[-1])
                if n >= FLUSH_PAIRS:
                    pair, c = np.unique(np.concatenate(held), return_counts=True)
                    yield {"g": dealt(pair, hot), "pair": pair, "v": c}
                    held, n = [], 0
        pair, c = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        yield {"g": dealt(pair, hot), "pair": pair, "v": c}

    def seated(pair: np.ndarray, v: np.ndarray) -> dict:
        m = model.value
        pair, at = np.unique(pair, return_inverse=True)
        c = np.bincount(at, v, len(pair)).astype(np.int64)
        rooms = restaurants_of(pair, c, m["start"], FIRST_DISCOUNT, m["counts"], m["hot"])
        for _ in range(BURN_IN):
            rooms.sweep()
        t = np.bincount(symbol_of(pair & 0xFFFFFFFF), rooms.t, SYMBOLS)
        some = np.flatnonzero(t)
        return {"symbol": np.concatenate([some, [-1, -2]]), "t": np.concatenate([t[some], [(c == 1).sum(), (c == 2).sum()]])}

    out = StructType([StructField("symbol", LongType()), StructField("t", DoubleType())])
    found = gathered(map_arrow(coded.filter(~F.col("held_out")).select("codes"), count, rows), out, seated)
    return found.groupBy("symbol").agg(F.sum("t").alias("t"))


def score_pairs(coded: DataFrame, model, slice_at: int) -> DataFrame:
    """block (of 2^``BLOCK_BITS`` neighbouring rows), at and score (packed): the sums of log10 probabilities that a
    task has for these rows' tokens, as far as their contexts lie in one slice."""
    rows = StructType([StructField("g", LongType()), StructField("pair", LongType()), StructField("v", LongType())])

    def places(batches: Iterator[dict]) -> Iterator[dict]:
        hot = model.value["hot"]
        for batch in batches:
            row = batch["row"].to_numpy(zero_copy_only=False) * 2 + np.array(batch["held_out"].to_pylist(), np.int64)
            for codes, lengths, at in coded_pieces(batch):
                pair = pairs_of(codes, lengths)
                g = dealt(pair, hot)
                own = g % SLICES == slice_at
                yield {"g": g[own], "pair": pair[own], "v": np.repeat(row[at], lengths)[own]}

    def scored(pair: np.ndarray, v: np.ndarray) -> dict:
        m = model.value
        pair, at = np.unique(pair, return_inverse=True)
        c = np.bincount(at, 1 - (v & 1), len(pair)).astype(np.int64)
        p = np.log10(restaurants_of(pair, c, m["parent"], m["discount"], m["counts"], m["hot"]).averaged())
        row, at_row = np.unique(v >> 1, return_inverse=True)
        score = np.bincount(at_row, p[at], len(row))
        block, first = np.unique(row >> BLOCK_BITS, return_index=True)
        ends = [*first[1:].tolist(), len(row)]
        place = (row & ((1 << BLOCK_BITS) - 1)).astype("<u2")
        return {"block": block, "at": [place[a:b].tobytes() for a, b in zip(first, ends)], "score": [score[a:b].tobytes() for a, b in zip(first, ends)]}

    out = StructType([StructField("block", LongType()), StructField("at", BinaryType()), StructField("score", BinaryType())])
    return gathered(map_arrow(coded.select("row", "held_out", "codes"), places, rows), out, scored)


def summed_scores(packed: DataFrame) -> DataFrame:
    """row, score: the packed sums added up; a task holds one array for each of its blocks."""
    schema = StructType([StructField("row", LongType()), StructField("score", DoubleType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, score in zip(batch["block"].to_pylist(), batch["at"].to_pylist(), batch["score"].to_pylist()):
                if block not in held:
                    held[block] = np.zeros(1 << BLOCK_BITS)
                held[block][np.frombuffer(at, "<u2")] += np.frombuffer(score)
        for block, total in held.items():
            some = np.flatnonzero(total)
            yield {"row": (block << BLOCK_BITS) + some, "score": total[some]}

    return map_arrow(packed.repartition("block"), run, schema)


def by_symbol(rows: DataFrame, column: str) -> tuple[np.ndarray, dict[int, float]]:
    """The sums by symbol as an array of ``SYMBOLS`` numbers, and those under negative numbers."""
    got = rows.toArrow()
    at, v = got.column("symbol").to_numpy(), got.column(column).to_numpy().astype(float)
    out = np.zeros(SYMBOLS)
    out[at[at >= 0]] = v[at >= 0]
    return out, dict(zip(at[at < 0].tolist(), v[at < 0].tolist()))


def tail_words(vocabulary: DataFrame, floor: int) -> DataFrame:
    """symbol, n, c: words and their counts in each group of words below ``floor``."""
    schema = StructType([StructField("symbol", LongType()), StructField("n", LongType()), StructField("c", LongType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        n, c = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            at = symbol_of(tail_codes(batch["word"].to_pylist()).astype(np.int64))
            n += np.bincount(at, minlength=SYMBOLS)
            c += np.bincount(at, batch["c"].to_numpy(), SYMBOLS).astype(np.int64)
        some = np.flatnonzero(n)
        yield {"symbol": some, "n": n[some], "c": c[some]}

    rare = vocabulary.filter((F.col("c") < floor) & (F.col("word") != F.lit(bytearray(END_WORD))))
    return map_arrow(rare, run, schema).groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def code_texts(docs: DataFrame, known, n_ends: int, spread: float) -> DataFrame:
    """doc_id, held_out, n_tokens, codes, and of the frequent words n_known and base; tail: the other words and their counts."""
    tail_type = ArrayType(StructType([StructField("word", BinaryType()), StructField("n", IntegerType())]))
    schema = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("codes", BinaryType()), StructField("n_known", LongType()), StructField("base", DoubleType()), StructField("tail", tail_type)])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        index, counts = known.value
        bases = np.log10((counts + 1) / spread)
        get = index.get
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"].to_pylist(), "held_out": batch["held_out"].to_pylist(), "n_tokens": [], "codes": [], "n_known": [], "base": [], "tail": []}
            tail, places, coded = [], [], []
            for value in batch["text"]:
                words = ascii_words(value.as_py())
                at = np.fromiter(chain(map(get, words, repeat(-1)), (END,)), "<i4", len(words) + 1)
                rare = np.flatnonzero(at < 0)
                frequent = at[:-1][at[:-1] >= 0]
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(frequent) + (n_ends > 0))
                out["base"].append(float(bases[frequent].sum()) + math.log10((n_ends + 1) / spread))
                tail.append([words[i] for i in rare.tolist()])
                places.append(rare)
                coded.append(at)
            # hashes and lists of the whole batch at once
            codes = np.split(tail_codes(list(chain.from_iterable(tail))), np.cumsum([len(x) for x in tail])[:-1])
            for at, rare, code in zip(coded, places, codes):
                at[rare] = code
                out["codes"].append(at.tobytes())
            counted = [Counter(x) for x in tail]
            ends = np.cumsum([0, *map(len, counted)])
            word = pa.array(list(chain.from_iterable(counted)), pa.binary())
            n = pa.array(list(chain.from_iterable(x.values() for x in counted)), pa.int32())
            out["tail"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([word, n], ["word", "n"]))
            yield out

    return map_arrow(docs.select("doc_id", "text", "held_out"), run, schema).withColumn("row", F.monotonically_increasing_id())


def fit_parent(coded: DataFrame, counts: np.ndarray, words: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, float]:
    """The parent's probabilities and the contexts' discount, from the seating of all training pairs."""
    sc = coded.sparkSession.sparkContext
    start = (counts + words) / (counts + words).sum() / np.maximum(words, 1)
    model = sc.broadcast({"hot": hot, "start": start, "counts": counts[: END + 1]})
    tables, told = np.zeros(SYMBOLS), Counter()
    for k in range(SLICES):
        t, more = by_symbol(seat_pairs(coded, model, k), "t")
        tables += t
        told.update(more)
    model.destroy()
    return parent_probabilities(tables, words), discount_of(told[-1], told[-2])


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every document."""
    docs = narrow(docs)
    spark = docs.sparkSession
    vocabulary = materialize(count_words(docs), "vocabulary")
    powers = [2**k for k in range(48)]
    sizes = vocabulary.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), *(F.sum((F.col("c") >= k).cast("long")).alias(f"p{i}") for i, k in enumerate(powers))).first()
    n_train, n_distinct = int(sizes["n"] or 0), int(sizes["v"] or 0)
    floor = next(k for i, k in enumerate(powers) if (sizes[f"p{i}"] or 0) <= FREQUENT)
    is_end = F.col("word") == F.lit(bytearray(END_WORD))
    n_ends = int(vocabulary.filter(is_end).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"])
    spread = n_train + n_distinct + 1.0

    frequent = vocabulary.filter((F.col("c") >= floor) & ~is_end).toArrow()
    index = {w: i for i, w in enumerate(frequent.column("word").to_pylist())}
    own = frequent.column("c").to_numpy().astype(float)
    known = spark.sparkContext.broadcast((index, own))
    counts, words = np.zeros(SYMBOLS), np.zeros(SYMBOLS, np.int64)
    counts[: len(own)], words[: len(own)], counts[END], words[END] = own, 1, n_ends, 1
    tail = tail_words(vocabulary, floor).toArrow()
    at = tail.column("symbol").to_numpy()
    counts[at], words[at] = tail.column("c").to_numpy(), tail.column("n").to_numpy()
    hot = counts[: END + 1] * HOT_PARTS > max(1, n_train)
    del index, frequent

    coded = materialize(code_texts(docs, known, n_ends, spread), "lm-coded")
    known.destroy()
    parent, discount = fit_parent(coded, counts, words, hot)
    model = spark.sparkContext.broadcast({"hot": hot, "parent": parent, "counts": counts[: END + 1], "discount": discount})
    scores = None
    for k in range(SLICES):
        part = materialize(score_pairs(coded, model, k), "lm-scores")
        scores = part if scores is None else scores.union(part)

    others = coded.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.n").join(vocabulary.filter(F.col("c") < floor), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    more = others.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((c + 1) / spread)).alias("more_base"))
    more = materialize(more, "lm-tail")
    facts = materialize(coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base"), "lm-rows")
    discard(coded)
    zero = lambda k: F.coalesce(F.col(k), F.lit(0))
    out = facts.join(more, "row", "left").join(summed_scores(scores), "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), zero("score").alias("score"), F.pow(F.lit(10.0), -zero("score") / F.col("n_tokens")).alias("perplexity"),
    )
