"""Toxicity by weak supervision.

1. Voters: whole words (lexicon) and word beginnings (patterns) that labelled rows outside the held-out
   fold tie to toxic text. Each votes toxic on a document that holds it and else abstains.
2. Label model: every voter's rates under the two classes are estimated by expectation-maximisation on the
   votes of all documents, started from the labelled rows; the residual correlation of each pair of voters,
   from co-votes counted over all documents, lowers the weight of voters that repeat one another.
3. Classifier: a linear (logistic) model over the same kinds of word evidence is trained on the label
   model's posteriors and gives the score.

Bounds: at most ``LABEL_BOUND`` labelled rows (lowest hash of the id first), ``VOTERS`` voters,
``FEATURES`` words and beginnings. Null and empty texts hold no evidence and get the score of the
intercept. A null doc_id is in no fold: its row is scored and not held out. Equal texts get equal scores. With no toxic labelled row there is no voter and every score is
0. Empty tables give an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from netaccess.llm.common import in_fold, map_arrow
from netaccess.runtime import broadcast_if_small, materialize

FOLDS, HELD_OUT = 4, 2
LABEL_BOUND, VOTERS, FEATURES = 20_000, 256, 2_048
STEMS = (4, 5, 6)
MIN_TOXIC, MIN_LIFT = 4, 8.0
CUT_AT = 0.3
EM_ROUNDS = 5
EDGES = ".,;:!?\"'()[]{}#*$%&|<>~_-…«»“”‘’¿¡"
CACHE_WORDS = 400_000
REJECT_BROADCAST_ROWS = 1_000_000


def evidence(text: str) -> set[str]:
    """Distinct words of the text, lower-case without punctuation at their edges, and their beginnings as ``stem*``."""
    words = {w.strip(EDGES) for w in text.lower().split()}
    words.discard("")
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


class WordIds(dict):
    """Word as written -> ids of the kept evidence that it gives."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = word.strip(EDGES)
        keys = [w] + [w[:k] + "*" for k in STEMS if len(w) >= k]
        found = self[word] = tuple(self.ids[k] for k in keys if k in self.ids)
        return found


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def evidence_ids(docs: DataFrame, ids: dict[str, int]) -> DataFrame:
    """doc_id and the sorted ids of kept evidence in the whole text."""
    schema = StructType([StructField("doc_id", LongType()), StructField("hits", ArrayType(IntegerType()))])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordIds(ids)
        for batch in batches:
            hits = []
            for value in batch["text"]:
                words = set((value.as_py() or "").lower().split())
                hits.append(sorted({i for found in map(known.__getitem__, words) if found for i in found}))
            yield {"doc_id": batch["doc_id"].to_pylist(), "hits": hits}

    return map_arrow(narrow(docs), run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.filter(F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_BOUND)
    return narrow(docs).join(F.broadcast(told), "doc_id")


def mine_evidence(told: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """Evidence that toxic labelled rows hold at least ``MIN_LIFT`` times as often: (key, toxic rows, other rows), best first."""
    schema = StructType([StructField("key", StringType()), StructField("toxic", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for value, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                for key in evidence(value.as_py() or ""):
                    c = counts.setdefault(key, [0, 0])
                    c[0] += toxic
                    c[1] += 1
            yield {"key": list(counts), "toxic": [c[0] for c in counts.values()], "n": [c[1] for c in counts.values()]}

    sizes = told.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    n_toxic, n_clean = int(sizes["toxic"]), int(sizes["n"] - sizes["toxic"])
    if not n_toxic:
        return [], 0, n_clean
    counts = map_arrow(told, run, schema).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    lift = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("n") - F.col("toxic") + 0.5) / (n_clean + 1))
    best = counts.filter((F.col("toxic") >= MIN_TOXIC) & (lift >= MIN_LIFT)).orderBy(F.desc(F.col("toxic") * F.log(lift)), "key").limit(FEATURES)
    return [(r["key"], int(r["toxic"]), int(r["n"] - r["toxic"])) for r in best.collect()], n_toxic, n_clean


class LabelModel:
    """Class share, voter rates by class, and voter weights lowered for residual correlation."""

    def __init__(self, rates: np.ndarray, share: float):
        self.rates, self.share = rates, share
        self.weights = np.ones(rates.shape[1])

    def logits(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0]) * self.weights
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weights
        return math.log(self.share / (1 - self.share)) + votes @ (on - off) + off.sum()

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(votes), -30, 30)))


def dense(patterns: list[list[int]], m: int) -> np.ndarray:
    votes = np.zeros((len(patterns), m))
    for row, hits in enumerate(patterns):
        votes[row, hits] = 1
    return votes


def summed(patterns: DataFrame, m: int, statistic, size: int) -> np.ndarray:
    """Sum of ``statistic(votes, counts)`` (``size`` numbers) over all vote patterns; partial sums are added in Spark."""
    schema = StructType([StructField("at", IntegerType()), StructField("v", DoubleType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(size)
        for batch in batches:
            hits, n = batch["hits"].to_pylist(), np.array(batch["n"].to_pylist(), float)
            for k in range(0, len(hits), 2_000):
                total += statistic(dense(hits[k : k + 2_000], m), n[k : k + 2_000])
        at = np.flatnonzero(total)
        yield {"at": at.tolist(), "v": total[at].tolist()}

    out = np.zeros(size)
    for r in map_arrow(patterns.select("hits", "n"), run, schema).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def fit_label_model(patterns: DataFrame, start: np.ndarray, share: float) -> LabelModel:
    m = start.shape[1]
    model = LabelModel(start, share)
    base = model.rates.copy()

    def expected(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = model.posterior(votes) * n
        q = n - p
        return np.concatenate([[p.sum(), q.sum()], p @ votes, q @ votes])

    def covotes(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = model.posterior(votes) * n
        return (votes.T @ (votes * p[:, None])).ravel()

    for k in range(EM_ROUNDS):
        s = summed(patterns, m, expected, 2 + 2 * m)
        # fifty imagined documents of each class hold the rates near those of the labelled rows
        model.rates = np.clip(np.stack([(s[2 + m :] + 50 * base[0]) / (s[1] + 50), (s[2 : 2 + m] + 50 * base[1]) / (s[0] + 50)]), 1e-6, 0.95)
        model.share = float(np.clip(s[0] / max(1.0, s[0] + s[1]), 1e-3, 0.5))
        if k == 0:
            together = summed(patterns, m, covotes, m * m).reshape(m, m) / max(1.0, s[0])
            a = model.rates[1]
            excess = (together - np.outer(a, a)) / np.sqrt(np.outer(a * (1 - a), a * (1 - a)))
            np.fill_diagonal(excess, 0)
            # toxic words of one language go together a little; only voters that mostly repeat one another share a weight
            model.weights = 1 / (1 + np.where(excess > 0.5, np.minimum(excess, 1), 0).sum(1))
    return model


def fit_logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 300, ridge: float = 2e-4) -> np.ndarray:
    """Weights (last: intercept) of a logistic model on soft labels of rows that stand for n documents each, by accelerated gradient steps."""
    n = n / n.sum()
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    v, rate = w.copy(), 4.0 / max(1.0, float(n @ (x**2).sum(1)))
    for k in range(rounds):
        grad = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - p)) + ridge * np.append(v[:-1], 0)
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    told = materialize(labelled_rows(docs, labels), "toxic-labelled")
    mined, n_toxic, n_clean = mine_evidence(told)
    held = in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out")
    if not mined:
        return narrow(docs).select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    hits = materialize(evidence_ids(docs, {key: i for i, (key, _, _) in enumerate(mined)}), "toxic-hits")
    m = min(VOTERS, len(mined))
    patterns = materialize(hits.groupBy(F.filter("hits", lambda i: i < m).alias("hits")).agg(F.count("*").alias("n")), "toxic-patterns")
    start = np.array([[(c + 0.05) / (n_clean + 1), (t + 0.05) / (n_toxic + 1)] for _, t, c in mined[:m]]).T
    model = fit_label_model(patterns, np.clip(start, 1e-6, 0.95), n_toxic / max(1, n_toxic + n_clean))
    rows = hits.join(F.broadcast(told.select("doc_id")), "doc_id").groupBy("hits").agg(F.count("*").alias("n")).orderBy("hits").collect()
    x = dense([r["hits"] for r in rows], len(mined))
    w = fit_logistic(x, model.posterior(x[:, :m]), np.array([r["n"] for r in rows], float))
    table = F.split(F.lit(",".join(repr(float(v)) for v in w[:-1])), ",").cast("array<double>")
    logit = F.aggregate("hits", F.lit(float(w[-1])), lambda s, i: s + F.element_at(F.col("w"), i + 1))
    scored = hits.withColumn("w", table).select("doc_id", held, (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT_AT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no predicted toxic text; rows without doc_id stay, every column passes through."""
    rejected = score_toxicity(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("rejected_id")).distinct()
    rejected = broadcast_if_small(materialize(rejected, "toxic-rejected"), REJECT_BROADCAST_ROWS)
    return docs.join(rejected, docs["doc_id"].cast("long") == rejected["rejected_id"], "left_anti")
