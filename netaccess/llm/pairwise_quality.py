"""Quality classifier by Bradley-Terry ranking: P(a beats b) = sigmoid(w . (x_a - x_b)).

Preference pairs set a good document against a bad one, both from labelled rows outside the held-out
fold. The weights minimise the logistic loss on feature differences. All documents are then scored, and
the cut is the quantile of all scores that leaves the labelled share of bad documents below it; scores
are scaled so that the cut lies at ``CUT_AT``.

The model is fitted on at most ``LABEL_BOUND`` labelled rows (lowest hash of the id first) and at most
``PAIR_BOUND`` pairs; scoring covers every row. Null and empty texts have all features 0 and a score from
these. A null doc_id is in no fold: its row is scored and not held out. Equal texts get equal scores. Without rows of both labels every weight is 0 and every score is
``CUT_AT``. Empty tables give an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from netaccess.llm.common import in_fold, map_arrow
from netaccess.runtime import materialize

FOLDS, HELD_OUT = 4, 2
LABEL_BOUND, PAIR_BOUND = 20_000, 60_000
CUT_AT = 0.7
MARKS = re.compile(r"[#*$%&|<>]+")
SHOUT = re.compile(r"[!?]{2}")
UPPER_WORD = re.compile(r"\b[^\W\d_]{2,}\b")
FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "shouts", "digits", "dup_lines", "distinct", "short_words", "comma", "stops", "line_words")


def text_features(text: str) -> list[float]:
    """Simple shares and lengths of a whole text, in the order of FEATURES."""
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    marks = MARKS.findall(text)
    upper = len(text) - len(text.translate(CAPITALS)) if text.isascii() else sum(map(str.isupper, words)) * chars / n
    digits = sum(map(text.count, "0123456789"))
    return [
        math.log1p(n), chars / n, sum(map(len, marks)) / n, len(marks) / n, upper / chars,
        len(SHOUT.findall(text)) / n, digits / chars, 1 - len(set(lines)) / max(1, len(lines)), len(distinct) / n ** 0.8,
        sum(1 for w in words if len(w) <= 2) / n, text.count(",") / n, text.count(".") / n, math.log1p(n / max(1, len(lines))),
    ]


CAPITALS = dict.fromkeys(range(65, 91))


def feature_table(docs: DataFrame) -> DataFrame:
    schema = StructType([StructField("doc_id", LongType()), StructField("x", ArrayType(DoubleType()))])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"].to_pylist(), "x": [text_features(v.as_py() or "") for v in batch["text"]]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def preference_pairs(good: np.ndarray, bad: np.ndarray, bound: int) -> np.ndarray:
    """Feature differences, good minus bad: the rarer side goes round against the other, shifted at each turn."""
    if not len(good) or not len(bad):
        return np.empty((0, len(FEATURES)))
    most, least = max(len(good), len(bad)), min(len(good), len(bad))
    turns = max(1, min(least, bound // most))
    i = np.tile(np.arange(most), turns)[:bound]
    shift = np.repeat(np.arange(turns) * max(1, least // turns), most)[:bound]
    g, b = (i % len(good), (i + shift) % len(bad)) if len(good) >= len(bad) else ((i + shift) % len(good), i % len(bad))
    return good[g] - bad[b]


def fit_bradley_terry(diff: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps on the mean logistic loss of the differences with a ridge."""
    w = np.zeros(diff.shape[1])
    for _ in range(rounds if len(diff) else 0):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = -diff.T @ (1 - p) / len(diff) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    features = materialize(feature_table(docs), "rank-features")
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    told = told.filter(F.col("quality").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_BOUND)
    rows = features.join(F.broadcast(told), "doc_id").select("x", "quality").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r["quality"] for r in rows], int)
    mean, std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.clip((x - mean) / std, -8, 8)
    w = fit_bradley_terry(preference_pairs(z[y == 1], z[y != 1], PAIR_BOUND))
    bad_share = float((y != 1).mean()) if len(y) else 0.0
    raw = F.lit(0.0)
    for k in range(len(FEATURES)):
        scaled = (F.element_at("x", k + 1) - float(mean[k])) / float(std[k])
        raw = raw + float(w[k]) * F.least(F.greatest(scaled, F.lit(-8.0)), F.lit(8.0))
    scored = features.select("doc_id", raw.alias("raw"))
    cut = scored.agg(F.percentile_approx("raw", bad_share, 10_000).alias("cut")).first()["cut"] or 0.0
    # the quantile is of a score with gaps between classes: take the middle of the gap that it falls in
    above = scored.filter(F.col("raw") > cut).agg(F.min("raw").alias("next")).first()["next"]
    cut = cut if above is None else (cut + above) / 2
    score = 1 / (1 + F.exp(-(F.col("raw") - cut + math.log(CUT_AT / (1 - CUT_AT)))))
    scored = scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT_AT).cast("int"))
