"""Hard negatives by a secondary sort.

Rows and anchors are packed into blocks. Every block of rows meets every block of anchors once, and numpy scores them
together; of each meeting only pairs that can still count leave the task: an anchor's best rows of its own label, and
for each of its positives the best rows inside the window of that positive. Their scores are packed into keys of (anchor,
descending score, id), which ``repartitionAndSortWithinPartitions`` brings together and orders; an iterator then reads
an anchor's scores from the highest down, opens a window at each positive and gives out the negatives that fall into it.
It holds the open windows and, for positives of score 0 alone, the first negatives of score 0; no anchor is ever gathered.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part; neither do anchors without
positives. Vectors are compared with those of equal length only; an empty one scores 0. Ties go to the lesser id. Rows with
an anchor's own id are not other rows for it; if several have it, the least (label, vector) is the anchor. Other repeated rows
count as often as they occur. Empty tables give empty results; further columns are ignored. Scores that 63 bits may not
hold raise an OverflowError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from netaccess.llm.common import map_arrow
from netaccess.runtime import discard, materialize

#: Rows and numbers that a block holds at most.
BLOCK_ROWS, BLOCK_CELLS = 8_192, 1 << 20
ANCHOR_ROWS = 1_024
#: Shards for each shuffle partition: every shard has a copy of all anchors, and no more tasks run than there are partitions.
SHARDS_A_PARTITION = 4
SIGN = 1 << 63
KEY = struct.Struct(">QQQ")
BLOCK = [StructField("block", LongType()), StructField("dims", IntegerType()), StructField("n", IntegerType()), StructField("ids", BinaryType()), StructField("labels", BinaryType()), StructField("cells", BinaryType())]
WINDOWS = StructField("windows", ArrayType(ArrayType(LongType())))
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(vector: Column) -> Column:
    """256 * x of each component as a double, still to be floored; null if the vector or a component is null or not finite."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.lit(256.0) * c.cast("double")))


def sound_rows(rows: DataFrame, vector: str, label: Column) -> DataFrame:
    """id, label and v of the rows that take part."""
    narrow = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector)).alias("v"))
    return narrow.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """(block, dims, n, ids, labels, cells): rows of one length side by side, as they come in a partition; ``scores`` go along as windows."""
    scored = "scores" in rows.columns

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, labels, v = b["id"].to_numpy(zero_copy_only=False), b["label"].to_numpy(zero_copy_only=False), b["v"]
            lengths, flat, starts = v.value_lengths().to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                step = max(1, min(most, BLOCK_CELLS // max(1, dims)))
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    cells = np.floor(flat[starts[some][:, None] + np.arange(dims)])
                    out = {"block": [at], "dims": [dims], "n": [len(some)], "ids": [ids[some].astype("<i8").tobytes()], "labels": [labels[some].astype("<i8").tobytes()], "cells": [cells.astype("<f8").tobytes()]}
                    yield out | ({"windows": [b["scores"].take(some).to_pylist()]} if scored else {})
                    at += 1

    return map_arrow(rows, run, StructType(BLOCK + [WINDOWS] * scored))


def block_scores(row: dict, anchor: dict) -> tuple[np.ndarray, ...]:
    """ids and labels of both sides and the exact integer scores, anchors by rows."""
    dims = row["dims"]
    r, a = (np.frombuffer(x["cells"], "<f8").reshape(x["n"], dims) for x in (row, anchor))
    most = dims * float(np.abs(r).max(initial=0)) * float(np.abs(a).max(initial=0))
    if most >= 2.0**63:
        raise OverflowError("a score may not fit into 63 bits")
    # sums of products below 2^53 are exact in doubles, in any order
    scores = (a @ r.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ r.T.astype(np.int64)
    ids, labels, anchors, own = (np.frombuffer(x[c], "<i8") for x in (row, anchor) for c in ("ids", "labels"))
    return ids, labels, anchors, own, scores


def first_of(ids: np.ndarray, scores: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``which`` the k of highest score, ties to the lesser id, without sorting the rest."""
    if len(which) > 4 * k:
        cut = np.partition(scores[which], len(which) - k)[len(which) - k]
        above, level = which[scores[which] > cut], which[scores[which] == cut]
        if len(level) > k:
            level = level[np.argpartition(ids[level], k - 1)[:k]]
        which = np.concatenate([above, level])
    return which[np.lexsort((ids[which], -scores[which]))[:k]]


def meetings(blocks: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """Every block of rows beside every block of anchors of its length; they meet by shard, so that neither side is sent whole to anyone.

    The planner counts the blocks of anchors before they are copied to the shards and would broadcast all copies through the driver, so it is told to merge.
    """
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    named = asked.select(*(F.col(c).alias(c if c == "dims" else f"a_{c}") for c in asked.columns))
    copies = named.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), ["shard", "dims"]).drop("shard", "block", "a_block")


def near_positives(meetings: DataFrame, positives: int) -> DataFrame:
    """(anchor_id, id, score): of every meeting an anchor's best rows of its label."""
    schema = StructType([StructField("anchor_id", LongType()), StructField("id", LongType()), StructField("score", LongType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for row, anchor in pairs_of(batch):
                ids, labels, anchors, own, scores = block_scores(row, anchor)
                out: dict[str, list] = {"anchor_id": [], "id": [], "score": []}
                for i, (a, label) in enumerate(zip(anchors.tolist(), own.tolist())):
                    best = first_of(ids, scores[i], np.flatnonzero((labels == label) & (ids != a)), positives)
                    out["anchor_id"] += [a] * len(best)
                    out["id"] += ids[best].tolist()
                    out["score"] += scores[i][best].tolist()
                yield out

    return map_arrow(meetings, run, schema)


def near_negatives(meetings: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """(key, positive): of every meeting the best rows of another label inside the window of each positive score."""
    schema = StructType([StructField("key", BinaryType()), StructField("positive", BooleanType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for row, anchor in pairs_of(batch):
                ids, labels, anchors, own, scores = block_scores(row, anchor)
                keys: list[bytes] = []
                for i, (a, label) in enumerate(zip(anchors.tolist(), own.tolist())):
                    other = np.flatnonzero((labels != label) & (ids != a))
                    found: set[int] = set()
                    for p in set(anchor["windows"][i]):
                        # the bounds -(-low*p // 100) <= score <= high*p // 100 in whole numbers
                        inside = other[(scores[i][other] >= -(-low * p // 100)) & (scores[i][other] <= high * p // 100)]
                        found.update(first_of(ids, scores[i], inside, negatives).tolist())
                    keys += [packed(a, int(scores[i][k]), int(ids[k])) for k in sorted(found)]
                yield {"key": keys, "positive": [False] * len(keys)}

    return map_arrow(meetings, run, schema)


def pairs_of(batch: dict) -> Iterator[tuple[dict, dict]]:
    """The two blocks of each meeting, one at a time."""
    names = [n for n in batch if not n.startswith("a_")]
    for k in range(len(batch["dims"])):
        row = {n: batch[n][k].as_py() for n in names}
        yield row, {"dims": row["dims"]} | {n[2:]: batch[n][k].as_py() for n in batch if n.startswith("a_")}


def packed(anchor: int, score: int, row: int) -> bytes:
    """A key whose byte order is (anchor, descending score, id)."""
    return KEY.pack(anchor + SIGN, SIGN - 1 - score, row + SIGN)


def unpacked(key: bytes) -> tuple[int, int, int]:
    a, s, r = KEY.unpack(key)
    return a - SIGN, SIGN - 1 - s, r - SIGN


def place_of(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine(pairs: Iterator[tuple[bytes, bool]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from sorted (key, is a positive).

    ``windows``: [positive id, its score, negatives given out]. A negative in the window of a positive above 0 comes after it;
    those of score 0 may stand before a positive of score 0, so the first of them are kept.
    """
    anchor, windows, zeros = None, [], []
    for key, positive in pairs:
        a, score, row = unpacked(key)
        if a != anchor:
            anchor, windows, zeros, opened = a, [], [], 0
        if positive:
            if opened < positives:
                opened += 1
                windows.append([row, score, 0])
                for n in zeros if score == 0 else ():
                    windows[-1][2] += 1
                    yield a, row, windows[-1][2], n, 0, 0
            continue
        if score == 0 and len(zeros) < negatives:
            zeros.append(row)
        for w in windows:
            if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield a, w[0], w[2], row, w[1], score
        if windows and windows[0][2] >= negatives:
            windows = [w for w in windows if w[2] < negatives]


def mine_hard_negatives(
    rows: DataFrame, vector: str = "embedding", label: Column | None = None, anchors: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` (of id) tells which rows are anchors (default: ids divisible by 100), ``label`` what a row's label is. For an
    anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is at least ``low`` and
    at most ``high`` hundredths of the positive's. Scores are inner products of floor(256 * x).
    """
    spark = rows.sparkSession
    part = sound_rows(rows, vector, F.col("label") if label is None else label)
    blocks = materialize(in_blocks(part, BLOCK_ROWS), "negatives-rows")
    chosen = part.filter(F.col("id") % 100 == 0 if anchors is None else anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    asked = materialize(in_blocks(chosen, ANCHOR_ROWS), "negatives-anchors")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(blocks.count(), SHARDS_A_PARTITION * n))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = near_positives(meetings(blocks, asked, shards), positives).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    best = materialize(best.select("anchor_id", "id", "score"), "negatives-positives")
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("score").alias("scores"))  # at most ``positives`` each
    opened = materialize(in_blocks(chosen.join(windows.hint("merge"), "id"), ANCHOR_ROWS), "negatives-windows")
    keys = near_negatives(meetings(blocks, opened, shards), negatives, low, high)
    opening = map_arrow(best, lambda batches: ({"key": [packed(*k) for k in zip(*(b[c].to_pylist() for c in ("anchor_id", "score", "id")))], "positive": [True] * len(b["id"])} for b in batches), keys.schema)
    # a negative that lies in several windows leaves its task once, so that no key comes twice from one block
    ordered = keys.union(opening).rdd.map(lambda r: (bytes(r[0]), r[1])).repartitionAndSortWithinPartitions(n, place_of)
    found = ordered.mapPartitions(lambda it: mine(it, positives, negatives, low, high))
    out = materialize(spark.createDataFrame(found, RESULT), "negatives")
    discard(blocks, asked, best, opened)
    return out

