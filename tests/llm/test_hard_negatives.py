"""Hard negatives against a plain search: ties, scores of 0, nulls, repeats, clashing columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from netaccess.llm import hard_negatives
from netaccess.llm.hard_negatives import mine, mine_hard_negatives, packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, score long, id long"


def brute_force(rows, positives=5, negatives=10):
    sound = [(i, label, [int(256 * x // 1) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    anchors = {}
    for i, label, v in sound:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in sound if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(t, n) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in mine_hard_negatives(df, **options).collect())


def invented(seed, n, dims=3, labels=3):
    r = random.Random(seed)
    return [(i, [r.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(dims)], r.randrange(labels), 7, 7) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search_with_many_ties(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    rows = invented(seed, 350)
    rows += [(900 + k, [0.0] * 3, k % 3, 1, 1) for k in range(8)] + [(1000, [0.0] * 3, 1, 1, 1)]
    assert found(spark, rows) == brute_force(rows)


def test_awkward_rows(spark):
    rows = invented(9, 220)
    rows += [(300, None, 1, 1, 1), (400, [None, 0.5, 0.5], 1, 1, 1), (500, [float("nan"), 0.5, 0.5], 1, 1, 1), (501, [float("inf"), 0.5, 0.5], 1, 1, 1), (600, [0.5] * 3, None, 1, 1), (None, [0.5] * 3, 1, 1, 1)]
    rows += [(700, [0.5, 0.5], 1, 1, 1), (701, [0.5, 0.25], 1, 1, 1), (702, [0.25, 0.25], 2, 1, 1), (800, [], 1, 1, 1), (801, [], 1, 1, 1), (802, [], 2, 1, 1)]
    rows += [rows[5], rows[100], rows[150]]
    assert found(spark, rows) == brute_force(rows)


def test_zero_positives_take_the_first_zero_negatives_whatever_the_order():
    keys = [(packed(0, 0, i), i in (3, 9)) for i in range(1, 20)]
    got = [(p, n) for _, p, _, n, _, _ in mine(iter(keys), 5, 4, 30, 90)]
    assert sorted(got) == sorted([(p, n) for p in (3, 9) for n in (1, 2, 4, 5)])


def test_keys_sort_by_anchor_descending_score_and_id():
    keys = [(a, s, i) for a in (-5, 0, 7) for s in (-(2**62), -1, 0, 3) for i in (-1, 0, 8)]
    assert [unpacked(k) for k in sorted(packed(*k) for k in keys)] == sorted(keys, key=lambda k: (k[0], -k[1], k[2]))


def test_one_vector_held_by_a_third_of_all_rows(spark):
    rows = invented(4, 200) + [(2000 + k, [0.5, 0.5, 0.25], k % 2, 1, 1) for k in range(150)]
    assert found(spark, rows) == brute_force(rows)


def test_empty_table_and_own_anchors(spark):
    assert found(spark, []) == []
    rows = invented(5, 60)
    wanted = [r for r in brute_force([(r[0] * 100 if r[0] == 33 else r[0] + 10_000 * (r[0] == 0), *r[1:]) for r in rows])]
    renamed = [(3300 if r[0] == 33 else 10_000 if r[0] == 0 else r[0], *r[1:]) for r in rows]
    assert [r for r in found(spark, renamed, anchors=F.col("id") == 3300)] == [r for r in wanted if r[0] == 3300]


def test_copies_of_anchors_are_not_broadcast(spark, tmp_path):
    """A block of anchors is copied to every shard; the planner sees it before that and would send all copies through the driver."""
    part = hard_negatives.sound_rows(spark.createDataFrame(invented(3, 600), SCHEMA), "embedding", F.col("label"))
    for name, most in (("rows", 4), ("anchors", 2)):
        hard_negatives.in_blocks(part, most).write.parquet(str(tmp_path / name))
    met = hard_negatives.meetings(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "anchors")), 50)
    assert met.count() > 50
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
