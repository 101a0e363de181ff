"""The label model of the quality rules: planted rates come back, and every verdict follows from them."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from netaccess.llm import quality_rules


def test_planted_rates_are_recovered():
    r = random.Random(3)
    share, planted = 0.7, {f"r{k}": ((0.2 + 0.05 * k, 0.6 - 0.05 * k, 0.2), (0.3, 0.05 + 0.02 * k, 0.65 - 0.02 * k)) for k in range(6)}
    counts = Counter()
    for _ in range(20_000):
        good = int(r.random() < share)
        counts[tuple(r.choices((0, 1, 2), planted[k][good])[0] for k in planted)] += 1
    got_share, rates, weights = quality_rules.fit_votes(sorted((*p, n) for p, n in counts.items()), list(planted))
    assert min(weights.values()) > 0.95
    assert got_share == pytest.approx(share, abs=0.05)
    for k, classes in planted.items():
        for want, got in zip(classes, rates[k]):
            assert got == pytest.approx(want, abs=0.05)


def test_posterior_by_hand(spark):
    rates = {"a": ((0.2, 0.7, 0.1), (0.3, 0.1, 0.6)), "b": ((0.5, 0.4, 0.1), (0.1, 0.2, 0.7))}
    rows = [(x, y) for x in range(3) for y in range(3)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", quality_rules.posterior(0.6, rates, {"a": 1.0, "b": 0.5}).alias("p")).collect()
    for row in got:
        g, b = (w * rates["a"][k][row["a"]] * rates["b"][k][row["b"]] ** 0.5 for k, w in ((1, 0.6), (0, 0.4)))
        assert row["p"] == pytest.approx(g / (g + b)) and math.isfinite(row["p"])


def test_repeats_nulls_and_names(spark):
    text = " ".join(f"word{k % 60}x{k}" for k in range(80)) + "."
    rows = [(1, text, 5), (1, text, 5), (None, text, 5), (2, None, 5), (3, "", 5), (4, "$$$ ### " * 60, 5), (5, text * 200, 5)]
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(got) == 7 and len({(r["n_words"], r["p_good"]) for r in got if r["doc_id"] in (1, None)}) == 1
    assert {r["doc_id"] for r in got if r["base_failed"]} >= {2, 3, 4}


def test_rules_that_repeat_each_other_share_their_weight():
    r, counts = random.Random(5), Counter()
    for _ in range(20_000):
        good = r.random() < 0.8
        votes = [r.choices((1, 2), (0.05, 0.95) if good else (0.8, 0.2))[0] for _ in range(3)]
        twin = r.choices((1, 2), (0.2, 0.8))[0]
        counts[(*votes, twin, twin, good)] += 1
    table = np.array([(*p, n) for p, n in counts.items()], float)
    weights = quality_rules.shared_weights(table[:, :5].astype(int), table[:, 6], table[:, 5])
    assert weights[:3].min() > 0.95 and weights[3:].max() < 0.55


def test_without_bad_documents_all_stay(spark):
    rows = [(k, " ".join(f"word{(k * 7 + j) % 90}x{j}" for j in range(80 + k % 9)) + ".") for k in range(60)]
    assert all(r["kept"] for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_labelled_bad_documents_go_and_good_ones_stay(spark, sf):
    """Labels judge the verdicts here; the operator never sees them."""
    folder = f"/root/testdata/{sf}"
    got = quality_rules.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).filter("NOT base_failed")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").agg({"*": "count", "p_good": "avg"}).collect()
    n = {r["quality"]: r["count(1)"] for r in rows}
    kept = {r["quality"]: r["count"] for r in got.filter("kept").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").count().collect()}
    assert kept.get(0, 0) <= 0.1 * n[0] and kept[1] >= 0.98 * n[1]
