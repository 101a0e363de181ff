"""Repeated q-grams: the same windows as one by one, in bounded memory and time; short items of few words."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from netaccess.llm import decontaminate
from netaccess.llm.decontaminate import WindowIndex, drop_leaks, find_leaks, shared_by_diagonal

from .conftest import invented


def test_counts_by_diagonal_equal_counting_pairs(monkeypatch):
    r = np.random.default_rng(1)
    for n, m, letters in ((50, 20, 3), (7, 30, 2), (400, 300, 1), (5_000, 4_000, 2)):
        text, item = r.integers(0, letters, n).astype(np.uint64), r.integers(0, letters, m).astype(np.uint64)
        got = shared_by_diagonal(text, item)
        for d in [*range(-m + 1, n, max(1, (n + m) // 60))]:
            a, b = max(0, -d), min(m, n - d)
            assert got[d + m - 1] == int((text[a + d : b + d] == item[a:b]).sum())


@pytest.mark.parametrize("seed", range(12))
def test_dense_search_finds_the_same_windows(seed, monkeypatch):
    r = random.Random(seed)
    unit = "".join(r.choice("abcdef") for _ in range(r.choice([1, 2, 3, 7, 40])))
    item = list((unit * 400)[:300]) if seed % 3 else list(invented(seed, 60, 1))
    for _ in range(r.randint(0, 8)):
        item[r.randrange(len(item))] = "z"
    body = list((unit * 600)[:700]) if seed % 2 else list(invented(seed + 1, 50, 1) + " " + "".join(item) + " " + invented(seed + 2, 50, 1))
    for _ in range(r.randint(0, 6)):
        body[r.randrange(len(body))] = "y"
    items, text = [(1, "".join(item)), (2, invented(99, 40, 1)), (3, (unit * 300)[:150])], "".join(body)
    plain = WindowIndex(items).matches(text)
    for most in (0, 50, 3_000):
        monkeypatch.setattr(decontaminate, "MOST_PAIRS", most)
        assert {i: n for i, (n, _) in WindowIndex(items).matches(text).items()} == {i: n for i, (n, _) in plain.items()}


@pytest.mark.parametrize("unit", ["a", "ab", "_ ", "0 1 "])
def test_long_runs_take_little_memory_and_time(unit):
    index = WindowIndex([(1, (unit * 10_000)[:10_000])])
    tracemalloc.start()
    began = time.time()
    found = index.matches((unit * 100_000)[:100_000])
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[1][1] == 0 and found[1][0] >= 9_000
    assert took < 10 and peak < 1_000_000_000


def test_a_word_or_two_are_no_leak(spark):
    docs = spark.createDataFrame([(k, f"{invented(k, 60, 2)} yes, the end of the day.", "x") for k in range(20)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, "the"), (2, "Yes"), (3, "No."), (4, "the end"), (5, None), (6, "end of the DAY")], "item_id long, text string")
    assert {(r["item_id"], r["n_windows"]) for r in find_leaks(docs, items).collect()} == {(6, 1)}
    assert drop_leaks(docs, items.filter("item_id < 6")).count() == 20
