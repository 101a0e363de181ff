"""The whole vocabulary as contexts, against counting pairs of words one by one; repeated, null and long texts."""

from collections import Counter

import numpy as np
import pytest
from netaccess.llm import pitman_yor

from .conftest import invented
from .test_brute_force import held, lowered


def test_pairs_of_texts():
    codes, lengths = np.array([5, 7, pitman_yor.END, pitman_yor.END, 9, pitman_yor.END], np.int32), np.array([3, 1, 2])
    e = pitman_yor.END
    assert [(int(x >> 32), int(x & 0xFFFFFFFF)) for x in pitman_yor.pairs_of(codes, lengths)] == [(e, 5), (5, 7), (7, e), (e, e), (e, 9), (9, e)]


@pytest.mark.parametrize(("slices", "parts"), [(1, 1_000), (4, 20)])
def test_tables_cover_all_pairs(spark, monkeypatch, slices, parts):
    """Every training pair is seated once: pairs met once and twice are counted over the whole vocabulary."""
    monkeypatch.setattr(pitman_yor, "SLICES", slices)
    monkeypatch.setattr(pitman_yor, "HOT_PARTS", parts)
    rows = [(i, invented(i % 25, 60)) for i in range(90)] + [(200, None), (201, ""), (202, invented(7, 30_000, 60))]
    told = {}
    fit = pitman_yor.by_symbol

    def noted(found, column):
        got = fit(found, column)
        told.update({k: told.get(k, 0) + v for k, v in got[1].items()})
        return got

    monkeypatch.setattr(pitman_yor, "by_symbol", noted)
    got = pitman_yor.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = Counter(p for i, t in rows if not held(i, 7) for p in zip(["", *lowered(t)], [*lowered(t), ""]))
    assert (told[-1], told[-2]) == (sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    assert len(got) == len(rows) and all(r["score"] < 0 and np.isfinite(r["score"]) and r["perplexity"] > 1 for r in got)


def test_repeats_are_told_apart(spark):
    """A training text that occurs twice is likelier than one of its kind that occurs once; equal rows score alike."""
    texts = {i: invented(i, 80) for i in range(60)}
    rows = [*texts.items(), *((1000 + 7 * i, texts[i]) for i in range(0, 60, 3)), (5, texts[5]), (5, texts[5])]
    got = pitman_yor.score_corpus(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    twice = {t for i, t in rows if i >= 1000 and not held(i, 7)}
    mean = lambda some: np.mean([r["score"] / r["n_tokens"] for r in got if r["doc_id"] in some and r["doc_id"] != 5])
    assert mean({i for i, t in texts.items() if t in twice and not held(i, 7)}) > mean({i for i, t in texts.items() if t not in twice and not held(i, 7)}) + 0.05
