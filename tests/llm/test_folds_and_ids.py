"""Null ids, repeated rows, ties, long texts and clashing columns where scores are learned; folds against zlib."""

import zlib

import pytest

from netaccess.llm import pairwise_quality, pitman_yor, toxicity

from .conftest import invented

BAD = {"toxic": "zidiot vscum qmoron ", "quality": "%%% $$$ ### "}


@pytest.fixture(scope="module")
def rows():
    made = [(i, (BAD["toxic"] if i % 5 == 0 else "") + (BAD["quality"] * 20 if i % 4 == 1 else "") + invented(3000 + i, 50)) for i in range(240)]
    ends = [(None, made[5][1]), (None, None), (300, made[5][1]), (300, made[5][1]), (301, ""), (302, invented(9, 20_000, 60)), (303, BAD["toxic"] * 20_000)]
    return made + ends


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5, 1, True, [1], 3) for i, t in rows], "doc_id long, text string, score double, predicted int, held_out boolean, hits array<int>, toxic int")
    told = [(i, int(i % 5 == 0), int(i % 4 != 1)) for i in range(240)] + [(None, 1, 0)]
    return docs.cache(), spark.createDataFrame(told, "doc_id long, toxic int, quality int").cache()


@pytest.mark.parametrize("score", [toxicity.score_toxicity, pairwise_quality.rank_quality])
def test_one_row_each_with_its_fold(score, rows, tables):
    got = score(*tables).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)
    same = {r["score"] for r in got if r["doc_id"] in (5, 300)}
    assert len(same) == 1 and next(iter(same)) in {r["score"] for r in got if r["doc_id"] is None}


def test_labels_of_held_out_rows_do_not_matter(spark, tables):
    docs, labels = tables
    turned = spark.createDataFrame([(r["doc_id"], *((1 - r["toxic"], 1 - r["quality"]) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else (r["toxic"], r["quality"]))) for r in labels.collect()], labels.schema)
    for score in (toxicity.score_toxicity, pairwise_quality.rank_quality):
        one, two = ({r["doc_id"]: round(r["score"], 9) for r in score(docs, x).collect() if r["doc_id"] is not None} for x in (labels, turned))
        assert one == two


def test_long_toxic_text_is_toxic(tables):
    assert {r["predicted"] for r in toxicity.score_toxicity(*tables).filter("doc_id = 303").collect()} == {1}


def test_certain_texts_have_a_score(spark):
    got = pitman_yor.score_corpus(spark.createDataFrame([(1, ""), (2, None), (2, " "), (None, "")], "doc_id long, text string")).collect()
    assert [(r["score"], r["perplexity"]) for r in got] == [(0.0, 1.0)] * 4
    assert all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)
