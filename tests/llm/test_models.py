"""Learned operators by held-out accuracy, extraction on made pages, and the pipeline as a whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netaccess.llm import html_consensus, pairwise_quality, toxicity

from .conftest import ITEM, invented


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        text, toxic, quality = invented(1000 + i, 60), i % 5 == 0, i % 4 != 1
        if toxic:
            w = text.split(" ")
            for word in r.sample(["zidiot", "vscum", "qmoron", "lowind", "lowende", "lowich"], 3):
                w.insert(r.randrange(len(w)), word)
            text = " ".join(w)
        if not quality:
            text = text.replace(" ", "%%% ")
        rows.append((i, text, "xx"))
        labels.append((i, int(quality), int(toxic)))
    rows += [(900, None, "xx"), (901, "", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity(labelled, no_docs):
    docs, labels = labelled
    scored = toxicity.score_toxicity(docs, labels).cache()
    assert scored.count() == docs.count() and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(scored, labels, "toxic") > 0.97
    assert {r["predicted"] for r in scored.filter("doc_id >= 900").collect()} == {0}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 900").count() == 2
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_label_model_shares_weight_of_repeating_voters(labelled):
    docs, labels = labelled
    mined, _, _ = toxicity.mine_evidence(toxicity.labelled_rows(docs, labels))
    keys = {k for k, _, _ in mined}
    assert {"zidiot", "vscum", "lowi*"} <= keys or {"zidiot", "lowe*"} <= keys


def test_pairwise_quality(labelled, no_docs):
    docs, labels = labelled
    scored = pairwise_quality.rank_quality(docs, labels).cache()
    assert scored.count() == docs.count() and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(scored, labels, "quality") > 0.97
    assert pairwise_quality.rank_quality(no_docs, labels).count() == 0
    assert {round(r["score"], 6) for r in pairwise_quality.rank_quality(docs, labels.limit(0)).collect()} == {0.7}


def page(body, k):
    return f"<html><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>{body}<div id='comments'><p>Reader comment number {k}, which is rather long</p></div><footer>&copy; x</footer></body></html>"


def test_html(spark):
    story = [invented(k, 50, 2).split("\n") for k in range(6)]
    rows = []
    for k, parts in enumerate(story):
        inner = "".join(f"<p>{p.replace('and', '&#97;nd')} <b>x</b>&amp;y<br>z</p>" for p in parts)
        rows.append((k, "https://a.example/x", page(f"<div class='wrap'><div class='post-body'><h2>T{k}</h2>{inner}<div class='ad'>buy</div><form>f</form></div><div class='sidebar'><p>side</p></div></div>", k)))
    rows += [(10, "https://a.example/y", page("<div class='wrap'><div class='post-body'><p>Tiny.</p></div><div class='teaser'><p>" + "long teaser text " * 20 + "</p></div></div>", 1))]
    rows += [(20, None, None), (21, "https://b.example", ""), (22, "https://b.example", "<p>cut off <b>here"), (23, "x", "a < b & c")]
    got = {r["page_id"]: r for r in html_consensus.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, parts in enumerate(story):
        assert got[k]["text"] == "\n".join([f"T{k}", *(f"{' '.join(p.split())} x&y z" for p in parts)])
    assert got[10]["text"] == "Tiny."  # the host's path wins over the page's own best
    assert (got[20]["text"], got[21]["text"], got[22]["text"]) == ("", "", "cut off here")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_consensus.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path, labelled):
    docs, labels = labelled
    copy = docs.filter("doc_id = 2").withColumn("doc_id", F.lit(500).cast("long"))
    leak = spark.createDataFrame([(501, invented(71, 60) + "\n" + ITEM, "xx")], docs.schema)
    docs.union(copy).union(leak).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r["doc_id"] for r in frame.collect()}
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    assert 501 not in kept and not (kept & toxic)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == kept
    assert frame.filter("doc_id = 500").first()["text"] == ""  # all lines of the copy repeat
