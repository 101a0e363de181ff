"""Line dedup as the query and the pipeline run it: every line with a word, compared by words."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from netaccess.llm import line_dedup, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHORT = [(1, "All rights reserved.\nOne\n\na b c d"), (2, "All  rights reserved.\none\n\nd c b a"), (3, "One\na b c d e"), (4, "a b c d\n \nall rights reserved.")]


@pytest.fixture(scope="module")
def rows(texts):
    """The small corpus, short lines and near copies: one or two words of 12 to 15 changed, added or lost; some only near each other."""
    r = random.Random(4)
    near = []
    for i in range(30):
        base = [f"w{i % 6}x{k}" for k in range(12 + i % 6)]
        for _ in range(i % 4):
            at = r.randrange(len(base))
            base[at : at + 1] = r.choice([["new" + str(r.randrange(9))], [], [base[at], "more"]])
        near.append((2000 + i, " ".join(base)))
    return texts + [(1000 + i, t) for i, t in SHORT] + near


def tokens(w, width):
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def cleaned(rows, width):
    """doc_id -> text without the lines that an earlier line matches, by comparing all pairs."""
    lines = [(i, k, WORDS.findall(x)) for i, t in sorted({(i, t) for i, t in rows if t}) for k, x in enumerate(t.split("\n"))]
    lines = [(i, k, tokens(w, width)) for i, k, w in lines if w]
    gone = {(i, k) for n, (i, k, s) in enumerate(lines) if any(100 * len(s & t) >= 80 * len(s | t) for _, _, t in lines[:n])}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in rows}


def hashes(clean):
    return {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}


def test_short_lines_by_shingles(spark, rows):
    clean = cleaned(rows, 5)
    assert clean[1002] == "one\n\nd c b a" and clean[1004] == " \nall rights reserved."
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string"), least=line_dedup.EVERY_LINE).collect()
    assert {r["doc_id"]: r["text_sha256"] for r in got} == hashes(clean)


def test_query_and_stage_compare_words(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean = cleaned(rows, 1)
    assert clean != cleaned(rows, 5) and clean[1002] == "one\n" and clean[1003] == ""
    got = {r["doc_id"]: r["text_sha256"] for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == hashes(clean)
    staged = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] or "" for r in staged} == clean


def test_ids_repeats_and_names(spark):
    """Repeated and extreme ids, rows alike in id and text, rows without id, and columns named like the helpers."""
    one = " ".join(f"w{k}" for k in range(30))
    near = one.replace("w7", "zz")
    rows = [(-(2**63), one), (2**63 - 1, near), (5, "own line here\n" + near), (5, "another text altogether"), (5, "another text altogether"), (2**45, "short line\nshort line"), (None, "first of all"), (7, "first of all")]
    docs = spark.createDataFrame([(i, t, 1, "x", 9) for i, t in rows], "doc_id long, text string, removed int, clean string, line int")
    out = line_dedup.dedup_lines(docs, least=line_dedup.EVERY_LINE, width=line_dedup.BY_WORD)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["removed"], r["clean"]) for r in out.collect()), key=str)
    want = [(-(2**63), one), (2**63 - 1, ""), (5, "own line here"), (5, "another text altogether"), (5, "another text altogether"), (2**45, "short line"), (None, "first of all"), (7, "")]
    assert got == sorted(((i, t, 1, "x") for i, t in want), key=str)


def test_words_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id long, text string")
    plan = line_dedup.line_report(docs, least=line_dedup.EVERY_LINE, width=line_dedup.BY_WORD)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
