"""Numbers of links and lists too long for pairs, against comparing all pairs."""

import pytest
from netaccess.llm import jaccard_join

from .conftest import invented
from .test_brute_force import components, lowered


def shingles(t, k):
    w = lowered(t)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_links(sets, percent):
    return {i: sum(j != i and bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b) for j, b in sets.items()) for i, a in sets.items()}


def near_copies(n):
    base = invented(5, 120).split()
    for i in range(n):
        w = list(base)
        for j in range(i % 5):
            w[(7 * i + 23 * j) % 120] = f"new{i % 8}{j}"
        yield i, " ".join(w)


@pytest.mark.parametrize("chunk", [4, 128])
def test_number_of_links(spark, docs, texts, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows = [*((i, t) for i, t in {i: t for i, t in texts}.items()), *((3000 + i, t) for i, t in near_copies(40)), (None, texts[0][1])]
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, with_links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == brute_links(sets, 85)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == components(sets, 85)
    assert [(r["component_id"], r["n_links"]) for r in got if r["doc_id"] is None] == [(None, 0)]


def test_long_list_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 8)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    rows = [(i, f"all of the rights x{i % 40} y{i // 2} z") for i in range(120)] + [(500 + i, t) for i, t in near_copies(30)]
    sets = {i: shingles(t, 4) for i, t in rows}
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 50, with_links=True).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(sets, 50)
    assert {r["doc_id"]: r["n_links"] for r in got} == brute_links(sets, 50)


@pytest.mark.parametrize("size", [4, 16])
def test_parts_in_blocks(spark, monkeypatch, size):
    """The largest part of a hub meets the others only; every pair of different parts meets once."""
    monkeypatch.setattr(jaccard_join, "CHUNK", size)
    parts = [(1, i, 0 if i < 50 else i % 3 + 1) for i in range(60)] + [(2, i, i % 2) for i in range(20)]
    rows = spark.createDataFrame([(h, i, p, 1) for h, i, p in parts], "hub long, doc_id long, part long, copies long")
    blocks = {}
    for r in jaccard_join.dealt_by_part(rows).collect():
        blocks.setdefault((r["hub"], r["i"], r["j"]), []).append(r)
    met = {(h, *sorted((a["doc_id"], b["doc_id"]))) for (h, _, _), x in blocks.items() for a in x for b in x if a["role"] & jaccard_join.QUERY and b["role"] & jaccard_join.ENTRY}
    part = {(h, i): p for h, i, p in parts}
    assert {(h, i, j) for h, i in part for g, j in part if g == h and i < j and part[h, i] != part[h, j]} <= met
    assert sum(len(x) for (h, _, _), x in blocks.items() if h == 1) <= 50 * -(-10 // size) + 10 * (-(-50 // size) + -(-10 // size))


def test_texts_come_in_small_batches(spark, monkeypatch):
    """No task takes a whole partition of texts at once, in any step that runs Python."""
    built = []

    def watched(df, fn, schema, mapped=jaccard_join.map_arrow):
        def run(batches):
            def checked():
                for batch in batches:
                    rows = len(batch["text"])
                    assert rows <= 1024, f"{rows} texts at once"
                    yield batch

            return fn(checked())

        built.append(schema)
        return mapped(df, run, schema)

    monkeypatch.setattr(jaccard_join, "map_arrow", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"one two three four five u{i // 2} v{i // 2}") for i in range(3000)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == {i: i // 2 * 2 for i in range(3000)}
    assert len(built) >= 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
