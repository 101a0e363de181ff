"""Pairs made in a group of near lines, and the prefix of the shorter line, against comparing all pairs."""

import random

from netaccess.llm import line_dedup

from .test_line_dedup_whole import cleaned


def report(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return {r["doc_id"]: r["text"] or "" for r in line_dedup.dedup_lines(docs, least=line_dedup.EVERY_LINE, width=line_dedup.BY_WORD).collect()}


def test_pairs_grow_with_the_group(spark, monkeypatch):
    made = []

    def counted(df, tag, written=line_dedup.materialize, **options):
        out = written(df, tag, **options)
        if tag in ("line-pairs", "line-more"):
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    base = [f"w{k}" for k in range(40)]
    # the later the line, the earlier it stands in the table
    rows = [(i, " ".join([*base[: i % 40], f"new{i}", *base[i % 40 + 1 :]])) for i in range(120, 0, -1)]
    assert report(spark, rows) == {i: t if i == 1 else "" for i, t in rows}
    assert sum(made) <= 10 * len(rows)


def test_pairs_grow_with_the_group_behind_an_unlike_line(spark, monkeypatch):
    """The first line has all words of the group and so many others, more frequent ones, that it is near none of it."""
    made = []

    def counted(df, tag, written=line_dedup.materialize, **options):
        out = written(df, tag, **options)
        if tag in ("line-pairs", "line-more"):
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"new{i}", *base[i % 40 + 1 :]])) for i in range(240, 0, -1)]
    others = [f"other{k}" for k in range(14)]
    rows += [(0, " ".join([*base, *others]))] + [(1000 + i, " ".join([*others, *(f"own{i}x{k}" for k in range(6))])) for i in range(300)]
    assert report(spark, rows) == {i: "" if 1 < i < 1000 else t for i, t in rows}
    assert sum(made) <= 20 * len(rows)


def test_shorter_and_longer_lines(spark):
    """Pairs at the edge of the threshold whose shorter line is the earlier or the later one, and lines of one document."""
    r = random.Random(11)
    rows = []
    for g in range(40):
        words = [f"g{g}x{k}" for k in range(r.randrange(4, 26))]
        near = [words]
        for _ in range(3):
            w = list(r.choice(near))
            for _ in range(r.randrange(1, 4)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [w[at], f"common{r.randrange(5)}"], [f"odd{r.randrange(900)}"]])
            near.append(w or words)
        r.shuffle(near)
        rows += [(r.randrange(10**6) * 100 + g, "\n".join(" ".join(w) for w in part)) for part in (near[:2], near[2:3], near[3:])]
    r.shuffle(rows)
    assert report(spark, rows) == cleaned(rows, 1)
