"""One small corpus with the awkward rows: nulls, empty and long texts, copies, repeated rows and extra columns."""

import random

import pytest

SYLLABLES = "an er the in on ti st re ed nd ou ha es or at it".split()


def invented(seed: int, words: int, lines: int = 3) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words)]
    cut = max(1, words // lines)
    return "\n".join(" ".join(out[k : k + cut]).capitalize() + "." for k in range(0, words, cut))


ITEM = "Thand er onesen erblest it hein ti inenan eranenes whou therouou thon the. Than heoron eratsh therin blees sh in esheon erstlyat of an eronthwh."


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    base = {k: invented(k, 60 + 7 * (k % 9)) for k in range(60)}
    rows = [(k, t) for k, t in base.items()]
    rows += [(100, base[1]), (101, base[1].upper()), (102, base[2].replace(" ", " x ", 1)), (103, base[3] + "\n" + base[4].split("\n")[0])]
    rows += [(110, None), (111, ""), (112, " \t\n"), (113, "one two"), (114, "one  two"), (115, base[5] + "\n" + ITEM + "\n" + base[6])]
    rows += [(120, invented(999, 9000, 40)), (121, "x" * 30_000), (122, "%%% $$$ " * 200), (123, "a b c " * 100), (124, "idiot " + base[7] + " scum")]
    rows += [(130, base[8]), (130, base[8])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    schema = "doc_id long, text string, lang string, words int, token string, n_chars long"
    return spark.createDataFrame([(i, t, None, 7, "clash", len(t or "")) for i, t in texts], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short"), (5, invented(77, 40))], "item_id long, text string")
