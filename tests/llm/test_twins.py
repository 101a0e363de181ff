"""The SQL twins of text queries give the operators' rows, on awkward texts as well."""

import duckdb
import pyarrow as pa
import pytest

from netaccess.llm import jaccard_join, line_dedup, queries, twins

LONG = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    (5, None), (7, ""), (8, " \n\t\n"), (9, "One two"), (10, "one  TWO"), (11, LONG), (12, LONG + " tail"), (13, LONG.replace("word7 ", "other ")), (14, LONG.upper()),
    (15, "one two\none two\nthree"), (16, "a b c d e f g h i j\n\na b c d e f g h i k\nj i h g f e d c b a"), (-3, "Straße Äpfel\r\nStraße Äpfel"), (1 << 60, "x y z x y z x y z"),
]


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op9_line_dedup"])
def test_twin_gives_the_same_rows(spark, name):
    documents = pa.table({"doc_id": pa.array([i for i, _ in TEXTS], pa.int64()), "text": pa.array([t for _, t in TEXTS], pa.string())})  # noqa: F841 - the twin reads it by name
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, k=4, percent=85, with_links=True) if name.startswith("op6") else line_dedup.line_report(docs, least=line_dedup.EVERY_LINE, width=line_dedup.BY_WORD)
    want = duckdb.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).fetchall()))


def test_hard_negatives_twin(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got, want = queries.QUERIES["op11_hard_negatives"](spark, sf), duckdb.sql(queries.ORACLE_SQL["op11_hard_negatives"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.fetchall()))


def test_twins_name_registered_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and twins.LINE_DEDUP in queries.ORACLE_SQL.values()
