"""Ranks of values that differ when they are made again; places searched once however many rows lie at them."""

import random

from pyspark.sql import functions as F

from netaccess.operators import spatial
from netaccess.operators.ranking import grouped_value_ranks, value_ranks


def test_ranks_of_values_that_change_when_made_again(spark):
    """A mean of doubles may come out differently in its last digit; here every value does."""
    drawn = F.udf(lambda: random.random(), "double").asNondeterministic()
    df = spark.range(20).withColumn("d", drawn()).withColumn("g", F.col("id") % 2)
    assert sorted(r["avg_rank"] for r in value_ranks(df, "d").collect()) == [float(k) for k in range(1, 21)]
    assert sorted(r["avg_rank"] for r in grouped_value_ranks(df, ["g"], "d").collect()) == sorted([float(k) for k in range(1, 11)] * 2)


def test_nearest_meets_places_not_rows(spark, monkeypatch):
    """300 rows on 4 places against 500 rows on 5 places: no ring may meet more than 20 pairs."""
    left = spark.createDataFrame([(k, k % 4, 0, k % 2) for k in range(300)] + [(900, None, 0, 0)], "id long, x long, y long, g long")
    right = spark.createDataFrame([(k, k % 5 * 3, 1, k % 2) for k in range(500)], "rid long, x long, y long, g long")
    met, plain = [], spatial.within

    def counted(*args, **options):
        met.append(plain(*args, **options).count())
        return plain(*args, **options)

    monkeypatch.setattr(spatial, "within", counted)
    for by in (None, "g"):
        for limit, step in ((None, None), (2.0, 1.0), (20.0, 1.0)):
            got = sorted(tuple(r) for r in spatial.nearest(left, "id", right, "rid", "x", "y", limit, step, by).collect())
            want = []
            for k in range(300):
                near = [((k % 4 - r % 5 * 3) ** 2 + 1, r) for r in range(500) if by is None or r % 2 == k % 2]
                d2, r = min(near)
                if limit is None or d2 <= limit * limit:
                    want.append((k, r, float(d2)))
            assert got == want
    assert max(met) <= 40
