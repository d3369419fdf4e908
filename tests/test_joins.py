"""Lookups by broadcast and with heavy keys apart give what a plain join gives."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(("few", "heavy"), [(1000, 10), (0, 10), (0, 2)])
def test_lookup(spark, monkeypatch, few, heavy):
    from driftlens.operators import joins

    monkeypatch.setattr(joins, "FEW", few)
    monkeypatch.setattr(joins, "HEAVY", heavy)
    rows = [(i, (None if i % 17 == 0 else 1 if i % 3 else i % 40), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, other string")
    counts = df.where("k IS NOT NULL AND k <> 5").groupBy("k").agg(F.count("*").alias("_n")).withColumn("found", F.col("k") * 2)
    got = joins.lookup(df, counts, ["k"])
    assert got.columns == ["id", "k", "other", "found"]
    assert sorted(map(tuple, got.collect())) == [(i, k, o, None if k is None or k == 5 else 2 * k) for i, k, o in rows]
