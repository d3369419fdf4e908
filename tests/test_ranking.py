"""Places in a total order by ranges, and the last mark before a row."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import ranking


@pytest.mark.parametrize("few", [100_000, 0])
def test_places(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    r = random.Random(2)
    rows = [(r.choice(["b", "a", None]), r.choice([None, 1.0, 2.0, -5.0]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a string, b double, k long").repartition(9)
    order = [F.col("a"), F.desc("b"), F.col("k")]
    got = ranking.ranked(df, order, "at")
    assert got.columns == ["a", "b", "k", "at"]
    # nulls are least, so they come last where the greater come first
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1] is None, -(x[1] or 0), x[2]))
    assert [(x.a, x.b, x.k) for x in sorted(got.collect(), key=lambda x: x["at"])] == want
    assert sorted(x["at"] for x in got.collect()) == list(range(500))
    assert ranking.ranked(df.limit(0), order, "at").count() == 0


def test_no_task_gets_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    plan = ranking.by_ranges(df, [F.desc("k")], "at")
    assert "SinglePartition" not in plan._jdf.queryExecution().toString()
    assert plan.where("at <> 999 - k").count() == 0


@pytest.mark.parametrize("span", [4, 1 << 20])
def test_the_last_mark_before(spark, span):
    r = random.Random(span)
    marks = sorted(r.sample(range(5, 300), 20))
    rows = [(k, r.randrange(0, 320)) for k in range(200)] + [(900, marks[0]), (901, marks[0] - 1)]
    got = ranking.last_before(spark.createDataFrame(rows, "k long, at long"), "at", spark.createDataFrame([(f"m{b}", b) for b in marks], "name string, begin long"), "begin", span)
    assert got.columns == ["k", "at", "_mark"]
    for x in got.collect():
        i = bisect.bisect_right(marks, x["at"])
        assert (x["_mark"] and (x["_mark"]["begin"], x["_mark"]["name"])) == ((marks[i - 1], f"m{marks[i - 1]}") if i else None)
    assert got.count() == len(rows)
