"""Blocks and context over all events; test_queries.py holds their rows to SQL."""

import os

import pytest

from driftlens.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_every_event_counts(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    new = events.where("event_type IN ('signup', 'error')").count()
    assert QUERIES["gone_chains"](spark, SF).count() == events.count()
    assert QUERIES["new_runs"](spark, SF).count() == new
    assert QUERIES["context_window"](spark, SF).count() == events.where("event_type = 'purchase' AND day(ts) > 20").count()
    for q in ("new_runs", "new_blocks", "gone_chains", "context_window"):
        assert ORACLES[q] != ORACLES[f"{q}_all"] and QUERIES[q] is not QUERIES[f"{q}_all"] and "event_id % 20" not in ORACLES[q] and "% 25" not in ORACLES[q]


def test_chains_over_ranges(spark, monkeypatch):
    """Ranges of a few lines give the chains of one pass over all."""
    from driftlens.operators import blocks

    rows = [(i, first, covered) for i, (first, covered) in enumerate([(1, 30), (2, 2), (9, 9), (12, 12), (33, 35), (50, 50), (51, 90), (70, 70), (95, 95), (99, 99)])]
    df = spark.createDataFrame(rows, "cid long, first long, covered long")
    whole = sorted(map(tuple, blocks.gone_chains(df).collect()))
    monkeypatch.setattr(blocks, "SPAN", 8)
    assert sorted(map(tuple, blocks.gone_chains(df).collect())) == whole
    assert [r[3] for r in whole] == [1, 1, 1, 1, 1, 2, 2, 2, 3, 4]
