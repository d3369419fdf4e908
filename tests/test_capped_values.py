"""Values of positions by capped sets against counting all of them."""

import random

import pytest

from driftlens.operators import compare as C
from driftlens.operators.mining import mine
from tests.test_engine import lines


def plain(rows, cap):
    """(cid, pos) of positions with more than ``cap`` values in a run, and the values of the others."""
    runs = {}
    for run, cid, pos, value, n in rows:
        own = runs.setdefault((run, cid, pos), {})
        own[value] = own.get(value, 0) + n
    return {k for k, v in runs.items() if len(v) > cap}, {k: v for k, v in runs.items() if len(v) <= cap}


@pytest.mark.parametrize("held", [300_000, 5])
def test_sets_are_capped_and_counts_whole(spark, monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    r = random.Random(held)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    verbs = ("took", "gave", "left", "came")
    runs = [[f"{verbs[k % 4]} user {r.choice(words[: (3, 10, 11, 48)[k % 4]])} with item svc{r.randrange((60, 64, 65, 90)[k % 4])} in time" for k in range(4000)] for _ in range(3)]
    mined = mine(lines(spark, *runs).repartition(7), 0.5)
    counts = C.counted(mined, 2)
    got = [tuple(x) for x in C.tracked(mined, counts, 2).select("source", "run_idx", "cid", "pos", "value", "n").collect()]
    assert len(got) == len({x[:5] for x in got})
    seen = [(x.run_idx, x.cid, x.tokens) for x in mined.assigned.collect()]
    shown = {c.cid: c.template_tokens for c in mined.clusters.collect()}
    for source, cap in ((False, 10), (True, 64)):
        rows = [(run, cid, p, t, 1) for run, cid, tokens in seen for p, t in enumerate(tokens) if shown[cid][p] == "<*>" and any(c.isdigit() for c in t) == source]
        over, fit = plain(rows, cap)
        assert over and fit
        marked = {x[1:4] for x in got if x[0] == source and x[4] is None}
        mine_ = {}
        for s, run, cid, pos, value, n in got:
            if s == source and value is not None:
                mine_.setdefault((run, cid, pos), {})[value] = n
        assert {k: v for k, v in mine_.items() if k in fit} == fit and not marked & set(fit)
        assert all(k in marked or len(mine_[k]) > cap for k in over)
        assert all(len(v) <= 8 * (cap + 1) for v in mine_.values())
