"""Scores of a template's counts as Column functions; sums keep one order, so results are the same everywhere."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.config import SMOOTHING


def _double(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def total(columns: list[Column]) -> Column:
    return reduce(add, columns) if columns else F.lit(0)


def g_test(baseline, baseline_total, target, target_total) -> Column:
    """G of the 2 x 2 table of lines of a template and others, each cell smoothed."""
    a, c = _double(baseline), _double(target)
    o11, o12 = a + SMOOTHING, F.greatest(_double(baseline_total) - a, F.lit(0.0)) + SMOOTHING
    o21, o22 = c + SMOOTHING, F.greatest(_double(target_total) - c, F.lit(0.0)) + SMOOTHING
    row1, row2, col1, col2 = o11 + o12, o21 + o22, o11 + o21, o12 + o22
    n = row1 + row2
    terms = [o * F.ln(o / (row * col / n)) for o, row, col in ((o11, row1, col1), (o12, row1, col2), (o21, row2, col1), (o22, row2, col2))]
    return 2.0 * total(terms)


def count_g_test(baselines: list[Column], target) -> Column:
    """G of the counts alone, were every run to hold as many."""
    runs = len(baselines)
    if not runs:
        return F.lit(0.0)
    b, t = _double(total(baselines)), _double(target)
    both = b + t

    def term(o, e):
        return F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)

    return F.when(both == 0, 0.0).otherwise(2.0 * (term(b, both * float(runs) / float(runs + 1)) + term(t, both / float(runs + 1))))


def flakiness_penalty(rates: list[Column]) -> Column:
    """1 and twice the coefficient of variation of the rates that aren't null; 1 of fewer than two."""
    if len(rates) < 2:
        return F.lit(1.0)
    n = _double(total([r.isNotNull().cast("int") for r in rates]))
    mean = total([F.coalesce(r, F.lit(0.0)) for r in rates]) / n
    var = total([F.coalesce((r - mean) * (r - mean), F.lit(0.0)) for r in rates]) / n
    return F.when((n < 2) | (mean <= 0), 1.0).otherwise(1.0 + 2.0 * (F.sqrt(var) / mean))


def score_template(counts: list[Column], totals: list, target, target_total) -> Column:
    totals = [t if isinstance(t, Column) else F.lit(t) for t in totals]
    rates = [F.when(t > 0, _double(c) / _double(t)) for c, t in zip(counts, totals, strict=True)]
    return g_test(total(counts), total(totals), target, target_total) / flakiness_penalty(rates)
