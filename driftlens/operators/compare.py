"""Baselines against a target: counts, findings and values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.config import MIN_EXPECTED, MIN_REPEATS, TRACKED_SOURCES, TRACKED_VALUES
from driftlens.functions.masks import is_placeholder, is_wildcard
from driftlens.functions.scoring import count_g_test, score_template, total
from driftlens.operators.joins import lookup
from driftlens.operators.lineage import durable
from driftlens.operators.mining import Mined
from driftlens.operators.ranking import ranked

#: Values and positions that a task holds at most before it passes them on.
HELD = 300_000


def run_totals(mined: Mined, runs: int) -> list[int]:
    """Lines of each run; one number a run comes to the driver."""
    got = {r["run_idx"]: r["n"] for r in mined.groups.groupBy("run_idx").agg(F.sum("n").alias("n")).collect()}
    return [got.get(i, 0) for i in range(runs)]


def counted(mined: Mined, n: int) -> DataFrame:
    """A row for each template: c0.. (baselines), tc (target), and its first and last lines.

    One aggregation with partial sums; run ``n`` is the target.
    """
    at = F.struct("line_no", "raw")
    target, base, key = F.col("run_idx") == n, F.col("run_idx") == 0, ["first_run", "first_line"]
    per = mined.groups.groupBy(*key).agg(
        *[F.coalesce(F.sum(F.when(F.col("run_idx") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(n)],
        F.coalesce(F.sum(F.when(target, F.col("n"))), F.lit(0)).alias("tc"),
        F.min(F.when(target, at)).alias("first_target"),
        F.min(F.when(base, at)).alias("first_base"),
        F.max(F.when(base, F.col("last_line"))).alias("last_base"),
        F.min(F.when(F.col("run_idx") < n, F.struct("run_idx", "line_no", "raw"))).alias("first_any"),
        F.count("*").alias("groups"),
    )
    named = mined.clusters.select("cid", "template", "template_tokens", "first_run", F.col("first_line_no").alias("first_line"))
    return named.join(per, key)


def findings(counts: DataFrame, totals: list[int], n: int, significance: float) -> DataFrame:
    """NEW, GONE and CHANGED templates."""
    cs = [F.col(f"c{i}") for i in range(n)]
    b_sum, b_total, t_total = total(cs), sum(totals[:n]), totals[n]
    if n == 0:
        kind = F.when(F.col("tc") > 0, "new")
        score = score_template([], [], F.col("tc"), t_total)
        direction = F.lit("up")
    else:
        score = score_template(cs, totals[:n], F.col("tc"), t_total)
        share = (F.col("tc") / t_total if t_total else F.lit(0.0)) - (b_sum / b_total if b_total else F.lit(0.0))
        by_share = F.when(share > 0, "up").when(share < 0, "down").otherwise("flat")
        by_count = F.when(F.col("tc") * n > b_sum, "up").when(F.col("tc") * n < b_sum, "down").otherwise("flat")
        changed = (score >= significance) & (count_g_test(cs, F.col("tc")) >= significance) & (by_share == by_count)
        everywhere = F.lit(True)
        for c in cs:
            everywhere = everywhere & (c > 0)
        kind = F.when((F.col("tc") > 0) & (b_sum == 0), "new").when((F.col("tc") == 0) & everywhere, "gone").when(changed, "changed")
        direction = F.when(kind == "new", "up").when(kind == "gone", "down").otherwise(by_share)
    out = counts.select(
        "cid", kind.alias("kind"), direction.alias("direction"), "template", score.alias("score"),
        (F.array(*cs) if cs else F.array().cast("array<bigint>")).alias("baseline_counts"), F.col("tc").alias("target_count"),
        F.col("first_target.line_no").alias("first_target_line_no"), F.col("first_target.raw").alias("first_target_raw"),
        F.when(kind == "gone", F.col("first_base.line_no")).alias("first_baseline_line_no"), F.when(kind == "gone", F.col("first_base.raw")).alias("first_baseline_raw"),
        "last_base", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("value"),
    )
    return out.where("kind IS NOT NULL")


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "new", 0).when(kind == "gone", 1).otherwise(2)


def _identifier(c: Column) -> Column:
    return c.rlike("[0-9]|::|/|\\.")


def _source(c: Column) -> Column:
    return (F.octet_length(c) <= 64) & c.rlike("[A-Za-z]") & c.rlike("[0-9]") & ~c.rlike("/|::|<")


def tracked(mined: Mined, counts: DataFrame, n: int) -> DataFrame:
    """(source, run_idx, cid, pos, value, n, first) of the tokens at the wildcards of templates on both sides.

    Positions are cut down to those wildcards before tokens are spread.  A position with more
    than ``TRACKED_VALUES`` values (sources: ``TRACKED_SOURCES``) in a run is ruled out
    whatever else it has, so a task keeps that many and then only a mark, a row without a
    value: what is shuffled is bounded by positions, not by values.
    """
    both = counts.where((F.col("tc") > 0) & (total([F.col(f"c{i}") for i in range(n)]) > 0))
    key = ["first_run", "first_line"]
    wild = both.select(*key, "cid", F.expr("filter(sequence(0, size(template_tokens) - 1), i -> size(template_tokens) > 0)").alias("all"), "template_tokens", F.col("groups").alias("_n"))
    wild = wild.select(*key, "cid", "_n", F.filter("all", lambda i: is_wildcard(F.get("template_tokens", i))).alias("at")).where(F.size("at") > 0)
    rows = lookup(mined.groups, durable(wild), key).where("cid IS NOT NULL")
    rows = rows.select("run_idx", "cid", "line_no", "raw", F.col("n").alias("lines"), F.explode(F.transform("at", lambda i: F.struct(i.alias("pos"), F.get("tokens", i).alias("value")))).alias("x"))
    v = F.col("x.value")
    rows = rows.where(~is_placeholder(v) & (~_identifier(v) | _source(v)))
    rows = rows.select(_identifier(v).alias("source"), "run_idx", "cid", F.col("x.pos").alias("pos"), v.alias("value"), F.col("lines").cast("long").alias("n"), "line_no", "raw")
    return rows.mapInArrow(_capped, _CAPPED).groupBy("source", "run_idx", "cid", "pos", "value").agg(F.sum("n").alias("n"), F.min(F.struct("line_no", "raw")).alias("first"))


_CAPPED = "source boolean, run_idx int, cid long, pos int, value string, n long, line_no long, raw string"


def _capped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each position of a run, summed up; one row without a value where they are too many."""
    held: dict[tuple, dict | None] = {}
    size = 0

    def out():
        rows = [(*key, v, *x) for key, own in held.items() for v, x in (own.items() if own is not None else [(None, (0, None, None))])]
        kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in _CAPPED.split(", ")])

    for b in batches:
        for source, run, cid, pos, value, n, line, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = source, run, cid, pos
            own = held.setdefault(key, {})
            if own is None:
                continue
            x = own.get(value)
            if x is None:
                if len(own) >= (TRACKED_SOURCES if source else TRACKED_VALUES):
                    held[key] = None
                    size -= len(own)
                    continue
                own[value] = [n, line, raw]
                size += 1
            else:
                x[0] += n
                if line < x[1]:
                    x[1:] = line, raw
        if size + len(held) > HELD:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


def _distinct(cap: int) -> Column:
    """Values of a position in a run; more than ``cap`` where a task has met more."""
    return F.count("value") + F.when(F.bool_or(F.col("value").isNull()), cap + 1).otherwise(0)


def new_values(values: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Positions where the target has a value that no baseline has had."""
    v = values.where(~F.col("source"))
    key = ["cid", "pos"]
    runs = v.groupBy("run_idx", *key).agg(_distinct(TRACKED_VALUES).alias("distinct"))
    over = runs.where(F.col("distinct") > TRACKED_VALUES).select(*key).distinct()
    v = v.join(over, key, "left_anti")
    per = v.groupBy(*key, "value").agg(
        F.coalesce(F.sum(F.when(F.col("run_idx") < n, F.col("n"))), F.lit(0)).alias("b"),
        F.coalesce(F.sum(F.when(F.col("run_idx") == n, F.col("n"))), F.lit(0)).alias("t"),
        F.min(F.when(F.col("run_idx") == n, F.col("first"))).alias("first"),
    )
    fresh = (F.col("b") == 0) & (F.col("t") > 0)
    out = per.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("b") > 0, F.col("value")))).alias("baseline_values"), F.sum("b").alias("b"),
        F.min(F.when(fresh, F.struct((-F.col("t")).alias("rank"), "value", "first"))).alias("best"),
    )  # at most a few values a run are left at a position
    out = out.withColumn("established", F.col("b") / F.size("baseline_values"))
    out = out.where((F.size("baseline_values").between(1, TRACKED_VALUES)) & (F.col("established") >= MIN_REPEATS) & F.col("best").isNotNull())
    words = F.expr("aggregate(slice(template_tokens, 1, pos), 0, (a, t) -> a + size(split(t, ' ')))")
    return out.join(counts.select("cid", "template", "template_tokens"), "cid").select(
        "template", words.alias("position"), F.col("best.value").alias("new_value"), "baseline_values",
        F.col("best.first.line_no").alias("first_target_line_no"), F.col("best.first.raw").alias("first_target_raw"), "established",
    )


def gone_values(values: DataFrame, counts: DataFrame, totals: list[int], n: int) -> DataFrame:
    """Sources that every baseline has heard from at a position and the target has not."""
    v = values.where("source")
    key = ["cid", "pos"]
    runs = v.groupBy("run_idx", *key).agg(_distinct(TRACKED_SOURCES).alias("distinct"), F.sum("n").alias("lines"))
    base, target = F.col("run_idx") < n, F.col("run_idx") == n
    fit = F.col("distinct") <= TRACKED_SOURCES
    usable = runs.groupBy(*key).agg(
        F.count_if(base & fit).alias("ok"), F.max(F.when(target & fit, F.col("lines"))).alias("target_lines"),
        *[F.max(F.when(F.col("run_idx") == i, F.col("lines"))).alias(f"l{i}") for i in range(n)],
    ).where((F.col("ok") == n) & F.col("target_lines").isNotNull())
    per = v.join(usable, key).groupBy(*key, "value").agg(
        *[F.coalesce(F.sum(F.when(F.col("run_idx") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(n)],
        F.coalesce(F.sum(F.when(target, F.col("n"))), F.lit(0)).alias("t"), F.min(F.when(F.col("run_idx") == 0, F.col("first"))).alias("first"),
        F.first("target_lines").alias("target_lines"), *[F.first(f"l{i}").alias(f"l{i}") for i in range(n)],
    )
    strange = per.where((F.col("t") > 0) & (F.col("c0") == 0)).select(*key).distinct()
    cs = [F.col(f"c{i}") for i in range(n)]
    shares = [F.col(f"c{i}") / F.col(f"l{i}") for i in range(n)]
    smallest = shares[0] if n == 1 else F.least(*shares)
    out = per.join(strange, key, "left_anti").where((F.col("c0") > 0) & (F.col("t") == 0) & (smallest * F.col("target_lines") >= MIN_EXPECTED))
    shown = F.expr("array_join(transform(template_tokens, (t, i) -> IF(i = pos, value, t)), ' ')")
    return out.join(counts.select("cid", "template_tokens"), "cid").select(
        "cid", F.lit("gone").alias("kind"), F.lit("down").alias("direction"), shown.alias("template"), score_template(cs, totals[:n], F.lit(0), totals[n]).alias("score"),
        F.array(*cs).alias("baseline_counts"), F.lit(0).cast("long").alias("target_count"), F.lit(None).cast("long").alias("first_target_line_no"), F.lit(None).cast("string").alias("first_target_raw"),
        F.col("first.line_no").alias("first_baseline_line_no"), F.col("first.raw").alias("first_baseline_raw"), F.lit(None).cast("long").alias("last_base"), F.col("pos").cast("int").alias("pos"), "value",
    )


def ordered(all_findings: DataFrame) -> DataFrame:
    """Findings with their index: kind, then score, then template; missing values after the templates of their kind."""
    order = [kind_rank(F.col("kind")), F.desc("score"), F.col("pos").isNotNull(), F.col("cid"), F.col("pos"), F.col("value")]
    return ranked(all_findings, order, "index").withColumn("index", F.col("index").cast("int"))
