"""A whole comparison: baselines against a target."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.config import MIN_TEMPLATES, DiffOptions
from driftlens.operators import blocks as B
from driftlens.operators import compare as C
from driftlens.operators import fields as W
from driftlens.operators.joins import lookup
from driftlens.operators.lineage import durable
from driftlens.operators.mining import Mined, mine
from driftlens.operators.ranking import last_before
from driftlens.sources.lines import runs

FINDING = "cid long, kind string, direction string, template string, score double, baseline_counts array<bigint>, target_count long, first_target_line_no long, first_target_raw string, first_baseline_line_no long, first_baseline_raw string, last_base long, pos int, value string, index int, block int"
BLOCK = "block int, kind string, first_line_no long, last_line_no long, line_count long, lines_elsewhere long, score double, findings array<int>"
VALUE = "template string, position int, new_value string, baseline_values array<string>, first_target_line_no long, first_target_raw string, established double, block int"


@dataclass
class Watch:
    """What a watched field has shown."""

    pointer: str
    group_by: tuple[str, ...]
    coverage: DataFrame
    complete: DataFrame
    values: DataFrame
    rate_groups: DataFrame | None = None
    rate_changes: DataFrame | None = None

    def finding_values(self) -> DataFrame:
        """Values that are new or whose rate has changed."""
        return W.finding_values(self.values, self.rate_changes)

    def is_complete(self) -> bool:
        row = self.complete.first()
        return row is not None and bool(row["complete"])


@dataclass
class Diff:
    """A comparison's results; the tables hold a row a finding, block or value, not a line."""

    baseline_totals: list[int]
    target_total: int
    total_templates: int
    findings: DataFrame
    blocks: DataFrame
    value_findings: DataFrame
    watches: list[Watch] = field(default_factory=list)
    context: DataFrame | None = None
    mined: Mined | None = None

    def report_count(self) -> int:
        """Items of a report: blocks, findings and values outside of them, and those of watched fields."""
        return self.blocks.count() + self.findings.where("block IS NULL").count() + self.value_findings.where("block IS NULL").count() + self.field_finding_count()

    def finding_count(self) -> int:
        """Findings before they are put into blocks: templates that differ, new values, and those of watched fields."""
        return self.findings.count() + self.value_findings.count() + self.field_finding_count()

    def field_finding_count(self) -> int:
        """New values, and groups with a changed rate."""
        n = 0
        for w in self.watches:
            n += w.values.where("is_new").count()
            if w.rate_changes is not None:
                n += w.rate_changes.select("group_json").distinct().count()
        return n

    def complete(self) -> bool:
        """Whether every watch saw all that it had to."""
        for w in self.watches:
            if not w.is_complete():
                return False
            if w.rate_groups is not None and w.rate_groups.where("status <> 'compared'").count():
                return False
        return True

    def exit_code(self) -> int:
        """0 without findings, 1 with some, 2 where a watch is incomplete."""
        return 2 if not self.complete() else int(self.finding_count() > 0)


def diff(lines: DataFrame, n: int, options: DiffOptions = DiffOptions()) -> Diff:
    """Compare run ``n`` of ``lines`` (run_idx, line_no, raw) with runs 0 to n - 1."""
    spark: SparkSession = lines.sparkSession
    if options.watch_fields or options.context:
        lines = durable(lines.select("run_idx", "line_no", "raw"))  # read again below
    mined = mine(lines, options.threshold, options.masks)
    totals = C.run_totals(mined, n + 1)
    counts = durable(C.counted(mined, n))
    found = C.findings(counts, totals, n, options.significance)
    values = spark.createDataFrame([], VALUE)
    if n:
        tracked = durable(C.tracked(mined, counts, n))
        if not tracked.isEmpty():
            found = found.unionByName(C.gone_values(tracked, counts, totals, n))
            values = C.new_values(tracked, counts, n)
    found = C.ordered(found)
    made = spark.createDataFrame([], BLOCK)
    several = {r["kind"] for r in found.where("pos IS NULL").groupBy("kind").count().collect() if r["count"] >= MIN_TEMPLATES} & {"new", "gone"} if options.group else set()
    if several:
        new = gone = None
        if "new" in several:
            fresh = counts.where(F.lit(n == 0) | (F.col("first_any").isNull())).select("first_run", "first_line", "cid", F.col("groups").alias("_n"))
            new_lines = lookup(mined.groups.where(F.col("run_idx") == n), fresh, ["first_run", "first_line"]).where("cid IS NOT NULL")
            new_lines = new_lines.select("line_no", "cid", F.explode("offsets").alias("at")).select((F.col("line_no") + F.col("at")).alias("line_no"), "cid")
            new = B.new_blocks(durable(B.new_runs(new_lines)))
        if "gone" in several:
            gone = B.gone_blocks(durable(B.gone_chains(B.gone_extents(found))))
        made = B.assembled(found, new, gone)
    of = made.select("block", F.explode("findings").alias("index"))
    findings = found.join(of, "index", "left").select(*[c.strip().split(" ")[0] for c in FINDING.split(", ")])
    if "block" not in values.columns and "new" not in several:
        values = values.withColumn("block", F.lit(None).cast("int"))
    elif "block" not in values.columns:  # runs of new lines lie apart, so a value is in one of them at most
        near = made.where("kind = 'new'").select(F.col("first_line_no").alias("begins"), F.col("last_line_no").alias("ends"), F.col("block").alias("of"))
        own = values.columns
        values = last_before(values, "first_target_line_no", near, "begins").select(*own, F.when(F.col("_mark.ends") >= F.col("first_target_line_no"), F.col("_mark.of")).alias("block"))
    result = Diff(totals[:n], totals[n], counts.count(), findings, made, values, mined=mined)
    if options.watch_fields:
        grouped = bool(options.watch_by)
        seen = durable(W.observed(lines, options.watch_fields, options.watch_by))
        cover, ledger = W.ledger(seen, n, grouped, options.watch_fields)
        cover, ledger = durable(cover), durable(ledger)
        complete = W.completeness(cover, n)
        shown = W.field_values(ledger, complete, n, grouped)
        rates = W.rate_groups(ledger, complete, n) if options.watch_rate_change is not None else None
        changes = W.rate_changes(ledger, rates, n, options.watch_rate_change, options.significance) if rates is not None else None
        for p in options.watch_fields:
            own = lambda df, p=p: df.where(F.col("pointer") == p)
            result.watches.append(Watch(p, options.watch_by, own(cover), own(complete), own(shown), None if rates is None else own(rates), None if changes is None else own(changes)))
    if options.context:
        at = lambda df, c: df.where(F.col(c).isNotNull()).select(F.col(c).alias("line_no"))
        wanted = at(findings.where("block IS NULL"), "first_target_line_no").unionByName(at(values.where("block IS NULL"), "first_target_line_no"))
        for w in result.watches:
            wanted = wanted.unionByName(at(w.finding_values(), "first_target.line_no"))
        result.context = durable(B.context(lines.where(F.col("run_idx") == n), durable(wanted.distinct()), options.context))
        window = result.context.select(F.col("line_no").alias("_at"), F.struct("before", "after").alias("context"))
        beside = lambda df: df.join(window, F.col("first_target_line_no") == F.col("_at"), "left").drop("_at")
        result.findings, result.value_findings = beside(result.findings), beside(result.value_findings)
        for w in result.watches:
            w.values = W.with_context(w.values, w.finding_values(), result.context)
    return result


def diff_runs(baselines: list[DataFrame], target: DataFrame, options: DiffOptions = DiffOptions()) -> Diff:
    return diff(runs(baselines, target), len(baselines), options)
