"""Watched JSON fields: coverage, values, novelty and rates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.config import GROUP_BYTES, GROUPED_VALUES, POOLED_VALUES, VALUE_BYTES, pointers
from driftlens.functions.fields import SIMPLE_CHARS, bounded_window, clipped, payload, select, simple
from driftlens.functions.scoring import score_template

PROBLEMS = ["invalid_json", "non_scalar", "ambiguous", "oversized", "untracked", "group_missing", "group_non_scalar", "group_ambiguous"]
CLASSES = ["matched", "missing", "non_json", *PROBLEMS]


_SEEN = "run_idx int, line_no long, raw string, pointer string, status string, value_json string, group_json array<string>"


def observed(lines: DataFrame, fields: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(pointer, run_idx, line_no, raw, status, value_json, group_json) of each line and field; masks don't apply.

    A line that one pattern a pointer proves to be plain JSON with all that is asked for
    is answered by Column expressions; the others, and all where a pointer has more than
    two steps, are parsed in Python.
    """
    lines = lines.select(F.col("run_idx").cast("int"), F.col("line_no").cast("long"), F.col("raw").cast("string"))
    patterns = [simple(s) for s in pointers((*fields, *by), 20)] if not set(fields) & set(by) else [None]
    if None in patterns or not fields:
        return _parsed(lines, fields, by)
    raw = F.col("raw")
    caught = [F.regexp_extract(raw, p, 1) for p in patterns]
    # an envelope of a container may be around it, whose names are looked for by the parser
    likely = raw.startswith("{") & (F.length(raw) <= SIMPLE_CHARS) & ~(raw.contains('"log"') & raw.contains('"stream"'))
    found = lines.withColumn("_x", F.when(likely, F.array(*caught)))
    proven = F.coalesce(F.forall("_x", lambda v: v != ""), F.lit(False))
    group = F.slice("_x", len(fields) + 1, len(by)) if by else F.array().cast("array<string>")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("pointer"), F.get("_x", F.lit(k)).alias("value_json")) for k, f in enumerate(fields)]))
    quick = found.where(proven).select("run_idx", "line_no", "raw", each.alias("e"), group.alias("group_json"))
    quick = quick.select("run_idx", "line_no", "raw", "e.pointer", F.lit("matched").alias("status"), "e.value_json", "group_json")
    return quick.unionByName(_parsed(found.where(~proven).select("run_idx", "line_no", "raw"), fields, by))


def _parsed(lines: DataFrame, fields: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """``observed`` by parsing every line."""
    steps, keys = pointers(fields, 16), pointers(by, 4)
    shape = pa.schema([("run_idx", pa.int32()), ("line_no", pa.int64()), ("raw", pa.string()), ("pointer", pa.string()), ("status", pa.string()), ("value_json", pa.string()), ("group_json", pa.list_(pa.string()))])

    def one(raw):
        why, obj = payload(raw)
        group, wrong = [], None
        if obj is not None:
            for k in keys:
                s, v = select(obj, k)
                if s != "ok":
                    wrong = s if s == "invalid_json" else "group_" + s
                    break
                group.append(v)
        for name, step in zip(fields, steps, strict=True):
            s, v = (why, None) if obj is None else select(obj, step)
            if s == "ok" and wrong:
                yield name, wrong, None, None
            else:
                yield name, "matched" if s == "ok" else s, v, group if s == "ok" else None

    def run(batches):
        for b in batches:
            rows = [(r, n, raw, *x) for r, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in one(raw or "")]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return lines.mapInArrow(run, _SEEN)


def _occurrence(at: Column, baseline: bool) -> Column:
    """Where a value or a problem was seen, with an excerpt of the line; null where it wasn't."""
    text, cut = clipped(at["raw"])
    run = [at["run_idx"].alias("baseline_index")] if baseline else []
    return F.when(at.isNotNull(), F.struct(*run, at["line_no"].alias("line_no"), text.alias("raw"), cut.alias("truncated")))


def ledger(seen: DataFrame, n: int, grouped: bool, fields: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(coverage, values): lines of each class by pointer and run, with the first problem; counts by pointer, group and value.

    Only the first 64 values (grouped: 256 pairs) of a pointer are tracked, in line order;
    the rest count as untracked, as do values and groups that are too long.  Each of
    ``fields`` has a row for every run, even one without a line.
    """
    limit = GROUPED_VALUES if grouped else POOLED_VALUES
    key = ["pointer", "group_json", "value_json"]
    short = (F.octet_length("value_json") <= VALUE_BYTES) & (F.aggregate("group_json", F.lit(0), lambda a, g: a + F.octet_length(g)) <= GROUP_BYTES)
    matched = seen.where(F.col("status") == "matched")
    at = F.struct("run_idx", "line_no")
    full = F.struct("run_idx", "line_no", "raw")
    target = F.col("run_idx") == n
    sums = matched.where(short).groupBy(*key).agg(
        F.min(at).alias("seen"), *[F.count_if(F.col("run_idx") == i).alias(f"c{i}") for i in range(n)], F.count_if(target).alias("tc"),
        F.min(F.when(~target, full)).alias("first_baseline"), F.min(F.when(target, full)).alias("first_target"),
    )
    # the first values by line order, found without sorting all: a top-k of each partition and pointer, then of all
    rank = F.row_number().over(Window.partitionBy("pointer").orderBy("seen"))
    values = sums.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    held = values.groupBy("pointer").agg(*[F.sum(f"c{i}").alias(f"h{i}") for i in range(n)], F.sum("tc").alias(f"h{n}"))
    problems = [p for p in PROBLEMS if p != "untracked"]
    wrong = F.min(F.when(F.col("status").isin(*problems), full)).alias("wrong")
    cover = seen.groupBy("pointer", "run_idx").agg(F.count("*").alias("lines"), wrong, *[F.count_if(F.col("status") == c).alias(c) for c in CLASSES if c != "untracked"])
    if fields:
        runs = seen.sparkSession.createDataFrame([(p, i) for p in fields for i in range(n + 1)], "pointer string, run_idx int")
        cover = runs.join(cover, ["pointer", "run_idx"], "left").fillna(0, ["lines", *(c for c in CLASSES if c != "untracked")])
    h = F.coalesce(F.element_at(F.array(*[F.col(f"h{i}") for i in range(n + 1)]), F.col("run_idx") + 1), F.lit(0))
    cover = cover.join(held, "pointer", "left").withColumn("untracked", F.col("matched") - h)
    # values beyond the limit are looked up by the few that are tracked
    tracked = F.broadcast(values.select("pointer", F.coalesce("group_json", F.array().cast("array<string>")).alias("g"), "value_json", F.lit(True).alias("known")))
    rest = matched.withColumn("g", F.coalesce("group_json", F.array().cast("array<string>"))).join(tracked, ["pointer", "g", "value_json"], "left_anti")
    rest = rest.groupBy("pointer", "run_idx").agg(F.min(full).alias("beyond"))
    cover = cover.join(rest, ["pointer", "run_idx"], "left")
    first = F.least("wrong", "beyond")  # of the line numbers, as both are of one run
    values = values.withColumn("first_baseline", _occurrence(F.col("first_baseline"), True)).withColumn("first_target", _occurrence(F.col("first_target"), False))
    return cover.select("pointer", "run_idx", "lines", *CLASSES, _occurrence(first, False).alias("first_problem")), values


def completeness(cover: DataFrame, n: int) -> DataFrame:
    """(pointer, complete): a match in every run, a baseline at least, and no problem anywhere."""
    bad = sum((F.col(c) for c in PROBLEMS), F.lit(0))
    per = cover.groupBy("pointer").agg(F.count_if((F.col("matched") > 0) & (bad == 0)).alias("ok"))
    return per.select("pointer", ((F.col("ok") == n + 1) & F.lit(n > 0)).alias("complete"))


def field_values(values: DataFrame, complete: DataFrame, n: int, grouped: bool) -> DataFrame:
    """The ledger's values with novelty; null where the watch isn't complete."""
    b = sum((F.col(f"c{i}") for i in range(n)), F.lit(0))
    known = F.max(b > 0).over(Window.partitionBy("pointer", "group_json"))
    return values.join(complete, "pointer").select(
        "pointer", "group_json", "value_json", F.array(*[F.col(f"c{i}") for i in range(n)]).alias("baseline_counts"), F.col("tc").alias("target_count"),
        F.when(F.col("complete"), (F.col("tc") > 0) & (b == 0)).alias("is_new"),
        (F.when(F.col("complete"), known) if grouped else F.lit(None).cast("boolean")).alias("group_seen_in_baseline"),
        "first_baseline", "first_target",
    )


def rate_groups(values: DataFrame, complete: DataFrame, n: int) -> DataFrame:
    """(pointer, group_json, baseline_totals, target_total, status) of complete watches."""
    sums = values.join(complete.where("complete"), "pointer").groupBy("pointer", "group_json").agg(
        F.array(*[F.sum(f"c{i}") for i in range(n)]).alias("baseline_totals"), F.sum("tc").alias("target_total")
    )
    none = F.forall("baseline_totals", lambda t: t == 0)
    status = F.when(none, "no_baseline_observations").when(F.col("target_total") == 0, "no_target_observations").otherwise("compared")
    return sums.withColumn("status", status)


def rate_changes(values: DataFrame, groups: DataFrame, n: int, min_change_pp: float, significance: float) -> DataFrame:
    """Known values whose share lies outside all baselines' by ``min_change_pp`` points or more, and significantly."""
    rows = values.join(groups.where(F.col("status") == "compared"), ["pointer", "group_json"])
    cs = [F.col(f"c{i}") for i in range(n)]
    ts = [F.get("baseline_totals", F.lit(i)) for i in range(n)]
    rates = [F.when(t > 0, c / t) for c, t in zip(cs, ts, strict=True)]
    low, high = F.array_min(F.array(*rates)), F.array_max(F.array(*rates))
    rate: Column = F.col("tc") / F.col("target_total")
    distance = F.when(rate > high, rate - high).when(rate < low, rate - low).otherwise(0.0)
    out = rows.where(sum(cs, F.lit(0)) > 0).select(
        "pointer", "group_json", "value_json", F.array(*rates).alias("baseline_rates"), rate.alias("target_rate"),
        (distance * 100.0).alias("range_distance_pp"), score_template(cs, ts, F.col("tc"), F.col("target_total")).alias("score"),
    )
    return out.where((F.col("range_distance_pp") != 0) & (F.abs("range_distance_pp") + 1e-12 >= min_change_pp) & (F.col("score") >= significance))


def finding_values(values: DataFrame, changes: DataFrame | None) -> DataFrame:
    """The rows of ``values`` that a finding is about: those that are new, and those whose rate has changed."""
    key = ["pointer", "group_json", "value_json"]
    new = values.where("is_new")
    if changes is None:
        return new
    moved = changes.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    same = (F.col("pointer") == F.col("_pointer")) & F.col("group_json").eqNullSafe(F.col("_group_json")) & (F.col("value_json") == F.col("_value_json"))
    return new.unionByName(values.where("NOT coalesce(is_new, false)").join(moved, same, "left_semi"))


def with_context(values: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """``values`` with the bounded context of those first seen in the target where one of ``found`` was.

    ``windows`` (line_no, before, after) are a row a finding; values are a ledger's, so few.
    """
    wanted = found.where("first_target IS NOT NULL").select(F.col("first_target.line_no").alias("line_no")).distinct()
    shape = "array<struct<line_no: bigint, raw: string>>"

    def run(batches):
        for b in batches:
            made = [bounded_window(*([(x["line_no"], x["raw"]) for x in side or []] for side in (b.column(1)[i].as_py(), b.column(2)[i].as_py()))) for i in range(b.num_rows)]
            side = pa.list_(pa.struct([("line_no", pa.int64()), ("raw", pa.string())]))
            cols = [pa.array([[{"line_no": n, "raw": r} for n, r in m[k]] for m in made], side) for k in (0, 1)]
            yield pa.record_batch([b.column(0), *cols, pa.array([m[2] for m in made], pa.bool_())], ["_line", "before", "after", "context_truncated"])

    bounded = windows.join(wanted, "line_no").select("line_no", "before", "after").mapInArrow(run, f"_line long, before {shape}, after {shape}, context_truncated boolean")
    out = values.join(bounded, F.col("first_target.line_no") == F.col("_line"), "left")
    return out.withColumn("context", F.when(F.col("_line").isNotNull(), F.struct("before", "after"))).drop("_line", "before", "after")
