"""Findings that belong to one event of the log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.config import BLOCK_GAP, GONE_GAP, MIN_TEMPLATES
from driftlens.operators.compare import kind_rank
from driftlens.operators.ranking import last_before, ranked

#: Lines of a range in which gaps are looked for at once.
SPAN = 1 << 20


def new_runs(new_lines: DataFrame) -> DataFrame:
    """(line_no, cid, run): runs of new lines with at most ``BLOCK_GAP`` known lines between.

    Gaps within a range of line numbers are found in that range; of each range only its
    first and last line meet the others.
    """
    part = new_lines.withColumn("part", F.floor(F.col("line_no") / SPAN))
    edges = part.groupBy("part").agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    before = edges.select((F.lead("part").over(Window.orderBy("part"))).alias("part"), F.col("high").alias("before"))  # a row a range
    joined = part.join(before, "part", "left")
    w = Window.partitionBy("part").orderBy("line_no")
    starts = joined.withColumn("gap", F.col("line_no") - F.coalesce(F.lag("line_no").over(w), F.col("before")))
    starts = starts.withColumn("start", F.when(F.col("gap").isNull() | (F.col("gap") > BLOCK_GAP + 1), F.col("line_no")))
    own = starts.withColumn("own", F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = starts.groupBy("part").agg(F.max("start").alias("last"))
    carried = last.withColumn("carried", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "carried")
    return own.join(carried, "part").select("line_no", "cid", F.coalesce("own", "carried").alias("run"))


def new_blocks(runs: DataFrame) -> DataFrame:
    """(run, first, last, members, lines_elsewhere): templates whose lines all lie in runs of several, by their first line's run."""
    run = runs.groupBy("run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count_distinct("cid").alias("kinds"))
    shared = run.where(F.col("kinds") >= MIN_TEMPLATES).select("run", "first", "last")
    per = runs.join(shared.select("run", F.lit(1).alias("in")), "run", "left").groupBy("cid").agg(F.count("*").alias("n"), F.count("in").alias("inside"), F.min_by("run", "line_no").alias("home"))
    folded = per.where("n = inside").select("cid", F.col("home").alias("run"))
    there = runs.join(folded.withColumnRenamed("run", "home"), "cid").groupBy(F.col("home").alias("run")).agg(F.count_if(F.col("run") != F.col("home")).alias("lines_elsewhere"))
    members = folded.groupBy("run").agg(F.collect_list("cid").alias("members")).where(F.size("members") >= MIN_TEMPLATES)
    return shared.join(members, "run").join(there, "run")


def gone_extents(found: DataFrame) -> DataFrame:
    """Where each gone template lay in the first baseline: first, last, count, and how far it covers."""
    e = found.where((F.col("kind") == "gone") & F.col("pos").isNull() & F.col("first_baseline_line_no").isNotNull())
    e = e.select("cid", F.col("first_baseline_line_no").alias("first"), F.col("last_base").alias("last"), F.get("baseline_counts", F.lit(0)).alias("count"))
    packed = 2 * F.col("count") >= F.col("last") - F.col("first") + 1
    return e.withColumn("covered", F.when(packed, F.col("last")).otherwise(F.col("first"))).withColumn("placed", F.when(packed, F.col("count")).otherwise(1))


def gone_chains(extents: DataFrame, gap: int = BLOCK_GAP) -> DataFrame:
    """Extents with their chain, numbered from 1: the next begins within ``gap`` lines of all before it.

    As in ``new_runs``, extents are gone through range by range, and of each range only how
    far it reaches and how many chains begin in it meet the others.
    """
    part = extents.withColumn("part", F.floor(F.col("first") / SPAN))
    w, ranges = Window.partitionBy("part").orderBy("first", "cid"), Window.orderBy("part")  # a row a range
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    reached = part.groupBy("part").agg(F.max("covered").alias("to")).select("part", F.max("to").over(before).alias("carried"))
    own = part.join(reached, "part").withColumn("reach", F.greatest(F.max("covered").over(w.rowsBetween(Window.unboundedPreceding, -1)), "carried"))
    own = own.withColumn("begins", (F.col("reach").isNull() | (F.col("first") > F.col("reach") + gap + 1)).cast("long"))
    begun = own.groupBy("part").agg(F.sum("begins").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begun"))
    chain = F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("begun")
    return own.join(begun, "part").select(*extents.columns, chain.alias("chain"))


class _Joined:
    """Chains in order on a stack; what a chain has joined can be joined again."""

    def __init__(self):
        self.stack: list[list] = []  # first, covered, placed, the first of its chains

    def push(self, first: int, covered: int, placed: int, chain: int) -> None:
        """One more chain.  It joins the one before it where the gap is small and a third of all lines between first
        and last are theirs; what has grown may then join the one before that."""
        self.stack.append([first, covered, placed, chain])
        while len(self.stack) > 1:
            a, b = self.stack[-2], self.stack[-1]
            end = max(a[1], b[1])
            if b[0] - a[1] - 1 > GONE_GAP or 3 * (a[2] + b[2]) < end - a[0] + 1:
                break
            self.stack[-2:] = [[a[0], end, a[2] + b[2], a[3]]]


def joined_chains(chained: DataFrame) -> DataFrame:
    """(block, first, covered, placed) of the joined chains; ``block`` is the first chain of each.

    Chains join one after another, in order.  But none joins past a gap of more than
    ``GONE_GAP`` lines after all that lies before it, so the stretches between such gaps,
    found as chains are, are gone through side by side, each as its sorted rows stream by.
    """
    chains = chained.groupBy("chain").agg(F.min("first").alias("first"), F.max("covered").alias("covered"), F.sum("placed").cast("long").alias("placed"))
    stretches = gone_chains(chains.withColumnRenamed("chain", "cid"), GONE_GAP).select(F.col("chain").alias("stretch"), F.col("cid").alias("chain"), "first", "covered", "placed")

    def run(batches):
        stretch, now = None, _Joined()

        def closed():
            cols = [[x[k] for x in now.stack] for k in (3, 0, 1, 2)]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["block", "first", "covered", "placed"])

        for b in batches:
            for s, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != stretch:
                    if now.stack:
                        yield closed()
                    stretch, now = s, _Joined()
                now.push(*row)
        if now.stack:
            yield closed()

    rows = stretches.repartition("stretch").sortWithinPartitions("stretch", "chain").select("stretch", "first", "covered", "placed", "chain")
    return rows.mapInArrow(run, "block long, first long, covered long, placed long")


def gone_blocks(chained: DataFrame) -> DataFrame:
    """(first, last, members) of the joined chains with several templates that lie in them whole."""
    joined = joined_chains(chained).select(F.col("block").alias("home"), "first", F.col("covered").alias("to"))
    inside = last_before(chained.select("cid", "last", "chain"), "chain", joined, "home", SPAN).where("last <= _mark.to")
    members = inside.groupBy("_mark").agg(F.collect_list("cid").alias("members")).where(F.size("members") >= MIN_TEMPLATES)
    return members.select(F.col("_mark.first").alias("first"), F.col("_mark.to").alias("last"), "members")


def assembled(found: DataFrame, new: DataFrame | None, gone: DataFrame | None) -> DataFrame:
    """Blocks with their lines, score and findings' indexes in line order; block numbers by kind, score and first line."""
    sides = [d.select(F.lit(kind).alias("kind"), "first", "last", "members", other.cast("long").alias("lines_elsewhere")) for d, kind, other in ((new, "new", F.col("lines_elsewhere")), (gone, "gone", F.lit(0))) if d is not None]
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    member = both.select("kind", "first", "last", "lines_elsewhere", F.explode("members").alias("cid"))
    own = found.where(F.col("pos").isNull()).select("cid", "kind", "index", "score", "target_count", "baseline_counts", "first_target_line_no", "first_baseline_line_no")
    rows = member.join(own, ["cid", "kind"])
    line = F.when(F.col("kind") == "gone", F.col("first_baseline_line_no")).otherwise(F.col("first_target_line_no"))
    n = F.when(F.col("kind") == "gone", F.get("baseline_counts", F.lit(0))).otherwise(F.col("target_count"))
    out = rows.groupBy("kind", "first", "last", "lines_elsewhere").agg(
        F.sum(n).alias("line_count"), F.sum("score").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct(line.alias("line"), "index"))), lambda x: x["index"]).alias("findings")
    ).where(F.size("findings") >= MIN_TEMPLATES)
    out = ranked(out, [kind_rank(F.col("kind")), F.desc("score"), F.col("first"), F.col("last")], "block")
    return out.select(F.col("block").cast("int").alias("block"), "kind", F.col("first").alias("first_line_no"), F.col("last").alias("last_line_no"), "line_count", "lines_elsewhere", "score", "findings")


def context(lines: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(line_no, before, after): the ``n`` lines on either side of each wanted line, by an equi-join on line numbers."""
    near = wanted.select("line_no").distinct().select("line_no", F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("at")).where("at <> line_no")
    got = near.join(lines.select(F.col("line_no").alias("at"), "raw"), "at")
    pair = F.struct(F.col("at").alias("line_no"), "raw")
    side = lambda c: F.sort_array(F.collect_list(F.when(c, pair)))
    per = got.groupBy("line_no").agg(side(F.col("at") < F.col("line_no")).alias("before"), side(F.col("at") > F.col("line_no")).alias("after"))
    return wanted.select("line_no").distinct().join(per, "line_no", "left")
