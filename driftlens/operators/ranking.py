"""Places in a total order without a task that gets all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.joins import FEW
from driftlens.operators.lineage import durable


#: Lines (or whatever is counted) of a range in which rows are looked through at once.
SPAN = 1 << 20


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, their places from 0 in ``order``, which no two rows may share.

    Up to ``FEW`` rows are numbered by a window, after that check of their size.  More are
    dealt by ranges and sorted there; of each range only its count meets the others.
    """
    rows = durable(rows)
    if rows.count() <= FEW:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return by_ranges(rows, order, name)


def by_ranges(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``ranked`` for any number of rows."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = durable(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n"), F.min("_nth").alias("low")).collect()  # a row a range
    before, offsets = 0, {}
    for r in sorted(counts, key=lambda r: r["_range"]):
        offsets[r["_range"]] = before - r["low"]
        before += r["n"]
    if not offsets:
        return dealt.select(*rows.columns, F.col("_nth").alias(name))
    offset: Column = F.get(F.array(*[F.lit(offsets.get(k, 0)).cast("long") for k in range(max(offsets) + 1)]), F.col("_range"))
    return dealt.select(*rows.columns, (F.col("_nth") + offset).alias(name))


def last_before(rows: DataFrame, at: str, marks: DataFrame, begin: str, span: int = SPAN) -> DataFrame:
    """``rows`` with ``_mark``, the row of ``marks`` with the greatest ``begin`` that isn't beyond their ``at``; null where there is none.

    Both are whole numbers.  Rows meet the marks of their own range of numbers, and of each
    range only the last mark meets the others.
    """
    shape = marks.select(F.struct(begin, *[c for c in marks.columns if c != begin]).alias("_mark")).schema["_mark"].dataType
    here = F.struct(*[F.col(c) for c in shape.names])
    both = rows.select(F.col(at).alias("_at"), F.lit(1).alias("_late"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(shape).alias("_mark")).unionByName(
        marks.select(F.col(begin).alias("_at"), F.lit(0).alias("_late"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("_row"), here.alias("_mark"))
    ).withColumn("_part", F.floor(F.col("_at") / span))
    own = F.max("_mark").over(Window.partitionBy("_part").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("_part").agg(F.max("_mark").alias("_end"))
    before = ends.select("_part", F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a range
    found = both.withColumn("_own", own).join(before, "_part", "left").where("_late = 1")
    return found.select("_row.*", F.coalesce("_own", "_before").alias("_mark"))
