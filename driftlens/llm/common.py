"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators.joins import FEW, HEAVY, lookup
from driftlens.operators.lineage import shared_folder

__all__ = ["FEW", "HEAVY", "components", "cut_lineage", "free_name", "into_blocks", "lookup", "release", "runs", "shared_folder", "sieve", "slices", "table"]

#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 3_000_000
#: Bits of the bitmap that ``sieve`` sends to all tasks.
SIEVE_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, free: bool = True) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and go on from there.

    Shuffle files and checkpoints that nothing refers to any more go when the driver
    collects its garbage.  It has little of that, so it is asked to, else they pile up.
    Each such collection stops the driver, and where they come thick its heap is let grow
    for them; so leave it (``free=False``) where nothing large has been dropped since the last.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if free:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        release()
    return out


def free_name(columns: list[str], name: str) -> str:
    """``name``, or it with as many underscores as keep it apart from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # not the GNU library
    _trim = None


def release() -> None:
    """Give freed memory back to the system: workers are used again, and would keep the most that a task ever took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes; one row at least.

    Memory that a slice took is given back before the next one.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(sizes) // limit).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
            if b - a < batch.num_rows:
                release()
    release()


def sieve(rows: DataFrame, column: str, ids: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """The rows of ``rows`` whose ``column`` is among ``ids`` (one column of longs), and a few others.

    A bitmap of the ids' hashes goes to all tasks, so that a join after it shuffles little
    more than it needs.  It is ``bits`` / 8 bytes (8 MB) at most, whatever the input; with
    more ids than it can tell apart more rows pass, and the join decides.  ``ids`` is read
    here and by that join, so it should be cheap to read.
    """
    place = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(bits)) + 1
    spots = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    found = spots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()
    packed = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in found:
        packed[(bucket - 1) * len(bitmap) : bucket * len(bitmap)] = np.frombuffer(bytes(bitmap), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(packed.tobytes())
    del found, packed
    release()
    spot = free_name(rows.columns, "_spot")

    def keep(batches):
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            kept = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if kept.num_rows:
                yield kept.select(range(batch.num_columns - 1))

    return rows.withColumn(spot, F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))).mapInArrow(keep, rows.schema)


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges``; returns (node, component), component the least node.

    Large-star and small-star steps in turn, each an aggregate with map-side combine and
    an equi-join, until the edges are stars around their least nodes, which neither step
    changes.  Nodes without an edge aren't returned.  Each round is cut off by a checkpoint,
    so a lost executor costs one round at most.  Rounds grow with the logarithm of the
    component's size; if ``max_rounds`` are too few, it raises.
    """
    e = cut_lineage(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        if _stars(e):
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = lookup(both.where("v > u"), cut_lineage(least, free=False), ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large, free=False)
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), free=False)
        ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = lookup(large, low, ["u"]).select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = cut_lineage(small)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(e: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v), u > v, has one v, which is no other edge's u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    open_nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 AND n > 1")
    return open_nodes.agg(F.count("*")).first()[0] == 0


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` in rows that come sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def into_blocks(rows: DataFrame, ident: str, block: int) -> DataFrame:
    """Deal groups of ``_rows`` rows each into pairs of blocks of about ``block`` rows.

    A row comes once for each pair of blocks that its own block is in; columns ``block``
    (its own), ``low_block`` and ``high_block`` take the place of ``_rows``.  A task that
    gets a group's pair of blocks never holds more than two blocks, however large the group.
    """
    dealt = rows.withColumn("_blocks", F.ceil(F.col("_rows") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("low_block", F.least("block", "_other")).withColumn("high_block", F.greatest("block", "_other")).drop("_rows", "_blocks", "_other")
