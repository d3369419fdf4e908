"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors of a label are one class, told by a 128-bit digest.  Each of ``TABLES`` tables
hashes a class by the signs of ``BITS`` random projections; a pair of cosine 0.98 shares a
bucket of at least one table with a probability of 0.9998.  Buckets go to tasks in pairs of
blocks, first with the 168 signs alone: pairs whose signs differ in more than ``APART``
places can't link (a pair at the threshold does so with a probability of 1e-7), and a pair
counts in the first table that it shares.  Vectors follow only those members that have a
pair left, and exact cosines in double precision decide.  A block sends on the number of
links of each of its classes and a spanning forest of its links, so what leaves a block is
as large as the block, not as its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import components, cut_lineage, into_blocks, lookup, runs, sieve
from driftlens.operators.lineage import durable

TABLES, BITS = 14, 12
BLOCK = 1024
#: Signs in which a pair may differ and be compared exactly.
APART = 30
#: Rows whose signs are compared with a block's at once.
STRIPE = 256


def planes(dim: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """The hyperplanes of all tables for vectors of ``dim`` components; the same in every task."""
    return np.random.default_rng([7, dim]).standard_normal((dim, tables * bits))


def signatures(vectors: np.ndarray, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    signs = vectors @ planes(vectors.shape[1], tables, bits) >= 0
    return (signs.reshape(len(vectors), tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.uint16)


def _told(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, low, high, raw) of every row: its components as doubles or floats and their digest, null where it can't link."""
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype = np.float32 if single else np.float64

    def run(batches):
        for batch in batches:
            dims, lows, highs, raws = [], [], [], []
            col = batch.column(2)
            value, offset = col.values, col.offsets.to_numpy()
            value = value.cast(pa.float64()) if not single else value
            bad = np.asarray(value.is_null()) if value.null_count else None
            flat = value.fill_null(0).to_numpy()
            ok = np.asarray(col.is_valid())
            for i, (vec, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = offset[i], offset[i + 1]
                v = flat[a:b].astype(dtype)
                if not ok[i] or label is None or vec is None or a == b or (bad is not None and bad[a:b].any()) or not np.isfinite(v).all() or not v.any():
                    dim = low = high = raw = None
                else:
                    dim, raw = b - a, (v + dtype(0)).tobytes()  # -0.0 becomes 0.0
                    digest = xxhash.xxh3_128_digest(raw)
                    low, high = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
                for to, what in ((dims, dim), (lows, low), (highs, high), (raws, raw)):
                    to.append(what)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), pa.array(raws, pa.binary())],
                ["vec_id", "label", "dim", "low", "high", "raw"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(
        run, "vec_id long, label long, dim int, low long, high long, raw binary"
    )


def _cosines(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows with a cosine of at least ``least``."""
    xn, yn = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    c = (x / xn[:, None]) @ (y / yn[:, None]).T
    i, j = np.nonzero(c >= least - 1e-9)
    close = np.flatnonzero(np.abs(c[i, j] - least) < 1e-9)  # at the very threshold: by the definition
    if len(close):
        a, b = i[close], j[close]
        exact = np.array([float(np.dot(x[s], y[t])) / (float(xn[s]) * float(yn[t])) for s, t in zip(a, b, strict=True)])
        keep = np.ones(len(i), bool)
        keep[close] = exact >= least
        i, j = i[keep], j[keep]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of each one's component, by the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _first_shared(sigs: np.ndarray, left: np.ndarray, right: np.ndarray | None, table: int) -> np.ndarray:
    """Which rows of ``sigs`` have a pair that shares bucket ``table``, none before it, and differs in few enough signs.

    Pairs are those of ``left`` and ``right``, or within ``left``.  All signs of a pair are
    compared at once, packed into words, for a stripe of rows at a time.
    """
    tables = sigs.shape[1]
    padded = np.zeros((len(sigs), -(-tables // 4) * 4), np.uint16)
    padded[:, :tables] = sigs
    words = padded.view(np.uint64)
    other = left if right is None else right
    hit = np.zeros(len(sigs), bool)
    for a in range(0, len(left), STRIPE):
        own = left[a : a + STRIPE]
        apart = np.zeros((len(own), len(other)), np.uint16)
        for k in range(words.shape[1]):
            apart += np.bitwise_count(words[own, k][:, None] ^ words[other, k][None, :])
        near = apart <= APART
        if right is None:
            near &= np.arange(a, a + len(own))[:, None] < np.arange(len(other))[None, :]
        i, j = np.nonzero(near)
        i, j = own[i], other[j]
        first = (sigs[i, :table] != sigs[j, :table]).all(1)
        hit[i[first]] = True
        hit[j[first]] = True
    return hit


def near_vectors(rows: DataFrame, least: float = 0.98, tables: int = TABLES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is at least
    ``least``.  A vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing, as do vectors of different lengths; its n_links is 0 and it is its
    own component.  Rows of the same vec_id are vectors of their own whose links count
    apart; those that can link share a component, as if they were linked.  A null vec_id
    links with nothing and has a null component.  Other columns are ignored.
    """
    dtype = np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    told = cut_lineage(_told(rows))
    ids = cut_lineage(told.drop("raw"))
    same = ["label", "dim", "low", "high"]
    classes = told.where("dim IS NOT NULL").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    # a vec_id may stand for several classes, so a class has a number of its own
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))
    del told

    def matrix(col) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1).astype(np.float64)

    def hashed(batches):
        for table in runs(batches, ["dim"]):
            for batch in table.to_batches(max_chunksize=2000):
                sig = signatures(matrix(batch.column(3)), tables, bits)
                row = pa.array(np.repeat(np.arange(len(sig)), tables))
                packed = pa.array([s.tobytes() for s in sig], pa.binary())
                yield pa.record_batch(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(sig))), pa.array(sig.ravel().astype(np.int32)), *(batch.column(k).take(row) for k in range(3)), packed.take(row)],
                    ["hash_table", "sig", "label", "dim", "cls", "sigs"],
                )

    key = ["label", "dim", "hash_table", "sig"]
    at = [*key, "low_block", "high_block"]
    spread = cut_lineage(classes.select("label", "dim", "cls", "raw").mapInArrow(hashed, "hash_table int, sig int, label long, dim int, cls long, sigs binary"))
    large = durable(spread.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > block).withColumn("_rows", F.col("_n")))
    sized = lookup(spread, large, key)
    dealt = into_blocks(sized.withColumn("_rows", F.coalesce("_rows", F.lit(1))), "cls", block).repartition(*at).sortWithinPartitions(*at)

    def sides(table):
        own = table.column("block").to_numpy()
        t, low, high = (table.column(c)[0].as_py() for c in ("hash_table", "low_block", "high_block"))
        left = np.flatnonzero(own == low)
        return t, left, None if low == high else np.flatnonzero(own == high)

    def touched(batches):
        for table in runs(batches, at):
            if table.num_rows < 2:
                continue
            sigs = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint16).reshape(-1, tables)
            t, left, right = sides(table)
            hit = _first_shared(sigs, left, right, t)
            if hit.any():
                yield from table.select([*at, "block", "cls"]).filter(pa.array(hit)).combine_chunks().to_batches()

    def compared(batches):
        for table in runs(batches, at):
            x = matrix(table.column("raw"))
            sigs = signatures(x, tables, bits)
            cls, copies = (table.column(c).to_numpy() for c in ("cls", "copies"))
            t, left, right = sides(table)
            i, j = _cosines(x[left], x[left if right is None else right], least)
            i, j = left[i], (left if right is None else right)[j]
            if right is None:
                i, j = i[i < j], j[i < j]
            first = (sigs[i, :t] != sigs[j, :t]).all(1)
            i, j = i[first], j[first]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            root = _forest(i, j, len(x))
            some = np.flatnonzero(links > 0)
            yield pa.record_batch([pa.array(cls[some]), pa.array(cls[root[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    few = cut_lineage(dealt.mapInArrow(touched, "label long, dim int, hash_table int, sig int, low_block int, high_block int, block int, cls long"))
    del spread, dealt, sized
    vectors = sieve(classes.select("cls", "copies", "raw"), "cls", few.select("cls"))
    found = few.join(vectors, "cls").repartition(*at).sortWithinPartitions(*at).mapInArrow(compared, "a long, b long, links long")
    found = cut_lineage(found)
    degree = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    classes = classes.drop("raw")

    # classes that hold rows of the same vec_id are joined by links of their own
    several = durable(ids.where("dim IS NOT NULL").groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_rows", F.col("_n")))
    edges = found.where("a <> b").select("a", "b")
    if not several.isEmpty():
        repeated = cut_lineage(lookup(ids.where("dim IS NOT NULL"), several, ["vec_id"]).where("_rows IS NOT NULL").drop("_rows"))
        its = lookup(repeated, classes.select(*same, "cls", F.col("copies").alias("_n")), same)
        first = its.groupBy("vec_id").agg(F.min("cls").alias("a"), F.count("*").alias("_n"))
        edges = edges.unionByName(lookup(its.select("vec_id", F.col("cls").alias("b")), first, ["vec_id"]).where("a <> b").select("a", "b").distinct())
    joined = durable(components(edges).withColumnRenamed("node", "cls"))
    named = durable(classes.select("cls", "rep", *same, "copies").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    least_id = named.groupBy("component").agg(F.min("rep").alias("of_class"), F.count("*").alias("_n"))
    named = lookup(named, durable(least_id), ["component"])
    per_class = named.join(degree, "cls", "left").select(*same, F.col("copies").alias("_n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "of_class")
    out = lookup(ids, durable(per_class), same)
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("of_class", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("of_class", "vec_id")).alias("kept"),
    )
