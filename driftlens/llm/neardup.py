"""MinHash near-dedup on HyperMinHash registers.

Per document: distinct word 5-grams as 64-bit hashes.  The top bits of a hash name one of
256 buckets; of each bucket's least value a register keeps the number of leading zeros and
the ten bits after the first one, 16 bits in all.  For banding, four buckets are one, 64 in
all; those that are empty are lent another's in a fixed order (optimal densification), so
small sets collide as often as their Jaccard similarity says.  Bands of three registers
bring documents together; all 256 estimate their similarity.

* Documents of equal sets are one *class*, told by a 128-bit digest; a class of any size
  costs one row from there on.
* Round 1 pairs each member of a band bucket with the bucket's least class: as many pairs
  as members, whatever the bucket's size.
* Round 2 takes up the buckets whose members aren't yet in one component, in pairs of
  blocks, and tests the pairs across components.  Pairs within a component can't change the
  result.
* The collision-corrected estimate and the sizes rule pairs out; what is left is confirmed
  on the full sets: in round 1 hub by hub in chunks, with one hub's set in memory at a time,
  in round 2 within the blocks, which send on a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import FEW, components, cut_lineage, into_blocks, lookup, runs, sieve, slices

WORDS = 5
REGISTERS = 256
#: Registers for banding, each made of as many as follow from ``REGISTERS``.
COARSE = 64
ROWS = 3
BANDS = COARSE // ROWS
EMPTY = 0xFFFF
MANTISSA = 10
#: Members that are verified against one copy of a hub's set.
CHUNK = 256
#: Classes of a bucket that are compared with as many others at once.
BLOCK = 512
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 5.0

_rng = np.random.default_rng(64)
_LENDERS = np.stack([_rng.permutation(COARSE) for _ in range(256)], axis=1)  # [bucket, attempt]
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    Words are parted by ASCII white space, A-Z count as a-z.  A text of fewer words is one
    shingle; one without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    unique = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    blank = names.index("") if "" in names else -1
    codes = coded.indices.to_numpy()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    out = []
    h = unique[codes] if len(codes) else np.zeros(0, np.uint64)
    if blank >= 0:
        real = codes != blank
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        h = h[real]
    for a, b in zip(ends, ends[1:], strict=False):
        n = min(words, b - a)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.full(b - a - n + 1, np.uint64(n))
        for k in range(n):
            total = _mix(total * _M1 + h[a + k : b - n + 1 + k])
        out.append(np.unique(total))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes, ``EMPTY`` where no hash falls."""
    shift = np.uint64(64 - REGISTERS.bit_length() + 1)
    bucket = np.arange(REGISTERS, dtype=np.uint64)
    at = np.searchsorted(shingles, bucket << shift)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((least >> shift) == bucket)
    value = least & ((np.uint64(1) << shift) - np.uint64(1))
    width = int(shift)
    length = np.frexp(value.astype(np.float64))[1]  # bits up to the first one; rounding up is the same everywhere
    mantissa = np.where(length > MANTISSA, value >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), value << np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64))
    reg = ((width - length).astype(np.uint16) << MANTISSA) | (mantissa.astype(np.uint16) & np.uint16((1 << MANTISSA) - 1))
    return np.where(full, reg, np.uint16(EMPTY))


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it.  One register at least must hold something."""
    parts = reg.reshape(COARSE, -1)
    held = parts != EMPTY
    first = held.argmax(1)  # the least value of joined buckets is that of the first that holds one
    coarse = (first.astype(np.uint64) << np.uint64(16)) | parts[np.arange(COARSE), first]
    full = held.any(1)
    lender = np.arange(COARSE)
    empty = ~full
    for attempt in range(_LENDERS.shape[1]):
        if not empty.any():
            break
        ask = _LENDERS[empty, attempt]
        lender[empty] = np.where(full[ask], ask, lender[empty])
        empty = ~full[lender]
    lender[empty] = np.flatnonzero(full)[0]
    rows = coarse[lender][: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix((key << np.uint64(20)) ^ rows[:, k])
    return key.view(np.int64)


def estimate(regs: np.ndarray, other: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity of each row of ``regs`` with ``other``, standard error at a similarity of 0.75).

    Buckets that hold something in either set are a sample, without replacement, of the
    union; the share of equal registers among them is corrected for chance collisions: two
    unrelated least values agree in leading zeros with a probability of about
    min / max of the sizes, halved, and in the mantissa with 2 ** -10.
    """
    either = ((regs != EMPTY) | (other != EMPTY)).sum(1)
    equal = ((regs == other) & (regs != EMPTY)).sum(1)
    chance = np.minimum(sizes, size) / np.maximum(np.maximum(sizes, size), 1) / 2 / (1 << MANTISSA)
    share = np.clip((equal / np.maximum(either, 1) - chance) / (1 - chance), 0, 1)
    union = np.maximum((sizes + size) / 1.75, 1)
    left = np.clip(1 - either / union, 0.02, 1)  # how much of the union is not in the sample
    return share, np.sqrt(0.1875 / np.maximum(either, 1) * left)


def plausible(regs: np.ndarray, other: np.ndarray, sizes: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """Whether the sizes and the estimate leave it open that the similarity reaches ``threshold``."""
    small, large = np.minimum(sizes, size), np.maximum(sizes, size)
    share, error = estimate(regs, other, sizes, size)
    return (small >= threshold * large - 1e-9) & (share >= threshold - SLACK * error - 0.01)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, set_a, set_b, regs): size and digest of the set, and its registers; of a set without shingles all null but n."""

    def run(batches):
        for part in slices(batches, "text"):
            n, a, b, regs = [], [], [], []
            for s in shingle_sets(part.column(1), words):
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                a.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                b.append(int.from_bytes(digest[8:], "little", signed=True) if digest else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n", "set_a", "set_b", "regs"])

    return _input(docs).mapInArrow(run, "doc_id long, n long, set_a long, set_b long, regs binary")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _banded(classes: DataFrame, extra: list[str]) -> DataFrame:
    """A row for each class and band."""
    at = classes.columns.index("regs")
    keep = [i for i, n in enumerate(classes.columns) if n in ("rep", *extra)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(at).to_pylist()]
            row = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.record_batch([pa.array(np.concatenate(keys)), *(batch.column(i).take(row) for i in keep)], ["band", *(batch.schema.names[i] for i in keep)])

    fields = ", ".join(f"{classes.schema[i].name} {classes.schema[i].dataType.simpleString()}" for i in keep)
    return classes.mapInArrow(run, f"band long, {fields}")


def _fetched(wanted: DataFrame, payload: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``wanted`` (small values) with what ``payload`` has for its ``key``; ``ids`` are the keys, cheap to read.

    Of few keys, the payload's rows are picked where they are read; of many, it is sieved
    by a bitmap and then shuffled.
    """
    if ids.count() <= FEW:
        chosen = payload.join(F.broadcast(ids.distinct()), key, "left_semi")
        return wanted.join(chosen, key)
    return wanted.join(sieve(payload, key, ids), key)


def _by_hub(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """(a, chunk, role, need, payload's second column and on) for every row of ``pairs`` (a, b).

    A hub a comes first (role 0), then up to about ``CHUNK`` of its members b (role 1), in
    one partition; a hub with more members comes once for each chunk.  ``payload`` is told
    by its column ``need``.
    """
    degree = cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("_n")).withColumn("degree", F.col("_n")), free=False)
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / CHUNK)).alias("chunk")
    dealt = cut_lineage(lookup(pairs, degree, ["a"]).select("a", "b", chunk), free=False)  # read several times below
    wanted = dealt.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("need")).unionByName(
        dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("need"))
    )
    ids = dealt.select(F.col("b").alias("need")).unionByName(dealt.select(F.col("a").alias("need")).distinct())
    rows = _fetched(wanted, payload, "need", ids).select("a", "chunk", "role", "need", *payload.columns[1:])
    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")


def _linked(pairs: DataFrame, payload: DataFrame, load, holds, limit_by: str) -> DataFrame:
    """The rows of ``pairs`` for which ``holds(hub's load, member's load)``; ``load`` makes a batch's loads."""

    def run(batches):
        hub, own = None, None
        for part in slices(batches, limit_by):
            out_a, out_b = [], []
            for a, chunk, role, need, it in zip(*(part.column(i).to_pylist() for i in range(4)), load(part), strict=True):
                if role == 0:
                    hub, own = (a, chunk), it
                elif hub == (a, chunk) and holds(own, it):
                    out_a.append(a)
                    out_b.append(need)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return _by_hub(pairs, payload).mapInArrow(run, "a long, b long")


def left_open(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (a, b), a the hub, whose sizes and estimate leave it open that they link."""

    def load(part):
        return [(n, np.frombuffer(r, np.uint16)[None]) for n, r in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]

    def holds(hub, member):
        return bool(plausible(member[1], hub[1], np.array([member[0]]), hub[0], threshold)[0])

    return _linked(pairs, classes.select(F.col("rep").alias("need"), "n", "regs"), load, holds, "regs")


def verify(pairs: DataFrame, docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """The rows of ``pairs`` (a, b), a the hub, with 100 * intersection >= percent * union on full sets."""

    def holds(own, s):
        both = len(np.intersect1d(own, s, assume_unique=True))
        return 100 * both >= percent * (len(own) + len(s) - both)

    texts = _input(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "need")
    return _linked(pairs, texts, lambda part: shingle_sets(part.column(4), words), holds, "text")


def _open_pairs(table: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of other components that it may link with) of a pair of blocks; a pair comes in the first band that it shares."""
    rep, comp, n, block = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "block"))
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    band, low, high = (table.column(c)[0].as_py() for c in ("band", "low_block", "high_block"))
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)
    keys: dict[int, np.ndarray] = {}

    def of(row: int) -> np.ndarray:
        if row not in keys:
            keys[row] = band_keys(regs[row])
        return keys[row]

    mixed = np.flatnonzero(comp != comp[0])
    if not len(mixed):
        return
    for i in left.tolist():
        other = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) | (low != high))]
        # sizes first: they rule out most, and registers are compared for the rest
        other = other[np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i]) - 1e-9]
        other = other[plausible(regs[other], regs[i], n[other], n[i], threshold)]
        if len(other):
            same = np.stack([of(o) for o in other.tolist()]) == of(i)
            other = other[of(i)[same.argmax(1)] == band]
            if len(other):
                yield i, other


def across(members: DataFrame, sketch: DataFrame, docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Links (a, b) that join what pairs of blocks hold of different components; a spanning forest of each.

    ``members`` (band, rep, comp, block, low_block, high_block) are in their blocks already.

    First those members are found that have a pair left open; only their texts follow them
    into the blocks, where the open pairs are confirmed on full sets.  Pairs never leave a
    block, so what comes out is as large as the blocks.
    """
    at = ["band", "low_block", "high_block"]

    def touched(batches):
        for table in runs(batches, at):
            hit = np.zeros(table.num_rows, bool)
            for i, other in _open_pairs(table, percent / 100):
                hit[i] = True
                hit[other] = True
            yield from table.select([*at, "block", "comp", "rep"]).filter(pa.array(hit)).combine_chunks().to_batches()

    def confirmed(batches):
        for table in runs(batches, at):
            rep, comp = (table.column(c).to_numpy() for c in ("rep", "comp"))
            sets = [s for part in slices(table.to_batches(), "text") for s in shingle_sets(part.column(part.schema.get_field_index("text")), words)]
            _, label = np.unique(comp, return_inverse=True)
            out_a, out_b = [], []
            for i, other in _open_pairs(table, percent / 100):
                for o in other.tolist():
                    if label[o] == label[i]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[o], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[o]) - both):
                        label[label == label[o]] = label[i]
                        out_a.append(min(rep[i], rep[o]))
                        out_b.append(max(rep[i], rep[o]))
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = _fetched(members, sketch, "rep", members.select("rep")).repartition(*at).sortWithinPartitions(*at)
    found = cut_lineage(dealt.mapInArrow(touched, "band long, low_block int, high_block int, block int, comp long, rep long").distinct())
    texts = _input(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "rep")
    full = _fetched(_fetched(found, sketch, "rep", found.select("rep")), texts, "rep", found.select("rep"))
    return full.repartition(*at).sortWithinPartitions(*at).mapInArrow(confirmed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked with 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id that links reach.  A document without words links with
    nothing.  Rows of the same doc_id are one document, linked where one of them is.  A row
    with a null doc_id links with nothing, and its component_id and kept are null.  Ties
    and equal texts follow from the sets alone.  Other columns are ignored.
    """
    threshold = percent / 100
    sketched = cut_lineage(sketches(docs, words), free=False)
    sets = cut_lineage(sketched.drop("regs"), free=False)
    usable = sketched.where(F.col("doc_id").isNotNull() & F.col("set_a").isNotNull())
    classes = cut_lineage(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies")), free=False)
    del sketched, usable

    # the buckets of two classes or more, with their least class
    banded = cut_lineage(_banded(classes, []))
    roots = cut_lineage(banded.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("_n")).where("_n > 1"), free=False)
    if roots.count() > FEW:
        banded = cut_lineage(sieve(banded, "band", roots.select("band")), free=False)
    shared = cut_lineage(lookup(banded, roots, ["band"]).where("a IS NOT NULL"), free=False)
    del banded, roots

    # round 1: each member of a bucket with the least
    pairs = cut_lineage(shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    pairs = cut_lineage(left_open(pairs, classes, threshold))
    links = cut_lineage(verify(pairs, docs, percent, words))
    joined = cut_lineage(components(links))

    # round 2: buckets that hold several components
    keyed = shared.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    keyed = cut_lineage(keyed, free=False)
    mixed = keyed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("_n")).where("low <> high")
    mixed = cut_lineage(mixed.select("band", "_n", F.col("_n").alias("_rows")), free=False)
    members = cut_lineage(lookup(keyed, mixed, ["band"]).where("_rows IS NOT NULL"))
    del shared, keyed, mixed
    sketch = classes.select("rep", "n", "regs")
    more = cut_lineage(across(into_blocks(members, "rep", BLOCK), sketch, docs, percent, words))
    final = joined if more.isEmpty() else cut_lineage(components(links.unionByName(more)))

    per_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.col("copies").alias("_n"), F.coalesce("component", "rep").alias("of_class"))
    out = lookup(sets, cut_lineage(per_class), ["set_a", "set_b"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
