"""Line dedup with two Bloom filters.

1. Every document's distinct line keys set bits in two filters: one of hashes seen once,
   one of hashes seen twice.  The filters are cut into segments; tasks send the bits that
   they set, a segment's bits meet in one task, and only the second filter comes back.
   Its size follows the bytes of text (``BITS_A_BYTE``) up to ``MAX_BITS``, 64 MB, which is
   what is broadcast at most.
2. Only keys that the second filter suspects are written, as 128-bit digests, and counted
   exactly (partial counts first).  More data than the filter can hold makes more
   suspects, never another result.
3. Confirmed digests are broadcast where there are at most ``MOST_KEYS`` (16 MB), and texts
   are rewritten where they are read.  Where there are more, they go back to their
   documents by doc_id; those of very common lines are broadcast even then
   (``common.lookup``), so that no task gets all documents of one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftlens.llm.common import cut_lineage, free_name, lookup, slices

MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
#: Bits of a filter a byte of text, about 8 to 16 a line of 30 bytes.
BITS_A_BYTE = 0.25
SEGMENT_BITS = 1 << 20
#: Confirmed digests that are broadcast at most.
MOST_KEYS = 1_000_000
#: Distinct keys that a task gathers before it sends their bits on.
FLUSH = 500_000
SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """Each line's key: stripped, A-Z small; None for a key of fewer than ``min_chars`` code points."""
    keys = [line.strip(SPACE).lower() for line in text.split(b"\n")]
    if min_chars <= 1:
        return [k if len(k) >= min_chars else None for k in keys]
    return [k if len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def _bits(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """The two filter positions of each digest."""
    return np.concatenate([low & np.uint64(bits - 1), high & np.uint64(bits - 1)]).astype(np.int64)


def _digests(keys) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def filter_bits(docs: DataFrame) -> int:
    """The size of each filter, a power of two."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, 1 << int(size * BITS_A_BYTE).bit_length()))


def seen_twice(docs: DataFrame, bits: int, min_chars: int = 1) -> bytes:
    """The filter of hashes seen at least twice, as packed bits."""
    segment = min(SEGMENT_BITS, bits)
    shift = int(segment).bit_length() - 1

    def sent(keys: list[bytes]):
        spot, times = np.unique(_bits(*_digests(keys), bits), return_counts=True)
        where = spot >> shift
        for s in np.unique(where).tolist():
            own = where == s
            yield s, (spot[own] & (segment - 1)).astype("<u4").tobytes(), (spot[own & (times > 1)] & (segment - 1)).astype("<u4").tobytes()

    def first(batches):
        pending: list[bytes] = []
        for part in slices(batches, "text"):
            for text in part.column(1).to_pylist():
                pending.extend({k for k in keys_of(text or b"", min_chars) if k is not None})
            if len(pending) >= FLUSH:
                yield as_batch(sent(pending))
                pending = []
        if pending:
            yield as_batch(sent(pending))

    def as_batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["segment", "once", "twice"])

    def merge(batches):
        now, once, twice = None, None, None
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])
                    now, once, twice = s, np.zeros(segment, bool), np.zeros(segment, bool)
                spots = np.frombuffer(a, "<u4")
                twice[spots[once[spots]]] = True
                twice[np.frombuffer(b, "<u4")] = True
                once[spots] = True
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    parts = (
        _input(docs).mapInArrow(first, "segment int, once binary, twice binary")
        .repartition(max(1, bits // segment), "segment").sortWithinPartitions("segment")
        .mapInArrow(merge, "segment int, bits binary").collect()
    )  # bits / 8 bytes at most
    out = np.zeros(bits // 8, np.uint8)
    for s, packed in parts:
        out[s * segment // 8 : (s + 1) * segment // 8] = np.frombuffer(bytes(packed), np.uint8)
    return out.tobytes()


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))


def suspected(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(doc_id, low, high): the distinct keys of each row that the second filter suspects, as digests."""
    shared = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, bits, min_chars))

    def run(batches):
        packed = np.frombuffer(shared.value, np.uint8)
        for part in slices(batches, "text"):
            owner, keys = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                own = {k for k in keys_of(text or b"", min_chars) if k is not None}
                keys.extend(own)
                owner.extend([i] * len(own))
            if not keys:
                continue
            low, high = _digests(keys)
            spot = _bits(low, high, bits)
            hit = (packed[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)
            hit = hit[: len(low)] & hit[len(low) :]
            if hit.any():
                rows = part.column(0).take(pa.array(np.array(owner)[hit]))
                yield pa.record_batch([rows, pa.array(low[hit].view(np.int64)), pa.array(high[hit].view(np.int64))], ["doc_id", "low", "high"])

    return _input(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, low long, high long")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, bits: int | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and n_lines, n_dropped, kept_sha256.

    A key (see ``keys_of``) that at least ``min_docs`` documents hold loses its lines in all
    of them.  A null or empty text is one empty line, whose key has no code point and so
    stays; the rewritten text of a document that loses all its lines is empty.  Each row is
    a document, so repeated rows count once each.  Rows with a null doc_id are handled like
    the others.  Columns named like the added ones are replaced.
    """
    kept = docs.drop("n_lines", "n_dropped", "kept_sha256")
    out = StructType([*kept.schema.fields]).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    at, width, names = kept.columns.index("text"), len(kept.columns), out.names
    found = suspected(docs, min_chars, bits or filter_bits(docs))
    often = cut_lineage(found.groupBy("low", "high").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).withColumn("often", F.lit(True)))

    def rewritten(batch: pa.RecordBatch, bad_of) -> pa.RecordBatch:
        """``bad_of`` tells of the digests of all keys of the batch, and each one's row, which are to go."""
        raws = [(text or "").encode() for text in batch.column(at).to_pylist()]
        keys, row, place = [], [], []
        for i, raw in enumerate(raws):
            own = keys_of(raw, min_chars)
            there = [j for j, k in enumerate(own) if k is not None]
            keys.extend(own[j] for j in there)
            row.extend([i] * len(there))
            place.extend(there)
        low, high = (x.view(np.int64) for x in _digests(keys))
        gone: dict[int, set[int]] = {}
        for k in np.flatnonzero(bad_of(low, high, np.array(row, np.int64))).tolist():
            gone.setdefault(row[k], set()).add(place[k])
        texts, lines, dropped, digest = [], [], [], []
        for i, raw in enumerate(raws):
            bad = gone.get(i, ())
            new = b"\n".join([line for j, line in enumerate(raw.split(b"\n")) if j not in bad]) if bad else raw
            texts.append(new.decode())
            lines.append(raw.count(b"\n") + 1)
            dropped.append(len(bad))
            digest.append(hashlib.sha256(new).hexdigest())
        cols = [*batch.columns[:width], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())]
        cols[at] = pc.if_else(batch.column(at).is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
        return pa.record_batch(cols, names)

    if often.count() <= most_keys:
        both = often.select("low", "high").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast([both.column(k).to_numpy().tobytes() for k in (0, 1)])

        def by_keys(batches):
            lows, highs = (np.frombuffer(x, np.int64) for x in shared.value)
            order = np.lexsort((highs, lows))
            lows, highs = lows[order], highs[order]

            def bad_of(low, high, row):
                first = np.searchsorted(lows, low)
                bad = np.zeros(len(low), bool)
                # equal low halves are next to each other, and hardly ever more than one
                while (more := first < len(lows)).any():
                    more[more] = lows[first[more]] == low[more]
                    if not more.any():
                        break
                    bad[more] |= highs[first[more]] == high[more]
                    first = np.where(more, first + 1, len(lows))
                return bad

            for batch in slices(batches, "text"):
                yield rewritten(batch, bad_of)

        return kept.mapInArrow(by_keys, out)

    ident, drop = free_name(kept.columns, "_of"), free_name(kept.columns, "_drop")
    found = cut_lineage(found)
    drops = lookup(found, often, ["low", "high"]).where("often").groupBy(F.col("doc_id").alias(ident)).agg(F.collect_set(F.struct("low", "high")).alias(drop))
    joined = kept.join(drops, F.col("doc_id").eqNullSafe(F.col(ident)), "left").drop(ident)

    def by_documents(batches):
        for batch in slices(batches, "text"):
            bad = [{(d["low"], d["high"]) for d in drop or ()} for drop in batch.column(batch.num_columns - 1).to_pylist()]
            yield rewritten(batch, lambda low, high, row, bad=bad: np.array([(a, b) in bad[i] for a, b, i in zip(low.tolist(), high.tolist(), row.tolist(), strict=True)], bool))

    return joined.mapInArrow(by_documents, out)
