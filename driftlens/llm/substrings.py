"""Exact removal of repeated byte strings, by bucket-pointer refinement over sampled suffixes.

Two documents hold the same ``least``-byte string only if they hold the same q-gram at the
place in it where q-gram identifiers are smallest.  So of each document's suffixes only
those *anchors* are sorted, about one in 14:

* initial buckets: anchors of the same q-gram.  A bucket of one document is done.
* refinement: the identifier of a longer string is made from the identifiers at an offset
  and at a later one (q-gram and q-gram give 2q bytes, those two give ``least`` bytes, two
  of those give an anchor's whole context, which is all strings that have this anchor).
  Sorting on it splits a bucket; the part of a smaller document settles the whole context.
* buckets that split are refined once more, to the strings of ``least`` bytes themselves.

Documents are packed into *slices* of some MB.  A slice sends its distinct identifiers,
packed, to the shard that sorts them, one entry for each however many documents hold it,
and gets one bit for each back.  So a passage that a third of all documents hold weighs as
much as the number of slices, no identifier is collected with its documents anywhere, and
the text itself is written once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import cut_lineage, release, slices

LEAST = 50
GRAM = 24
SLICE = 1_500_000
#: Anchors that a shard sorts at once, about.
SHARD = 1_000_000

#: Bytes of a slice that are looked at at once; only a text that is longer than a slice has more.
STEP = 4_000_000

_PLACE = 28  # bits of a place within a step
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _join(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The identifier of what ``a`` and ``b`` identify at an offset and at a later one."""
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xA0761D6478BD642F + salt)) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(salt))


class Slice:
    """The anchors of a slice: ``doc`` (number of the text), string starts ``low`` to ``high``, ``gram`` identifier."""

    def __init__(self, texts: list[bytes], least: int = LEAST, gram: int = GRAM, step: int = STEP):
        self.least, self.size = least, gram
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        empty = np.zeros(0, np.int64)
        self.low = self.high = self.doc = empty
        self.gram = self.grams = empty.astype(np.uint64)
        if len(raw) < least:
            return
        self.grams = np.empty(len(raw) - gram + 1, np.uint64)
        found = [self._anchors(raw, a, min(a + step, len(raw) - least + 1)) for a in range(0, len(raw) - least + 1, step)]
        self.low, self.high, self.doc, self.gram = (np.concatenate(x) for x in zip(*found, strict=True))

    def _anchors(self, raw: np.ndarray, begin: int, end: int):
        """Anchors of the starts from ``begin`` to ``end``; a longer slice than ``STEP`` is one very long text, and taken a part at a time."""
        least, gram = self.least, self.size
        raw = raw[begin : end + least - 1]
        n = len(raw) - gram + 1
        power = np.full(len(raw), _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * power, dtype=np.uint64)])
        grams = total[gram:] - total[:n]
        del total
        power[:] = _INVERSE
        power[0] = 1
        grams *= np.multiply.accumulate(power[:n], out=power[:n])
        del power
        grams = _mix(grams)
        self.grams[begin : begin + n] = grams
        # leftmost smallest identifier of each window: identifier above, place below
        wide = least - gram + 1
        mask = np.uint64((1 << _PLACE) - 1)
        best = (grams & ~mask) | np.arange(n, dtype=np.uint64)
        span = 1
        while span < wide:
            move = min(span, wide - span)
            best = np.minimum(best[:-move], best[move:])
            span += move
        at = (best & mask).astype(np.int32)
        del best
        start = np.arange(begin, end)
        first_doc = int(np.searchsorted(self.bounds, begin, "right")) - 1
        held = np.diff(np.clip(self.bounds[first_doc:], begin, end))
        doc = np.repeat(np.arange(first_doc, first_doc + len(held), dtype=np.int32), held)
        own = start + least <= self.bounds[doc + 1]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new & own)
        # a run's last start: the next run's start, or where the text's own starts end
        nxt = np.concatenate([np.flatnonzero(new), [len(at)]])
        last = begin + nxt[np.searchsorted(nxt, first, "right")] - 1
        last = np.minimum(last, self.bounds[doc[first] + 1] - least)
        return begin + first, last, doc[first].astype(np.int64), grams[at[first]]

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Identifiers of the ``least``-byte strings that start at ``at``, refined from the q-grams'."""
        g, q = self.grams, self.size
        if self.least <= 2 * q:
            return _join(g[at], g[at + self.least - q])
        two = _join(g[at], g[at + q])
        rest = self.least - 2 * q
        return _join(two, _join(g[at + rest], g[at + rest + q]))

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each anchor's context by 64 and by 16 more bits."""
        a, b = self.strings(self.low), self.strings(self.high)
        wide = (self.high - self.low).astype(np.uint64)
        return _join(a + wide, b, 1), (_join(b, a + wide, 2) >> np.uint64(48)).astype(np.uint16)


def _five(keys: np.ndarray) -> bytes:
    """The low 40 bits of each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _narrow(ids: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest takes; in eight where one is negative."""
    width = 8 if ids.min(initial=0) < 0 else max(1, -(-int(ids.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<i8").ravel()


def _sharded(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, which of ``keys``, sorted and distinct, it has)."""
    shard = ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


class Work:
    """A slice on its way through the rounds; every step follows from its texts and the bits that came back."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], shards: int, least: int, gram: int, step: int = STEP):
        self.shards = shards
        self.part = Slice(texts, least, gram, step)
        self.key, self.of = np.unique(self.part.gram, return_inverse=True)
        # gram identifiers that two documents of this very slice hold
        own = ids[self.part.doc].astype(np.int64)
        self.own = own
        self.local = self._differ(self.of, own, len(self.key))

    @staticmethod
    def _differ(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, group, value)
        np.maximum.at(high, group, value)
        return low < high

    def _bits(self, n: int, keys: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(n, bool)
        for s, which in _sharded(keys, self.shards):
            out[which] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=len(which)).astype(bool)
        return out

    def first(self):
        """Round 1: which q-grams do other slices hold?"""
        for s, which in _sharded(self.key, self.shards):
            yield 1, s, _five(self.key[which]), b"", b""

    def take_first(self, replies):
        again = self._bits(len(self.key), self.key, replies) | self.local
        self.open = np.flatnonzero(again[self.of])
        long, short = self.part.contexts()
        self.context, at, self.kind = np.unique(long[self.open], return_index=True, return_inverse=True)
        self.short = short[self.open][at]
        self.least_doc = np.full(len(self.context), np.iinfo(np.int64).max)
        np.minimum.at(self.least_doc, self.kind, self.own[self.open])
        self.again, self.gram_of = np.unique(self.part.gram[self.open], return_inverse=True)
        self.split = self._differ(self.gram_of, self.context[self.kind].view(np.int64), len(self.again))

    def second(self):
        """Round 2: does a smaller document hold the context?  Does the bucket have other contexts?"""
        for s, which in _sharded(self.context, self.shards):
            yield 2, s, self.context[which].tobytes(), self.short[which].tobytes(), _narrow(self.least_doc[which])
        one = np.zeros(len(self.again), np.uint64)
        one[self.gram_of] = self.context[self.kind]
        for s, which in _sharded(self.again, self.shards):
            yield 3, s, _five(self.again[which]), np.packbits(self.split[which]).tobytes(), _five(one[which])

    def take_second(self, smaller, split):
        smaller = self._bits(len(self.context), self.context, smaller)
        split = self._bits(len(self.again), self.again, split) | self.split
        self.done = smaller[self.kind] | (self.own[self.open] > self.least_doc[self.kind])
        rest = self.open[~self.done & split[self.gram_of]]
        count = self.part.high[rest] - self.part.low[rest] + 1
        self.start = np.repeat(self.part.low[rest] - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.start_doc = np.repeat(self.own[rest], count)
        strings = self.part.strings(self.start) if len(self.start) else np.zeros(0, np.uint64)
        self.string, at, self.string_of = np.unique(strings, return_index=True, return_inverse=True)
        again = _mix(self.part.grams[self.start[at]] + np.uint64(7)) if len(at) else np.zeros(0, np.uint64)
        self.string_short = (again >> np.uint64(48)).astype(np.uint16)
        self.string_doc = np.full(len(self.string), np.iinfo(np.int64).max)
        np.minimum.at(self.string_doc, self.string_of, self.start_doc)

    def third(self):
        """Round 3: does a smaller document hold the string?"""
        for s, which in _sharded(self.string, self.shards):
            yield 4, s, self.string[which].tobytes(), self.string_short[which].tobytes(), _narrow(self.string_doc[which])

    def covered(self, smaller) -> np.ndarray:
        """Which bytes of the slice go."""
        smaller = self._bits(len(self.string), self.string, smaller)
        starts = self.start[smaller[self.string_of] | (self.start_doc > self.string_doc[self.string_of])]
        edge = np.zeros(int(self.part.bounds[-1]) + 1, np.int32)
        full = self.open[self.done]
        np.add.at(edge, self.part.low[full], 1)
        np.add.at(edge, self.part.high[full] + self.part.least, -1)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.part.least, -1)
        return np.cumsum(edge)[:-1] > 0


def _sort_shard(table: pa.Table) -> pa.Table:
    """The bits that answer each slice's entries of one shard and round."""
    kind = table.column("kind")[0].as_py()
    rows = table.select(["slice", "key", "more", "doc"]).to_pylist()
    if kind in (1, 3):
        keys = [_unfive(r["key"]) for r in rows]
    else:
        keys = [np.frombuffer(r["key"], np.uint64) for r in rows]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    if kind == 1:
        _, of, n = np.unique(key, return_inverse=True, return_counts=True)
        bit = n[of] > 1
    elif kind == 3:
        _, of = np.unique(key, return_inverse=True)
        one = np.concatenate([_unfive(r["doc"]) for r in rows]).view(np.int64)
        split = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes, strict=True)])
        m = int(of.max()) + 1
        many = Work._differ(of, one, m)
        many[of[split]] = True
        bit = many[of]
    else:
        more = np.concatenate([np.frombuffer(r["more"], np.uint16) for r in rows])
        doc = np.concatenate([_wide(r["doc"], n) for r, n in zip(rows, sizes, strict=True)])
        order = np.lexsort((doc, more, key))
        k, x, d = key[order], more[order], doc[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        bit = np.zeros(len(key), bool)
        bit[order] = d > least
    cuts = np.cumsum(sizes)[:-1]
    return pa.table({
        "slice": pa.array([r["slice"] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()),
        "shard": table.column("shard").cast(pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in np.split(bit, cuts)], pa.binary()),
    })


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, slice_bytes: int = SLICE, step: int = STEP) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes
    that stay) and kept_text (those as text; characters that lost a part are left out).

    A byte goes if a string of ``least`` bytes covers it that also starts in a document of
    a smaller doc_id.  Empty, null and shorter texts lose nothing.  Rows of the same doc_id
    are the same document and take nothing from each other; a null doc_id comes after all
    others.  Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")

    def blobs(batches):
        """Slices as one compressed row each; written once, so that their numbers stay."""
        task, k = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.record_batch([pa.array([(task << 32) + k], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "size", "blob"])

        for part in slices(batches, "text", slice_bytes):
            more = pc.sum(pc.binary_length(part.column(at_text))).as_py() or 0
            if held and size + more > slice_bytes:
                yield out()
                k, held, size = k + 1, [], 0
            held.append(part)
            size += more
        if held:
            yield out()

    packed = docs.mapInArrow(blobs, "slice long, size long, blob binary")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a plan that is fixed beforehand tells how its rows are dealt, so that no round deals the slices again
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packed = cut_lineage(packed.repartition(parts, "slice").sortWithinPartitions("slice"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    total = packed.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) * 2 // ((least - gram + 2) * SHARD)))

    def opened(blob: bytes):
        table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
        ids = table.column(at_id).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
        return table, ids, [(t or "").encode() for t in table.column(at_text).to_pylist()]

    def through(blob, replies, rounds):
        table, ids, texts = opened(blob)
        work = Work(ids, texts, shards, least, gram, step)
        if rounds > 1:
            work.take_first(replies.get(1, {}))
        if rounds > 2:
            work.take_second(replies.get(2, {}), replies.get(3, {}))
        return table, texts, work

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                replies: dict[int, dict[int, bytes]] = {}
                for r in row.get("replies") or []:
                    replies.setdefault(r["kind"], {})[r["shard"]] = r["bits"]
                yield row.pop("slice"), row.pop("blob"), replies
                release()

    def asked(blob, replies, rounds):
        _, _, work = through(blob, replies, rounds)
        return list((work.first, work.second, work.third)[rounds - 1]())

    def sender(rounds):
        def send(batches):
            for number, blob, replies in rows_of(batches):
                rows = asked(blob, replies, rounds)
                if rows:
                    kind, shard, key, more, doc = zip(*rows, strict=True)
                    yield pa.record_batch(
                        [pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(key, pa.binary()), pa.array(more, pa.binary()), pa.array(doc, pa.binary())],
                        ["kind", "shard", "slice", "key", "more", "doc"],
                    )

        return send

    replies = None

    def with_replies():
        if replies is None:
            return packed.select("slice", "blob")
        per = replies.groupBy("slice").agg(F.collect_list(F.struct("kind", "shard", "bits")).alias("replies"))
        return packed.select("slice", "blob").join(per, "slice", "left")

    for rounds in (1, 2, 3):
        sent = with_replies().mapInArrow(sender(rounds), "kind int, shard int, slice long, key binary, more binary, doc binary")
        got = cut_lineage(sent.groupBy("kind", "shard").applyInArrow(_sort_shard, "slice long, kind int, shard int, bits binary"))
        replies = got if replies is None else replies.unionByName(got)

    def rewritten(blob, said) -> pa.Table:
        table, texts, work = through(blob, said, 3)
        gone = work.covered(said.get(4, {}))
        size, removed, spans, digest, kept = [], [], [], [], []
        for t, a, b in zip(texts, work.part.bounds[:-1].tolist(), work.part.bounds[1:].tolist(), strict=True):
            cover = gone[a:b]
            n = int(cover.sum())
            stay = np.frombuffer(t, np.uint8)[~cover].tobytes() if n else t
            size.append(b - a)
            removed.append(n)
            spans.append(int(np.count_nonzero(np.diff(cover.astype(np.int8), prepend=0) == 1)) if n else 0)
            digest.append(hashlib.sha256(stay).hexdigest())
            kept.append(stay)
        for name, values, kind in (("n_bytes", size, pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64()), ("kept_sha256", digest, pa.string()), ("kept", kept, pa.binary()), ("kept_text", [k.decode("utf-8", "ignore") for k in kept], pa.string())):
            table = table.append_column(name, pa.array(values, kind))
        return table

    def finish(batches):
        for _, blob, said in rows_of(batches):
            yield from rewritten(blob, said).to_batches()

    schema = docs.schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary").add("kept_text", "string")
    return with_replies().mapInArrow(finish, schema)
