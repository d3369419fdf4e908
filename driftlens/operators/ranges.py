"""The ordered fold of one bucket by many tasks.

A line that changes no template leaves no trace, and few do change one.  So ranges of a
bucket's lines are folded side by side, each from a guess of the templates that stand
before it, and of each only its *events* are kept, the lines that changed something.  One
task a bucket goes through the events alone, in order, and so gets the templates before
each range: the next guess.  Only ranges whose guess has changed are folded again.  Where
none has, every range was folded from what the one before it left, which is the fold in
order.  The first guess is nothing; the second is mostly right.  After k rounds the first
k ranges are right whatever the lines, so it always ends.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators.lineage import durable
from driftlens.operators.mining import Bucket, Template, group_rows, out_batch

#: Line numbers of a range.
SPAN = 1 << 21
KEYS = ["bucket", "run_idx", "part"]
_EVENTS = "bucket string, run_idx int, part long, events binary"
_STATES = "bucket string, run_idx int, part long, state binary, mark string"


def _saved(now: Bucket) -> tuple[bytes, str]:
    """A bucket's templates, and a mark that is equal for equal ones."""
    rows = [(t.shown, t.shapes, t.words, t.attributes, t.run, t.line) for t in now.templates]
    return pickle.dumps([(*r, t.raw) for r, t in zip(rows, now.templates, strict=True)]), hashlib.md5(repr(rows).encode()).hexdigest()


def _restored(state: bytes | None, threshold: float) -> Bucket:
    now = Bucket(threshold)
    for shown, shapes, words, attributes, run, line, raw in pickle.loads(state) if state else ():
        now.enter(Template.known(shown, shapes, words, attributes, run, line, raw))
    return now


def _each_range(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[tuple, Bucket, tuple | None]]:
    """(key, bucket, chunk) of each chunk of each range in order; a range ends with no chunk."""
    key, now = None, None
    for b in batches:
        for bucket, run, part, base, lists, raws, codes, offsets, state in zip(*(iter(c) for c in b.columns), strict=True):
            own = bucket.as_py(), run.as_py(), part.as_py()
            if own != key:
                if now is not None:
                    yield key, now, None
                key, now = own, None
            if now is None:
                now = _restored(state.as_py(), threshold)
            if codes.is_valid:
                yield key, now, (own[1], base.as_py(), lists.as_py(), raws.as_py(), np.frombuffer(codes.as_buffer(), "<i4"), np.frombuffer(offsets.as_buffer(), "<i4"))
    if now is not None:
        yield key, now, None


def _events(threshold: float):
    def run(batches):
        known = None
        for key, now, chunk in _each_range(batches, threshold):
            if now is not known:
                known, now.events = now, []
            if chunk is not None:
                now.fold(*chunk)
            else:
                yield pa.record_batch([pa.array([v], k) for v, k in zip((*key, pickle.dumps(now.events)), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "run_idx", "part", "events"])

    return run


def _replayed(threshold: float):
    """The templates before each range of a bucket, and, without a range, those at its end."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())

    def row(*values):
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split(" ")[0] for f in _STATES.split(", ")])

    def run(batches):
        name, now = None, None
        for b in batches:
            for bucket, r, part, events in zip(*(iter(c) for c in b.columns), strict=True):
                if bucket.as_py() != name:
                    if now is not None:
                        yield row(name, None, None, *_saved(now))
                    name, now = bucket.as_py(), Bucket(threshold)
                yield row(name, r.as_py(), part.as_py(), *_saved(now))
                for event in pickle.loads(events.as_py()):
                    now.add(*event)
        if now is not None:
            yield row(name, None, None, *_saved(now))

    return run


def _final(threshold: float, groups: bool):
    def run(batches):
        for (bucket, _, _), now, chunk in _each_range(batches, threshold):
            if chunk is not None:
                out = now.fold(*chunk)
                if groups:
                    yield out_batch(group_rows(bucket, *chunk, out, now.templates))
            elif rows := [(None, None, None, t.count, None, None, None, t.run, t.line, bucket, None, None, None) for t in now.templates if t.count]:
                yield out_batch(rows)

    return run


def _templates(batches):
    for b in batches:
        for bucket, state in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if rows := [(None, None, None, 0, raw, shown, None, run, line, bucket, shapes, words, attributes) for shown, shapes, words, attributes, run, line, raw in pickle.loads(state)]:
                yield out_batch(rows)


def fold_by_ranges(packed: DataFrame, threshold: float, groups: bool, schema: str, span: int = SPAN) -> DataFrame:
    """What the fold of ``mining`` gives for chunk rows, without a task that gets all chunks of a bucket."""
    packed = durable(packed.withColumn("part", F.floor(F.col("base") / span)))

    def dealt(states: DataFrame | None, chosen: DataFrame | None) -> DataFrame:
        """Chunks range by range, each range's state first; only ranges that are ``chosen``."""
        rows = packed if chosen is None else packed.join(F.broadcast(chosen), KEYS, "left_semi")
        rows = rows.select(*KEYS, "base", "tokens", "raws", "codes", "offsets", F.lit(None).cast("binary").alias("state"))
        if states is not None:
            own = states.where("part IS NOT NULL") if chosen is None else states.join(F.broadcast(chosen), KEYS, "left_semi")
            rows = rows.unionByName(own.select(*KEYS, F.lit(-1).cast("long").alias("base"), "state"), allowMissingColumns=True)
        return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "base")

    states, chosen, events = None, None, None
    for _ in range(packed.select(*KEYS).distinct().count() + 2):
        found = dealt(states, chosen).mapInArrow(_events(threshold), _EVENTS)
        events = durable(found if chosen is None else events.join(F.broadcast(chosen), KEYS, "left_anti").unionByName(found))
        after = durable(events.repartition("bucket").sortWithinPartitions(*KEYS).mapInArrow(_replayed(threshold), _STATES))
        ranges = after.where("part IS NOT NULL")
        if states is None:
            changed = ranges.where(F.col("mark") != _saved(Bucket(threshold))[1])
        else:
            changed = ranges.join(states.select(*KEYS, F.col("mark").alias("_was")), KEYS).where("mark <> _was")
        states, chosen = after, durable(changed.select(*KEYS))
        if chosen.isEmpty():
            break
    else:
        raise RuntimeError("ranges still change")
    out = durable(dealt(states, None).mapInArrow(_final(threshold, groups), schema))
    counts = out.where("line_no IS NULL").groupBy("first_run", "first_line").agg(F.sum("n").alias("_n"))
    made = states.where("part IS NULL").select("bucket", "state").mapInArrow(_templates, schema).join(counts, ["first_run", "first_line"])
    return out.where("line_no IS NOT NULL").unionByName(made.withColumn("n", F.col("_n")).select(*out.columns))
