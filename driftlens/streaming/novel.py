"""Live lines that fit no template of the baselines.

The model is frozen, so the stream keeps no state: lines meet the templates of their own
bucket where they are read, or, where the model is large, in a stream-static join, and
those that none takes go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.config import THRESHOLD
from driftlens.functions.text import signature
from driftlens.functions.words import Lexicon
from driftlens.operators.joins import FEW
from driftlens.operators.mining import Bucket, Template, bucket_of, clusters

#: Bytes of templates that are sent to all tasks at most, and rows of tokens whose answer is remembered.
MODEL_BYTES, MEMO = 32_000_000, 100_000


def model(baselines: DataFrame, threshold: float = THRESHOLD, masks=()) -> DataFrame:
    """The templates of ``baselines`` as rows to match against: one row a bucket."""
    c = clusters(baselines, threshold, masks)
    return c.groupBy("bucket").agg(F.collect_list(F.struct("shapes", "words", "attributes")).alias("templates"))


class _Rows:
    """Batches of lines as distinct rows of tokens; a worker's words are begun afresh when they are many."""

    def __init__(self, masks):
        self.masks, self.words, self.memo = tuple(masks), Lexicon(masks), {}

    def distinct(self, raw: pa.Array) -> tuple[list[tuple[bytes, list[str]]], np.ndarray]:
        """(each distinct row's numbers and tokens; which of them each line has)."""
        if self.words.full():
            self.words, self.memo = Lexicon(self.masks), {}
        flat, start, size = self.words.read(pc.fill_null(raw, ""))
        first, which = self.words.alike(flat, start, size)
        return [(flat[s : s + n].tobytes(), flat[s : s + n].tolist()) for s, n in zip(start[first].tolist(), size[first].tolist(), strict=True)], which

    def tokens(self, row: list[int]) -> list[str]:
        return [self.words.tokens[k] for k in row]


def described(lines: DataFrame, masks=()) -> DataFrame:
    """All columns of ``lines`` (one is ``raw``) with the bucket, shapes and kinds of each line."""
    masks, at = tuple(masks), lines.columns.index("raw")

    def run(batches):
        rows = _Rows(masks)
        for b in batches:
            own, which = rows.distinct(b.column(at))
            tokens = [rows.tokens(r) for _, r in own]
            seen = [signature(t) for t in tokens]
            made = pa.array(map(bucket_of, tokens), pa.string()), pa.array([s[0] for s in seen], pa.list_(pa.string())), pa.array([s[2] for s in seen], pa.list_(pa.int32()))
            yield pa.record_batch([*b.columns, *(m.take(pa.array(which)) for m in made)], [*b.schema.names, "bucket", "line_shapes", "line_kinds"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, *T.StructType.fromDDL("bucket string, line_shapes array<string>, line_kinds array<int>").fields]))


class Frozen:
    """Templates that answer whether one of them takes a line, and never change."""

    def __init__(self, held: dict[str, list[tuple]], threshold: float, masks):
        self.held, self.threshold, self.rows = held, threshold, _Rows(masks)
        self.buckets: dict[str, Bucket] = {}  # made when first asked for

    def _bucket(self, name: str) -> Bucket:
        if name not in self.buckets:
            own = self.buckets[name] = Bucket(self.threshold)
            for shapes, words, attributes in self.held.get(name, ()):
                own.enter(Template.known((), shapes, words, attributes, 0, 0, None))
        return self.buckets[name]

    def taken(self, raw: pa.Array) -> np.ndarray:
        """Whether a template takes each of some lines."""
        own, which = self.rows.distinct(raw)
        memo, out = self.rows.memo, []
        if len(memo) >= MEMO:
            memo.clear()
        for key, row in own:
            known = memo.get(key)
            if known is None:
                tokens = self.rows.tokens(row)
                shapes, _, kinds, _ = signature(tokens)
                known = memo[key] = self._bucket(bucket_of(tokens)).best(shapes, kinds)[0] is not None
            out.append(known)
        return np.array(out, bool)[which]

    def takes(self, line: str) -> bool:
        return bool(self.taken(pa.array([line], pa.string()))[0])


def _held(templates: DataFrame) -> dict[str, list[tuple]]:
    return {r["bucket"]: [(t["shapes"], t["words"], t["attributes"]) for t in r["templates"]] for r in templates.toLocalIterator()}


def novel(lines: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, masks=()) -> DataFrame:
    """The rows of ``lines``, a batch or a stream, that fit no template; all their columns.

    Templates of at most ``MODEL_BYTES`` of text and ``FEW`` in number go to all tasks, which
    filter lines where they are read; of more, lines meet those of their bucket by a join.
    """
    size = F.aggregate("templates", F.lit(0), lambda n, t: n + F.octet_length(F.array_join(t["shapes"], " ", "")))
    count, total = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    if count <= FEW and total <= MODEL_BYTES:
        shared, at, own = lines.sparkSession.sparkContext.broadcast(_held(templates)), lines.columns.index("raw"), tuple(masks)

        def run(batches):
            frozen = Frozen(shared.value, threshold, own)
            for b in batches:
                if b.num_rows:
                    yield b.filter(pa.array(~frozen.taken(b.column(at))))

        return lines.mapInArrow(run, lines.schema)
    d = described(lines, masks).join(templates, "bucket", "left")
    agree = lambda kind: "aggregate(zip_with(zip_with(t.shapes, line_shapes, (a, b) -> a IS NOT NULL AND a = b), line_kinds, (s, k) -> s AND k = %d), 0, (n, x) -> n + int(x))" % kind
    same = "forall(zip_with(t.shapes, line_shapes, (a, b) -> a IS NULL OR a = b), x -> x)"
    score = f"CASE WHEN t.words > 0 THEN {agree(2)} / t.words WHEN t.attributes > 0 THEN {agree(1)} / t.attributes WHEN {same} THEN 1.0 ELSE 0.0 END"
    return d.where(F.expr(f"NOT coalesce(exists(templates, t -> {score} >= {threshold}), false)")).select(*lines.columns)


def live(source, templates: DataFrame, threshold: float = THRESHOLD, masks=()) -> Iterator[str]:
    """The novel ones of lines that come one by one, such as those of a pipe, each as soon as it is read.

    One pipe is read by one process, so this runs on the driver, which holds the templates;
    ``watch`` is for what comes as files.
    """
    frozen = Frozen(_held(templates), threshold, masks)
    for line in source:
        if not frozen.takes(line):
            yield line


def watch(spark, path: str, templates: DataFrame, threshold: float = THRESHOLD, masks=()):
    """A stream of the novel lines of files that come into ``path``."""
    live = spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace(F.make_valid_utf8("value"), r"[\r\n]+\z", "").alias("raw"))
    return novel(live, templates, threshold, masks)


def follow(spark, path: str, templates: DataFrame, out: str, checkpoint: str, threshold: float = THRESHOLD, masks=(), once: bool = False):
    """A running query that keeps the novel lines of files that come into ``path``, each once, as Parquet in ``out``.

    ``checkpoint`` remembers which files went into which batch.  A batch is written into a
    folder of its own number, whole or not at all, and one that was written but not noted as
    done before a crash is written over by the same rows; so no line is lost or kept twice.
    With ``once`` it ends when all files that are there have been read.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = watch(spark, path, templates, threshold, masks).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def followed(spark, out: str) -> DataFrame:
    """(raw, batch) of what ``follow`` has kept so far."""
    return spark.read.schema("raw string, batch long").option("basePath", out).parquet(out)
