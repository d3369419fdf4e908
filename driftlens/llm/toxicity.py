"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its pairs of neighbours and its
pairs with one word between, in ``BITS`` bits.  Training sees a bounded sample of labelled
rows (``SAMPLE``); its per-coordinate rates and L1 penalty leave few weights, which are
broadcast (``2**BITS`` floats at most, whatever the input).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import release, slices

BITS = 22
#: Most labelled rows that training reads; those of the least hashes of doc_id.
SAMPLE = 12_000
#: Most bytes of text that training reads; rows beyond them don't count.
SAMPLE_BYTES = 64_000_000
EPOCHS = 5
#: Texts of the sample that must hold a feature; rarer ones are left out of training.
INCLUDE = 3
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts one after another, where each text's begin and end); each text's are distinct.

    Words are parted by ASCII white space, their closing and opening marks and the case of
    ASCII letters don't count.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    coded = lists.flatten().dictionary_encode()
    words = pc.ascii_lower(pc.utf8_trim(coded.dictionary, ".,;:!?\"'()[]|")).to_pylist()
    unique = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(unique):
        return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
    h = unique[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    grams, owners = [h * _A], [owner]
    for gap, salt in ((1, _B), (2, _C)):
        same = owner[:-gap] == owner[gap:]
        grams.append(((h[:-gap] * salt) ^ (h[gap:] * _A + salt))[same] * _B)
        owners.append(owner[:-gap][same])
    # one number holds the text and the feature, so that a sort brings equal ones together
    both = (np.concatenate(owners).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(grams) >> np.uint64(64 - bits))
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    bounds = np.searchsorted(both, np.arange(len(ends), dtype=np.uint64) << np.uint64(bits))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), bounds


@dataclass
class Model:
    """Sparse weights: where they are, what they are; and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out

    def score(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        flat, bounds = features(texts, self.bits)
        total = np.concatenate([[0.0], np.cumsum(dense[flat])])
        z = np.clip(total[bounds[1:]] - total[bounds[:-1]] + self.bias, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 9)


def train(rows: list[np.ndarray], labels: list[int], slots: int, alpha: float = 8.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over ``rows``, each the distinct features of a text, below ``slots``; the bias has no penalty."""
    z, n = np.zeros(slots), np.zeros(slots)
    zb = nb = 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i], labels[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Model(at, w[at], -zb / ((beta + nb**0.5) / alpha + l2))


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of ``labels`` (doc_id, toxic), from rows that aren't held out.

    At most ``sample`` rows are read, those whose hashed doc_id is least, and of those so
    many as come to at most ``sample_bytes``, a longer text being passed over.  Null ids, null
    labels and repeated labels of an id beyond the largest don't count.  With no labelled
    row the model scores 0.5 less than that: no text is predicted toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    size = F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("size")
    chosen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), size).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    taken, room = [], sample_bytes
    for size in chosen.column("size").to_pylist():
        taken.append(size <= room)
        room -= size if taken[-1] else 0
    chosen = docs.sparkSession.createDataFrame(chosen.filter(pa.array(taken, pa.bool_())).select(["doc_id", "toxic"]))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def hashed(batches):
        for part in slices(batches, "text"):
            flat, bounds = features(part.column(2), bits)
            raw = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["doc_id", "toxic", "x"])

    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(hashed, "doc_id long, toxic int, x binary").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), -1.0, bits)
    order, labels_of = pc.sort_indices(rows.column("doc_id")).to_pylist(), rows.column("toxic").to_pylist()
    each = [np.frombuffer(v.as_buffer(), np.int32) for v in rows.column("x")]  # views, not copies
    often = np.zeros(1 << bits, np.uint8)
    for v in each:
        often[v] = np.minimum(often[v] + 1, INCLUDE)  # distinct within a text
    used = np.flatnonzero(often >= INCLUDE)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    x = [place[v] for v in each]
    x = [x[i][x[i] >= 0] for i in order]
    model = train(x, [labels_of[i] for i in order], len(used))
    del rows, each, x, place, often
    release()
    return Model(used[model.index], model.weight, model.bias, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    An empty or null text has the score that the bias alone gives.  Repeated rows are scored
    each, a null doc_id stays null (and its held_out too), other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.index.astype(np.int32), model.weight.astype(np.float32), float(model.bias), model.bits))

    def run(batches):
        index, weight, bias, bits = shared.value
        own = Model(index, weight, bias, bits)
        dense = own.dense()
        for part in slices(batches, "text"):
            s = own.score(part.column(1), dense)
            yield pa.record_batch([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.index.astype(np.int32), model.weight.astype(np.float32), float(model.bias), model.bits))
    at = docs.columns.index("text")

    def run(batches):
        own = Model(*shared.value)
        dense = own.dense()
        for part in slices(batches, "text"):
            yield part.filter(pa.array(own.score(part.column(at), dense) < 0.5))

    return docs.mapInArrow(run, docs.schema)
