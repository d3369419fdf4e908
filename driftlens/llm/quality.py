"""Quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label.  Every passage of the whole
text is encoded (shares of kinds of words and characters, repetition, hashed words; then a
layer), gated attention gives each passage its weight within the document, and the weighted
sum of the encoded passages is what is scored.  Attention, encoder and score are learned
together from the documents' labels on a bounded sample; the weights, a few thousand
numbers whatever the input, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import release, slices

#: Words of a passage at most.
PASSAGE = 64
#: Most labelled rows that training reads, those of the least hashes of doc_id; and most bytes of their texts.
SAMPLE, SAMPLE_BYTES = 8_000, 32_000_000
HASHED, ENCODED, GATES = 32, 24, 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.004, 1e-4

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "#$%&*+=<>@^_~|\\/{}[]")
_CLASS_OF = np.zeros((256, len(_CLASSES) + 1), np.float64)
for _k, _c in enumerate(_CLASSES):
    _CLASS_OF[[ord(x) for x in _c], _k] = 1
_CLASS_OF[0xC0:, -1] = 1  # first bytes of characters beyond ASCII
#: Features of a passage: its size, shares of kinds of words and of characters, repetition, hashed words.
FEATURES = 2 + 5 + len(_CLASSES) + 1 + 3 + HASHED


def _of_words(words: pa.Array) -> np.ndarray:
    """What is summed up over a passage's words: characters by class, bytes, and kinds of words."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    per = np.zeros((len(words), _CLASS_OF.shape[1]))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        for k in range(_CLASS_OF.shape[1]):
            per[filled, k] = np.add.reduceat(_CLASS_OF[data, k], offsets[filled])
    size = np.diff(offsets).astype(float)
    letters = per[:, 0] + per[:, 1] + per[:, -1]
    kind = lambda f: f(words).to_numpy(zero_copy_only=False)
    kinds = [kind(pc.utf8_is_upper) & (letters > 1), kind(pc.utf8_is_title), letters == 0, letters + per[:, 3] < size / 2, size <= 3]
    return np.column_stack([size, *kinds, per]).astype(float)


@dataclass
class Passages:
    """Feature rows of the passages of some texts, where each text's begin, and each passage's words."""

    rows: np.ndarray
    cuts: np.ndarray
    words: np.ndarray


def passages(texts: pa.Array, size: int = PASSAGE) -> Passages:
    """All passages of whole texts: words in their order, cut into as few even parts as have ``size`` words at most.

    Words are parted by ASCII white space.  A text without a word has one passage without any.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    keep = filled[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[ends - ends[0]]
    codes = codes[keep]
    count = np.diff(ends)
    parts = np.maximum(1, -(-count // size))
    cuts = np.concatenate([[0], np.cumsum(parts)])
    text_of = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(cuts[-1]) - cuts[text_of]
    begin = ends[text_of] + nth * count[text_of] // parts[text_of]
    n = np.diff(np.concatenate([begin, [ends[-1]]]))
    own = np.repeat(np.arange(len(n)), n)
    sums = np.zeros((len(n), 1 + 5 + _CLASS_OF.shape[1]))
    has = np.flatnonzero(n)
    repeats, distinct, most = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    hashed = np.zeros((len(n), HASHED))
    if len(has):
        per = _of_words(coded.dictionary)
        for k in range(sums.shape[1]):
            sums[has, k] = np.add.reduceat(per[:, k][codes], begin[has])
        same = (codes[1:] == codes[:-1]) & (own[1:] == own[:-1])
        repeats = np.bincount(own[1:], same, minlength=len(n))
        both = own.astype(np.int64) * len(per) + codes
        both.sort()
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        of = both[first] // len(per)
        distinct = np.bincount(of, minlength=len(n)).astype(float)
        np.maximum.at(most, of, np.diff(np.concatenate([first, [len(both)]])))
        plain = pc.utf8_lower(pc.utf8_trim(coded.dictionary, ".,;:!?\"'()[]|#$%&*")).to_pylist()
        h = np.fromiter(map(xxhash.xxh32_intdigest, plain), np.int64, len(plain))[codes]
        hashed = np.bincount(own * HASHED + h % HASHED, np.where(h >> 16 & 1, 1.0, -1.0), minlength=len(n) * HASHED).reshape(len(n), HASHED)
    words = np.maximum(n, 1)[:, None]
    chars = np.maximum(sums[:, :1], 1)
    rows = np.column_stack([np.log1p(n), sums[:, :1] / words, sums[:, 1:6] / words, sums[:, 6:] / chars, np.column_stack([repeats, distinct, most]) / words, hashed / np.sqrt(words)])
    return Passages(rows, cuts, n)


@dataclass
class Network:
    """Encoder, gated attention and score; ``mean`` and ``scale`` make features alike."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rows: np.ndarray, seed: int = 0) -> "Network":
        r = np.random.default_rng(seed)
        shape = {"W": (rows.shape[1], ENCODED), "c": (ENCODED,), "V": (ENCODED, GATES), "U": (ENCODED, GATES), "w": (GATES,), "u": (ENCODED,), "b": (1,)}
        weights = {k: np.zeros(s) if k in "cb" else r.normal(0, (1 / s[0]) ** 0.5, s) for k, s in shape.items()}
        return cls(rows.mean(0) if len(rows) else np.zeros(rows.shape[1]), np.maximum(rows.std(0), 1e-3) if len(rows) else np.ones(rows.shape[1]), weights)

    def alike(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
        """Everything on the way from features ``x`` to the documents' scores; document k has passages cuts[k] to cuts[k + 1]."""
        p = self.weights
        own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        h = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, cuts[:-1])[own])
        a = e / np.add.reduceat(e, cuts[:-1])[own]
        z = np.add.reduceat(a[:, None] * h, cuts[:-1])
        score = 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["b"], -30, 30)))
        return {"own": own, "h": h, "t": t, "s": s, "a": a, "z": z, "score": score}

    def gradients(self, x: np.ndarray, cuts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of the documents' labels."""
        p, f = self.weights, self.forward(x, cuts)
        own, h, t, s, a = f["own"], f["h"], f["t"], f["s"], f["a"]
        d = (f["score"] - labels) * weight / weight.sum()
        dz = d[:, None] * p["u"]
        da = (h * dz[own]).sum(1)
        de = a * (da - np.add.reduceat(a * da, cuts[:-1])[own])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dz[own] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "c": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "u": f["z"].T @ d, "b": d.sum(keepdims=True)}


def train(found: Passages, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Adam on batches of documents, each class with half of the weight."""
    net = Network.fresh(found.rows, seed)
    x, size = net.alike(found.rows), np.diff(found.cuts)
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    weight = 0.5 / np.maximum(share, 1e-9)
    first, second, step, r = {k: 0.0 for k in net.weights}, {k: 0.0 for k in net.weights}, 0, np.random.default_rng(seed)
    for epoch in range(epochs):
        order = r.permutation(len(labels))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            cuts = np.concatenate([[0], np.cumsum(size[docs])])
            rows = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - found.cuts[docs], size[docs])
            step += 1
            for k, g in net.gradients(x[rows], cuts, labels[docs], weight[docs]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] * (1 - rate * DECAY) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network of ``labels`` (doc_id, quality), from rows that aren't held out; None where there is no such row.

    At most ``sample`` rows are read, those whose hashed doc_id is least, and of those so
    many as come to at most ``sample_bytes``, a longer text being passed over.  Null ids and
    labels don't count; of several labels of an id the largest does, of several texts all do.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    ordered = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*ordered).limit(sample)
    size = F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("size")
    sized = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), size).orderBy(*ordered).toArrow()
    taken, room = [], sample_bytes
    for n in sized.column("size").to_pylist():
        taken.append(n <= room)
        room -= n if taken[-1] else 0
    wanted = docs.sparkSession.createDataFrame(sized.filter(pa.array(taken, pa.bool_())).select(["doc_id", "label"]))

    def encoded(batches):
        for part in slices(batches, "text"):
            found = passages(part.column(2))
            rows = found.rows.astype(np.float32)
            raw = [rows[a:b].tobytes() for a, b in zip(found.cuts, found.cuts[1:], strict=False)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["doc_id", "label", "x"])

    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text").mapInArrow(encoded, "doc_id long, label int, x binary").toArrow()
    if not got.num_rows:
        return None
    got = got.combine_chunks().sort_by([("doc_id", "ascending"), ("x", "ascending")])  # the same whatever the partitions
    each = [np.frombuffer(v.as_buffer(), np.float32).reshape(-1, FEATURES) for v in got.column("x")]
    rows = np.concatenate(each).astype(np.float64)
    found = Passages(rows, np.concatenate([[0], np.cumsum([len(v) for v in each])]), np.zeros(0))
    net = train(found, got.column("label").to_numpy().astype(float))
    del got, each, rows, found
    release()
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage, top_weight) of every row of ``docs``.

    ``top_passage`` is the passage (from 0) with the greatest attention, the first of equals,
    and ``top_weight`` that.  An empty, blank or null text is one passage without words and
    is scored as such.  Without a network every score is 0.5.  Repeated rows are scored
    each, a null doc_id stays null (and its held_out too), other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "text"):
            found = passages(part.column(1))
            n = np.diff(found.cuts)
            if own is None:
                value, top, weight = np.full(len(n), 0.5), np.zeros(len(n), np.int64), 1 / n
            else:
                f = own.forward(own.alike(found.rows), found.cuts)
                value = np.round(f["score"], 9)
                weight = np.maximum.reduceat(f["a"], found.cuts[:-1])
                is_top = np.flatnonzero(f["a"] == weight[f["own"]])
                top = is_top[np.searchsorted(is_top, found.cuts[:-1])] - found.cuts[:-1]
            yield pa.record_batch(
                [part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(top, pa.int64()), pa.array(np.round(weight, 9))],
                ["doc_id", "score", "predicted", "n_passages", "top_passage", "top_weight"],
            )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, n_passages long, top_passage long, top_weight double"
    )
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "top_passage", "top_weight")
