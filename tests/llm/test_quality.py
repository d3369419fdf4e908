"""The quality network against plain versions: features, gradients, attention, held-out rows, odd cases."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.01"
ODD = [(1, "some plain words, more words."), (2, None), (3, ""), (4, " \t\n "), (5, "x" * 50_000), (6, "word " * 900), (6, "word " * 900), (None, "no id"), (7, "日本語 テキスト 😀"), (8, "ALL CAPS!! HERE!!")]
SCHEMA = "doc_id long, text string, score string, label int, n_passages int"


def plain_passages(text, size=64):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    k = max(1, math.ceil(len(words) / size))
    cuts = [i * len(words) // k for i in range(k + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_passages_are_the_plain_ones():
    from driftlens.llm.quality import FEATURES, passages

    texts = [t for _, t in ODD] + [" ".join(f"w{i % 7}" for i in range(n)) for n in (63, 64, 65, 129)]
    found = passages(pa.array(texts))
    want = [plain_passages(t) for t in texts]
    assert np.diff(found.cuts).tolist() == [len(p) for p in want]
    flat = [p for ps in want for p in ps]
    assert found.words.tolist() == [len(p) for p in flat] and found.rows.shape == (len(flat), FEATURES)
    for row, words in zip(found.rows, flat, strict=True):
        n = max(1, len(words))
        joined = "".join(words)
        assert row[0] == pytest.approx(math.log1p(len(words)))
        assert row[1] == pytest.approx(len(joined.encode()) / n)
        assert row[2] == pytest.approx(sum(w.isupper() and len([c for c in w if c.isalpha()]) > 1 for w in words) / n)
        chars = max(1, len(joined.encode()))
        assert row[7] == pytest.approx(sum("A" <= c <= "Z" for c in joined) / chars) and row[9] == pytest.approx(sum("0" <= c <= "9" for c in joined) / chars)
        assert row[14] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n)
        assert row[15] == pytest.approx(len(set(words)) / n) and row[16] == pytest.approx(max([words.count(w) for w in set(words)], default=0) / n)


def test_gradients_are_those_of_the_loss():
    from driftlens.llm.quality import Network

    r = np.random.default_rng(2)
    x, cuts, y, w = r.normal(size=(11, 6)), np.array([0, 1, 4, 9, 11]), np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 0.5, 1])
    net = Network.fresh(x)
    net.weights = {k: r.normal(size=v.shape) for k, v in net.weights.items()}

    def loss():
        p = net.forward(x, cuts)["score"]
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    for k, g in net.gradients(x, cuts, y, w).items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 12)]:
            keep = net.weights[k][at]
            net.weights[k][at] = keep + 1e-6
            up = loss()
            net.weights[k][at] = keep - 1e-6
            down = loss()
            net.weights[k][at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_forward_is_gated_attention():
    from driftlens.llm.quality import Network

    r = np.random.default_rng(4)
    x, cuts = r.normal(size=(7, 5)), np.array([0, 3, 4, 7])
    net = Network.fresh(x)
    p, f = net.weights, net.forward(x, cuts)
    for k in range(3):
        h = [np.tanh(v @ p["W"] + p["c"]) for v in x[cuts[k] : cuts[k + 1]]]
        e = np.array([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
        a = np.exp(e) / np.exp(e).sum()
        z = sum(w * v for w, v in zip(a, h, strict=True))
        assert f["score"][k] == pytest.approx(float(1 / (1 + np.exp(-(z @ p["u"] + p["b"]))[0])))
        assert f["a"][cuts[k] : cuts[k + 1]].tolist() == pytest.approx(a.tolist())


def test_held_out_rows_and_odd_ones(spark):
    from driftlens.llm.quality import fit, score

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = fit(docs, labels)
    rows = {r.doc_id: r for r in score(docs, net).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(truth[i], r.predicted) for i, r in rows.items() if r.held_out and i in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.top_passage < r.n_passages and 1 / r.n_passages - 1e-6 <= r.top_weight <= 1 for r in rows.values())
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in score(docs.repartition(3), fit(docs.repartition(5), flipped)).collect()}
    assert again == {i: r.score for i, r in rows.items()}

    odd = score(spark.createDataFrame([(i, t, "c", 1, 1) for i, t in ODD], SCHEMA), net).collect()
    assert len(odd) == len(ODD) and [r.score for r in odd if r.doc_id == 6] == [next(r.score for r in odd if r.doc_id == 6)] * 2
    blank = {r.score for r in odd if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1 and next(r for r in odd if r.doc_id is None).held_out is None
    assert next(r for r in odd if r.doc_id == 6).n_passages == 15
    empty = spark.createDataFrame([], SCHEMA)
    assert score(empty, net).count() == 0
    assert fit(empty, labels) is None and fit(docs, labels.limit(0)) is None
    assert {(r.score, r.predicted) for r in score(docs, None).collect()} == {(0.5, 1)}


def test_a_bound_of_the_sample_holds(spark):
    from driftlens.llm.quality import fit

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert fit(docs, labels, sample=20) is not None and fit(docs, labels, sample_bytes=0) is None
