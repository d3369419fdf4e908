"""Near-duplicate and repeat operators against brute force."""

import hashlib
import re

import numpy as np
import pytest


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def texts(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = (out[rng.integers(len(out))] or "").split(" ")
            for _ in range(rng.integers(0, 4)):
                if w:
                    w[rng.integers(len(w))] = str(rng.choice(words))
            out.append(" ".join(w) + ("\n" if rng.random() < 0.1 else ""))
        else:
            out.append(" ".join(rng.choice(words, rng.integers(0, 60))))
    return out + [None, "", " ", "one", "One", "two words", "a b c d e", "A b c d E"]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    from driftlens.llm.neardup import near_duplicates

    t = texts(seed)
    s = [shingles(x) for x in t]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    want = roots(len(t), links)
    df = spark.createDataFrame([(i, x, "k", 1) for i, x in enumerate(t)], "doc_id long, text string, component string, n int").repartition(6)
    got = near_duplicates(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(i, len(s[i]), want[i], want[i] == i) for i in range(len(t))]


def test_near_duplicate_blocks_and_chains(spark, monkeypatch):
    """Links between members that the hub of their bucket doesn't link with, over several blocks."""
    from driftlens.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "CHUNK", 2)
    base = [f"x{k}" for k in range(40)]
    docs = []
    for i in range(30):  # each shares 0.75 or more with the next, not with ones further on
        docs.append(" ".join(base))
        base = base[1:] + [f"y{i}"] if i % 2 else base[2:] + [f"y{i}", f"z{i}"]
    s = [shingles(x) for x in docs]
    links = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    want = roots(len(docs), links)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def test_near_duplicates_odd(spark):
    from driftlens.llm.neardup import near_duplicates

    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, None), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close():
    from driftlens.llm.neardup import estimate, registers

    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    errors = []
    for share in (0.3, 0.6, 0.9):
        n = int(4000 * share)
        b = np.concatenate([a[:n], rng.integers(0, 2**64, 4000 - n, dtype=np.uint64)])
        got, _ = estimate(registers(np.unique(a))[None], registers(np.unique(b)), np.array([4000]), 4000)
        errors.append(abs(got[0] - n / (8000 - n)))
    assert max(errors) < 0.12


def test_plausible_pairs_hold_all_links():
    from driftlens.llm.neardup import plausible, registers

    rng = np.random.default_rng(10)
    for size in (1, 3, 8, 30, 150, 900):
        missed = 0
        for _ in range(200):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            b = np.concatenate([a[: -(size // 8) or None], rng.integers(0, 2**64, size // 8, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            missed += not plausible(registers(a)[None], registers(b), np.array([len(a)]), len(b), 0.75)[0]
        assert missed <= 1


def covered(docs, least=50):
    first = {}
    for i, t in docs:
        for k in range(len(t) - least + 1):
            s = t[k : k + least]
            first[s] = min(first.get(s, 1 << 62), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if first[t[k : k + least]] < i:
                gone[k : k + least] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    from driftlens.llm.substrings import remove_repeats

    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdé "), rng.integers(1, 7))) for _ in range(40)]
    passages = [" ".join(rng.choice(words, rng.integers(5, 60))) for _ in range(6)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.integers(0, 6)):
            if rng.random() < 0.5:
                p = passages[rng.integers(6)]
                a = rng.integers(0, len(p) // 2 + 1)
                t += p[a : a + rng.integers(10, 200)]
            else:
                t += " ".join(rng.choice(words, rng.integers(1, 30)))
        if rng.random() < 0.2 and rows:
            t = rows[rng.integers(len(rows))][1]
        rows.append((i * 3, "a" * 200 if i % 20 == 7 else t))
    rows += [(1000, None), (1001, ""), (1002, "x" * 49), (1003, "x" * 49)]
    docs = [(i, (t or "").encode()) for i, t in rows]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, slice int").repartition(7)
    got = remove_repeats(df, slice_bytes=3000).orderBy("doc_id").collect()
    for r, (i, t), gone in zip(got, docs, covered(docs), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.slice) == (i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), 5)
        assert r.kept_text == kept.decode("utf-8", "ignore")


def test_repeats_of_texts_longer_than_a_slice(spark):
    """A text over a slice is taken in steps; runs that a step cuts find their likes in other texts."""
    from driftlens.llm import substrings

    rng = np.random.default_rng(9)
    made = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, other = made(400), made(900)
    rows = [(1, made(3000) + passage + made(2500) + other[:500]), (2, made(37) + passage), (3, made(10) + other + made(4000) + passage[100:300]), (4, other[200:800]), (5, made(2000))]
    docs = [(i, t.encode()) for i, t in rows]
    whole = [substrings.Slice([t for _, t in docs], step=s) for s in (1 << 20, 700)]
    assert np.array_equal(whole[0].grams, whole[1].grams) and len(whole[1].low) >= len(whole[0].low)
    work = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(work, slice_bytes=1000, step=700).orderBy("doc_id").collect()
    for r, (_, t), gone in zip(got, docs, covered(docs), strict=True):
        assert r.n_removed == int(gone.sum()) and r.kept == bytes(b for b, g in zip(t, gone, strict=True) if not g)


def test_repeats_odd(spark):
    from driftlens.llm.substrings import remove_repeats

    p = "".join(f"{k:x}" for k in range(60))
    rows = [(-5, p), (2, p), (2, p), (None, p)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, -5, 0), (False, 2, len(p)), (False, 2, len(p)), (True, 0, len(p))]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings(spark):
    from driftlens.llm.embeddings import near_vectors

    rng = np.random.default_rng(4)
    rows, group = [], rng.standard_normal(16)
    for i in range(400):
        if i % 3 == 0:
            v = group + 0.1 * rng.standard_normal(16)
        elif i % 3 == 1 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) * (1 if i % 2 else 2)
        else:
            v = rng.standard_normal(16)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    nan = float("nan")
    odd = [(400, None, 1), (401, [0.0] * 16, 1), (402, [nan] * 16, 1), (403, [1.0, None] * 8, 1), (404, rows[0][1], None), (405, [], 0), (406, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, links string").repartition(5)
    got = near_vectors(df, block=32).orderBy("vec_id").collect()
    links = []
    degree = [0] * 407
    for i in range(400):
        for j in range(i):
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
    want = roots(407, links)
    assert sum(r.n_links for r in got) >= 0.995 * sum(degree)
    assert all(r.n_links <= d for r, d in zip(got, degree, strict=True))
    assert [r.component_id for r in got] == want and [r.kept for r in got] == [w == i for i, w in enumerate(want)]
    assert near_vectors(df.limit(0)).count() == 0


def test_embeddings_at_the_threshold_and_repeated_ids(spark):
    from driftlens.llm.embeddings import near_vectors

    # 0.98 is not a double, so take vectors whose cosine in double precision is what we ask for
    a, b, c = [3.0, 4.0, 0.0], [4.0, 3.0, 0.0], [0.0, 0.0, 1.0]
    cosine = float(np.dot(a, b)) / (float(np.sqrt(np.dot(a, a))) * float(np.sqrt(np.dot(b, b))))
    df = spark.createDataFrame([(1, a, 0), (2, b, 0), (3, c, 0)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in near_vectors(df, least=cosine, tables=60, bits=1).orderBy("vec_id").collect()] == [1, 1, 0]
    assert [r.n_links for r in near_vectors(df, least=np.nextafter(cosine, 1), tables=60, bits=1).orderBy("vec_id").collect()] == [0, 0, 0]
    # 7 has two vectors of its own, near 2 and near 9; they make one component
    near = lambda v: [x + 0.01 for x in v]
    rows = [(2, a, 0), (7, near(a), 0), (7, near(c), 0), (9, c, 0), (9, c, 0), (8, b, 1), (None, a, 0)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(False, 2, 1, 2, True), (False, 7, 1, 2, False), (False, 7, 2, 2, False), (False, 9, 2, 2, False), (False, 9, 2, 2, False), (False, 8, 0, 8, True), (True, 0, 0, None, None)], key=str
    )


def test_components(spark):
    from driftlens.llm.common import components

    chain = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300)] + [(400, 400 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200, **{400 + k: 400 for k in range(40)}}


@pytest.fixture
def collections(monkeypatch):
    """Whether the driver was told to collect its garbage, a checkpoint each."""
    from driftlens.llm import common, neardup

    told, real = [], common.cut_lineage

    def counted(df, **more):
        told.append(more.get("free", True))
        return real(df, **more)

    monkeypatch.setattr(common, "cut_lineage", counted)
    monkeypatch.setattr(neardup, "cut_lineage", counted)
    return told


def test_components_collect_once_a_round(spark, collections):
    """Stars around their least nodes are found to be done at once; others cost one collection a round."""
    from driftlens.llm.common import components

    def of(edges):
        collections.clear()
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = roots(1 + max(max(e) for e in edges), edges)
        assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
        return len(collections), sum(collections)

    assert of([(0, 5), (7, 0), (0, 5), (2, 3), (4, 4)]) == (1, 1)
    rng = np.random.default_rng(3)
    for edges in ([(i, i + 1) for i in range(40)], [(9, k) for k in range(9)], rng.integers(0, 60, (45, 2)).tolist()):
        checkpoints, collected = of([tuple(e) for e in edges])
        assert collected == 1 + (checkpoints - 1) // 4


def test_near_duplicates_collect_little(spark, collections):
    """The driver isn't stopped for a collection after each small table."""
    from driftlens.llm.neardup import near_duplicates

    df = spark.createDataFrame(list(enumerate(texts(1))), "doc_id long, text string").repartition(6)
    near_duplicates(df).collect()
    assert sum(collections) <= 24 and sum(collections) < len(collections) / 2
