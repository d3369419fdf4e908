"""Embeddings in large buckets and at the threshold, against all cosines."""

import numpy as np
import pytest


def brute(x, least):
    n = x / np.linalg.norm(x, axis=1)[:, None]
    c = n @ n.T
    np.fill_diagonal(c, 0)
    return c >= least


def components_of(links):
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def test_more_classes_in_a_bucket_than_a_block(spark):
    """2,300 different vectors about one place share all buckets, so each goes to several pairs of blocks."""
    from driftlens.llm.embeddings import BLOCK, near_vectors

    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((2300, 16)) + r.normal(0, 1e-4, (2300, 16)), r.normal(0, 1, (200, 16))])
    assert len(x) > 2 * BLOCK
    links = brute(x, 0.98)
    df = spark.createDataFrame([(k, v.tolist(), 7) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(6)
    got = near_vectors(df).orderBy("vec_id").collect()
    assert [g.n_links for g in got] == links.sum(1).tolist() and got[5].n_links >= 2299
    assert [g.component_id for g in got] == components_of(links).tolist()


def test_recall_with_the_cut_of_signs(spark):
    """Pairs whose cosines lie just above the threshold, where tables and signs lose most; none below it is linked."""
    from driftlens.llm.embeddings import near_vectors

    r = np.random.default_rng(5)
    base = r.normal(0, 1, (1500, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = r.normal(0, 1, base.shape)
    off -= (off * base).sum(1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    c = r.uniform(0.9795, 0.983, 1500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * off])
    links = brute(x, 0.98)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = np.array([g.n_links for g in near_vectors(df).orderBy("vec_id").collect()])
    want = links.sum(1)
    assert want.sum() > 2000 and (got <= want).all()
    recall = got.sum() / want.sum()
    print(f"recall {recall:.5f} of {want.sum() // 2} links")
    assert recall >= 0.995


@pytest.mark.parametrize("one_sided", [True, False])
def test_pairs_of_signs(one_sided):
    from driftlens.llm.embeddings import APART, _first_shared

    r = np.random.default_rng(9)
    sigs = r.integers(0, 1 << 12, (700, 14)).astype(np.uint16)
    sigs[350:] = sigs[:350] ^ (r.random((350, 14)) < 0.12).astype(np.uint16)
    sigs[r.random(700) < 0.5, 2] = 5
    left, right = (np.arange(700), None) if one_sided else (np.arange(0, 300), np.arange(300, 700))
    hit = np.zeros(700, bool)
    for k, i in enumerate(left):
        for j in left[k + 1 :] if right is None else right:
            if bin(int.from_bytes((sigs[i] ^ sigs[j]).tobytes(), "little")).count("1") <= APART and (sigs[i, :2] != sigs[j, :2]).all():
                hit[[i, j]] = True
    assert hit.any() and _first_shared(sigs, left, right, 2).tolist() == hit.tolist()
