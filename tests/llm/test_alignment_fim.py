"""Tokenizer alignment and fill-in-the-middle against plain versions, and their odd cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

ODD = [
    (1, "plain text of some words, more words."), (2, None), (3, ""), (4, "a <|endoftext|> b <s> </s> <unk> c"), (5, "É.,x it's I'LL x...  .. İIi ǅ.ΑΣ"), (6, "word " * 3000), (6, "word " * 3000),
    (7, "x" * 20_000), (None, "no id"), (8, "a\n\nb\n"), (9, " \t\x0b\r\n"), (10, "日本語 テキスト 😀"), (11, "mark ▁ of its own"), (12, " leading"), (13, "ends in space "), (14, "ﬁ ½ ①"), (15, "one"),
]
SCHEMA = "doc_id long, text string, n long, output string, links string, form string, _row int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "clash", "clash", "clash", 1) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, *((x is None, x) for x in r))


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(letter[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([b.id_to_piece(i) and int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = (" " + text).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            docs.append((doc_id, 0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        links = [(x, y) for x, e in zip(ia, ends_a, strict=True) for y, f in zip(ib, ends_b, strict=True) if e == f]
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(i) for i, e in zip(ia, ends_a, strict=True) if last < e <= cut) + "|" + ",".join(str(i) for i, e in zip(ib, ends_b, strict=True) if last < e <= cut))
            last = cut
        counts.update(links)
        docs.append((doc_id, len(ia), len(ib), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (i, x, y, len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for i, x, y, g, links in docs
    ]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def short(rows):
    """Without the texts that the plain version takes too long for."""
    return [(i, t) for i, t in rows if not t or len(t) < 2000]


@pytest.mark.parametrize("few", [10**6, 0])
def test_alignment_is_the_plain_one(spark, empty, few):
    from driftlens.llm.alignment import alignment

    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    r = random.Random(3)
    rows = short(ODD) + [(100 + k, "".join(r.choice(["the ", "Nation", "é", "ß ", "  ", "\n", "123", ".,", "日本", "x", "'s", "ing ", "tion"]) for _ in range(r.randrange(1, 120)))) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "c", "c", "c", 1) for i, t in rows], SCHEMA)
    got = sorted((tuple(x) for x in alignment(docs, a, b, few).select(*NAMES).collect()), key=key)
    assert got == sorted(plain_alignment(rows), key=key)
    assert alignment(empty, a, b, few).count() == 0


def test_long_texts_are_aligned_whole(odd):
    from driftlens.llm.alignment import align

    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    got = {(x.doc_id, x.n_links): x for x in align(odd, a, b).collect()}
    assert all(len(x.links) == 4 * x.n_links and x.n_links == x.n_groups for x in got.values())
    longest = next(x for x in got.values() if x.doc_id == 6)
    assert longest.n_a > 3000 and longest.n_groups >= 3000


def test_bitsets_rank_and_select():
    from driftlens.llm.alignment import Bitset

    r = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        at = np.unique(r.integers(0, size, size // 2 + 1))
        bits = Bitset.of(at, size)
        every = np.arange(size)
        assert bits.select().tolist() == at.tolist()
        assert bits.rank(every).tolist() == np.searchsorted(at, every, side="right").tolist()


# ---------------------------------------------------------------- fill in the middle

UNIT = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def plain_fim(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_is_the_plain_one_and_comes_back(spark, odd, empty):
    from pyspark.sql import functions as F

    from driftlens.llm.fim import fill_in_middle, restored

    r = random.Random(5)
    rows = [(i, t) for i, t in ODD] + [(200 + k, "".join(r.choice([" ", "\n", "\t", "a", "éé", "日", "word", "<", "P>", "S>", " ", " "]) for _ in range(r.randrange(0, 3000)))) for k in range(200)]
    rows += [(1000, "has <M> inside"), (1001, "has <P> inside"), (1002, "y " * 200_000), (1003, "z" * 300_000 + " tail ")]
    docs = spark.createDataFrame([(i, t, 1, "c", "c", "c", 1) for i, t in rows], SCHEMA)
    made = fill_in_middle(docs)
    got = sorted((tuple(x) for x in made.collect()), key=key)
    assert got == sorted((plain_fim(i, t) for i, t in rows), key=key)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(x) for x in back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fill_in_middle(empty).count() == 0
    assert all(x.form != "plain" for x in fill_in_middle(docs.where("doc_id = 1"), rate=100).collect())


@pytest.mark.parametrize("every, block", [(1, 7), (3, 16), (256, 1 << 16)])
def test_every_cut_is_found_from_its_checkpoint(every, block):
    from driftlens.llm.fim import checkpoints, cut_after

    r = random.Random(every)
    for _ in range(50):
        text = "".join(r.choice([" ", "\n", "a", "é", "日本", "😀"]) for _ in range(r.randrange(0, 80)))
        units, raw = UNIT.findall(text), text.encode()
        index = checkpoints(np.frombuffer(raw, np.uint8), every, block)
        assert index.total == len(units) and len(index.units) <= len(units) // every + 1
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert cut_after(raw, index, k) == (len(head.encode()), len(head))
