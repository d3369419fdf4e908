"""The fold of one bucket by many tasks, the index of templates, and lines read word by word."""

import random

import pyarrow as pa
import pytest

from driftlens.functions.text import tokenize
from driftlens.functions.words import Lexicon
from driftlens.operators import mining, ranges
from driftlens.operators.mining import Bucket, bucket_of, clusters, mine
from tests.test_engine import in_order, lines


@pytest.mark.parametrize("seed, threshold", [(1, 0.5), (2, 0.8), (3, 0.3), (4, 1.0)])
def test_ranges_give_the_fold_in_order(spark, seed, threshold, monkeypatch):
    """One bucket over 8 ranges and more, with templates that change all along; the plan has no task that gets it all."""
    r = random.Random(seed)
    words = [chr(97 + i) * 3 for i in range(4 + 4 * seed)]
    runs = [[f"go {r.choice(words[: 3 + k // 40])} {r.choice(words)} {r.choice(words[:5])} {r.choice('ab')}" for k in range(150)] for _ in range(2)]
    texts = runs[0] + runs[1]
    spans = []
    whole = ranges.fold_by_ranges

    def short(packed, threshold, groups, schema):
        spans.append(packed.selectExpr("floor(base / 16) AS part", "run_idx").distinct().count())
        return whole(packed, threshold, groups, schema, span=16)

    monkeypatch.setattr(ranges, "fold_by_ranges", short)
    got = mine(lines(spark, *runs), threshold, size=5, limit=20)
    assert [g.cid for g in got.assigned.orderBy("run_idx", "line_no").collect()] == in_order(texts, threshold)
    assert spans and spans[0] >= 8
    plain = mine(lines(spark, *runs), threshold)
    shown = lambda m: sorted((c.cid, c.template, c["count"], c.first_run, c.first_line_no, c.first_raw, c.shapes, c.words, c.attributes) for c in m.collect())
    assert shown(got.clusters) == shown(plain.clusters) == shown(clusters(lines(spark, *runs), threshold, size=5, limit=20))


def test_only_large_buckets_go_by_ranges(spark, monkeypatch):
    r = random.Random(9)
    texts = [r.choice(["go far now", "go near", "stop there", "", "k=1", "k=2 v=3", "12 7"]) + f" {r.choice('xyz')}" * r.randrange(2) for _ in range(300)]
    whole, seen = ranges.fold_by_ranges, []

    def noted(packed, *rest):
        seen.extend(sorted(x.bucket for x in packed.select("bucket").distinct().collect()))
        return whole(packed, *rest, span=32)

    monkeypatch.setattr(ranges, "fold_by_ranges", noted)
    got = mine(lines(spark, texts), 0.5, size=20, limit=30)
    assert [g.cid for g in got.assigned.orderBy("line_no").collect()] == in_order(texts)
    assert 0 < len(seen) < len({bucket_of(tokenize(t)) for t in texts})


@pytest.mark.parametrize("seed", range(12))
def test_the_index_finds_what_comparing_with_all_finds(seed):
    r = random.Random(seed)
    words = [f"w{chr(97 + i)}x" for i in range(r.choice([3, 8, 30]))] + ["k=1", "k=2", "j=x", "12", "7", "--"]
    n, threshold = r.choice([1, 3, 6]), r.choice([0.3, 0.5, 0.7, 0.8, 1.0])
    texts = [("go " if r.random() < 0.7 else "") + " ".join(r.choice(words) for _ in range(n)) for _ in range(500)]
    buckets, ids, got = {}, {}, []
    for i, t in enumerate(texts):
        tokens = tokenize(t)
        name = bucket_of(tokens)
        k, _ = buckets.setdefault(name, Bucket(threshold)).add(tokens, 0, i, t)
        got.append(ids.setdefault((name, k), len(ids)))
    assert got == in_order(texts, threshold)


def test_many_templates_of_one_bucket():
    """20,000 templates; comparing with all would take minutes."""
    import time

    r, b = random.Random(1), Bucket(0.5)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}q" for i in range(5000)]
    rows = [["go", "at", *(r.choice(words) for _ in range(6))] for _ in range(20_000)]
    began = time.process_time()
    for i, x in enumerate(rows):
        b.add(x, 0, i, "")
    assert len(b.templates) > 19_000 and time.process_time() - began < 10


BITS = [
    "2024-01-15", "10:23:45", "2024-01-15T10:23:45.123Z", "2024-01-15 10:23:45,5", "01/15/2024", "Jan", "15", "Sun", "Dec", "04", "2005", "Sun,", "GMT", "04/Dec/2005:04:47:44", "+0000", "12", "ms", "s,", "5s", "3.4",
    "KB/s", "10.0.0.1", "10.0.0.1:80", "[::1]:80", "[abc", "def]", "[a b c]", "[x]", 'k="two words"', 'k="one"', 'k="open', 'close"', "....F", "[", "12%]", "INFO", "-", ":", "- -", '{"a":1}', "{", "stdout", "F", "Foo",
    "host", "proc[12]:", "a@b.co", "/tmp/x", "/var/tmp/y z", "0xdead", "deadbeef1", "1234567", "1700000000", "12345", "v1.2.3", "\t", "  ", "é", "déjà", "µs", "日本", "http://u:p@h/x?q=1", "s3://b/12/abcdef1", "Market",
    "May", "\x1b[31m", "a=b", '="x"', '"', "x[1][2", "]]", "[[a]b", "~", "12:34:56", "1:02", "h", "d.", "B)", "...", " ", "", "25.3.4.300", "1.2.3.4.5", "0x", "5x12", "1234567890123", "2234567890", "1a2b3c4d5",
    "12345ms", "v12-345", "99%", "512KiB", "3fa9b2c1:80", "dead-beef-1234567", "aDec", "feedDec", "\x0b", "\x85",
]


@pytest.mark.parametrize("seed", range(6))
def test_words_make_the_tokens_of_whole_lines(seed):
    from driftlens.config import CustomMask

    r = random.Random(seed)
    masks = (CustomMask.inline("[a-z]+=b"), CustomMask.from_line("odd=Ma")) if seed == 5 else ()

    def line():
        head = r.choice(["", "", "2024-01-15T10:23:45Z ", "2024-01-15 10:23:45 - ", "Jan 15 10:23:45 ", " "])
        return head + r.choice([" ", " ", " ", "  ", ""]).join(r.choice(BITS) for _ in range(r.randrange(0, 9)))

    words = Lexicon(masks)
    for _ in range(60):
        texts = [line() for _ in range(50)]
        read = words.read(pa.array(texts, pa.string()))
        want = [tokenize(t, masks) for t in texts]
        assert [words.list_of(read[0], s, n) for s, n in zip(read[1].tolist(), read[2].tolist(), strict=True)] == want
        first, which = words.alike(*read)
        seen: dict[tuple, int] = {}
        assert which.tolist() == [seen.setdefault(tuple(t), len(seen)) for t in want]
        assert first.tolist() == [[tuple(t) for t in want].index(t) for t in seen]


def test_equal_sums_are_told_apart():
    """Rows are compared by a sum first; where sums lie, by their tokens."""
    words = Lexicon()
    read = words.read(pa.array(["red blue", "blue red", "red blue", "red", ""]))
    words.hashes[:] = 0
    first, which = words.alike(*read)
    assert which.tolist() == [0, 1, 0, 2, 3] and first.tolist() == [0, 1, 3, 4]


def test_a_full_lexicon_is_begun_afresh(spark, monkeypatch):
    texts = [f"user u{chr(97 + k % 26)}{chr(97 + k // 26)} came by" for k in range(300)]
    monkeypatch.setattr("driftlens.functions.words.WORDS", 50)
    assert [g.cid for g in mine(lines(spark, texts)).assigned.orderBy("line_no").collect()] == in_order(texts)
    assert mining.CHUNK == 65_536
