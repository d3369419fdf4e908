"""Words and overlapping chunks against the library on all of Unicode's letters and on hostile mixtures."""

import random
import unicodedata
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

#: Letters that come apart, marks, composed and uncomposed forms, spaces, contractions, special strings and cuts of them.
BITS = [
    "İ", "क़", "a", "B", "é", "é", "́", "ß", "Σ", "ΑΣ", "ς", "'s", "'ll", "1", "²", "½", "_", "-", ",", ".", "!", "?", ";", ":", "日", "本", "😀", "👩‍👩‍👧", "<|endoftext|>", "<|", "|>", " ", "  ", "\n",
    " ", " ", ";", "Å", "ﬁ", "ǅ", "ก", "ำ", "가", "각", "가", "~", " ~ ", "‍", "﻿", "K", "Ω", "word", " the ", "nation",
]


@pytest.fixture(scope="module")
def coder():
    from driftlens.llm.tokens import WordCoder

    return WordCoder(P.path("word_bpe_49k.json"), memo=10**7)


@pytest.mark.parametrize("mark", ",.;:!?")
def test_every_letter_before_a_mark(coder, mark):
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] in "LMN" and not (0x3400 < i < 0x9F00 or 0xAC00 < i < 0xD7A0 or i > 0x1F000)]
    words = [c + mark for c in letters] + ["a" + c + mark + mark for c in letters]
    for w, got, want in zip(words, coder.words(words), coder.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, np.uint16).tolist() == want.ids, w


def test_mixed_scripts(coder):
    r = random.Random(1)
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(1, 25))) for _ in range(4000)]
    ids, ends = coder.ids(pa.array(texts))
    want = coder.library.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [e.ids for e in want]


@pytest.mark.parametrize("chunk, overlap, run", [(20, 5, 3), (50, 10, 3), (64, 32, 8), (200, 20, 8)])
def test_hostile_texts_splice_to_the_whole(coder, chunk, overlap, run):
    from driftlens.llm.tokens import chunked_ids, word_ends

    r, ends = random.Random(chunk), word_ends(coder.library)
    for _ in range(250):
        text = "".join(r.choice(BITS) for _ in range(r.randrange(1, 300)))
        assert [i for part in chunked_ids(coder.library, text, chunk, overlap, ends, run) for i in part] == coder.library.encode(text, add_special_tokens=False).ids, text


def test_overlaps_are_encoded_twice_and_widened(coder, monkeypatch):
    from driftlens.llm import tokens

    seen = []
    whole = tokens.Encoded.__init__

    def noted(self, library, text, begin, end):
        seen.append((begin, end))
        whole(self, library, text, begin, end)

    monkeypatch.setattr(tokens.Encoded, "__init__", noted)
    text = "some words of a text " * 100
    parts = list(tokens.chunked_ids(coder.library, text, 400, 100))
    assert [i for p in parts for i in p] == coder.library.encode(text, add_special_tokens=False).ids and len(parts) > 5
    assert all(b[0] == a[1] - 100 for a, b in zip(seen, seen[1:], strict=False))
    seen.clear()
    text = "some words " * 30 + "x" * 250 + " and more words" * 60
    assert [i for p in tokens.chunked_ids(coder.library, text, 400, 20) for i in p] == coder.library.encode(text, add_special_tokens=False).ids
    assert any(b[0] < a[1] - 20 for a, b in zip(seen, seen[1:], strict=False))


def test_huge_texts_without_a_space(coder):
    from driftlens.llm.tokens import chunked_ids

    for text in ("x" * 70_000, "日本語" * 15_000, "a" * 300 + " b" * 30_000):
        assert [i for p in chunked_ids(coder.library, text) for i in p] == coder.library.encode(text, add_special_tokens=False).ids


def fewest(lengths: tuple[int, ...], capacity: int) -> int:
    """The least number of sequences, by trying all ways."""

    @cache
    def rest(left: tuple[int, ...], room: int) -> int:
        if not left:
            return 0
        best = None
        for k, x in enumerate(left):
            if k and x == left[k - 1]:
                continue
            more = left[:k] + left[k + 1 :]
            n = rest(more, room - x) if x <= room else 1 + rest(more, capacity - x)
            best = n if best is None or n < best else best
        return best

    return rest(tuple(sorted(lengths)), 0)


def test_packing_is_near_the_optimum_of_small_ones():
    from driftlens.llm.packing import sum_of_squares

    assert fewest((5, 5, 5), 10) == 2 and len(list(permutations(range(3)))) == 6
    r, over = random.Random(7), 0
    for _ in range(120):
        lengths = sorted((r.randrange(1, 17) for _ in range(r.randrange(1, 9))), reverse=True)
        which, offset = sum_of_squares(np.array(lengths), 16)
        used = len(set(which.tolist()))
        assert all(o + n <= 16 for o, n in zip(offset.tolist(), lengths, strict=True))
        best = fewest(tuple(lengths), 16)
        assert best <= used <= best + 1
        over += used - best
    assert over <= 4
