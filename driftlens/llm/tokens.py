"""Token ids and token counts of the library behind ``word_bpe_49k.json``.

**Whole words.**  The tokenizer's pre-tokenizer never joins characters across white space,
its normalizer turns every run of white space into one space and composes and lowers what
stands between, and no special token holds white space.  So the ids of a text are those of
its words, in order, and ``WordCoder`` encodes each distinct word of a slice once.  Within a
word, closing marks are taken off only behind a character that is still a letter once it is
composed and lowered: some letters come apart into a letter and a mark, and marks join
what follows.

**Huge documents** are encoded in overlapping chunks with offsets.  In an overlap, tokens of
both chunks that have the same offsets and id make runs; the longest one is spliced behind
a token that ends a word in both, near the run's middle.  There both have come to the same
state: the pre-tokenizer looks ahead only, so from a common end of a word on it goes on
alike, and what a chunk's cut spoils lies at the outer ends of the overlap.  Where the
longest run is short or ends no word, the overlap is widened, and then the chunk.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from unicodedata import category, is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import SLICE_BYTES, slices

#: Distinct words that a worker remembers (some 40 MB); it starts afresh when it has more.
MEMO = 300_000
#: A text of more characters than this is encoded in overlapping chunks.
HUGE = 32_768
CHUNK, OVERLAP = 16_384, 512
#: Tokens that two chunks must have in common one after another to be spliced.
RUN = 8

_coders: dict[str, "WordCoder"] = {}


def _ends_in_letter(word: str) -> bool:
    """Whether the last character is a letter as the normalizer leaves it (``İ`` becomes ``i`` and a mark)."""
    return category(normalize("NFC", word)[-1].lower()[-1])[0] == "L"


class WordCoder:
    """Ids of texts by way of their distinct words."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[str, bytes] = {}
        self.limit = memo
        # the byte-level alphabet: bytes without a letter of their own are numbered from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes_as_letters = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        (self.mark,) = self.library.encode("~", add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> "WordCoder":
        """The worker's own coder of this vocabulary; loaded once a worker."""
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 16-bit numbers (the vocabulary has fewer than 65,536).

        Closing marks after what is normalized to a letter are a pre-token of their own, and the
        normalizer makes ASCII letters small, so ``Word,`` takes what is known of ``word`` and of ``,``.
        """
        memo, plan, new = self.memo, [], {}
        for w in words:
            base = w.rstrip(",.;:!?")
            tail = w[len(base) :] if base and (base[-1].isascii() and base[-1].isalpha() or _ends_in_letter(base)) else ""
            base = base if tail else w
            if base.isascii() and "<|" not in base:
                base = base.lower()
            plan.append((base, tail))
            if base not in memo:
                new[base] = None
            if tail and tail not in memo:
                new[tail] = None
        if new:
            if len(memo) + len(new) > self.limit:
                keep = {w: memo[w] for pair in plan for w in pair if w in memo}
                memo.clear()
                memo.update(keep)
            self._learn(list(new))
        return [memo[b] + memo[t] if t else memo[b] for b, t in plan]

    def _learn(self, words: list[str]) -> None:
        """Encode ``words`` many to a text, parted by a mark that is one token and that none of them holds."""
        hard = []
        piece, low = self.library.model.tokenize, self.bytes_as_letters
        for w in words:
            if w.isalpha() and w == w.lower() and (w.isascii() or (max(w) < "\u0250" and is_normalized("NFC", w))):
                # one pre-token that the normalizer leaves as it is: straight to the library's model
                self.memo[w] = array("H", [t.id for t in piece(w if w.isascii() else w.encode().decode("latin-1").translate(low))]).tobytes()
            else:
                hard.append(w)
        words = hard
        plain = [w for w in words if "~" not in w and "<|" not in w]
        for a in range(0, len(plain), 5000):
            part = plain[a : a + 5000]
            ids = np.array(self.library.encode_batch_fast([" ~ ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise RuntimeError("the mark between words was not kept apart")
            raw, at = ids.tobytes(), (2 * cuts).tolist()
            for w, i, j in zip(part, [0, *(x + 2 for x in at)], [*at, len(raw)], strict=True):
                self.memo[w] = raw[i:j]
        odd = [w for w in words if "~" in w or "<|" in w]
        for w, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.memo[w] = array("H", e.ids).tobytes()

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: 0)."""
        ends, codes, lengths, _ = self._split(texts)
        return np.diff(np.concatenate([[0], np.cumsum(lengths[codes])])[ends])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint16, where each text's begin and end)."""
        ends, codes, lengths, flat = self._split(texts)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        each = lengths[codes]
        to = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(to[-1]) - np.repeat(to[:-1] - starts[codes], each)
        return flat[at], to[ends]

    def _split(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        found = self.words(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 2
        return ends - ends[0], coded.indices.to_numpy(), lengths, np.frombuffer(b"".join(found), np.uint16)


class Encoded:
    """A chunk's ids with their offsets in the whole text."""

    def __init__(self, library, text: str, begin: int, end: int):
        e = library.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.end, self.ids = begin, end, e.ids
        self.offsets = [(begin + a, begin + b) for a, b in e.offsets]


def _common_run(left: Encoded, right: Encoded, first: int, limit: int, ends: frozenset[int]) -> tuple[int, int, int]:
    """(tokens of the longest run that both have, and the places in both behind which to splice; -1 where it ends no word).

    ``first`` is the first token of ``left`` that may be in it, ``limit`` the character by which it must end.
    """
    i, j, best, run = first, 0, (0, -1, -1), 0
    ids_a, at_a, ids_b, at_b = left.ids, left.offsets, right.ids, right.offsets
    longest = (0, 0)  # length, and where it ends in left
    shift = 0
    while i < len(ids_a) and j < len(ids_b) and at_a[i][1] <= limit:
        if at_a[i] == at_b[j] and ids_a[i] == ids_b[j]:
            run += 1
            i, j = i + 1, j + 1
            if run > longest[0]:
                longest, shift = (run, i), j - i
            continue
        run = 0
        if at_a[i] == at_b[j]:
            i, j = i + 1, j + 1
        elif at_a[i] < at_b[j]:
            i += 1
        else:
            j += 1
    n, stop = longest
    middle = stop - 1 - n // 2
    words = [k for k in range(stop - n, stop) if ids_a[k] in ends]
    if words:
        k = min(words, key=lambda k: abs(k - middle))
        best = (n, k, k + shift)
    return best if words else (n, -1, -1)


def word_ends(library) -> frozenset[int]:
    """Ids behind which a word is over: those with the suffix of a word's end, and special tokens."""
    suffix = library.model.end_of_word_suffix
    special = set(library.get_added_tokens_decoder())
    return frozenset(i for t, i in library.get_vocab().items() if i in special or t.endswith(suffix))


def chunked_ids(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, ends: frozenset[int] | None = None, run: int = RUN) -> Iterator[list[int]]:
    """The ids of ``text``, a part at a time, from overlapping chunks that are spliced within what both have."""
    ends = word_ends(library) if ends is None else ends
    margin = max((len(t.content) for t in library.get_added_tokens_decoder().values()), default=0)  # what a chunk's end may cut in two
    n, size, first = len(text), chunk, 0
    left = Encoded(library, text, 0, min(n, size))  # tokens before ``first`` are out
    while left.end < n:
        wide, spliced = overlap, False
        while not spliced:
            begin = max(left.begin, left.end - wide)
            right = Encoded(library, text, begin, min(n, max(begin + chunk, left.end + overlap)))
            found = next((k for k in range(first, len(left.ids)) if left.offsets[k][0] >= begin), len(left.ids)) if begin else first
            length, a, b = _common_run(left, right, max(first, found), left.end - margin, ends)
            if a >= 0 and length >= run and right.end > left.end:
                yield left.ids[first : a + 1]
                left, first, size, spliced = right, b + 1, chunk, True
            elif begin > left.begin:
                wide *= 2
            else:
                break
        if not spliced:  # nothing in common in the whole chunk: take in more text
            size *= 2
            left = Encoded(library, text, left.begin, min(n, left.begin + size))
    yield left.ids[first:]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    One pass without a shuffle.  Null and empty texts have 0 bytes and 0 tokens; a null
    doc_id stays null; repeated rows are counted each; other columns are ignored.
    """

    def run(batches):
        coder = WordCoder.of(vocabulary)
        ends = word_ends(coder.library)
        for part in slices(batches, "text", 3 * SLICE_BYTES):
            texts = part.column(1)
            chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
            long = chars > huge
            n = coder.count(pc.if_else(pa.array(long), pa.scalar("", texts.type), texts))
            for i in np.flatnonzero(long):
                n[i] = sum(map(len, chunked_ids(coder.library, texts[i].as_py(), ends=ends)))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([part.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
