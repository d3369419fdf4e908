"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text's characters: at each position the automaton's output links give all
pieces that end there, and each is tried as the last piece of the best way to cut the text
so far.  What "best" is, the model says:

* ``unigram``: the greatest sum of scores (Viterbi).
* ``bpe``: scores are merge ranks, and their sum does not give the library's pieces.  A cut
  is what merging gives if and only if each pair of neighbours is what merging gives for
  the two alone, so a piece is taken if it goes with the last piece of the prefix before
  it; for each prefix there is one.  Pairs are remembered.

Characters outside the vocabulary become byte pieces.  Texts are cut before each space, as
no piece goes on past one, and distinct words are encoded once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import slices

SPACE = "▁"
MEMO = 400_000
_coders: dict[tuple[str, str], "PieceCoder"] = {}


def gathered(parts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts that ``codes`` name, one after another; where each begins, and the end); part k is ``lengths[k]`` long."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    each = lengths[codes]
    cuts = np.concatenate([[0], np.cumsum(each)])
    return parts[np.arange(cuts[-1]) - np.repeat(cuts[:-1] - starts[codes], each)], cuts


class PieceCoder:
    def __init__(self, path: str, kind: str = "bpe", memo: int = MEMO):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.limit = kind, memo
        self.text_of = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.special = {i for i in range(len(self.text_of)) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_of = {i: int(self.text_of[i][3:-1], 16) for i in range(len(self.text_of)) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.id_of = {t: i for i, t in enumerate(self.text_of) if i not in self.special and i not in self.byte_of}
        self.score = {i: model.get_score(i) for i in self.id_of.values()}
        self.characters = frozenset(t for t in self.id_of if len(t) == 1)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.text_of]
        self.pairs: dict[int, bool] = {}  # by left + 1 and right, 16 bits each
        self.memo: dict[str, bytes] = {}
        self.shown: tuple[np.ndarray, np.ndarray] | None = None  # what each id gives back, and how long it is

    @classmethod
    def of(cls, path: str, kind: str) -> "PieceCoder":
        if (path, kind) not in _coders:
            _coders[path, kind] = cls(path, kind)
        return _coders[path, kind]

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the best-scored pair of neighbours, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging ``left`` and ``right`` (-1: nothing) together gives just these two."""
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        want = [self.text_of[right]] if left < 0 else [self.text_of[left], self.text_of[right]]
        known = self.pairs[left + 1 << 16 | right] = self.merged("".join(want)) == want
        return known

    def known(self, text: str) -> list[int]:
        """Ids of ``text``, of which every character is a piece."""
        n = len(text)
        if self.kind == "unigram":
            best, last = [0.0] + [float("-inf")] * n, [-1] * (n + 1)
            for end, (i, size) in self.automaton.iter(text):
                s = best[end + 1 - size] + self.score[i]
                if s > best[end + 1]:
                    best[end + 1], last[end + 1] = s, i
        else:
            last, done, asked = [-1] * (n + 1), -1, self.pairs.get
            for end, (i, size) in self.automaton.iter(text):  # longest first at each end
                if end != done:
                    begin = end + 1 - size
                    left = last[begin]
                    if left >= 0 or not begin:
                        fits = asked(left + 1 << 16 | i)
                        if self.fits(left, i) if fits is None else fits:
                            last[end + 1], done = i, end
        out, at = [], n
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def word(self, text: str) -> list[int]:
        if self.characters.issuperset(text):
            return self.known(text)
        out: list[int] = []
        run = 0
        for k, ch in enumerate(text):
            if ch not in self.id_of:
                if k > run:
                    out += self.known(text[run:k])
                out += [self.id_of_byte[b] for b in ch.encode()]
                run = k + 1
        return out + self.known(text[run:]) if run < len(text) else out

    def units(self, words: list[str]) -> list[bytes]:
        memo, out = self.memo, []
        if len(memo) > self.limit:
            memo.clear()
        for w in words:
            got = memo.get(w)
            if got is None:
                got = memo[w] = array("H", self.word(w)).tobytes()
            out.append(got)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.zeros(0, np.uint16)
        marked = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(self.units(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked))), np.uint16)

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a text without two spaces in a row is cut at spaces for all texts at once."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")
        coded = lists.flatten().dictionary_encode()
        found = self.units([SPACE + w for w in coded.dictionary.to_pylist()])
        codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        flat, cuts = gathered(np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) // 2, codes)
        at = cuts[ends - ends[0]].tolist()
        return [self.encode(texts[k].as_py()) if o else flat[a:b] for k, (o, a, b) in enumerate(zip(odd.tolist(), at, at[1:], strict=False))]

    def decode_column(self, ids: list[np.ndarray]) -> list[bytes]:
        """``decode`` of many, as UTF-8: the pieces' bytes gathered for all at once."""
        if self.shown is None:
            parts = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.text_of[i].replace(SPACE, " ").encode() for i in range(len(self.text_of))]
            self.shown = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
        raw, cuts = gathered(*self.shown, np.concatenate(ids) if ids else np.zeros(0, np.int64))
        at = cuts[np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)].tolist()
        out, whole = [], raw.tobytes()
        for a, b in zip(at, at[1:], strict=False):
            text = whole[a:b]
            if not text.isascii():
                text = text.decode("utf-8", "replace").replace(SPACE, " ").encode()
            out.append(text[1:] if text.startswith(b" ") else text)
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined, marks as spaces, the first space taken off; broken bytes become U+FFFD."""
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.text_of[i].encode() for i in ids)
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode_decode(docs: DataFrame, model: str, kind: str = "bpe", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, round_trip) of every row.

    ids_crc32 is of the little-endian unsigned 32-bit ids, decoded_sha256 of what the ids
    give back, round_trip whether that is the text (a text with the mark U+2581 of its own
    comes back with a space there).  A null text is an empty one and has no piece.
    ``keep_ids`` adds the ids.  One pass without a shuffle; repeated rows are encoded each.
    """

    def run(batches):
        coder = PieceCoder.of(model, kind)
        for part in slices(batches, "text"):
            rows = []
            texts = part.column(1)
            all_ids = coder.encode_column(texts)
            for doc_id, text, ids, back in zip(part.column(0).to_pylist(), texts.cast(pa.binary()).to_pylist(), all_ids, coder.decode_column(all_ids), strict=True):
                rows.append((doc_id, len(text or b""), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back).hexdigest(), back == (text or b""), *([ids.tolist()] if keep_ids else [])))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * keep_ids
    ddl = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
