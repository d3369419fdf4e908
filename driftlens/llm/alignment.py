"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often corpus-wide.

A slice's texts lie one after another in one space of bytes.  The ends of either
tokenizer's tokens are bits of a packed bitset; the AND of both has the shared cuts.  A
directory of running popcounts gives the rank of a cut (how many tokens have ended there),
which maps each stretch between cuts to its token ranges, and each cut to the two tokens
that it links.  Links are kept as packed id pairs, a number each; they are summed up with
partial sums by pair, and the sums go back to the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import cut_lineage, release, slices

#: Pairs whose sums are broadcast at most (13 bytes each); of more, documents meet them in a join.
FEW_PAIRS = 3_000_000
#: Bytes of text that are aligned at once.
SLICE = 1_000_000
_B_BITS = 16

#: Words whose ids a worker remembers for each tokenizer; it starts afresh when it has more.
MEMO = 250_000
#: White space other than single spaces and line feeds between words.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|^$|[\x{00}-\x{09}\x{0b}-\x{1f}\x{7f}-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2581}\x{3000}\x{feff}]"

Ids = tuple[np.ndarray, np.ndarray]  # ids one after another, and how many each text has
_coders: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, and what their tokens stand for in bytes."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            vocabulary = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are numbered from 256 on
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        known = vocabulary["model"]["vocab"] | {t["content"]: t["id"] for t in vocabulary.get("added_tokens", ())}
        parts = [b""] * (max(known.values()) + 1)
        for text, i in known.items():
            parts[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        self.a_bytes = _packed(parts)
        n = self.b.get_piece_size()
        if n > 1 << _B_BITS:
            raise ValueError("ids of the second tokenizer take more than 16 bits")
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = _packed([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second tokenizer goes on past a space")
        self.memo_a: dict[str, bytes] = {}
        self.memo_b: dict[str, bytes] = {}
        # the digits of each id with what may stand behind it
        most = max(len(parts), n)
        self.digits = _packed([f"{i}{mark}".encode() for i in range(most) for mark in ",|;"])

    @classmethod
    def of(cls, a: str, b: str) -> "Pair":
        if (a, b) not in _coders:
            _coders[a, b] = cls(a, b)
        return _coders[a, b]

    def encode(self, texts: list[str]) -> tuple[Ids, Ids]:
        """Ids of space+text by A and of text by B, for all texts one after another.

        Where white space is single spaces and line feeds alone, neither tokenizer joins what
        stands before a space with what stands behind it (A's pre-tokens and B's pieces begin
        with one), so distinct words are encoded once; other texts go to the libraries whole.
        """
        odd = pc.match_substring_regex(pa.array(texts, pa.string()), _ODD).to_numpy(zero_copy_only=False).astype(bool)
        alone = np.flatnonzero(odd)
        plain = pa.array(["" if o else t for t, o in zip(texts, odd.tolist(), strict=True)], pa.string())
        out = []
        for memo, library, lead, split in ((self.memo_a, self._by_a, " ", pc.replace_substring(plain, "\n", " \n")), (self.memo_b, self._by_b, "", plain)):
            lists = pc.split_pattern(split, " ")
            ends = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            self._learn(memo, words, library, lead)
            found = [memo[w] for w in words]
            starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 2)])
            flat, stop = _joined((np.frombuffer(b"".join(found), np.uint16), starts), coded.indices.to_numpy())
            size = np.diff(np.concatenate([[0], stop])[ends - ends[0]])
            if len(alone):  # an odd text has none so far
                each = [library(lead + texts[k]) for k in alone]
                of_plain = np.repeat(~odd, size := size + np.bincount(alone, list(map(len, each)), len(texts)).astype(np.int64))
                merged = np.empty(len(of_plain), np.uint16)
                merged[of_plain], merged[~of_plain] = flat, np.concatenate(each)
                flat = merged
            out.append((flat.astype(np.int64), size))
        return out[0], out[1]

    def _by_a(self, text: str) -> np.ndarray:
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _by_b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode(text), np.uint16)

    def _learn(self, memo: dict[str, bytes], words: list[str], library, lead: str) -> None:
        """Encode what ``memo`` lacks of ``words``, many to a text, which is cut by the bytes of its tokens."""
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO:
            kept = {w: memo[w] for w in words if w in memo}
            memo.clear()
            memo.update(kept)
        memo[""] = b""
        token_bytes = np.diff((self.a_bytes if lead else self.b_bytes)[1])
        new = [w for w in new if w]
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            # behind a line feed no space goes before the word
            units = part if not lead else [w if w[0] == "\n" else " " + w for w in part]
            ids = library("".join(units) if lead else " ".join(units))
            size = np.fromiter((len(u.encode()) for u in units), np.int64, len(units)) + (0 if lead else 1)
            cuts = np.searchsorted(np.cumsum(token_bytes[ids]), np.cumsum(size)) + 1
            raw = ids.tobytes()
            for w, i, j in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                memo[w] = raw[2 * i : 2 * j]


def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes one after another, where each part begins and the end)."""
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])


def _joined(packed: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the named parts one after another, where each ends)."""
    raw, starts = packed
    size = np.diff(starts)[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return raw[np.arange(total) - np.repeat(ends - size - starts[codes], size)], ends


class Bitset:
    """Bits of byte offsets, 64 to a word, with running popcounts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    @classmethod
    def of(cls, offsets: np.ndarray, size: int) -> "Bitset":
        flags = np.zeros(-(-max(size, 1) // 64) * 64, np.uint8)
        flags[offsets] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: "Bitset") -> "Bitset":
        return Bitset(self.words & other.words)

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """Bits set at or before each offset."""
        word, bit = offsets >> 6, (offsets & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)))

    def select(self) -> np.ndarray:
        """The offsets of all bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def aligned(coder: Pair, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
    """(tokens of A, of B, groups, digest of the groups, links as packed id pairs) of each text."""
    n = len(texts)
    (flat_a, size_a), (flat_b, size_b) = coder.encode(texts)
    raw_a, end_a = _joined(coder.a_bytes, flat_a)
    raw_b, end_b = _joined(coder.b_bytes, flat_b)
    want = [(" " + t).encode() for t in texts]
    cut_a, cut_b = (np.concatenate([[0], np.cumsum(size)]) for size in (size_a, size_b))
    at_a, at_b = (np.concatenate([[0], end])[cut] for end, cut in ((end_a, cut_a), (end_b, cut_b)))
    whole_a, whole_b = raw_a.tobytes(), raw_b.tobytes()
    same = np.array([t != "" and whole_a[a:b] == w and whole_b[c:d] == w for t, w, a, b, c, d in zip(texts, want, at_a.tolist(), at_a[1:].tolist(), at_b.tolist(), at_b[1:].tolist(), strict=False)], bool)
    del raw_a, raw_b, whole_a, whole_b
    # what remains shares one space of bytes, in which a text ends where the next begins
    of_a, of_b = (np.repeat(np.arange(n), size) for size in (size_a, size_b))
    length = np.where(same, [len(w) for w in want], 0)
    base = np.cumsum(length) - length
    keep_a, keep_b = same[of_a], same[of_b]
    flat_a, flat_b, of_a, of_b = flat_a[keep_a], flat_b[keep_b], of_a[keep_a], of_b[keep_b]
    end_a, end_b = end_a[keep_a] - at_a[of_a] + base[of_a], end_b[keep_b] - at_b[of_b] + base[of_b]
    total = int(length.sum())
    bits_a, bits_b = Bitset.of(end_a - 1, total), Bitset.of(end_b - 1, total)
    cuts = (bits_a & bits_b).select()
    last_a, last_b = bits_a.rank(cuts) - 1, bits_b.rank(cuts) - 1  # the tokens that end at each cut
    links = (flat_a[last_a] << _B_BITS | flat_b[last_b]).astype(np.uint32)
    group_of = np.searchsorted(base + length, cuts, side="right")
    groups = np.bincount(group_of, minlength=n)
    # a1,a2|b1;a3|b2,b3: a group's tokens of A, then those of B; each has one mark behind it
    mark_a, mark_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]) if len(cuts) else last_a, np.concatenate([[0], last_b[:-1] + 1]) if len(cuts) else last_b
    in_a, in_b = last_a - first_a + 1, last_b - first_b + 1
    place_a = np.arange(len(flat_a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
    place_b = np.arange(len(flat_b)) + np.repeat(np.cumsum(in_a), in_b)
    shown = np.empty(len(flat_a) + len(flat_b), np.int64)
    shown[place_a], shown[place_b] = flat_a * 3 + mark_a, flat_b * 3 + mark_b
    text, ends = _joined(coder.digits, shown)
    text = text.tobytes()
    n_a, n_b = np.where(same, size_a, 0), np.where(same, size_b, 0)
    stop = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    link_cuts = np.concatenate([[0], np.cumsum(groups)]).tolist()
    for k in range(n):
        digest = hashlib.sha256(text[stop[k] : stop[k + 1] - 1]).hexdigest() if same[k] else ""
        yield int(n_a[k]), int(n_b[k]), int(groups[k]), digest, links[link_cuts[k] : link_cuts[k + 1]]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every row of ``docs``.

    ``links`` holds a little-endian unsigned 32-bit number a link: A's id, 16 bits, B's id.
    Tokens link that end at the same byte; as none is empty, a group has one link, its last
    tokens.  Null and empty texts, and texts that either tokenizer changes, have no tokens:
    zeros and an empty digest.  One pass without a shuffle; repeated rows are aligned each.
    """

    def run(batches):
        coder = Pair.of(a, b)
        for part in slices(batches, "text", SLICE):
            rows = [(i, x, y, g, len(found), digest, found.tobytes()) for i, (x, y, g, digest, found) in zip(part.column(0).to_pylist(), aligned(coder, [t or "" for t in part.column(1).to_pylist()]), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in _ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ALIGNED)


def pair_counts(done: DataFrame) -> DataFrame:
    """(pair, n, best) of the links of ``align``: how often each id pair is linked, and whether no pair of its B id is more often.

    Slices are summed up where they are read; what is shuffled is a pair a task at most.
    """

    def run(batches):
        held: dict[int, int] = {}
        for batch in batches:
            col = batch.column(0)
            flat = np.frombuffer(b"".join(col.to_pylist()), "<u4")
            pairs, n = np.unique(flat, return_counts=True)
            for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
                held[p] = held.get(p, 0) + k
            if len(held) > 400_000:
                yield pa.record_batch([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["pair", "n"])
                held = {}
        if held:
            yield pa.record_batch([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["pair", "n"])
        release()

    sums = cut_lineage(done.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    most = sums.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row an id of B: 65,536 at most
    return sums.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a: str, b: str, few: int = FEW_PAIRS) -> DataFrame:
    """``align`` with each document's n_best and count_sum in place of its links.

    n_best counts its links whose pair is as frequent corpus-wide as any pair of the same B
    id, count_sum sums its links' corpus-wide counts.  The sums of at most ``few`` pairs are
    broadcast; of more, each document's distinct pairs meet them in a join by pair and come
    back by row.  Rows of equal doc_id, and of none, are kept apart.
    """
    done = cut_lineage(align(docs, a, b).withColumn("_row", F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(done))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= few:
        table = counts.orderBy("pair").toArrow()
        held = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
        shared = docs.sparkSession.sparkContext.broadcast((held[0].astype(np.uint32), held[1], held[2]))
        del table, held

        def run(batches):
            pair, n, best = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                col = batch.column(batch.schema.get_field_index("links"))
                size = pc.binary_length(col).to_numpy().astype(np.int64) // 4
                own, back = np.unique(np.frombuffer(b"".join(col.to_pylist()), "<u4"), return_inverse=True)
                at = np.searchsorted(pair, own)
                ends = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for per in (best[at].astype(np.int64), n[at]):
                    total = np.concatenate([[0], np.cumsum(per[back])])
                    sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
                by_name = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"n_best": sums[0], "count_sum": sums[1]}
                yield pa.record_batch([by_name[c] for c in names], names)
            release()

        return done.drop("_row").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def spread(batches):
        for batch in batches:
            for row, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, n = np.unique(np.frombuffer(links, "<u4"), return_counts=True)
                yield pa.record_batch([pa.array([row] * len(pairs), pa.int64()), pa.array(pairs.astype(np.int64)), pa.array(n, pa.int64())], ["_row", "pair", "links"])

    own = done.select("_row", "links").mapInArrow(spread, "_row long, pair long, links long")
    sums = own.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return done.join(sums, "_row", "left").select(*(zero(c) if c in ("n_best", "count_sum") else F.col(c) for c in names))
