"""Lines as rows of token numbers, word by word; runs inside tasks.

``tokenize`` masks a whole line.  But for a few formats with a space inside, no masker looks
past white space, so a word's mask is the same in every line.  ``Lexicon`` splits a batch of
lines at white space at once, masks each distinct word once, and keeps a line as the
numbers of its tokens.  Words carry flags for what may reach over a space (dates before
times, numbers before units, months, open brackets and quotes, rows of dots); a line where
one does, and one with other than plain characters or with an envelope, is tokenized whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from driftlens.functions import patterns as P
from driftlens.functions.text import _STOP, _closes, mask_body, strip_escapes, tokenize, with_masks

#: Words and tokens that a lexicon holds before it is to be begun afresh.
WORDS = 400_000

# Visible ASCII, spaces, tabs and Latin letters: white space and digits are the ASCII ones there.
_PLAIN = r"^[\t -~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]*$"
# What stands before a payload and is more than a leading ISO time stamp; and what may be JSON.
_ENVELOPED = r"^[ \t]*\{|^\S+[ \t]+(?:stdout|stderr)[ \t]"
_LEADING = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?[ \t:-]*"

ALONE, DIGIT_END, UNIT, DATE_END, CLOCK, NAME_END, DIGIT, BRACE = (1 << k for k in range(8))
#: Flags of a word and of the one behind it that need the whole line.
_PAIRS = ((DIGIT_END, UNIT), (DATE_END, CLOCK), (NAME_END, DIGIT))
_UNIT = re.compile(r"(?:ns|[uµ]s|ms|s|m|h|d|B|KB|KiB|MB|MiB|GB|GiB|TB|TiB|bps|Kbps|Mbps|Gbps)\b")
_DATE = re.compile(r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\Z")
_CLOCK = re.compile("[0-9]{2}:[0-9]{2}:[0-9]{2}")
_NAME = re.compile(r"(?:\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)|\A[A-Z][a-z]{2})\Z")
_INNER_DATE = re.compile("/(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/")
_DOTS = re.compile(r"[.FEsSxX*URIfe]{4,}\Z")
_HEX = re.compile(P.HEXID.replace(r"\b", "") + r"\Z")
_ADDRESS = re.compile(P.IPV4 + r"\Z")
_ZEROS = str.maketrans("123456789", "0" * 9)
#: A form whose words are masked each.
_EACH = -1000


def _open(word: str) -> bool:
    """Whether a bracket or a quoted value of the word is closed behind it, if at all."""
    b, at = word.encode(), 0
    while m := _STOP.search(b, at):
        if b[m.start()] == 91 or m.start() > 0:
            end = _closes(b, m.start())
            if end == m.start():
                return True
            at = end + 1
        else:
            at = m.start() + 1
    return False


def _flags(word: str) -> int:
    out = 0
    if ("[" in word or '="' in word) and _open(word) or word.count(".") > 2 and _DOTS.match(word) or "/" in word and _INNER_DATE.search(word):
        out |= ALONE
    if word[-1].isdigit():
        out |= DIGIT_END
        if _DATE.search(word):
            out |= DATE_END
    if word[0].isdigit():
        out |= DIGIT
        if _CLOCK.match(word):
            out |= CLOCK
    elif _UNIT.match(word):
        out |= UNIT
    if len(word) > 2 and _NAME.search(word):
        out |= NAME_END
    if word[0] == "{":
        out |= BRACE
    return out


class Lexicon:
    """Tokens and their numbers, and what each word becomes."""

    def __init__(self, masks: tuple = ()):
        self.masks = tuple(masks)
        self.tokens: list[str] = []
        self.number: dict[str, int] = {}
        self.words: dict[str, int] = {}  # a word's token, 8 bits, its flags
        self.forms: dict[str, int] = {}  # the same of words that differ in digits; below 0 where they stay, or where each is masked
        self.hashes = np.zeros(1024, np.uint64)

    def full(self) -> bool:
        return len(self.words) + len(self.tokens) > WORDS

    def _token(self, token: str) -> int:
        k = self.number.get(token)
        if k is None:
            k = self.number[token] = len(self.tokens)
            self.tokens.append(token)
            if k >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[k] = xxhash.xxh64_intdigest(token)
        return k

    def _word(self, w: str) -> int:
        """What a word becomes.  But for a few formats, digits' values don't matter to it, so words are known by their forms."""
        if _HEX.match(w):
            return self._token("<HEX>") << 8 | w[0].isdigit() * DIGIT | w[-1].isdigit() * DIGIT_END
        form = w.translate(_ZEROS)
        known = self.forms.get(form)
        if known is None:
            known = _EACH
            if "0000000000" not in form and "0x" not in form and "0X" not in form and "://" not in form and form.count(".") < 3:  # no epoch, hex, scheme or address
                masked, flags = mask_body(form), _flags(form)
                known = self._token(masked) << 8 | flags if "0" not in masked else -1 - flags if masked == form else _EACH
            self.forms[form] = known
        if known >= 0:
            return known
        if known > _EACH:  # stays as it is
            return self._token(w) << 8 | -1 - known
        if _ADDRESS.match(w):
            return self._token("<IP>") << 8 | DIGIT | DIGIT_END
        return self._token(mask_body(w)) << 8 | _flags(w)

    def _learn(self, words: list[str]) -> np.ndarray:
        known, out = self.words, []
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = self._word(w) if w else 0
            out.append(v)
        return np.array(out, np.int64)

    def read(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token numbers, where each line's begin in them, how many each has)."""
        n = len(raw)
        if self.masks:
            raw = pa.array([with_masks(strip_escapes(x), self.masks) for x in raw.to_pylist()], pa.string())
        plain = pc.and_not(pc.match_substring_regex(raw, _PLAIN), pc.match_substring_regex(raw, _ENVELOPED))
        body = pc.replace_substring_regex(pc.if_else(plain, raw, ""), _LEADING, "")
        lists = pc.ascii_split_whitespace(body)
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = lists.flatten().dictionary_encode()
        learnt = self._learn(coded.dictionary.to_pylist())
        filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
        codes = coded.indices.to_numpy()
        if not filled.all():  # white space at a line's ends
            keep = filled[codes]
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            codes = codes[keep]
        own = learnt[codes]
        flat, flags = (own >> 8).astype(np.int32), own & 255
        start, size = ends[:-1].copy(), np.diff(ends)
        whole = ~plain.to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(n), size)
        whole[line[(flags & ALONE) > 0]] = True
        first = start[size > 0]
        whole[line[first[(flags[first] & BRACE) > 0]]] = True  # a payload that may be JSON
        if len(flags) > 1:
            hit = np.zeros(len(flags) - 1, bool)
            for a, b in _PAIRS:
                hit |= ((flags[:-1] & a) > 0) & ((flags[1:] & b) > 0)
            whole[line[:-1][hit & (line[:-1] == line[1:])]] = True
        at = np.flatnonzero(whole)
        if len(at):
            more: list[int] = []
            for k, text in zip(at.tolist(), raw.take(pa.array(at)).to_pylist(), strict=True):
                tokens = tokenize(text)
                start[k], size[k] = len(flat) + len(more), len(tokens)
                more += map(self._token, tokens)
            flat = np.concatenate([flat, np.array(more, np.int32)])
        return flat, start, size

    def alike(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first line of each distinct row of tokens, in order; and for each line, which of these it has)."""
        n = len(start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) - np.repeat(ends - size - start, size)
        rows, place = flat[at], np.arange(len(at)) - np.repeat(ends - size, size)
        # a sum of products is compared first, the tokens themselves after
        factor = (np.arange(1, int(size.max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.hashes[rows] ^ (self.hashes[rows] >> np.uint64(29))) * factor[place], dtype=np.uint64)])
        key = (sums[ends] - sums[ends - size]) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        of = first[which]
        same = size == size[of]
        if same.all():
            begin = ends - size
            same = bool((rows == rows[np.arange(len(rows)) - np.repeat(begin - begin[of], size)]).all())
        else:
            same = False
        if not same:  # two rows with the same sum
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(rows[e - k : e].tobytes(), len(seen)) for e, k in zip(ends.tolist(), size.tolist(), strict=True)])
            _, first = np.unique(which, return_index=True)
            return first, which
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return first[order], rank[which]

    def list_of(self, flat: np.ndarray, start: int, size: int) -> list[str]:
        return [self.tokens[k] for k in flat[start : start + size].tolist()]
