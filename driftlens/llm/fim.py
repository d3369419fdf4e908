"""Fill-in-the-middle transformation of documents.

A text is a row of units: words with the white space before them, and white space at the
end.  Units are counted block by block, and every ``EVERY`` units a checkpoint keeps how
many units, bytes and code points lie before it.  A cut after k units is found by a binary
search of the checkpoints and a scan of less than ``EVERY`` units from there, so a huge
text costs its bytes once and an index of a thousandth of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import slices

#: Units between checkpoints, and bytes that are counted at once.
EVERY, BLOCK = 256, 1 << 16
_UNIT = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass
class Checkpoints:
    """Units, bytes and code points before each checkpoint, the first of which is the text's begin; and the units of all."""

    units: list[int] = field(default_factory=lambda: [0])
    bytes: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    total: int = 0


def checkpoints(raw: np.ndarray, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
    """Count the units of a text (its UTF-8 bytes) block by block, with a checkpoint after each ``every`` of them."""
    out, chars, n = Checkpoints(), 0, len(raw)
    for at in range(0, n, block):
        part = raw[at : at + block]
        space = _SPACE[part]
        after = np.empty(len(part), bool)
        after[:-1] = space[1:]
        end = at + len(part)
        after[-1] = end == n or _SPACE[raw[end]]
        ends = np.flatnonzero(after & ~space)  # last bytes of words
        begins = (part & 0xC0) != 0x80
        first = every - 1 - out.total % every
        for k in range(first, len(ends), every):
            stop = int(ends[k]) + 1
            out.units.append(out.total + k + 1)
            out.bytes.append(at + stop)
            out.chars.append(chars + int(np.count_nonzero(begins[:stop])))
        out.total += len(ends)
        chars += int(np.count_nonzero(begins))
    if n and _SPACE[raw[-1]]:  # white space at the end is a unit of its own
        out.total += 1
    return out


def cut_after(text: bytes, index: Checkpoints, units: int) -> tuple[int, int]:
    """(bytes, code points) of the text's first ``units`` units."""
    k = bisect_right(index.units, units) - 1
    begin = end = index.bytes[k]
    for m in islice(_UNIT.finditer(text, begin), units - index.units[k]):
        end = m.end()
    return end, index.chars[k] + len(text[begin:end].decode("utf-8", "replace"))


def _numbers(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """The first four groups of eight digits of the id's hash, as numbers."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def transformed(doc_id: int | None, text: bytes, raw: np.ndarray, rate: int, spm: int, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix's and middle's code points, output) of one text."""
    index = checkpoints(raw)
    h1, h2, h3, h4 = _numbers(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.total, "plain", None, None, text
    low, high = sorted((h1 % (index.total + 1), h2 % (index.total + 1)))
    (a, a_chars), (b, b_chars) = cut_after(text, index, low), cut_after(text, index, high)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form = "spm" if h4 % 100 < spm else "psm"
    parts = (s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b])
    return index.total, form, a_chars, b_chars - a_chars, b"".join(parts)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    ``rate`` percent of texts are cut, ``spm`` percent of those give their suffix first; both
    follow from the id's hash.  Null and empty texts have no unit and stay plain with an
    empty output, as do texts that hold a mark, whatever their length.  A null id hashes as
    an empty one and stays null.  Repeated rows are transformed each, other columns are
    ignored, an empty table gives no rows.  One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "text"):
            rows = []
            for doc_id, value in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                held = value.as_buffer() if value.is_valid else None
                text = held.to_pybytes() if held is not None else b""
                rows.append((doc_id, *transformed(doc_id, text, np.frombuffer(text, np.uint8), rate, spm, seed)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.record_batch([*made[:-1], made[-1].cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of.

    Marks neither overlap nor stand in a text that was cut, so each is found at its one place.
    """
    body, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    begin = F.substr(body, F.lit(len(PREFIX) + 1))  # without its first mark
    by_suffix = F.concat(F.substring_index(begin, PREFIX, -1), middle, F.substring_index(begin, PREFIX, 1))
    by_prefix = F.concat(F.substring_index(begin, SUFFIX, 1), middle, F.substring_index(begin, SUFFIX, -1))
    return F.when(form == "plain", output).when(form == "spm", by_suffix).otherwise(by_prefix)
