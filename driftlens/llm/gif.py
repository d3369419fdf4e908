"""GIF media columns: payloads as animated GIFs, and GIFs back to timed frames.

``encode`` writes a payload as 8-bit palette indexes, ``WIDTH`` to a row, over as many
frames as it takes.  ``decode`` reads any GIF: LZW code streams, global and local
palettes, interlacing, transparency and the four disposal rules, into rendered frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftlens.llm.common import SLICE_BYTES, slices

WIDTH = 192
#: Rows of a frame; longer payloads take more frames.
ROWS = 2048
#: Hundredths of a second that a frame is shown.
DELAY = 10
BINS = 8

# Fixed values of the format.
CLEAR8, END8, FULL = 256, 257, 4096


@dataclass
class Frame:
    """One rendered frame: RGBA pixels of the whole screen, its time, the drawn rectangle's indexes and place (x, y)."""

    pixels: np.ndarray
    start_ms: int
    duration_ms: int
    indexes: np.ndarray
    place: tuple[int, int] = (0, 0)

    @property
    def drawn(self) -> np.ndarray:
        """Rendered pixels of the drawn rectangle."""
        (x, y), (h, w) = self.place, self.indexes.shape
        return self.pixels[y : y + h, x : x + w]


def _widths(first: int, least: int, count: int) -> np.ndarray:
    """Bits of the codes number 0.. after a clear code, whose table then holds ``first`` entries."""
    size = np.minimum(first + np.maximum(np.arange(count) - 1, 0), FULL - 1)
    return np.maximum(least, np.floor(np.log2(size)).astype(np.int64) + 1)


_SCHEDULE = {m: _widths((1 << m) + 2, m + 1, 8192) for m in range(2, 9)}
_ENDS = {m: np.cumsum(w) for m, w in _SCHEDULE.items()}


def lzw_pack(data: bytes) -> bytes:
    """LZW codes of 8-bit samples, as bytes without sub-blocks."""
    codes, table, nxt = [CLEAR8], {}, END8 + 1
    add, known = codes.append, table.get
    clears = [0]
    it = iter(data)
    word = next(it)
    for b in it:
        key = word << 8 | b
        code = known(key)
        if code is None:
            add(word)
            table[key] = nxt
            nxt += 1
            word = b
            if nxt == FULL:
                clears.append(len(codes))
                add(CLEAR8)
                table.clear()
                nxt = END8 + 1
        else:
            word = code
    add(word)
    add(END8)
    value = np.array(codes, np.int32)
    if len(clears) == 1:
        width = np.concatenate([[9], _SCHEDULE[8][: len(value) - 1]])
    else:  # a clear code is as wide as its place in the run before it says
        begin = np.array(clears)
        nth = np.arange(len(value)) - begin[np.searchsorted(begin, np.arange(len(value)), "right") - 1] - 1
        width = np.where(nth >= 0, _SCHEDULE[8][np.maximum(nth, 0)], 9)
        width[begin[1:]] = _SCHEDULE[8][np.diff(begin) - 1]
    bit = np.cumsum(width) - width
    byte, value = bit >> 3, value << (bit & 7)
    size = int(bit[-1] + width[-1] + 7) >> 3
    out = np.bincount(byte, value & 255, size + 2)
    out[1:] += np.bincount(byte, value >> 8 & 255, size + 1)
    out[2:] += np.bincount(byte, value >> 16, size)
    return out[:size].astype(np.uint8).tobytes()


def lzw_unpack(stream: bytes, least: int) -> bytes:
    """Samples of an LZW code stream whose minimum code size is ``least``.

    A table entry is the samples of one code and the first of the next, so it is a stretch
    of what is already out.  Each sample therefore points at an earlier one until it meets
    a literal; the pointers are followed for all samples at once, twice as far each time.
    """
    clear, end, width = 1 << least, (1 << least) + 1, _SCHEDULE[least]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out = 8 * len(stream), 0, []
    while True:
        run, stopped = [], None
        while stopped is None:  # codes to the next clear or end code; widths depend on a code's place alone
            if run:
                w = np.full(4200, 12)
                ends = np.cumsum(w)
            else:
                w, ends = width[:4200], _ENDS[least][:4200]
            n = int(np.searchsorted(ends, bits - at, "right"))
            w = w[:n]
            pos = ends[:n] - w + at
            k = pos >> 3
            codes = ((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (pos & 7)) & ((1 << w) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                stopped, at = int(codes[stop[0]]), int(pos[stop[0]] + w[stop[0]])
                codes = codes[: stop[0]]
            elif n < 4200:
                stopped = end
            else:
                at = int(pos[-1] + w[-1])
            run.append(codes)
        codes = np.concatenate(run)
        if len(codes):
            size: list[int] = []
            add = size.append
            for code in codes.tolist():
                add(1 if code < clear else size[code - end - 1] + 1)
            sizes = np.array(size, np.int32)
            begin = np.cumsum(sizes, dtype=np.int32) - sizes
            entry = codes > end
            back = np.zeros(len(codes), np.int32)
            back[entry] = begin[entry] - begin[codes[entry] - end - 1]
            values = np.zeros(int(begin[-1]) + size[-1], np.uint8)
            values[begin[~entry]] = codes[~entry]
            back = np.arange(len(values), dtype=np.int32) - np.repeat(back, sizes)
            while True:
                further = back.take(back)
                if (further == back).all():
                    break
                back = further
            out.append(values.take(back).tobytes())
        if stopped == end:
            return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A grey GIF whose frames hold ``payload``, a multiple of ``width`` bytes, as palette indexes."""
    high = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, high, 0xF7, 0, 0), bytes(v for i in range(256) for v in (i, i, i))]
    for a in range(0, len(payload), width * rows):
        part = payload[a : a + width * rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_pack(part)))
    return b"".join(out) + b"\x3b"


def decode(gif: bytes, render: bool = True) -> list[Frame]:
    """The frames of a GIF; ``render=False`` leaves the pixels out and keeps indexes and times."""
    return list(played(gif, render))


def _colours(rgb: np.ndarray) -> np.ndarray:
    """RGBA of a palette as one number an index; indexes past its end are black."""
    full = np.zeros((256, 4), np.uint8)
    full[:, 3] = 255
    full[: len(rgb), :3] = rgb
    return full.view(np.uint32).ravel()


def played(gif: bytes, render: bool = True) -> Iterator[Frame]:
    """The frames of a GIF one by one."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", gif, 6)
    if render and 4 * wide * high >= 1 << 31:
        raise ValueError("a screen too large for a binary value")
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = np.frombuffer(gif, np.uint8, n, at).reshape(-1, 3), at + n
    screen = np.zeros((high, wide), np.uint32) if render else None
    clock, delay, dispose, clear_index = 0, 0, 0, None

    def gather(at: int) -> tuple[bytes, int]:
        parts = []
        while n := gif[at]:
            parts.append(gif[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while gif[at] != 0x3B:
        if gif[at] == 0x21:
            kind = gif[at + 1]
            data, at = gather(at + 2)
            if kind == 0xF9:
                bits, delay, index = data[0], data[1] | data[2] << 8, data[3]
                dispose, clear_index = bits >> 2 & 7, index if bits & 1 else None
            continue
        if gif[at] != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, bits = struct.unpack_from("<HHHHB", gif, at + 1)
        at, palette = at + 10, shared
        if bits & 0x80:
            n = 3 << (bits & 7) + 1
            palette, at = np.frombuffer(gif, np.uint8, n, at).reshape(-1, 3), at + n
        least = gif[at]
        data, at = gather(at + 1)
        index = np.frombuffer(lzw_unpack(data, least), np.uint8)[: w * h].reshape(h, w)
        if bits & 0x40:  # interlaced: every 8th row from 0, every 8th from 4, every 4th from 2, every 2nd from 1
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            plain = np.empty_like(index)
            plain[order] = index
            index = plain
        shown = None
        if render:
            if palette is None:
                raise ValueError("a frame without a palette")
            before = screen.copy() if dispose == 3 else None
            area = screen[y : y + h, x : x + w]
            inside = index[: area.shape[0], : area.shape[1]]
            if clear_index is None:
                area[:] = _colours(palette).take(inside)
            else:
                area[:] = np.where(inside == clear_index, area, _colours(palette).take(inside))
            shown = screen.copy().view(np.uint8).reshape(high, wide, 4)
            if dispose == 2:
                area[:] = 0
            elif dispose == 3:
                screen = before
        yield Frame(shown, clock, 10 * delay, index, (x, y))
        clock += 10 * delay
        delay, dispose, clear_index = 0, 0, None


def colour_histogram(pixels: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Opaque RGBA pixels in each of ``bins`` equal ranges of red, then of green, then of blue."""
    seen = pixels.reshape(-1, 4)
    if (seen[:, 3] != 255).any():
        seen = seen[seen[:, 3] == 255]
    return np.concatenate([np.bincount(seen[:, k], minlength=256).reshape(bins, -1).sum(1) for k in range(3)])


FRAME_FIELDS = [("frame", "int"), ("start_ms", "long"), ("duration_ms", "long"), ("width", "int"), ("height", "int"), ("pixels", "binary"), ("histogram", "array<long>"), ("error", "string")]


def gif_frames(rows: DataFrame, column: str) -> DataFrame:
    """A row a frame of the GIFs in a binary column, beside the other columns of ``rows``.

    ``pixels`` are the rendered samples, RGBA by rows of the whole screen; ``histogram`` is
    that of ``colour_histogram``.  A value that is no GIF, a null among them, is one row with
    ``error``; so is what follows the frames read of a damaged one.  One pass without a shuffle.
    """
    rest = [f for f in rows.schema.fields if f.name != column]
    if clash := {f.name for f in rest} & {n for n, _ in FRAME_FIELDS}:
        raise ValueError(f"columns with the names of frames' fields: {sorted(clash)}")
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def of(gif):
        n = 0
        try:
            for f in played(b"" if gif is None else gif):
                h, w = f.pixels.shape[:2]
                yield n, f.start_ms, f.duration_ms, w, h, f.pixels.tobytes(), colour_histogram(f.pixels).tolist(), None
                n += 1
        except (ValueError, IndexError, KeyError, struct.error) as e:
            yield n, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
        else:
            if not n:
                yield 0, None, None, None, None, None, None, "no frames"

    def run(batches):
        for part in slices(batches, column):
            others = part.select([f.name for f in rest])

            def batch(held, others=others):
                at = pa.array([i for i, _ in held], pa.int64())
                made = [pa.array(v, kind) for v, kind in zip(zip(*[r for _, r in held], strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*[c.take(at) for c in others.columns], *made], [*others.schema.names, *[n for n, _ in FRAME_FIELDS]])

            held, size = [], 0
            for i, gif in enumerate(part.column(part.schema.get_field_index(column))):
                for row in of(gif.as_py()):
                    held.append((i, row))
                    size += len(row[5] or b"")
                    if size > SLICE_BYTES:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)

    out = StructType(rest + StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in FRAME_FIELDS)).fields)
    return rows.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{column}`")).mapInArrow(run, out)


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    """``text`` with spaces up to a positive multiple of ``unit``."""
    return text + b" " * (max(1, -(-len(text) // unit)) * unit - len(text))


def media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each document's text as a GIF, read back, with features of the rendered frames.

    One pass without a shuffle.  A null text is an empty one, which is one row of spaces;
    repeated rows come out repeated; a null doc_id stays null; an empty table gives no rows.
    Frames' times and the histogram of their colours are columns too.  ``keep_media`` adds the column ``media``.
    """

    def run(batches):
        for part in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or b""
                gif = encode(padded(text))
                frames = decode(gif)
                back = b"".join(f.drawn[:, :, 0].tobytes() for f in frames)  # grey: red is the sample
                histogram = sum(colour_histogram(f.drawn) for f in frames)
                counts = histogram.reshape(3, BINS).sum(0)
                share = counts / counts.sum()
                feature = f"frames={len(frames)};ms={sum(f.duration_ms for f in frames)};hist=" + ",".join(f"{v:.6f}" for v in share)
                rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, [f.start_ms for f in frames], [f.duration_ms for f in frames], histogram.tolist(), *([gif] if keep_media else [])))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)

    fields = [("doc_id", "int64"), ("n_bytes", "int64"), ("payload_bytes", "int64"), ("payload_sha256", "string"), ("tail_crc32", "int64"), ("media_bytes", "int64"), ("media_sha256", "string"), ("feature", "string")]
    fields += [("frame_start_ms", "int64s"), ("frame_duration_ms", "int64s"), ("histogram", "int64s")] + [("media", "binary")] * keep_media
    kinds = {"int64": (pa.int64(), "long"), "string": (pa.string(), "string"), "int64s": (pa.list_(pa.int64()), "array<long>"), "binary": (pa.binary(), "binary")}
    shape = pa.schema([(n, kinds[t][0]) for n, t in fields])
    ddl = ", ".join(f"{n} {kinds[t][1]}" for n, t in fields)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).mapInArrow(run, ddl)
