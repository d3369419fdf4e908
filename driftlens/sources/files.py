"""A data source of log lines: any number of files of any size, plain, gzip or UTF-16.

``spark.read.format("loglines").load(path)`` gives (file, begin, place, raw, loss): the lines
of each range of each file, counted from 0, and how many bytes (of UTF-16: units) of each
were malformed and have been replaced.  The driver lists files and their sizes; what a
file is, the tasks see from its first bytes.  Plain and UTF-16 files are read by ranges, a
line by the range in which it begins.  A gzip file can't be cut: the task of its first
range streams it, member by member, and those of the others find nothing to do.  No task
holds more than a block of a file and its longest line.
"""

from __future__ import annotations

import codecs
import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GZIP = b"\x1f\x8b"
MARKS = ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_ORDER = {"utf-16-le": "<u2", "utf-16-be": ">u2"}
#: Bytes at a text's begin that are looked at for a NUL, which text doesn't hold.
HEAD = 256 * 1024
#: Bytes of a range, and that a task reads or unpacks at once.
RANGE, BLOCK = 64 << 20, 1 << 20
SCHEMA = "file string, begin long, place long, raw string, loss int"


def reachable(path: str) -> bool:
    """Whether tasks can open ``path`` themselves; some stores only Spark's own readers know."""
    try:
        _system(path)
        return True
    except (pa.ArrowInvalid, OSError, ValueError):
        return False


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of each file of a path, folder or pattern, in the order of their names; names that begin with ``.`` or ``_`` are passed over in folders."""
    fs, own = _system(path)
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    wild = next((k for k, c in enumerate(own) if c in "*?["), None)
    if wild is not None:
        root = own[:wild].rpartition("/")[0] or ("/" if own.startswith("/") else ".")
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        depth = own.count("/")
        found = [f for f in found if f.path.count("/") == depth and all(fnmatch.fnmatchcase(a, b) for a, b in zip(f.path.split("/"), own.split("/"), strict=True))]
    else:
        found = [fs.get_file_info(own)]
    out = []
    for f in found:
        if f.type == pafs.FileType.Directory:
            inner = fs.get_file_info(pafs.FileSelector(f.path))
            out += [(x.path, x.size) for x in inner if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_"))]
        elif f.type == pafs.FileType.File:
            out.append((f.path, f.size))
    if not out:
        raise FileNotFoundError(f"{path}: no such file")
    return sorted((prefix + p, n) for p, n in out)


def unpacked(blocks: Iterator[bytes], block: int = BLOCK) -> Iterator[bytes]:
    """What the members of a gzip stream hold, one after another, at most ``block`` bytes at once; each one's check is made."""
    d, begun = zlib.decompressobj(wbits=31), False
    for data in blocks:
        while data:
            begun = True
            out = d.decompress(data, block)
            if out:
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d, begun = d.unused_data, zlib.decompressobj(wbits=31), False
    while begun and not d.eof:
        out = d.decompress(d.unconsumed_tail, block) if d.unconsumed_tail else d.flush(block)
        if not out:
            break
        yield out
    if begun and not d.eof:
        raise ValueError("the gzip file ends early")


def _joined(blocks: Iterator[bytes], least: int) -> tuple[bytes, Iterator[bytes]]:
    """(at least ``least`` bytes of the begin, or all; the rest)."""
    head = b""
    for b in blocks:
        head += b
        if len(head) >= least:
            break
    return head, blocks


def texts(blocks: Iterator[bytes], encoding: str, exact: bool) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lines, losses) of blocks of bytes, a few at a time; a last line may lack its line feed."""
    rest: list[bytes] = []
    odd, unit = b"", 1 if encoding == "utf-8" else 2
    for data in blocks:
        if unit == 2:
            data = odd + data
            even = len(data) // 2 * 2
            data, odd = data[:even], data[even:]
            feeds = np.flatnonzero(np.frombuffer(data, _ORDER[encoding]) == 10)
            at = 2 * int(feeds[-1]) + 2 if len(feeds) else 0
        else:
            at = data.rfind(b"\n") + 1
        if at:
            yield _lines((b"".join(rest) + data[:at])[:-unit], encoding, exact)
            rest = []
        if at < len(data):
            rest.append(data[at:])
    if rest or odd:
        yield _lines(b"".join(rest) + odd, encoding, exact)


def _lines(data: bytes, encoding: str, exact: bool) -> tuple[pa.Array, pa.Array]:
    """Lines parted by line feeds, without the carriage returns and line feeds at their ends; and what was replaced in each."""
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        if exact:
            raise
        return _mended(data, encoding)
    if len(text) < 1 << 28:
        lines = pc.utf8_rtrim(pc.split_pattern(pa.array([text], pa.large_string()), "\n").flatten(), "\r\n").cast(pa.string())
    else:
        lines = pa.array([x.rstrip("\r\n") for x in text.split("\n")], pa.string())
    return lines, pa.array(np.zeros(len(lines), np.int32))


def _mended(data: bytes, encoding: str) -> tuple[pa.Array, pa.Array]:
    lost = 0

    def replaced(e: UnicodeDecodeError):
        nonlocal lost
        lost += e.end - e.start if encoding == "utf-8" else -(-(e.end - e.start) // 2)
        return "\ufffd", e.end

    codecs.register_error("driftlens.replaced", replaced)
    lines, losses = [], []
    if encoding == "utf-8":
        parts = data.split(b"\n")
    else:
        feeds = np.flatnonzero(np.frombuffer(data[: len(data) // 2 * 2], _ORDER[encoding]) == 10) * 2
        parts = [data[a:b] for a, b in zip([0, *(feeds + 2).tolist()], [*feeds.tolist(), len(data)], strict=True)]
    for part in parts:
        lost = 0
        lines.append(part.decode(encoding, "driftlens.replaced").rstrip("\r\n"))
        losses.append(lost)
    return pa.array(lines, pa.string()), pa.array(losses, pa.int32())


@dataclass
class Ranges(InputPartition):
    """Ranges (file, its bytes, begin, end) that a task reads."""

    parts: list[tuple[str, int, int, int]]


def _to(f, begin: int, end: int) -> Iterator[bytes]:
    f.seek(begin)
    while begin < end and (data := f.read(min(BLOCK, end - begin))):
        begin += len(data)
        yield data


def _feed(data: bytes, encoding: str) -> int:
    """Where the first line of ``data`` is over, or 0."""
    if encoding == "utf-8":
        return data.find(b"\n") + 1
    found = np.flatnonzero(np.frombuffer(data[: len(data) // 2 * 2], _ORDER[encoding]) == 10)
    return 2 * int(found[0]) + 2 if len(found) else 0


def _line_end(f, at: int, encoding: str) -> int | None:
    """Where the line is over that is open at ``at``; None where the file ends first."""
    f.seek(at)
    while data := f.read(BLOCK):
        if k := _feed(data, encoding):
            return at + k
        at += len(data)
    return None


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.exact = options["path"], options.get("exact", "false").lower() == "true"
        self.range = int(options.get("rangebytes", RANGE)) // 2 * 2

    def partitions(self):
        """Files larger than a range are cut; smaller ones go together, as many as make one."""
        out, held, size = [], [], 0
        for name, n in listed(self.path):
            if n > self.range:
                out += [Ranges([(name, n, a, min(n, a + self.range))]) for a in range(0, n, self.range)]
                continue
            if held and size + n > self.range or len(held) >= 1000:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((name, n, 0, n))
            size += n + 4096
        return [*out, Ranges(held)] if held else out

    def read(self, partition):
        for name, n, begin, end in partition.parts:
            fs, own = _system(name)
            try:
                with fs.open_input_file(own) as f:
                    place = 0
                    for lines, losses in self._of(f, n, begin, end):
                        for a in range(0, len(lines), 50_000):
                            part = lines.slice(a, 50_000)
                            cols = pa.array([name] * len(part), pa.string()), pa.array([begin] * len(part), pa.int64()), pa.array(range(place, place + len(part)), pa.int64()), part, losses.slice(a, 50_000)
                            yield pa.record_batch(list(cols), ["file", "begin", "place", "raw", "loss"])
                            place += len(part)
            except (ValueError, zlib.error) as e:
                raise ValueError(f"{name}: {e}") from e

    def _of(self, f, n: int, begin: int, end: int) -> Iterator[tuple[pa.Array, pa.Array]]:
        head = f.read(4)
        if head.startswith(GZIP):
            if begin:
                return
            f.seek(0)
            head, rest = _joined(unpacked(iter(lambda: f.read(BLOCK), b"")), HEAD)
            encoding, skip = self._kind(head)

            def all_blocks():
                yield head[skip:]
                yield from rest

            yield from texts(all_blocks(), encoding, self.exact)
            return
        if begin == 0:
            f.seek(0)
            encoding, skip = self._kind(f.read(HEAD))
        else:
            encoding, skip = next(((e, 2) for m, e in MARKS if head.startswith(m)), ("utf-8", 3 if head.startswith(codecs.BOM_UTF8) else 0))
        unit = 1 if encoding == "utf-8" else 2
        # a line belongs to the range in which it begins, the first one with the text's mark
        start = skip if begin == 0 else _line_end(f, begin - unit, encoding)
        if start is None or begin and start >= end:
            return
        stop = n if end >= n else _line_end(f, end - unit, encoding) or n
        yield from texts(_to(f, start, stop), encoding, self.exact)

    def _kind(self, head: bytes) -> tuple[str, int]:
        """(encoding, bytes of its mark) by a text's first bytes; what holds a NUL is none."""
        for mark, encoding in MARKS:
            if head.startswith(mark):
                return encoding, 2
        if b"\0" in head[:HEAD]:
            raise ValueError("binary, not text")
        return "utf-8", 3 if head.startswith(codecs.BOM_UTF8) else 0


class LogSource(DataSource):
    """``loglines``; options: ``exact`` (malformed text is an error), ``rangeBytes``."""

    @classmethod
    def name(cls):
        return "loglines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)


_known: WeakSet = WeakSet()


def register(spark: SparkSession) -> None:
    """Make the source known to a session, once."""
    if spark not in _known:
        spark.dataSource.register(LogSource)
        _known.add(spark)
