"""The source of log lines: ranges, gzip members, UTF-16, odd bytes, folders, patterns; and its memory."""

import gzip
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftlens.sources import files
from driftlens.sources.lines import read


def plain_lines(data: bytes, encoding="utf-8"):
    text = data.decode(encoding, "replace")
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return [x.rstrip("\r\n") for x in lines]


def got(df):
    return [r.raw for r in df.orderBy("line_no").collect()]


def by_ranges(spark, path, size):
    files.register(spark)
    rows = spark.read.format("loglines").option("rangeBytes", str(size)).load(str(path)).collect()
    return [r.raw for r in sorted(rows, key=lambda r: (r.file, r.begin, r.place))], len({(r.file, r.begin) for r in rows})


@pytest.mark.parametrize("size", [2, 6, 64, 1000])
def test_ranges_of_plain_and_wide_files(spark, tmp_path, size):
    r = random.Random(size)
    bits = ["a", "word", "é", "日本", "😀", "਀", "Ā", "\r", " ", "\r\n", "\n", "\n\n", "x" * 40]
    for k in range(2):
        text = "".join(r.choice(bits) for _ in range(60)) + r.choice(["", "\n"])
        for name, data, encoding in (
            ("p.log", text.encode(), "utf-8"), ("b.log", b"\xef\xbb\xbf" + text.encode(), "utf-8-sig"), ("l.log", b"\xff\xfe" + text.encode("utf-16-le"), "utf-16"),
            ("g.log", b"\xfe\xff" + text.encode("utf-16-be"), "utf-16"), ("z", gzip.compress(text.encode()[:30]) + gzip.compress(text.encode()[30:]), None),
        ):
            path = tmp_path / f"{k}{name}"
            path.write_bytes(data)
            lines, ranges = by_ranges(spark, path, size)
            assert lines == plain_lines(text.encode() if encoding is None else data, encoding or "utf-8"), name
            assert ranges == 1 if encoding is None else ranges > 1 or size > 60


def test_kinds_by_their_first_bytes(spark, tmp_path):
    def at(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    assert got(read(spark, at("a.txt", gzip.compress("é\n".encode("utf-16"))))) == ["é"]
    assert got(read(spark, at("b.gz", b"plain\n"))) == ["plain"]
    assert got(read(spark, at("c", b""))) == [] and got(read(spark, at("d", gzip.compress(b"")))) == []
    assert got(read(spark, at("e", b"bad \xff\xfe byte\r\r\n\nlast"))) == ["bad �� byte", "", "last"]
    assert got(read(spark, at("f", b"\xff\xfea\x00\x00\xd8b\x00\n\x00\x0a"))) == ["a�b", "�"]
    for data, why in ((b"x\0y", "binary, not text"), (gzip.compress(b"hello\n" * 1000)[:-9], "ends early"), (gzip.compress(b"x\0y"), "binary")):
        with pytest.raises(Exception, match=why):
            read(spark, at("odd", data)).collect()
    with pytest.raises(Exception, match="odd.*(decode|truncated)"):
        read(spark, at("odd", b"bad \xff"), exact=True).collect()
    with pytest.raises(FileNotFoundError, match="nothing"):
        read(spark, str(tmp_path / "nothing"))


def test_folders_and_patterns(spark, tmp_path, monkeypatch):
    """Plain files are cut where gzip files aren't; lines are numbered through all files in the order of their names."""
    text = "".join(f"line {k}\n" for k in range(3000))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_bytes(gzip.compress(text.upper().encode()))
    (tmp_path / "c.log").write_text("last")
    (tmp_path / "_hidden").write_text("no")
    lines, ranges = by_ranges(spark, tmp_path, 4000)
    assert lines == plain_lines((text + text.upper() + "last").encode()) and ranges == -(-len(text) // 4000) + 2
    df = read(spark, str(tmp_path))
    assert got(df) == lines and [r.line_no for r in df.orderBy("line_no").collect()] == list(range(1, len(lines) + 1))
    assert got(read(spark, f"{tmp_path}/[ac].log")) == plain_lines((text + "last").encode())
    assert got(read(spark, f"file://{tmp_path}/c.log", exact=True)) == ["last"]
    monkeypatch.setattr(files, "RANGE", 100)
    assert read(spark, str(tmp_path / "a.log")).where(F.col("line_no") == 2999).first().raw == "line 2998"


def test_thousands_of_small_files_go_together(tmp_path):
    for k in range(1200):
        (tmp_path / f"{k:05}.log").write_text(f"only line of {k}\n")
    parts = files.LogReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 2 and sum(len(p.parts) for p in parts) == 1200


_MEASURE = """
import re, sys
from driftlens.sources.files import LogReader
reader = LogReader({"path": sys.argv[1]})
n = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
print(n, int(re.search("VmHWM:\\s+([0-9]+)", open("/proc/self/status").read())[1]) // 1024)
"""


@pytest.mark.parametrize("gib", [3])
def test_a_large_gzip_file_in_little_memory(tmp_path, gib):
    """3 GiB unpacked, members of 64 MiB, by less than 500 MB of memory."""
    member = gzip.compress(b"".join(b"2024-01-15T10:23:45Z INFO request %07d handled in 12 ms by worker three\n" % k for k in range(1 << 20))[: 64 << 20], 1)
    with open(tmp_path / "large.log", "wb") as f:
        for _ in range(gib * 16):
            f.write(member)
    done = subprocess.run([sys.executable, "-c", _MEASURE, str(tmp_path / "large.log")], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=900)
    n, mb = map(int, done.stdout.split())
    assert n > gib * 14_000_000 // 2 and mb < 500, (n, mb)
