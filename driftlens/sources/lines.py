"""Log files as DataFrames of numbered lines."""

from __future__ import annotations

import codecs
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.sources import files

GZIP = b"\x1f\x8b"
#: How files begin that ``read_lines`` can't read.
PACKED = (GZIP, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
#: Bytes at a file's begin that are looked at for a NUL, which text doesn't hold.
HEAD = 256 * 1024


def numbered(rows: DataFrame, run_idx: int = 0, order: tuple[str, ...] = ("_split", "_place")) -> DataFrame:
    """(run_idx, line_no, raw) of rows in ``order``: rows within a split are counted there, splits by running totals.

    So no task sorts a whole run: only one row a split meets in one place.  A column
    ``run_idx`` of ``rows`` tells runs apart that are numbered each.
    """
    split, place = order
    rows = rows if "run_idx" in rows.columns else rows.withColumn("run_idx", F.lit(run_idx))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("run_idx", split).orderBy(place)))
    sizes = rows.groupBy("run_idx", split).count()
    before = sizes.select("run_idx", split, (F.sum("count").over(Window.partitionBy("run_idx").orderBy(split)) - F.col("count")).alias("_before"))
    return own.join(before, ["run_idx", split]).select("run_idx", (F.col("_own") + F.col("_before")).cast("long").alias("line_no"), "raw")


def numbered_in_place(rows: DataFrame, run_idx: int = 0) -> DataFrame:
    """Like ``numbered`` for places that count up by one within a split: no line is shuffled or sorted for its number."""
    sizes = rows.groupBy("_split").agg(F.count("*").alias("n"), F.min("_place").alias("_low"))
    before = sizes.select("_split", (F.sum("n").over(Window.orderBy("_split")) - F.col("n") - F.col("_low") + 1).alias("_before"))  # a row a split
    more = [c for c in rows.columns if c not in ("_split", "_place", "raw")]
    return rows.join(before, "_split").select(F.lit(run_idx).alias("run_idx"), (F.col("_place") + F.col("_before")).cast("long").alias("line_no"), "raw", *more)


def _cleaned(c):
    return F.regexp_replace(c, r"[\r\n]+\z", "")


def read_lines(spark: SparkSession, path: str, run_idx: int = 0, exact: bool = False) -> DataFrame:
    """A run's lines, split at ``\\n`` alone, without the line feeds and carriage returns at their ends.

    UTF-8 that is malformed is repaired, or refused where ``exact``.  Files end their last
    line with or without a line feed.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(
        (F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))).alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
        _cleaned(F.validate_utf8("value") if exact else F.make_valid_utf8("value")).alias("raw"),
    )
    return numbered_in_place(rows, run_idx)


def first_bytes(spark: SparkSession, path: str, n: int = HEAD) -> list[bytes]:
    """The first ``n`` bytes of each file of a path, pattern or folder, by the store's own reader.  There must be one."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for g in fs.globStatus(root) or [] for s in (fs.listStatus(g.getPath()) if g.isDirectory() else [g])]
    out = []
    if not found:
        raise FileNotFoundError(f"{path}: no such file")
    for status in found:
        if status.isDirectory():
            continue
        stream = fs.open(status.getPath())
        try:
            out.append(bytes(stream.readNBytes(n)))
        finally:
            stream.close()
    return out


def lost(c: Column) -> Column:
    """Bytes of a string that are no UTF-8 and that ``make_valid_utf8`` replaces; U+FFFD that stands there is none."""
    mended = F.make_valid_utf8(c)
    count = lambda hexed: (F.length(hexed) - F.length(F.replace(hexed, F.lit(",EF,BF,BD"), F.lit("")))) / 9
    bytes_of = lambda x: F.regexp_replace(F.hex(x.cast("binary")), "(..)", ",$1")
    marks = count(bytes_of(mended)) - count(bytes_of(c))
    return F.when(F.is_valid_utf8(c), 0).otherwise(F.octet_length(c) - F.octet_length(mended) + 3 * marks).cast("int")


def losses(rows: DataFrame) -> DataFrame:
    """(run_idx, lines, lossy_lines, lost, first_lossy): of each run, what has been replaced in its lines (``loss``)."""
    bad = F.col("loss") > 0
    return rows.groupBy("run_idx").agg(F.count("*").alias("lines"), F.count_if(bad).alias("lossy_lines"), F.sum(F.col("loss").cast("long")).alias("lost"), F.min(F.when(bad, F.col("line_no"))).alias("first_lossy"))


def read(spark: SparkSession, path: str, run_idx: int = 0, exact: bool = False, loss: bool = False) -> DataFrame:
    """Lines of files of any kind and size by the ``loglines`` source; what holds a NUL is refused.

    ``loss`` adds the column of that name: bytes (of UTF-16: units) of each line that were malformed.

    Of a store that only Spark can open, by the reader that the files' first bytes ask for.
    """
    if files.reachable(path):
        found = files.listed(path)
        files.register(spark)
        rows = spark.read.format("loglines").option("exact", str(exact).lower()).load(path)
        if len(found) == 1 and found[0][1] <= files.RANGE:  # one range: its lines are counted already
            return rows.select(F.lit(run_idx).alias("run_idx"), (F.col("place") + 1).alias("line_no"), "raw", *(["loss"] if loss else []))
        return numbered_in_place(rows.select(F.struct("file", "begin").alias("_split"), F.col("place").alias("_place"), "raw", *(["loss"] if loss else [])), run_idx)
    if loss:
        raise ValueError(f"{path}: what is lost isn't counted in a store that only Spark can open")
    heads = first_bytes(spark, path)
    if any(h.startswith(PACKED) for h in heads):
        return read_any(spark, path, run_idx, exact)
    if any(b"\0" in h for h in heads):
        raise ValueError(f"{path}: binary, not text")
    return read_lines(spark, path, run_idx, exact)


def gunzip_bounded(data: bytes, limit: int) -> bytes:
    """All members of a gzip file, checked, if they come to at most ``limit`` bytes."""
    out, rest = [], data
    room = limit
    while rest:
        d = zlib.decompressobj(wbits=31)
        part = d.decompress(rest, room + 1)
        if len(part) > room:
            raise ValueError("the file is larger than the limit")
        if not d.eof:
            raise ValueError("the gzip file ends early")
        out.append(part)
        room -= len(part)
        rest = d.unused_data
    return b"".join(out)


def decoded(data: bytes, exact: bool = False, limit: int = 1 << 31) -> str:
    """Text of a file: gzip told by its first bytes, UTF-16 by its mark; a NUL elsewhere is refused."""
    if data.startswith(GZIP):
        data = gunzip_bounded(data, limit)
    errors = "strict" if exact else "replace"
    for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[2:].decode(name, errors)
    if b"\0" in data[:HEAD]:
        raise ValueError("binary, not text")
    return data.removeprefix(codecs.BOM_UTF8).decode("utf-8", errors)


def read_any(spark: SparkSession, path: str, run_idx: int = 0, exact: bool = False, limit: int = 1 << 31) -> DataFrame:
    """Like ``read_lines`` for files in gzip whatever their name, or in UTF-16; each file is read by one task."""

    def run(batches):
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    lines = decoded(content, exact, limit).split("\n")
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{name}: {e}") from e
                if lines and not lines[-1]:
                    lines.pop()
                for at in range(0, len(lines), 50_000):
                    part = [re.sub(r"[\r\n]+\Z", "", x) for x in lines[at : at + 50_000]]
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], ["_split", "_place", "raw"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return numbered_in_place(files.mapInArrow(run, "_split string, _place long, raw string"), run_idx)


def from_lines(spark: SparkSession, lines, run_idx: int = 0) -> DataFrame:
    """Lines that the driver holds, such as standard input."""
    return spark.createDataFrame([(run_idx, i + 1, x.rstrip("\r\n")) for i, x in enumerate(lines)], "run_idx int, line_no long, raw string")


def runs(baselines: list[DataFrame], target: DataFrame) -> DataFrame:
    """Baselines in order, then the target, as one DataFrame."""
    out = None
    for i, df in enumerate([*baselines, target]):
        df = df.select(F.lit(i).alias("run_idx"), "line_no", "raw")
        out = df if out is None else out.unionByName(df)
    return out


def bench_log(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` lines of five shapes in shares of 55, 25, 17, 2.8 and 0.2 percent, made where they are read."""

    def some(k: int, below: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(below))

    def hexed(k: int, digits: int):
        return F.substring(F.lower(F.hex(F.xxhash64(F.lit(seed + 1), F.lit(k), "id"))), 1, digits)

    ip = F.concat_ws(".", *[(some(10 + i, 255)).cast("string") for i in range(4)])
    ts = F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 7), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    roll = some(0, 1000)
    body = (
        F.when(roll < 550, F.format_string('INFO %s:%d - "GET /api/v1/items/%d HTTP/1.1" 200 %d', ip, 8000 + some(1, 40), some(2, 100_000), 64 + some(3, 4096)))
        .when(roll < 800, F.format_string("INFO job %s completed in %dms", hexed(1, 8), 1 + some(4, 500)))
        .when(roll < 970, F.format_string("WARN retrying connection to %s:5432 (attempt %d)", ip, 1 + some(5, 3)))
        .when(roll < 998, F.format_string("INFO uploaded %dKiB to s3://bucket/%s/data.bin", 1 + some(6, 2048), hexed(2, 12)))
        .otherwise(F.format_string("ERROR job %s failed: connection reset by peer after %dms", hexed(1, 8), 100 + some(7, 9000)))
    )
    return spark.range(n).select(F.lit(0).alias("run_idx"), (F.col("id") + 1).alias("line_no"), F.concat(ts, F.lit(" "), body).alias("raw"))
