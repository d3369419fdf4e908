"""``python -m driftlens.cli diff|templates|novel``."""

from __future__ import annotations

import argparse
import re
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from driftlens.config import SIGNIFICANCE, THRESHOLD, CustomMask, DiffOptions, check_stdin, check_threshold
from driftlens.operators.lineage import durable
from driftlens.operators.mining import templates
from driftlens.plans import report
from driftlens.plans.diff import diff_runs
from driftlens.sources.lines import from_lines, read, runs
from driftlens.streaming.novel import follow, followed, live, model, novel


def _read(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    if path == "-":
        return from_lines(spark, sys.stdin)
    return read(spark, path, exact=exact)


def _stdin():
    """Lines of standard input as they come, without their ends."""
    for line in iter(sys.stdin.readline, ""):
        yield line.rstrip("\r\n")


def _lines(text: str) -> int:
    """A number of lines, 0 or more."""
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError(f"{text}: must be 0 or more")
    return n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftlens")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--threshold", type=float, default=THRESHOLD)
    common.add_argument("--mask", action="append", default=[])
    common.add_argument("--mask-file")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("diff", parents=[common])
    d.add_argument("inputs", nargs="+")
    d.add_argument("--target")
    d.add_argument("-C", "--context", type=_lines, default=0)
    d.add_argument("--significance", type=float, default=SIGNIFICANCE)
    d.add_argument("--watch-field", action="append", default=[])
    d.add_argument("--watch-by", action="append", default=[])
    d.add_argument("--watch-rate-change", type=float)
    d.add_argument("--flat", action="store_true")
    d.add_argument("--block-lines", type=_lines, default=report.BLOCK_LINES)
    form = d.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true")
    form.add_argument("--markdown", action="store_true")
    t = sub.add_parser("templates", parents=[common])
    t.add_argument("input")
    t.add_argument("-n", type=_lines, default=20)
    t.add_argument("--json", action="store_true")
    n = sub.add_parser("novel", parents=[common])
    n.add_argument("--baseline", action="append", required=True)
    n.add_argument("target", nargs="?", default="-")
    n.add_argument("--follow", metavar="FOLDER", help="take the lines of files that come into this folder")
    n.add_argument("--out", metavar="FOLDER", help="where their novel lines are kept, each once")
    n.add_argument("--once", action="store_true", help="end when all files that are there have been read")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 without findings, 1 with some, 2 for an error or an incomplete watch."""
    a = _parser().parse_args(argv)
    try:
        check_threshold(a.threshold)
        masks = [CustomMask.inline(m) for m in a.mask]
        if a.mask_file:
            with open(a.mask_file, encoding="utf-8") as f:
                masks += CustomMask.load(f)
        spark = spark or SparkSession.builder.appName("driftlens").getOrCreate()
        return {"templates": _templates, "novel": _novel, "diff": _diff}[a.command](a, spark, tuple(masks))
    except BrokenPipeError:
        return 0
    except (ValueError, OSError, re.error) as e:
        print(f"driftlens: {e}", file=sys.stderr)
    except (PySparkException, Py4JJavaError) as e:  # what a task raised while it read
        said = re.findall(r"^(?:[\w.]*(?:Error|Exception)): (.+)", str(e), re.M)
        print(f"driftlens: {said[-1] if said else str(e).splitlines()[0]}", file=sys.stderr)
    return 2


def _templates(a, spark: SparkSession, masks) -> int:
    lines = durable(_read(spark, a.input))
    top = templates(lines, None if a.json else a.n, a.threshold, masks)
    print("\n".join(top.toJSON().collect()) if a.json else report.templates_text(top, lines.count()), end="")
    return 0


def _novel(a, spark: SparkSession, masks) -> int:
    check_stdin([*a.baseline, *([] if a.follow else [a.target])])
    if bool(a.follow) != bool(a.out) or a.follow and a.target != "-" or a.once and not a.follow:
        raise ValueError("--follow takes --out and no target, --once takes --follow")
    base = model(runs([_read(spark, b) for b in a.baseline[:-1]], _read(spark, a.baseline[-1])), a.threshold, masks)
    if a.follow:
        query = follow(spark, a.follow, base, a.out, f"{a.out}/_checkpoint", a.threshold, masks, a.once)
        query.awaitTermination()
        return int(not followed(spark, a.out).isEmpty())
    if a.target == "-":
        found = live(_stdin(), base, a.threshold, masks)
    else:
        found = (r["raw"] for r in novel(_read(spark, a.target), base, a.threshold, masks).orderBy("line_no").toLocalIterator())
    n = 0
    for line in found:
        print(line, flush=a.target == "-")
        n += 1
    return int(n > 0)


def _diff(a, spark: SparkSession, masks) -> int:
    baselines, target = (a.inputs, a.target) if a.target else (a.inputs[:-1], a.inputs[-1])
    if not baselines:
        raise ValueError("a comparison takes a baseline and a target")
    check_stdin([*baselines, target])
    options = DiffOptions(a.threshold, a.significance, not a.flat, 0 if target == "-" else a.context, tuple(a.watch_field), tuple(a.watch_by), a.watch_rate_change, masks)
    exact = bool(a.watch_field)
    d = diff_runs([_read(spark, b, exact) for b in baselines], _read(spark, target, exact), options)
    shown = report.to_json(d) + "\n" if a.json else report.to_markdown(d, baselines, target, a.block_lines) if a.markdown else report.to_text(d, baselines, target, a.block_lines)
    print(shown, end="")
    return d.exit_code()


if __name__ == "__main__":
    sys.exit(main())
