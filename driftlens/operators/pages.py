"""Pages of findings and of a ledger, each begun behind the last row of the one before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from driftlens.operators.compare import kind_rank

# Fixed values.
FINDINGS_PAGE, LEDGER_PAGE = 50, 32


def matching(rows: DataFrame, texts: list, query: str) -> DataFrame:
    """Rows one of whose ``texts`` holds ``query``, whatever its case; all of them where it is blank."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(t), F.lit(wanted)), F.lit(False)) for t in texts]))


def page(rows: DataFrame, keys: list[tuple[str, bool]], size: int, after: Row | None = None) -> DataFrame:
    """The ``size`` rows that follow ``after`` (a row of the page before) by ``keys`` (column, whether the greater come first).

    Keys aren't null and no two rows share all of them.  What lies before isn't counted or
    sorted past: a page is a filter and a top-k, whichever it is.
    """
    if after is not None:
        behind: Column = F.lit(False)
        for name, greater in reversed(keys):
            c, v = F.col(name), F.lit(after[name])
            behind = (c < v if greater else c > v) | ((c == v) & behind)
        rows = rows.where(behind)
    return rows.orderBy(*[F.desc(n) if greater else F.asc(n) for n, greater in keys]).limit(size)


def findings_page(findings: DataFrame, kind: str | None = None, query: str = "", after: Row | None = None, size: int = FINDINGS_PAGE) -> DataFrame:
    """Findings by kind, score and template; only those of a kind, or whose template or first lines hold a text."""
    rows = findings if kind is None else findings.where(F.col("kind") == kind)
    rows = matching(rows, [F.col("template"), F.col("first_target_raw"), F.col("first_baseline_raw")], query)
    none = F.lit(-1)
    rows = rows.withColumn("rank", kind_rank(F.col("kind"))).withColumn("place", F.coalesce("pos", none)).withColumn("text", F.coalesce("value", F.lit("")))
    return page(rows, [("rank", False), ("score", True), ("place", False), ("cid", False), ("text", False)], size, after)


def ledger_page(values: DataFrame, query: str = "", after: Row | None = None, size: int = LEDGER_PAGE) -> DataFrame:
    """Values of a ledger by group and value; only those that hold a text, or whose group does."""
    rows = values.withColumn("group", F.coalesce(F.to_json("group_json"), F.lit("")))
    return page(matching(rows, [F.col("value_json"), F.col("group")], query), [("pointer", False), ("group", False), ("value_json", False)], size, after)
