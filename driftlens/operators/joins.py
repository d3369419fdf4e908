"""Joins that keep heavy keys apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that are broadcast whole at most; some numbers a row, so a few MB.
FEW = 100_000
#: Keys that hold more than one of this many rows are heavy; there are at most as many of them.
HEAVY = 10_000


def lookup(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row a key, small values); null where a key is null or not found.

    ``found._n`` tells how many of ``rows`` have the key.  A ``found`` of at most ``FEW``
    rows is broadcast.  Of a larger one, only keys with more than one of ``HEAVY`` rows, so
    at most ``HEAVY`` keys, are broadcast, and only rows of the others are shuffled: no task
    gets all rows of a heavy key.  Both are read several times and should be cheap to read.
    """
    size, total = found.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    new = [c for c in found.columns if c not in keys and c != "_n"]
    if size <= FEW:
        return rows.join(F.broadcast(found.drop("_n")), keys, "left").select(*rows.columns, *new)
    many = F.col("_n") > max(1, total // HEAVY)
    heavy, few = F.broadcast(found.where(many).drop("_n")), found.where(~many).drop("_n")
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    whole = rows.where(known)
    alone = rows.where(f"NOT ({known})").select("*", *(F.lit(None).cast(few.schema[c].dataType).alias(c) for c in new))
    light = whole.join(heavy.select(*keys), keys, "left_anti").join(few, keys, "left")
    return whole.join(heavy, keys).select(*rows.columns, *new).unionByName(light.select(*rows.columns, *new)).unionByName(alone)
