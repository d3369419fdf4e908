"""Sum-of-squares packing of documents into sequences of a fixed length.

Documents become token ids and an end mark; only longer ones are cut.  The pieces, a few
numbers each, are dealt into packing groups of about ``GROUP`` pieces by a hash, so that
every group sees the whole mix of lengths, and each group is packed on its own.  The
number of groups follows the number of pieces, so no task grows with the input, and what
a group wastes at its end is a handful of sequences in thousands.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import SLICE_BYTES, cut_lineage, slices
from driftlens.llm.tokens import WordCoder

CAPACITY = 2048
GROUP = 32_768


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; a null text is an empty one."""

    def run(batches):
        coder = WordCoder.of(vocabulary)
        for part in slices(batches, "text", 3 * SLICE_BYTES):
            flat, bounds = coder.ids(part.column(1))
            flat = np.insert(flat.astype("<u4"), bounds[1:], end_id)
            begin = bounds[:-1] + np.arange(len(bounds) - 1)
            n = np.diff(bounds) + 1
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begin[row] + start).tolist(), (begin[row] + start + length).tolist(), strict=True)]
            yield pa.record_batch(
                [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order given.

    ``open_[g]`` counts the open sequences with g places left.  A piece goes into the open
    sequence for which the sum of the squares of these counts comes out smallest; the
    smallest gap decides ties.  A new sequence is begun only where no open one has room:
    with the longest pieces first that wastes least (0.1 % over the bound on real lengths).
    """
    open_ = np.zeros(capacity + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    which, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    gain = np.zeros(capacity + 1, np.int64)  # change of the sum when a sequence comes to have this gap
    for i, s in enumerate(lengths.tolist()):
        # a sequence with gap g becomes one with gap g - s; gap 0 is full and isn't counted
        fits = open_[s:capacity]
        gap = capacity
        if fits.any():
            gain[: fits.size] = 2 * (open_[: fits.size] - fits) + 2
            gain[0] = 1 - 2 * fits[0]
            gap = s + int(np.where(fits > 0, gain[: fits.size], np.iinfo(np.int64).max).argmin())
        if gap == capacity:
            seq, made = made, made + 1
        else:
            seq = members[gap].pop()
            open_[gap] -= 1
        which[i], offset[i] = seq, capacity - gap
        if gap > s:
            members[gap - s].append(seq)
            open_[gap - s] += 1
    return which, offset


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Each piece with its sequence_id and its offset there.

    Within a group the pieces come longest first.  Empty and null texts are a piece of one
    token, the end mark; repeated rows are packed each; an empty table gives no rows; a
    null doc_id stays null.
    """
    cut = cut_lineage(pieces(docs, vocabulary, capacity))
    groups = max(1, -(-cut.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        seq, offset = sum_of_squares(pdf.length.to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf.packing_group.astype("int64") * (1 << 32) + seq, offset=offset).drop(columns="packing_group")

    kept = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    keyed = cut.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return keyed.groupBy("packing_group").applyInPandas(run, kept)
