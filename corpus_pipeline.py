"""Documents to packed training sequences, stage by stage.

Each stage takes what the one before kept, as a table in the shared folder, and all but the
last return the columns of ``documents``; where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import free_name, shared_folder, table
from driftlens.llm.lines import dedup_lines
from driftlens.llm.neardup import near_duplicates
from driftlens.llm.packing import pack
from driftlens.llm.queries import WORD_BPE
from driftlens.llm.substrings import remove_repeats
from driftlens.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; every document stays, even without a line."""
    return _rewritten(docs, dedup_lines(_apart(docs), min_docs=10, min_chars=1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id stays."""
    name = free_name(docs.columns, "_gone")
    gone = near_duplicates(docs, percent=75).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat 50 bytes or more of a document of a smaller doc_id go."""
    found = remove_repeats(_apart(docs))
    return _rewritten(docs, found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(WORD_BPE))


def _apart(docs: DataFrame) -> DataFrame:
    """All columns but doc_id and text under numbered names, as theirs may be those that an operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_{k}") for k, c in enumerate(docs.columns)))


def _rewritten(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed``, made of ``_apart(docs)``, with the columns of ``docs``; n_chars follows the text."""
    size = lambda c: F.char_length("text").cast(docs.schema[c].dataType)
    return changed.select(*((F.col(c) if c in ("doc_id", "text") else size(c) if c == "n_chars" else F.col(f"_{k}")).alias(c) for k, c in enumerate(docs.columns)))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: SQL has neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; a stage's table goes when the next one's is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if k:
            _delete(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
