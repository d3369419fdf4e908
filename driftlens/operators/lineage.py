"""Where a plan is written and read again."""

from __future__ import annotations

import tempfile
import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary one on a local master, as in tests; a cluster's
    executors could not see that, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = sc.master == "local" or sc.master.startswith("local[")
        if not named and not alone:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not alone and sc.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints", "false") != "true":
            warnings.warn("set spark.cleaner.referenceTracking.cleanCheckpoints=true, or checkpoints stay in the shared folder for good", stacklevel=2)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftlens-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder, to go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
