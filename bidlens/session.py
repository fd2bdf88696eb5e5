"""What the library needs of a session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows of an Arrow batch, where the session has Spark's default: of long texts these are some MB, and a
#: task keeps several batches.
ARROW_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver has it, if it is not installed there (--py-files does as well)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(ARROW_ROWS))
    return spark
