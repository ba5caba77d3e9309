"""Tables that are computed once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which cuts its lineage, so that an executor's loss doesn't change it.

    The folder is spark.checkpoint.dir.  Where none is set, a session on one machine gets a temporary one, and one on a cluster an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="sitelens-")
        sc.setCheckpointDir(root)
    return df.checkpoint()
