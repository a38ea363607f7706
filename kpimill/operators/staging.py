"""Tables that are worked out once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder now, so that what made it runs once and lost executors cost nothing.

    The folder is ``spark.checkpoint.dir``, which driver and executors share; only where that is unset and the master is
    local a temporary one serves.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="kpimill-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
