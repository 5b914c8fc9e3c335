"""Where the lineage of a loop over tables is cut: reliable checkpoints in the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``; a lost executor then costs its tasks only.

    Where neither that setting nor a checkpoint folder is given, a session on one machine gets a
    temporary folder; a cluster has none that its machines share, so this raises.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
