"""Small tables that are read more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """Cuts lineage in the checkpoint folder that the session names, or where none is set and the master is local, in one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factorlab-"))
    return df.checkpoint()
