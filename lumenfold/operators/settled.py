"""Tables that are computed once, so that whatever is read twice from them agrees."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all machines see, and read from there; lost executors lose nothing.

    The folder is the session's ``spark.checkpoint.dir``. Only where everything runs on one machine is one made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster see")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenfold-"))
    return df.checkpoint()
