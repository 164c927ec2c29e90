"""Where queries that write keep their tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the folder that the cluster shares (spark.checkpoint.dir).

    Only where none is set and Spark runs in one process, a temporary folder serves, which goes with the process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="matchloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        shared = f"file://{_own[0]}"
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
