"""Folders for what a query writes on its way."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset (a session of one machine, as in tests), in one that goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lorespring-")
        atexit.register(shutil.rmtree, shared, True)
        shared = "file://" + shared
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
