"""Where a job keeps intermediate files."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder(context.applicationId)


@lru_cache
def _local_folder(application: str) -> str:
    """One temporary folder per local application."""
    return tempfile.mkdtemp(prefix="deskflow-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
