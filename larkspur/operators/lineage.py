"""Cutting lineage between the steps of a loop, and the folder for what a query stores on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Busy(Exception):
    """Another writer is at work, or has committed since this one began: wait, read again and repeat."""


def cut(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed in the shared folder that the session names, or kept in memory and on disk where it names none."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not sc._jsc.sc().getCheckpointDir().isDefined():
        return df.persist()
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir. Where that is unset, a temporary one of this machine if all executors are its threads, else an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
