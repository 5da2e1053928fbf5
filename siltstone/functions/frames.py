"""Functions of whole DataFrames."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: More partitions than any part of a union has.
MOST = 1 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session's application: functions on Arrow batches import it there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{top.name}", "zip", top.parent, top.name))
        _shipped.add(context.applicationId)


def union(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns, by name.

    Spark 4.1 takes a union of parts that are hashed alike for hashed, too,
    though adaptive execution may have coalesced each part differently; rows
    of one key then lie in several partitions. Coalescing to more partitions
    than there are moves nothing, but makes Spark forget how a part is hashed.
    """
    return reduce(DataFrame.unionByName, [f.coalesce(MOST) for f in frames])


def attempt(work, value, keep: bool):
    """(result, None) of ``work(value)``, or (None, cause) if it fails and errors are kept."""
    try:
        return work(value), None
    except Exception as e:
        if not keep:
            raise
        return None, f"{type(e).__name__}: {e}"[:300]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where all runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows reads it as often as it likes, and a lost executor costs no more than that."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
