"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.frames import ship

#: Bits of the coarse filter of ``may_be_among``: 2 MB, however many keys it's made of.
FILTER_BITS = 1 << 24
#: Rows in one Arrow batch; with the byte limit it bounds what a Python worker holds.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send this package to the executors; keep Arrow batches small, so that long texts don't add up in a worker.

    The batch size is the session's, as plans read it when they run; a smaller one stays.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= rows:
        spark.conf.set(size, str(rows))
    ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is named and all runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Later jobs read the files, so a lost executor costs no recomputation of
    what came before. The files stay until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_column(
    df: DataFrame, out_col: str, dtype: T.DataType, start: Callable[[], Callable[..., list]], inputs: list[str]
) -> DataFrame:
    """All columns of ``df`` and ``out_col``, computed from Arrow batches of ``inputs``.

    ``start()`` is called once a task and gives a function from lists of the
    input columns' values to the list of results. A column that is called
    ``out_col`` already is replaced; all others pass through untouched.
    """
    kept = [f for f in df.schema.fields if f.name != out_col]
    names = df.columns
    at = [names.index(f.name) for f in kept]
    of = [names.index(c) for c in inputs]
    arrow = to_arrow_type(dtype)

    def run(batches):
        work = start()
        for batch in batches:
            made = pa.array(work(*(batch.column(i).to_pylist() for i in of)), type=arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), made], [*(f.name for f in kept), out_col])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, dtype)]))


def may_be_among(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash ``column``, a long, may be among ``keys`` (one such column), and those of which it surely isn't.

    Each key sets one of FILTER_BITS bits, whose words go to every task. So rows
    that no key meets need not be shuffled to find that out; the others are to
    be decided by a join. With far more keys than bits, all rows are such.
    """
    bit = lambda c: F.col(c).bitwiseAND(F.lit(FILTER_BITS - 1))
    word, held, place = fresh(rows, "_word", "_held", "_place")
    one = F.expr(f"shiftleft(1L, cast({place} & 63 as int))")
    of = keys.select(bit(keys.columns[0]).alias(place)).groupBy(F.shiftright(place, 6).alias(word)).agg(F.bit_or(one).alias(held))
    marked = rows.withColumn(word, F.shiftright(bit(column), 6)).join(F.broadcast(written(of, "filter")), word, "left")
    hit = F.coalesce(F.getbit(held, bit(column).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return marked.filter(hit).drop(word, held), marked.filter(~hit).drop(word, held)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that ``df`` doesn't have."""
    lead = ""
    while {lead + n for n in names} & set(df.columns):
        lead += "_"
    return [lead + n for n in names]


def remainder(column: str, by: int) -> Column:
    """crc32 of the value as text, modulo ``by``: the folds of the held-out data."""
    return F.crc32(F.col(column).cast("string")) % F.lit(by)


def joined_sha256(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
