"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash. Only a bucket over the
byte limit is split on its next bit, until every shard fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import union
from .common import fresh, table, written

SHARD_BYTES = 16 << 20
#: Bits of a row's hash, half of them its id's, and bits by which one pass over the sizes extends the directory.
HASH_BITS, STEP = 120, 12


def hash_bits(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of the id as text, then 60 of the text's, as zeros and ones; nulls count as empty."""
    bits = lambda x: F.lpad(F.conv(F.substring(F.md5(F.coalesce(x, F.lit(""))), 1, 15), 16, 2), 60, "0")
    return F.concat(bits(F.col(id_col).cast("string")), bits(F.col(text_col).cast("string")))


def _leaves(sums: DataFrame, depth: int, limit: int) -> DataFrame:
    """For each prefix of depth + STEP bits: the shallowest bucket below ``depth`` that fits; null if none does.

    A bucket with only one hash value can't be split and counts as fitting.
    """
    first = depth + (depth > 0)
    at = sums.select("prefix", "bytes", "low", "high", F.explode(F.sequence(F.lit(first), F.lit(depth + STEP))).alias("d"))
    bucket = Window.partitionBy("d", F.substring("prefix", F.lit(1), F.col("d")))
    at = at.withColumns({"n": F.sum("bytes").over(bucket), "one": F.min("low").over(bucket) == F.max("high").over(bucket)})
    fits = F.when((F.col("n") <= limit) | F.col("one"), F.struct("d", "n"))
    return at.groupBy("prefix").agg(F.min(fits).alias("leaf"))


def assign_shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, prefix: str = "") -> DataFrame:
    """``df`` with ``shard`` (bits of its bucket), ``shard_bytes`` and ``doc_bytes``, the names led by ``prefix``.

    Sizes are UTF-8 bytes of the text; null and empty texts have none. A text
    over the limit has a shard of its own, the only kind that is over it.
    Rows of one id share 60 bits, so an id of many rows, null too, is split on
    the bits of its texts. Rows of the same id and text share all bits: if
    together they're over the limit, they are dealt to parts ``bits-0``,
    ``bits-1`` and so on. An empty table gives no rows. Columns of the names
    of the new ones are replaced, all others pass through.

    The sizes are summed by the first 12 bits before anything is decided, so
    the first directory has at most 4,096 rows; further passes read only the
    rows of buckets that are still too large.
    """
    shard, total, size = (f"{prefix}{x}" for x in ("shard", "shard_bytes", "doc_bytes"))
    rows = df.select(*(c for c in df.columns if c not in (shard, total, size)))
    bits, lead, leaf = fresh(rows, "_bits", "_lead", "_leaf")
    rows = rows.withColumns({bits: hash_bits(id_col, text_col), size: F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")})
    keep = rows.columns
    small = rows.select(F.col(bits).alias("bits"), F.col(size).alias("bytes"))
    done, depth = [], 0
    while True:
        known = depth + STEP
        sums = small.groupBy(F.substring("bits", 1, known).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        leaves = written(_leaves(sums, depth, limit), "shard-directory")
        found = leaves.select(F.col("prefix").alias(lead), F.col("leaf").alias(leaf))
        found = F.broadcast(found) if depth == 0 else found  # at most 4,096 rows at first
        rows = rows.withColumn(lead, F.substring(bits, 1, known)).join(found, lead).drop(lead)
        done.append(rows.filter(F.col(leaf).isNotNull()).select(*keep, F.substring(bits, F.lit(1), F.col(f"{leaf}.d")).alias(shard), F.col(f"{leaf}.n").alias(total)))
        if known == HASH_BITS or not leaves.filter("leaf is null").head(1):
            break
        rows = rows.filter(F.col(leaf).isNull()).drop(leaf)
        over = leaves.filter("leaf is null").select("prefix")
        small = small.withColumn("prefix", F.substring("bits", 1, known)).join(over, "prefix", "left_semi").drop("prefix")
        depth = known
    return _dealt(union(*done), shard, total, size, bits, limit)


def _dealt(out: DataFrame, shard: str, total: str, size: str, bits: str, limit: int) -> DataFrame:
    """Split the buckets of a single hash, of equal rows, that are over the limit; all other rows pass."""
    over = F.col(total) > limit
    number = F.row_number().over(Window.partitionBy(bits).orderBy(size))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(size))).cast("long")
    split = out.filter(over).withColumn(shard, F.concat(F.col(shard), F.lit("-"), F.floor((number - 1) / each).cast("string")))
    split = split.withColumn(total, F.sum(size).over(Window.partitionBy(bits, shard)))
    return union(out.filter(~over), split).drop(bits)


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder for each shard; its rows are brought together first, so that it's one file."""
    sharded.repartition(shard_col).write.partitionBy(shard_col).parquet(path)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its shard, the shard's bytes and its own. Null and empty texts have no bytes; null and repeated ids are dealt by their texts; see ``assign_shards``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "shard", "shard_bytes", "doc_bytes")


OP10_SQL = f"""
with d as (select doc_id, coalesce(strlen(text), 0) b, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::bigint h from documents),
     e as (select doc_id, b, h, k, h >> ({HASH_BITS // 2} - k) p from d, (select unnest(range(0, 25)) k)),
     s as (select *, sum(b) over (partition by k, p) n from e),
     r as (select *, row_number() over (partition by doc_id order by k) x from s where n <= {SHARD_BYTES})
select doc_id, right(lpad(bin(p), 64, '0'), cast(k as int)) shard, cast(n as bigint) shard_bytes, cast(b as bigint) doc_bytes from r where x = 1
"""
