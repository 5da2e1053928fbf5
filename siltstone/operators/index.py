"""Index tables: postings, document lengths, term statistics and hashed vectors."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.frames import ship
from ..functions.text import let, tokens
from .chunk import chunk_documents
from .dense import Hasher


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, term, tf): dl is the document's number of words."""
    words = docs.select(id_col, tokens(F.col(text_col)).alias("t")).select(id_col, F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return words.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def word_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, dl, words) and the columns ``more``: a document's distinct words as they come first, with their numbers ``tf``, in one row, so that nothing is shuffled."""
    ship(docs.sparkSession)
    kept = [id_col, *more]

    def run(batches):
        for b in batches:
            lists = b.column(len(kept))
            dl, flat = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten().dictionary_encode()
            row, many = np.repeat(np.arange(len(lists)), dl), max(len(flat.dictionary), 1)
            pair, first, tf = np.unique(row * many + flat.indices.to_numpy(), return_index=True, return_counts=True)
            order = np.argsort(first)
            words = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(pair[order] % many)), pa.array(tf[order])], ["term", "tf"])
            ends = np.searchsorted(pair[order] // many, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(dl.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), words)], [*kept, "dl", "words"])

    word = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    fields = [*(docs.schema[c] for c in kept), T.StructField("dl", T.LongType()), T.StructField("words", T.ArrayType(word))]
    return docs.select(*kept, tokens(F.col(text_col)).alias("_words")).mapInArrow(run, T.StructType(fields))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n, avgdl); avgdl is 0 for an empty corpus."""
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens(F.col(text_col)))), F.lit(0.0)).alias("avgdl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _hashed(docs: DataFrame, id_col: str, text_col: str, dim: int, blake2b: bool, rows_of, fields: list[T.StructField], whole: bool = False) -> DataFrame:
    """``rows_of`` (ids, unit vectors, or if ``whole`` what they are made of) gives the columns after the id's; nothing is shuffled."""
    ship(docs.sparkSession)
    narrow = docs.select(id_col, tokens(F.col(text_col)).alias("words"))

    def run(batches):
        known = Hasher(dim, blake2b)
        for b in batches:
            yield rows_of(b.column(0), (known.sums if whole else known)(b.column(1)))

    return narrow.mapInArrow(run, T.StructType([docs.schema[id_col], *fields]))


def hash_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = fixed.EMBEDDING_DIM, blake2b: bool = False) -> DataFrame:
    """(id, bucket, weight): unit vectors without their zeros. A text without words has no rows: the zero vector.

    A word's place and sign come from its MD5, which any SQL engine can repeat, or its 8-byte BLAKE2b.
    """

    def rows_of(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        row, bucket = np.nonzero(vectors)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(vectors[row, bucket])], [id_col, "bucket", "weight"])

    return _hashed(docs, id_col, text_col, dim, blake2b, rows_of, [T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.DoubleType())])


def embedded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = fixed.EMBEDDING_DIM, blake2b: bool = False) -> DataFrame:
    """(id, embedding): the same vectors with all their numbers; all zeros for a text without words."""

    def rows_of(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))
        return pa.RecordBatch.from_arrays([ids, lists], [id_col, "embedding"])

    return _hashed(docs, id_col, text_col, dim, blake2b, rows_of, [T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = fixed.EMBEDDING_DIM, blake2b: bool = False) -> DataFrame:
    """(id, counts): the same vectors before they get unit length; whole numbers take much less room."""

    def rows_of(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim), pa.array(sums.ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([ids, lists], [id_col, "counts"])

    return _hashed(docs, id_col, text_col, dim, blake2b, rows_of, [T.StructField("counts", T.ArrayType(T.IntegerType()))], whole=True)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``embedding``, made of ``counts``; to be called behind joins, which then move the smaller column."""
    size = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.withColumn("embedding", let(size, lambda n: F.transform("counts", lambda x: F.coalesce(x.cast("double") / F.nullif(n, F.lit(0.0)), F.lit(0.0)))))


TABLES = ("chunks", "postings", "vectors", "stats")


def write_index(chunks: DataFrame, folder: str, id_col: str = "chunk_id", text_col: str = "content", blake2b: bool = False) -> None:
    """The four tables of the index, as Parquet, in a folder of its own below ``folder``; nothing is shuffled on the way.

    A chunk's postings lie in one row, so that a search scores it where it is;
    vectors are kept as whole numbers.

    The commit, which names that folder, is written last: an index without it
    counts as absent, and several builders don't get in each other's way.
    """
    spark, build = chunks.sparkSession, f"build-{uuid.uuid4().hex}"
    to = lambda df, name: df.write.option("compression", "zstd").parquet(f"{folder}/{build}/{name}")
    to(chunks, "chunks")
    written = spark.read.schema(chunks.schema).parquet(f"{folder}/{build}/chunks")
    to(word_lists(written, id_col, text_col), "postings")
    to(counted(written, id_col, text_col, blake2b=blake2b), "vectors")
    corpus_stats(written, text_col).write.parquet(f"{folder}/{build}/stats")
    spark.range(1).select(F.lit(build).alias("build"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{folder}/commits")


def committed_build(spark: SparkSession, folder: str) -> str | None:
    """The folder of the first index that was written as a whole; None if there's none."""
    try:
        first = spark.read.parquet(f"{folder}/commits").orderBy("at", "build").select("build").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        first = []
    return f"{folder}/{first[0][0]}" if first else None


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    build = committed_build(spark, folder)
    if build is None:
        raise FileNotFoundError(f"no whole index in {folder}")
    tables = {name: spark.read.parquet(f"{build}/{name}") for name in TABLES}
    return tables | {"vectors": unit_vectors(tables["vectors"])}


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """Chunk documents, embed and write them, and read the index back; a chunk's id is its document's and its place."""
    chunks = chunk_documents(docs, id_col=id_col, text_col=text_col)
    write_index(chunks.select(F.concat_ws(":", id_col, "chunk_index").alias("chunk_id"), id_col, "chunk_index", "content"), folder)
    return read_index(docs.sparkSession, folder)


def ensure_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """The index in ``folder``; built first if there's none, or if an earlier build didn't come to its end."""
    if committed_build(docs.sparkSession, folder) is None:
        return build_index(docs, folder, id_col, text_col)
    return read_index(docs.sparkSession, folder)


def index_join(index: dict[str, DataFrame], id_col: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors, by id."""
    return unit_vectors(index["chunks"].join(index["vectors"].drop("embedding"), id_col))
