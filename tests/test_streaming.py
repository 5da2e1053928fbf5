"""The index that changes by micro-batches equals the one that is built at once; half-written ones don't count."""

import shutil

import pytest
from pyspark.sql import functions as F

from siltstone.operators import index, search
from siltstone.streaming import incremental
from siltstone.streaming.incremental import changes, compact, embed_new, index_batch, index_stream, read_stream_index


def test_stream_index(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    docs.filter("doc_id < 60").write.parquet(source)
    stream = lambda: spark.readStream.schema(docs.schema).parquet(source)
    index_stream(stream(), folder, str(tmp_path / "state")).awaitTermination()
    docs.filter("doc_id >= 60").write.mode("append").parquet(source)
    index_stream(stream(), folder, str(tmp_path / "state")).awaitTermination()
    index_stream(stream(), folder, str(tmp_path / "state")).awaitTermination()  # nothing new
    index_batch(docs.filter("doc_id < 60"), 0, folder)  # as after a failure
    grown, whole = read_stream_index(spark, folder), index.build_index(docs, str(tmp_path / "whole"))
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id query_id", "text query")
    assert grown["chunks"].count() == whole["chunks"].count() > 200
    for find in (search.bm25_index, search.dense_index):
        rows = [sorted(map(tuple, find(x, q, 5).collect())) for x in (grown, whole)]
        assert rows[0] == rows[1] and len(rows[0]) == 5 * q.count()


def same_as_fresh(spark, folder, docs, tmp_path, name):
    grown, whole = read_stream_index(spark, folder), index.build_index(docs, str(tmp_path / name))
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta changed"), (3, "none")], "query_id long, query string")
    for table in ("chunks", "postings", "stats"):
        cols = sorted(whole[table].columns)
        assert sorted(map(str, grown[table].select(cols).collect())) == sorted(map(str, whole[table].select(cols).collect())), table
    for find in (search.bm25_index, search.dense_index):
        assert sorted(map(tuple, find(grown, q, 4).collect())) == sorted(map(tuple, find(whole, q, 4).collect()))
    assert grown["vectors"].count() == whole["vectors"].count()


def test_updates_and_removals_equal_a_fresh_build(spark, tmp_path):
    folder = str(tmp_path / "index")
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, gone boolean")
    run = lambda rows, batch: index_batch(of(rows), batch, folder, deleted_col="gone")
    want = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    long = "alpha beta gamma. " * 60
    with pytest.raises(FileNotFoundError):
        read_stream_index(spark, folder)
    compact(spark, folder)  # nothing to do yet
    run([(1, "alpha one", None), (2, long, False), (3, "gamma", None), (None, "lost", None), (5, None, None)], 0)
    same_as_fresh(spark, folder, want([(1, "alpha one"), (2, long), (3, "gamma"), (5, None)]), tmp_path, "a")
    run([(2, "beta changed", None), (3, None, True), (4, "delta", None), (9, None, True)], 1)
    state = [(1, "alpha one"), (2, "beta changed"), (4, "delta"), (5, None)]
    same_as_fresh(spark, folder, want(state), tmp_path, "b")
    run([(2, "beta changed", None), (3, None, True), (4, "delta", None), (9, None, True)], 1)  # again, as after a failure
    same_as_fresh(spark, folder, want(state), tmp_path, "c")
    compact(spark, folder)
    compact(spark, folder)
    same_as_fresh(spark, folder, want(state), tmp_path, "d")
    assert len(incremental.committed(spark, folder)) == 1
    run([(3, "gamma is back", None), (1, None, True), (4, "delta", None), (4, None, True)], 2)
    state = [(2, "beta changed"), (3, "gamma is back"), (5, None)]
    same_as_fresh(spark, folder, want(state), tmp_path, "e")
    shutil.copytree(f"{folder}/chunks/at=4", f"{folder}/chunks/at=6")  # a batch that didn't come to its commit
    same_as_fresh(spark, folder, want(state), tmp_path, "f")
    run([(2, None, True), (3, None, True), (5, None, True)], 3)
    assert read_stream_index(spark, folder)["chunks"].collect() == [] and read_stream_index(spark, folder)["stats"].first()["n"] == 0


def test_only_changed_texts_are_embedded(spark, tmp_path):
    folder = str(tmp_path / "index")
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index_batch(of([(1, "alpha"), (2, "beta"), (3, "beta")]), 0, folder)
    count = lambda place: spark.read.parquet(f"{folder}/vectors/at={place}").count()
    assert count(0) == 2  # equal texts once
    index_batch(of([(1, "alpha"), (2, "gamma"), (4, "beta"), (5, "delta")]), 1, folder)
    assert count(2) == 2  # gamma and delta
    compact(spark, folder)
    index_batch(of([(6, "alpha"), (7, "epsilon")]), 2, folder)
    assert count(4) == 1
    known = spark.read.parquet(f"{folder}/vectors/at=0")
    assert embed_new(spark.createDataFrame([("beta",), ("zeta",), ("zeta",)], "content string"), known).count() == 1
    before, now = of([(1, "a"), (2, "b"), (3, None), (4, "d")]), of([(1, "a"), (2, "B"), (3, None), (5, "e")])
    assert sorted(map(tuple, changes(now, before).collect())) == [(2, "B", False), (4, None, True), (5, "e", False)]


def test_half_an_index_is_built_anew(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    folder = str(tmp_path / "index")
    assert index.committed_build(spark, folder) is None
    index.ensure_index(docs, folder)
    build = index.committed_build(spark, folder)
    shutil.rmtree(f"{folder}/commits")
    shutil.rmtree(f"{build}/vectors")  # as if the builder had died
    with pytest.raises(FileNotFoundError):
        index.read_index(spark, folder)
    assert index.ensure_index(docs, folder)["vectors"].count() == 2
    again = index.committed_build(spark, folder)
    assert again != build
    index.build_index(docs.filter("doc_id = 1"), folder)  # a second builder that came too late
    assert index.committed_build(spark, folder) == again and index.ensure_index(docs.limit(0), folder)["chunks"].count() == 2
    empty = index.ensure_index(docs.limit(0), str(tmp_path / "empty"))
    assert empty["chunks"].collect() == [] and empty["stats"].select("n", F.col("avgdl")).first() == (0, 0.0)
