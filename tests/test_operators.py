"""Hand-computed cases of the retrieval and answer operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import answer, chunk, index, rank, search
from siltstone.sources import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "\n a \t", T.strip) == "a"
    assert one(spark, None, T.tokens) == []
    assert one(spark, "Điều 5: ma_túy × x", T.tokens) == ["điều", "5", "ma_túy", "×", "x"]
    assert one(spark, "https://A.b/Xé-1/", T.slugify) == "a-b-x-1"
    assert one(spark, "https://", T.slugify) == "article"
    assert one(spark, "và a [b1] luật-mới!", T.keywords) == ["[b1]", "luật-mới"]
    assert one(spark, "Hình phạt theo luật", T.classify) == "legal"
    assert one(spark, "ca sĩ", T.classify) == "news"
    assert one(spark, "x", T.classify) is None
    assert one(spark, "a START b and more END c", lambda c: T.between_markers(c, "START", ["END", "c"])) == "START b and more"
    assert one(spark, "---\ntitle: a: b\nx: 1\n---\nbody", T.front_matter) == {"title": "a: b", "x": "1"}


def test_vectors(spark):
    pair = lambda a, b, f: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(f(F.col("a"), F.col("b"))).first()[0]
    assert pair([1.0, 2.0], [3.0], V.dot_product) == 3.0
    assert pair([], [3.0], V.dot_product) == 0.0
    assert pair([1.0], [1.0, 2.0], V.cosine) == 0.0
    assert pair([0.0], [1.0], V.cosine) == 0.0
    assert pair([2.0], [3.0], V.cosine) == pytest.approx(1.0)


def chunks(spark, text):
    return [r["content"] for r in chunk.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()]


def test_chunks(spark):
    assert [len(c) for c in chunks(spark, "a" * 500 + "\n\n" + "b" * 500)] == [500, 551]
    assert [len(c) for c in chunks(spark, "x" * 920 + "\n\ny")] == [500, 470, 20, 1]
    assert chunks(spark, " \n ") == [] and chunks(spark, None) == []
    fixed = chunk.chunk_fixed(spark.createDataFrame([(1, "z" * 501), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], len(r["content"])) for r in fixed] == [(1, 0, 500), (1, 450, 51)]


def test_search(spark):
    docs = spark.createDataFrame([(2, "a b"), (1, "a b"), (3, "c"), (4, None)], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "a"), (2, "a a"), (3, "  ")], "query_id long, query string")
    got = {(r["query_id"], r["rank"]): r for r in search.bm25(docs, qs, 5).collect()}
    assert got[1, 1]["doc_id"] == 1 and got[1, 2]["doc_id"] == 2  # ties by id
    assert got[2, 1]["score"] == pytest.approx(2 * got[1, 1]["score"], abs=2e-6)
    assert {k[0] for k in got} == {1, 2}
    assert search.bm25(docs.limit(0), qs, 5).count() == 0
    v = index.hash_vectors(docs, blake2b=True).filter("doc_id = 3").collect()
    assert [r["bucket"] for r in v] == [int.from_bytes(hashlib.blake2b(b"c", digest_size=8).digest()[:4], "big") % 384] and abs(v[0]["weight"]) == 1
    assert {(r["doc_id"], r["score"]) for r in search.vectorless(docs, qs, 5).filter("query_id = 1").collect()} == {(1, 1.0), (2, 1.0)}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def test_fusion_and_gate(spark):
    a, b = ranked(spark, [(1, 7, 0.9, 1)]), ranked(spark, [(1, 7, 5.0, 1), (1, 8, 2.0, 2)])
    got = rank.rrf([a, b], 5).orderBy("rank").collect()
    assert got[0]["score"] == round(2 / 61, 6) and got[0]["raw"] == 5.0 and got[1]["doc_id"] == 8
    assert [r["score"] for r in rank.merge_dedupe([a, b]).orderBy("rank").collect()] == [0.9, 2.0]
    other = ranked(spark, [(1, 1, 0.1, 1), (2, 1, 0.1, 1)])
    qs, asked = spark.createDataFrame([(1,), (2,)], "query_id long"), []

    def fallback(refused):
        asked.append({r[0] for r in refused.collect()})
        return other.join(refused, "query_id", "left_semi")

    gated = {(r["query_id"], r["retrieval_source"]) for r in rank.fallback_gate(a, qs, fallback).collect()}
    assert asked == [{2}]  # only refused queries are searched for again
    assert gated == {(1, "hybrid"), (2, "pageindex")}
    with pytest.raises(ValueError):
        rank.rerank(a, 1, "no")


@pytest.mark.parametrize("n", range(8))
def test_reorder(spark, n):
    rows = ranked(spark, [(1, i, 1.0, i) for i in range(1, n + 1)])
    got = [r["rank"] for r in answer.reorder_for_llm(rows).orderBy("position").collect()]
    all_ = list(range(1, n + 1))
    assert got == (all_ if n <= 2 else all_[::2] + all_[1::2][::-1])


def test_mmr(spark):
    rows = [(1, [1.0, 0.0], 1, 1.0, [1.0, 0.0]), (1, [1.0, 0.0], 2, 1.0, [1.0, 0.0]), (1, [1.0, 0.0], 3, 0.6, [0.6, 0.8]), (1, [1.0, 0.0], 4, 0.1, None)]
    got = rank.mmr(spark.createDataFrame(rows, "query_id long, query_vec array<double>, vec_id long, score double, embedding array<double>"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3]


def test_citations(spark):
    src = "array<struct<rank:long,source:string,text:string>>"
    f = lambda a, s: spark.createDataFrame([(a, s)], f"a string, s {src}").select(answer.faithfulness(F.col("a"), F.col("s"))).first()[0]
    s = [(1, "law.md", "x")]
    assert [f("no mark", s), f("so [law]", s), f("so [zzz]", s), f("", s), f("x", None)] == [0.2, 1.0, 0.5, 0.0, 0.0]


def test_pages(spark):
    html = '<html><title>T</title><script>var t="</p>";</script><article><h1>A &amp; B</h1><p>' + "word " * 10 + "<p>short</p><p>" + "word " * 10 + "</p></article>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in ingest.standardize(pages).collect()}
    assert got[1]["title"] == "A & B" and got[1]["body"] == ("word " * 10).strip()
    assert got[2]["title"] == "Unknown title"
