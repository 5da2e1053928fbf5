"""Fusing, reranking, boosting and gating of ranked lists (query_id, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.frames import stored, union
from ..functions.text import classify, tokens, token_set, WORD
from .ranked import ranked
from .search import bm25, counts_cosine, hash_dense, overlap, vectorless


def _together(lists: list[DataFrame]) -> DataFrame:
    cols = ["query_id", "doc_id", "score", "rank"]
    return union(*(x.select(*cols, F.lit(i).alias("list")) for i, x in enumerate(lists)))


def rrf(lists: list[DataFrame], k: int, constant: int = fixed.RRF_K) -> DataFrame:
    """(query_id, doc_id, score, raw, rank): reciprocal ranks summed; raw is the highest score of any list."""
    sums = _together(lists).groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 6).alias("score"), F.max(F.col("score").cast("double")).alias("raw"))
    return ranked(sums, k)


def max_merge(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    return ranked(_together(lists).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def merge_dedupe(lists: list[DataFrame]) -> DataFrame:
    """The lists one after another; of the same document the first stays."""
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("list", "rank"))
    kept = _together(lists).withColumn("_n", first).filter("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank")).cast("long")).drop("list")


def dedupe_prefix(results: DataFrame, length: int = 300) -> DataFrame:
    """Of a query's results with the same first ``length`` characters, the best ranked stays."""
    first = F.row_number().over(Window.partitionBy("query_id", F.left("text", F.lit(length))).orderBy("rank"))
    return results.withColumn("_n", first).filter("_n = 1").drop("_n")


def with_texts(results: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The results, a few a query, are written once: of their real size Spark can tell that the texts needn't be shuffled to meet them."""
    return stored(results, "results").join(docs, "doc_id").join(queries, "query_id")


def rerank_formula(results: DataFrame, k: int) -> DataFrame:
    """Overlap, count cosine, old score and old rank, weighed; replaces ``score``. Needs text and query.

    The candidates, a few a query, are written once, as their words are counted from several sides.
    """
    rows = stored(results, "candidates").withColumns({"_d": tokens(F.col("text"), WORD), "_q": tokens(F.col("query"), WORD)})
    rows = counts_cosine(rows, "_q", "_d", ["query_id", "doc_id"], "_cosine")
    new = fixed.W_OVERLAP * overlap(F.array_distinct("_q"), F.array_distinct("_d")) + fixed.W_COSINE * F.col("_cosine") + fixed.W_ORIGINAL * F.col("score") + fixed.W_RANK / (fixed.RRF_K + F.col("rank"))
    return ranked(rows.withColumn("score", F.round(new, 6)).drop("_d", "_q", "_cosine"), k)


def rerank_linear(results: DataFrame, k: int) -> DataFrame:
    """Of equal beginnings the first; then 0.7 of the old score and 0.3 of the overlap."""
    o = overlap(token_set(F.col("query")), token_set(F.col("text")))
    return ranked(dedupe_prefix(results).withColumn("score", F.round(0.7 * F.col("score") + 0.3 * o, 6)), k)


def rerank_length_mod(results: DataFrame, k: int) -> DataFrame:
    return ranked(results.withColumn("score", F.round(F.col("score") + F.length("text") % 10 * 0.01, 6)), k)


def rerank(results: DataFrame, k: int, method: str = "cross_encoder") -> DataFrame:
    if method in ("cross_encoder", "mmr"):
        return rerank_formula(results, k)
    if method == "rrf":
        return rrf([results], k)
    raise ValueError(f"unknown method {method!r}")


def mmr(candidates: DataFrame, k: int = fixed.TOP_K, weight: float = fixed.MMR_LAMBDA) -> DataFrame:
    """(query_id, vec_id, score, rank): picked one by one for relevance and against likeness to those picked.

    ``candidates``: query_id, query_vec, vec_id, score, embedding; a bounded
    top-k list for each query. Without an embedding the relevance is the score.
    Of ties the first by falling score, then id, wins; the score stays.
    """
    import numpy as np
    import pandas as pd

    def unit(v):
        if v is None or len(v) == 0:
            return None
        v = np.asarray(v, float)
        n = np.linalg.norm(v)
        return v / n if n else v

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "vec_id"], ascending=[False, True])
        q, vs, scores = unit(rows.query_vec.iloc[0]), [unit(v) for v in rows.embedding], rows.score.tolist()
        like = lambda a, b: float(a @ b) if a is not None and b is not None and len(a) == len(b) else 0.0
        relevance = [like(q, v) if v is not None else s for v, s in zip(vs, scores, strict=True)]
        left, picked = list(range(len(vs))), []
        while left and len(picked) < k:
            value = lambda i: weight * relevance[i] - (1 - weight) * max([0.0, *(like(vs[i], vs[j]) for j in picked)])
            best = max(left, key=lambda i: (value(i), -i))
            picked.append(best)
            left.remove(best)
        out = rows.iloc[picked][["query_id", "vec_id", "score"]].copy()
        out["rank"] = range(1, len(picked) + 1)
        return out

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, score double, rank long")


def domain_boost(results: DataFrame, hints: dict[str, list[str]] = fixed.HINTS, type_col: str = "type", boost: float = fixed.DOMAIN_BOOST) -> DataFrame:
    """More for documents of the type that the query hints at; ranks anew. Without a hint nothing changes."""
    wanted = classify(F.col("query"), hints)
    return ranked(results.withColumn("score", F.round(F.col("score") + F.when(wanted == F.col(type_col), boost).otherwise(0.0), 6)))


def fallback_gate(results: DataFrame, queries: DataFrame, fallback, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """The results of queries whose best score reaches the threshold; for the others those of ``fallback(refused queries)``.

    Only refused queries are searched for again. ``retrieval_source`` says which it was.
    """
    good = results.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= threshold).select("query_id")
    cols = ["query_id", "doc_id", "score", "rank"]
    kept = results.join(good, "query_id", "left_semi").select(*cols, F.lit("hybrid").alias("retrieval_source"))
    again = fallback(queries.join(good, "query_id", "left_anti"))
    return union(kept, again.select(*cols, F.lit("pageindex").alias("retrieval_source")))


def retrieve_hybrid(docs: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, threshold: float = fixed.THRESHOLD, reranking: bool = True, hints: dict = fixed.HINTS, type_col: str = "lang") -> DataFrame:
    """Dense and lexical lists fused, boosted, reranked, boosted again and gated."""
    many = k * fixed.OVER_FETCH
    fused = stored(rrf([hash_dense(docs, queries, many), bm25(docs, queries, many)], many), "fused")
    boosted = domain_boost(with_texts(fused, docs.select("doc_id", "text", F.col(type_col).alias("type")), queries), hints)
    final = rerank_formula(boosted, k) if reranking else boosted.filter(F.col("rank") <= k)
    final = stored(domain_boost(final, hints).select("query_id", "doc_id", "score", "rank"), "reranked")
    return fallback_gate(final, queries, lambda refused: vectorless(docs, refused, k, content=False), threshold)


def retrieve_linear(docs: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, threshold: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank, retrieval_source): both lists one after the other, reranked linearly, cut at the threshold.

    Queries that keep fewer than k results get the lexical list, as the
    vectorless search, put behind theirs, and the whole is reranked.
    """
    texts, cols = docs.select("doc_id", "text"), ["query_id", "doc_id", "score", "rank"]
    lexical = stored(bm25(docs, queries, 2 * k), "lexical")
    out = rerank_linear(with_texts(merge_dedupe([hash_dense(docs, queries, 2 * k), lexical]), texts, queries), 2 * k).select(*cols)
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    out = stored(out, "reranked")
    enough = out.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    few = out.join(enough, "query_id", "left_anti")
    more = merge_dedupe([few, lexical.join(enough, "query_id", "left_anti")])
    topped = rerank_linear(with_texts(more, texts, queries), k).select(*cols)
    own = few.select("query_id", "doc_id", F.lit("hybrid").alias("retrieval_source"))
    topped = topped.join(own, ["query_id", "doc_id"], "left").withColumn("retrieval_source", F.coalesce("retrieval_source", F.lit("pageindex")))
    kept = out.join(enough, "query_id", "left_semi").filter(F.col("rank") <= k).withColumn("retrieval_source", F.lit("hybrid"))
    return union(kept, topped)


def retrieve_maxmerge(docs: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, threshold: float = fixed.THRESHOLD) -> DataFrame:
    lists = max_merge([hash_dense(docs, queries, k), bm25(docs, queries, k)])
    final = stored(rerank_length_mod(with_texts(lists, docs.select("doc_id", "text"), queries), k).select("query_id", "doc_id", "score", "rank"), "reranked")
    return fallback_gate(final, queries, lambda refused: vectorless(docs, refused, k, content=False), threshold)
