"""Answers grounded in retrieved chunks: intents, selection by kind, refusals and answers by rule.

Results have query_id, query, rank, score, text, source and type; few rows a query.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.frames import stored, union
from ..functions.text import contains_any, keyword_sentences
from .answer import REFUSAL, best_evidence, build_prompt, format_context, generate_answers, reorder_for_llm
from .facts import PROHIBITED, Section, first_sections
from .rank import dedupe_prefix, retrieve_hybrid, retrieve_linear, with_texts

INSUFFICIENT = "The penalty can't be verified, as no text of the code was found. Sources at hand: "
NO_SOURCE = "no fitting source"
LEAD, CLOSING = "According to the retrieved documents:", "Only the sources named above are used."
BASIS, CASES, NEAREST = "Legal basis", "Cases from the news:", "The nearest passages:"


def result_key(source: Column, chunk_index: Column, content: Column) -> Column:
    """source::chunk_index::first 120 characters; the content alone if there's neither source nor index."""
    key = F.concat_ws("::", F.coalesce(source, F.lit("")), F.coalesce(chunk_index.cast("string"), F.lit("")), F.left(content, F.lit(120)))
    return F.when((F.coalesce(source, F.lit("")) == "") & chunk_index.isNull(), content).otherwise(key)


def normalize_source(source: Column) -> Column:
    return F.when(source == "pageindex", "pageindex").otherwise("hybrid")


def query_intents(query: Column, hints: dict[str, list[list[str]]] = fixed.INTENTS) -> dict[str, Column]:
    """For each intent, whether the text holds one of the words of each of its lists."""
    low = F.lower(query)
    out = {}
    for name, lists in hints.items():
        test = F.lit(True)
        for words in lists:
            test = test & contains_any(low, words)
        out[name] = test
    out["prohibited"] = out["prohibited"] | out.pop("prohibited_acts") if "prohibited_acts" in out else out["prohibited"]
    out["mixed"] = out["storage"] | out["crime"]
    return out


def classify_intent(queries: DataFrame, results: DataFrame, hints: dict = fixed.INTENTS, code: list[str] = fixed.CODE_EVIDENCE) -> DataFrame:
    """(query_id, an intent a column, code_evidence): the last says whether a result's source or text names the code."""
    evidence = results.groupBy("query_id").agg(F.bool_or(contains_any(F.lower(F.concat_ws(" ", "source", "text")), code)).alias("code_evidence"))
    out = queries.select("query_id", *(c.alias(k) for k, c in query_intents(F.col("query"), hints).items())).join(evidence, "query_id", "left")
    return out.withColumn("code_evidence", F.coalesce("code_evidence", F.lit(False)))


def is_legal(kind: Column, source: Column) -> Column:
    return F.coalesce((kind == "legal") | F.lower(source).contains("legal") | source.contains("ND_CP"), F.lit(False))


def is_news(kind: Column, source: Column) -> Column:
    return F.coalesce((kind == "news") | F.lower(source).contains("news"), F.lit(False))


def mentions(text: Column, words: list[str] = fixed.STORAGE_MENTIONS) -> Column:
    return F.coalesce(contains_any(F.lower(text), words), F.lit(False))


def quota_selection(results: DataFrame, k: int, hints: dict = fixed.INTENTS, storage: list[str] = fixed.STORAGE_MENTIONS) -> DataFrame:
    """The k chunks of a query to answer from, with a rank of their own.

    Legal chunks come first, in order, but for those whose beginning the first
    holds already. A question about storage or a crime gets news behind them:
    those that mention storage, or else any. Without any choice the list's own
    first k stay. Of equal beginnings the first stays.
    """
    by = Window.partitionBy("query_id")
    rows = results.withColumns({"_legal": is_legal(F.col("type"), F.col("source")) & (F.coalesce("text", F.lit("")) != ""), "_news": is_news(F.col("type"), F.col("source"))})
    rows = rows.withColumns({"_mixed": query_intents(F.col("query"), hints)["mixed"], "_storage": F.col("_news") & mentions(F.col("text"), storage)})
    first = F.min_by(F.when(F.col("_legal"), F.col("text")), F.when(F.col("_legal"), F.col("rank"))).over(by)
    at = F.min(F.when(F.col("_legal"), F.col("rank"))).over(by)
    rows = rows.withColumns({"_first": first, "_at": at, "_any": F.max("_storage").over(by)})
    legal = F.col("_legal") & ((F.col("rank") == F.col("_at")) | ~F.contains("_first", F.left("text", F.lit(300))))
    news = F.col("_mixed") & ~legal & F.when(F.col("_any"), F.col("_storage")).otherwise(F.col("_news"))
    rows = rows.withColumn("_group", F.when(legal, 0).when(news, 1).otherwise(2))
    rows = rows.withColumn("_some", F.min("_group").over(by) < 2).filter((F.col("_group") < 2) | ~F.col("_some"))
    chosen = rows.withColumn("rank", F.row_number().over(by.orderBy("_group", "rank"))).filter(F.col("rank") <= k)
    kept = dedupe_prefix(chosen).withColumn("rank", F.row_number().over(by.orderBy("rank")).cast("long"))
    return kept.drop("_legal", "_news", "_mixed", "_storage", "_first", "_at", "_any", "_group", "_some")


def _lines(rows: DataFrame, line: Column, order: list[str], out: str, between: str = "\n") -> DataFrame:
    lists = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(lists, lambda x: x["line"]), between).alias(out))


def insufficient_answer(queries: DataFrame, results: DataFrame, most: int = fixed.EVIDENCE_LIMIT) -> DataFrame:
    """(query_id, answer): a refusal that names the distinct sources of the first results."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]))
    known = results.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(names, ", ").alias("names"))
    return queries.select("query_id").join(known, "query_id", "left").select("query_id", F.concat(F.lit(INSUFFICIENT), F.coalesce(F.nullif("names", F.lit("")), F.lit(NO_SOURCE)), F.lit(".")).alias("answer"))


def grounded_answer(queries: DataFrame, results: DataFrame, hints: dict = fixed.INTENTS, code: list[str] = fixed.CODE_EVIDENCE, overviews: DataFrame | None = None, **terms) -> DataFrame:
    """(query_id, answer), by the first rule that fits: a refusal without results; an overview of facts for a question
    with its intent; a refusal that names its sources for one about a penalty without the code's text; the best
    evidence, each sentence with its source; a refusal.

    ``overviews`` has an intent and its overview a row, few in all; the first of the intents in ``hints`` counts.
    """
    bullets = _lines(best_evidence(results, **terms), F.concat(F.lit("- "), "sentence", F.lit(" ["), "source", F.lit("]")), ["rank"], "bullets")
    refused = insufficient_answer(queries, results).withColumnRenamed("answer", "refused")
    rows = classify_intent(queries, results, hints, code).join(refused, "query_id").join(bullets, "query_id", "left")
    some = results.select("query_id").distinct().withColumn("some", F.lit(True))
    rows = rows.join(some, "query_id", "left")
    told = F.lit(None).cast("string")
    if overviews is not None:
        names = [k for k in hints if k in rows.columns]
        wide = overviews.agg(*(F.max(F.when(F.col("intent") == k, F.col("overview"))).alias(f"_{k}") for k in names))
        rows = rows.crossJoin(F.broadcast(wide))  # one row
        told = F.coalesce(*(F.when(F.col(k), F.col(f"_{k}")) for k in names))
    whole = F.concat(F.lit(LEAD + "\n"), "bullets", F.lit("\n" + CLOSING))
    answer = F.when(F.col("some").isNull(), REFUSAL).when(told.isNotNull(), told).when(F.col("penalty") & ~F.col("code_evidence"), F.col("refused")).otherwise(F.coalesce(whole, F.lit(REFUSAL)))
    return rows.select("query_id", answer.alias("answer"))


def generate(docs: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, complete=None, hints: dict = fixed.INTENTS, code: list[str] = fixed.CODE_EVIDENCE, domain: dict = fixed.HINTS, overviews: DataFrame | None = None, **retrieval) -> DataFrame:
    """(query_id, answer, sources, retrieval_source), from retrieval to answer.

    At least 8 results are fetched and put in order for a model. ``complete``
    takes a list of prompts and gives their answers; without it the answer is
    by rule. ``sources`` has the results' ids in the order of retrieval.
    """
    found = stored(retrieve_hybrid(docs, queries, max(k, 8), hints=domain, **retrieval), "found")
    texts = docs.select("doc_id", "text", "source", F.col("lang").alias("type"))
    ordered = stored(reorder_for_llm(with_texts(found, texts, queries)), "ordered")
    if complete:
        context = format_context(ordered).join(queries, "query_id")
        prompts = context.select("query_id", F.concat(F.lit("Context:\n"), "context", F.lit("\n\n---\n\nQuestion: "), "query").alias("prompt"))
        made = generate_answers(prompts, complete)
        answers = queries.select("query_id").join(made, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL)))
    else:
        answers = grounded_answer(queries, ordered.withColumn("rank", F.col("position")), hints, code, overviews)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    kept = found.groupBy("query_id").agg(ids.alias("sources"), F.min_by("retrieval_source", "rank").alias("retrieval_source"))
    out = answers.join(kept, "query_id", "left")
    return out.select("query_id", "answer", F.coalesce("sources", F.array().cast(found.select(F.array("doc_id")).dtypes[0][1])).alias("sources"), F.coalesce("retrieval_source", F.lit("none")).alias("retrieval_source"))


def structured_answer(queries: DataFrame, results: DataFrame, hints: dict = fixed.INTENTS, storage: list[str] = fixed.STORAGE_MENTIONS, basis: list[str] = fixed.BASIS_WORDS, cases: list[str] = fixed.CASE_WORDS, article: str = fixed.ARTICLE) -> DataFrame:
    """(query_id, answer) by rule, from at most a few chunks.

    Questions about storage or a crime get up to three sentences with a word of
    ``basis`` from each legal chunk that mentions storage or the article, then
    up to five with a word of ``cases`` from chunks that mention storage; others
    the beginnings of the first three chunks. Without chunks it's a refusal.
    """
    words = lambda xs: F.array(*map(F.lit, xs))
    mixed = query_intents(F.col("query"), hints)["mixed"]
    rows = results.withColumn("_mixed", mixed)
    legal = rows.filter(F.col("_mixed") & is_legal(F.col("type"), F.col("source")) & (mentions(F.col("text"), storage) | F.col("text").contains(article)))
    legal = legal.withColumn("s", keyword_sentences(F.col("text"), words(basis), 3)).filter(F.size("s") > 0)
    block = F.concat(F.lit(f"{BASIS} [Source "), F.col("rank").cast("string"), F.lit("]:\n"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x)), "\n"))
    legal = _lines(legal, block, ["rank"], "legal")
    shown = rows.filter(F.col("_mixed") & mentions(F.col("text"), storage)).select("query_id", "rank", F.posexplode(keyword_sentences(F.col("text"), words(cases), 2)).alias("at", "s"))
    shown = shown.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "at"))).filter("n <= 5")
    shown = _lines(shown, F.concat(F.lit("- [Source "), F.col("rank").cast("string"), F.lit("] "), "s"), ["n"], "cases")
    text = F.trim("text")
    near = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), F.lit("\n"), F.when(F.length(text) > 500, F.concat(F.left(text, F.lit(500)), F.lit("..."))).otherwise(text))
    nearest = _lines(rows.filter(~F.col("_mixed") & (F.col("rank") <= 3)), near, ["rank"], "nearest")
    some = rows.groupBy("query_id").agg(F.max("_mixed").alias("_mixed"))
    out = queries.select("query_id").join(some, "query_id", "left").join(legal, "query_id", "left").join(shown, "query_id", "left").join(nearest, "query_id", "left")
    by_rule = F.concat_ws("\n\n", F.lit(LEAD), "legal", F.concat(F.lit(CASES + "\n"), "cases"), F.lit(CLOSING))
    return out.select("query_id", F.when(F.col("_mixed").isNull(), REFUSAL).when(F.col("_mixed"), by_rule).otherwise(F.concat_ws("\n\n", F.lit(NEAREST), "nearest")).alias("answer"))


def offline_answer(queries: DataFrame, results: DataFrame, **rules) -> DataFrame:
    """(query_id, answer, sources, model): the answer by rule, with the chunks' sources in order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"])
    kept = results.groupBy("query_id").agg(F.array_join(names, ",").alias("sources"))
    out = structured_answer(queries, results, **rules).join(kept, "query_id", "left")
    return out.select("query_id", "answer", F.coalesce("sources", F.lit("")).alias("sources"), F.lit("offline_fallback").alias("model"))


def replace_refusals(answers: DataFrame, queries: DataFrame, results: DataFrame, hints: dict = fixed.INTENTS, storage: list[str] = fixed.STORAGE_MENTIONS, article: str = fixed.ARTICLE, **rules) -> DataFrame:
    """(query_id, answer, replaced): a refusal gives way to the answer by rule if there are chunks and the
    question asks for a rule and cases, or a chunk mentions storage or is legal and has the article."""
    fits = mentions(F.col("text"), storage) | (is_legal(F.col("type"), F.col("source")) & F.col("text").contains(article))
    usable = results.groupBy("query_id").agg(F.bool_or(query_intents(F.col("query"), hints)["mixed"] | fits).alias("usable"))
    by_rule = structured_answer(queries, results, hints, storage, article=article, **rules).withColumnRenamed("answer", "by_rule")
    rows = answers.join(usable, "query_id", "left").join(by_rule, "query_id", "left")
    replaced = F.col("answer").contains(REFUSAL) & F.coalesce("usable", F.lit(False))
    return rows.select("query_id", F.when(replaced, F.col("by_rule")).otherwise(F.col("answer")).alias("answer"), replaced.alias("replaced"))


def rewrite_queries(queries: DataFrame, hints: dict = fixed.INTENTS, whole: str = fixed.REWRITTEN, added: str = fixed.ADDED) -> DataFrame:
    """(query_id, query) to search for: ``whole`` in place of questions about prohibited acts or storage, ``added`` behind those about a crime."""
    intents = query_intents(F.col("query"), hints)
    to = F.when(intents["prohibited"] | intents["storage"], F.lit(whole)).when(intents["crime"], F.concat("query", F.lit(" " + added))).otherwise(F.col("query"))
    return queries.select("query_id", to.alias("query"))


def inject_sections(results: DataFrame, queries: DataFrame, sections: DataFrame, hints: dict = fixed.INTENTS) -> DataFrame:
    """``results`` and, in front of a query's, with rank 0 and score 1, the section of its intents that has the first priority.

    ``sections`` (intent, priority, doc_id, source, type, text) has few rows.
    Columns of ``results`` that sections don't have are null in them.
    """
    intents = query_intents(F.col("query"), hints)
    names = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in intents.items())), lambda x: x.isNotNull())
    asked = queries.select("query_id", "query", F.explode(names).alias("intent"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "doc_id"))
    chosen = asked.join(F.broadcast(sections), "intent").withColumn("_n", first).filter("_n = 1")
    known = {"score": F.lit(1.0), "rank": F.lit(0).cast("long"), **{c: F.col(c) for c in ("query_id", "query", "doc_id", "source", "type", "text")}}
    return union(results, chosen.select(*((known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in results.schema.fields)))


def generate_quota(
    docs: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, complete=None, *, sections: Iterable[Section] = (PROHIBITED,), hints: dict = fixed.INTENTS,
    storage: list[str] = fixed.STORAGE_MENTIONS, whole: str = fixed.REWRITTEN, added: str = fixed.ADDED, threshold: float | None = None, **rules,
) -> DataFrame:
    """(query_id, answer, sources, model), by intent: rewrite, retrieve, inject, select, order, answer, replace refusals.

    ``docs`` has doc_id, text, source and type. What is searched for may differ
    from the question, which decides all else. At least 30 results are
    fetched, of which k are selected by kind, behind the section that the
    question's intent asks for. ``complete`` takes a list of prompts and gives
    answers, of which refusals give way to the answer by rule where chunks
    allow for one; without it all answers are by rule. ``sources`` are those
    of the chunks, as ordered for the model.
    """
    asked = rewrite_queries(queries, hints, whole, added)
    found = retrieve_linear(docs, asked, max(6 * k, 30), threshold).select("query_id", "doc_id", "score", "rank")
    results = with_texts(found, docs.select("doc_id", "text", "source", "type"), queries)
    selected = quota_selection(inject_sections(results, queries, first_sections(docs, sections), hints), k, hints, storage)
    ordered = stored(reorder_for_llm(selected), "ordered").drop("rank").withColumnRenamed("position", "rank")
    rules = {"hints": hints, "storage": storage, **rules}
    by_rule = offline_answer(queries, ordered, **rules)
    if complete is None:
        return by_rule
    prompts = build_prompt(format_context(ordered, "rank"), queries, "combine")
    made = queries.select("query_id").join(generate_answers(prompts, complete), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL)))
    answers = replace_refusals(made, queries, ordered, **rules)
    model = F.when(F.col("replaced") | (F.col("sources") == ""), F.lit("offline_fallback")).otherwise("model")
    return answers.join(by_rule.select("query_id", "sources"), "query_id").select("query_id", "answer", "sources", model.alias("model"))
