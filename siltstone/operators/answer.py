"""Order, context, evidence, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.frames import union
from ..functions.text import answer_tokens, contains_any, evidence_sentences, keywords

REFUSAL = "No sufficient evidence was found."


def reorder_for_llm(results: DataFrame) -> DataFrame:
    """``position`` puts the best at both ends: 1, 3, 5, 4, 2 of five."""
    whole = Window.partitionBy("query_id")
    n, r = F.count("*").over(whole), F.col("rank")
    rows = results.withColumn("_key", F.when((n <= 2) | (r % 2 == 1), r).otherwise(2 * n + 2 - r))
    return rows.withColumn("position", F.row_number().over(whole.orderBy("_key")).cast("long")).drop("_key")


def _joined(rows: DataFrame, block: Column, between: str, order: str, out: str) -> DataFrame:
    """Blocks of a query's top-k results, which are few, joined in order."""
    blocks = F.array_sort(F.collect_list(F.struct(order, block.alias("block"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), between).alias(out))


def format_context(results: DataFrame, order: str = "position", extension: bool = True) -> DataFrame:
    """(query_id, context) of rows with source, type, score and text; sources may be named without their ``extension``."""
    if not extension:
        results = results.withColumn("source", F.regexp_replace("source", r"\.[A-Za-z0-9]+$", ""))
    head = F.format_string("[Document %d | Source: %s | Type: %s | Score: %.3f]\n", F.col(order), F.coalesce(F.nullif("source", F.lit("")), F.format_string("Source %d", F.col(order))), F.coalesce("type", F.lit("unknown")), F.round("score", 3))
    return _joined(results, F.concat(head, F.trim("text"), F.lit("\n")), "\n---\n", order, "context")


def format_context_source(results: DataFrame) -> DataFrame:
    """Blocks led by ``[Source i]``; empty texts are skipped."""
    some = results.filter(F.trim("text") != "")
    return _joined(some, F.concat(F.format_string("[Source %d]\n", F.col("rank")), F.trim("text")), "\n\n", "rank", "context")


#: Rules that a prompt can begin with.
RULES = {
    "cite": "Answer from the context only and name a source in brackets after each statement. Say so if the context doesn't suffice.",
    "combine": "Answer from the context only, with sources in brackets. If it holds both rules and cases, give the rule first, then the cases.",
}


def build_prompt(contexts: DataFrame, queries: DataFrame, rules: str | None = None) -> DataFrame:
    """(query_id, prompt); ``rules`` names what it begins with."""
    lead = f"{RULES[rules]}\n\n" if rules else ""
    return contexts.join(queries, "query_id").select("query_id", F.concat(F.lit(f"{lead}Context:\n"), "context", F.lit("\n\nQuestion: "), "query", F.lit("\n\nAnswer:")).alias("prompt"))


def answer_sources(results: DataFrame, most: int = fixed.EVIDENCE_LIMIT) -> DataFrame:
    """(query_id, sources): distinct sources of the first results, in order."""
    few = results.filter(F.col("rank") <= most)
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]))
    return few.groupBy("query_id").agg(F.array_join(names, ",").alias("sources"))


def best_evidence(results: DataFrame, limit: int = fixed.EVIDENCE_LIMIT, legal: list[str] = fixed.LEGAL_TERMS, news: list[str] = fixed.NEWS_TERMS, law: list[str] = fixed.LAW_TERMS, law_source: str = fixed.LAW_SOURCE) -> DataFrame:
    """(query_id, sentence, source, score, rank) of rows with query, text, source, type, score and rank.

    Equal sentences count once, at the first result that has them.
    """
    parts = results.select("*", F.posexplode(evidence_sentences(F.col("text"))).alias("at", "sentence"))
    low = F.lower("sentence")
    first = F.row_number().over(Window.partitionBy("query_id", low).orderBy("rank", "at"))
    once = parts.withColumn("_n", first).filter("_n = 1")
    q, s = answer_tokens(F.col("query")), answer_tokens(F.col("sentence"))
    asked = F.lower("query")
    bonus = F.when((F.col("type") == "legal") & contains_any(asked, legal), 0.35).otherwise(0.0) + F.when((F.col("type") == "news") & contains_any(asked, news), 0.35).otherwise(0.0)
    bonus = bonus + F.when(F.lower("source").contains(law_source) & contains_any(asked, law), 0.30).otherwise(0.0)
    bonus = bonus + F.when(low.contains("luật này quy định"), 0.55).otherwise(0.0) + F.when(low.startswith("điều "), 0.25).otherwise(0.0)
    bonus = bonus + F.when(contains_any(low, ["phòng, chống ma túy là", "phòng, chống ma tuý là"]), 0.45).otherwise(0.0)
    score = F.size(F.array_intersect(q, s)) / F.greatest(F.size(q), F.lit(1)) + 0.15 * F.col("score") + bonus
    scored = once.select("query_id", "sentence", "source", F.round(F.when(F.size(s) > 0, score).otherwise(0.0), 6).alias("score"), F.col("rank").alias("_r"), "at").filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_r", "at")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).select("query_id", "sentence", "source", "score", "rank")


def extractive_answer(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, answer): evidence as bullets with their sources in brackets; a refusal where there's none."""
    lines = _joined(evidence, F.concat(F.lit("- "), "sentence", F.lit(" ["), "source", F.lit("]")), "\n", "rank", "answer")
    return queries.select("query_id").join(lines, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"))


def template_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, answer) that names the first source, without its extension."""
    top = results.filter("rank = 1").select("query_id", F.regexp_replace("source", r"\.[A-Za-z0-9]+$", "").alias("s"))
    text = F.concat(F.lit("According to ["), "s", F.lit("]."))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce(text, F.lit(REFUSAL)).alias("answer"))


def generate_answers(prompts: DataFrame, complete) -> DataFrame:
    """(query_id, answer) by ``complete``, a function from a list of prompts to their answers, called batch by batch."""

    def run(frames):
        for f in frames:
            yield f[["query_id"]].assign(answer=complete(f["prompt"].tolist()))

    return prompts.select("query_id", "prompt").mapInPandas(run, "query_id long, answer string")


def with_sources(answers: DataFrame, results: DataFrame) -> DataFrame:
    """``answers`` with ``sources``, an array of (rank, source, text) of each query's few results."""
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("sources"))
    return answers.join(lists, "query_id", "left")


def faithfulness(answer: Column, sources: Column) -> Column:
    """Part of the bracketed citations that name a source, at least a half; 0.2 without any, 0 without answer or sources."""
    names = F.lower(F.array_join(F.transform(sources, lambda s: F.coalesce(s["source"], F.lit(""))), " "))
    cited = F.regexp_extract_all(F.lower(answer), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    known = lambda c: F.contains(names, c) | F.exists(F.split(c, r"\s+"), lambda w: (F.length(w) > 2) & F.contains(names, w))
    share = F.size(F.filter(cited, known)) / F.nullif(F.size(cited), F.lit(0))
    none = (F.coalesce(answer, F.lit("")) == "") | F.coalesce(F.size(sources) <= 0, F.lit(True))
    return F.when(none, 0.0).when(F.size(cited) == 0, 0.2).otherwise(F.greatest(F.lit(0.5), share))


def relevance(question: Column, answer: Column) -> Column:
    q = F.array_distinct(keywords(question))
    return F.coalesce(F.size(F.array_intersect(q, keywords(answer))) / F.nullif(F.size(q), F.lit(0)), F.lit(1.0))


def context_recall(expected: Column, sources: Column) -> Column:
    """Part of the expected words that occur in the sources' texts or names."""
    words = F.array_distinct(keywords(expected))
    text = F.lower(F.array_join(F.transform(sources, lambda s: F.concat_ws(" ", s["text"], s["source"])), " "))
    share = F.coalesce(F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0)), F.lit(1.0))
    return F.when((F.coalesce(expected, F.lit("")) == "") | F.coalesce(F.size(sources) <= 0, F.lit(True)), 0.0).otherwise(share)


def context_precision(question: Column, sources: Column) -> Column:
    """Part of the sources whose text holds two of the question's words, or the one that it has."""
    words = F.array_distinct(keywords(question))
    need = F.least(F.lit(2), F.size(words))
    good = F.filter(sources, lambda s: F.size(F.filter(words, lambda w: F.contains(F.lower(s["text"]), w))) >= need)
    return F.when(F.coalesce(F.size(sources) <= 0, F.lit(True)), 0.0).when(F.size(words) == 0, 1.0).otherwise(F.size(good) / F.nullif(F.size(sources), F.lit(0)))


def evaluate(answers: DataFrame) -> DataFrame:
    """Four metrics of rows with query, expected, answer and sources, and their mean."""
    c = F.col
    m = {"faithfulness": faithfulness(c("answer"), c("sources")), "relevance": relevance(c("query"), c("answer")), "recall": context_recall(c("expected"), c("sources")), "precision": context_precision(c("query"), c("sources"))}
    out = answers.withColumns({k: F.round(v, 6) for k, v in m.items()})
    return out.withColumn("average", F.round((c("faithfulness") + c("relevance") + c("recall") + c("precision")) / 4, 6))


def summary(evaluated: DataFrame, *by: str) -> DataFrame:
    names = ["faithfulness", "relevance", "recall", "precision", "average"]
    return evaluated.groupBy(*by).agg(*(F.round(F.avg(x), 5).alias(x) for x in names))


def worst(evaluated: DataFrame, n: int = 3) -> DataFrame:
    return evaluated.orderBy("average", "query_id").limit(n)


def compare(evaluated: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, first, second, delta): the means of two configs, named as they are, and how much the first has more; null for one without rows."""
    names = ["faithfulness", "relevance", "recall", "precision", "average"]
    long = evaluated.filter(F.col("config").isin(first, second)).select("config", F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names))).alias("m"))
    wide = long.groupBy("m.metric").pivot("config", [first, second]).agg(F.avg("m.value"))
    return wide.select("metric", *(F.round(x, 5).alias(x) for x in (first, second)), F.round(F.col(first) - F.col(second), 5).alias("delta"))


def worst_of(evaluated: DataFrame, config: str, n: int = 3) -> DataFrame:
    """The n lowest rows of one config, by the average, then by query."""
    return worst(evaluated.filter(F.col("config") == config), n)


def report(evaluated: DataFrame) -> DataFrame:
    """(line_no, line): means by ``config`` and the worst queries, as Markdown; both are few rows."""
    cells = lambda first, names: F.concat(F.lit("| "), first, *(F.concat(F.lit(" | "), F.format_string("%.3f", F.col(x))) for x in names), F.lit(" |"))
    names = ["faithfulness", "relevance", "recall", "precision", "average"]
    head = evaluated.sparkSession.createDataFrame([(0, "", "| config | " + " | ".join(names) + " |"), (1, "", "|---" * 6 + "|"), (3, "", ""), (4, "", "| query | " + " | ".join(names) + " |"), (5, "", "|---" * 6 + "|")], "part int, key string, line string")
    means = summary(evaluated, "config").select(F.lit(2).alias("part"), F.col("config").alias("key"), cells(F.col("config"), names).alias("line"))
    low = worst(evaluated).select(F.lit(6).alias("part"), F.format_string("%.6f %012d", "average", "query_id").alias("key"), cells(F.col("query_id").cast("string"), names).alias("line"))
    order = Window.orderBy("part", "key")
    return union(head, means, low).select(F.row_number().over(order).cast("long").alias("line_no"), "line")


def write_report(evaluated: DataFrame, folder: str) -> None:
    """The report as one text file in ``folder``."""
    report(evaluated).coalesce(1).sortWithinPartitions("line_no").select("line").write.text(folder)
