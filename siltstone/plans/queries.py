"""The queries: each takes (spark, sf_dir) and works on whole tables.

Documents are the corpus, benchmark items the batch of questions; a
document's language stands in for its type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.frames import shared_folder, union
from ..operators import answer, chunk, dense, facts, grounded, index, rank, search
from ..operators.facts import Fact, Overview, Section
from ..sources import ingest
from ..sources.ingest import table
from ..streaming import incremental

#: Words that tell the driver tables' languages apart, in place of the hints of a legal corpus.
HINTS = {"en": [" the ", " and "], "fr": [" les ", " des "], "de": [" der ", " und "], "es": [" los ", " que "]}
K, MANY = 5, 20
#: Likewise for intents, evidence and selection; English counts as legal texts, French and German as news.
INTENTS = {"overview": [["ing "], [" and "]], "decree_summary": [["tion"], [" in "], [" by ", " at "]], "penalty": [[" of "]], "prohibited": [["ble "]], "prohibited_acts": [["er "], ["ly "]], "storage": [["ment", "hand"]], "crime": [["tion ", "sh "]]}
CODE, STORAGE, BASIS, CASES, ARTICLE = ["src3", "thereon"], ["tion"], ["the", "ing"], ["and", "is"], "Th"
EVIDENCE = {"legal": [" the "], "news": [" der ", " les "], "law": [" of "], "law_source": "src1"}
NOISE = ["menu", "the and", "ing."]
SECTION = {"government": ["the"], "decree": ["and"], "first": ["of"], "ends": ["ble", "tion"], "least": 2, "lead": 1}
THRESHOLD = 0.25
DOMAINS = {"legal": [" the ", " and "], "news": [" der ", " les "]}

#: Sections, facts and rewritten questions that the test tables' texts have.
SECTIONS = [Section("first", "Licensed under", [".", "!"], ("prohibited",)), Section("second", "The ", [". ", "tion"], ("storage", "crime")), Section("rest", "the ", [";", "no such end"], ("overview",))]
FACTS = [Fact("licence", 1, r"Licensed under the ([A-Za-z0-9 .,-]+)\.", "under the {}"), Fact("licence", 2, r"(MIT License)"), Fact("contact", 2, r"(\+[0-9][0-9 ()-]+[0-9])", "call {}"), Fact("contact", 1, r"([a-z0-9._]+@[a-z0-9-]+\.[a-z]+)", "write to {}"), Fact("opening", 1, r"^([A-Z]\w+ \w+)", "begins with {}")]
FACT_LEAD, FACT_CLOSING = "What it says:", "No more than that."
OVERVIEWS = {"overview": Overview("src1", FACTS, FACT_LEAD, FACT_CLOSING), "decree_summary": Overview("src2", FACTS[:2], FACT_LEAD, FACT_CLOSING)}
REWRITE, ADD = "the thing and of der les que ment", "tion and the"

REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, question, answer, expected, sources): user turns that the next turn answers; the conversation's last answer is expected, and the two turns before are the sources."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    before = F.filter(F.array(F.lag("text", 1).over(w), F.lag("text", 2).over(w)), lambda x: x.isNotNull())
    last = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = c.withColumns({"expected": last, "answer": F.lead("text").over(w), "next": F.lead("role").over(w), "before": before}).filter("role = 'user' and next = 'assistant'")
    sources = F.transform("before", lambda x: F.struct(F.lit("turn").alias("source"), x.alias("text")))
    return rows.select("conv_id", "turn", F.col("text").alias("question"), "answer", "expected", sources.alias("sources"))


def _digest(words):
    return F.md5(F.array_join(words, " "))


def _words(name: str, words):
    def f(spark, d):
        w = words(F.col("text"))
        return docs_of(spark, d).select("doc_id", F.size(w).cast("long").alias("n"), _digest(w).alias("digest"))

    f.__name__ = name
    return query(f)


_words("tokenize", T.tokens)
_words("token_set", lambda c: F.array_sort(T.token_set(c)))
_words("answer_tokens", lambda c: F.array_sort(T.answer_tokens(c)))
_words("eval_keywords", T.keywords)
_words("evidence_sentences", T.evidence_sentences)
_words("keyword_sentences", lambda c: T.keyword_sentences(c, F.array(F.lit("the"), F.lit("der"), F.lit("que"), F.lit("les"))))


def _pages(name: str, /, **columns):
    def f(spark, d):
        return table(spark, d, "pages").select("page_id", *(v(F.col("url"), F.col("html")).alias(k) for k, v in columns.items()))

    f.__name__ = name
    return query(f)


_pages("slugify", slug=lambda u, h: T.slugify(u))
_pages("safe_filename", name=lambda u, h: T.safe_filename(u))
_pages("page_title", title=lambda u, h: ingest.page_title(h))
_pages("page_title_regex", title=lambda u, h: ingest.page_title_regex(h))
_pages("page_body", body=lambda u, h: ingest.page_body(h))
_pages("metadata_header", header=lambda u, h: T.metadata_header(ingest.page_title_regex(h), u, F.lit("news"), extra=F.lit(None).cast("string")))


@query
def standardize_pages(spark, d):
    return ingest.standardize(table(spark, d, "pages")).select("page_id", "markdown")


@query
def longest_region(spark, d):
    return ingest.longest_region(table(spark, d, "pages"))


@query
def conversion_report(spark, d):
    return ingest.conversion_summary(ingest.conversion_status(table(spark, d, "pages")).withColumn("kind", F.lit("news")))


@query
def dedupe_consecutive_lines(spark, d):
    return ingest.clean_lines(table(spark, d, "pages"), "page_id", "html", NOISE)


@query
def noise_lines(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("raw")).select("page_id", ingest.normalize_line(F.col("raw")).alias("line"))
    return lines.groupBy("page_id").agg(F.sum(ingest.is_noise(F.col("line"), NOISE).cast("long")).alias("noise"), F.count("*").alias("n"))


@query
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.clean_markup_text(F.col("html"))).alias("digest"))


def _legal(spark, d):
    return ingest.legal_texts(table(spark, d, "pages"), "page_id", "html", F.lit("is"), shortest=200, patterns=NOISE, **SECTION)


@query
def legal_section(spark, d):
    lines = ingest.clean_lines(table(spark, d, "pages"), "page_id", "html", NOISE)
    return ingest.section(lines, "page_id", F.lit("is"), **SECTION)


@query
def legal_texts(spark, d):
    return _legal(spark, d)


@query
def convert_all(spark, d):
    pages = table(spark, d, "pages")
    laws = _legal(spark, d).filter("page_id % 3 = 0").join(pages.select("page_id", "url", ingest.page_title_regex(F.col("html")).alias("title")), "page_id")
    return ingest.convert_all(laws, pages.filter("page_id % 3 <> 0")).select("kind", "page_id", F.md5("markdown").alias("digest"))


@query
def preferred_sources(spark, d):
    """Texts by paragraphs stand for those by lines where there are any."""
    pages = table(spark, d, "pages")
    good = pages.select("page_id", ingest.page_body(F.col("html")).alias("text"), F.lit("paragraphs").alias("method")).filter(F.length("text") >= ingest.SHORT)
    rest = _legal(spark, d).select("page_id", "text", F.lit("lines").alias("method"))
    return ingest.preferred(good, rest, "page_id").select("page_id", "method", F.md5("text").alias("digest"))


def _laws(spark, d):
    """Legal texts of a third of the pages by lines, and for a part of them by paragraphs."""
    pages = table(spark, d, "pages").filter("page_id % 3 = 0")
    told = [ingest.page_title_regex(F.col("html")).alias("title"), F.col("url"), F.lit("archive").alias("source_name"), F.lit(None).cast("string").alias("crawl_date")]
    by_lines = _legal(spark, d).select("page_id", "text").join(pages, "page_id").select("page_id", *told, F.lit("html_text_cleaned").alias("method"), "text")
    return by_lines, pages.filter("page_id % 2 = 0").select("page_id", *told, F.lit("paragraphs").alias("method"), ingest.page_body(F.col("html")).alias("text"))


@query
def legal_markdown(spark, d):
    return ingest.legal_markdown(_laws(spark, d)[0]).select("page_id", "chars", F.md5("markdown").alias("digest"))


@query
def convert_everything(spark, d):
    rows, _ = ingest.convert_everything(*_laws(spark, d), table(spark, d, "pages").filter("page_id % 3 <> 0"), least=1000)
    return rows.select("kind", "page_id", "method", "chars", "bytes", "status", F.md5("markdown").alias("digest"))


@query
def everything_report(spark, d):
    return ingest.convert_everything(*_laws(spark, d), table(spark, d, "pages").filter("page_id % 3 <> 0"), least=1000)[1]


@query
def best_extraction(spark, d):
    """Of paragraphs, clean lines and the whole text of each page the longest, with statistics of all."""
    pages = table(spark, d, "pages")
    lines = ingest.clean_lines(pages, "page_id", "html", NOISE)
    lines = lines.groupBy("page_id").agg(F.array(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("texts"))
    of = lambda method, texts: pages.select("page_id", F.lit(method).alias("method"), texts.alias("texts"))
    whole = F.array(ingest.plain(ingest.without_code(F.col("html"))))
    each = union(of("paragraphs", ingest.page_paragraphs(F.col("html"))), lines.withColumn("method", F.lit("lines")), of("whole", whole))
    best = ingest.best_extraction(each.withColumn("priority", F.array_position(F.array(*map(F.lit, ("paragraphs", "lines", "whole"))), F.col("method")).cast("int")))
    count = lambda x: F.array_join(F.transform(x, lambda a: F.concat_ws(":", a["method"], a["pages"].cast("string"), a["chars"].cast("string"))), ",")
    stats = F.array_join(F.transform("page_stats", lambda p: F.concat_ws(":", p["page"].cast("string"), p["chars"].cast("string"))), ",")
    return best.select("page_id", "method", "pages", "chars", stats.alias("page_stats"), F.md5("text").alias("digest"), count(F.col("attempts")).alias("attempts"))


@query
def load_documents(spark, d):
    rows = ingest.load_documents(table(spark, d, "documents"))
    return rows.select("chunk_id", "source", "type", F.length("content").cast("long").alias("n"))


@query
def chunk_recursive(spark, d):
    return chunk.chunk_documents(docs_of(spark, d))


@query
def chunk_large(spark, d):
    return chunk.chunk_large(docs_of(spark, d))


@query
def chunk_fixed(spark, d):
    return chunk.chunk_fixed(docs_of(spark, d))


@query
def term_frequency(spark, d):
    return index.postings(docs_of(spark, d))


@query
def document_frequency(spark, d):
    docs = docs_of(spark, d)
    n, _ = index.corpus_stats(docs).first()
    return index.document_frequency(index.postings(docs)).select("term", "df", F.round(index.idf(F.lit(n), F.col("df")), 6).alias("idf"))


@query
def corpus_stats(spark, d):
    return index.corpus_stats(docs_of(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def hash_embedding(spark, d):
    return index.hash_vectors(docs_of(spark, d)).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query
def hash_embedding_blake2b(spark, d):
    return index.hash_vectors(docs_of(spark, d), blake2b=True).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query
def embed_chunks(spark, d):
    """Of each chunk's vector its largest number and its place, and how many aren't 0."""
    chunks = chunk.chunk_documents(docs_of(spark, d)).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))
    v = index.embedded(chunks, "chunk_id", "content")
    most = F.array_max(F.transform("embedding", lambda x: F.round(x, 6)))
    return v.select("chunk_id", most.alias("most"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n"))


_INDEXES: dict = {}


def _index(spark, d):
    """An index in the shared folder, built by the first query of the application that asks for it."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), d)
    if key not in _INDEXES:
        _INDEXES[key] = f"{key[1]}/index-{uuid.uuid4().hex}"
    return index.ensure_index(docs_of(spark, d), _INDEXES[key])


@query
def index_upserts(spark, d):
    """Chunks of an index after batches of new, changed and removed documents and a compaction between them."""
    folder = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    docs = docs_of(spark, d).select("doc_id", "text")
    changed = docs.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("Changed. "), "text").alias("text"))
    incremental.index_batch(docs.filter("doc_id % 3 <> 0"), 0, folder)
    incremental.index_batch(changed, 1, folder)
    incremental.compact(spark, folder)
    late = docs.filter("doc_id % 3 = 0 and doc_id % 4 <> 0").withColumn("deleted", F.lit(False))
    incremental.index_batch(union(late, docs.filter("doc_id % 10 = 1").withColumn("deleted", F.lit(True))), 2, folder, deleted_col="deleted")
    found = incremental.read_stream_index(spark, folder)
    rows = index.index_join(found)
    return rows.select("chunk_id", "doc_id", "chunk_index", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n"), F.md5("content").alias("digest"))


@query
def index_join(spark, d):
    rows = index.index_join(_index(spark, d))
    return rows.select("chunk_id", "doc_id", "chunk_index", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n"), F.md5("content").alias("digest"))


@query
def bm25_indexed(spark, d):
    return search.bm25_index(_index(spark, d), queries_of(spark, d), K)


@query
def dense_indexed(spark, d):
    return search.dense_index(_index(spark, d), queries_of(spark, d), K)


@query
def bm25_search(spark, d):
    return search.bm25(docs_of(spark, d), queries_of(spark, d), MANY)


@query
def bm25_okapi(spark, d):
    return search.bm25(docs_of(spark, d), queries_of(spark, d), MANY, okapi=True)


@query
def dense_search(spark, d):
    return search.hash_dense(docs_of(spark, d), queries_of(spark, d), MANY)


@query
def substring_search(spark, d):
    return search.substring_search(docs_of(spark, d), queries_of(spark, d), K)


@query
def vectorless_search(spark, d):
    return search.vectorless(docs_of(spark, d), queries_of(spark, d), K)


@query
def vectorless_relabel(spark, d):
    return search.vectorless_lexical(docs_of(spark, d), queries_of(spark, d), K)


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query
def vector_topk(spark, d):
    return dense.vector_topk(*_vectors(spark, d), 10)


@query
def dot_product(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(V.dot_product(F.col("embedding"), F.col("embedding")), 4).alias("dot"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query
def mmr(spark, d):
    v, q = _vectors(spark, d)
    top = dense.vector_topk(v, q, MANY).join(v.select("vec_id", "embedding"), "vec_id").join(q, "query_id")
    return rank.mmr(top)


def _lists(spark, d, k=MANY):
    docs, q = docs_of(spark, d), queries_of(spark, d)
    return docs, q, [search.hash_dense(docs, q, k), search.bm25(docs, q, k)]


@query
def rrf_fusion(spark, d):
    return rank.rrf(_lists(spark, d)[2], MANY)


@query
def max_merge(spark, d):
    return rank.max_merge(_lists(spark, d)[2])


@query
def merge_dedupe(spark, d):
    return rank.merge_dedupe(_lists(spark, d)[2])


def _candidates(spark, d):
    docs, q = docs_of(spark, d), queries_of(spark, d)
    return rank.with_texts(search.bm25(docs, q, MANY), docs, q)


@query
def dedupe_prefix(spark, d):
    return rank.dedupe_prefix(_candidates(spark, d)).select("query_id", "doc_id", "score", "rank")


@query
def rerank_formula(spark, d):
    return rank.rerank(_candidates(spark, d), K).select("query_id", "doc_id", "score", "rank")


@query
def rerank_linear(spark, d):
    return rank.rerank_linear(_candidates(spark, d), K).select("query_id", "doc_id", "score", "rank")


@query
def rerank_length_mod(spark, d):
    return rank.rerank_length_mod(_candidates(spark, d), K).select("query_id", "doc_id", "score", "rank")


@query
def classify_query(spark, d):
    return queries_of(spark, d).select("query_id", T.classify(F.col("query"), HINTS).alias("type"))


@query
def domain_boost(spark, d):
    return rank.domain_boost(_candidates(spark, d), HINTS, "lang").select("query_id", "doc_id", "score", "rank")


@query
def retrieve_hybrid(spark, d):
    return rank.retrieve_hybrid(docs_of(spark, d), queries_of(spark, d), hints=HINTS)


@query
def retrieve_linear(spark, d):
    return rank.retrieve_linear(docs_of(spark, d), queries_of(spark, d), K, THRESHOLD)


@query
def result_key(spark, d):
    rows = docs_of(spark, d).select("doc_id", grounded.result_key(F.when(F.col("doc_id") % 5 > 0, F.col("source")), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")), F.col("text")).alias("key"))
    return rows.select("doc_id", F.md5("key").alias("digest"))


@query
def normalize_source(spark, d):
    return rank.retrieve_maxmerge(docs_of(spark, d), queries_of(spark, d)).select("query_id", "doc_id", grounded.normalize_source(F.col("retrieval_source")).alias("source"))


@query
def retrieve_maxmerge(spark, d):
    return rank.retrieve_maxmerge(docs_of(spark, d), queries_of(spark, d))


def _kind():
    return F.when(F.col("lang") == "en", "legal").when(F.col("lang").isin("fr", "de"), "news").otherwise(F.col("lang"))


def _top(spark, d, k=K):
    docs, q = docs_of(spark, d), queries_of(spark, d)
    return q, rank.with_texts(search.bm25(docs, q, k), docs.withColumn("type", _kind()), q)


@query
def classify_intent(spark, d):
    return grounded.classify_intent(*_top(spark, d), INTENTS, CODE)


@query
def chunk_predicates(spark, d):
    c = F.col
    rows = docs_of(spark, d).withColumn("type", _kind())
    return rows.select("doc_id", grounded.is_legal(c("type"), c("source")).alias("legal"), grounded.is_news(c("type"), c("source")).alias("news"), grounded.mentions(c("text"), STORAGE).alias("storage"))


@query
def quota_selection(spark, d):
    return grounded.quota_selection(_top(spark, d, MANY)[1], K, INTENTS, STORAGE).select("query_id", "doc_id", "rank")


@query
def insufficient_answer(spark, d):
    return grounded.insufficient_answer(*_top(spark, d))


def _rules():
    return {"hints": INTENTS, "storage": STORAGE, "basis": BASIS, "cases": CASES, "article": ARTICLE}


@query
def structured_answer(spark, d):
    return grounded.structured_answer(*_top(spark, d), **_rules()).select("query_id", F.md5("answer").alias("digest"))


@query
def offline_answer(spark, d):
    return grounded.offline_answer(*_top(spark, d), **_rules()).select("query_id", F.md5("answer").alias("digest"), "sources", "model")


@query
def replace_refusals(spark, d):
    q, top = _top(spark, d)
    given = q.select("query_id", F.when(F.col("query_id") % 2 == 0, answer.REFUSAL).otherwise("It is so.").alias("answer"))
    return grounded.replace_refusals(given, q, top, **_rules()).select("query_id", F.md5("answer").alias("digest"), "replaced")


@query
def generate(spark, d):
    out = grounded.generate(docs_of(spark, d).withColumn("lang", _kind()), queries_of(spark, d), K, hints=INTENTS, code=CODE, domain=DOMAINS)
    return out.select("query_id", F.md5("answer").alias("digest"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "retrieval_source")


@query
def section_between_markers(spark, d):
    return facts.section_table(docs_of(spark, d), SECTIONS).select("doc_id", "section", "at", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


@query
def fact_table(spark, d):
    return facts.fact_table(docs_of(spark, d), FACTS)


@query
def fact_overview(spark, d):
    return facts.fact_overview(docs_of(spark, d), OVERVIEWS["overview"]).select("doc_id", "n_facts", F.md5("overview").alias("digest"))


@query
def grounded_overview(spark, d):
    q, top = _top(spark, d)
    made = facts.overviews(docs_of(spark, d), OVERVIEWS)
    return grounded.grounded_answer(q, top, INTENTS, CODE, made, **EVIDENCE).select("query_id", F.md5("answer").alias("digest"))


@query
def rewrite_queries(spark, d):
    return grounded.rewrite_queries(queries_of(spark, d), INTENTS, REWRITE, ADD)


@query
def generate_quota(spark, d):
    docs = docs_of(spark, d).select("doc_id", "text", "source", _kind().alias("type"))
    rules = {k: v for k, v in _rules().items() if k not in ("hints", "storage")}
    out = grounded.generate_quota(docs, queries_of(spark, d), K, sections=SECTIONS, hints=INTENTS, storage=STORAGE, whole=REWRITE, added=ADD, **rules)
    return out.select("query_id", F.md5("answer").alias("digest"), "sources", "model")


@query
def reorder_for_llm(spark, d):
    return answer.reorder_for_llm(_top(spark, d)[1]).select("query_id", "doc_id", "rank", "position")


@query
def format_context(spark, d):
    return answer.format_context(answer.reorder_for_llm(_top(spark, d)[1])).select("query_id", F.md5("context").alias("digest"))


@query
def build_prompt(spark, d):
    q, top = _top(spark, d)
    return answer.build_prompt(answer.format_context_source(top), q).select("query_id", F.md5("prompt").alias("digest"))


@query
def answer_sources(spark, d):
    return answer.answer_sources(_top(spark, d)[1])


@query
def best_evidence(spark, d):
    return answer.best_evidence(_top(spark, d)[1], **EVIDENCE)


@query
def extractive_answer(spark, d):
    q, top = _top(spark, d)
    return answer.extractive_answer(q, answer.best_evidence(top, **EVIDENCE))


@query
def template_answer(spark, d):
    return answer.template_answer(*_top(spark, d))


@query
def eval_metrics(spark, d):
    t = turns(spark, d)
    rows = t.select("conv_id", "turn", F.col("question").alias("query"), "expected", "answer", "sources")
    return answer.evaluate(rows).drop("query", "expected", "answer", "sources")


def golden(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query, expected): the first half of an item's words asks for the second."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w"), half.alias("n"))
    return rows.select("query_id", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("query"), F.array_join(F.slice("w", F.col("n") + 1, F.size("w") - F.col("n")), " ").alias("expected"))


def _evaluated(spark, d):
    """Template answers over the lexical and over the dense list alone, with their metrics."""
    docs, q = docs_of(spark, d), golden(spark, d)
    asked, out = q.select("query_id", "query"), []
    for config, found in (("lexical", search.bm25(docs, asked, K)), ("dense", search.hash_dense(docs, asked, K))):
        top = rank.with_texts(found, docs, asked)
        answers = answer.with_sources(answer.template_answer(asked, top).join(q, "query_id"), top)
        out.append(answer.evaluate(answers).withColumn("config", F.lit(config)))
    return union(*out)


@query
def eval_compare(spark, d):
    """Mean metrics of template answers over the lexical and over the dense list alone."""
    return answer.summary(_evaluated(spark, d), "config")


@query
def evaluation_report(spark, d):
    return answer.report(_evaluated(spark, d))


@query
def config_deltas(spark, d):
    return answer.compare(_evaluated(spark, d), "lexical", "dense")


@query
def config_worst(spark, d):
    return answer.worst_of(_evaluated(spark, d), "dense").select("query_id", "faithfulness", "relevance", "recall", "precision", "average")


@query
def worst_performers(spark, d):
    rows = eval_metrics(spark, d).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    return answer.worst(rows).select("conv_id", "turn", "average")


@query
def chat_history(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("place"), F.lag("role").over(w).alias("before"), F.length("text").cast("long").alias("n"))
