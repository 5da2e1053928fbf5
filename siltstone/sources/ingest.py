"""Reading documents and pages, and standardizing pages to Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.frames import attempt, ship, stored, union
from ..functions.text import clean_markup_text, collapse, contains_any, metadata_header, strip, unescape

#: Texts shorter than this are reported.
SHORT = fixed.NEWS_MIN
NEWS = "url string, title string, date_crawled string, content_markdown string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_markdown(spark: SparkSession, folder: str, stripped: bool = True, blank: bool = False, by_parent: bool = False) -> DataFrame:
    """(path, source, stem, type, content) of all Markdown files below ``folder``; blank ones are left out unless ``blank``.

    The type is the part of the path that says ``legal`` or ``news``, else
    ``unknown``; ``by_parent`` it's the file's folder. The stem is the name
    without its extension.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    path = F.col("_metadata.file_path")
    kind = F.when(path.contains("/legal/"), "legal").when(path.contains("/news/"), "news").otherwise("unknown")
    name, content = F.element_at(F.split(path, "/"), -1), strip(F.col("value")) if stripped else F.col("value")
    rows = files.select(path.alias("path"), name.alias("source"), F.regexp_replace(name, r"\.md$", "").alias("stem"), (F.element_at(F.split(path, "/"), -2) if by_parent else kind).alias("type"), content.alias("content"))
    return rows if blank else rows.filter(strip(F.col("content")) != "")


def load_news(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled articles, one JSON object a file; rows that don't parse have nulls."""
    return spark.read.schema(NEWS).option("multiLine", True).json(folder)


def load_news_checked(spark: SparkSession, folder: str, needed: tuple[str, ...] = ("url",)) -> DataFrame:
    """``load_news`` with ``path`` and ``error``: null, ``not JSON: `` and what the file begins with, or ``missing `` and the keys of ``needed`` without a value.

    One bad file is one row with its cause and stops no other.
    """
    rows = spark.read.schema(f"{NEWS}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(folder)
    absent = F.array_join(F.filter(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in needed)), lambda c: c.isNotNull()), ", ")
    cause = F.when(F.col("_broken").isNotNull(), F.concat(F.lit("not JSON: "), F.left("_broken", F.lit(100)))).when(absent != "", F.concat(F.lit("missing "), absent))
    return rows.select("*", F.col("_metadata.file_path").alias("path"), cause.alias("error")).drop("_broken")


def good_and_bad(rows: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """The rows without an error, whose column goes, and those with one; written once, so that both are of one reading."""
    once = stored(rows, "checked")
    return once.filter(F.col(error_col).isNull()).drop(error_col), once.filter(F.col(error_col).isNotNull())


def legal_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the PDF and Word files below ``folder``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.lower("path").rlike(r"\.(pdf|docx|doc)$")).select("path", "length")


def files_valid(files: DataFrame, least: int = 3, size: int = 1024) -> DataFrame:
    """One row (n, valid): enough files, all of them large enough."""
    return files.agg(F.count("*").alias("n"), ((F.count("*") >= least) & F.coalesce(F.bool_and(F.col("length") > size), F.lit(False))).alias("valid"))


def load_documents(docs: DataFrame) -> DataFrame:
    """(chunk_id, content, source, type) of a table of documents; blank ones are left out."""
    return docs.select(F.col("doc_id").alias("chunk_id"), strip("text").alias("content"), "source", F.coalesce("lang", F.lit("unknown")).alias("type")).filter("content <> ''")


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<iframe\b.*?</iframe>", " ")


def plain(html: Column) -> Column:
    return collapse(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def page_title(html: Column) -> Column:
    """The first heading, else the title, else ``Unknown title``."""
    part = lambda tag: F.nullif(plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(part("h1"), part("title"), F.lit("Unknown title"))


def page_title_regex(html: Column) -> Column:
    return F.coalesce(F.nullif(collapse(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.lit("")), F.lit("Untitled"))


def page_paragraphs(html: Column) -> Column:
    """Distinct paragraphs in order, of the article if it has any, else of the page."""
    code_free = without_code(html)
    article = F.regexp_extract(code_free, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    scope = F.when(article.rlike(r"(?i)<p[\s>]"), article).otherwise(code_free)
    pieces = F.split(scope, r"(?i)<p(?:\s[^>]*)?>")
    texts = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: plain(F.element_at(F.split(p, r"(?i)</p>|</article>"), 1)))
    return F.array_distinct(F.filter(texts, lambda t: F.length(t) >= fixed.PARAGRAPH_MIN))


def page_body(html: Column) -> Column:
    return F.array_join(page_paragraphs(html), "\n\n")


#: Classes of the elements that hold an article, besides ``article`` and ``body``.
REGIONS = ["detail-content", "detail__content", "content", "news-content", "article-body", "main-content"]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "iframe", "svg"}


class _Regions(HTMLParser):
    """Texts of the regions of a page, nested ones too, and of the whole page."""

    def __init__(self, classes: list[str]):
        super().__init__(convert_charrefs=True)
        self.classes, self.open, self.parts, self.found, self.hidden = set(classes), [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        names = set((dict(attrs).get("class") or "").split())
        self.hidden += tag in _HIDDEN
        self.open.append((tag, len(self.parts) if tag in ("article", "body") or names & self.classes else None))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            t, start = self.open.pop()
            self.hidden -= t in _HIDDEN
            if start is not None:
                self.found.append((start, len(self.parts)))
            if t == tag:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def regions(self) -> list[str]:
        self.found += [(start, len(self.parts)) for _, start in self.open if start is not None]
        return ["\n".join(self.parts[a:b]) for a, b in sorted(self.found)]


def longest_region(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = SHORT, classes: list[str] = REGIONS, errors: bool = False) -> DataFrame:
    """(id, region): the longest text of an article, a content element or the body if over ``least`` characters, else all text.

    Elements may be nested. A page without text, or null, gives an empty
    region. A page that can't be read stops the job, or with ``errors`` has a
    null region and a column ``error`` with the cause; null for the others.
    """

    def regions_of(html: str | None) -> list[str]:
        page = _Regions(classes)
        page.feed(html or "")
        page.close()
        return page.regions() + ["\n".join(page.parts)]

    def run(batches):
        for b in batches:
            found = [attempt(regions_of, html, errors) for html in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.string())], [id_col, "regions", "error"])

    ship(pages.sparkSession)
    found = pages.select(id_col, html_col).mapInArrow(run, T.StructType([pages.schema[id_col], T.StructField("regions", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
    texts = F.transform("regions", clean_markup_text)
    some = F.filter(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda r: F.length(r) > least)
    best = F.array_max(F.transform(some, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    region = F.when(F.col("error").isNull(), F.coalesce(best, F.element_at(texts, -1)))
    return found.select(id_col, region.alias("region"), *(["error"] if errors else []))


def is_noise(line: Column, patterns: list[str] = fixed.NOISE) -> Column:
    """Two characters or fewer, a number of up to three digits, or page furniture."""
    return (F.length(line) <= 2) | line.rlike(r"^\d{1,3}$") | contains_any(F.lower(line), [p.lower() for p in patterns])


def normalize_line(line: Column) -> Column:
    return collapse(clean_markup_text(line))


def clean_lines(pages: DataFrame, id_col: str, html_col: str, patterns: list[str] = fixed.NOISE) -> DataFrame:
    """(id, line_no, line): a page's lines without tags and noise; of equal neighbours the first stays."""
    text = F.regexp_replace(without_code(F.col(html_col)), r"(?s)<[^>]*>", "\n")
    lines = pages.select(id_col, F.posexplode(F.split(text, r"\n")).alias("line_no", "raw")).select(id_col, "line_no", normalize_line(F.col("raw")).alias("line")).filter(~is_noise(F.col("line"), patterns))
    before = F.lag("line").over(Window.partitionBy(id_col).orderBy("line_no"))
    return lines.withColumn("_before", before).filter(~F.col("line").eqNullSafe(F.col("_before"))).select(id_col, F.col("line_no").cast("long").alias("line_no"), "line")


def section(lines: DataFrame, id_col: str, number: Column, *, government: list[str] = fixed.GOVERNMENT, decree: list[str] = fixed.DECREE, first: list[str] = fixed.FIRST_ARTICLE, ends: list[str] = fixed.END_MARKERS, look_ahead: int = fixed.LOOK_AHEAD, least: int = fixed.SECTION_MIN, lead: int = fixed.LEAD_LINES) -> DataFrame:
    """Lines (id, line_no, line) of the legal text with the given number, by three rules for its start, the first that fits:

    a line of ``government`` with number, decree and first article within the
    next ``look_ahead`` lines; a line with the number, with decree and first
    article; a line of ``decree`` with a first article. The last two begin
    ``lead`` lines earlier. Without any, the first line. The text ends before
    the first line of ``ends`` that is ``least`` lines on or more, or at the end.
    """
    order = Window.partitionBy(id_col).orderBy("line_no")
    ahead, whole = order.rowsBetween(0, look_ahead - 1), Window.partitionBy(id_col)
    low = F.lower("line")
    marks = {"_number": low.contains(F.lower(number)), "_government": contains_any(low, government), "_decree": contains_any(low, decree), "_first": contains_any(low, first)}
    at = lines.withColumns({**marks, "_n": F.row_number().over(order)})
    near = {k: F.max(k).over(ahead) for k in ("_number", "_decree", "_first")}
    begin = lambda test, back: F.min(F.when(test, F.greatest(F.lit(1), F.col("_n") - back)))
    at = at.withColumns({f"_near{k}": v for k, v in near.items()})
    c = F.col
    starts = [
        begin(c("_government") & c("_near_number") & c("_near_decree") & c("_near_first"), 0).over(whole), begin(c("_number") & c("_near_decree") & c("_near_first"), lead).over(whole),
        begin(c("_decree") & c("_near_first"), lead).over(whole),
    ]
    at = at.withColumn("_start", F.coalesce(*starts, F.lit(1)))
    stop = F.min(F.when(contains_any(low, [e.lower() for e in ends]) & (c("_n") >= c("_start") + least), c("_n"))).over(whole)
    return at.withColumn("_end", stop).filter((c("_n") >= c("_start")) & (c("_end").isNull() | (c("_n") < c("_end")))).select(*lines.columns)


def _joined_lines(lines: DataFrame, id_col: str, out: str) -> DataFrame:
    """A page's lines, which came from one text, joined again."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias(out))


def legal_texts(pages: DataFrame, id_col: str, html_col: str, number: Column, shortest: int = fixed.LEGAL_MIN, patterns: list[str] = fixed.NOISE, **rules) -> DataFrame:
    """(id, text, chars, status): the legal text of each page, or all its clean lines if that is shorter than ``shortest`` and they're longer.

    A page without lines has an empty text. The status is ``ok``, or
    ``too_short`` below ``shortest`` characters.
    """
    lines = clean_lines(pages, id_col, html_col, patterns)
    cut, full = _joined_lines(section(lines, id_col, number, **rules), id_col, "cut"), _joined_lines(lines, id_col, "full")
    both = pages.select(id_col).join(full, id_col, "left").join(cut, id_col, "left").fillna("", ["full", "cut"])
    text = F.when((F.length("cut") < shortest) & (F.length("full") > F.length("cut")), F.col("full")).otherwise(F.col("cut"))
    rows = both.select(id_col, text.alias("text"))
    chars = F.length("text").cast("long")
    return rows.select(id_col, "text", chars.alias("chars"), F.when(chars >= shortest, "ok").otherwise("too_short").alias("status"))


def standardize(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, body, markdown) of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", page_title(F.col("html")).alias("title"), page_body(F.col("html")).alias("body"))
    header = metadata_header(F.col("title"), F.col("url"), F.lit("news"))
    return rows.withColumn("markdown", F.concat(header, F.lit("\n\n# "), "title", F.lit("\n\n"), "body"))


def standardize_news(news: DataFrame) -> DataFrame:
    """``news`` (url, title, date_crawled, content_markdown) with ``markdown``: front matter, heading, source and date lines, text; absent dates are left out."""
    header = metadata_header(F.coalesce("title", F.lit("Unknown title")), F.coalesce("url", F.lit("")), F.lit("news"), date_crawled=F.col("date_crawled"))
    told = F.concat_ws("\n", F.concat(F.lit("**Source:** "), F.coalesce("url", F.lit(""))), F.concat(F.lit("**Crawled:** "), "date_crawled"))
    return news.withColumn("markdown", F.concat_ws("\n\n", header, F.concat(F.lit("# "), F.coalesce("title", F.lit("Unknown title"))), told, F.nullif(strip(F.coalesce("content_markdown", F.lit(""))), F.lit(""))))


def extraction_attempts(extractions: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, method, priority, pages, chars, page_stats, text) of several extractions a document, a row each.

    ``extractions`` has the id, ``method``, ``priority`` and ``texts``, an
    array of its pages' texts, null if it failed. Texts are cleaned; page_stats
    counts each page's characters; the whole has a heading for each page that
    has any.
    """
    clean = F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: clean_markup_text(F.coalesce(t, F.lit(""))))
    rows = extractions.select(id_col, "method", "priority", clean.alias("_texts"))
    parts = F.filter(F.transform("_texts", lambda t, i: F.when(t != "", F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), t))), lambda t: t.isNotNull())
    stats = F.transform("_texts", lambda t, i: F.struct((i + 1).cast("long").alias("page"), F.length(t).cast("long").alias("chars")))
    rows = rows.select(id_col, "method", "priority", F.size("_texts").cast("long").alias("pages"), stats.alias("page_stats"), strip(F.array_join(parts, "\n\n")).alias("text"))
    return rows.withColumn("chars", F.length("text").cast("long"))


def best_extraction(extractions: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, method, pages, chars, page_stats, text, attempts): the longest of a document's extractions, of equally long ones the first by priority, which tells methods apart.

    attempts lists method, pages and chars of all, by priority; a document has as many as there are methods.
    """
    rows = extraction_attempts(extractions, id_col)
    order = F.struct("chars", (-F.col("priority")).alias("p"))
    best = F.max_by(F.struct("method", "pages", "chars", "page_stats", "text"), order)
    tried = F.array_sort(F.collect_list(F.struct("priority", "method", "pages", "chars")))
    return rows.groupBy(id_col).agg(best.alias("b"), F.transform(tried, lambda a: a.dropFields("priority")).alias("attempts")).select(id_col, "b.*", "attempts")


def conversion_status(pages: DataFrame, least: int = SHORT) -> DataFrame:
    """(page_id, method, chars, bytes, status): ``ok``, or a warning for short texts; a page without paragraphs gives all its text."""
    body, whole = F.nullif(page_body(F.col("html")), F.lit("")), clean_markup_text(plain(without_code(F.col("html"))))
    rows = pages.select("page_id", F.when(body.isNotNull(), "paragraphs").otherwise("html_text").alias("method"), F.coalesce(body, whole).alias("text"))
    rows = rows.select("page_id", "method", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))
    return rows.withColumn("status", F.when(F.col("chars") >= least, "ok").otherwise("short_content_warning"))


def conversion_summary(reports: DataFrame) -> DataFrame:
    """(kind, method, status, n, chars, bytes) of reports with these columns."""
    return reports.groupBy("kind", "method", "status").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"))


def preferred(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All keys of both; a row of ``first`` stands for that of ``second`` with the same key."""
    return union(first, second.join(first.select(key), key, "left_anti").select(first.columns))


def convert_all(legal: DataFrame, news: DataFrame) -> DataFrame:
    """(kind, page_id, markdown) of legal texts (page_id, title, url, text) and pages (page_id, url, html)."""
    header = metadata_header(F.col("title"), F.col("url"), F.lit("legal"))
    laws = legal.select(F.lit("legal").alias("kind"), "page_id", F.concat(header, F.lit("\n\n"), "text").alias("markdown"))
    return union(laws, standardize(news).select(F.lit("news").alias("kind"), "page_id", "markdown"))


#: The lines above a legal text, each with what it tells.
LEGAL_HEADER = {"Source URL": "url", "Source name": "source_name", "Crawl date": "crawl_date", "Category": "category", "Extraction method": "method", "Extracted characters": "chars"}


def legal_markdown(laws: DataFrame) -> DataFrame:
    """``laws`` (title, url, source_name, crawl_date, method, text) with category, chars and ``markdown``: title, a list of LEGAL_HEADER, text.

    Null fields are told as empty.
    """
    text = strip(F.coalesce("text", F.lit("")))
    rows = laws.withColumns({"category": F.lit("legal"), "chars": F.length(text).cast("long")})
    told = [F.concat(F.lit(f"- {k}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in LEGAL_HEADER.items()]
    return rows.withColumn("markdown", strip(F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.concat_ws("\n", *told), text)))


def convert_everything(laws: DataFrame, overrides: DataFrame, news: DataFrame, key: str = "page_id", least: int = fixed.LEGAL_MIN) -> tuple[DataFrame, DataFrame]:
    """(kind, key, method, chars, bytes, status, markdown) of all laws and news, and their report by kind, method and status.

    ``laws`` and ``overrides`` are as ``legal_markdown`` takes them, with
    ``key``; a law is taken from ``overrides`` if it is there with ``least``
    characters or more. ``news`` are pages (page_id, url, html).
    """
    good = overrides.filter(F.length(strip("text")) >= least)
    told = legal_markdown(preferred(good.select(laws.columns), laws, key))
    size = F.octet_length("markdown").cast("long").alias("bytes")
    legal = told.select(F.lit("legal").alias("kind"), key, "method", "chars", size, F.when(F.col("chars") >= least, "ok").otherwise("too_short").alias("status"), "markdown")
    made = standardize(news).select("page_id", "markdown").join(conversion_status(news).drop("bytes"), "page_id")
    articles = made.select(F.lit("news").alias("kind"), F.col("page_id").alias(key), "method", "chars", size, "status", "markdown")
    rows = union(legal, articles)
    return rows, conversion_summary(rows)


def write_markdown(standardized: DataFrame, folder: str) -> None:
    """Markdown texts, with the page's id, as Parquet; a file for each row doesn't scale."""
    standardized.select("page_id", "markdown").write.parquet(folder)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected) of a JSON array of questions with expected answers, numbered in order."""
    rows = spark.read.schema("question string, expected_answer string").option("multiLine", True).json(path)
    return rows.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("query_id"), F.col("question").alias("query"), F.col("expected_answer").alias("expected"))
