"""Column -> Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .entities import unescape

WORD, INDEX_WORD = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_À-ỹ]+"
_SPACE = r"(?U)\s+"


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, _SPACE, " "))


def tokens(text: Column, pattern: str = INDEX_WORD) -> Column:
    """Lower-case words, with repeats; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def token_set(text: Column, pattern: str = WORD) -> Column:
    return F.array_distinct(tokens(text, pattern))


def _without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def answer_tokens(text: Column) -> Column:
    return _without(token_set(text, INDEX_WORD), fixed.ANSWER_STOPWORDS)


def keywords(text: Column) -> Column:
    """Words for the metrics: punctuation but hyphens and brackets parts words; stop words and single characters go."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s\-\[\]]", " ")
    return _without(F.split(plain, _SPACE), fixed.METRIC_STOPWORDS)


def slugify(url: Column, most: int = fixed.SLUG_MAX) -> Column:
    """Lower-case ASCII words of a url joined by hyphens; ``article`` if there are none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://", ""), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(plain, r"^-+|-+$", ""), F.lit(most)), F.lit("")), F.lit("article"))


def safe_filename(url: Column, most: int = fixed.SLUG_MAX) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1)
    return F.left(F.regexp_replace(last, r"[^A-Za-z0-9]+", "_"), F.lit(most))


def clean_markup_text(text: Column) -> Column:
    """Entities resolved, one kind of line end, single blanks, at most one empty line in a row."""
    lines = F.regexp_replace(F.regexp_replace(unescape(text), r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def sentences(text: Column) -> Column:
    """Pieces of a collapsed text that end with a mark of punctuation."""
    return F.split(collapse(text), r"(?<=[.!?])\s+")


def evidence_sentences(text: Column) -> Column:
    """Sentences that can be quoted: front matter goes; articles and chapters begin a new one."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)---.*?---", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(Điều\s+\d+\.)", "|||$1"), r"(?U)\b(Chương\s+[IVXLC]+)", "|||$1")
    parts = F.transform(F.split(collapse(marked), r"\|\|\||(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^[ \-•\t\r\n]+|[ \-•\t\r\n]+$", ""))

    def usable(s: Column) -> Column:
        low = F.lower(s)
        allowed = F.lit(False)
        for p in fixed.LOWER_STARTS:
            allowed = allowed | low.startswith(p)
        return F.length(s).between(fixed.SENTENCE_MIN, fixed.SENTENCE_MAX) & ~contains_any(low, fixed.EVIDENCE_MARKERS) & (~starts_lower(s) | allowed)

    return F.filter(parts, usable)


def keyword_sentences(text: Column, words: Column, most: int = 3) -> Column:
    """The first sentences of over 30 characters that hold one of the words."""
    pieces = F.split(collapse(text), r"(?<=[.!?…])\s+")
    return F.slice(F.filter(pieces, lambda s: (F.length(s) > 30) & F.exists(words, lambda w: F.contains(F.lower(s), w))), 1, most)


def between_markers(text: Column, start: str, ends: list[str], most: int = fixed.SECTION_MOST, skip: int = fixed.SECTION_SKIP) -> Column:
    """From the first ``start`` to the nearest of ``ends`` that begins ``skip`` characters on or later, else ``most`` characters; null without ``start``."""
    at = F.instr(text, start)
    stops = [F.nullif(F.position(F.lit(e), text, at + skip), F.lit(0)) for e in ends]
    stop = F.least(*stops) if len(stops) > 1 else stops[0]
    return F.when(at > 0, strip(F.substring(text, at, F.coalesce(stop - at, F.lit(most)))))


def classify(query: Column, hints: dict[str, list[str]] = fixed.HINTS) -> Column:
    """The first document type of which the text holds a hint; null if none."""
    low, out = F.lower(query), None
    for kind, parts in hints.items():
        test = contains_any(low, parts)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def metadata_header(title: Column, source: Column, kind: Column, **extra: Column) -> Column:
    """Front matter; extras that are null are left out."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    return F.concat_ws("\n", F.lit("---"), line("title", title), line("source", source), line("type", kind), *(line(k, v) for k, v in extra.items()), F.lit("---"))


def front_matter(markdown: Column) -> Column:
    """Map of the keys between the first two ``---`` lines; empty without them."""
    head = F.regexp_extract(markdown, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), strip(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value"))), lambda x: x["key"] != "")
    return F.map_from_entries(pairs)
