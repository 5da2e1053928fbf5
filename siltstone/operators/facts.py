"""Sections cut out of documents by markers, and overviews of facts that rules find in them.

Both are tables made in one pass over the documents, in which each rule is a
column; answers join them.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.frames import union
from ..functions.text import between_markers, collapse


class Section(NamedTuple):
    """From a marker to the nearest of others; questions with one of the intents get it."""

    name: str
    start: str
    ends: list[str]
    intents: tuple[str, ...] = ()


class Fact(NamedTuple):
    """What a pattern's first group says; of several rules for a fact the first that matches, by priority. ``{}`` in the template stands for it."""

    fact: str
    priority: int
    pattern: str
    template: str = "{}"


class Overview(NamedTuple):
    """Facts of the first document whose source holds ``source``, between two lines."""

    source: str
    facts: list[Fact]
    lead: str
    closing: str


PROHIBITED = Section("prohibited_acts", fixed.ARTICLE_START, fixed.ARTICLE_ENDS, ("prohibited", "storage"))
LAW = Overview(fixed.FACT_SOURCES["overview"], [Fact(f, 1, p) for f, p in fixed.LAW_FACTS], "The main points of the law:", "Only what the text of the law says is used.")
DECREE = Overview(fixed.FACT_SOURCES["decree_summary"], [Fact(f, 1, p) for f, p in fixed.DECREE_FACTS], "Summary of the decree:", "Annexes and forms are left out.")


def section_table(docs: DataFrame, sections: Iterable[Section] = (PROHIBITED,), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, at, content) for each section that a document holds; ``at`` is its first character's place, from 1.

    Documents without text or start have none. A section whose start has no
    end after it goes on for a bounded number of characters.
    """
    text = F.col(text_col)
    each = [F.struct(F.lit(s.name).alias("section"), F.instr(text, s.start).cast("long").alias("at"), between_markers(text, s.start, s.ends).alias("content")) for s in sections]
    rows = docs.select(id_col, F.explode(F.array(*each)).alias("s"))
    return rows.select(id_col, "s.section", "s.at", "s.content").filter("content <> ''")


def first_sections(docs: DataFrame, sections: Iterable[Section] = (PROHIBITED,)) -> DataFrame:
    """(intent, priority, doc_id, source, type, text) of each section's first document, by id, for each of its intents; at most a row a rule and intent.

    ``docs`` has doc_id, text, source and type. Priorities follow the order of the sections.
    """
    sections = list(sections)
    found = section_table(docs, sections).join(docs.select("doc_id", "source", "type"), "doc_id")
    one = found.groupBy("section").agg(F.min(F.struct("doc_id", "source", "type", F.col("content").alias("text"))).alias("d"))
    rules = [(s.name, intent, k) for k, s in enumerate(sections) for intent in s.intents]
    rules = docs.sparkSession.createDataFrame(rules, "section string, intent string, priority int")
    return F.broadcast(rules).join(one, "section").select("intent", "priority", "d.*")


def _line(text: Column, fact: Fact) -> Column:
    """The template with what the pattern finds; null if it finds nothing."""
    found = F.nullif(F.regexp_extract(text, fact.pattern, 1), F.lit(""))
    return F.replace(F.lit(fact.template), F.lit("{}"), found)


def fact_lines(text: Column, facts: list[Fact]) -> Column:
    """Array of (fact, line), in the order in which facts first appear among the rules; white space counts as single blanks."""
    plain = collapse(text)
    names = list(dict.fromkeys(f.fact for f in facts))
    lines = [F.struct(F.lit(n).alias("fact"), F.coalesce(*(_line(plain, f) for f in sorted((f for f in facts if f.fact == n), key=lambda f: f.priority))).alias("line")) for n in names]
    return F.filter(F.array(*lines), lambda x: x["line"].isNotNull())


def fact_table(docs: DataFrame, facts: list[Fact], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fact, line): a row for each fact that a document states; null texts state none."""
    return docs.select(id_col, F.explode(fact_lines(F.col(text_col), facts)).alias("f")).select(id_col, "f.fact", "f.line")


def fact_overview(docs: DataFrame, rules: Overview, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, n_facts, overview) of each document that states a fact: a bullet with its source for each, between two lines."""
    rows = docs.select(id_col, F.coalesce(source_col, F.lit("")).alias("_source"), fact_lines(F.col(text_col), rules.facts).alias("_facts")).filter(F.size("_facts") > 0)
    bullets = F.transform("_facts", lambda x: F.concat(F.lit("- "), x["line"], F.lit(" ["), "_source", F.lit("]")))
    text = F.concat_ws("\n", F.lit(rules.lead), F.array_join(bullets, "\n"), F.lit(rules.closing))
    return rows.select(id_col, F.size("_facts").cast("long").alias("n_facts"), text.alias("overview"))


def overviews(docs: DataFrame, rules: dict[str, Overview] | None = None) -> DataFrame:
    """(intent, overview): at most one for each intent, of the fitting document with the smallest id that states a fact."""
    rules = {"overview": LAW, "decree_summary": DECREE} if rules is None else rules
    out = []
    for intent, r in rules.items():
        made = fact_overview(docs.filter(F.lower("source").contains(r.source)), r)
        out.append(made.agg(F.min_by("overview", "doc_id").alias("overview")).filter("overview is not null").select(F.lit(intent).alias("intent"), "overview"))
    return union(*out)
