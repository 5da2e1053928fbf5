"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised test questions and answers are sequences of word numbers. A
window of 13 words always holds one of the blocks of 7 into which its item is
cut, so the automaton has these blocks only, about one state for each word of
the benchmark; items of fewer words than a window are blocks of their own. Each
document is scanned once; where a block occurs, the match is followed to both
sides, and runs of a window or more are hits. Spans are mapped back to code
points of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, python_ready, joined_sha256, table

WINDOW = 13
#: Words of benchmark in one automaton (about 100 bytes of memory each); a larger benchmark is scanned for in further blocks.
BLOCK_WORDS = 4_000_000

#: A-Z to a-z; every byte that is no part of a word to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Dicts of text's words -> item ids, each of at most ``block_words`` words and one item more."""
    block: dict[bytes, set] = defaultdict(set)
    size = 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        key = b" ".join(words)
        size += len(words) if key not in block else 0
        block[key].add(item)
        if size >= block_words:
            yield dict(block)
            block, size = defaultdict(set), 0
    if block:
        yield dict(block)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


class Items:
    """The benchmark's texts as word numbers, and the automaton over their blocks."""

    def __init__(self, texts: dict, window: int):
        import ahocorasick

        self.window, self.number = window, {}
        self.texts = [tuple(self.number.setdefault(w, len(self.number) + 1) for w in key.split(b" ")) for key in texts]
        self.ids = [tuple(i for i in ids if i is not None) for ids in texts.values()]
        step = window // 2 + 1
        places: dict[tuple, list] = defaultdict(list)
        for k, words in enumerate(self.texts):
            if len(words) < window:
                places[words].append((k, 0))
            else:
                for at in range(0, len(words) - step + 1, step):
                    places[words[at : at + step]].append((k, at))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, found in places.items():
            self.machine.add_word(block, (len(block), found))
        if places:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(ranges of words, ids) of all runs of a window or more, or of a whole shorter item, that an item shares."""
        get = self.number.get
        doc = tuple([get(w, 0) for w in words])
        ranges, ids, done = set(), set(), set()
        if not self.texts or not any(doc):
            return [], ids
        for last, (size, found) in self.machine.iter(doc):
            first = last - size + 1
            for k, at in found:
                item = self.texts[k]
                end = first + len(item) - at  # of the item, laid along the document here
                if (k, end, first) in done:  # within a run that was followed before
                    continue
                low, high = 0, size
                if len(item) >= self.window:
                    while low > -at and first + low > 0 and doc[first + low - 1] == item[at + low - 1]:
                        low -= 1
                    while at + high < len(item) and first + high < len(doc) and doc[first + high] == item[at + high]:
                        high += 1
                    done.update((k, end, first + j) for j in range(0, high, size))
                    if high - low < self.window:
                        continue
                ranges.add((first + low, first + high))
                ids.update(self.ids[k])
        return list(ranges), ids


_built: dict[str, Items] = {}


def built(name: str, texts: dict, window: int) -> Items:
    """The automaton of that name; a worker builds it once."""
    if name not in _built:
        if len(_built) > 1:
            _built.clear()
        _built[name] = Items(texts, window)
    return _built[name]


def scanner(items: Items):
    """A function that adds the hits of ``items`` to those of the blocks before."""

    def work(texts: list, earlier: list | None = None) -> list:
        out = []
        for k, text in enumerate(texts):
            words = words_of(text)
            old = earlier[k] if earlier else None
            hits, ids = items.hits(words)
            if old:
                hits, ids = hits + [(x["start"], x["end"]) for x in old["words"]], ids | set(old["items"])
            hits, spans = merged(hits), []
            if hits:
                places = [m.span() for m in _WORD.finditer(text)]
                spans = [(places[a][0], places[b - 1][1]) for a, b in hits]
            pair = lambda xs: [{"start": a, "end": b} for a, b in xs]
            out.append({"n_words": len(words), "words": pair(hits), "items": sorted(ids), "spans": pair(spans)})
        return out

    return work


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    out_col: str = "contamination", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, hit word ranges, items, original spans.

    Null and empty texts have no words and no hits; so has everything if the
    benchmark is empty. An item without words makes no window. Repeated items
    and rows count as they stand; an item with a null id marks words but isn't
    listed; ids may have any type that sorts. Columns pass through; one named
    ``out_col`` is replaced. The benchmark is the stated query set: it goes to
    the executors in blocks of bounded size, of which collections of usual
    size make one, with one narrow pass for each, without a shuffle.
    """
    spark = docs.sparkSession
    python_ready(spark)
    found = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("words", _SPANS), T.StructField("items", T.ArrayType(benchmark.schema[item_col].dataType)), T.StructField("spans", _SPANS),
    ])
    out = docs
    for k, block in enumerate(item_blocks(benchmark, item_col, item_text_col, block_words)):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        out = append_column(out, out_col, found, lambda sent=sent, name=name: scanner(built(name, sent.value, window)), [text_col, out_col] if k else [text_col])
    if out is docs:
        out = append_column(out, out_col, found, lambda: scanner(Items({}, window)), [text_col])
    return out


def n_hit(found: str = "contamination"):
    return F.aggregate(f"{found}.words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def is_contaminated(found: str = "contamination"):
    """At least a twentieth of the words is hit."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its words, those that stand in benchmark windows, and the items that these are of. Null and empty texts have no words; null items hold none; repeated rows come one by one; see ``find_contamination``."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("contamination.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        joined_sha256(ids).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
with d as (select doc_id, coalesce({_SQL_WORDS}, []) w from documents),
     b as (select item_id, {_SQL_WORDS} w from benchmark where text is not null),
     bw as (select distinct item_id, least(len(w), {WINDOW}) n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') s
            from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) i from b where len(w) > 0)),
     dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') s
            from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
     m as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.s = bw.s),
     h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from m) group by doc_id),
     t as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct doc_id, cast(item_id as varchar) x from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
