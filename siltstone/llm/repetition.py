"""Quality rules on repetition, from a suffix array of each text's words.

The suffix arrays of a batch of texts are built together by prefix doubling.
The ranks of every doubling step are kept, so the longest common prefix (LCP)
of neighbouring suffixes is read off by binary descent. A suffix' innermost
LCP interval gives the longest repeated substring that starts there; those
that no earlier start already holds are the maximal repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, python_ready, table

#: Repeats of fewer words don't count for the method's verdict.
MIN_REPEAT = 8
#: Largest part of the words, in per cent, that such repeats may cover.
MAX_COVERED = 40
#: Longest repeat, in words, of a text that is kept.
MAX_LONGEST = 200
#: Words whose suffixes are sorted together; a longer text is sorted alone.
SORT_WORDS = 400_000

_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_maximal"]
REPEATS = T.StructType([T.StructField(c, T.LongType()) for c in _LONGS] + [
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
])


def longest_matches(tokens: np.ndarray, lengths: np.ndarray, kinds: int) -> np.ndarray:
    """For each word, the length of the longest repeat in its text that starts there.

    ``tokens`` holds the texts' word ids (below ``kinds``) one after another;
    the result has one more entry, 0, at each text's end.
    """
    size = int(lengths.sum()) + len(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    key = np.full(size, kinds, np.int64)
    inside = np.ones(size, bool)
    inside[ends] = False
    key[inside] = tokens
    key += doc * (kinds + 1)
    place = np.arange(size)

    def starts(change: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(change, place[: len(change)], 0))

    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(size, np.int64)
    rank[order] = starts(new)
    ranks = [rank.astype(np.int32)]
    active = order[~(new & np.r_[new[1:], True])]  # suffixes that share their first word with another
    step = 1
    while len(active):
        both = rank[active] * size + rank[active + step]
        by = np.argsort(both, kind="stable")
        active, both = active[by], both[by]
        old = rank[active]
        group = starts(np.r_[True, old[1:] != old[:-1]])
        new = np.r_[True, both[1:] != both[:-1]]
        rank = rank.copy()
        rank[active] = old + starts(new) - group
        ranks.append(rank.astype(np.int32))
        active = active[~(new & np.r_[new[1:], True])]
        step *= 2
    suffix = np.empty(size, np.int64)
    suffix[rank] = place
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    near = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b, common = a[near], b[near], np.zeros(len(near), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        more = (ranks[level][a] == ranks[level][b]).astype(np.int64) << level
        common, a, b = common + more, a + more, b + more
    lcp = np.zeros(size + 1, np.int64)
    lcp[near + 1] = common
    longest = np.empty(size, np.int64)
    longest[suffix] = np.maximum(lcp[:-1], lcp[1:])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words the repeats of ``least`` words or more cover."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _measured(texts: list[str], words: list[list[bytes]], min_repeat: int) -> list[dict]:
    ids: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in words], np.int64)
    tokens = np.fromiter((ids.setdefault(x, len(ids)) for w in words for x in w), np.int64, int(lengths.sum()))
    longest = longest_matches(tokens, lengths, len(ids))
    first = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    short, full = covered(longest, 3), covered(longest, min_repeat)
    maximal = (longest >= min_repeat) & (np.r_[0, longest[:-1]] != longest + 1)
    sums = [np.add.reduceat(x.astype(np.int64), first).tolist() for x in (short, full, maximal)]
    most = np.maximum.reduceat(longest, first).tolist()
    out = []
    for k, (text, w) in enumerate(zip(texts, words, strict=True)):
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")] if "\n" in text else []
        spans = []
        if sums[1][k]:
            on = np.flatnonzero(np.diff(np.r_[0, full[first[k] : first[k] + len(w)].astype(np.int8), 0]))
            spans = [{"start": a, "end": b} for a, b in on.reshape(-1, 2).tolist()]
        out.append({
            "n_words": len(w),
            "word_chars": len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c"),
            "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": sums[0][k], "n_covered": sums[1][k], "longest_repeat": most[k], "n_maximal": sums[2][k], "spans": spans,
        })
    return out


def measure(texts: list, min_repeat: int = MIN_REPEAT, sort_words: int = SORT_WORDS) -> list[dict]:
    out, some, words, total = [], [], [], 0
    for text in texts:
        text = text or ""
        w = text.encode("utf-8", "surrogatepass").split()
        if some and total + len(w) > sort_words:
            out += _measured(some, words, min_repeat)
            some, words, total = [], [], 0
        some.append(text)
        words.append(w)
        total += len(w)
    return out + (_measured(some, words, min_repeat) if some else [])


def measure_repetition(docs: DataFrame, *, text_col: str = "text", out_col: str = "repetition", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``docs`` with a struct ``out_col`` of counts and the covered word ranges.

    Each text is measured whole and alone, so there's no shuffle. Null counts
    as empty: all counts 0, no spans. Repeated rows give the same result each.
    Columns pass through; one named ``out_col`` is replaced.
    """
    python_ready(docs.sparkSession)
    return append_column(docs, out_col, REPEATS, lambda: lambda texts: measure(texts, min_repeat), [text_col])


def quality(found: str = "repetition", max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST):
    """(base_failed, kept) as columns."""
    c = lambda x: F.col(f"{found}.{x}")
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    return failed, ~failed & (100 * c("n_covered") <= max_covered * c("n_words")) & (c("longest_repeat") <= max_longest)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: counts of words, symbols and repeats, and whether it is kept. Null and empty texts have no words and fail; repeated rows come one by one; see ``measure_repetition``."""
    found = measure_repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed, kept = quality()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered"]
    return found.select("doc_id", *(F.col(f"repetition.{c}").alias(c) for c in names), failed.alias("base_failed"), kept.alias("kept"))


def _sql_covered(n: int) -> str:
    return f"""select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + {n})) p from
        (select doc_id, i, count(*) over (partition by doc_id, s) times from
            (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') s from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) i from d where len(w) >= {n})))
        where times > 1) group by doc_id"""


OP2_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
     l as (select doc_id, len(x) - len(list_distinct(x)) n from (select doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) x from d)),
     r3 as ({_sql_covered(3)}),
     r8 as ({_sql_covered(MIN_REPEAT)}),
     rl as ({_sql_covered(MAX_LONGEST + 1)}),
     m as (select d.doc_id, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) word_chars,
                  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(l.n as bigint) n_dup_lines,
                  coalesce(r3.n, 0) n_repeat_words, coalesce(r8.n, 0) n_covered, coalesce(rl.n, 0) long_words
           from d join l using (doc_id) left join r3 using (doc_id) left join r8 using (doc_id) left join rl using (doc_id)),
     f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select * exclude (long_words), not base_failed and 100 * n_covered <= {MAX_COVERED} * n_words and long_words = 0 kept from f
"""
