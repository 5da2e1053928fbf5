"""Language identification by cross-parsing entropy.

A suffix automaton of a sample of each language's words gives longest-match
lengths. A text's words, each with a space before and after, are cut greedily
into the longest phrases that occur in the sample; the language that needs the
fewest phrases, weighed by the bits that point into its sample, wins. Phrases
don't cross words, so a word is parsed once and its counts are kept.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, python_ready, remainder, table

#: Bounds of the labelled sample: documents (on average) and characters a language; rows of more characters aren't drawn if the language has others.
SAMPLE_DOCS, SAMPLE_CHARS, ROW_CHARS = 400, 100_000, 20_000
#: Labels that are learned, the most frequent ones; a label column with more isn't one of languages.
LANGUAGES = 256
#: A language is rejected if its phrases are shorter than this on average.
MIN_PHRASE = 2.0
#: Words whose counts a worker keeps.
KNOWN_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_BITS = 40  # of one language's count in a packed sum

FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_chars", T.DoubleType())])


class SuffixAutomaton:
    """All substrings of a text; transitions only, as parsing needs no more."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(self.next[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """Greedy longest matches that cover ``text``; an unknown character is a phrase."""
        count = state = 0
        for c in text:
            to = self.next[state].get(c)
            if to is None:
                count += state > 0
                to = self.next[0].get(c, 0)
                count += to == 0
            state = to
        return count + (state > 0)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in small letters; other characters that count as numbers, such as fractions, are none."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Parser(dict):
    """Word -> phrase counts of all languages, packed into one integer."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        super().__init__()
        self.langs, self.automata = [k for k, _ in samples], [SuffixAutomaton(text) for _, text in samples]
        self.weights = [math.log2(len(text) + 2) for _, text in samples]

    def __missing__(self, word: str) -> int:
        counts = 0
        for k, a in enumerate(self.automata):
            counts |= a.phrases(f" {word} ") << (_BITS * k)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = counts
        return counts


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """A worker builds it once."""
    return Parser(samples)


def identify(text: str | None, known: Parser) -> dict:
    words = words_of(text)
    if not words or not known.langs:
        return {"lang": "und", "score": 0.0, "phrase_chars": 0.0}
    packed = sum(map(known.__getitem__, words))
    counts = [packed >> (_BITS * k) & ((1 << _BITS) - 1) for k in range(len(known.langs))]
    found = sorted(zip([n * w for n, w in zip(counts, known.weights, strict=True)], known.langs, counts, strict=True))
    rest = found[1][0] if len(found) > 1 else 0.0
    return {"lang": found[0][1], "score": 1 - found[0][0] / rest if rest else 1.0, "phrase_chars": sum(len(w) + 2 for w in words) / found[0][2]}


def learn_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[tuple[str, str], ...]:
    """(language, sample of its words) of the LANGUAGES most frequent labels; rows without label or letters are passed over.

    Whole rows are drawn by a hash of their id and text, at a rate that follows
    the language's row count, so the sample is as large at any input size. Rows
    of more than ROW_CHARS characters stand in only for a language that has no
    others, by the shortest of them.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    short = F.length(text_col) <= ROW_CHARS
    rates = {r[0]: (min(1.0, SAMPLE_DOCS / r[1]) if r[1] else 0.0) for r in labelled.groupBy(lang_col).agg(F.count_if(short), F.count("*").alias("_rows")).orderBy(F.desc("_rows"), lang_col).limit(LANGUAGES).collect()}
    if not rates:
        return ()
    rate = F.try_element_at(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)), F.col(lang_col))
    h = F.xxhash64(id_col, text_col)
    rows = labelled.filter(short & (F.pmod(h, F.lit(1 << 30)) < rate * (1 << 30))).select(lang_col, h.alias("h"), F.col(text_col).alias("t")).collect()
    if long := [lang for lang, r in rates.items() if not r]:
        least = F.struct(F.length(text_col).alias("n"), h.alias("h"))
        rows += labelled.filter(F.col(lang_col).isin(long)).groupBy(lang_col).agg(F.min(least)["h"].alias("h"), F.min_by(text_col, least).alias("t")).collect()
    samples: dict[str, str] = dict.fromkeys(sorted(rates), " ")
    for lang, _, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if len(samples[lang]) < SAMPLE_CHARS:
            samples[lang] += "".join(w + " " for w in words_of(text))
    return tuple((k, v) for k, v in samples.items() if len(v) > 1)


def identify_language(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col``: lang, score, phrase_chars.

    ``und`` with score 0 for a null text, one without letters, or if nothing
    was learned. score is 1 - (bits of the best / bits of the next best): 0 for
    a tie, which the lower name wins; 1 if there's one language only. Whole
    texts are parsed; repeated rows give the same each. Columns pass through;
    one named ``out_col`` is replaced.
    """
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(samples)

    def start():
        known = parser(sent.value)
        return lambda texts: [identify(t, known) for t in texts]

    return append_column(docs, out_col, FOUND, start, [text_col])


def is_rejected(found: str = "language", min_phrase: float = MIN_PHRASE) -> Column:
    """No language, or none whose sample holds more than scraps of the text."""
    return (F.col(f"{found}.lang") == "und") | (F.col(f"{found}.phrase_chars") < min_phrase)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with the language predicted by what the other fold's labels taught. A null id isn't held out; ``und`` for null texts and those without letters; without labels all are ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))  # a null id isn't held out
    samples = learn_languages(docs.filter(~F.col("held_out")))
    found = identify_language(docs.select("doc_id", "text", "held_out"), samples)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
