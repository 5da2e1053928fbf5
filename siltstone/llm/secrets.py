"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Two first-order character models are counted from labelled samples; a token's
mean log-likelihood ratio says whether its characters follow each other like
those of a random string. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import union
from .common import table
from .spans import apart_from, described, in_order, let, match_spans

#: The base patterns.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Labelled samples drawn of each class, of which half train and half calibrate.
SAMPLES = 8000
#: Part of the held-out identifiers that may be taken for random strings.
FALSE_ALARMS = 0.002


def identifier_words(spark: SparkSession) -> list[str]:
    """Words of which identifiers are made: those of the session's function names and configuration keys; the same in any order of settings."""
    names = [f.name for f in spark.catalog.listFunctions("default") if f.isTemporary] + [r[0] for r in spark.sql("set -v").select("key").collect()]
    words = {w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n)}
    return sorted(w for w in words if 2 <= len(w) <= 14)


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(id, random, s): random strings and ordinary identifiers of 16 characters or more, the same at each call.

    Random ones are digests and their base64, base32-like and alphanumeric
    forms; identifiers join words in the usual styles, a third with a number.
    """
    at = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512))
    size = (F.lit(16) + F.pmod(F.xxhash64("id"), F.lit(29))).cast("int")
    base64 = F.base64(F.unhex("h"))
    plain, style = F.regexp_replace(base64, "[+/=]", ""), F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(6))
    forms = [F.col("h"), F.upper("h"), base64, F.translate(base64, "+/", "-_"), F.translate(F.upper(plain), "0189", "WXYZ")]
    kinds = plain
    for k, form in enumerate(forms):
        kinds = F.when(style == k, form).otherwise(kinds)
    random = at.select("id", F.lit(True).alias("random"), F.regexp_replace(kinds.substr(F.lit(1), size), "=", "").alias("s"))
    words = identifier_words(spark)
    known = F.split(F.lit(" ".join(words)), " ")
    drawn = lambda *x: F.pmod(F.xxhash64("id", *x), F.lit(1 << 30)).cast("int")
    pick = F.transform(F.sequence(F.lit(0), (drawn(F.lit("n")) % 4 + 2).cast("int")), lambda k: F.element_at(known, F.pmod(F.xxhash64(F.col("id"), k), F.lit(len(words))).cast("int") + 1))
    camel = F.array_join(F.transform(pick, lambda w: F.initcap(w)), "")
    look = drawn(F.lit("style")) % 8
    shown = camel
    for k, form in enumerate([F.array_join(pick, "_"), F.array_join(pick, "-"), F.array_join(pick, "/"), F.upper(F.array_join(pick, "_")), F.array_join(pick, ""), F.concat(F.lower(camel.substr(1, 1)), F.substring(camel, 2, 200))]):
        shown = F.when(look == k, form).otherwise(shown)
    number = F.when(drawn(F.lit("number")) % 3 == 0, F.substring(drawn(F.lit("digits")).cast("string"), F.lit(1), drawn(F.lit("width")) % 4 + 1)).otherwise("")
    ordinary = at.select("id", F.lit(False).alias("random"), F.concat(shown, number).alias("s"))
    return union(random, ordinary).filter(F.length("s") >= 16)


@dataclass(frozen=True)
class Models:
    ratios: str  # log ratio of each pair of characters, comma-joined
    threshold: float


def mean_ratio(token: Column, ratios: str) -> Column:
    """Mean log-likelihood ratio, random against ordinary, of a token's character pairs."""
    table_ = F.split(F.lit(ratios), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = lambda p, i: F.element_at(table_, p[i] * len(ALPHABET) + p[i + 1] + 1)
    total = let(places, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), F.lit(0.0), lambda a, i: a + pair(p, i)))
    return total / (F.length(token) - 1)


def train_models(samples: DataFrame, false_alarms: float = FALSE_ALARMS) -> Models:
    """Count both models from the (id, random, s) rows of even id; s has two characters or more, of ALPHABET only.

    ``samples`` is a bounded sample of labelled rows. At most two numbers for
    each pair of its characters come back to the driver. The threshold is the
    ratio that ``false_alarms`` of the ordinary strings of odd id pass.
    """
    pairs = samples.filter("id % 2 = 0").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("p"))
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy("random", "p").count().collect()}
    size = len(ALPHABET)
    firsts = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (True, False) for a in ALPHABET}
    odds = lambda k, a, b: (counts.get((k, a + b), 0) + 1) / (firsts[k, a] + size)
    ratios = ",".join(f"{math.log(odds(True, a, b) / odds(False, a, b)):.6f}" for a in ALPHABET for b in ALPHABET)
    ordinary = samples.filter("not random and id % 2 = 1").agg(F.percentile(mean_ratio(F.col("s"), ratios), F.lit(1 - false_alarms))).first()[0]
    return Models(ratios, max(float(ordinary or 0.0), 0.0))


def find_secrets(docs: DataFrame, models: Models, *, text_col: str = "text", base_col: str = "base", added_col: str = "added") -> DataFrame:
    """``docs`` with two arrays of spans (start, end, kind, match): patterns' and the models'.

    Null counts as empty and has none. The models judge tokens of 16 characters
    or more with letters and digits that no pattern has found; repeated rows
    give the same each, and an empty table gives no rows. Whole texts are
    searched, in time linear in their length and matches; nothing is shuffled.
    Columns pass through, but for those with the names of the new ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        match_spans(text, "assign", ASSIGN, lambda m, g: F.length(g) >= 6, group=2), match_spans(text, "access", ACCESS), match_spans(text, "hex", HEX)
    )
    odd = lambda m, g: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (mean_ratio(m, models.ratios) > models.threshold)
    rows = docs.withColumn(base_col, in_order(base, KINDS, True))
    return rows.withColumn(added_col, apart_from(match_spans(text, "random", TOKEN, odd), F.col(base_col)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: base secrets by kind, their digest, and all spans with those that the models add. Null texts count as empty; repeated rows and ids come one by one; see ``find_secrets``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train_models(labelled_samples(spark)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(described(F.col("base")), 256).alias("base_sha256"),
        described(in_order(F.concat("base", "added"), KINDS, True)).alias("spans"),
    )
