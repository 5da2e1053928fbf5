"""Personal data: candidate spans, judged by gradient-boosted trees.

Patterns with high recall propose spans that may overlap; boosted trees weigh
their format and the words before them; a calibrated threshold selects. The
base patterns' spans always stay. DataFrame functions only: the trees become
CASE expressions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import SPAN_NEAR, apart_from, described, in_order, let, match_spans, scanned

#: The base patterns. A run of characters is tried from its start only (or from where a match ended),
#: which finds the same and is linear in long runs; repeated groups are possessive, as Java needs stack for others.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
#: Kinds and patterns of further candidates.
PROPOSED = {
    "mail_words": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ (?:\(at\)|\[at\]|at) [a-z0-9-]+ (?:\(dot\)|\[dot\]|dot) [a-z]{2,}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "number": r"\(?\b[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}\b",
    "ip6": r"\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b",
}
KINDS = [*BASE, *PROPOSED]
#: Labelled samples; boosting rounds; depth of a tree; precision that each kind's threshold is to reach.
SAMPLES, TREES, DEPTH, PRECISION = 8000, 12, 3, 0.98

#: Words before a candidate that speak for and against it.
FOR, AGAINST = r"(?i)\b(?:phone|tel|call|mobile|fax|mail|contact|reach|ssn|social|iban|account|address|from|host|write)\b", r"(?i)\b(?:order|version|isbn|invoice|part|page|no|chapter|serial|ratio|score|build|pp|item|figure)\b"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def features(kind: Column, match: Column, before: Column, after: Column) -> list[tuple[str, Column]]:
    n = F.length(digits(match))
    flag = lambda x: x.cast("double")
    return [
        *((f"is_{k}", flag(kind == k)) for k in PROPOSED),
        ("digits", n.cast("double")),
        ("length", F.length(match).cast("double")),
        ("letters", F.length(F.regexp_replace(match, "[^A-Za-z]", "")).cast("double")),
        ("separators", F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")).cast("double")),
        ("kinds_of_separator", F.size(F.array_distinct(F.regexp_extract_all(match, F.lit("[^A-Za-z0-9]"), F.lit(0)))).cast("double")),
        ("parenthesis", flag(match.contains("("))),
        ("for", flag(before.rlike(FOR))),
        ("against", flag(before.rlike(AGAINST))),
        ("joined_before", flag(before.rlike(r"[A-Za-z0-9.,/-]$"))),
        ("joined_after", flag(after.rlike(r"^[A-Za-z0-9/-]|^[.,][0-9]"))),
        ("zeros", flag(digits(match).rlike("000$|^0000"))),
        ("area", F.coalesce(F.substring(digits(match), 1, 3).try_cast("double"), F.lit(-1.0))),
        ("mod97", flag((kind == "iban") & mod97(match))),
        ("ordinary_words", flag((kind == "mail_words") & match.rlike(r"(?i) at (?:the|an?|this|that|each|noon|night|once|least|home|last|first|all) "))),
        ("known_domain", flag(match.rlike(r"(?i) (?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|uk|ch|at|us)$"))),
    ]


def mod97(iban: Column) -> Column:
    """Whether the check digits of an IBAN are right: its first four characters put last, letters as 10 to 35, leave 1 by 97."""
    plain = F.upper(F.regexp_replace(iban, " ", ""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda a, c: let(value(c), lambda v: F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def with_check_digits(land: Column, account: Column) -> Column:
    """An IBAN in groups of four with the right check digits."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.filter(F.split(F.concat(account, land, F.lit("00")), ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))
    return F.rtrim(F.regexp_replace(F.concat(land, F.lpad((98 - rest).cast("string"), 2, "0"), account), "(.{4})", "$1 "))


def labelled_candidates(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(id, kind, match, before, after, label): made up by rules, half of them personal data; the same at each call.

    What isn't personal has the same patterns: part numbers, figures in groups,
    versions, strings with wrong check digits, hex dumps, and prose with "at"
    and "dot". Either label comes in plain surroundings too, and some personal
    data in misleading ones.
    """
    at = spark.range(n)
    draw = lambda what, below: F.pmod(F.xxhash64("id", F.lit(what)), F.lit(below)).cast("int")
    num = lambda what, width: F.lpad(draw(what, 10**width).cast("string"), width, "0")
    one = lambda what, xs: F.element_at(F.array(*map(F.lit, xs)), draw(what, len(xs)) + 1)
    letters = lambda what, k: F.translate(F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(what)), 256), 1, k), "0123456789", "klmnoprstu")
    name = F.concat(letters("name", 4), one("joint", ["", ".", "_", "-"]), letters("surname", 5), F.when(draw("n", 3) == 0, num("n2", 2)).otherwise(""))
    land, account = one("land", ["DE", "FR", "ES", "GB", "NL", "IT"]), F.concat(num("b", 8), num("c", 8), F.when(draw("long", 2) == 0, num("d", 4)).otherwise(""))
    area = F.lpad((draw("a", 898) + 1).cast("string"), 3, "0")
    style, lines = draw("style", 5), [F.concat(F.lit("("), num("p", 3), F.lit(") "), num("q", 3), F.lit("-"), num("r", 4)), F.concat_ws("-", num("p", 3), num("q", 3), num("r", 4)), F.concat_ws(".", num("p", 3), num("q", 3), num("r", 4)), F.concat(F.lit("0"), num("p", 2), F.lit(" "), num("q", 4), F.lit(" "), num("r", 4)), F.concat(F.lit("0"), num("p", 3), F.lit("-"), num("q", 3), F.lit(" "), num("r", 3))]
    phone = lines[0]
    for k, x in enumerate(lines[1:], 1):
        phone = F.when(style == k, x).otherwise(phone)
    group = lambda what: F.lower(F.hex(draw(what, 65535) + 1))
    good = {
        "mail_words": F.concat(name, one("at", [" at ", " (at) ", " [at] "]), letters("host", 6), one("dot", [" dot ", " (dot) ", " [dot] "]), one("tld", ["com", "org", "de", "fr", "net", "eu"])),
        "ssn": F.concat_ws("-", F.when(area == "666", "665").otherwise(area), F.lpad((draw("b", 99) + 1).cast("string"), 2, "0"), F.lpad((draw("c", 9999) + 1).cast("string"), 4, "0")),
        "iban": with_check_digits(land, account),
        "number": phone,
        "ip6": F.concat_ws(":", *(group(f"g{k}") for k in range(8))),
    }
    figures = F.concat((draw("p", 98) + 1).cast("string"), one("sep", [" ", ".", "-"]), num("q", 3), one("sep", [" ", ".", "-"]), F.concat(num("r", 1), F.lit("00")))
    dump = F.concat_ws(":", *(F.lpad(F.lower(F.hex(draw(f"d{k}", 4) * draw(f"e{k}", 2))), 2, "0") for k in range(8)))
    bad = {
        "mail_words": F.concat(one("w", ["look", "meet", "stop", "arrive", "stare", "laugh", "met"]), F.lit(" at "), one("x", ["the", "noon", "each", "a", "this", "night", "home"]), F.lit(" dot "), one("y", ["on", "in", "of", "matrix", "the", "product"])),
        "ssn": F.concat_ws("-", F.when(draw("w", 2) == 0, (draw("a", 100) + 900).cast("string")).otherwise(num("a", 3)), num("b", 2), F.when(draw("w", 2) == 1, "0000").otherwise(num("c", 4))),
        "iban": F.concat(one("code", ["XX", "AB", "DE", "SN", "FR"]), num("b", 2), F.lit(" "), num("c", 4), F.lit(" "), num("d", 4), F.lit(" "), num("e", 4)),
        "number": F.when(draw("w", 3) == 0, F.concat_ws(".", num("p", 2), num("q", 3), num("r", 4))).otherwise(figures),
        "ip6": dump,
    }
    kind, label = one("kind", list(PROPOSED)), draw("label", 2)
    pick = lambda forms: F.coalesce(*(F.when(kind == k, v) for k, v in forms.items()))
    told = one("told", ["phone: ", "call me at ", "my ssn is ", "iban ", "contact ", "tel ", "write to ", "mobile ", "reach us: ", "account "])
    other = one("other", ["order ", "version ", "invoice no ", "page ", "serial ", "part ", "isbn ", "figure ", "build "])
    plain = one("plain", ["we saw ", "and then ", "la suite ", "der text ", "of the ", "", "is ", "y luego "])
    way = draw("ctx", 10)
    before = F.when(label == 1, F.when(way < 4, told).when(way < 9, plain).otherwise(other)).otherwise(F.when(way < 5, other).otherwise(plain))
    after = F.when((label == 0) & (draw("aft", 3) == 0), one("tail", ["7", "/2", "-x"])).otherwise(one("end", [" ", ".", ",", ". "]))
    # a part of what isn't personal has the right format, in surroundings that speak against it
    match = F.when((label == 1) | ((way < 2) & (draw("swap", 2) == 0)), pick(good)).otherwise(pick(bad))
    return at.select("id", kind.alias("kind"), match.alias("match"), before.alias("before"), after.alias("after"), label.cast("double").alias("label"))


@dataclass(frozen=True)
class Trees:
    rules: tuple  # of each tree: nested (feature, bound, yes, no), or a weighted vote
    thresholds: tuple  # (kind, least margin)


def margin(f: Column, rules: tuple) -> Column:
    return F.aggregate(F.array(f), F.lit(0.0), lambda a, x: a + _votes(x, rules))


def _votes(x: Column, rules: tuple) -> Column:
    total = F.lit(0.0)
    for r in rules:
        total = total + _vote(x, r)
    return total


def _vote(x: Column, rule) -> Column:
    if isinstance(rule, float):
        return F.lit(rule)
    k, bound, yes, no = rule
    return F.when(x[k] <= bound, _vote(x, yes)).otherwise(_vote(x, no))


def parsed(lines: list[str], weight: float):
    """A regression tree's printed form as nested (feature, bound, yes, no), or a weighted vote."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split()[1]) * weight
    k, bound = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
    yes = parsed(lines, weight)
    lines.pop(0)  # Else
    return int(k), float(bound), yes, parsed(lines, weight)


def train_trees(labelled: DataFrame, precision: float = PRECISION) -> Trees:
    """Boost on three fifths of the samples; on a fifth find each kind's least margin at which ``precision`` holds.

    ``labelled`` is a bounded sample of candidates. The last fifth (id % 5 = 4)
    is left for measuring.
    """
    c = F.col
    made = labelled.withColumn("f", F.array(*(x for _, x in features(c("kind"), c("match"), c("before"), c("after")))))
    rows = made.select("id", "kind", "label", "f", array_to_vector("f").alias("features"))
    fit = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(rows.filter("id % 5 in (1, 2, 3)").coalesce(1))
    rules = tuple(parsed(t.toDebugString.split("\n")[1:], w) for t, w in zip(fit.trees, fit.treeWeights, strict=True))
    held = sorted(((r["kind"], -r["m"], r["label"]) for r in rows.filter("id % 5 = 0").select("kind", "label", margin(c("f"), rules).alias("m")).collect()))
    thresholds = dict.fromkeys(PROPOSED, math.inf)
    for kind in PROPOSED:
        right = 0.0
        mine = [x[1:] for x in held if x[0] == kind]
        for k, (m, label) in enumerate(mine, 1):
            right += label
            if right >= precision * k and (k == len(mine) or mine[k][0] != m):
                thresholds[kind] = -m
    return Trees(rules, tuple(thresholds.items()))


def selected(model: Trees, s: Column) -> Column:
    """Whether the trees take a candidate with fields kind, match, before and after."""
    bound = F.coalesce(*(F.when(s["kind"] == k, F.lit(float(m))) for k, m in model.thresholds))
    return margin(F.array(*(x for _, x in features(s["kind"], s["match"], s["before"], s["after"]))), model.rules) >= bound


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    twice = F.split(F.lit("0,2,4,6,8,1,3,5,7,9"), ",").cast("array<int>")
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(F.element_at(twice, F.substring(number, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    size = lambda m: F.length(digits(m))
    small = lambda m: F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.concat(
        match_spans(text, "email", EMAIL),
        match_spans(text, "ip", IP, lambda m, g: small(m)),
        match_spans(text, "card", CARD, lambda m, g: size(m).between(16, 19) & luhn(digits(m))),
        match_spans(text, "phone", PHONE, lambda m, g: size(m).between(8, 15)),
    )


def find_personal_data(docs: DataFrame, model: Trees, *, text_col: str = "text", base_col: str = "base", added_col: str = "added") -> DataFrame:
    """``docs`` with two arrays of spans (start, end, kind, match): the base patterns' and those that the trees select.

    Null counts as empty and has none. Proposals that overlap a base span
    aren't judged; those that overlap each other are each judged, so selected
    spans may overlap. A proposal's context reaches to the one of its kind
    before it. Whole texts are searched, in time linear in their length and
    matches; repeated rows give the same each, an empty table gives no rows;
    nothing is shuffled. Columns pass through, but for those with the names of
    the new ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    proposed = F.concat(*(match_spans(text, k, p, near=True) for k, p in PROPOSED.items()))
    rows = docs.withColumn(base_col, in_order(base_spans(text), BASE, False))
    kept = F.filter(apart_from(proposed, F.col(base_col), SPAN_NEAR), lambda s: selected(model, s))
    return rows.withColumn(added_col, F.transform(kept, lambda s: s.dropFields("before", "after")))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span's characters replaced by its kind in brackets; of overlapping spans the first gives the kind, and all are taken out."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    far = F.greatest(F.lit(0), F.array_max(F.transform(spans, lambda s: s["end"])))

    def piece(at: Column, s: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), s["kind"], F.lit("]")))

    pieces = scanned(ordered, F.lit(0), lambda s: s["end"], lambda a, b: F.greatest(a, b), piece, "string")
    return F.concat(F.array_join(pieces, ""), F.substring(text, far + 1, F.length(text)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: personal data by kind, their digest, and all spans with those that the trees add. Null texts count as empty; repeated rows and ids come one by one; see ``find_personal_data``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train_trees(labelled_candidates(spark)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(described(F.col("base")), 256).alias("base_sha256"),
        described(in_order(F.concat("base", "added"), KINDS, False)).alias("spans"),
    )
