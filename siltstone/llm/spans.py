"""Places of regular-expression matches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a run: arrays grow by appending within runs only, so that long ones take no quadratic time.
RUN = 128


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


SPAN = "struct<start:int,end:int,kind:string,match:string>"
#: A span with up to 32 characters before it and 2 after it, as far as no other match of its kind.
NEAR, NEXT = 32, 2
SPAN_NEAR = "struct<start:int,end:int,kind:string,match:string,before:string,after:string>"


def scanned(rows: Column, zero: Column, part, plus, made, made_type: str) -> Column:
    """``made(state, x)`` for each x of an array, state being the ``part``s of all before it, joined by ``plus``; those that are null are left out.

    The array is cut into runs: the states at their starts come from the runs'
    totals, so the work grows with the array's length times RUN at most, and
    with the square of the number of runs only in copies of pointers.
    """
    runs = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / RUN).cast("int")), lambda k: F.slice(r, k * RUN + 1, F.lit(RUN)))
    total = lambda run: F.aggregate(run, zero, lambda a, x: plus(a, part(x)))

    def starts(totals: Column) -> Column:
        state = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(totals, state, lambda a, t: F.struct(plus(a["at"], t).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def within(run: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(f"array<{made_type}>").alias("out"))
        step = lambda a, x: F.struct(plus(a["at"], part(x)).alias("at"), let(made(a["at"], x), lambda m: F.when(m.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(m)))).alias("out"))
        return F.aggregate(run, state, step, lambda a: a["out"])

    whole = lambda rs: F.flatten(F.zip_with(rs, starts(F.transform(rs, total)), within))
    return let(rows, lambda r: F.when(F.size(r) > 0, let(runs(r), whole)).otherwise(F.array().cast(f"array<{made_type}>")))


def match_spans(text: Column, kind: str, pattern: str, fits=None, group: int = 0, near: bool = False) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of (start, end, kind, match), with ``near`` of (..., before, after) too.

    Code points, end exclusive. ``fits`` takes the match and its ``group`` and
    says which matches stay; text that a failing match took isn't tried again.
    A split at the pattern gives the pieces between the matches, so the
    lengths of pieces and matches add up to the places.
    """
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    caught = F.regexp_extract_all(text, rx, F.lit(group)) if group else F.array().cast("array<string>")
    pieces = F.split(text, pattern, -1)
    tails = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.lit(NEXT))) if near else F.array().cast("array<string>")
    rows = let(found, lambda m: F.slice(F.arrays_zip(pieces.alias("p"), m.alias("m"), caught.alias("g"), (F.slice(tails, F.lit(2), F.size(tails)) if near else tails).alias("t")), F.lit(1), F.size(m)))

    def one(at: Column, x: Column) -> Column:
        begin = at + F.length(x["p"])
        more = [F.right(x["p"], F.lit(NEAR)).alias("before"), x["t"].alias("after")] if near else []
        span = F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("match"), *more)
        return span if fits is None else F.when(fits(x["m"], x["g"]), span)

    kind_of = SPAN_NEAR if near else SPAN
    spans = scanned(rows, F.lit(0), lambda x: F.length(x["p"]) + F.length(x["m"]), lambda a, b: a + b, one, kind_of)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{kind_of}>"))


def described(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: list[str], start_first: bool) -> Column:
    """Sorted by start, then kind as listed, or the other way round."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s.alias("s")) if start_first else F.struct(rank(s).alias("a"), s["start"].alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def apart_from(spans: Column, others: Column, span_type: str = SPAN) -> Column:
    """Those that overlap none of ``others``, by their end.

    A span overlaps another if one that starts before its end ends after its
    start, so in the order of starts and ends the greatest end so far decides.
    """
    # at the same place a span's end comes before another's start
    asked = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("other"), F.lit(0).alias("end"), s.alias("s")))
    known = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("other"), o["end"].alias("end"), F.lit(None).cast(span_type).alias("s")))
    both = F.array_sort(F.concat(asked, known))
    kept = scanned(both, F.lit(-1), lambda x: x["end"], lambda a, b: F.greatest(a, b), lambda far, x: F.when((x["other"] == 0) & (far <= x["s"]["start"]), x["s"]), span_type)
    return let(spans, lambda s: F.when(F.size(s) > 0, kept).otherwise(s))
