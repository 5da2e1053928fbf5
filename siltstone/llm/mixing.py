"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent: 1 keeps the natural mix, 0
makes it uniform. The exponent is searched on aggregates of the source table;
the weights are realised within a token budget as full permutations of each
source and the first blocks of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import union
from .common import fresh, table, written

#: Part of the largest possible entropy that the mix is to have.
TARGET_ENTROPY = 0.98
#: The query's own: nearly even, and a budget that repeats sources and cuts a permutation of each.
QUERY_ENTROPY, TIMES = 0.999, 1.7
#: Times that a source may be repeated at most.
MAX_REPEATS = 4.0
#: Blocks of a permutation, by hash.
BLOCKS = 4096
#: Exponents tried in one pass of the search, and passes.
SECTIONS, PASSES = 32, 4


def token_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measured(sources: DataFrame, exponents: list[float], total: int, budget: float) -> list[tuple[float, float]]:
    """(entropy, most repeats of a source) for each of a fixed number of exponents, in one aggregate."""
    tried = sources.withColumn("a", F.explode(F.lit(exponents)))
    share = F.col("tokens") / F.lit(total)
    p = F.pow(share, F.col("a"))
    sums = tried.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.col("a") * F.ln(share)).alias("l"), F.max(p / F.col("tokens")).alias("r"))
    # H = ln z - sum(p^a ln p^a) / z
    found = {r["a"]: (math.log(r["z"]) - r["l"] / r["z"], budget * r["r"] / r["z"]) for r in sums.collect()}
    return [found[a] for a in exponents]


def find_exponent(sources: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The largest exponent that meets the target entropy, or a larger one if that repeats a source too often.

    ``sources`` has a positive ``tokens`` for each source. Entropy falls with
    the exponent, and so do the repeats of the rarest source, so each bound is
    bracketed by sections that shrink 32-fold a pass. If no exponent up to 1
    keeps the repetition limit, 1 is taken and the budget decides.
    """
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    target = target_entropy * math.log(n)

    def largest(holds) -> float:
        """The largest exponent in [0, 1] for which holds(entropy, repeats), true up to some point."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
            good = [holds(*m) for m in _measured(sources, grid, total, budget)]
            at = max((k for k, ok in enumerate(good) if ok), default=0)
            if at == SECTIONS:
                return high
            low, high = grid[at], grid[at + 1]
        return low

    by_entropy = largest(lambda h, _: h >= target - 1e-12)
    by_repeats = largest(lambda _, r: r > max_repeats)  # below this a source repeats too often
    if by_repeats > by_entropy or _measured(sources, [by_entropy], total, budget)[0][1] > max_repeats:
        by_repeats = min(1.0, by_repeats + SECTIONS**-PASSES)
        return max(by_entropy, by_repeats)
    return by_entropy


def mix_sources(
    docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", budget: float | None = None, times: float = 1.0,
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: str = "mix", prefix: str = "mix_",
) -> DataFrame:
    """A row of ``docs`` for each time that the mix holds it, with ``mix_*`` columns.

    Those are tokens, weight (of the source), epoch (permutation), block and
    key (place within the block): ordering by (epoch, block, key) walks the
    mix. ``budget`` is in tokens; by default all tokens of ``docs`` so many
    ``times``. A source
    whose share of the budget is e whole epochs and a rest has every row e
    times, and those rows of one more permutation before which less than the
    rest is used up, so it's passed by less than one document. A null source
    is a source of its own. Null and empty texts have no tokens; a source of
    only such texts has no weight and no rows. Repeated rows count one by one.
    ``mix_*`` columns of ``docs`` are replaced; the others pass through.

    Only the block in which a source's budget ends is ordered row by row; all
    other rows are decided by their source's row of the weights, so neither
    texts nor a hot source are shuffled.
    """
    names = {x: f"{prefix}{x}" for x in ("source", "tokens", "weight", "epochs", "rest", "block", "key", "epoch")}
    end, used = fresh(docs, "_end", "_used")
    c = lambda x: F.col(names[x])
    out = docs.select([x for x in docs.columns if x not in names.values()]).withColumns({
        names["source"]: F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")),
        names["tokens"]: token_count(text_col),
    })
    sources = written(out.groupBy(c("source").alias("s")).agg(F.sum(c("tokens")).alias("tokens")).filter("tokens > 0"), "mix-sources")
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return out.limit(0).select(*docs.columns, *(F.lit(0).alias(names[x]) for x in ("tokens", "weight", "epoch", "block", "key")))
    budget = float(total) * times if budget is None else float(budget)
    power = find_exponent(sources, budget, target_entropy, max_repeats)
    raised = F.pow(F.col("tokens") / F.lit(total), F.lit(power))
    norm = sources.agg(F.sum(raised)).first()[0]
    share = F.lit(budget) * raised / F.lit(norm)
    weights = sources.select(
        F.col("s").alias(names["source"]), (raised / F.lit(norm)).alias(names["weight"]),
        F.floor(share / F.col("tokens")).alias(names["epochs"]), F.floor(share - F.floor(share / F.col("tokens")) * F.col("tokens")).alias(names["rest"]),
    )
    # the block of its last permutation in which each source's budget ends, and what is left for it
    narrow = out.select(names["source"], names["tokens"], id_col).join(weights, names["source"])
    sums = _placed(narrow, c("epochs"), id_col, seed, blocks, names).groupBy(c("source"), c("block")).agg(F.sum(c("tokens")).alias("n"), F.first(c("rest")).alias("rest"))
    before = F.sum("n").over(Window.partitionBy(names["source"]).orderBy(names["block"])) - F.col("n")
    ends = sums.withColumn("before", before).filter("before + n >= rest").groupBy(names["source"])
    ends = ends.agg(F.min(F.struct(names["block"], (F.col("rest") - F.col("before")).alias("left"))).alias(end))
    weights = written(weights.join(ends, names["source"]), "mix-weights")
    # whole permutations and the blocks before the end are decided row by row; the last block is walked in order
    times = out.join(weights, names["source"]).withColumn(names["epoch"], F.explode(F.sequence(F.lit(0).cast("long"), c("epochs"))))
    times = _placed(times, c("epoch"), id_col, seed, blocks, names)
    at, last = c("block"), c("epoch") == c("epochs")
    sure = times.filter(~last | (at < F.col(f"{end}.{names['block']}")))
    order = Window.partitionBy(names["source"]).orderBy(names["key"], id_col, F.xxhash64(text_col)).rowsBetween(Window.unboundedPreceding, -1)
    some = times.filter(last & (at == F.col(f"{end}.{names['block']}"))).withColumn(used, F.coalesce(F.sum(c("tokens")).over(order), F.lit(0)))
    keep = [*(x for x in docs.columns if x not in names.values()), *(names[x] for x in ("tokens", "weight", "epoch", "block", "key"))]
    return union(sure.select(keep), some.filter(F.col(used) < F.col(f"{end}.left")).select(keep))


def _placed(df: DataFrame, epoch: Column, id_col: str, seed: str, blocks: int, names: dict) -> DataFrame:
    h = F.xxhash64(F.lit(seed), epoch, F.col(id_col).cast("string"))
    return df.withColumns({names["block"]: F.pmod(h, F.lit(blocks)).cast("int"), names["key"]: F.xxhash64(h)})


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each time that a nearly even mix of all sources, of TIMES their tokens, holds a document.

    A null source is one of its own; rows with null or empty texts come with
    their source's permutations; see ``mix_sources``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, times=TIMES, target_entropy=QUERY_ENTROPY).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_key")
