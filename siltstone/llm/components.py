"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union
from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is the smallest id that links reach.

    In each round every vertex moves to the neighbour with the smallest hash,
    if that is below its own, and the edges follow. Hashes make long chains
    shrink by a constant part a round, so the rounds grow with the logarithm of
    the vertices; every round's table is written to the shared folder. A
    vertex with many neighbours costs no more than they: minima are taken
    before the shuffle.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    moves = []
    while edges.head(1):
        both = union(edges, edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        to = F.when(F.col("m.h") < F.xxhash64("id"), F.col("m.to")).otherwise(F.col("id"))
        move = written(near.select("id", to.alias("to")), "moves")
        moves.append(move)
        ends = edges.join(move.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    at = moves[0]
    for move in moves[1:]:
        at = at.join(move.select(F.col("id").alias("to"), F.col("to").alias("further")), "to", "left").select("id", F.coalesce("further", "to").alias("to"))
    at = written(at, "contracted")
    least = at.groupBy("to").agg(F.min("id").alias("component"))
    return at.join(least, "to").select("id", "component")
