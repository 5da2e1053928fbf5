"""Whitening of embeddings by principal components.

Entries become whole numbers first, so that sums are exact and rows can be
centred before anything is multiplied. Spark MLlib's RowMatrix gives the Gram
matrix of the centred rows, which has a row and a column a dimension; its
eigenvectors are found on the driver and sent to all tasks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, python_ready, table, written

#: Fixed values of the whole numbers that stand for entries: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: A component with less than this part of the largest one's variance has none: rounding alone gives as much.
LEAST_VARIANCE = 1e-13


class Whitening(NamedTuple):
    """n vectors with the given sums; components in columns, by falling variance; each one's variance and its part of all."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def finite(vector: Column) -> Column:
    """Whether there's a vector, and neither nulls nor infinite entries nor NaNs in it."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda c: F.coalesce(good(c), F.lit(False))), F.lit(False))


def on_lattice(vector: Column, n: int, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Entries as whole numbers; those of which n don't fit a long are moved to the largest that do."""
    most = float(2**62 // max(n, 1) - 2 * shift)
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(scale * c, F.lit(-most)), F.lit(most))).cast("long") + shift)


def usual_length(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """The most frequent length of a vector, of equally frequent ones the larger, and how many have it; zeros without vectors."""
    top = df.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return (max(0, top[0][0]), top[0][1]) if top else (0, 0)


def _centred(x_col: str, n: int, sums: np.ndarray) -> Column:
    """n times a vector less the sums, which is whole and exact, over n."""
    return F.zip_with(x_col, F.lit(sums.tolist()).cast("array<long>"), lambda x, s: (x * n - s).cast("double") / F.lit(float(n)))


def covariance(rows: DataFrame, centred: Column, n: int, d: int) -> np.ndarray:
    """Of rows that are centred already, with divisor n; d x d numbers come to the driver, whatever the rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray() / n


def fit_whitening(df: DataFrame, x_col: str, components: int = COMPONENTS) -> Whitening | None:
    """Of vectors of whole numbers, all of one length; None without vectors or dimensions."""
    d, n = usual_length(df, x_col)
    if not d:
        return None
    sums = np.zeros(d, np.int64)
    for i, total in df.select(F.posexplode(x_col).alias("i", "x")).groupBy("i").agg(F.sum("x")).collect():  # one row a dimension
        sums[i] = total
    found, vectors = np.linalg.eigh(covariance(df, _centred(x_col, n, sums), n, d))
    found, vectors = np.maximum(found[::-1], 0.0), vectors[:, ::-1]
    k, trace = min(components, d), found.sum()
    return Whitening(n, sums, vectors[:, :k].copy(), found[:k], found[:k] / trace if trace > 0 else np.zeros(k))


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exactly; None if one doesn't fit a long."""
    most = int(np.abs(centred).max(initial=0))
    if most * most * centred.shape[1] < 2**63:
        return (centred * centred).sum(1).tolist()
    exact = [sum(int(x) ** 2 for x in row) for row in centred]
    return [x if x < 2**63 else None for x in exact]


def whiten(df: DataFrame, model: Whitening, x_col: str, keys: list[str]) -> DataFrame:
    """(keys, deviation, whitened) for each row: n² times its squared distance from the mean, and its place on each component, over the component's deviation.

    ``x_col`` holds vectors of whole numbers of the model's length. A component
    without variance gives 0. Keys pass through, nulls and repeats too.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = sent.value
        some = m.variances > LEAST_VARIANCE * m.variances.max(initial=0)
        onto = np.where(some, m.vectors / np.sqrt(np.where(some, m.variances, 1.0)), 0.0)
        for f in frames:
            x = np.stack(f[x_col].to_numpy()).astype(np.int64) if len(f) else np.empty((0, len(m.sums)), np.int64)
            centred = x * m.n - m.sums
            yield pd.DataFrame({k: f[k] for k in keys} | {"deviation": pd.Series(_deviations(centred), f.index, dtype="Int64"), "whitened": pd.Series(list((centred / m.n) @ onto), f.index, dtype=object)})

    python_ready(df.sparkSession)
    kinds = [df.schema[k] for k in keys]
    return df.select(*keys, x_col).mapInPandas(run, T.StructType([*kinds, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))


def identity_error(rows: DataFrame, k: int, vec_col: str = "whitened") -> float:
    """The largest entry, without its sign, of the whitened rows' own covariance less the identity."""
    n = rows.count()
    means = [m for _, m in sorted(rows.select(F.posexplode(vec_col).alias("i", "w")).groupBy("i").agg(F.avg("w")).collect())]
    centred = F.zip_with(vec_col, F.lit(means).cast("array<double>"), lambda w, m: w - m)
    return float(np.abs(covariance(rows, centred, n, k) - np.eye(k)).max())


def whitened_components(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null or hold nulls, NaNs or infinite entries are left
    out, and so are empty ones and those of another length than the most
    frequent, which can't lie in one space with the rest (of equally frequent
    lengths the larger counts). Ids may be null or repeat: each row counts and
    comes back. Without any vector there are no rows. Equal vectors alone have
    no variance: all components are 0 then, and explain 0. Entries so large
    that n of them don't fit a long count as the largest that do, and
    ``deviation`` is null where it doesn't fit one. Other columns aren't read.
    """
    key, x = fresh(df.select(id_col), "_key", "_x")
    whole = df.filter(finite(F.col(vec_col)))
    d, n = usual_length(whole, vec_col)
    rows = whole.filter(F.size(vec_col) == d).select(F.col(id_col).alias(key), on_lattice(F.col(vec_col), n).alias(x))
    model = fit_whitening(rows, x, components)
    if model is None:
        return df.limit(0).select(id_col, F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    out = written(whiten(rows, model, x, [key]), "whitened")
    error = identity_error(out, len(model.variances))
    each = out.select(F.col(key).alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.lit(model.explained.tolist()).cast("array<double>")
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each whole vector of ``embeddings`` and component up to 32; see ``whitened_components`` for odd vectors."""
    return whitened_components(table(spark, sf_dir, "embeddings"))
