"""Whitening against numpy on whole numbers, and on odd vectors."""

import math

import numpy as np
import pytest

from siltstone.llm.whitening import whitened_components

SF = "/root/testdata/sf0.01"


def brute(vectors, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n = len(x)
    s = x.sum(0)
    centred = n * x - s
    deviation = [int(sum(c * c for c in row)) for row in centred]
    y = centred.astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, len(e))
    return n, deviation, y @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def by_row(rows):
    """vec_id -> (deviation, whitened by component)"""
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], (r["deviation"], {}))[1][r["component"]] = r["whitened"]
    return out


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = df.select("vec_id", "embedding").collect()
    n, deviation, want, explained = brute([r["embedding"] for r in given])
    rows = whitened_components(df).collect()
    assert len(rows) == 32 * len(given) and {r["n"] for r in rows} == {n}
    assert {type(r["n"]) for r in rows} == {int} and max(r["identity_error"] for r in rows) < 1e-9
    got = by_row(rows)
    sign = np.sign([want[0][k] * got[given[0]["vec_id"]][1][k + 1] for k in range(32)])
    for i, r in enumerate(given):
        d, w = got[r["vec_id"]]
        assert d == deviation[i]
        assert np.allclose([w[k + 1] for k in range(32)], want[i] * sign, atol=1e-8)
    assert np.allclose([next(r["explained"] for r in rows if r["component"] == k + 1) for k in range(32)], explained, rtol=1e-9)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=5)], "e") for i in range(40)]
    good += [(None, [1.0, 2.0, 3.0, 4.0, 5.0], "n"), (7, good[7][1], "again"), (2**60 + 1, [9.0, -3.0, 0.5, 0.25, 1e9], "large")]
    odd = [(100, None, "x"), (101, [1.0, None, 2.0, 3.0, 4.0], "x"), (102, [math.nan] * 5, "x"), (103, [math.inf, 0.0, 0.0, 0.0, 0.0], "x"), (104, [], "x"), (105, [1.0, 2.0], "x"), (None, None, "x")]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, whitened string")
    rows = whitened_components(df).collect()
    assert rows[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert len(rows) == len(good) * 5 and {r["n"] for r in rows} == {len(good)}
    n, deviation, _, _ = brute([v for _, v, _ in good])
    want = sorted(((i, d if d < 2**63 else None) for (i, _, _), d in zip(good, deviation, strict=True)), key=str)
    assert sorted(((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1), key=str) == want


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    rows = whitened_components(df).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in rows] == [(0.0, 0.0, 0)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    first = [r for r in whitened_components(line).collect() if r["component"] == 1]
    assert abs(sum(r["whitened"] ** 2 for r in first) / 9 - 1) < 1e-9 and abs(first[0]["explained"] - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = whitened_components(df)
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
