"""Exact quantiles by rounds of narrowing, whatever the distribution."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A

WANTED = {"q0": 0.0, "p1": 0.01, "median": 0.5, "p99": 0.99, "q1": 1.0}


def groups(seed=5, n=6000):
    r = np.random.default_rng(seed)
    return {
        "even": r.uniform(-1, 1, n), "wild": np.exp(r.normal(0, 60, n)) * r.choice([-1, 1], n), "ties": r.integers(0, 4, n) * 1.0, "one": np.full(n, 7.5),
        "steps": np.sort(r.normal(size=n)).round(2), "small": r.normal(size=9), "single": np.array([3.0]), "none": np.array([np.nan, np.inf]), None: r.normal(100, 1e-9, n),
    }


@pytest.mark.parametrize("few", [20, 500, 10**6])
def test_groups_of_any_shape(spark, few):
    data = groups()
    rows = [(g, None if np.isnan(x) else float(x)) for g, xs in data.items() for x in xs] + [("none", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in A.quantiles(df, ["g"], F.col("x"), WANTED, few=few, small=0).collect()}
    assert set(got) == set(data) | {"empty"}
    for g, row in got.items():
        xs = [x for x in data.get(g, []) if np.isfinite(x)]
        for name, q in WANTED.items():
            assert row[name] == (pytest.approx(np.quantile(xs, q), rel=1e-12) if xs else None), (g, name)


def test_whole_table(spark):
    xs = np.random.default_rng(1).standard_cauchy(20_000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for few, small in ((50, 0), (10**6, 0), (50, 10**12)):
        row = A.quantiles(df, [], F.col("x"), WANTED, few=few, small=small).first()
        assert [row[n] for n in WANTED] == pytest.approx([np.quantile(xs, q) for q in WANTED.values()], rel=1e-12)
    assert A.quantiles(df.limit(0), [], F.col("x"), {"m": 0.5}, small=0).first().m is None


def plain_fuse(xs, k, least):
    s = np.array([x for x in xs if x is not None and np.isfinite(x)])
    for _ in range(2):
        m = np.median(s)
        s = s[np.abs(s - m) <= max(k * 1.4826 * np.median(np.abs(s - m)), least)]
    return np.median(s), len(s)


@pytest.mark.parametrize("few", [10, 10_000])
def test_fuse(spark, few):
    r = np.random.default_rng(3)
    data = {g: np.concatenate((r.normal(size=n), r.normal(0, 50, n // 4))) for g, n in ((1, 400), (2, 5), (3, 1), (4, 90))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [(1, None), (9, None)], "g int, x double")
    got = {row.g: row for row in A.robust_fuse(df, ["g"], "x", 2.5, 0.01, few=few).collect()}
    assert set(got) == set(data)
    for g, xs in data.items():
        value, n = plain_fuse(xs, 2.5, 0.01)
        assert (got[g].value, got[g].n, got[g].n_all) == (pytest.approx(value), n, len(xs))


def test_mean_or_median_of_larger_tables(spark, monkeypatch):
    """of tables that are not small, metrics that ask for a median alone are ordered, and few numbers are counted by number."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), (F.col("id") * 7919 % 30_000 / 10).alias("value"), (F.col("id") % 24).cast("double").alias("max_hour"), F.when(F.col("id") % 5 > 0, F.sqrt(F.col("id"))).alias("depth"))
    long = df.unpivot(["g"], ["value", "max_hour", "depth"], "metric", "v")
    whole = {(r.g, r.metric): (r.value, r.n) for r in A.mean_or_median(long, ["g"], "metric", "v").collect()}
    monkeypatch.setattr(A, "SMALL_BYTES", 0)
    monkeypatch.setattr(A, "FEW", 1000)
    ordered, plain = [], A.quantiles
    monkeypatch.setattr(A, "quantiles", lambda rows, *a, **k: (ordered.append(rows), plain(rows, *a, **k))[1])
    got = {(r.g, r.metric): (r.value, r.n) for r in A.mean_or_median(long, ["g"], "metric", "v").collect()}
    assert set(got) == set(whole) and len(got) == 6 and all(got[k] == pytest.approx(whole[k]) for k in got)
    assert len(ordered) == 1 and {tuple(r[0]) for r in ordered[0].select("__key").distinct().collect()} == {("a", "depth"), (None, "depth")}
