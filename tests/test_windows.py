"""Series operators against NumPy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import windows as W

BY, ORDER = ["s"], ["k"]
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def series(spark, *values):
    return spark.createDataFrame([(s, k, None if v is None else float(v)) for s, xs in enumerate(values) for k, v in enumerate(xs)], "s int, k int, x double")


def column(df, name, s=0):
    return [r[name] for r in df.where(F.col("s") == s).orderBy("k").collect()]


def gappy(seed, n=40):
    r = random.Random(seed)
    x = [r.uniform(-5, 5) for _ in range(n)]
    for k in (0, 1, 10, 11, 12, n - 1):
        x[k] = None
    return x


def filled(x):
    k = [i for i, v in enumerate(x) if v is not None]
    return np.interp(range(len(x)), k, [x[i] for i in k]) if k else np.zeros(len(x))


def test_fill_and_smooth(spark):
    xs = [gappy(1), [None] * 9, [1.0], [float("nan"), 2.0, None, 4.0]]
    df = series(spark, *xs)
    for s, x in enumerate(xs):
        x = [None if v is not None and math.isnan(v) else v for v in x]
        f = filled(x)
        assert column(W.fill_gaps(df, BY, ORDER, "x", "f"), "f", s) == pytest.approx(list(f))
        pad = np.concatenate(([f[0]] * 3, f, [f[-1]] * 3))
        assert column(W.fill_smooth(df, BY, ORDER, "x", 7, "y"), "y", s) == pytest.approx([pad[i : i + 7].mean() for i in range(len(f))])


@FEW
@given(st.floats(-100, 100), st.integers(1, 20))
def test_smoothing_a_constant_changes_nothing(spark, c, n):
    assert column(W.fill_smooth(series(spark, [c] * n), BY, ORDER, "x", 7, "y"), "y") == pytest.approx([c] * n, abs=1e-9)


def test_convolution_and_differences(spark):
    x = [random.Random(2).uniform(0, 9) for _ in range(30)]
    df = series(spark, x)
    got = column(W.same_convolution(df, BY, ORDER, "x", 12, "y"), "y")
    assert got == pytest.approx(list(np.convolve(x, np.ones(12) / 12, "same")))
    assert column(W.first_difference(df, BY, ORDER, "x", "d"), "d")[1:] == pytest.approx(list(np.diff(x)))
    assert column(W.second_difference(df, BY, ORDER, "x", "d"), "d")[1:-1] == pytest.approx(list(np.diff(x, 2)))


def plain_runs(flags):
    out, k = [], 0
    while k < len(flags):
        j = k
        while j < len(flags) and flags[j] == flags[k]:
            j += 1
        out.append([flags[k], k, j])
        k = j
    return out


def plain_clean(flags, on, off):
    f = list(flags)
    for value, least in ((0, off), (1, on)):
        runs = plain_runs(f)
        for v, a, b in runs[1:-1]:
            if v == value and b - a < least:
                f[a:b] = [1 - value] * (b - a)
    return f


def test_intervals_and_clean_runs(spark):
    texts = ["1101111100000011011111", "0000", "1", "101010101", "0110111000111111011"]
    df = series(spark, *[[int(c) for c in t] for t in texts])
    got = W.clean_runs(df, BY, ORDER, F.col("x") == 1, 5, 5, "c")
    for s, t in enumerate(texts):
        assert [int(v) for v in column(got, "c", s)] == plain_clean([int(c) for c in t], 5, 5)
        runs = sorted((r.start, r.end, r.n) for r in W.flag_intervals(df, BY, ORDER, F.col("x") == 1).where(F.col("s") == s).collect())
        assert runs == [(a, b - 1, b - a) for v, a, b in plain_runs([int(c) for c in t]) if v]


@FEW
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=25))
def test_slew_never_exceeds(spark, x):
    y = column(W.slew_follow(series(spark, x), BY, ORDER, "x", 2.5, "y"), "y")
    want = [x[0]]
    for v in x[1:]:
        want.append(want[-1] + min(max(v - want[-1], -2.5), 2.5))
    assert y == pytest.approx(want)
    assert all(abs(b - a) <= 2.5 + 1e-9 for a, b in zip(y, y[1:]))


def test_clock(spark):
    x = [10.0, 10.9, 10.2, 11.0, 9.5, 9.6]
    want = [x[0]]
    for v in x[1:]:
        while v < want[-1] - 0.5:
            v += 1
        want.append(v)
    assert column(W.monotonic_clock(series(spark, x), BY, ORDER, "x", "y"), "y") == pytest.approx(want)


def test_filters(spark):
    x = [random.Random(3).uniform(0, 9) for _ in range(25)]
    df = series(spark, x, [4.0])
    pad = [x[0]] * 2 + x + [x[-1]] * 2
    assert column(W.median_filter(df, BY, ORDER, "x", 5, "m"), "m") == pytest.approx([float(np.median(pad[i : i + 5])) for i in range(25)])
    r = 8
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / 2.0) ** 2)
    g /= g.sum()
    for edge, mode in (("reflect", "symmetric"), ("nearest", "edge")):
        p = np.pad(x, r, mode=mode)
        assert column(W.gaussian_smooth(df, BY, ORDER, "x", 2.0, "g", edge), "g") == pytest.approx([float((p[i : i + 2 * r + 1] * g).sum()) for i in range(25)])
    assert column(W.gaussian_smooth(df, BY, ORDER, "x", 2.0, "g"), "g", 1) == pytest.approx([4.0])


def test_paths(spark):
    p = np.cumsum(np.random.default_rng(4).normal(size=(12, 2)), axis=0)
    df = spark.createDataFrame([(0, k, float(a), float(b)) for k, (a, b) in enumerate(p)], "s int, k int, a double, b double")
    s = np.append(0, np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1)))
    t = np.linspace(0, s[-1], 9)
    got = W.resample_path(df, BY, ORDER, ["a", "b"], 9).orderBy("i").collect()
    assert [r.a for r in got] == pytest.approx(list(np.interp(t, s, p[:, 0])))
    assert [r.b for r in got] == pytest.approx(list(np.interp(t, s, p[:, 1])))
    rows = W.resample_rows(df, BY, ORDER, "a", 7).orderBy("i").collect()
    assert [r.a for r in rows] == pytest.approx(list(np.interp(np.linspace(0, 11, 7), range(12), p[:, 0])))
    far_a = np.linalg.norm(p - p[0], axis=1) > 0.8
    far_b = np.linalg.norm(p - p[-1], axis=1) > 0.8
    lo, hi = int(np.argmax(far_a)), int(np.flatnonzero(far_b)[-1]) + 1
    assert sorted(r.k for r in W.trim_still(df, BY, ORDER, ["a", "b"], 0.8).collect()) == list(range(lo, hi + 1))


def test_carry_alive_first_running(spark):
    df = series(spark, [None, 1, None, 3, 0, 5])
    assert column(W.carry_forward(df, BY, ORDER, "x", "c"), "c") == [None, 1, 1, 3, 0, 5]
    assert column(W.still_alive(df, BY, ORDER, F.coalesce("x", F.lit(1.0)) > 0, "a"), "a") == [True] * 4 + [False] * 2
    assert column(W.first_n(df, BY, ORDER, 2), "k") == [0, 1]
    assert column(W.running_from_start(df, BY, ORDER, "x", "r"), "r") == [0, 1, 1, 4, 4, 9]


def test_withdrawn(spark):
    seen = [1] * 8 + [0] * 3 + [1] * 6 + [0] * 7 + [1] * 9 + [0] * 2
    gone = np.zeros(len(seen))
    for v, a, b in plain_runs(seen):
        if not v and (b - a > 5 or a == 0 or b == len(seen)):
            gone[a:b] = 1
    want = np.clip(np.convolve(gone, np.ones(12) / 12, "same") * 1.6, 0, 1)
    assert column(W.withdrawn(series(spark, seen), BY, ORDER, F.col("x") == 1, "w"), "w") == pytest.approx(list(want))
