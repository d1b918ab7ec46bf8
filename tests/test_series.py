"""Series in segments beside plain loops: any cut gives the same numbers."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_windows import filled, plain_clean
from tidemark.operators import joins as J
from tidemark.operators import series as S
from tidemark.operators import windows as W

#: A series of more rows is cut; None leaves the default, where all here are whole.
CUTS = [S.LONG, 30]


def many(spark, seed=7, n=400, gaps=0.3):
    """One long series among short ones, with ties in the first order column; keys may be null."""
    r = random.Random(seed)
    rows = [(None if s == 3 else s, k // 3, k, None if r.random() < gaps else r.choice([r.uniform(-5, 5), 2.0])) for s in range(5) for k in range(n if s in (1, 3) else r.randint(1, 20))]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "s int, t int, k int, x double"), rows


def by_key(rows):
    out = {}
    for s, _, k, x in sorted(rows, key=lambda r: r[2]):
        out.setdefault(s, []).append((k, x))
    return out


def answers(df, name):
    return {(r.s, r.k): r[name] for r in df.collect()}


@pytest.mark.parametrize("long", CUTS)
def test_fill_and_smooth(spark, long):
    df, rows = many(spark)
    fill, smooth = answers(W.fill_gaps(df, ["s"], ["t", "k"], "x", "y", long=long), "y"), answers(W.fill_smooth(df, ["s"], ["t", "k"], "x", 7, "y", long), "y")
    for s, xs in by_key(rows).items():
        f = filled([x for _, x in xs])
        pad = np.concatenate(([f[0]] * 3, f, [f[-1]] * 3))
        assert [fill[s, k] for k, _ in xs] == pytest.approx(list(f))
        assert [smooth[s, k] for k, _ in xs] == pytest.approx([pad[i : i + 7].mean() for i in range(len(f))])


@pytest.mark.parametrize("long", CUTS)
def test_followers(spark, long):
    df, rows = many(spark)
    slew, clock = answers(W.slew_follow(df, ["s"], ["t", "k"], "x", 1.5, "y", long), "y"), answers(W.monotonic_clock(df, ["s"], ["t", "k"], "x", "y", 0.25, long), "y")
    for s, xs in by_key(rows).items():
        y = c = None
        for k, v in xs:
            if v is not None:
                y = v if y is None else y + min(max(v - y, -1.5), 1.5)
                c = v if c is None else v + max(math.ceil(c - 0.25 - v), 0)
            assert slew[s, k] == (None if y is None else pytest.approx(y)) and clock[s, k] == (None if c is None else pytest.approx(c))


@pytest.mark.parametrize("long", CUTS)
@pytest.mark.parametrize("on, off", [(3, 2), (6, 9)])
def test_clean_runs(spark, long, on, off):
    df, rows = many(spark, gaps=0.0)
    got = answers(W.clean_runs(df, ["s"], ["t", "k"], F.col("x") < 1.0, on, off, "c", long), "c")
    for s, xs in by_key(rows).items():
        assert [int(got[s, k]) for k, _ in xs] == plain_clean([int(x < 1.0) for _, x in xs], on, off)


@pytest.mark.parametrize("long", CUTS)
def test_time_joins(spark, long):
    r = random.Random(4)
    left = [(g, k, r.choice([r.uniform(0, 50), float(r.randint(0, 50))])) for k in range(300) for g in [r.choice([1, 1, 1, 2, None, 9])]]
    right = [(g, 1000 + k, r.choice([r.uniform(0, 50), float(r.randint(0, 50))])) for k in range(200) for g in [r.choice([1, 1, 1, 2, None])]]
    a, b = spark.createDataFrame(left, "g int, i int, t double"), spark.createDataFrame(right, "g int, j int, t double")
    near = {x.i: (x.near_t, x.near_j) for x in J.nearest_in_time(a, b, ["g"], "t", "t", ["j"], long=long).collect()}
    line = {x.i: x.y for x in J.interpolate_at(a, b, ["g"], "t", "t", "j", "y", long).collect()}
    for g, i, t in left:
        mine = sorted((abs(u - t), u, j) for h, j, u in right if h == g)
        assert near[i] == ((mine[0][1], mine[0][2]) if mine else (None, None))
        times = sorted({u for h, _, u in right if h == g})
        assert line[i] == (pytest.approx(np.interp(t, times, [np.mean([j for h, j, u in right if h == g and u == v]) for v in times])) if times else None)


@pytest.mark.parametrize("rule", [S.Slew(0.7), S.Clock(0.25)])
def test_a_segment_is_a_function(rule):
    """What a segment's few numbers do to any number that comes in is what its readings do one after the other."""
    r = random.Random(2)
    for n in (1, 2, 3, 8, 60):
        for spread in (0.5, 3.0, 20.0):
            xs = [r.uniform(-spread, spread) for _ in range(n)]
            line = rule.summary()
            for v in xs:
                line.add(v)
            for y in [r.uniform(-30, 30) for _ in range(60)] + xs:
                want = y
                for v in xs:
                    want = rule.step(want, v)
                assert rule.through(line.numbers(), y) == pytest.approx(want, abs=1e-9)


def test_a_million_rows_in_one_key(spark):
    """Time joins and followers are linear: one series of a million rows takes seconds, whole or in segments."""
    n = 1_000_000
    one = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") * 1.0).alias("t"), F.when(F.col("id") % 7 == 0, F.sin(F.col("id") / 1000)).alias("x"))
    for long in (S.LONG, 100_000):
        began = time.time()
        got = J.interpolate_at(one.where("k % 2 = 1").select("g", "k", "t"), one.where("k % 2 = 0"), ["g"], "t", "t", "x", "y", long).agg(F.count("y").alias("n"), F.max(F.abs(F.col("y") - F.sin(F.col("t") / 1000))).alias("e")).first()
        assert got.n == n // 2 and got.e < 1e-2
        fill = W.fill_smooth(one, ["g"], ["t"], "x", 7, "y", long).agg(F.max(F.abs(F.col("y") - F.sin(F.col("t") / 1000))).alias("e")).first()
        assert fill.e < 1e-1
        assert time.time() - began < 60
