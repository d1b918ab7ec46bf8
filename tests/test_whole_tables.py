"""Operators over whole tables, beside plain loops over the same rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect
from tidemark.operators import aggregates as A
from tidemark.operators import experiments as X
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.plans import geometry_catalog as catalog
from tidemark.plans.catalog import _iou_pairs


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def run(spark, sf, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def vectors(con):
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64)


@pytest.fixture(scope="module")
def nearest(vectors):
    """Positions of the four nearest others of each vector, ties by id, and squared distances."""
    ids, x, _ = vectors
    d2 = np.stack([((x - v) ** 2).sum(1) for v in x])
    np.fill_diagonal(d2, np.inf)
    at = np.stack([np.lexsort((ids, row))[:4] for row in d2])
    return at, np.take_along_axis(d2, at, 1)


def test_neighbours_of_every_vector(spark, sf, vectors, nearest):
    ids, _, label = vectors
    at, d2 = nearest
    got = {i: (j, d) for i, j, d in run(spark, sf, "nn_embeddings")}
    assert set(got) == set(ids.tolist())
    assert all(got[i][0] == ids[a[0]] and got[i][1] == pytest.approx(d[0], abs=2e-6) for i, a, d in zip(ids.tolist(), at, d2))
    w = 1 / (np.sqrt(d2) + 1e-4)
    want = (w * label[at]).sum(1) / w.sum(1)
    mean = dict(run(spark, sf, "idw_knn4"))
    assert set(mean) == set(ids.tolist()) and all(mean[i] == pytest.approx(v, abs=2e-5) for i, v in zip(ids.tolist(), want))
    clear = np.sqrt(d2[:, 0]) < 0.97 * np.sqrt(d2[:, 1])
    assert set(run(spark, sf, "ratio_test")) == set(zip(ids[clear].tolist(), ids[at[clear, 0]].tolist()))


def test_set_iou_of_every_pair(spark, sf, con):
    sets = defaultdict(set)
    for s, p in con.execute("SELECT l_suppkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey").fetchall():
        sets[s].add(p)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(a, b): v for a, b, v in run(spark, sf, "set_iou_pairs")}
    assert got == pytest.approx(want)


def test_points_in_every_triangle(spark, sf, vectors):
    ids, x, _ = vectors
    at = {i: v[:3] for i, v in zip(ids.tolist(), x)}
    want = {}
    for t in at:
        if t + 1 in at and t + 2 in at:
            (ax, ay, az), (bx, by, bz), (cx, cy, cz) = at[t], at[t + 1], at[t + 2]
            det = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
            if det:
                w1 = ((x[:, 0] - ax) * (cy - ay) - (cx - ax) * (x[:, 1] - ay)) / det
                w2 = ((bx - ax) * (x[:, 1] - ay) - (x[:, 0] - ax) * (by - ay)) / det
                for i in ids[(1 - w1 - w2 >= -1e-6) & (w1 >= -1e-6) & (w2 >= -1e-6)].tolist():
                    want[i] = min(want.get(i, (np.inf, 0)), ((az + bz + cz) / 3, t))
    assert {r[0]: r[1] for r in run(spark, sf, "point_in_triangle")} == {i: t for i, (_, t) in want.items()}


def test_bilinear_lookup_of_every_order(spark, sf, con):
    img = {(u, v): z for u, v, z in con.execute("SELECT s_nationkey, s_suppkey % 10, avg(s_acctbal) FROM supplier GROUP BY 1, 2").fetchall()}
    want = {}
    for key, total, cust in con.execute("SELECT o_orderkey, o_totalprice, o_custkey FROM orders").fetchall():
        x, y = min(max(float(total) % 30 - 2, 0), 24), min(max(cust % 120 / 10 - 1, 0), 9)
        for dx in (0, 1):
            for dy in (0, 1):
                c = min(math.floor(x) + dx, 24), min(math.floor(y) + dy, 9)
                if c in img:
                    w = (x % 1 if dx else 1 - x % 1) * (y % 1 if dy else 1 - y % 1)
                    want[key] = want.get(key, 0.0) + w * float(img[c])
    assert dict(run(spark, sf, "bilinear_lookup")) == pytest.approx(want, abs=1e-5)


def test_series_are_followed_to_their_end(spark, sf, con):
    follow, clock, last = {}, {}, {}
    for user, event, value, s in con.execute("SELECT user_id, event_id, value, second(ts)::DOUBLE FROM events ORDER BY user_id, ts, event_id").fetchall():
        y, c = last.get(user, (value, s))
        y, c = y + min(max(value - y, -5), 5), s + max(math.ceil(c - 0.5 - s), 0)
        follow[event], clock[event], last[user] = y, c, (y, c)
    assert dict(run(spark, sf, "slew_follow")) == pytest.approx(follow)
    assert dict(run(spark, sf, "clock_repair")) == pytest.approx(clock)


def test_neighbours_in_small_blocks(spark):
    """Hot points (one third alike), several levels, blocks and batches, a tree that is full, fewer points than asked for, ties by id."""
    r = np.random.default_rng(5)
    x = np.concatenate([np.repeat(r.normal(size=(1, 5)), 60, 0), r.normal(size=(120, 5)), r.integers(0, 2, (30, 5)).astype(float)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "id long, vec array<double>")
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    for k, fan_out, block, nodes in ((3, 8, 7, 100), (70, 3, 50, 20), (1, 64, 20_000, 16_384)):
        got = J.neighbours(df, df, "id", "id", "vec", k, fan_out=fan_out, block=block, nodes=nodes).collect()
        want = {(i, int(j), n + 1) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), d2[i]))[:k])}
        assert {(r.id, r.near_id, r.rank) for r in got} == want and len(got) == len(want)
    few = J.neighbours(df.where("id < 3"), df.where("id < 4"), "id", "id", "vec", 10).collect()
    assert len(few) == 9 and J.neighbours(df.limit(0), df, "id", "id", "vec", 2).count() == 0 and J.neighbours(df, df.limit(0), "id", "id", "vec", 2).count() == 0


def test_clustered_points_meet_few_leaves(spark):
    """Work follows the clusters: a query of 40 clusters in 16 dimensions meets few of the leaves."""
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(40, 16)), 50, 0) + 0.02 * r.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    work = {}
    got = J.neighbours(df, df, "id", "id", "vec", 2, fan_out=16, block=60, work=work).collect()
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    assert {(q.id, q.near_id) for q in got} == {(i, int(j)) for i in range(len(x)) for j in np.argsort(d2[i])[:2]}
    assert work["blocks"] >= 30 and work["visits"] < 0.15 * work["queries"] * work["blocks"]


def test_radius_join_splits_full_cells(spark):
    r = np.random.default_rng(6)
    p = np.concatenate([np.repeat(r.normal(size=(1, 2)), 50, 0), r.normal(size=(80, 2))])
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(p)], "id long, x double, y double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    got = {(a.id, a.near_id) for a in J.radius_join(df, df, "id", "id", "xy", 0.3, block=9).collect()}
    assert got == set(zip(*map(list, (x.tolist() for x in np.nonzero(d < 0.3)))))
    far = {a.id: a.near_id for a in J.nearest_point(df.where("id >= 60"), df.where("id < 60"), "id", "id", "xy", 0.05).collect()}
    assert far == {i: int(d[i, :60].argmin()) for i in range(60, len(p))}


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles_are_exact(spark, monkeypatch, by):
    monkeypatch.setattr(A, "ACCURACY", 50)  # wide brackets and many ties
    r = np.random.default_rng(7)
    rows = [(int(r.integers(3)) if k % 9 else None, "ab"[k % 2], float(v) if k % 13 else (None if k % 2 else float("nan"))) for k, v in enumerate(np.round(r.normal(size=4000), 2))]
    df = spark.createDataFrame(rows + [(7, "a", None), (8, "a", 5.0)], "g int, h string, x double")
    wanted = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {tuple(x[c] for c in by): [x[n] for n in wanted] for x in A.quantiles(df, by, F.col("x"), wanted).collect()}
    groups = defaultdict(list)
    for g, h, v in rows + [(7, "a", None), (8, "a", 5.0)]:
        key = tuple({"g": g, "h": h}[c] for c in by)
        groups[key] += [v] if v is not None and not math.isnan(v) else []
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        assert got[key] == (pytest.approx(np.quantile(values, list(wanted.values())).tolist()) if values else [None] * 5)


def test_leaderboard_over_everything(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 13)) for i in range(200)] + [(900, None)], "i long, s double").repartition(7)
    got = [r.i for r in X.leaderboard(df, "s", ["i"]).orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (-(i * 7 % 13), i)) + [900]


@pytest.mark.parametrize("edge,n", [("reflect", 1), ("reflect", 5), ("reflect", 40), ("nearest", 30)])
def test_gaussian_at_the_ends(spark, edge, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "g string, i int, x double")
    got = [r.y for r in W.gaussian_smooth(df, ["g"], ["i"], "x", 2.0, "y", edge).orderBy("i").collect()]
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    want = np.convolve(np.pad(x, 8, mode="symmetric" if edge == "reflect" else "edge"), w / w.sum(), "valid")
    assert got == pytest.approx(want.tolist())


def test_scan_keeps_a_value_over_nulls(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 9.0), ("b", 0, None), ("b", 1, 4.0), (None, 0, 2.0)], "g string, i int, x double")
    got = {(r.g, r.i): r.y for r in W.slew_follow(df, ["g"], ["i"], "x", 3.0, "y").collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 4.0, ("b", 0): None, ("b", 1): 4.0, (None, 0): 2.0}


def test_greedy_select(spark):
    rows = [("a", c) for c in range(5)] + [("b", c) for c in range(3, 9)] + [("c", c) for c in range(8, 11)] + [("d", c) for c in range(8, 11)] + [(None, 99)]
    got = [tuple(r) for r in X.greedy_select(spark.createDataFrame(rows, "i string, c long"), "i", "c", 9).orderBy("round").collect()]
    assert got == [(1, "b", 6), (2, "a", 3), (3, "c", 2)]


def test_triangles_met_in_layers(spark):
    """a point that front layers hold meets no triangle behind; depths tie, a point lies outside a box by the tolerance, and over a cell's border."""
    r = np.random.default_rng(11)
    c, z, q = r.normal(0, 0.2, (300, 6)).round(2), r.integers(0, 20, 300) / 4, r.normal(0, 0.2, (200, 2)).round(2)
    c[7], z[7], q[0] = (0.05, 3.0, 0.1, 3.0, 0.1, 3.05), -1.0, (0.1 + 5e-9, 3.01)
    want = {}
    for i, (x, y) in enumerate(q):
        for t, (ax, ay, bx, by, cx, cy) in enumerate(c):
            det = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
            if det:
                w1, w2 = ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / det, ((bx - ax) * (y - ay) - (x - ax) * (by - ay)) / det
                if min(1 - w1 - w2, w1, w2) >= -1e-6:
                    want[i] = min(want.get(i, (np.inf, 0)), (z[t], t))
    tri = spark.createDataFrame([(t, *map(float, v), float(d)) for t, (v, d) in enumerate(zip(c, z))], "t long, ax double, ay double, bx double, by double, cx double, cy double, depth double")
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "p long, x double, y double")
    got = {r.p: r.t for r in J.in_triangles(pts, tri, "p", "t", 0.1, 1e-6, "depth", first=4).collect()}
    assert got == {i: t for i, (_, t) in want.items()} and got[0] == 7 and 100 < len(got) < 200
    assert J.in_triangles(pts, tri.limit(0), "p", "t", 0.1).count() == 0


def test_set_iou_of_pairs_in_blocks(spark):
    """blocks of three sets; a part in every set, one in none other, one that is null and counts in sizes alone; no join makes the pairs."""
    sets = {s: {1} | {p for p in range(2, 12) if (s * p) % 7 == 3} | {100 + s} for s in range(0, 40, 3)}
    rows = [(s, p) for s, ps in sets.items() for p in ps] * 2 + [(6, None), (9, None)] + [(50, None), (51, 7), (52, 8)]
    df = _iou_pairs(spark.createDataFrame(rows, "s long, p long"), block=3)
    sets |= {6: sets[6] | {None}, 9: sets[9] | {-1}, 50: {None}, 51: {7}, 52: {8}}
    got = [tuple(r) for r in df.collect()]
    want = {(a, b): len(sets[a] & sets[b] - {None}) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want[6, 50] = 0 / (len(sets[6]) + 1)
    assert len(got) == len(want) and {(a, b): v for a, b, v in got} == {k: pytest.approx(v) for k, v in want.items()}
