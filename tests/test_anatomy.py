"""Selections and constructions on bodies, sheets and tools on cases worked out by hand or with NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anatomy as N


def pts(spark, rows, names="v long, x double, y double, z double"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], names)


def test_vertices(spark):
    # two tetrahedra's surfaces that touch in vertex 0 only
    f = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 3, 2), (0, 4, 5), (0, 5, 6), (0, 6, 4), (4, 6, 5)]
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "f long, a long, b long, c long")
    assert [r.v for r in N.nonmanifold_vertices(faces).collect()] == [0] and N.nonmanifold_vertices(faces.where("f < 4")).count() == 0
    v = pts(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]).withColumn("depth", F.col("z") + F.col("v") / 10)
    att = spark.createDataFrame([(2, "backdrop"), (1, "ducts")], "v long, to string")
    assert [r.v for r in N.bed_vertices(v, att).collect()] == [2]
    assert {r.v for r in N.bed_vertices(v, att.where("to = 'ducts'")).collect()} == {2, 3}
    tet = faces.where("f < 4")
    assert {r.v for r in N.vertices_facing(v, tet, (0.0, 0.0, 1.0), 0.35).collect()} ^ {r.v for r in N.vertices_facing(v, tet, (0.0, 0.0, -1.0), 0.35).collect()} == {0, 3}
    seen = spark.createDataFrame([(i, 5.2 + i, 7.9, -1.0 if i < 3 else 1.0) for i in range(4)], "v long, u double, w double, facing double")
    sheet = spark.createDataFrame([(6, 7), (8, 7)], "u int, v int")
    got = [(r.to, r.v) for r in N.suggested_attachments(v, tet, (0.0, 0.0, 1.0), (1.0, 0.0, 0.001), seen, sheet).orderBy("ord").collect()]
    assert got[-2:] == [("ducts", 1), ("membrane", 1)] and all(t == "backdrop" for t, _ in got[:-2])


def test_cables_and_parts(spark):
    rows = [("a", 12, "ends", True, "gb", "backdrop"), ("b", 12, "mid", True, "gb", "gb"), ("c", 12, "glue_mid2", False, "gb", "backdrop"), ("d", 13, "mid2", True, "gb", "none"), ("e", 9, "none", True, "gb", "gb")]
    got = {}
    for r in N.driven_nodes(spark.createDataFrame(rows, "cable string, n int, mode string, is_duct boolean, start string, end string")).collect():
        got.setdefault(r.cable, set()).add(r.node)
    assert got == {"a": {0, 11}, "b": {0, 6}, "c": {4, 8, 11}, "d": {0, 3, 6}}
    t = spark.createDataFrame([("ducts", True, False, False, 0.0), ("gb", False, True, True, 1.0), ("m", False, False, False, 2.0), ("s", False, False, False, 0.0)], "tissue string, has_tubes boolean, has_tets boolean, solid boolean, merge double")
    assert {r.tissue: (r.kind, r.dim) for r in N.simulated_parts(t).collect()} == {"ducts": ("cables", 1), "gb": ("solid", 3), "m": ("merged", 2), "s": ("surface", 2)}


def test_hull_and_pushes(spark):
    r = np.random.default_rng(3)
    p = np.concatenate([[(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], r.uniform(0.1, 0.9, (30, 3))])
    hull = N.hull_planes(spark.createDataFrame([(0, *map(float, q)) for q in p], "g int, x double, y double, z double"), ["g"])
    planes = {(round(h.nx), round(h.ny), round(h.nz), round(h.d)) for h in hull.collect()}
    assert planes == {(1, 0, 0, 1), (-1, 0, 0, 0), (0, 1, 0, 1), (0, -1, 0, 0), (0, 0, 1, 1), (0, 0, -1, 0)}
    rays = [(0, 0.5, 0.5, 0.9, 0.0, 0.0, 1.0), (1, 0.5, 0.5, 2.0, 0.0, 0.0, 1.0), (2, 0.5, 0.5, 0.5, 0.0, 0.0, 1.0)]
    got = {x.id: (x.z, x.steps) for x in N.pushed_outside(spark.createDataFrame([(0, *x) for x in rays], "g int, id int, x double, y double, z double, dx double, dy double, dz double"), hull, ["g"], 0.03, 8).collect()}
    assert got == {0: (pytest.approx(1.02), 4), 1: (2.0, 0), 2: (pytest.approx(0.74), 8)}


def test_tents_and_apexes(spark):
    r = np.random.default_rng(4)
    a, b, p = r.normal(size=3), r.normal(size=(5, 3)), 1.7
    grid = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in (0.0, 0.4, 1.0) for t in (0.0, 0.3, 1.0))]
    got = {x.v: (x.x, x.y, x.z) for x in N.tent(spark.createDataFrame([(0, *map(float, a), p)], "k int, x double, y double, z double, p double"), spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(b)], "k int, node int, x double, y double, z double"), spark.createDataFrame(grid, "v int, s double, t double"), ["k"], 0.2).collect()}
    m, e = b.mean(0), (b[-1] - b[0]) / np.linalg.norm(b[-1] - b[0])
    for i, s, t in grid:
        c = np.array([np.interp(t * 4, range(5), b[:, j]) for j in range(3)])
        assert got[i] == pytest.approx(tuple(a + s * (m - a) + s**p * (c - m) + (1 - s) * (t - 0.5) * 0.2 * e))
    best = N.best_exponent(spark.createDataFrame([(0, 0, 1.0, 0.5), (0, 1, 1.5, 0.7), (0, 2, 2.0, 0.7)], "k int, ord int, p double, iou double")).first()
    assert (best.p, best.iou) == (1.5, 0.7)
    n = 6
    tcp, tip, o, d = (r.normal(size=(n, 3)) for _ in range(4))
    cols = "g int, k int, " + ", ".join(f"{c}{x} double" for c in "abod" for x in "xyz")
    track = spark.createDataFrame([(0, k, *map(float, np.concatenate([tcp[k], tip[k], o[k], d[k]]))) for k in range(n)], cols)
    us = np.linspace(0, 1, 61)
    for x in N.apex_on_ray(track, ["g"], "k", sigma=0).collect():
        u = d[x.k] / np.linalg.norm(d[x.k])
        q = tcp[x.k] + us[:, None] * (tip[x.k] - tcp[x.k])
        near = o[x.k] + ((q - o[x.k]) @ u)[:, None] * u
        i = np.linalg.norm(near - q, axis=1).argmin()
        assert (x.x, x.y, x.z, x.u) == pytest.approx((*near[i], us[i]))
    seg = {x.k: x.u for x in N.apex_on_segment(track, ["g"], "k", F.abs(F.col("__px")), sigma=0, count=31).collect()}
    raw = np.array([np.linspace(0, 1, 31)[np.abs(tcp[k, 0] + np.linspace(0, 1, 31) * (tip[k, 0] - tcp[k, 0])).argmin()] for k in range(n)])
    med = np.array([np.median(np.pad(raw, 2, mode="edge")[i : i + 5]) for i in range(n)])
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
    assert [seg[k] for k in range(n)] == pytest.approx(np.convolve(np.pad(med, 8, mode="edge"), w / w.sum(), "valid").tolist())


def test_cast_on_surface(spark):
    cols = "k int, face long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    faces = spark.createDataFrame([(0, 0, -1.0, -1.0, 2.0, 1.0, -1.0, 2.0, -1.0, 1.0, 2.0)], cols)
    pose = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 100.0, (0.0, 0.0, 0.0))], "k int, rot array<double>, f double, pos struct<x:double,y:double,z:double>")
    covered = spark.createDataFrame([(0, u, v, 2.0) for u in range(0, 51) for v in range(0, 51) if u + v <= 100], "k int, u int, v int, z double")
    points = spark.createDataFrame([(0, 0, -0.5, -0.5, 1.0), (0, 1, 0.1, 0.0, 1.0), (0, 2, 0.9, 0.9, 1.0)], "k int, id long, x double, y double, z double")
    got = {r.id: (r.way, round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in N.cast_on_surface(points, faces, covered, pose, 50.0, 50.0, 0.01).collect()}
    assert got[0] == ("ray", -0.995, -0.995, 1.99) and got[1][0] == "pixel" and got[1][1:] == (0.0, 0.0, 1.99) and got[2] == ("space", 1.0, -1.0, 2.0) or got[2][0] == "space"


def test_pushes_over_a_mesh(spark):
    need = spark.createDataFrame([(k, v, 1.0 if (k, v) == (1, 2) else 0.0) for k in range(3) for v in range(5)], "k long, v long, need double")
    edges, frozen = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long"), spark.createDataFrame([(0,)], "v long")
    got = {(r.k, r.v): r.push for r in N.pushed_forward(need, edges, frozen, rounds=30).collect()}
    n = np.zeros((3, 5))
    n[1, 2] = 1
    adj = np.eye(5, k=1) + np.eye(5, k=-1)
    p = n.copy()
    for _ in range(30):
        p = np.maximum(n, 0.5 * p + 0.5 * (p @ adj.T) / adj.sum(1))
        p[:, 0] = 0
    assert all(got[k, v] == pytest.approx(p[k, v]) for k in range(3) for v in range(5))
    late = {(r.k, r.v): r.push for r in N.pushed_forward(need, edges, frozen, sigma=1.0).collect()}
    assert late[1, 2] == 1 and 0 < late[0, 2] < 1 and late[0, 0] == 0


def test_tubes(spark):
    obs = [(k, i, float(i), 0.5, 4.0 + k, True) for k in (0, 2) for i in range(12)] + [(1, i, float(i), 0.5, 9.0, False) for i in range(12)]
    centre = [(k, j, float(j), 0.0, 2.0, 100.0, 0.04) for k in range(3) for j in range(12)]
    got = N.width_scale(spark.createDataFrame(obs, "k int, i int, u double, v double, radius double, inside boolean"), spark.createDataFrame(centre, "k int, node int, u double, v double, z double, f double, r double"), 4, 2.0, (0.5, 9.0), half=3).orderBy("k").collect()
    raw = np.interp(range(4), [0, 2], [2.0, 3.0])
    w = np.exp(-0.5 * (np.arange(-3, 4) / 2.0) ** 2)
    assert [g.raw for g in got] == [2.0, None, 3.0, None] and [g.scale for g in got] == pytest.approx(np.convolve(np.pad(raw, 3, mode="edge"), w / w.sum(), "valid").tolist())
    paths = spark.createDataFrame([(0, i, 10, 20 - 2 * i) for i in range(6)] + [(1, i, i, i) for i in range(3)], "k int, i int, u int, v int")
    junction = spark.createDataFrame([(0, 10, 7), (0, 90, 90)], "k int, u int, v int")
    path = N.observed_paths(paths, ["k"], junction, 5.0, 1.0)
    p = [(r.u, r.v, r.joined) for r in path.orderBy("i").collect()]
    assert p[0] == (10.0, 7.0, True) and p[-1][:2] == (10.0, 20.0) and len(p) == 14 and np.allclose(np.diff([q[1] for q in p]), 1)
    flat = lambda rows, extra="": spark.createDataFrame(rows, "k int, u int, v int" + extra)
    s = N.observed_samples(path, ["k"], flat([(0, 10, v) for v in range(9, 30)]), flat([(0, 10, v, 3.0) for v in range(30)], ", r double"), flat([(0, 10, v, 0.2) for v in range(30)], ", z double"), flat([(0, 10, 20)]), spark.createDataFrame([(0, 100.0)], "k int, f double"), 64, 48).orderBy("i").collect()
    assert (s[0].end_ok, s[-1].end_ok, s[3].end_ok) == (True, False, None) and [x.inside for x in s[:4]] == [False, False, True, True] and s[5].radius == pytest.approx(3.0 * 0.2 / 100)


def test_tools(spark):
    r = np.random.default_rng(6)
    depth = [(0, u, v, 0.3 if u > 20 else 0.2) for u in range(45) for v in range(41)]
    deep = spark.createDataFrame(depth, "k int, u int, v int, z double")
    tip = spark.createDataFrame([(0, 20.0, 20.0, 1.0, 0.0)], "k int, pu double, pv double, pdu double, pdv double")
    px = spark.createDataFrame([(0, u, 20) for u in range(21)], "k int, u int, v int")
    assert N.depth_map_indentation(px, tip, deep, deep, ["k"]).first().indent == pytest.approx(-0.1)
    assert {x.ring for x in N.ring_sensitivity(deep, tip, ["k"], [(4, 14), (8, 20)]).collect()} == {"4-14", "8-20"}
    sheet = spark.createDataFrame([(0, 30, v) for v in range(15, 26)], "k int, u int, v int")
    tips = spark.createDataFrame([(0, 20.0, 20.0, 0.35)], "k int, pu double, pv double, z double")
    a = N.sheet_apex(sheet, tips, deep).first()
    assert (a.touch, a.u, a.v, a.z, a.error) == (10.0, 30.0, 20.0, 0.3, None) and a.dz == pytest.approx(0.05)
    assert "missing" in N.sheet_apex(None, tips, deep).first().error
    two = spark.createDataFrame([("g", 0, 20.0, 20.0, 1.0, 0.0), ("p", 0, 20.0, 20.0, 1.0, 0.0)], "tool string, k int, pu double, pv double, pdu double, pdv double")
    assert {x.tool: (x.z, x.w) for x in N.depth_targets(deep, two, ["g"]).collect()} == {"g": (0.3, 1.0), "p": (None, 0.0)}
    c = spark.range(1).select(N.tool_centre(F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).alias("c")).first().c
    assert c.x == pytest.approx(0.997) and r is not None


def box(m, r):
    p = np.pad(m, r)
    return sum(p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1))


def test_windows_and_blurs(spark):
    r = np.random.default_rng(7)
    h, w = 20, 24
    a, b, m = r.uniform(0, 255, (h, w)), r.uniform(0, 255, (h, w)), r.random((h, w)) < 0.9
    b = 0.7 * a + 0.3 * b
    px = spark.createDataFrame([(0, int(u), int(v), float(a[v, u]), float(b[v, u])) for v, u in np.argwhere(m)], "k int, u int, v int, a double, b double")
    got = N.local_correlation(px, ["k"], radius=2, least=10).first()
    n = box(m * 1.0, 2) + 1e-6
    mean = lambda x: box(np.where(m, x, 0), 2) / n
    va, vb, cov = mean(a * a) - mean(a) ** 2, mean(b * b) - mean(b) ** 2, mean(a * b) - mean(a) * mean(b)
    ok = m & (n > 0.6 * 25) & (va > 4) & (vb > 4)
    assert got.n == ok.sum() and got.lncc == pytest.approx((cov / np.sqrt(np.maximum(va, 1e-3) * np.maximum(vb, 1e-3)))[ok].mean())
    z, known = r.uniform(1, 2, (h, w)), r.random((h, w)) < 0.5
    cells = spark.createDataFrame([(0, u, v, float(z[v, u]) if known[v, u] else None) for v in range(h) for u in range(w)], "k int, u int, v int, z double")

    def blur(x, sigma):
        t = int(4 * sigma + 0.5)
        g = np.exp(-0.5 * (np.arange(-t, t + 1) / sigma) ** 2)
        g /= g.sum()
        x = np.array([np.convolve(np.pad(row, t), g, "valid") for row in x])
        return np.array([np.convolve(np.pad(col, t), g, "valid") for col in x.T]).T

    want = blur(np.where(known, z, 0), 1.5) / np.maximum(blur(known * 1.0, 1.5), 1e-6)
    got = {(x.u, x.v): x.z for x in N.smoothed_known(cells, ["k"], 1.5).collect()}
    assert all((got[u, v] is None) == (not known[v, u]) and (not known[v, u] or got[u, v] == pytest.approx(want[v, u])) for u in range(w) for v in range(h))
    corner = cells.where("u < 4 and v < 4")
    fill = spark.createDataFrame([(0, 6, 2, None), (0, 6, 3, 9.0), (0, 22, 19, None)], "k int, u int, v int, least double")
    got = {(x.u, x.v): x.z for x in N.extrapolated_depth(corner, fill, ["k"], (1.0, 3.0)).collect()}
    kn = np.zeros((h, w), bool)
    kn[:4, :4] = known[:4, :4]
    for (u, v), value in got.items():
        z1 = next((blur(np.where(kn, z, 0), s)[v, u] / blur(kn * 1.0, s)[v, u] for s in (1.0, 3.0) if blur(kn * 1.0, s)[v, u] > 1e-3), None)
        assert (value is None) if z1 is None else value == pytest.approx(max(z1, 9.0) if v == 3 else z1)
    lab = N.label_cells(spark.createDataFrame([(0, 0, True), (0, 0, False), (3, 0, None)], "cu int, cv int, l boolean"), [], F.col("l"))
    assert {(x.cu, x.share) for x in lab.collect()} == {(0, 0.5), (3, 0.5)}


def test_shape_residuals(spark):
    samples = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 5.0, 5.0, 1.0, True), (1, 1.0, 0.0, 1.0, 8.0, 5.0, 1.0, True), (2, 0.4, 0.0, 1.0, 6.0, 5.0, 2.0, False)], "id int, x double, y double, z double, u double, v double, depth double, front boolean")
    observed = pts(spark, [(0.4, 0, 1), (0, 0, 3)], "id long, x double, y double, z double")
    outside = spark.createDataFrame([(5, 5, 0.0, 9.0), (8, 5, 4.0, 9.0), (6, 5, 4.0, 1.0)], "u int, v int, d double, z_visible double")
    contour = spark.createDataFrame([(0, 5.0, 8.0)], "id long, u double, v double")
    got = {(r.kind, r.id): r.r for r in N.shape_residuals(samples, observed, outside, contour, 0.01).collect()}
    w = 2.0 * 0.01
    assert got == {("points", 0): pytest.approx(0.4), ("points", 1): pytest.approx(2.0), ("outline", 0): 0.0, ("outline", 1): pytest.approx(w * 4 / math.sqrt(3 / 2)), ("outline", 2): 0.0, ("cover", 0): pytest.approx(w * 3 / math.sqrt(1 / 2 + 1e-9))}
