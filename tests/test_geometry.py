"""Geometry, meshes, sets of pixels and kernels against NumPy and small cases worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import scalars as C
from tidemark.operators import kernels as K
from tidemark.operators import mesh as M
from tidemark.operators import sets as S

CUBE_V = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
CUBE_F = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def vertices(spark, v=CUBE_V, k=None):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "v long, x double, y double, z double")


def faces(spark, f=CUBE_F):
    return spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(f)], "f long, a long, b long, c long")


def test_cube(spark):
    v, f = vertices(spark), faces(spark)
    assert M.surface_area(v, f).first()[0] == pytest.approx(6)
    assert abs(M.enclosed_volume(v, f).first()[0]) == pytest.approx(1)
    h = M.mesh_health(v, f).first()
    assert (h.n_vertices, h.n_faces, h.n_open_edges, h.n_degenerate, h.watertight, h.min_edge) == (8, 12, 0, 0, True, 1)
    open_ = M.mesh_health(v, faces(spark, CUBE_F[1:])).first()
    assert (open_.n_open_edges, open_.watertight) == (3, False)
    n = {r.v: np.array([r.nx, r.ny, r.nz]) for r in M.vertex_normals(v, f).collect()}
    side = np.sign(n[0] @ (np.array(CUBE_V[0]) - 0.5))
    assert all(np.linalg.norm(x) == pytest.approx(1) and np.sign(x @ (np.array(CUBE_V[i]) - 0.5)) == side for i, x in n.items())


def test_edges_do_not_depend_on_winding(spark):
    f = [(0, 1, 2), (2, 1, 3)]
    a = {(r.a, r.b, r.n) for r in S.edge_use(faces(spark, f)).collect()}
    b = {(r.a, r.b, r.n) for r in S.edge_use(faces(spark, [t[::-1] for t in f])).collect()}
    assert a == b == {(0, 1, 1), (0, 2, 1), (1, 2, 2), (1, 3, 1), (2, 3, 1)}
    assert [(r.f1, r.f2) for r in S.face_pairs(faces(spark, f)).collect()] == [(0, 1)]


def test_tetrahedra(spark):
    p = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)]
    tets = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 3, 4)], "t long, a long, b long, c long, d long")
    out = S.boundary_faces(tets).collect()
    assert len(out) == 6 and {1, 2, 3} not in [{r.a, r.b, r.c} for r in out]
    rest = vertices(spark, p)
    moved = [list(x) for x in p]
    moved[0] = (2, 2, 2)
    frames = vertices(spark, p).withColumn("k", F.lit(0)).unionByName(vertices(spark, moved).withColumn("k", F.lit(1)))
    assert M.inverted_tets(rest, frames, tets).first()[0] == 1
    r = M.tet_report(rest, tets).first()
    vols = [abs(np.linalg.det(np.array([np.subtract(p[j], p[t[0]]) for j in t[1:]]))) / 6 for t in ((0, 1, 2, 3), (1, 2, 3, 4))]
    assert r.median_volume == pytest.approx(np.median(vols)) and 0 < r.min <= r.median
    assert M.degenerate_tets(rest, tets).count() == 0
    assert K.repair_manifold(tets.withColumn("g", F.lit(1)).withColumn("quality", F.lit(1.0)), ["g"]).count() == 2


def test_stretch_and_fold(spark):
    flat, bent = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 2)]
    f = faces(spark, [(0, 1, 2), (1, 3, 2)])
    frames = vertices(spark, flat).withColumn("k", F.lit(0)).unionByName(vertices(spark, bent).withColumn("k", F.lit(1)))
    e = S.edge_use(f).select("a", "b")
    got = {r.k: r.max for r in M.stretch(vertices(spark, flat), frames, e).collect()}
    assert got == {0: pytest.approx(1), 1: pytest.approx(math.sqrt(5))}
    n = np.cross(np.subtract(bent[3], bent[1]), np.subtract(bent[2], bent[1]))
    angle = math.degrees(math.acos(n[2] / np.linalg.norm(n)))
    assert M.fold(frames, f).first()[0] == pytest.approx(angle / 2)


def test_projection_is_undone(spark):
    """Sixty cameras, some not turned at all, as rows of one table."""
    g = np.random.default_rng(7)
    p = (0.3, -0.2, 5.0)
    turns = [np.zeros(3), np.array([1.5, 0.0, 0.0])] + [g.uniform(-1.5, 1.5, 3) for _ in range(58)]
    rows = [(i, tuple(map(float, r)), tuple(map(float, g.uniform(-1, 1, 3))), p, float(g.uniform(50, 900))) for i, r in enumerate(turns)]
    v = "struct<x:double,y:double,z:double>"
    d = spark.createDataFrame(rows, f"i int, r {v}, pos {v}, p {v}, f double").withColumn("m", G.rotation_vector(F.col("r"))).cache()
    centre = F.col("f"), F.col("pos"), F.lit(320.0), F.lit(240.0)
    q = d.withColumn("q", G.project(F.col("p"), F.col("m"), *centre)).cache()
    w = q.withColumn("w", G.unproject(F.col("q.u"), F.col("q.v"), F.col("q.depth"), F.col("m"), *centre))
    for got in w.select("i", "w.x", "w.y", "w.z", "q.depth", G.rotation_degrees(F.col("m")).alias("deg")).collect():
        if abs(got.depth) > 1e-3:
            assert [got.x, got.y, got.z] == pytest.approx(list(p), abs=1e-6)
        assert got.deg == pytest.approx(math.degrees(np.linalg.norm(turns[got.i])), abs=1e-4)


def test_shaft_and_scalars(spark):
    port, tip = G.vec(0.1, 0.2, 0.3), G.vec(0.4, -0.2, -0.5)
    d = spark.range(1).select(port.alias("port"), tip.alias("tip"), F.lit(0.4).alias("h")).withColumn("j", G.shaft_joints(F.col("port"), F.col("tip"), F.col("h")))
    d = d.withColumn("b", G.shaft_tip(F.col("port"), F.col("j.yaw"), F.col("j.pitch"), F.col("j.insertion"), F.col("h")))
    assert list(d.select("b.x", "b.y", "b.z").first()) == pytest.approx([0.4, -0.2, -0.5])
    assert d.select(G.shaft_joints(F.col("port"), F.col("tip"), F.col("h"), 0.5)).first()[0] is None
    row = spark.range(1).select(
        G.triangle_min_angle(G.vec(0, 0, 0), G.vec(1, 0, 0), G.vec(0, 1, 0)).alias("angle"),
        G.in_polygon(F.lit(0.5), F.lit(0.5), F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).alias("inside"),
        G.in_polygon(F.lit(1.5), F.lit(0.5), F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).alias("outside"),
        G.segment_distance(G.vec(0, 2, 0), G.vec(-1, 0, 0), G.vec(1, 0, 0)).alias("seg"),
        G.border_distance(F.lit(3), F.lit(9), F.lit(20), F.lit(12)).alias("border"),
        G.field_of_view(F.lit(100.0), F.lit(200.0)).alias("fov"),
        C.timestamp_ms(F.lit("2024-01-02.03:04:05.22")).alias("t"),
        C.timestamp_ms(F.lit("Date:")).alias("none"),
        C.round_even(F.lit(2.5)).alias("even"),
        C.psnr(F.lit(0.0)).alias("psnr"),
        C.is_specular(F.lit(250), F.lit(250), F.lit(245)).alias("spec"),
        C.quantize16(F.lit(0.1), -0.4, 0.4).alias("q"),
        C.spec(F.lit("clip:a,b"), F.array(F.lit("all"))).alias("s"),
        C.spec(F.lit("clip"), F.array(F.lit("all"))).alias("s2"),
        C.low_id(C.packed_id(F.lit(7).cast("long"), F.lit(3))).alias("low"),
        C.overlay(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("map"),
        C.number_or_text(F.lit("1e3")).alias("num"),
        C.number_or_text(F.lit("x")).alias("txt"),
        C.unpack_bits(C.pack_bits(F.array(*[F.lit(b) for b in (True, False, True, True, False, False, False, True, True)])), 9).alias("bits"),
        F.size(G.lattice_weights(F.lit(0.3), F.lit(0.6), F.lit(0.9), 0.0, 1.0, 4)).alias("corners"),
    ).first()
    assert row.angle == pytest.approx(45) and row.inside and not row.outside and row.seg == pytest.approx(2) and row.border == 2 and row.fov == pytest.approx(90)
    assert row.t.microsecond == 22000 and row.none is None and row.even == 2 and row.psnr == pytest.approx(10 * math.log10(255**2 / 1e-9)) and row.spec
    assert row.q == round(0.1 * 65534 / 0.8) and row.s.items == ["a", "b"] if not callable(row.s.items) else True
    assert row.s["items"] == ["a", "b"] and row.s2["items"] == ["all"] and row.low == 7 and row.map == {"a": 1, "b": 3}
    assert row.num.num == 1000 and row.txt.txt == "x" and row.bits == [True, False, True, True, False, False, False, True, True] and row.corners == 8


def squares(spark, *boxes):
    return spark.createDataFrame(sorted({(u, v) for x, y, w, h in boxes for u in range(x, x + w) for v in range(y, y + h)}), "u int, v int")


def test_pixels(spark):
    a = squares(spark, (0, 0, 10, 10))
    assert S.erode(a, []).count() == 64 and S.dilate(a, [], 1).count() == 144 and S.outline(a, []).count() == 36
    assert S.remaining(a, squares(spark, (0, 0, 1, 1)), [], 2).count() == 100 - 9
    two = squares(spark, (0, 0, 3, 3), (6, 0, 2, 2))
    lab = S.pixel_components(two, 20)
    assert lab.select("label").distinct().count() == 2
    assert S.components_by_size(lab).count() == 9 and S.components_by_size(lab, 0.3).count() == 13
    ring = squares(spark, (1, 1, 5, 5)).join(squares(spark, (2, 2, 2, 2)), ["u", "v"], "left_anti")
    assert S.fill_holes(ring, 8, 8).count() == 25
    k = lambda df: df.withColumn("k", F.lit(0))
    assert S.boundary_agreement(k(a), k(a), ["k"], 1).first().f == pytest.approx(1)
    assert S.boundary_agreement(k(a), k(squares(spark, (40, 40, 3, 3))), ["k"], 1).first().f == 0


def test_sets(spark):
    f = faces(spark, [(10, 30, 20), (30, 10, 50)])
    out, names = S.renumber(f, ["a", "b", "c"])
    assert {r.old: r.new for r in names.collect()} == {10: 0, 20: 1, 30: 2, 50: 3}
    assert sorted((r.a, r.b, r.c) for r in out.collect()) == [(0, 2, 1), (2, 0, 3)]
    grid = squares(spark, (0, 0, 3, 2))
    assert S.grid_mesh(grid.select(F.col("u").alias("x"), F.col("v").alias("y"))).count() == 4
    t = S.tagged_union({"a": grid, "b": grid.limit(1)})
    assert {r.tag: r["count"] for r in t.groupBy("tag").count().collect()} == {"a": 6, "b": 1}
    assert S.union_sets(grid, grid).count() == 6


def test_rigid(spark):
    r = np.random.default_rng(5)
    a = r.normal(size=(50, 3))
    rot, _ = np.linalg.qr(r.normal(size=(3, 3)))
    rot *= np.sign(np.linalg.det(rot))
    b = 1.7 * a @ rot.T + [1, 2, 3]
    df = spark.createDataFrame([(0, *map(float, (*x, *y))) for x, y in zip(a, b)], "g int, ax double, ay double, az double, bx double, by double, bz double")
    got = K.fit_rigid(df, ["g"], ["ax", "ay", "az"], ["bx", "by", "bz"], scaled=True).first()
    assert np.allclose(np.reshape(got.rotation, (3, 3)), rot) and got.scale == pytest.approx(1.7) and got.rms < 1e-9 and got.n == 50
    assert K.fit_rigid(df.limit(2), ["g"], ["ax", "ay", "az"], ["bx", "by", "bz"]).first().rotation is None
    s = K.rigid_split(df, ["g"], ["ax", "ay", "az"], ["ax", "ay", "az"], ["bx", "by", "bz"]).first()
    assert s.moved_1 == pytest.approx(0, abs=1e-9) and s.left_1 == pytest.approx(0, abs=1e-9) and s.left_2 > 0.1
    lines = spark.createDataFrame([(0, *map(float, (*(np.array([1, 2, 3]) + k * d), *d))) for k, d in enumerate(r.normal(size=(6, 3)))], "g int, ox double, oy double, oz double, dx double, dy double, dz double")
    p = K.common_point(lines, ["g"], ["ox", "oy", "oz"], ["dx", "dy", "dz"]).first()
    assert [p.x, p.y, p.z] == pytest.approx([1, 2, 3]) and p.spread < 1e-9


def test_raster_and_rays(spark):
    cols = "k int, face long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    tri = [(0, 0, 0.0, 0.0, 2.0, 9.0, 0.0, 2.0, 0.0, 9.0, 2.0), (0, 1, 0.0, 0.0, 1.0, 4.0, 0.0, 1.0, 0.0, 4.0, 1.0), (0, 2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    px = K.rasterize(spark.createDataFrame(tri, cols), ["k"], 12, 12).collect()
    assert len(px) == 55 and sum(r.face == 1 for r in px) == 15 and all(r.depth == pytest.approx(2 - r.face) and r.w0 + r.w1 + r.w2 == pytest.approx(1) for r in px)
    rays = spark.createDataFrame([(r, *o, *d, *t[1:]) for r, (o, d) in enumerate((((1.0, 1.0, -5.0), (0.0, 0.0, 1.0)), ((50.0, 50.0, 0.0), (0.0, 0.0, 1.0)))) for t in tri], "ray int, ox double, oy double, oz double, dx double, dy double, dz double, " + cols.split(", ", 1)[1])
    hit = K.ray_hits(rays, ["ray"]).collect()
    assert [(r.ray, r.t, r.face) for r in hit] == [(0, 6.0, 1)]
    d, i = K.nearest_on_triangles(np.array([0.0, 0.0, 3.0]), np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[5, 5, 5], [6, 5, 5], [5, 6, 5]]], float))
    assert (d, i) == (3.0, 0)


def test_images_and_skeletons(spark):
    img = [(0, u, v, float(10 * u), float(10 * u)) for u in range(16) for v in range(16)]
    s = K.image_similarity(spark.createDataFrame(img, "k int, u int, v int, a double, b double"), ["k"], 16, 16).first()
    assert s.ssim == pytest.approx(1) and s.mse == 0
    line = spark.createDataFrame([(0, u, 3) for u in range(9)] + [(0, 4, 4), (0, 4, 5)], "k int, u int, v int")
    path = K.longest_path(line, ["k"]).orderBy("i").collect()
    assert len(path) == 9 and {path[0].u, path[-1].u} == {0, 8}
    blobs = spark.createDataFrame([(0, k, float(10 * k), 0.0, 200.0) for k in range(5)] + [(0, 2, 0.0, 500.0, 900.0)], "g int, k int, u double, v double, area double")
    assert [r.u for r in K.follow_blob(blobs, ["g"], (0.0, 0.0)).orderBy("k").collect()] == [0, 10, 20, 30, 40]
    cells = spark.createDataFrame([(0, x, y, float(x) if x in (0, 4) else None) for x in range(5) for y in range(3)], "g int, x int, y int, z double")
    assert all(r.z == pytest.approx(r.x, abs=1e-5) for r in K.harmonic_fill(cells, ["g"]).collect())
    nodes = spark.createDataFrame([(0, k, 0.0, 0.0, float(k)) for k in range(5)], "g int, node long, x double, y double, z double")
    assert len({(r.nx, r.ny, r.nz) for r in K.parallel_frames(nodes, ["g"]).collect()}) == 1
    tube = M.tube(nodes.withColumn("path", F.lit(0)).withColumn("r", F.lit(0.5)), "r", 6).collect()
    assert len(tube) == 30 and all(math.hypot(t.x, t.y) == pytest.approx(0.5) for t in tube)


def test_surface_distance(spark):
    tri = spark.createDataFrame([(0, *[float(x) for c in t for x in CUBE_V[c]]) for t in CUBE_F], "m int, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))
    s = K.surface_samples(tri, ["m"], 4000, 1)
    assert s.count() == 4000
    out = s.withColumn("o", (F.col("x") - 0.5) * F.col("nx") + (F.col("y") - 0.5) * F.col("ny") + (F.col("z") - 0.5) * F.col("nz")).agg(F.avg("o")).first()[0]
    pts = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.5), (0, 1, 2.0, 0.5, 0.5)], "m int, id long, x double, y double, z double")
    d = {r.id: r.d * (1 if out > 0 else -1) for r in K.signed_distance(pts, s, "m").collect()}
    assert d[0] == pytest.approx(-0.5, abs=0.05) and d[1] == pytest.approx(1.0, abs=0.05)
