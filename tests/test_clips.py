"""Compositions over a clip's tables on small cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clips as C


def test_colours_and_textures(spark):
    px = spark.createDataFrame([("t", 0, 1.0, 2.0, 3.0), ("t", 0, 3.0, 2.0, 9.0), ("t", 5, 99.0, 99.0, 99.0), ("s", 5, 1.0, 1.0, 1.0)], "t string, k int, r double, g double, b double")
    assert {r.t: (r.r, r.g, r.b) for r in C.median_colour(px, ["t"], 10, (7, 8, 9)).collect()} == {"t": (2, 2, 6), "s": (7, 8, 9)}


def plain_texture(cols, sharp, enough, blend):
    """cols[k, cell] (NaN: not seen): gains against a first median, then medians of sharp and of all frames."""
    cols = cols.copy()
    first = np.nanmedian(cols, 0)
    for k in range(len(cols)):
        v = np.isfinite(cols[k])
        if v.sum() > 5:
            gain = np.clip(np.median(cols[k, v] + 1) / np.median(first[v] + 1), 0.6, 1.6)
            cols[k, v] = np.floor(np.clip(cols[k, v] / gain, 0, 255))
    with np.errstate(all="ignore"):
        s, a, n = np.nanmedian(cols[sharp], 0), np.nanmedian(cols, 0), np.isfinite(cols[sharp]).sum(0)
    if blend:
        w = np.clip(n / enough, 0, 1)
        return np.where(n > 0, w * np.nan_to_num(s) + (1 - w) * a, a)
    return np.where(n >= enough, s, a)


@pytest.mark.parametrize("blend", [False, True])
def test_fused_texture(spark, blend):
    r = np.random.default_rng(1)
    cols = np.floor(r.uniform(40, 200, 12) * r.choice([0.5, 0.8, 1.0, 1.3, 2.5], 9)[:, None] + r.normal(0, 3, (9, 12))).clip(0, 255)
    cols[r.random((9, 12)) < 0.3] = np.nan
    cols[8, 4:] = np.nan  # too few pixels for a gain
    sharp = np.array([k % 2 == 0 for k in range(9)])
    rows = [(c, k, float(cols[k, c]), bool(sharp[k])) for k in range(9) for c in range(12) if np.isfinite(cols[k, c])]
    got = C.fuse_texture(spark.createDataFrame(rows, "c int, k int, g double, s boolean"), ["c"], "k", "g", least=5, sharp="s", enough=3, blend=blend)
    want = plain_texture(cols, sharp, 3, blend)
    assert {x.c: x.value for x in got.collect()} == {c: pytest.approx(want[c]) for c in range(12)}


def test_shifts_bands_profiles(spark):
    d = spark.createDataFrame([(0, k, float(k)) for k in range(4) for _ in range(3 if k != 2 else 1)], "g int, k int, s double")
    assert [r.shift for r in C.carried_shift(d, ["g"], "k", "s", 2).orderBy("k").collect()] == [0, 1, 1, 4]
    bands = spark.createDataFrame([("a", 0, 2), ("b", 1, 4)], "band string, lo int, hi int")
    got = {r.band: (r["median"], r.n) for r in C.nested_band_medians(d, bands, ["g"], "k", "s").collect()}
    assert got == {"a": (0.5, 6), "b": (2.0, 7), None: (1.0, 10)}
    obs = spark.createDataFrame([(0, n, 2.0) for n in (0, 4) for _ in range(5)] + [(0, 2, 99.0)], "g int, node int, r double")
    nodes = spark.createDataFrame([(0, n) for n in range(5)], "g int, node int")
    assert {r.node: r.radius for r in C.radius_profile(obs, nodes, ["g"], "node", "r", 0.5, 1.8).collect()} == {n: 1.8 for n in range(5)}


def test_surfaces(spark):
    px = spark.createDataFrame([(0, 1.0, 2.0, True), (0, 3.0, 2.0, False), (0, 1.0, None, True), (0, None, 1.0, False)], "k int, z double, z_other double, seen boolean")
    r = C.occlusion(px, ["k"]).first()
    assert (r.in_front, r.seen_share, r.n_both) == (0.5, pytest.approx(2 / 3), 2)
    assert C.behind_share(px, ["k"], F.col("z") - 2, only=F.col("seen")).first().behind == 0
    blob = spark.createDataFrame([(0, u, v) for u in range(6) for v in range(6) if (u, v) != (3, 3)] + [(0, 30, 30), (70, 40, 40)], "k int, u int, v int")
    full = C.amodal(blob, blob, 60, 64)
    assert full.count() == 36
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    pose = spark.createDataFrame([(0, eye, 100.0, None), (1, eye, 100.0, (0.1, 0.0, 0.0))], "k int, rot array<double>, f double, pos struct<x:double,y:double,z:double>")
    img = spark.createDataFrame([(k, u, v, 1.0, float(u * u + v)) for k in (0, 1) for u in range(30) for v in range(20)], "k int, u int, v int, z double, g double")
    w = C.warp(img, pose, 0, 1, 15.0, 10.0, 30, 20)
    assert w.count() == 20 * 20 and {r.d for r in w.select((F.col("u") - F.col("wu")).alias("d")).collect()} == {10}
    moved = img.where("k = 0").select((F.col("u") - 10).alias("u"), "v", "g")
    n = C.warped_correlation(moved, w, img, 0, 0.05, 600).first()
    assert n.ncc == pytest.approx(1) and n.n == 400
    cols = "p int, px double, py double, pz double, face long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    tri = [(0, 0.2, 0.2, 2.0, 7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0, 0.2, 0.2, 2.0, 3, 9.0, 9.0, 9.0, 8.0, 9.0, 9.0, 9.0, 8.0, 9.0)]
    assert C.closest_faces(spark.createDataFrame(tri, cols), ["p"]).first().asDict() == {"p": 0, "d": 2.0, "face": 7}


def test_cables_gaps_tools(spark):
    rest = spark.createDataFrame([(n, float(n), 0.0, 0.0) for n in range(4)], "node int, x double, y double, z double")
    rec = rest.withColumn("k", F.lit(0)).unionByName(rest.withColumn("y", F.lit(1.0)).withColumn("k", F.lit(1)))
    r = C.cable_report(rec, rec, rest, rest.where("node = 0")).first()
    assert (r.error, r.explained, r.length_min, r.length_max) == (0, 1, 1, 1)
    held = C.cable_report(rest.withColumn("k", F.lit(1)), rec, rest, rest.where("node = 0")).first()
    assert held.explained == pytest.approx(0) and held.error == 1
    g = C.gap_summary(spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, None), (0, 2, 5.0)], "g int, k int, d double"), ["g"], "d", "k").first()
    assert (g["median"], g["max"], g.frames) == (3.5, 5.0, 2)
    px = spark.createDataFrame([(0, k, u, v) for k in (0, 1, 3) for u in range(0, 81) for v in range(28, 32)], "g int, k int, u int, v int")
    t = C.instrument_track(px, ["g"], "k", 200, 100, 5).orderBy("k").collect()
    assert [x.visible for x in t] == [True, True, False, True, False] and all(79 < x.tu <= 80 and 0 <= x.eu < 1 and x.du == pytest.approx(1) and x.depth is None for x in t)
    near = C.instrument_track(px, ["g"], "k", 200, 100, 5, depth=px.withColumn("z", F.col("u") / 100)).collect()
    assert all(0.68 < x.depth < 0.78 for x in near)


def test_depth_and_offsets(spark):
    px = spark.createDataFrame([(0, u, v, 3.0) for u in range(5) for v in range(3)], "k int, u int, v int, disp double")
    affine = spark.createDataFrame([(0, 1.0, 1.0)], "k int, a double, b double")
    grid = spark.createDataFrame([(0, gu, gv, float(gu)) for gu in range(3) for gv in range(2)], "k int, gu int, gv int, c double")
    import math

    assert {(r.u, r.v): r.z for r in C.corrected_depth(px, affine, grid, 5, 3, 3, 2).collect()} == {(u, v): pytest.approx(math.exp(u / 2) / 4) for u in range(5) for v in range(3)}
    bed = spark.createDataFrame([("a", 0, 10.0, 0.0, 2.0, None, None, None), ("b", 0, 10.0, 0.0, 2.0, 0.5, 0.0, 0.1)], "clip string, k int, du double, dv double, z double, x double, y double, z3 double")
    assert {r.clip: (r.dx, r.dz) for r in C.bed_shift(bed, 100.0).collect()} == {"a": (0.2, 0.0), "b": (0.5, 0.1)}
    off = spark.createDataFrame([(g, k, 2.0 if g else None, 1.0) for g in (0, 1) for k in range(9)], "g int, k int, s double, o double")
    assert {(r.g, round(r.offset, 9)) for r in C.depth_offsets(off, ["g"], "k", "s", "o").collect()} == {(0, 0.0), (1, 1.0)}


def test_paths_and_windows(spark):
    mask = spark.createDataFrame([(0, u, 5) for u in (11, 12, 13, 15)], "g int, u int, v int")
    ends = spark.createDataFrame([(0, 10.0, 5.0, 1.0, 0.0)], "g int, eu double, ev double, du double, dv double")
    assert [r.u for r in C.extend_path(ends, mask, ["g"]).orderBy("i").collect()] == [11, 12, 13]
    depth = spark.createDataFrame([(u, v, float(10 * u + v)) for u in range(5) for v in range(5)], "u int, v int, z double")
    at = spark.createDataFrame([(0, 2.2, 3.4), (1, 90.0, 0.0)], "key int, pu double, pv double")
    assert {r.key: r.z for r in C.window_min(at, depth, "key").collect()} == {0: 12.0, 1: None}
    gaps = spark.createDataFrame([(0, i, float(i)) for i in range(8)] + [(1, 0, 1.0)], "g int, i int, gap double")
    assert {r.g: r.gap for r in C.second_half_gap(gaps, ["g"], "i", "gap").collect()} == {0: 5.5, 1: None}
    assert C.free_space(spark.createDataFrame([(1.0, None), (1.0, 3.0)], "l double, r double"), "l", "r").orderBy("bound").collect()[1].bound == 3.0
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "condition string, s int"), spark.createDataFrame([("x", 9)], "condition string, t int")
    assert C.compare_conditions(a, b).count() == 1


def test_orientation_and_frames(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "v long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 1)], "f long, a long, b long, c long")
    assert {(r.b, r.c) for r in C.oriented_faces(f, v, (0.0, 0.0, 5.0)).collect()} == {(1, 2)} and {(r.b, r.c) for r in C.oriented_faces(f, v, (0.0, 0.0, -5.0)).collect()} == {(2, 1)}
    n = spark.createDataFrame([(0, i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 0.0, 1.0), (2.0, 0.0, 2.0)])], "g int, node int, x double, y double, z double")
    s = C.view_frame(n, ["g"], (0.0, 0.0, 1.0)).orderBy("node").collect()
    assert all((r.sx, r.sy, r.sz) == (pytest.approx(0), pytest.approx(-1), pytest.approx(0)) for r in s)
