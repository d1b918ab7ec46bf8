"""Evaluations against NumPy over dense images."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import evaluations as E
from tidemark.operators import kernels as K
from tidemark.operators import mesh as M

H, W, N = 24, 30, 4


@pytest.fixture(scope="module")
def clip(spark):
    """Random blobs: drawn depth (inf: not drawn), mask, hidden pixels and measured depth of four frames; the last is empty."""
    r = np.random.default_rng(11)

    def blob(share):
        a = r.random((N, H, W))
        for _ in range(2):
            a = sum(np.roll(np.roll(a, i, 1), j, 2) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
        return a > np.quantile(a, 1 - share)

    drawn, mask, unknown, neighbour = blob(0.4), blob(0.4), blob(0.1), blob(0.2)
    drawn[:, 0], mask[:, 0] = False, False
    depth = 0.1 + 0.01 * r.random((N, H, W))
    z = np.where(drawn, depth + r.normal(0, 0.008, depth.shape), np.inf)
    drawn[3], mask[3], z[3] = False, False, np.inf
    px = lambda m, *more: [(int(k), int(u), int(v), *[float(x[k, v, u]) for x in more]) for k, v, u in np.argwhere(m)]
    flat = lambda m: spark.createDataFrame(px(m), "k int, u int, v int")
    deep = lambda m, x: spark.createDataFrame(px(m, x), "k int, u int, v int, z double")
    return {
        "np": dict(z=z, drawn=drawn, mask=mask, unknown=unknown, depth=depth, neighbour=neighbour),
        "frames": spark.range(N).select(F.col("id").cast("int").alias("k")),
        "rendered": deep(drawn, z), "mask": flat(mask), "unknown": flat(unknown), "depth": deep(np.ones_like(drawn), depth), "neighbour": flat(neighbour),
    }


def edge(m):
    """Pixels of a mask that lose a neighbour (outside the image counts as outside)."""
    p = np.pad(m, 1)
    inner = np.ones_like(m)
    for i in (0, 1, 2):
        for j in (0, 1, 2):
            inner &= p[i : i + m.shape[0], j : j + m.shape[1]]
    return m & ~inner


def plain_frame(c, k, least, empty, tol, cut=0.006, unknown=None):
    z, real, d = c["z"][k], c["mask"][k], c["depth"][k]
    drawn, valid = np.isfinite(z), ~(c["unknown"][k] if unknown is None else unknown)
    vis = drawn & (z < d + cut)
    a, b = vis & valid, real & valid
    both = drawn & real & valid
    bm, br = edge(vis) & valid, edge(real) & valid
    if bm.any() and br.any():
        vv, uu = np.mgrid[0:H, 0:W]
        near = lambda p, q: np.mean([((vv[q] - y) ** 2 + (uu[q] - x) ** 2).min() <= tol * tol for y, x in np.argwhere(p)])
        p, r = near(bm, br), near(br, bm)
        f = 2 * p * r / max(p + r, 1e-9)
    else:
        f = 0.0 if bm.any() or br.any() else empty
    return dict(
        iou=(a & b).sum() / (a | b).sum() if (a | b).any() else empty, boundary_f=f,
        depth_residual=np.median(np.abs(z - d)[both]) if both.sum() > least else None,
        cut_by_depth=(both & ~vis).sum() / max(both.sum(), 1), mesh_px=a.sum(), mask_px=b.sum(),
    )


def same(row, want):
    return all((row[n] is None and w is None) or (row[n] is not None and w is not None and row[n] == pytest.approx(float(w))) for n, w in want.items())


@pytest.mark.parametrize("least,empty", [(30, 0.0), (60, None)])
def test_frame_scores(clip, least, empty):
    got = {r.k: r for r in E.frame_scores(clip["frames"], clip["rendered"], clip["mask"], clip["depth"], clip["unknown"], 2, least, empty=empty).collect()}
    assert set(got) == set(range(N)) and all(same(got[k], plain_frame(clip["np"], k, least, empty, 2)) for k in range(N))


def test_tube_and_dual_scores(clip):
    c = clip["np"]
    got = {r.k: r for r in E.tube_scores(clip["frames"], clip["rendered"], clip["mask"], clip["depth"], clip["unknown"], clip["neighbour"], 2).collect()}
    for k in range(N):
        apart = plain_frame(c, k, 15, None, 2, unknown=c["unknown"][k] | (c["neighbour"][k] & ~c["mask"][k]))["iou"]
        assert same(got[k], {**plain_frame(c, k, 15, None, 2), "iou_apart": apart})
    both = E.dual_mask_scores(clip["frames"], clip["rendered"], {"a": clip["mask"], "b": clip["neighbour"]}, clip["depth"], {"a": clip["unknown"]}, 2, cover=clip["neighbour"]).collect()
    for r in both:
        a = plain_frame(c, r.k, 30, 0.0, 2)
        b = plain_frame({**c, "mask": c["neighbour"]}, r.k, 30, 0.0, 2, unknown=np.zeros((H, W), bool))
        cov = (c["drawn"][r.k] & c["neighbour"][r.k]).sum() / max(c["neighbour"][r.k].sum(), 1)
        assert r.iou_a == pytest.approx(a["iou"]) and r.iou_b == pytest.approx(b["iou"]) and r.boundary_f_b == pytest.approx(b["boundary_f"]) and r.covered == pytest.approx(cov)


def test_in_front_and_summaries(spark, clip):
    f = clip["rendered"].withColumn("z", F.col("z") - 0.004)
    got = {r.k: r for r in E.in_front_scores(clip["frames"], f, clip["rendered"]).collect()}
    assert got[0].overlap_px == clip["np"]["drawn"][0].sum() and got[0].front_share == 1 and got[0].front_max == pytest.approx(0.004) and got[3].overlap_px == 0
    scores = spark.createDataFrame([(0, 0.5, 1.0), (1, 0.7, None), (5, 0.9, 3.0)], "k int, iou double, boundary_f double")
    bands = spark.createDataFrame([("early", 0, 2), ("late", 2, 9), ("never", 20, 30)], "band string, lo int, hi int")
    rows = {(r.metric, r.band): r for r in E.silhouette_block(scores, bands, scores.select("k", (F.col("iou") / 2).alias("iou"))).collect()}
    assert rows["iou", "all"]["mean"] == pytest.approx(0.7) and rows["iou", "early"].n == 2 and rows["iou", "never"].n == 0 and rows["iou", "never"]["mean"] is None
    assert rows["boundary_f", "early"].n == 1 and rows["boundary_f", "all"].median == 2 and rows["static_iou", "all"].max == pytest.approx(0.45)


def test_outline_curve_and_condition(spark, clip):
    c = clip["np"]
    ref = c["depth"] + 0.002
    valid = c["neighbour"] | c["mask"]
    refs = spark.createDataFrame([(int(k), int(u), int(v), float(ref[k, v, u])) for k, v, u in np.argwhere(valid)], "k int, u int, v int, z double")
    got = {r.k: r for r in E.outline_curve(clip["frames"], clip["rendered"], clip["mask"], clip["unknown"], clip["depth"], {"stereo": refs}, least_mask=200).collect()}
    want = {}
    for k in range(N):
        if c["mask"][k].sum() >= 200:
            vis = ~c["unknown"][k]
            m, real = (c["z"][k] < c["depth"][k] + 0.004) & vis, c["mask"][k] & vis
            both = m & real
            want[k] = ((both.sum() / max((m | real).sum(), 1)), np.median(np.abs(c["z"][k] - c["depth"][k])[both]), np.median(np.abs(c["z"][k] - ref[k])[both & valid[k]]) if (both & valid[k]).sum() > 50 else None)
    assert set(got) == set(want) and len(want) >= 2
    for k, (iou, mono, stereo) in want.items():
        assert got[k].iou == pytest.approx(iou) and got[k].depth_err_monocular == pytest.approx(mono) and (got[k].depth_err_stereo is None if stereo is None else got[k].depth_err_stereo == pytest.approx(stereo))
    errors = spark.createDataFrame([(t, s, k, float(t + k), float(t + 2 * k)) for t in range(4) for s in (0, 5) for k in range(1, 4)], "track int, seed int, k int, e double, e_static double")
    doc = E.condition_evaluation(E.outline_curve(clip["frames"], clip["rendered"], clip["mask"], clip["unknown"], clip["depth"], least_mask=200), errors).first()
    assert doc.outline_iou == pytest.approx(np.mean([w[0] for w in want.values()])) and doc.depth_err_monocular == pytest.approx(np.mean([w[1] for w in want.values()]))
    assert (doc.track_err, doc.n_samples, doc.n_seeds, doc.n_tracks, doc.seeds_better_than_static, doc.n_samples_first_seed) == (3.5, 24, 2, 8, 2, 12)
    assert [(x.k, x.iou) for x in doc.iou_curve] == [(k, pytest.approx(want[k][0])) for k in sorted(want)] and [x.value for x in doc.depth_curve_monocular] == [pytest.approx(want[k][1]) for k in sorted(want)]
    assert [(x.seed, x.sim, x.static, x.n) for x in doc.track_by_seed] == [(0, 3.5, 5.5, 12), (5, 3.5, 5.5, 12)]
    starts = spark.createDataFrame([(t, s) for t in range(6) for s in (0, 5, 9)], "track int, seed int")
    counted = E.condition_evaluation(E.outline_curve(clip["frames"], clip["rendered"], clip["mask"], clip["unknown"], clip["depth"].limit(0), least_mask=200), errors, starts.where("seed < 9"), starts).first()
    assert (counted.n_tracks, counted.n_seeds, counted.outline_iou, counted.depth_err_monocular) == (12, 3, 0.0, None)  # no wall: nothing is seen
    tex = E.texture_tracking(errors, errors.select("seed", F.when(F.col("seed") == 5, F.col("e") + 50).otherwise(F.col("e")).alias("e")), 15.0).first()
    assert tex.n == 1 and tex.value == 3.5 and tex.baseline == 53.5 and tex.change == pytest.approx((3.5 / 53.5 - 1) * 100)


def test_tracks_on_faces(spark):
    cols = "k int, face long, ax double, ay double, bx double, by double, cx double, cy double"
    tri = lambda k, s: (k, 0, 0.0 + s, 0.0, 10.0 + s, 0.0, 0.0 + s, 10.0)
    corners = spark.createDataFrame([tri(k, 2.0 * k) for k in range(4)], cols)
    still = spark.createDataFrame([(0, *tri(k, 0.0)) for k in range(4)], "seed int, " + cols)
    seen = spark.createDataFrame([(0, u, v, 0) for u in range(11) for v in range(11 - u)], "k int, u int, v int, face long")
    starts = spark.createDataFrame([(0, 0, 2.0, 3.0), (1, 0, 30.0, 3.0)], "track int, seed int, u double, v double")
    bound = E.bound_tracks(starts, seen, corners)
    b = bound.collect()
    assert len(b) == 1 and (b[0].w0, b[0].w1, b[0].w2) == pytest.approx((0.5, 0.2, 0.3))
    tracks = spark.createDataFrame([(0, 0, k, 2.0 + 1.5 * k, 3.0) for k in range(4)], "track int, seed int, k int, u double, v double")
    got = {r.k: (r.e, r.e_static) for r in E.track_errors(bound, tracks, corners, still).collect()}
    assert got == {k: (pytest.approx(0.5 * k), pytest.approx(1.5 * k)) for k in (1, 2, 3)}


def test_flow_errors(spark):
    r = np.random.default_rng(5)
    q0, q1, qs = (r.uniform(0, 40, (6, 2)) for _ in range(3))
    f = np.array([(0, 1, 2), (2, 3, 4), (3, 4, 5)])
    ids, flow = r.integers(0, 3, 60), r.normal(0, 5, (60, 2))
    pts = lambda q: spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(q)], "k int, v long, u double, w double")
    px = spark.createDataFrame([(0, i, 0, int(x)) for i, x in enumerate(ids)] + [(1, 0, 0, 0)], "k int, u int, v int, face long")
    fl = spark.createDataFrame([(0, i, 0, *map(float, x)) for i, x in enumerate(flow)] + [(1, 0, 0, 1.0, 1.0)], "k int, u int, v int, du double, dv double")
    faces = spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(f)], "f long, a long, b long, c long")
    (got,) = E.flow_errors(px, faces, pts(q0), pts(q1), pts(qs), fl).collect()
    err = lambda q: np.median(np.linalg.norm((q - q0)[f[ids]].mean(1) - flow, axis=1))
    assert got.epe == pytest.approx(err(q1)) and got.epe_static == pytest.approx(err(qs)) and got.n == 60


def cube(spark, frames):
    v = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    f = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    t = [(0, 1, 3, 5), (0, 3, 2, 6), (0, 5, 6, 4), (3, 5, 6, 7), (0, 3, 5, 6)]
    rest = spark.createDataFrame([(i, *p) for i, p in enumerate(v.tolist())], "v long, x double, y double, z double")
    verts = spark.createDataFrame([(k, i, *p) for k, fr in enumerate(frames(v)) for i, p in enumerate(fr.tolist())], "k int, v long, x double, y double, z double")
    return v, rest, verts, spark.createDataFrame([(i, *x) for i, x in enumerate(f)], "f long, a long, b long, c long"), spark.createDataFrame([(i, *x) for i, x in enumerate(t)], "t long, a long, b long, c long, d long")


def turned(v, a, s=1.0, t=(0.0, 0.0, 0.0)):
    m = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    return s * v @ m.T + t


def test_strain_by_singular_values(spark):
    """Against the deformation of each cell worked out by NumPy: random bodies, one with slivers, some cells turned over."""
    r = np.random.default_rng(8)
    rest = r.normal(size=(12, 3))
    rest[4:8, 2] *= 1e-4
    tets = np.array([r.choice(12, 4, replace=False) for _ in range(15)] + [[4, 5, 6, 7]])
    frames = np.array([rest + s * r.normal(size=rest.shape) for s in (0.0, 0.05, 0.6)])
    table = lambda x, k=(): [(*k, i, *map(float, p)) for i, p in enumerate(x)]
    a = spark.createDataFrame(table(rest), "v long, x double, y double, z double")
    b = spark.createDataFrame([q for k, f in enumerate(frames) for q in table(f, (k,))], "k int, v long, x double, y double, z double")
    t = spark.createDataFrame([(i, *map(int, q)) for i, q in enumerate(tets)], "t long, a long, b long, c long, d long")
    box = lambda x: (x[tets[:, 1:]] - x[tets[:, :1]]).transpose(0, 2, 1)
    far = np.array([max(np.linalg.norm(rest[i] - rest[j]) for i in q for j in q) for q in tets])
    well = np.abs(np.linalg.det(box(rest))) / 6 / far**3 >= 0.01
    got = {x.k: x for x in E.tet_strain(a, b, t).collect()}
    for k, f in enumerate(frames):
        g = box(f) @ np.linalg.inv(box(rest))
        det, top = np.linalg.det(g), np.linalg.svd(g, compute_uv=False)[:, 0]
        assert got[k].min_det == pytest.approx(det.min(), rel=1e-6) and (got[k].inverted, got[k].inverted_well) == ((det <= 0).sum(), ((det <= 0) & well).sum())
        assert got[k].principal == pytest.approx(np.abs(top - 1).max(), rel=1e-5, abs=1e-6)
    assert E.slivers(a, t).first().slivers == (~well).sum() > 0


def test_gaps_between_parts(spark):
    """A cube that a duct starts beside, runs into and leaves, a sheet on its side, held by a tool; one frame without the duct."""
    v, rest, verts, faces, _ = cube(spark, lambda v: [v, v + [1.0, 0.0, 0.0]])
    ducts = spark.createDataFrame([(0, "a", 0, 1.25, 0.5, 0.5), (0, "a", 1, 0.5, 0.5, 0.5), (0, "a", 2, 0.5, 0.5, 2.0), (0, "b", 0, 0.5, 0.5, -0.1), (0, "b", 1, 0.5, 0.5, 0.9995)], "k int, duct string, node int, x double, y double, z double")
    flat = [(0, 0.5, 1.2, 0.5), (1, 0.4, 1.4, 0.5), (2, 0.5, 0.9, 0.5), (3, 0.5, 1.5, 0.5), (4, 3.0, 0.0, 0.0), (5, 5.0, 0.0, 0.0)]
    sheet = spark.createDataFrame([(k, i, x + k, y, z) for k in range(2) for i, x, y, z in flat], "k int, v long, x double, y double, z double")
    attached = spark.createDataFrame([(0, "body"), (1, "body"), (3, "backdrop"), (4, "left"), (5, "left")], "v long, target string")
    tip = spark.createDataFrame([(0, 4.0, 3.0, 0.0), (1, 5.0, 0.0, 0.0)], "k int, x double, y double, z double")
    got = {r.metric: (r.median, r["max"], r.n) for r in E.anatomy_gaps(verts, faces, ducts, sheet, attached, tip).collect()}
    assert got == {
        "duct_start_gap": (pytest.approx(0.25), pytest.approx(0.25), 1), "duct_nodes_inside": (pytest.approx(1 / 3), pytest.approx(1 / 3), 1),
        "sheet_base_gap": (pytest.approx(0.3), pytest.approx(0.3), 2), "sheet_inside": (pytest.approx(0.5), pytest.approx(0.5), 2), "jaw_tip": (pytest.approx(1.5), pytest.approx(3.0), 2),
    }
    assert {r.metric for r in E.anatomy_gaps(verts, faces, ducts, None, None, None).collect()} == {"duct_start_gap", "duct_nodes_inside"}
    assert E.anatomy_gaps(verts, faces, None, None, None, None).count() == 0


def test_instruments(spark):
    tips = spark.createDataFrame([("probe", k, float(k), 0.0, 0.0) for k in range(4)] + [("grasp", 0, 0.0, 3.0, 4.0)], "tool string, k int, x double, y double, z double")
    planned = spark.createDataFrame([(t, k, 0.0, 0.0, 0.0) for t in ("probe", "grasp") for k in range(4)], tips.schema)
    forces = spark.createDataFrame([("probe", k, 0.5 * k) for k in range(4)], "tool string, k int, force double")
    bands = spark.createDataFrame([("a", 0, 2), ("b", 8, 9)], "band string, lo int, hi int")
    got = {(r.metric, r.band): r for r in E.instrument_block(tips, planned, forces, bands).collect()}
    assert got["probe_tip_lag", "all"].median == 1.5 and got["grasp_tip_lag", "all"].max == 5 and got["probe_force", "a"].n == 2 and got["probe_force", "b"].n == 0
    assert ("probe_tip_lag", "a") not in got


def test_bodies(spark, clip):
    frames = lambda v: [turned(v, 0.2 * k, t=(0.1 * k, 0.0, 0.0)) for k in range(3)] + [v * [1.0, 1.0, 2.0]]
    v, rest, verts, faces, tets = cube(spark, frames)
    fr = np.array(frames(v))
    one = E.temporal_scores(verts).first()
    vel, acc = np.linalg.norm(np.diff(fr, axis=0), axis=2), np.linalg.norm(np.diff(fr, n=2, axis=0), axis=2)
    assert one.max_speed == pytest.approx(vel.max()) and one.p99_speed == pytest.approx(np.percentile(vel, 99)) and one.mean_speed == pytest.approx(vel.mean()) and one.max_accel == pytest.approx(acc.max())
    cen = fr.mean(1)
    assert one.centroid_path == pytest.approx(np.linalg.norm(np.diff(cen, axis=0), axis=1).sum()) and one.range_z == pytest.approx(np.ptp(cen[:, 2]))
    rig = {r.k: r for r in E.rigid_remainder(rest, verts).collect()}
    assert rig[2].degrees == pytest.approx(math.degrees(0.4)) and rig[2].rms == pytest.approx(0, abs=1e-9) and rig[2].shift == pytest.approx(np.linalg.norm(cen[2] - cen[0])) and rig[3].max > 0.2
    strain = {r.k: r for r in E.tet_strain(rest, verts, tets).collect()}
    assert strain[1].min_det == pytest.approx(1) and strain[3].min_det == pytest.approx(2) and strain[3].inverted == 0
    assert strain[1].principal == pytest.approx(0, abs=1e-7) and strain[3].principal == pytest.approx(1)
    rows = {(r.metric, r.band): r for r in E.body_evaluation({"own": E.frame_scores(clip["frames"], clip["rendered"], clip["mask"], clip["depth"], clip["unknown"])}, rest, verts, faces, tets).collect()}
    assert rows["own_iou", "all"].n == N and rows["volume_ratio", "all"].max == pytest.approx(2) and rows["stretch_max", "all"].max == pytest.approx(2) and rows["degrees", "all"].max >= 20
    err = E.recorded_errors(verts, verts, rest)
    assert E.motion_explained(err).first().explained == pytest.approx(1)
    some = {r.k: r.e_static for r in E.recorded_errors(verts, verts, rest, rest.where("v < 2")).collect()}
    assert some[1] == pytest.approx(np.linalg.norm(fr[1, :2] - v[:2], axis=1).mean())
    bands = spark.createDataFrame([("a", 0, 2)], "band string, lo int, hi int")
    doc = {(r.metric, r.band): r for r in E.tissue_evaluation(clip["frames"], bands, {"sim": E.frame_scores(clip["frames"], clip["rendered"], clip["mask"], clip["depth"])}, verts, rest, faces, verts).collect()}
    assert doc["sim_iou", "a"].n == 2 and doc["motion_explained", "all"]["mean"] == pytest.approx(1) and doc["area", "all"].min == pytest.approx(6) and doc["fold_p90", "all"]["mean"] == pytest.approx(90)
    states = spark.createDataFrame([(s, 0, float(s)) for s in range(11)], "step long, v long, x double")
    at = {r.k: r.x for r in E.to_frames(states, clip["frames"], 10.0, 0.05, 11).collect()}
    assert at == {k: float(min(round(k / 10 / 0.05), 10)) for k in range(N)}


def test_sheets(spark, clip):
    frames = lambda v: [v + [0, 0, 0.1 * k] for k in range(3)]
    v, rest, verts, faces, _ = cube(spark, frames)
    s = E.frame_scores(clip["frames"], clip["rendered"], clip["mask"], clip["depth"])
    px = E.pixel_table(clip["frames"], clip["rendered"], clip["mask"], clip["depth"]).withColumn("face", F.col("u") % 2)
    split = E.split_depth(px, spark.createDataFrame([(0, 0.2), (1, 0.8)], "face int, s double"))
    c = clip["np"]
    lower = c["drawn"][0] & c["mask"][0] & (np.arange(W) % 2 == 1)
    got = {r.k: r for r in split.collect()}
    assert got[0].lower == pytest.approx(np.median(np.abs(c["z"][0] - c["depth"][0])[lower]))
    doc = E.sheet_evaluation(s, s, split, verts, rest, faces, rest.where("z = 1").select("v"), rest.where("z = 0").select("v"), spark.createDataFrame([(0, 1.0, 1.0, 4.0, 5.0)], "k int, u double, v double, pu double, pv double"), {"there": spark.createDataFrame([(0, 2.0)], "k int, value double"), "gone": None})
    rows = {r.metric: r for r in doc.collect()}
    assert rows["lift"]["mean"] == pytest.approx(1) and rows["apex_to_image"]["mean"] == 5 and rows["accel"]["mean"] == pytest.approx(0, abs=1e-9) and rows["stretch_p05"]["mean"] == pytest.approx(1)
    assert rows["there"].median == 2 and rows["gone"].n == 0 and "missing" in rows["gone"].error
    rep = {(r.version, r.metric): r for r in E.surface_report(clip["frames"], {"new": clip["rendered"]}, clip["mask"], clip["rendered"].withColumn("z", F.col("z") - 0.001).where("u < 15"), clip["unknown"]).collect()}
    left = (c["drawn"] & (np.arange(W) < 15)).sum((1, 2)) / np.maximum(c["drawn"].sum((1, 2)), 1)
    assert rep["new", "hidden_share"]["mean"] == pytest.approx(left.mean())


def test_backdrop(spark, clip):
    c, r = clip["np"], np.random.default_rng(9)
    gi, gr, spec = r.uniform(0, 255, (N, H, W)), r.uniform(0, 255, (N, H, W)), r.random((N, H, W)) < 0.1
    full = [(int(k), int(u), int(v)) for k in range(N) for v in range(H) for u in range(W)]
    images = spark.createDataFrame([(k, u, v, float(gi[k, v, u]), bool(spec[k, v, u])) for k, u, v in full], "k int, u int, v int, g double, specular boolean")
    rendered = spark.createDataFrame([(k, u, v, float(c["z"][k, v, u]), float(gr[k, v, u])) for k, u, v in full if c["drawn"][k, v, u]], "k int, u int, v int, z double, g double")
    got = {x.k: x for x in E.backdrop_scores(clip["frames"], rendered, clip["mask"], clip["depth"], images, clip["mask"], clip["unknown"]).collect()}
    for k in range(N):
        both = c["drawn"][k] & c["mask"][k]
        assert got[k].coverage == pytest.approx(both.sum() / max(c["mask"][k].sum(), 1))
        if both.sum() > 50:
            dz = (c["z"][k] - c["depth"][k])[both]
            ph = both & ~spec[k]
            a, b = gr[k][ph] - gr[k][ph].mean(), gi[k][ph] - gi[k][ph].mean()
            assert (got[k].depth_bias, got[k].depth_p90, got[k].front_violation) == pytest.approx((np.median(dz), np.percentile(np.abs(dz), 90), (dz < -0.005).mean()))
            assert got[k].photo_l1 == pytest.approx(np.abs(gr[k] - gi[k])[ph].mean()) and got[k].photo_ncc == pytest.approx((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean() + 1e-9))
    rep = {(x.metric, x.band): x for x in E.backdrop_report(E.backdrop_scores(clip["frames"], rendered, clip["mask"], clip["depth"], images, clip["mask"], clip["unknown"]), baseline=spark.createDataFrame([(0, 0.25)], "k int, coverage double").join(clip["frames"].limit(0).select("k"), "k", "left").select("k", "coverage", *[F.lit(0.0).alias(n) for n in ("depth_med", "depth_bias", "depth_p90", "front_violation", "organ_violation", "organ_gap", "photo_l1", "photo_ncc", "frame_iou")])).collect()}
    assert rep["coverage", "all"].change == pytest.approx(np.mean([got[k].coverage for k in range(N)]) - 0.25)
    ways = {"a": [(0, 1, u, v, float(u)) for u in range(30) for v in range(20)], "b": [(0, 1, u, v, 2.0 * u) for u in range(5, 30) for v in range(20)] + [(0, 2, 1, 1, 3.0)]}
    warps = {n: spark.createDataFrame(x, "i int, j int, u int, v int, g double") for n, x in ways.items()}
    img = spark.createDataFrame([(0, u, v, float(u)) for u in range(30) for v in range(20)], "k int, u int, v int, g double")
    w = {x.way: x for x in E.warp_consistency(warps, img, 500).collect()}
    assert w["a"].n == w["b"].n == 500 and w["a"].l1 == 0 and w["a"].ncc == pytest.approx(1) and w["b"].l1 == pytest.approx(np.mean(range(5, 30)))


def test_interaction(spark):
    indent = [None, -3.0, 1.0, 2.0, 6.0, 7.0, 8.0, 9.0, None, 7.0, 1.0, -5.0, -6.0, -7.0, -8.0]
    seen = [i not in (0,) for i in range(15)]
    track = spark.createDataFrame([("p", k, x, s, "gb" if k < 8 else "liver") for k, (x, s) in enumerate(zip(indent, seen))], "tool string, k int, indent double, visible boolean, label string")
    facts, runs, labels = E.interaction_facts(track)
    f = [r.asDict() for r in facts.orderBy("k").collect()]
    filled = np.interp(range(15), [i for i, x in enumerate(indent) if x is not None], [x for x in indent if x is not None])
    smooth = [float(np.median(np.pad(filled, 3, mode="edge")[i : i + 7])) for i in range(15)]
    assert [x["smooth"] for x in f] == pytest.approx(smooth)
    on = [s and x > -1 for s, x in zip(seen, smooth)]
    assert [x["contact"] for x in f] == on
    assert {(r.what, r.start, r.end) for r in runs.collect()} >= {("contact", min(i for i, x in enumerate(on) if x), max(i for i, x in enumerate(on) if x))}
    assert sum(r.n for r in labels.collect()) == sum(on)
    rep = {(r.metric, r.part): r for r in E.interaction_report(facts, ["smooth"], after=10).collect()}
    assert rep["smooth", "contact"].n == sum(on) and rep["smooth", "after"].n == 5


def test_depth_evidence(spark):
    samples = spark.createDataFrame([(0, i, 1.0 + 0.1 * i, 0.9) for i in range(7)] + [(1, 0, 1.0, 0.5)], "k int, i int, tissue double, shaft double")
    away = {r.k: r.away for r in E.free_space_bound(samples, 0.002).collect()}
    assert away == {0: pytest.approx(np.percentile([1.0 + 0.1 * i - 0.9 - 0.002 for i in range(3, 7)], 20)), 1: None}
    widths = spark.createDataFrame([(0, float(s), 20 - 0.1 * s) for s in range(0, 50, 10)] + [(1, 0.0, 9.0)], "k int, s double, w double")
    z = {r.k: r.z for r in E.width_only_depth(widths, spark.createDataFrame([(0, 500.0, 60.0), (1, 500.0, 1.0)], "k int, f double, s_end double"), 0.005).collect()}
    assert z == {0: pytest.approx(500 * 0.005 / 14), 1: None}
    around = spark.createDataFrame([(0, True, 0.2), (0, True, 0.3), (0, False, 0.9), (1, False, 0.5), (1, True, 0.2), (1, False, 0.5)], "k int, is_sheet boolean, z double")
    sheet = E.under_sheet(around)
    assert {r.k: (r.under, r.sheet_z) for r in sheet.collect()} == {0: (True, 0.25), 1: (False, None)}
    frames = spark.range(2).select(F.col("id").cast("int").alias("k"))
    per, doc = E.depth_evidence(frames, spark.createDataFrame([(0, 0.26), (1, 0.3)], "k int, z double"), E.free_space_bound(samples, 0.002), E.width_only_depth(widths, spark.createDataFrame([(0, 500.0, 60.0)], "k int, f double, s_end double"), 0.005), sheet, frames)
    p = {r.k: r for r in per.collect()}
    assert p[0].toward_max == pytest.approx(0.01) and p[1].toward_max is None
    d = {r.metric: r["mean"] for r in doc.collect()}
    assert d["consistent_share"] == 0.5 and d["under_frames"] == 1
    tip = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 10.0, 10.0, 2.0)], "k int, x double, y double, z double, u double, v double, depth double")
    r = E.tip_track(tip, tip.withColumn("y", F.lit(2.0)).withColumn("u", F.lit(13.0)).withColumn("v", F.lit(14.0)).withColumn("depth", F.lit(3.0))).first()
    assert (r.z_tip, r.z_target, r.d, r.px) == (2.0, 3.0, 2.0, 5.0)


def test_runs_and_shapes(spark, clip):
    c = clip["np"]
    runs = spark.createDataFrame([("r1", "gb", 11), ("r2", "gb", 11)], "run string, tissue string, steps int")
    states = spark.createDataFrame([(n, "gb", s, 0, float(s), 0.0, 0.0) for n in ("r1", "r2") for s in range(11)], "run string, tissue string, step long, v long, x double, y double, z double")
    draw = lambda t: t.where("run = 'r1'").select("run", "tissue", "k").distinct().join(clip["rendered"].drop("face").withColumnRenamed("z", "zz"), "k").select("run", "tissue", "k", "u", "v", F.col("zz").alias("z"))
    got = {(r.run, r.k): r.iou for r in E.hold_out_scores(runs, states, clip["frames"], 10.0, 0.05, draw, clip["mask"].withColumn("tissue", F.lit("gb")), clip["depth"], clip["unknown"]).collect()}
    assert len(got) == 2 * N
    for k in range(N):
        assert got["r1", k] == pytest.approx(plain_frame(c, k, 30, 0.0, 4)["iou"]) and got["r2", k] == 0
    shape = clip["rendered"].where("k = 0").select(F.lit("ball").alias("shape"), "u", "v", "z")
    mask, depth = clip["mask"].where("k = 0").drop("k"), clip["depth"].where("k = 0").drop("k")
    per, scale = E.shape_study(shape, mask, depth, depth.withColumn("z", F.col("z") * 1.1))
    r, s = per.first(), scale.first()
    both = c["drawn"][0] & c["mask"][0]
    assert r.outline_iou == pytest.approx(both.sum() / (c["drawn"][0] | c["mask"][0]).sum()) and r.n_px == both.sum() and s.scale_ratio == pytest.approx(1.1)
    assert r.depth_err_reference == pytest.approx(np.median(np.abs(c["z"][0] - 1.1 * c["depth"][0])[both])) and E.shape_study(shape, mask, depth)[1] is None


# ---- drawing


def plain_paint(tri, width, height):
    out = {}
    order = sorted(range(len(tri)), key=lambda i: (-np.mean(tri[i][:, 2]), -i))
    for i in order:
        p = np.trunc(tri[i][:, :2]).astype(int)
        if (tri[i][:, 2] <= 0).any():
            continue
        rows = {}
        for a, b in ((0, 1), (1, 2), (2, 0)):
            n = int(np.abs(p[b] - p[a]).max())
            for s in range(n + 1):
                q = np.floor(p[a] + (s / n if n else 0.0) * (p[b] - p[a]) + 0.5).astype(int)
                rows.setdefault(q[1], []).append(q[0])
        for y, xs in rows.items():
            for x in range(min(xs), max(xs) + 1):
                if 0 <= x < width and 0 <= y < height:
                    out[x, y] = (i, float(np.mean(tri[i][:, 2])))
    return out


def test_drawing(spark):
    r = np.random.default_rng(8)
    tri = np.concatenate([r.uniform(-5, 35, (30, 3, 2)), r.uniform(-0.02, 1, (30, 3, 1))], 2)
    cols = "k int, face long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    df = spark.createDataFrame([(0, i, *map(float, t.ravel())) for i, t in enumerate(tri)], cols)
    got = {(p.u, p.v): (p.face, p.z) for p in K.paint(df, ["k"], 30, 24).collect()}
    want = plain_paint(tri, 30, 24)
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and got[q][1] == pytest.approx(want[q][1]) for q in want)
    z = {}
    for i, t in enumerate(tri):
        if (t[:, 2] <= 0).any():
            continue
        for u in range(30):
            for v in range(24):
                w = np.linalg.solve(np.vstack([t[:, :2].T, np.ones(3)]), [u, v, 1])
                if (w >= 0).all():
                    z.setdefault((u, v), []).append((1 / (w / t[:, 2]).sum(), i))
    got = {(p.u, p.v): p for p in K.rasterize(df, ["k"], 30, 24, far=True).collect()}
    assert got.keys() == z.keys() and all(got[q].face == min(z[q])[1] and got[q].depth == pytest.approx(min(z[q])[0]) and got[q].far_depth == pytest.approx(max(z[q])[0]) for q in z)
    a = spark.createDataFrame([(0, 1, 1, 5, 2.0), (0, 2, 1, 6, 1.0)], "k int, u int, v int, face long, z double")
    both = {(p.u, p.layer, p.face, p.id) for p in K.composite(a, a.withColumn("z", F.lit(1.0))).collect()}
    assert both == {(1, 1, 5, 2**32 + 5), (2, 0, 6, 6)}


def test_distances_and_hits(spark):
    r = np.random.default_rng(12)
    tri, pts = r.normal(size=(40, 1, 3)) + 0.3 * r.normal(size=(40, 3, 3)), r.normal(size=(25, 3)) * 2
    cols = ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    faces = spark.createDataFrame([(0, i, *map(float, t.ravel())) for i, t in enumerate(tri)], "m int, face long, " + cols)
    got = {x.id: (x.d, x.face) for x in K.mesh_distances(spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)] + [(7, 0, 0.0, 0.0, 0.0)], "m int, id long, x double, y double, z double"), faces, ["m"]).where("m = 0").collect()}
    for i, p in enumerate(pts):
        d = K.triangle_distances(np.repeat(p[None], 40, 0), tri)
        assert got[i] == (pytest.approx(d.min()), int(d.argmin()))
        s = min(np.linalg.norm(p - (a + u * (b - a) + v * (c - a))) for a, b, c in tri for u in np.linspace(0, 1, 15) for v in np.linspace(0, 1 - u, 15))
        assert d.min() <= s + 1e-9 and d.min() > s - 0.15
    rays = spark.createDataFrame([(0, i, *map(float, p), *map(float, -p)) for i, p in enumerate(pts)], "m int, ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    hits = {x.ray: (x.t, x.face) for x in K.mesh_hits(rays, faces, ["m"]).collect()}
    pairs = rays.join(faces, "m").drop("m")
    assert hits == {x.ray: (pytest.approx(x.t), x.face) for x in K.ray_hits(pairs, ["ray"]).collect()} and len(hits) > 3
    n = 300
    s, q = r.normal(size=(n, 3)), np.concatenate([r.normal(size=(50, 3)), 30 + r.normal(size=(5, 3)), np.zeros((1, 3))])
    s[10], s[20] = s[5], s[5]
    at, d2 = K.CellIndex(s).nearest(np.concatenate([q, s[5:6]]))
    want = ((np.concatenate([q, s[5:6]])[:, None] - s[None]) ** 2).sum(2)
    assert (at == want.argmin(1)).all() and np.allclose(d2, want.min(1)) and at[-1] == 5


def test_height_fields(spark):
    r = np.random.default_rng(13)
    dom = [(x, y) for x in range(7) for y in range(6) if (x, y) not in ((3, 3), (3, 2))]
    n, at = len(dom), {c: i for i, c in enumerate(dom)}
    lap = np.zeros((n, n))
    for (x, y), i in at.items():
        for d in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            if (x + d[0], y + d[1]) in at:
                lap[i, i] += 1
                lap[i, at[x + d[0], y + d[1]]] -= 1
    known, z = r.random(n) < 0.4, r.normal(size=n)
    df = spark.createDataFrame([(0, *c, float(z[i]) if known[i] else None, float(0.1) if i % 3 == 0 else None) for c, i in at.items()], "g int, x int, y int, z double, lower double")
    for bi in (False, True):
        a = lap.T @ lap if bi else lap
        want = z.copy()
        want[~known] = np.linalg.solve(a[np.ix_(~known, ~known)], -a[np.ix_(~known, known)] @ z[known])
        assert {(p.x, p.y): p.z for p in K.harmonic_fill(df, ["g"], biharmonic=bi).collect()} == {c: pytest.approx(want[i], abs=1e-6) for c, i in at.items()}
    low = {(p.x, p.y): p.z for p in K.harmonic_fill(df, ["g"], lower=True, rounds=9).collect()}
    assert all(low[c] >= 0.1 - 1e-9 for c, i in at.items() if i % 3 == 0 and not known[i]) and all(low[c] == z[i] for c, i in at.items() if known[i])
    w = np.where(known, r.uniform(0.5, 2, n), 0.0)
    sm = df.withColumn("w", F.lit(0.0)).drop("w", "lower").join(spark.createDataFrame([(*c, float(w[i])) for c, i in at.items()], "x int, y int, w double"), ["x", "y"])
    want = np.linalg.solve(np.diag(w) + 0.3 * lap + 0.2 * lap.T @ lap, w * z)
    assert {(p.x, p.y): p.z for p in K.smooth_surface(sm, ["g"], 0.3, 0.2).collect()} == {c: pytest.approx(want[i], abs=1e-6) for c, i in at.items()}
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(i) if lap[i, j]], "a long, b long")
    fixed = r.random(n) < 0.2
    wt, target = r.uniform(0.1, 1, n), r.normal(size=n)
    verts = spark.createDataFrame([(0, i, float(wt[i]), float(target[i]), bool(fixed[i])) for i in range(n)], "k int, v long, w double, target double, fixed boolean")
    a = np.diag(wt) + 2.0 * lap
    want = np.zeros(n)
    want[~fixed] = np.linalg.solve(a[np.ix_(~fixed, ~fixed)], (wt * target)[~fixed])
    assert {p.v: p.offset for p in K.laplacian_offsets(verts, edges, ["k"]).collect()} == {i: pytest.approx(want[i], abs=1e-8) for i in range(n)}


def test_tet_measures_and_health(spark):
    _, rest, _, faces, tets = cube(spark, lambda v: [v])
    reg = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, -1.0, -1.0), (2, -1.0, 1.0, -1.0), (3, -1.0, -1.0, 1.0)], "v long, x double, y double, z double")
    r = M.tet_measures(reg, spark.createDataFrame([(0, 0, 2, 1, 3), (1, 0, 1, 2, 3)], "t long, a long, b long, c long, d long")).orderBy("t").collect()
    assert {round(abs(x.mean_ratio), 9) for x in r} == {1.0} and r[0].mean_ratio == -r[1].mean_ratio and all(x.min_dihedral == pytest.approx(math.degrees(math.acos(1 / 3))) and x.rel_volume == pytest.approx(1) for x in r)
    assert M.tet_measures(rest, tets).count() == 5
    h = M.mesh_health(rest, faces).first()
    assert h.watertight and h.n_components == 1 and h.n_faces == 12 and h.volume == pytest.approx(1)
    two = faces.unionByName(faces.select((F.col("f") + 100).alias("f"), *[(F.col(c) + 8).alias(c) for c in "abc"]))
    far = rest.unionByName(rest.select((F.col("v") + 8).alias("v"), (F.col("x") + 9).alias("x"), "y", "z"))
    assert M.mesh_health(far, two).first().n_components == 2 and G.norm is not None
