"""Documents put in place at once, tables as text, and the measures that exports are made of."""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import measures as M
from tidemark.operators import skeletons as S
from tidemark.sources import bundles as B
from tidemark.sources import sinks as K


def test_a_document_of_many_parts(spark, tmp_path):
    path = str(tmp_path / "out" / "scene.json")
    r = np.random.default_rng(1)
    x = {c: r.uniform(-0.6, 0.6, (n, 4, 3)) for c, n in (("a", 100), ("b", 7))}
    rows = [(c, k, v, *map(float, p)) for c, xs in x.items() for k, f in enumerate(xs) for v, p in enumerate(f)]
    states = spark.createDataFrame(rows, "condition string, k int, v int, x double, y double, z double").repartition(7)
    facts = spark.createDataFrame([("a", 0.5), ("b", None)], "condition string, iou double")
    index = spark.createDataFrame([("clip", 2)], "name string, n int")
    B.export_clip(path, "clip", states, facts, (-0.5, 0.5), index=(index, str(tmp_path / "index")))
    doc = json.load(open(path))
    assert doc["fields"] == {"name": "clip", "quant": [-0.5, 0.5], "conditions": [{"condition": "a", "iou": 0.5}, {"condition": "b"}]}
    fields, blocks = B.read_bundle(spark, path)
    got = {b.block: np.frombuffer(b.data, "<i2").reshape(-1, 4, 3) for b in blocks.collect()}
    assert all(np.array_equal(got[c], np.rint(np.clip(xs, -0.5, 0.5) * 65534)) for c, xs in x.items())
    assert fields.select(F.try_variant_get("fields", "$.name", "string")).first()[0] == "clip" and K.read_table(spark, str(tmp_path / "index")).count() == 1
    before = open(path).read()
    broken = states.withColumn("x", F.when(F.col("k") == 6, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        B.export_clip(path, "clip", broken, facts, (-0.5, 0.5))
    with pytest.raises(Exception, match="follow each other"):
        B.write_bundle(spark.createDataFrame([("a", 0, b"abc"), ("a", 2, b"d")], "block string, chunk int, data binary"), path)
    assert open(path).read() == before and os.listdir(tmp_path / "out") == ["scene.json"]
    B.write_bundle(spark.createDataFrame([], "block string, chunk int, data binary"), path)
    assert json.load(open(path)) == {"fields": {}, "blocks": {}}


def test_text_tables(spark):
    df = spark.createDataFrame([("b", 2, 0.12345), ("a", 2, None), ("c", 1, 7.0)], "name string, rank int, score double")
    got = [r.line for r in K.markdown_table(df, ["name", "score"], ["rank", "name"], 2).orderBy("ord").collect()]
    assert got == ["| name | score |", "|---|---|", "| c | 7.00 |", "| a | - |", "| b | 0.12 |"]
    flat = spark.createDataFrame([([[0.123456, float("nan")], [2.5]],)], "a array<array<double>>").select(K.rounded_flat(F.col("a"), 4).alias("f")).first().f
    assert flat == [0.1235, None, 2.5]


def test_tube_statistics(spark):
    r = np.random.default_rng(2)
    rest = np.cumsum(r.uniform(0.5, 1, (8, 3)), 0)
    x = rest + 0.1 * r.normal(size=(6, 8, 3))
    table = lambda rows, s: spark.createDataFrame(rows, s)
    nodes = table([(k, i, *map(float, p)) for k, f in enumerate(x) for i, p in enumerate(f)], "k int, node int, x double, y double, z double")
    still = table([(i, *map(float, p)) for i, p in enumerate(rest)], "node int, x double, y double, z double")
    got = M.tube_statistics(nodes, still, table([(i, float(i + 1)) for i in range(8)], "node int, r double")).first()
    seg, r0 = np.linalg.norm(np.diff(x, axis=1), axis=2), np.linalg.norm(np.diff(rest, axis=0), axis=1)
    length, speed = seg.sum(1), np.linalg.norm(np.diff(x, axis=0), axis=2).max(1)
    want = dict(length_rest=r0.sum(), length_min=length.min(), length_max=length.max(), length_std=length.std(), max_strain=np.abs(length / r0.sum() - 1).max(), stretch_max=(seg / r0).max(), stretch_p95_mean=np.percentile(seg / r0, 95, axis=1).mean())
    want |= dict(max_speed=speed.max(), p95_speed=np.percentile(speed, 95), max_accel=np.linalg.norm(np.diff(x, n=2, axis=0), axis=2).max(), radius_min=1, radius_median=4.5, radius_max=8)
    assert got.asDict() == pytest.approx(want)


def test_seen_cells_and_static_pixels(spark):
    corners = spark.createDataFrame([(0, 0, 2.0, 1.0), (0, 1, 9.0, 3.0), (0, 2, 6.0, 8.5), (0, 3, 1.0, 5.0), (1, 0, -3.0, -2.0), (1, 1, 2.5, -2.0), (1, 2, 2.5, 2.5), (1, 3, -3.0, 2.5)], "k int, i int, u double, v double")
    got = {tuple(r) for r in M.footprints(corners, 12, 9).collect()}
    quad = [(2.0, 1.0), (9.0, 3.0), (6.0, 8.5), (1.0, 5.0)]
    side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    inside = {(u, v) for u in range(12) for v in range(9) if all(side((u, v), quad[i], quad[(i + 1) % 4]) > 1e-9 for i in range(4))}
    assert inside <= got and {(u, v) for u in range(3) for v in range(3)} <= got and len(got - inside) <= 12 and all(0 <= u < 12 and 0 <= v < 9 for u, v in got)
    moving = [(0, "a", 10, 10), (0, "b", 20, 12), (1, "c", 8, 8)]
    free = M.static_anatomy(spark.createDataFrame([(0,), (1,)], "k int"), spark.createDataFrame(moving, "k int, obj string, u int, v int"), spark.createDataFrame([("a", 2), ("b", 5)], "obj string, radius int"), 30, 25)
    want = {(k, u, v) for k in (0, 1) for u in range(3, 27) for v in range(3, 22) if k or (max(abs(u - 10), abs(v - 10)) > 2 and max(abs(u - 20), abs(v - 12)) > 5)}
    assert {tuple(r) for r in free.collect()} == want


def test_points_and_targets(spark):
    mask = spark.createDataFrame([(0, u, v) for u in range(0, 12) for v in range(4, 14)], "k int, u int, v int")
    depth = spark.createDataFrame([(0, u, v, 2.0) for u in range(20) for v in range(20)], "k int, u int, v int, z double")
    pose = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 100.0, (1.0, 0.0, 0.0))], "k int, rot array<double>, f double, pos struct<x:double,y:double,z:double>")
    got = {(r.u, r.v): (r.x, r.y, r.z) for r in M.object_points(mask, depth, pose, 10.0, 10.0, 20, 20).collect()}
    assert set(got) == {(u, v) for u in range(0, 10, 3) for v in range(6, 12, 3)}  # the image's edge wears nothing down
    assert got[3, 6] == pytest.approx(((3 - 10) / 50 + 1, (6 - 10) / 50, 2.0))
    tips = spark.createDataFrame([("t", k, float(k * k), 1.0, -float(k)) for k in range(9)], "tool string, k int, x double, y double, z double")
    at = M.control_targets(tips, ["tool"], 8.0, 0.05).orderBy("step").collect()
    clock = np.arange(0, 1 + 1e-9, 0.05)
    assert [r.step for r in at] == list(range(len(clock))) and [r.x for r in at] == pytest.approx(np.interp(clock, np.arange(9) / 8, np.arange(9.0) ** 2))


def test_tool_scores(spark):
    """Two drawn shafts against masks drawn a little beside them."""
    def bar(cu, cv, angle, length, thick):
        v, u = np.mgrid[0:100, 0:160]
        s, t = (u - cu) * math.cos(angle) + (v - cv) * math.sin(angle), (v - cv) * math.cos(angle) - (u - cu) * math.sin(angle)
        return np.argwhere((s <= 0) & (s >= -length) & (np.abs(t) <= thick / 2))

    px = lambda tool, k, p, z=None: [(tool, k, int(u), int(v), *([z] if z else [])) for v, u in p]
    a, b = bar(90, 50, 0.2, 300, 12), bar(90, 53, 0.2, 300, 12)
    masks = spark.createDataFrame(px("a", 0, b) + px("a", 1, a) + px("b", 0, bar(30, 20, 0.0, 300, 3)[:30]), "tool string, k int, u int, v int")
    drawn = spark.createDataFrame(px("a", 0, a, 0.5) + px("a", 1, a, 0.5) + px("b", 1, a, 0.4), "tool string, k int, u int, v int, z double")
    back = (90 - 20 * math.cos(0.2), 50 - 20 * math.sin(0.2))
    track = spark.createDataFrame([("a", k, 0.1 * k, 0.0, 0.0, 90.0, 50.0, *back) for k in range(3)] + [("b", 0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "tool string, k int, x double, y double, z double, au double, av double, bu double, bv double")
    measured = S.tool_measurement(masks, ["tool", "k"], 160, 100)
    got = {(r.tool, r.k): r for r in M.tool_scores(track, measured, drawn, masks).collect()}
    g = got["a", 0]
    assert g.tip_px == pytest.approx(3, abs=1.5) and g.ang_deg < 2 and g.offset_px == pytest.approx(3 * math.cos(0.2), abs=0.8) and g.speed == pytest.approx(0.1) and g.acceleration is None
    on, off = {tuple(p) for p in a.tolist()}, {tuple(p) for p in b.tolist()}
    assert g.iou == pytest.approx(len(on & off) / len(on | off)) and got["a", 1].iou == 0 and got["a", 1].offset_px < 0.8 and got["a", 1].acceleration == pytest.approx(0, abs=1e-9)
    assert got["a", 2].tip_px is None and got["b", 0].iou is None and got["b", 0].ang_deg is None
