"""Sources, sinks, joins, aggregates, experiments and streams on small cases."""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import experiments as X
from tidemark.operators import joins as J
from tidemark.sources import documents as D
from tidemark.sources import sinks as K
from tidemark.sources.arrays import use_npz
from tidemark.streaming import extensions as T


def put(path, text):
    path.write_text(text)
    return str(path)


def test_documents(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"name": "a", "fps": 25, "objects": {"x": {"role": "organ", "prompts": [{"frame": 0, "pos": [[1, 2]], "neg": []}]}, "y": {"role": "tool", "template": "t"}}}, indent=1))
    clips = D.json_documents(spark, str(tmp_path / "a.json"), D.CLIP)
    assert [(r.name, r.role, r.template) for r in D.clip_objects(clips).orderBy("idx").collect()] == [("x", "organ", None), ("y", "tool", "t")]
    v = D.json_values(spark, str(tmp_path / "a.json")).select(F.try_variant_get("doc", "$.objects.x.role", "string"), F.try_variant_get("doc", "$.missing.x", "double")).first()
    assert list(v) == ["organ", None]


def test_text_formats(spark, tmp_path):
    v, f = D.obj_mesh(spark, put(tmp_path / "m.obj", "# c\nv 0 0 0\nv 1 0 0\nvt 0 0\nv 0 1 0\nf 1/1 2/1 3/1\n"))
    assert [tuple(r) for r in v.orderBy("v").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0)] and [tuple(r) for r in f.collect()] == [(0, 0, 1, 2)]
    log = put(tmp_path / "b.log", "10:00:01 clip scene ok 12 s\n10:00:02 clip sim a b FAILED (1) 7 s\nnoise\n")
    rows = D.batch_log(spark, log).orderBy("time").collect()
    assert [(r.stage, r.conditions, r.status, r.seconds) for r in rows] == [("scene", [], "ok", 12), ("sim", ["a", "b"], "FAILED (1)", 7)]
    ev = {r.tool: r.n for r in D.event_log(spark, put(tmp_path / "e.log", '{"tool":"a"}\n{"tool":"a"}\nbad\n{}\n')).collect()}
    assert ev == {"a": 2, None: 2}
    kin = D.kinematics(spark, put(tmp_path / "k.csv", "Date:,x,y\n2024-01-02.03:04:05.22,1,2\n2024-01-02.03:04:06.5,3\nDate:,x,y\n2024-01-02.03:04:07.7,5,6\n"), ["x", "y"])
    assert [(r.t.second, r.t.microsecond, r.x, r.y) for r in kin.orderBy("t").collect()] == [(5, 22000, 1, 2), (7, 7000, 5, 6)]
    for n in ("v1", "v2"):
        os.makedirs(tmp_path / "t" / n)
        put(tmp_path / "t" / n / "model.npz", "x")
    assert D.latest_version(D.files(spark, str(tmp_path / "t"), "*.npz")).first()[0] == "v2"


def test_npz(spark, tmp_path):
    bits = np.zeros((2, 10), bool)
    bits[1, 9] = True
    np.savez(tmp_path / "m.npz", a=np.array([[1.0, np.nan], [0.0, 4.0]]), names=np.array(["x"]))
    np.savez(tmp_path / "p.npz", masks=np.packbits(bits, axis=-1), shape=np.array(bits.shape))
    use_npz(spark)
    got = sorted((tuple(r["index"]), r.value) for r in spark.read.format("npz").option("array", "a").load(str(tmp_path / "m.npz")).collect())
    assert got == [((0, 0), 1.0), ((1, 0), 0.0), ((1, 1), 4.0)]
    p = spark.read.format("npz").option("packed", "true").option("array", "masks").load(str(tmp_path / "p.npz")).collect()
    assert [tuple(r["index"]) for r in p] == [(1, 9)]


def test_depth_sources(spark):
    px = spark.createDataFrame([("c", 0, 1, 5, 4.0), ("c", 1, 1, 9, 8.0), ("c", 2, 1, 9, 8.0)], "clip string, k int, u int, v int, disp double")
    calib, off = spark.createDataFrame([("c", 0.5)], "clip string, a double"), spark.createDataFrame([("c", 0, 2.0), ("c", 1, -99.0)], "clip string, k int, b double")
    assert {r.k: r.z for r in D.metric_depth(px, calib, off).collect()} == {0: 0.25, 1: 1.0}
    assert [(r.k, r.v) for r in D.frames_between(px, 1, 2, (8, 10)).orderBy("k").collect()] == [(1, 1), (2, 1)]
    assert [r.valid for r in D.reference_depth(spark.createDataFrame([(0,), (5,)], "raw int"), 0.1).orderBy("raw").collect()] == [False, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, float("nan")), (2, 1, 0.25)], "k int, ver int, x double")
    K.write_json(df, str(tmp_path / "j"))
    assert {r.k: r.x for r in spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()} == {1: None, 2: 0.25}
    path = str(tmp_path / "t")
    K.upsert_table(df, path, ["k"], "ver")
    K.upsert_table(spark.createDataFrame([(2, 0, 9.0), (3, 1, 7.0), (1, 2, 5.0)], "k int, ver int, x double"), path, ["k"], "ver")
    assert {r.k: (r.ver, r.x) for r in K.read_table(spark, path).collect()} == {1: (2, 5.0), 2: (1, 0.25), 3: (1, 7.0)}
    q = K.quantized(df.where("k = 2"), ["x"], -0.4, 0.4)
    b = K.base64_series(q.withColumn("s", F.lit(0)), ["s"], ["k"], "x").first().data
    import base64

    assert np.frombuffer(base64.b64decode(b), "<i2").tolist() == [q.first().x]
    index = spark.createDataFrame([("a", 0), ("b", 1)], "name string, ord long")
    assert {r.name: r.ord for r in K.index_first(index, spark.createDataFrame([("b",)], "name string"), "name").collect()} == {"b": 0, "a": 1}
    assert K.text_table(df.orderBy("k"), ["k", "x"]).collect()[1].line == "2 | 0.250"


def test_time_joins_ties(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, 1.0)], "g int, t double")
    right = spark.createDataFrame([(1, 0.0, 5), (1, 1.0, 6), (1, 1.0, 4), (1, 9.0, 7)], "g int, t double, id int")
    got = {(r.g, r.t): (r.near_t, r.near_id) for r in J.nearest_in_time(left, right, ["g"], "t", "t", ["id"]).collect()}
    assert got == {(1, 0.5): (0.0, 5), (1, 2.0): (1.0, 4), (2, 1.0): (None, None)}
    far = J.nearest_in_time(left, right, ["g"], "t", "t", ["id"], max_gap=0.6).where("t = 2.0").first()
    assert far.near_id is None
    k = spark.range(8).select(J.step_of_frame(F.col("id"), 8.0, 0.05, 100).alias("even"), J.step_of_frame_first(F.col("id"), 8.0, 0.05, 100).alias("first")).collect()
    assert (k[1].even, k[1]["first"]) == (2, 2) and (k[3].even, k[3]["first"]) in ((8, 7), (7, 7))
    grid = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "k long, v double")
    at = spark.createDataFrame([(0.5,), (2.25,), (99.0,)], "t double")
    assert {r.t: r.v for r in J.interpolate_frames(at, grid, "t", 1.0, "k", 4, ["v"]).collect()} == {0.5: 0.5, 2.25: 5.25, 99.0: 9.0}


def test_point_joins(spark):
    r = np.random.default_rng(7)
    p = r.uniform(0, 1, (60, 3))
    a = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    b = a.withColumnRenamed("id", "bid")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    near = {(x.id, x.bid) for x in J.radius_join(a, b, "id", "bid", "xyz", 0.3).collect()}
    assert near == {(i, j) for i in range(60) for j in range(60) if d[i, j] < 0.3}
    np.fill_diagonal(d, 9)
    best = {x.id: x.bid for x in J.nearest_point(a, b.where("bid % 2 = 0"), "id", "bid", "xyz", 2.0).collect()}
    full = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert best == {i: int(np.argmin(full[i, ::2])) * 2 for i in range(60)}
    assert J.within_reach(a, b, "id", "bid", "xyz", 0.05, 0.3, 3).count() == sum((full[i] < 0.3).sum() >= 3 for i in range(60))
    tri = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0), (1, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0), (2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "t int, ax double, ay double, bx double, by double, cx double, cy double")
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.0)], "p int, x double, y double")
    (hit,) = J.in_triangles(pts, tri, "p", "t", 1.5).collect()
    assert (hit.p, hit.t) == (0, 0) and [hit.w0, hit.w1, hit.w2] == pytest.approx([0.5, 0.25, 0.25])
    img = spark.createDataFrame([(u, v, float(u + 10 * v)) for u in range(4) for v in range(3)], "u int, v int, z double")
    at = spark.createDataFrame([(0, 1.25, 0.5), (1, -3.0, 9.0)], "key int, x double, y double")
    assert {q.key: q.z for q in J.lookup_bilinear(at, img, "key", "x", "y", 4, 3, "z").collect()} == {0: pytest.approx(6.25), 1: pytest.approx(20)}
    assert {q.key: q.z for q in J.lookup_clamped(at, img, "x", "y", 4, 3, "z").collect()} == {0: 1.0, 1: 20.0}


def test_small_joins(spark):
    a, b = spark.createDataFrame([(1, 2), (3, 4)], "k int, v int"), spark.createDataFrame([(1, 5)], "k int, v int")
    assert J.matched(a, b, ["k"]).first().asDict() == {"k": 1, "v_a": 2, "v_b": 5}
    assert {r.k: r.w for r in J.with_fallback(a.select("k"), b.withColumnRenamed("v", "w"), a.withColumnRenamed("v", "w"), ["k"], "w").collect()} == {1: 5, 3: 4}
    assert J.optional_join(a, None, ["k"], {"z": "double"}).first().error is not None
    assert J.optional_join(a, b.withColumnRenamed("v", "z"), ["k"], {"z": "int"}).where("z = 5").count() == 1
    assert J.layouts(a.select("k"), b.select(F.col("v").alias("w"))).count() == 2
    assert J.left_over(a, b, ["k"]).count() == 1 and J.belonging(a, b, ["k"]).count() == 1


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None)], "g string, x double")
    got = {r.g: r for r in A.summarize(df, ["g"], "x").collect()}
    assert (got["a"].n, got["a"]["mean"], got["a"].median, got["a"].p10) == (2, 2, 2, pytest.approx(1.2)) and (got["b"].n, got["b"]["mean"]) == (0, None)
    assert A.guarded_median(df, ["g"], F.col("x"), 2, "m").where("m is not null").count() == 0
    r = np.random.default_rng(1)
    x, b = r.uniform(1, 9, 600), np.repeat([1.0, -2.0, 4.0], 200)
    y = 1.5 * x + b + r.normal(0, 0.01, 600)
    cal = A.alternating_calibration(spark.createDataFrame([(int(k), float(p), float(q)) for k, p, q in zip(np.repeat([0, 1, 2], 200), x, y)], "k int, x double, y double"), "k", "x", "y", rounds=40).orderBy("k").collect()
    assert [c.b for c in cal] == pytest.approx([1, -2, 4], abs=0.05) and cal[0].a == pytest.approx(1.5, abs=0.01)  # what three rounds of NumPy give is in test_calibration
    pooled, by = A.pooled_and_grouped(spark.createDataFrame([(0, 1.0)] * 3 + [(1, 9.0)], "s int, e double"), "s", "e", 2)
    assert pooled.first().median == 1 and [tuple(q) for q in by.collect()] == [(0, 1.0, 3)]
    assert A.scatter(spark.createDataFrame([(1, 2.0), (1, 3.0)], "i int, x double"), "i", "x").first().asDict() == {"i": 1, "sum": 5.0, "min": 2.0, "n": 2}
    assert A.percent_errors(df, "x").first().median == 2
    assert {q.band: q["min"] for q in A.band_extremes(spark.createDataFrame([(0, 1.0), (1, 5.0)], "band int, x double"), "band", "x").collect()} == {0: 1.0, 1: 5.0, None: 1.0}


def test_experiments(spark):
    s = spark.createDataFrame([("b", 0.50004), ("a", 0.50001), ("c", None)], "c string, s double")
    assert [r.c for r in X.leaderboard(s, "s", ["c"], digits=4).orderBy("rank").collect()] == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, '{"a":{"mean":2.5}}'), (2, "bad")], "k int, doc string")
    assert {r.k: r.m for r in X.flatten_documents(docs, ["k"], "doc", {"m": "$.a.mean"}).collect()} == {1: 2.5, 2: None}
    base, var = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int"), spark.createDataFrame([(1, 9)], "k int, a int")
    assert X.overlay_config(base, var, "k").first().asDict() == {"k": 1, "a": 9, "b": 3}
    f = spark.createDataFrame([("x", 2.0, 1), ("x", 1.0, 2), ("x", 1.0, 0)], "g string, cost double, ord int")
    assert X.first_best(f, ["g"], F.col("cost"), ["ord"], ["ord"]).first().asDict() == {"g": "x", "cost": 1.0, "ord": 0}
    rep = X.constraint_report(base.unionByName(base), ["k"], {"a": F.col("a") > 5, "n": F.lit(None).cast("boolean")})
    assert {r.rule: r.n for r in X.first_offender(rep, ["k"]).collect()} == {"a": 2, "n": 2}
    assert X.best_frame(spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0)], "k int, d double"), "k", "d").first().k == 1
    assert X.rest_candidates(spark.createDataFrame([(0, float(i)) for i in range(101)], "c int, r double"), "c", F.col("r")).first().asDict() == {"c": 0, "p1": 1.0, "p99": 99.0}
    assert X.tail_of(spark.createDataFrame([("v1", True), ("v3", False), ("v2", True)], "n string, ok boolean"), "n", F.col("ok")).first()[0] == "v2"


def test_golden_relations():
    """Relations between stored numbers that hold by definition: a curve's mean, counts of better seeds."""
    curve, seeds = [0.5, 0.6, 0.7], [(0, 2.0, 3.0, 11), (10, 5.0, 4.0, 20)]
    assert math.isclose(sum(curve) / 3, 0.6) and sum(a < b for _, a, b, _ in seeds) == 1


def test_streams(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    ev.repartition(3).write.parquet(src)
    stream = lambda: T.event_stream(spark, src, ev.schema)
    batch = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    got = T.drain(T.windowed_summary(stream(), "ts", "event_type", "value", "1 day", late="60 days"), "w1", "complete", str(tmp_path / "c1"))
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("value").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == batch.count() and got.count() == want.count()
    s = T.drain(T.slew_follow(stream(), "user_id", "ts", "value", 5.0, "60 days"), "w2", "append", str(tmp_path / "c2"))
    assert s.count() == batch.count()
    c = T.drain(T.clean_runs(stream().withColumn("f", F.col("value") > 25), "user_id", "ts", "f", 4, 3, "60 days"), "w6", "append", str(tmp_path / "c6"))
    assert 0 < c.count() <= batch.count()
    clock = T.drain(T.monotonic_clock(stream(), "user_id", "ts", "value", 0.5, "60 days"), "w7", "append", str(tmp_path / "c7"))
    assert clock.count() == batch.count()
    d = T.drain(T.first_seen(stream(), ["event_id"], "ts", "60 days"), "w3", "append", str(tmp_path / "c3"))
    assert d.count() == batch.count()
    ses = T.drain(T.sessions(stream(), "ts", "user_id", "6 hours", "60 days"), "w4", "complete", str(tmp_path / "c4"))
    assert ses.agg(F.sum("n")).first()[0] == batch.count()
    out = str(tmp_path / "out")
    q = stream().select("user_id", "event_id", "value").writeStream.foreachBatch(T.upsert_sink(out, ["user_id"], "event_id")).option("checkpointLocation", str(tmp_path / "c5")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = {r.user_id: r.m for r in ev.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.user_id: r.event_id for r in K.read_table(spark, out).collect()} == newest


def test_streamed_runs_are_those_of_the_batch(spark, tmp_path):
    """Each trigger brings a few rows of every key; what is held comes out when the keys expire."""
    import datetime

    from tidemark.operators import windows as W

    r = np.random.default_rng(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=i), int(r.random() < (0.3 + 0.4 * (i // 10 % 2)))) for k in range(4) for i in range(80)]
    late = [(99, start + datetime.timedelta(days=d), 0) for d in (30, 31)]  # moves the watermark on
    src, schema = str(tmp_path / "in"), "k long, ts timestamp, f int"
    for n, part in enumerate([[x for x in rows if (x[1] - start).seconds // 16 == j] for j in range(5)] + [late[:1], late[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        for name in os.listdir(src):
            if name.endswith(".parquet") and not name.startswith("n"):
                os.rename(f"{src}/{name}", f"{src}/n{n:02d}-{name}")
                os.utime(f"{src}/n{n:02d}-{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = T.event_stream(spark, src, spark.createDataFrame(rows[:1], schema).schema)
    got = T.drain(T.clean_runs(stream, "k", "ts", "f", 3, 2, "1 second", 3_600_000), "runs", "append", str(tmp_path / "c")).where("k < 99")
    want = W.clean_runs(spark.createDataFrame(rows, schema), ["k"], ["ts"], F.col("f") == 1, 3, 2, "clean")
    assert {(x.k, x.ts): x.clean for x in got.collect()} == {(x.k, x.ts): x.clean for x in want.collect()}


def test_calibration(spark):
    r = np.random.default_rng(4)
    k, x = np.repeat(np.arange(5), 40), r.uniform(1, 9, 200)
    y = 2.5 * x + np.array([1.0, 3.0, -2.0, 4.0, 0.5])[k] + r.normal(0, 0.05, 200) + (r.random(200) < 0.1) * 20
    k[195:] = 9  # two frames are too short for an offset
    k[198:] = 8
    a, b = 3.0, np.full(10, 5.0)
    for _ in range(3):
        for f in range(10):
            if (k == f).sum() >= 3:
                b[f] = np.median(y[k == f] - a * x[k == f])
        res = y - b[k]
        w = np.abs(res - a * x) < 3 * np.median(np.abs(res - a * x)) + 1e-6
        a = float(x[w] @ res[w] / (x[w] @ x[w]))
    got = A.alternating_calibration(spark.createDataFrame([(int(i), float(p), float(q)) for i, p, q in zip(k, x, y)], "k int, x double, y double"), "k", "x", "y", rounds=3).collect()
    assert {g.k for g in got} == {0, 1, 2, 3, 4, 9} and all(g.a == pytest.approx(a) for g in got)
    assert all(g.b == pytest.approx(np.median(y[k == g.k] - a * x[k == g.k])) for g in got)


def test_published_table_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    K.replace_table(spark.createDataFrame([(1, 1)], "k int, v int"), path)
    old = K.read_table(spark, path)
    bad = spark.createDataFrame([(2, 2)], "k int, v int").withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        K.replace_table(bad, path)
    assert K.read_table(spark, path).collect() == [(1, 1)]
    K.replace_table(K.read_table(spark, path).withColumn("v", F.col("v") + 1), path)
    assert K.read_table(spark, path).collect() == [(1, 2)] and old.collect() == [(1, 1)]
    with pytest.raises(FileNotFoundError):
        K.read_table(spark, str(tmp_path / "none"))
    assert K.is_complete(spark, K.current_version(spark, path)) and not K.is_complete(spark, path)
    K.append_points(spark.createDataFrame([(0, 1.0), (1, 2.0)], "part int, x double"), str(tmp_path / "p"), "part")
    K.append_points(spark.createDataFrame([(1, 3.0)], "part int, x double"), str(tmp_path / "p"), "part")
    assert spark.read.parquet(str(tmp_path / "p")).where("part = 1").count() == 2


def test_scenes(spark, tmp_path):
    from tidemark.sources import scenes as N

    np.savez(tmp_path / "scene.npz", zb=np.arange(4.0), ribbon0_x=np.array([1.0, 2.0]), ribbon0_y=np.array([3.0]), ribbon1_x=np.array([5.0]))
    (tmp_path / "scene.json").write_text('{"a": 1}')
    plain, groups, side = N.scene_bundle(spark, str(tmp_path / "scene.npz"), str(tmp_path / "scene.json"))
    assert {r.array for r in plain.collect()} == {"zb"} and plain.count() == 4
    assert {(r.kind, r.n, r.field, r.value) for r in groups.collect()} == {("ribbon", 0, "x", 1.0), ("ribbon", 0, "x", 2.0), ("ribbon", 0, "y", 3.0), ("ribbon", 1, "x", 5.0)} and side.count() == 1
    made = []

    def mask():
        made.append(1)
        return spark.range(3)

    v = N.Views("c+x", {"mask": mask, "depth": lambda: spark.range(5)})
    own = v.with_tables(mask=lambda w: w.original("mask").where("id > 0"))
    assert v["mask"].count() == 3 and v["mask"].count() == 3 and len(made) == 1 and own["mask"].count() == 2 and own["depth"].count() == 5
    assert spark.table("c_x_depth").count() == 5
    v.close(), own.close()
    a, b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k int, f double"), spark.createDataFrame([(0, 9.0)], "k int, f double")
    every = N.solutions({"late": a, "first": b, "gone": None}, ["first", "gone", "late"])
    assert {(r.k, r.solution) for r in N.preferred(every, ["k"]).collect()} == {(0, "first"), (1, "late")}
    with pytest.raises(ValueError):
        N.solutions({"gone": None}, ["gone"])
    asked = spark.createDataFrame([("a", "template", 0), ("a", "measured", 1)], "clip string, condition string, ord int")
    objects = spark.createDataFrame([("a", "organ", None), ("b", "organ", "t.obj")], "clip string, role string, template string")
    default = spark.createDataFrame([("a", "primitive", 0), ("b", "template", 0)], "clip string, condition string, ord int")
    assert {(r.clip, r.condition) for r in N.applicable_conditions(asked, objects, default).collect()} == {("a", "measured"), ("b", "template")}
    reg = N.Registry(["v"])
    reg.add("box", lambda n: spark.range(n).withColumnRenamed("id", "v"))
    assert reg("box", 3).count() == 3
    with pytest.raises(KeyError):
        reg("ball")
    base = spark.createDataFrame([(0, 1, 2.0)], "run int, n int, s double")
    runs = N.edited(base, spark.createDataFrame([(1, 5, None), (2, None, 7)], "run int, n int, extra int")).orderBy("run").collect()
    assert [(r.run, r.n, r.s, r.extra) for r in runs] == [(1, 5, 2.0, None), (2, 1, 2.0, 7)]
    count = []

    def step(*needs):
        count.append(len(needs))
        return spark.range(1 + len(needs))

    steps = [("one", [], step), ("two", ["one"], step)]
    for _ in range(2):
        out = N.build_missing(spark, steps, str(tmp_path / "prep"))
    assert out["two"].count() == 2 and count == [0, 1]
    N.export_bundle({"a": a}, str(tmp_path / "x"), index=spark.createDataFrame([("c",)], "name string"))
    assert spark.read.json(str(tmp_path / "x/a")).count() == 2 and spark.read.json(str(tmp_path / "x/index")).count() == 1
    rep = {r["column"]: r for r in N.replay_table(spark.createDataFrame([("b", k, 0.1 * k, 0.0) for k in range(3)], "body string, k int, x double, y double"), ["body"], "k", ["x", "y"], -0.4, 0.4).collect()}
    import base64

    assert rep["x"].n == 3 and np.frombuffer(base64.b64decode(rep["x"].data), "<i2").tolist() == [0, round(0.1 * 65534 / 0.8), round(0.2 * 65534 / 0.8)]


def test_recovered_tools_and_canvas(spark):
    from tidemark.functions import geometry as G
    from tidemark.functions import scalars as C
    from tidemark.sources import scenes as N

    tracks = spark.createDataFrame([("g", k, 10.0, 0.0, 1.0, k < 3) for k in range(8)], "tool string, k int, tu double, tv double, z double, visible boolean")
    hold = spark.createDataFrame([("g", k, 20.0, 0.0, 2.0) for k in range(8)], "tool string, k int, hu double, hv double, hz double")
    ports = spark.createDataFrame([("g", "b", 1.0, 5.0, 5.0, 5.0), ("g", "a", 1.0, 6.0, 6.0, 6.0), ("g", "c", 2.0, 7.0, 7.0, 7.0)], "tool string, way string, cost double, x double, y double, z double")
    got = {r.k: (r.u, r.z, r.px) for r in N.recovered_tools(tracks, hold, ports).collect()}
    assert got == {k: (pytest.approx(10 + 10 * min(max((k - 2 + 5) / 5, 0), 1)), pytest.approx(1 + min(max((k - 2 + 5) / 5, 0), 1)), 6.0) for k in range(8)}
    turn = lambda a: [math.cos(a), 0.0, math.sin(a), 0.0, 1.0, 0.0, -math.sin(a), 0.0, math.cos(a)]
    poses = spark.createDataFrame([(k, turn(0.2 * k), 500.0) for k in range(4)], "k int, rot array<double>, f double")
    r0, r3 = np.reshape(turn(0.0), (3, 3)), np.reshape(turn(0.6), (3, 3))
    over = 0.0
    for u in (0, 640):
        for v in (0, 480):
            w = r0 @ r3.T @ np.array([(u - 320) / 500, (v - 240) / 500, 1.0])
            q = 320 + 500 * w[0] / w[2], 240 + 500 * w[1] / w[2]
            over = max(over, -q[0], q[0] - 640, -q[1], q[1] - 480)
    assert N.canvas_margin(poses, 640, 480, 320.0, 240.0, high=9999).first().margin == int(over + 48)
    assert N.canvas_margin(poses, 640, 480, 320.0, 240.0).first().margin == min(int(over + 48), 480)
    vec = lambda *x: G.vec(*map(float, x))
    row = spark.range(1).select(
        G.heading(vec(0, 0, 0), vec(-1, 1, 5)).alias("h"), G.pose_position(F.lit(None).cast("struct<x:double,y:double,z:double>"), vec(1, 2, 3))["y"].alias("p"),
        G.canvas_uv(F.lit(5.0), F.lit(7.0), 3, 10, 14).alias("uv"), G.silhouette_thickness(F.lit(3.0), F.lit(5.0), F.lit(0.1), F.lit(500.0)).alias("t"),
        C.variant_title(F.lit("Clip"), F.lit("v"), {"v": "second"}).alias("a"), C.variant_title(F.lit("Clip"), F.lit(""), {"v": "second"}).alias("b"), G.visible(F.lit(1.0), F.lit(0.995)).alias("vis"),
        G.shaft_direction(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d0"), G.shaft_direction(F.lit(math.pi / 2), F.lit(0.0), F.lit(0.0)).alias("d1"), G.faces_viewer(vec(0, 0, 1), vec(0, 0, -1)).alias("faces"),
        G.tet_quality(vec(0, 0, 0), vec(1, 0, 0), vec(0, 1, 0), vec(0, 0, 1)).alias("q"), G.orient_tet(F.lit(-1.0), F.lit(0), F.lit(1), F.lit(2), F.lit(3)).alias("o"), C.robust_loss(F.lit(0.0)).alias("loss"), C.json_number(F.lit(0.123456)).alias("num"),
        F.abs(C.dequantize16(C.quantize16(F.lit(0.1), -0.4, 0.4), -0.4, 0.4) - 0.1).alias("back"), C.padded(F.array(F.lit(1), F.lit(2)), 1, 2).alias("pad"),
    ).first()
    assert row.h == pytest.approx(math.pi / 4) and row.p == 2.0 and (row.uv.u, row.uv.v) == (8 / 16, 10 / 20) and row.t == pytest.approx(0.002)
    assert row.a == "Clip \u00b7 second" and row.b == "Clip" and row.vis and row.faces and (row.d0.y, row.d1.x) == (1.0, pytest.approx(-1.0))
    assert row.q > 0 and row.back < 1e-4 and row.pad == [1, 1, 2, 2, 2] and row.loss is not None and row.num is not None and row.o is not None
    bounds = {"yaw": (-1.0, 1.0)}
    j = spark.createDataFrame([(1.05, 0.0, 0.1)], "yaw double, pitch double, insertion double").select(F.struct("yaw", "pitch", "insertion").alias("j"))
    assert j.select(G.checked_joints(F.col("j"), bounds, {"yaw": 0.1}).alias("k")).first().k.yaw == 1.0
    with pytest.raises(Exception, match="out of reach"):
        j.select(G.checked_joints(F.col("j"), bounds, {"yaw": 0.01}).alias("k")).first()
