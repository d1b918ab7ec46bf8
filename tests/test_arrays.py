"""Archives read by slices and written as a whole or not at all; the readers that stand on them."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import arrays as A
from tidemark.sources import documents as D
from tidemark.sources import scenes as N


def table(df):
    return {(r.array, tuple(r["index"])): r.value for r in df.collect()}


def expected(name, a):
    return {(name, tuple(map(int, at))): float(a[tuple(at)]) for at in np.argwhere(np.isfinite(a))}


def test_slices_and_batches(spark, tmp_path):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(40, 3, 5)), np.asfortranarray(r.normal(size=(7, 4)))
    a[3, 1, 2] = np.nan
    np.savez(tmp_path / "x.npz", a=a, b=b, one=np.float32(2.5), whole=np.arange(4, dtype=np.int16), name=np.array("organ"))
    np.savez_compressed(tmp_path / "y.npz", c=a[:9])
    for size in ("1", "700", "100000000"):
        got = A.npz(spark, str(tmp_path), sliceBytes=size)
        want = {**expected("a", a), **expected("b", b), ("one", ()): 2.5, **expected("whole", np.arange(4.0)), **expected("c", a[:9])}
        assert table(got.where("text is null")) == pytest.approx(want)
        assert [(t.array, t.text) for t in got.where("text is not null").collect()] == [("name", "organ")]
    some = A.npz(spark, f"file://{tmp_path}/*.npz").where("array = 'a' and k between 10 and 12 and value > 0")
    assert table(some) == {k: v for k, v in expected("a", a).items() if 10 <= k[1][0] <= 12 and v > 0}


class Counted:
    """A file that counts the bytes that are read from it."""

    total = 0

    def __init__(self, f):
        self.f = f

    def read(self, n=-1):
        data = self.f.read(None if n is None or n < 0 else n)
        Counted.total += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *what):
        self.f.close()


def test_a_range_of_frames_reads_its_bytes_only(tmp_path, monkeypatch):
    a = np.arange(500 * 64 * 64, dtype=np.float64).reshape(500, 64, 64)
    np.savez(tmp_path / "big.npz", a=a, other=a)
    plain = A.open_file
    monkeypatch.setattr(A, "open_file", lambda p: Counted(plain(p)))
    reader = A.NpzReader({"path": str(tmp_path / "big.npz")})
    rest = list(reader.pushFilters([A.EqualTo(("array",), "a"), A.GreaterThanOrEqual(("k",), 100), A.LessThan(("k",), 103), A.EqualTo(("value",), 1.0)]))
    assert len(rest) == 1
    Counted.total = 0
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 3 * 64 * 64 and Counted.total < 3 * 64 * 64 * 8 + 20_000 < a.nbytes / 100


def test_filters_reach_the_plan(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.ones((1000, 8)), b=np.ones((1000, 8)))
    few = A.npz(spark, str(tmp_path / "x.npz"), sliceBytes="6400").where("array = 'a' and k >= 300 and k < 310")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 80
    assert D.frames_between(A.npz(spark, str(tmp_path / "x.npz"), sliceBytes="6400"), 0, 9).rdd.getNumPartitions() == 2


def test_written_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(n, k, [k + 0.5, None, -1.0 * k]) for n in ("p", "q") for k in range(50)]
    df = spark.createDataFrame(rows, "array string, k int, values array<double>").repartition(5)
    A.write_npz(df, path)
    want = {(n, (k, j)): v for n, k, vs in rows for j, v in enumerate(vs) if v is not None}
    assert table(A.npz(spark, path)) == want and table(A.npz(spark, path).where("k = 7 and array = 'q'")) == {k: v for k, v in want.items() if k[0] == "q" and k[1][0] == 7}
    broken = df.withColumn("values", F.when(F.col("k") == 49, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("values")))
    with pytest.raises(Exception, match="lost"):
        A.write_npz(broken, path)
    assert table(A.npz(spark, path)) == want
    A.write_npz(spark.createDataFrame([("r", 3, [1.0])], df.schema), path, "append")
    assert table(A.npz(spark, path)) == {**want, ("r", (3, 0)): 1.0}
    A.write_npz(df.where("k < 2"), path)
    assert len(table(A.npz(spark, path))) == len([k for k in want if k[1][0] < 2])


def test_masks_without_instruments(spark, tmp_path):
    r = np.random.default_rng(2)
    masks = r.random((4, 3, 12, 21)) < 0.15
    np.savez(tmp_path / "masks.npz", masks=np.packbits(masks, axis=-1), shape=np.array(masks.shape), names=np.array(["liver", "tool", "bone"]))
    px = N.object_masks(spark, str(tmp_path / "masks.npz"), 1, 3)
    names = ["liver", "tool", "bone"]
    want = {(int(k), names[o], int(u), int(v)) for k, o, v, u in np.argwhere(masks) if k >= 1}
    assert {tuple(x) for x in px.select("k", "obj", "u", "v").collect()} == want
    roles = spark.createDataFrame([("liver", "organ"), ("tool", "instrument"), ("bone", "backdrop")], "obj string, role string")
    tool = {(k, u, v) for k, o, u, v in want if o == "tool"}
    near = lambda k, u, v: any((k, u + a, v + b) in tool for a in (-1, 0, 1) for b in (-1, 0, 1))
    assert {tuple(x) for x in N.without_instruments(px, roles).collect()} == {p for p in want if p[1] != "liver" or not near(p[0], p[2], p[3])}


def test_frames_with_repaired_borders(spark):
    f = np.arange(2 * 9 * 8).reshape(2, 9, 8)
    px = spark.createDataFrame([(int(k), int(u), int(v), int(f[k, v, u])) for k, v, u in np.ndindex(f.shape)], "k int, u int, v int, x int")
    got = D.frames_between(px, 1, 1, (1, 8), (8, 7))
    want = f[1, 1:8].copy()
    want[0], want[-2:] = want[1], want[-3]
    want[:, -2:] = want[:, -3:-2]
    assert {(r.u, r.v): r.x for r in got.collect()} == {(u, v): want[v, u] for v, u in np.ndindex(want.shape)} and got.schema == px.schema


def test_bundles_versions_and_fallbacks(spark, tmp_path):
    np.savez(tmp_path / "organ.npz", verts=np.eye(2), kind=np.array("measured"), fit=np.array(json.dumps({"scale": 1.5})))
    arrays, facts = N.organ_bundle(spark, str(tmp_path / "organ.npz"))
    assert table(arrays) == expected("verts", np.eye(2))
    assert facts.select("kind", F.try_variant_get("fit", "$.scale", "double").alias("s")).first() == ("measured", 1.5)
    listing = spark.createDataFrame([(f"s3://x/tissues/{t}/{v}/model.npz",) for t, v in (("liver", "v1"), ("liver", "v9"), ("duct", "v2"), ("bed", "v4"))], "path string")
    asked = spark.createDataFrame([("liver", None), ("duct", "latest"), ("bed", "none"), ("skin", None), ("bone", "a/b")], "tissue string, version string")
    got = {r.tissue: r.version for r in N.model_versions(asked, {"liver": "v1"}, listing).collect()}
    assert got == {"liver": "v1", "duct": "v2", "bed": None, "skin": None, "bone": "a/b"}
    own = spark.createDataFrame([("left", 0, 1, 1), ("right", 0, 2, 2), ("right", 0, 1, 1), ("z", None, None, None)], "array string, k int, u int, v int")
    clip = spark.createDataFrame([(5, 5, 5)], "k int, u int, v int")
    pixels = lambda df: sorted(tuple(r) for r in df.collect())
    assert pixels(N.first_key_masks(own, [["no"], ["left", "right"]])) == [(0, 1, 1), (0, 2, 2)]
    assert pixels(N.first_key_masks(own, [["no"]])) == [(0, 1, 1)] and pixels(N.first_key_masks(own.limit(0), [], clip)) == [(5, 5, 5)]
    old = spark.createDataFrame([("a", 0, 1.0, 2.0, 0.3, None), ("b", 0, 5.0, 6.0, 0.4, "liver")], "tool string, k int, tip double, rcm double, jaw double, holds string")
    model = spark.createDataFrame([("b", 0, 7.0, 8.0, 9.0, 0.1)], "tool string, k int, tcp double, tip double, rcm double, heading double")
    assert {(r.tool, r.tcp, r.tip, r.jaw, r.source) for r in N.tool_tracks(old, model).collect()} == {("a", 1.0, 1.0, 0.3, "old fit"), ("b", 7.0, 8.0, 0.0, "model")}
    assert N.tool_tracks(old, None).where("tcp = tip").count() == 2
