"""STL files of several splits, text and binary, welded and reduced to their largest part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import meshes as M


def grid(n, m, shift=0.0, z=0.0):
    """Triangles (t, 3, 3) of a sheet of n x m squares."""
    p = lambda i, j: (i + shift, 2.0 * j, z + 0.1 * np.sin(i + j))
    return np.array([t for i in range(n) for j in range(m) for t in ([p(i, j), p(i + 1, j), p(i + 1, j + 1)], [p(i, j), p(i + 1, j + 1), p(i, j + 1)])])


def write_binary(path, tri):
    rec = np.zeros(len(tri), M.RECORD)
    rec["corners"] = tri
    path.write_bytes(b"made here".ljust(80, b"\0") + np.uint32(len(tri)).tobytes() + rec.tobytes())


def write_text(path, tri):
    corner = lambda p: "      vertex " + " ".join(f"{x:.9e}" for x in p)
    path.write_text("solid s\n" + "".join("  facet normal 0 0 0\n    outer loop\n" + "\n".join(map(corner, t)) + "\n    endloop\n  endfacet\n" for t in tri) + "endsolid s\n")


@pytest.mark.parametrize("write", [write_binary, write_text])
def test_shapes(spark, tmp_path, write):
    small, large = grid(4, 3, 100.0, 5.0), grid(12, 9)
    tri = np.float32(np.concatenate((small, large[::-1], [large[0][[0, 0, 1]]])))
    write(tmp_path / "s.stl", tri)
    rows = M.stl(spark, str(tmp_path / "s.stl"), split=50)
    assert rows.rdd.getNumPartitions() == (5 if write is write_binary else 1)
    got = np.array([list(r)[1:] for r in rows.orderBy("f").collect()]).reshape(-1, 3, 3)
    assert np.allclose(got, tri)
    vertices, faces = M.welded(rows)
    v = {r.v: (r.x, r.y, r.z) for r in vertices.collect()}
    assert len(v) == 5 * 4 + 13 * 10 and sorted(v) == list(range(len(v))) and [v[k] for k in sorted(v)] == sorted(v.values())
    assert faces.count() == len(tri) - 1
    assert all(np.allclose([v[r.a], v[r.b], v[r.c]], tri[r.f]) for r in faces.collect())
    own, part = M.load_shape(spark, str(tmp_path / "s.stl"), split=50)
    assert part.count() == len(large)
    p = np.array([(r.x, r.y, r.z) for r in own.collect()])
    want = np.unique(np.float32(large).reshape(-1, 3), axis=0).astype(float) * 1e-3
    c = np.cov(p.T)
    assert len(p) == 130 and np.allclose(p.mean(0), 0, atol=1e-12) and np.allclose(c, np.diag(np.diag(c)), atol=1e-12) and (np.diff(np.diag(c)) < 0).all()
    assert np.allclose(sorted(np.diag(c)), np.linalg.eigvalsh(np.cov(want.T)))


def test_bad_files(spark, tmp_path):
    write_binary(tmp_path / "cut.stl", grid(3, 3))
    whole = (tmp_path / "cut.stl").read_bytes()
    (tmp_path / "cut.stl").write_bytes(whole[:-7])
    with pytest.raises(Exception, match="no STL"):
        M.stl(spark, str(tmp_path / "cut.stl")).count()
    (tmp_path / "half.stl").write_text("solid s\n vertex 0 0 0\n vertex 1 0 0\nendsolid")
    with pytest.raises(Exception, match="cut short"):
        M.stl(spark, str(tmp_path / "half.stl")).count()
    write_binary(tmp_path / "none.stl", np.zeros((0, 3, 3)))
    vertices, faces = M.load_shape(spark, str(tmp_path / "none.stl"))
    assert vertices.count() == 0 and faces.where(F.col("a") >= 0).count() == 0
