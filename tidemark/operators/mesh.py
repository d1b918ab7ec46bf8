"""Meshes as relations: vertex (v, x, y, z), face (f, a, b, c), tet (t, a, b, c, d), all with leading key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators.aggregates import quantiles, with_quantiles
from tidemark.operators.sets import edge_use, face_edges, face_pairs, min_label_components

Names = Sequence[str]


def _corner(vertices: DataFrame, by: Names, name: str) -> DataFrame:
    return vertices.select(*by, F.col("v").alias(name), F.struct("x", "y", "z").alias(f"p{name}"))


def with_corners(cells: DataFrame, vertices: DataFrame, corners: Sequence[str] = ("a", "b", "c"), by: Names = ()) -> DataFrame:
    """Adds pa, pb, … : positions of the corners. ``by`` are key columns of the vertices (frames) that the cells lack or share."""
    out = cells
    for i, c in enumerate(corners):
        shared = [k for k in by if k in out.columns]
        out = out.join(_corner(vertices, by, c), [*shared, c])
    return out


def surface_area(vertices: DataFrame, faces: DataFrame, by: Names = ()) -> DataFrame:
    t = with_corners(faces, vertices, by=by)
    return t.groupBy(*by).agg(F.sum(G.triangle_area(F.col("pa"), F.col("pb"), F.col("pc"))).alias("area"))


def enclosed_volume(vertices: DataFrame, faces: DataFrame, by: Names = ()) -> DataFrame:
    t = with_corners(faces, vertices, by=by)
    return t.groupBy(*by).agg((F.sum(G.dot(F.col("pa"), G.cross(F.col("pb"), F.col("pc")))) / 6.0).alias("volume"))


def area_and_volume(vertices: DataFrame, faces: DataFrame, by: Names = ()) -> DataFrame:
    """``surface_area`` and ``enclosed_volume`` by one pass over the faces: by, area, volume."""
    t = with_corners(faces, vertices, by=by)
    a, b, c = (F.col(f"p{n}") for n in "abc")
    return t.groupBy(*by).agg(F.sum(G.triangle_area(a, b, c)).alias("area"), (F.sum(G.dot(a, G.cross(b, c))) / 6.0).alias("volume"))


def edge_lengths(vertices: DataFrame, edges: DataFrame, by: Names = ()) -> DataFrame:
    e = with_corners(edges, vertices, ("a", "b"), by)
    return e.select(*by, "a", "b", G.norm(G.sub(F.col("pa"), F.col("pb"))).alias("length"))


def stretch(rest: DataFrame, frames: DataFrame, edges: DataFrame, k: str = "k") -> DataFrame:
    """Largest and 95th percentile of edge length over rest length, by frame."""
    r = edge_lengths(rest, edges).select("a", "b", F.col("length").alias("rest"))
    n = edge_lengths(frames, edges, (k,)).join(r, ["a", "b"]).withColumn("s", F.col("length") / F.greatest("rest", F.lit(1e-12)))
    return with_quantiles(n, [k], F.col("s"), {"p95": 0.95}, F.max("s").alias("max")).select(k, "max", "p95")


def face_normals(vertices: DataFrame, faces: DataFrame, by: Names = ()) -> DataFrame:
    t = with_corners(faces, vertices, by=by)
    return t.select(*by, "f", "a", "b", "c", G.cross(G.sub(F.col("pb"), F.col("pa")), G.sub(F.col("pc"), F.col("pa"))).alias("n"))


def fold(frames: DataFrame, faces: DataFrame, k: str = "k") -> DataFrame:
    """90th percentile by frame of the angle between faces that share an edge, then the median over frames."""
    pairs = face_pairs(faces).select("f1", "f2")
    n = face_normals(frames, faces, (k,)).select(k, "f", G.unit(F.col("n")).alias("n"))
    both = pairs.join(n.select(k, F.col("f").alias("f1"), F.col("n").alias("n1")), "f1").join(n.select(k, F.col("f").alias("f2"), F.col("n").alias("n2")), [k, "f2"])
    angle = F.degrees(F.acos(F.least(F.greatest(G.dot(F.col("n1"), F.col("n2")), F.lit(-1.0)), F.lit(1.0))))
    per = quantiles(both, [k], angle, {"p90": 0.9})
    return quantiles(per, [], F.col("p90"), {"fold_p90": 0.5})


def vertex_normals(vertices: DataFrame, faces: DataFrame, by: Names = ()) -> DataFrame:
    """Unit sums of the normals of the faces around each vertex."""
    n = face_normals(vertices, faces, by)
    c = n.select(*by, F.explode(F.array("a", "b", "c")).alias("v"), "n")
    s = c.groupBy(*by, "v").agg(*[F.sum(f"n.{x}").alias(x) for x in "xyz"])
    u = G.unit(F.struct("x", "y", "z"))
    return s.select(*by, "v", u["x"].alias("nx"), u["y"].alias("ny"), u["z"].alias("nz"))


def inverted_tets(rest: DataFrame, frames: DataFrame, tets: DataFrame, k: str = "k") -> DataFrame:
    """Most tetrahedra in any frame whose volume has another sign than at rest."""
    vol = lambda t: F.signum(G.tet_volume(F.col("pa"), F.col("pb"), F.col("pc"), F.col("pd")))
    corners = ("a", "b", "c", "d")
    r = with_corners(tets, rest, corners).select("t", vol(0).alias("s0"))
    n = with_corners(tets, frames, corners, (k,)).select(k, "t", vol(0).alias("s")).join(r, "t")
    return n.groupBy(k).agg(F.sum((F.col("s") != F.col("s0")).cast("long")).alias("n")).agg(F.max("n").alias("inverted_max"))


def tet_measures(vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """Per tetrahedron: mean ratio (12 (3 V)^(2/3) over the sum of squared edges, negative when turned over), volume over the
    median volume, least dihedral angle in degrees, volume over the cube of the longest edge: t, mean_ratio, rel_volume,
    min_dihedral, quality."""
    t = with_corners(tets, vertices, ("a", "b", "c", "d"))
    p = {c: F.col(f"p{c}") for c in "abcd"}
    v = G.tet_volume(*p.values())
    pairs = [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]]
    edge = lambda x, y: G.sub(p[y], p[x])
    squares = sum((G.dot(edge(x, y), edge(x, y)) for x, y in pairs[1:]), G.dot(edge(*pairs[0]), edge(*pairs[0])))

    def dihedral(x: str, y: str) -> Column:
        """Angle at the edge between the two faces that meet there."""
        z, w = (c for c in "abcd" if c not in (x, y))
        e = edge(x, y)
        n1, n2 = G.cross(e, edge(x, z)), G.cross(e, edge(x, w))
        c = G.dot(n1, n2) / F.greatest(G.norm(n1) * G.norm(n2), F.lit(1e-30))
        return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))

    q = t.select("t", v.alias("v"), (F.signum(v) * 12.0 * F.pow(3.0 * F.abs(v), F.lit(2.0 / 3.0)) / F.greatest(squares, F.lit(1e-30))).alias("mean_ratio"), F.least(*[dihedral(x, y) for x, y in pairs]).alias("min_dihedral"), G.tet_quality(*p.values()).alias("quality"))
    med = quantiles(q, [], F.abs(F.col("v")), {"m": 0.5})
    return q.crossJoin(F.broadcast(med)).select("t", "mean_ratio", (F.abs("v") / F.greatest("m", F.lit(1e-30))).alias("rel_volume"), "min_dihedral", "quality")


def tet_report(vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """Quality percentiles, volume over the median volume, smallest: one row."""
    t = with_corners(tets, vertices, ("a", "b", "c", "d"))
    p = [F.col(f"p{c}") for c in "abcd"]
    q = t.select(G.tet_quality(*p).alias("q"), F.abs(G.tet_volume(*p)).alias("v"))
    of_q = with_quantiles(q, [], F.col("q"), {"p1": 0.01, "p5": 0.05, "median": 0.5}, F.min("q").alias("min"), F.min("v").alias("min_volume"))
    return of_q.crossJoin(F.broadcast(quantiles(q, [], F.col("v"), {"median_volume": 0.5}))).select("min", "p1", "p5", "median", "median_volume", "min_volume")


def degenerate_tets(vertices: DataFrame, tets: DataFrame, rel: float = 1e-6) -> DataFrame:
    """Tetrahedra whose volume is under ``rel`` of the median volume."""
    t = with_corners(tets, vertices, ("a", "b", "c", "d")).select("t", F.abs(G.tet_volume(*[F.col(f"p{c}") for c in "abcd"])).alias("v"))
    med = quantiles(t, [], F.col("v"), {"m": 0.5})
    return t.crossJoin(F.broadcast(med)).where(F.col("v") < rel * F.col("m")).select("t", "v")


def mesh_health(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: vertices, faces, components (of faces joined by edges), edges not used twice, watertight, shortest edge,
    degenerate faces, area, volume."""
    use = edge_use(faces)
    lengths = edge_lengths(vertices, use.select("a", "b"))
    t = with_corners(faces, vertices)
    area = G.triangle_area(F.col("pa"), F.col("pb"), F.col("pc"))
    a = vertices.agg(F.count(F.lit(1)).alias("n_vertices"))
    b = t.agg(F.count(F.lit(1)).alias("n_faces"), F.sum((area < 1e-12).cast("long")).alias("n_degenerate"), F.sum(area).alias("area"), (F.sum(G.dot(F.col("pa"), G.cross(F.col("pb"), F.col("pc")))) / 6.0).alias("volume"))
    c = use.agg(F.sum((F.col("n") != 2).cast("long")).alias("n_open_edges"))
    d = lengths.agg(F.min("length").alias("min_edge"))
    joined = min_label_components(face_pairs(faces).select(F.col("f1").alias("a"), F.col("f2").alias("b")), faces.select(F.col("f").alias("node")))
    e = joined.agg(F.count_distinct("root").alias("n_components"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e).withColumn("watertight", F.col("n_open_edges") == 0)


def neighbour_mean(values: DataFrame, edges: DataFrame, x: str) -> DataFrame:
    """(v, mean): mean of ``x`` over the vertices one edge away: one smoothing round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(values.select(F.col("v").alias("b"), F.col(x)), "b").groupBy(F.col("a").alias("v")).agg(F.avg(x).alias("mean"))


def tube(nodes: DataFrame, radius: str, n_around: int = 8) -> DataFrame:
    """Ring vertices around a polyline in its own plane frames: (node, i, x, y, z). nodes: node, x, y, z, radius."""
    w = Window.orderBy("node").partitionBy("path")
    nxt = F.struct(*[F.coalesce(F.lead(c).over(w), F.col(c)).alias(c) for c in "xyz"])
    prv = F.struct(*[F.coalesce(F.lag(c).over(w), F.col(c)).alias(c) for c in "xyz"])
    t = nodes.withColumn("__t", G.unit(G.sub(nxt, prv)))
    up = F.when(F.abs(F.col("__t.z")) < 0.9, G.vec(0, 0, 1)).otherwise(G.vec(1, 0, 0))
    t = t.withColumn("__n", G.unit(G.cross(F.col("__t"), up))).withColumn("__b", G.cross(F.col("__t"), F.col("__n")))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_around - 1))).alias("i"))
    a = F.col("i") * F.lit(2.0 * 3.141592653589793 / n_around)
    p = lambda c: F.col(c) + F.col(radius) * (F.cos(a) * F.col(f"__n.{c}") + F.sin(a) * F.col(f"__b.{c}"))
    return t.select("path", "node", "i", *[p(c).alias(c) for c in "xyz"])


def interpolate_on_faces(hits: DataFrame, faces: DataFrame, attr: DataFrame, x: str) -> DataFrame:
    """Attribute at (f, w0, w1, w2): three lookups and a weighted sum. Adds ``x``."""
    out = hits.join(faces.select("f", "a", "b", "c"), "f")
    for c in "abc":
        out = out.join(attr.select(F.col("v").alias(c), F.col(x).alias(f"__{c}")), c)
    return out.select(*hits.columns, (F.col("w0") * F.col("__a") + F.col("w1") * F.col("__b") + F.col("w2") * F.col("__c")).alias(x))


__all__ = ["degenerate_tets", "edge_lengths", "enclosed_volume", "face_edges", "face_normals", "fold", "interpolate_on_faces", "inverted_tets", "mesh_health", "neighbour_mean", "stretch", "surface_area", "tet_measures", "tet_report", "tube", "vertex_normals", "with_corners"]
