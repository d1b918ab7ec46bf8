"""Set algebra over keys, pixels, edges and faces; components and small-grid morphology as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

Names = Sequence[str]


def union_sets(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Row union of blocks, each row tagged with its block's name."""
    out = None
    for tag, df in parts.items():
        df = df.withColumn("tag", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def difference(a: DataFrame, b: DataFrame, keys: Names) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: Names) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def first_occurrence(df: DataFrame, key: Column, order: Names) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy("__key").orderBy(*order)
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def undirected_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with a < b: distinct pairs and how often each occurs."""
    e = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def face_edges(faces: DataFrame, f: str = "f") -> DataFrame:
    """(f, a, b) with a < b: three edges of every face (a, b, c)."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return faces.select(f, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).select(f, "e.a", "e.b")


def edge_use(faces: DataFrame) -> DataFrame:
    """(a, b, n): how many faces use each edge; n other than 2 is an open or branching edge."""
    return face_edges(faces).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def boundary_faces(tets: DataFrame) -> DataFrame:
    """Faces of tetrahedra (t, a, b, c, d) that occur once, with their orientation: (t, a, b, c)."""
    face = lambda x, y, z: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("c"))
    four = F.array(face("b", "c", "d"), face("a", "d", "c"), face("a", "b", "d"), face("a", "c", "b"))
    f = tets.select("t", F.explode(four).alias("f")).select("t", "f.*").withColumn("k", F.sort_array(F.array("a", "b", "c")))
    return f.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "a", "b", "c")).alias("f")).where("n = 1").select("f.*")


def renumber(df: DataFrame, columns: Names, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with ids 0..n-1 in the order of the old ones, dictionary (old, new)).

    New ids come from a range sort and the sizes of its partitions, not from a window over everything.
    """
    ids = used if used is not None else union_sets(*[df.select(F.col(c).alias("old")) for c in columns])
    placed = materialize(ids.orderBy("old").withColumn("m", F.monotonically_increasing_id()), "ids")
    placed = placed.withColumn("p", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = placed.join(F.broadcast(before.select("p", "before")), "p").select("old", (F.col("before") + F.col("i")).alias("new"))
    for c in columns:
        df = df.join(names.select(F.col("old").alias(c), F.col("new").alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    return df, names


def face_pairs(faces: DataFrame, f: str = "f") -> DataFrame:
    """Pairs of faces that share an edge; with more than two, neighbours in face order: (a, b, f1, f2)."""
    w = Window.partitionBy("a", "b").orderBy(f)
    e = face_edges(faces, f).withColumn("f2", F.lead(f).over(w))
    return e.where("f2 is not null").select("a", "b", F.col(f).alias("f1"), "f2")


def grid_neighbours(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y, nx, ny): four-neighbours that are cells too."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    n = cells.select(x, y).distinct().select(x, y, step).select(x, y, (F.col(x) + F.col("s.dx")).alias("nx"), (F.col(y) + F.col("s.dy")).alias("ny"))
    return n.join(cells.select(F.col(x).alias("nx"), F.col(y).alias("ny")).distinct(), ["nx", "ny"], "left_semi")


def grid_degree(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    d = grid_neighbours(cells, x, y).groupBy(x, y).agg(F.count(F.lit(1)).alias("degree"))
    return cells.select(x, y).distinct().join(d, [x, y], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def grid_mesh(cells: DataFrame) -> DataFrame:
    """Two triangles for every square whose four corners (x, y) are there: (ax, ay, bx, by, cx, cy)."""
    at = lambda dx, dy, n: cells.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")).distinct().withColumn(n, F.lit(True))
    sq = cells.select("x", "y").distinct().join(at(1, 0, "r"), ["x", "y"]).join(at(0, 1, "u"), ["x", "y"]).join(at(1, 1, "d"), ["x", "y"])
    p = lambda dx, dy: (F.col("x") + dx, F.col("y") + dy)
    tri = lambda *c: F.struct(*[v.alias(n) for v, n in zip(sum(c, ()), ("ax", "ay", "bx", "by", "cx", "cy"))])
    return sq.select(F.explode(F.array(tri(p(0, 0), p(1, 0), p(1, 1)), tri(p(0, 0), p(1, 1), p(0, 1)))).alias("t")).select("t.*")


def dilate(px: DataFrame, by: Names, radius: int, shape: str = "square") -> DataFrame:
    """Pixels within ``radius`` of a pixel (square, cross or disc): an explode of offsets and a distinct."""
    r = range(-radius, radius + 1)
    keep = {"square": lambda x, y: True, "cross": lambda x, y: x == 0 or y == 0, "disc": lambda x, y: x * x + y * y <= radius * radius}[shape]
    off = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in r for y in r if keep(x, y)])).alias("o")
    return px.select(*by, "u", "v", off).select(*by, (F.col("u") + F.col("o.x")).alias("u"), (F.col("v") + F.col("o.y")).alias("v")).distinct()


def erode(px: DataFrame, by: Names, radius: int = 1) -> DataFrame:
    """Pixels all of whose square neighbourhood is there: counts of neighbours, no negation of the image."""
    side = 2 * radius + 1
    r = range(-radius, radius + 1)
    off = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in r for y in r])).alias("o")
    hits = px.select(*by, "u", "v").distinct().select(*by, "u", "v", off).select(*by, (F.col("u") + F.col("o.x")).alias("u"), (F.col("v") + F.col("o.y")).alias("v"))
    return hits.groupBy(*by, "u", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side * side).drop("n")


def outline(px: DataFrame, by: Names) -> DataFrame:
    """Pixels that erosion takes away."""
    return px.select(*by, "u", "v").distinct().join(erode(px, by), [*by, "u", "v"], "left_anti")


def remaining(px: DataFrame, taken: DataFrame, by: Names, radius: int) -> DataFrame:
    """Pixels not within ``radius`` of the taken ones: what is static, visible or known."""
    return px.join(dilate(taken, by, radius), [*by, "u", "v"], "left_anti")


def boundary_agreement(a: DataFrame, b: DataFrame, by: Names, tol: int) -> DataFrame:
    """F of two outlines: shares of each within ``tol`` pixels of the other (Euclid); 0 where either is empty."""
    oa, ob = outline(a, by), outline(b, by)
    near_b, near_a = dilate(ob, by, tol, "disc"), dilate(oa, by, tol, "disc")
    count = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    keys = [*by, "u", "v"]
    out = count(oa, "na").join(count(ob, "nb"), list(by), "full")
    out = out.join(count(oa.join(near_b, keys, "left_semi"), "ha"), list(by), "left").join(count(ob.join(near_a, keys, "left_semi"), "hb"), list(by), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    p, r = zero("ha") / F.greatest(zero("na"), F.lit(1)), zero("hb") / F.greatest(zero("nb"), F.lit(1))
    return out.select(*by, F.when((zero("na") == 0) | (zero("nb") == 0), 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours of a node to the least of them: larger neighbours to it (large), or smaller ones and itself (small)."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without an edge are not listed.

    ``edges`` has long columns u and v; loops and repeats do no harm. Minima are combined before the shuffle and hot
    nodes' rows are split by adaptive joins. The number of rounds follows the logarithm of the longest path; a labelling
    that has not settled after ``rounds`` is an error.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    links = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())


def min_label_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root) by ``connected_components`` of edges (a, b); with ``nodes``, those without an edge are their own root."""
    out = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "left").withColumn("root", F.coalesce("root", "node"))


def pixel_components(px: DataFrame, width: int, diagonal: bool = True) -> DataFrame:
    """Pixels with ``label``: the least v * width + u joined to it."""
    ids = px.select("u", "v", (F.col("v") * width + F.col("u")).cast("long").alias("node")).distinct()
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if diagonal else [])
    off = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("o")
    e = ids.select("node", "u", "v", off).select(F.col("node").alias("a"), (F.col("u") + F.col("o.x")).alias("u"), (F.col("v") + F.col("o.y")).alias("v"))
    e = e.join(ids.select("u", "v", F.col("node").alias("b")), ["u", "v"]).select("a", "b")
    return ids.join(min_label_components(e, ids), "node").select("u", "v", F.col("root").alias("label"))


def components_by_size(labelled: DataFrame, share: float | None = None) -> DataFrame:
    """The largest component (of equals the least label), or all of at least ``share`` of the largest."""
    n = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("area"))
    if share is None:
        best = n.agg(F.min(F.struct((-F.col("area")).alias("a"), "label")).alias("b")).select(F.col("b.label").alias("label"))
    else:
        best = n.crossJoin(F.broadcast(n.agg(F.max("area").alias("top")))).where(F.col("area") >= share * F.col("top")).select("label")
    return labelled.join(best, "label", "left_semi")


def fill_holes(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels and the background components that touch no border of the width x height image."""
    grid = px.sparkSession.range(width * height).select((F.col("id") % width).alias("u"), F.floor(F.col("id") / width).alias("v"))
    p = px.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct()
    back = pixel_components(grid.join(p, ["u", "v"], "left_anti"), width, diagonal=False)
    touch = back.where((F.col("u") == 0) | (F.col("v") == 0) | (F.col("u") == width - 1) | (F.col("v") == height - 1)).select("label").distinct()
    return p.unionByName(back.join(touch, "label", "left_anti").select("u", "v"))


def voxel_means(df: DataFrame, coords: Names, size: float) -> DataFrame:
    """Mean of each coordinate by cell of side ``size`` from the least corner: (cell columns, means, n)."""
    low = df.agg(*[F.min(c).alias(f"__m{c}") for c in coords])
    cell = df.crossJoin(F.broadcast(low))
    cols = [F.floor((F.col(c) - F.col(f"__m{c}")) / F.lit(size)).alias(f"cell_{c}") for c in coords]
    return cell.select(*cols, *coords).groupBy(*[f"cell_{c}" for c in coords]).agg(*[F.avg(c).alias(c) for c in coords], F.count(F.lit(1)).alias("n"))
