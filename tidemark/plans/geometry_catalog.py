"""Queries on points, pixels and meshes derived from the driver's tables, with their SQL.

Points are the first components of ``embeddings``; pixels are numbers taken from keys; meshes are strips over vector ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import scalars as C
from tidemark.operators import aggregates as A
from tidemark.operators import experiments as X
from tidemark.operators import joins as J
from tidemark.operators import mesh as M
from tidemark.operators import sets as S
from tidemark.operators import windows as W
from tidemark.plans.catalog import ORACLES, QUERIES, query
from tidemark.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

_P = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings"
_DIST3 = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label")


def strip(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and the faces (i, i + 1, i + 2) of a strip."""
    p = points(spark, sf)
    v = p.select(F.col("vec_id").alias("v"), "x", "y", "z")
    f = p.join(p.agg(F.max("vec_id").alias("top")), F.lit(True)).where("vec_id <= top - 2").select(F.col("vec_id").alias("f"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    return v, f


_STRIP = f"WITH p AS ({_P}), t AS (SELECT a.vec_id AS f, a.x ax, a.y ay, a.z az, b.x bx, b.y AS byy, b.z bz, c.x cx, c.y cy, c.z cz FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 JOIN p c ON c.vec_id = a.vec_id + 2), n AS (SELECT f, (byy - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (byy - ay) * (cx - ax) AS nz, ax * (byy * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - byy * cx) AS v6 FROM t)"


@query(_STRIP + " SELECT round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 7) AS area, round(sum(v6) / 6, 9) AS volume FROM n")
def mesh_area_volume(spark, sf):
    v, f = strip(spark, sf)
    return M.surface_area(v, f).crossJoin(M.enclosed_volume(v, f)).select(F.round("area", 7).alias("area"), F.round("volume", 9).alias("volume"))


@query(_STRIP + """, e AS (SELECT f, least(i, j) AS a, greatest(i, j) AS b FROM (SELECT f, f AS i, f + 1 AS j FROM n UNION ALL SELECT f, f + 1, f + 2 FROM n UNION ALL SELECT f, f + 2, f FROM n))
    SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2""")
def edge_use(spark, sf):
    return S.edge_use(strip(spark, sf)[1])


@query(_STRIP + """, u AS (SELECT f, nx / sqrt(nx * nx + ny * ny + nz * nz) AS x, ny / sqrt(nx * nx + ny * ny + nz * nz) AS y, nz / sqrt(nx * nx + ny * ny + nz * nz) AS z FROM n),
    g AS (SELECT degrees(acos(least(greatest(a.x * b.x + a.y * b.y + a.z * b.z, -1), 1))) AS d FROM u a JOIN u b ON b.f = a.f + 1)
    SELECT round(quantile_cont(d, 0.9), 6) AS fold_p90 FROM g""")
def fold_p90(spark, sf):
    v, f = strip(spark, sf)
    return M.fold(v.withColumn("k", F.lit(0)), f).select(F.round("fold_p90", 6).alias("fold_p90"))


@query(_STRIP + """, c AS (SELECT f AS v, nx, ny, nz FROM n UNION ALL SELECT f + 1, nx, ny, nz FROM n UNION ALL SELECT f + 2, nx, ny, nz FROM n), s AS (SELECT v, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM c GROUP BY 1)
    SELECT v, round(x / greatest(sqrt(x * x + y * y + z * z), 1e-12), 6) AS nx, round(y / greatest(sqrt(x * x + y * y + z * z), 1e-12), 6) AS ny, round(z / greatest(sqrt(x * x + y * y + z * z), 1e-12), 6) AS nz FROM s""")
def vertex_normals(spark, sf):
    return M.vertex_normals(*strip(spark, sf)).select("v", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")])


@query(f"""WITH p AS ({_P}), k AS (SELECT unnest([0, 1, 2, 3]) AS k), m AS (SELECT k, vec_id, x * (1 + k / 4.0::DOUBLE) AS x, y + k * z / 10.0::DOUBLE AS y, z FROM p, k),
    r AS (SELECT a.vec_id AS i, b.vec_id AS j, {_DIST3} AS d FROM p a JOIN p b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2)),
    s AS (SELECT a.k, {_DIST3} / greatest(r.d, 1e-12) AS s FROM r JOIN m a ON a.vec_id = r.i JOIN m b ON b.vec_id = r.j AND b.k = a.k)
    SELECT k::INT AS k, round(max(s), 9) AS max, round(quantile_cont(s, 0.95), 9) AS p95 FROM s GROUP BY 1""")
def stretch(spark, sf):
    """Edges of a strip over their rest lengths, in four frames that pull and shear it."""
    v, f = strip(spark, sf)
    frames = v.select("v", "x", "y", "z", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).select("k", "v", (F.col("x") * (1 + F.col("k") / 4.0)).alias("x"), (F.col("y") + F.col("k") * F.col("z") / 10.0).alias("y"), "z")
    return M.stretch(v, frames, S.edge_use(f).select("a", "b")).select("k", F.round("max", 9).alias("max"), F.round("p95", 9).alias("p95"))


@query(f"WITH p AS ({_P}), q AS (SELECT vec_id, x, y, z + 3 AS z FROM p) SELECT vec_id, 320 + 500 * x / z AS u, 240 + 500 * y / z AS v, z AS depth, 320 + 500 * x / z >= 0 AND 320 + 500 * x / z < 330 AND 240 + 500 * y / z >= 0 AND 240 + 500 * y / z < 480 AS inside, least(320 + 500 * x / z, 640 - 1 - (320 + 500 * x / z), 240 + 500 * y / z, 480 - 1 - (240 + 500 * y / z)) AS border FROM q")
def project_points(spark, sf):
    p = points(spark, sf).select("vec_id", G.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    eye = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    q = p.select("vec_id", G.project(F.col("p"), eye, F.lit(500.0), G.vec(0, 0, -3), F.lit(320.0), F.lit(240.0)).alias("q")).select("vec_id", "q.*")
    return q.select("*", G.inside_image(F.col("u"), F.col("v"), F.lit(330), F.lit(480)).alias("inside"), G.border_distance(F.col("u"), F.col("v"), F.lit(640), F.lit(480)).alias("border"))


@query(f"WITH p AS ({_P}) SELECT vec_id, (x > -0.1 AND x < 0.1 AND y > -0.05 AND y < 0.05) AS inside, label % 2 = 0 AND vec_id % 3 = 0 AS keep FROM p WHERE z < 0.1 + 0.006")
def polygon_and_visibility(spark, sf):
    ring = ([-0.1, 0.1, 0.1, -0.1], [-0.05, -0.05, 0.05, 0.05])
    p = points(spark, sf).where(F.col("z") < 0.1 + 0.006)
    arr = lambda xs: F.array(*map(F.lit, xs))
    return p.select("vec_id", G.in_polygon(F.col("x"), F.col("y"), arr(ring[0]), arr(ring[1])).alias("inside"), ((F.col("label") % 2 == 0) & (F.col("vec_id") % 3 == 0)).alias("keep"))


@query(f"WITH p AS ({_P}), a AS (SELECT * FROM p WHERE vec_id % 2 = 0), b AS (SELECT * FROM p WHERE vec_id % 2 = 1), d AS (SELECT a.vec_id, b.vec_id AS near, {_DIST3} AS d FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS r FROM d) SELECT a.vec_id, near AS other, d FROM a LEFT JOIN r ON r.vec_id = a.vec_id AND r.r = 1")
def nearest_point(spark, sf):
    p = points(spark, sf)
    return J.nearest_point(p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "other"), "vec_id", "other", "xyz", 0.15)


@query(f"WITH p AS ({_P}), d AS (SELECT a.vec_id, {_DIST3} AS d FROM p a, p b WHERE a.label <> b.label) SELECT vec_id, count(*) FILTER (d < 0.2) AS n, min(d) AS nearest FROM d GROUP BY 1 HAVING min(d) <= 0.1 AND count(*) FILTER (d < 0.2) >= 3")
def within_reach(spark, sf):
    """Points of every label within reach of points of the other labels."""
    p = points(spark, sf)
    near = J.radius_join(p, p.withColumnRenamed("vec_id", "other"), "vec_id", "other", "xyz", 0.2, strict=False)
    labels = p.select("vec_id", "label")
    near = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("other"), F.col("label").alias("their")), "other").where("label <> their")
    return J.reached(near, "vec_id", 0.1, 0.2, 3)


@query(f"""WITH p AS ({_P}), t AS (SELECT a.vec_id AS t, a.x ax, a.y ay, b.x bx, b.y AS byy, c.x cx, c.y cy, (a.z + b.z + c.z) / 3 AS depth FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 JOIN p c ON c.vec_id = a.vec_id + 2),
    w AS (SELECT p.vec_id, t, depth, (bx - ax) * (cy - ay) - (cx - ax) * (byy - ay) AS det, (x - ax) * (cy - ay) - (cx - ax) * (y - ay) AS d1, (bx - ax) * (y - ay) - (x - ax) * (byy - ay) AS d2 FROM p, t),
    h AS (SELECT vec_id, t, depth, d1 / det AS w1, d2 / det AS w2 FROM w WHERE det <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY depth, t) AS r FROM h WHERE 1 - w1 - w2 >= -0.000001 AND w1 >= -0.000001 AND w2 >= -0.000001)
    SELECT vec_id, t, round(1 - w1 - w2, 9) AS w0, round(w1, 9) AS w1, round(w2, 9) AS w2 FROM k WHERE r = 1""")
def point_in_triangle(spark, sf):
    """Every point in the front-most of all triangles of the strip."""
    p = points(spark, sf)
    c = lambda k, n: p.select((F.col("vec_id") - k).alias("t"), F.col("x").alias(n + "x"), F.col("y").alias(n + "y"), F.col("z").alias(n + "z"))
    tri = c(0, "a").join(c(1, "b"), "t").join(c(2, "c"), "t").withColumn("depth", (F.col("az") + F.col("bz") + F.col("cz")) / 3)
    return J.in_triangles(p, tri, "vec_id", "t", 0.1, 1e-6, "depth").select("vec_id", "t", *[F.round(w, 9).alias(w) for w in ("w0", "w1", "w2")])


_IMG = "WITH img AS (SELECT u, v, avg(s_acctbal) AS z FROM (SELECT s_nationkey::BIGINT AS u, s_suppkey % 10 AS v, s_acctbal FROM supplier) GROUP BY 1, 2)"


def image(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("u"), (F.col("s_suppkey") % 10).alias("v")).agg(F.avg("s_acctbal").alias("z"))


@query(_IMG + """, q AS (SELECT o_orderkey AS key, least(greatest((o_totalprice % 30) - 2, 0), 24) AS x, least(greatest((o_custkey % 120) / 10.0::DOUBLE - 1, 0), 9) AS y FROM orders),
    c AS (SELECT key, least(floor(x) + dx, 24)::BIGINT AS u, least(floor(y) + dy, 9)::BIGINT AS v, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dx, dy))
    SELECT key, round(sum(w * z), 6) AS z FROM c JOIN img USING (u, v) GROUP BY 1""")
def bilinear_lookup(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") % 30 - 2).alias("x"), ((F.col("o_custkey") % 120) / 10.0 - 1).alias("y"))
    return J.lookup_bilinear(q, image(spark, sf), "key", "x", "y", 25, 10, "z").select("key", F.round("z", 6).alias("z"))


@query(_IMG + """ SELECT o_orderkey, z FROM (SELECT o_orderkey, least(greatest(o_custkey % 30 - 2, 0), 24) AS u, least(greatest(o_custkey % 13 - 1, 0), 9) AS v FROM orders) LEFT JOIN img USING (u, v)""")
def clamped_lookup(spark, sf):
    q = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 30 - 2).alias("x"), (F.col("o_custkey") % 13 - 1).alias("y"))
    return J.lookup_clamped(q, image(spark, sf), "x", "y", 25, 10, "z").select("o_orderkey", "z")


@query("""
    WITH RECURSIVE px AS (SELECT DISTINCT c_custkey % 120 AS u, floor((c_acctbal + 1000) / 110)::BIGINT AS v FROM customer), id AS (SELECT u, v, v * 120 + u AS n FROM px),
    e AS (SELECT a.n AS a, b.n AS b FROM id a JOIN id b ON abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1), r(n, root) AS (SELECT n, n FROM id UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n),
    l AS (SELECT u, v, min(root) AS label FROM r JOIN id USING (n) GROUP BY 1, 2), s AS (SELECT label, count(*) AS area FROM l GROUP BY 1)
    SELECT u, v, label FROM l WHERE label IN (SELECT label FROM s WHERE area >= 0.05 * (SELECT max(area) FROM s))
""")
def pixel_components(spark, sf):
    """Customers as pixels (number, balance): components of at least 5 % of the largest."""
    px = table(spark, sf, "customer").select((F.col("c_custkey") % 120).alias("u"), F.floor((F.col("c_acctbal") + 1000) / 110).alias("v"))
    return S.components_by_size(S.pixel_components(px, 120), 0.05)


@query("""
    WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, value FROM events),
    w AS (SELECT k, exp(-0.5::DOUBLE * (k / 2.0::DOUBLE) ** 2) AS w FROM range(-8, 9) t(k)),
    j AS (SELECT event_id, user_id, n, w.w, ((i - 1 + k) % (2 * n) + 2 * n) % (2 * n) AS m FROM x, w)
    SELECT j.event_id, round(sum(j.w / (SELECT sum(w) FROM w) * x.value), 6) AS g FROM j JOIN x ON x.user_id = j.user_id AND x.i - 1 = CASE WHEN m < j.n THEN m ELSE 2 * j.n - 1 - m END GROUP BY 1
""")
def gaussian_smooth(spark, sf):
    return W.gaussian_smooth(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 2.0, "g").select("event_id", F.round("g", 6).alias("g"))


@query("""
    WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value FROM events),
    t AS (SELECT DISTINCT user_id, k AS i, (n - 1) * k / 49.0::DOUBLE AS t, n FROM x, range(0, 50) r(k))
    SELECT t.user_id, t.i::INT AS i, a.value + (b.value - a.value) * (t - floor(t)) AS value FROM t JOIN x a ON a.user_id = t.user_id AND a.i = floor(t) JOIN x b ON b.user_id = t.user_id AND b.i = least(floor(t) + 1, t.n - 1)
""")
def resample_50(spark, sf):
    return W.resample_rows(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 50)


@query("""
    WITH x AS (SELECT *, row_number() OVER w AS i, abs(value - first(value) OVER f) > 20 AS a, abs(value - last(value) OVER f) > 20 AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    r AS (SELECT event_id, i, min(CASE WHEN a THEN i END) OVER (PARTITION BY user_id) AS lo, max(CASE WHEN b THEN i END) OVER (PARTITION BY user_id) AS hi FROM x)
    SELECT event_id FROM r WHERE i BETWEEN coalesce(lo, 1) AND coalesce(hi, i) + 1
""")
def trim_still(spark, sf):
    return W.trim_still(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["value"], 20.0).select("event_id")


@query("""
    SELECT event_id, sum(coalesce(CASE WHEN event_type <> 'view' THEN value END, 0)) OVER w - coalesce(first(CASE WHEN event_type <> 'view' THEN value END) OVER w, 0) AS run, least(greatest((row_number() OVER w - 3 + 5) / 5.0::DOUBLE, 0), 1) AS ramp
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_and_ramp(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value"))).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = W.running_from_start(e, ["user_id"], ["ts", "event_id"], "v", "run")
    return e.select("event_id", "run", C.ramp(F.col("i"), -2.0, 5.0).alias("ramp"))


@query("""
    WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)
    SELECT a.event_id, list_sort(list(b.value))[3] AS med FROM x a, (VALUES (-2), (-1), (0), (1), (2)) o(k), x b WHERE b.user_id = a.user_id AND b.i = least(greatest(a.i + k, 1), a.n) GROUP BY 1
""")
def median_filter_5(spark, sf):
    return W.median_filter(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5, "med").select("event_id", "med")


@query("""
    WITH x AS (SELECT o_custkey, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    d AS (SELECT *, coalesce(abs(p - lag(p) OVER (PARTITION BY o_custkey ORDER BY i)), 0) AS d FROM x),
    s AS (SELECT *, sum(d) OVER (PARTITION BY o_custkey ORDER BY i) AS s FROM d),
    n AS (SELECT *, lead(s) OVER w AS s2, lead(p) OVER w AS p2, max(s) OVER (PARTITION BY o_custkey) AS len FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY i)),
    t AS (SELECT *, len * k / 9.0::DOUBLE AS t FROM n, range(0, 10) r(k))
    SELECT o_custkey, k::INT AS i, CASE WHEN s2 IS NULL THEN p ELSE p + coalesce((t - s) / (s2 - s) * (p2 - p), 0) END AS p FROM t WHERE (t >= s AND t < s2) OR (s2 IS NULL AND t >= s)
""")
def resample_path(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_totalprice", "p")
    return W.resample_path(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["p"], 10).select("o_custkey", "i", "p")


@query("""
    WITH e AS (SELECT * FROM events), lo AS (SELECT user_id, quantile_cont(value, 0.5) AS a FROM events WHERE event_type = 'signup' AND event_id % 10 = 0 GROUP BY 1), hi AS (SELECT user_id, avg(value) AS b FROM events GROUP BY 1),
    u AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id, coalesce(a, b) AS v FROM u LEFT JOIN lo USING (user_id) LEFT JOIN hi USING (user_id)
""")
def fallback_cascade(spark, sf):
    e = table(spark, sf, "events")
    first = e.where("event_type = 'signup' and event_id % 10 = 0").groupBy("user_id").agg(F.percentile("value", 0.5).alias("v"))
    return J.with_fallback(e.select("user_id").distinct(), first, e.groupBy("user_id").agg(F.avg("value").alias("v")), ["user_id"], "v")


@query("SELECT r_name, n, g FROM region, (VALUES (1), (2), (4)) a(n), (VALUES ('x'), ('y')) b(g)")
def layouts(spark, sf):
    r = table(spark, sf, "region").select("r_name")
    return J.layouts(r, spark.createDataFrame([(1,), (2,), (4,)], "n int"), spark.createDataFrame([("x",), ("y",)], "g string"))


@query("SELECT l_suppkey % 50 AS i, sum(l_quantity) AS sum, min(l_quantity) AS min, count(*) AS n FROM lineitem GROUP BY 1")
def scatter_add(spark, sf):
    return A.scatter(table(spark, sf, "lineitem").withColumn("i", F.col("l_suppkey") % 50), "i", "l_quantity")


@query("""
    SELECT p_brand, avg(p_retailprice) AS mean, min(p_retailprice) AS min, count(*) AS n, grouping(p_brand)::INT AS total FROM part GROUP BY ROLLUP (p_brand)
""")
def band_extremes(spark, sf):
    return A.band_extremes(table(spark, sf, "part"), "p_brand", "p_retailprice")


@query("SELECT l_partkey, CASE WHEN count(*) > 30 THEN quantile_cont(l_extendedprice, 0.5) END AS median FROM lineitem GROUP BY 1")
def guarded_median(spark, sf):
    return A.guarded_median(table(spark, sf, "lineitem"), ["l_partkey"], F.col("l_extendedprice"), 30, "median")


@query("""
    SELECT s_suppkey, (round_even((least(greatest(s_acctbal / 30000, -0.4), 0.4) - 0) * (65534.0::DOUBLE / 0.8), 0))::SMALLINT AS q FROM supplier
""")
def quantise(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", C.quantize16(F.col("s_acctbal") / 30000, -0.4, 0.4).alias("q"))


@query("""
    SELECT p_partkey, greatest(r, g, b) > 225 AND CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b) ELSE 0 END < 90 AS specular
    FROM (SELECT p_partkey, p_partkey * 37 % 256 AS r, 200 + p_size AS g, 180 + p_partkey % 76 AS b FROM part)
""")
def specular(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", C.is_specular(F.col("p_partkey") * 37 % 256, 200 + F.col("p_size"), 180 + F.col("p_partkey") % 76).alias("specular"))


@query("""
    SELECT o_orderkey, split_part(k, '+', 1) AS base, CASE WHEN position('+' IN k) > 0 THEN substr(k, position('+' IN k) + 1) ELSE '' END AS variant, translate('a=1,b=' || o_orderkey, ',', '_') AS slug FROM (SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '+v' || o_custkey ELSE '' END AS k FROM orders)
""")
def name_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("+v"), F.col("o_custkey").cast("string"))).otherwise("")).alias("k"))
    base, var = C.split_name(F.col("k"))
    return o.select("o_orderkey", base.alias("base"), var.alias("variant"), C.config_slug(F.concat(F.lit("a=1,b="), F.col("o_orderkey").cast("string"))).alias("slug"))


@query("""
    WITH p AS (SELECT l_suppkey, l_orderkey, l_extendedprice AS cost, l_linenumber, l_partkey FROM lineitem)
    SELECT l_suppkey, cost, l_partkey FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY cost, l_orderkey, l_linenumber, l_partkey) = 1
""")
def best_of_several(spark, sf):
    return X.first_best(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_partkey"]).select("l_suppkey", "cost", "l_partkey")


@query("SELECT l_suppkey, quantile_cont(l_extendedprice / l_quantity, 0.01) AS p1, quantile_cont(l_extendedprice / l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1")
def rest_candidates(spark, sf):
    return X.rest_candidates(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_extendedprice") / F.col("l_quantity"))


@query(f"""
    WITH p AS ({_P}) SELECT vec_id, sqrt(greatest((x - (-0.2 + t * 0.4)) ** 2 + y ** 2 + (z - (-0.1 + t * 0.2)) ** 2, 0)) AS d FROM (SELECT *, least(greatest(((x + 0.2) * 0.4 + (z + 0.1) * 0.2) / (0.4 * 0.4 + 0.2 * 0.2), 0), 1) AS t FROM p)
""")
def segment_distance(spark, sf):
    p = points(spark, sf)
    return p.select("vec_id", G.segment_distance(G.vec(F.col("x"), F.col("y"), F.col("z")), G.vec(-0.2, 0, -0.1), G.vec(0.2, 0, 0.1)).alias("d"))


@query(f"""
    WITH p AS ({_P}), m AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM p)
    SELECT vec_id, round(atan2(-(x * cos(0.3::DOUBLE) + y * sin(0.3::DOUBLE)), y * cos(0.3::DOUBLE) - x * sin(0.3::DOUBLE)), 9) AS yaw, round(asin(least(greatest(-z / greatest(n, 1e-12), -1), 1)), 9) AS pitch, n AS insertion, round(degrees(2 * atan(n / 2)), 9) AS fov FROM m
""")
def inverse_kinematics(spark, sf):
    p = points(spark, sf).select("vec_id", G.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    j = p.select("vec_id", G.shaft_joints(G.vec(0, 0, 0), F.col("p"), F.lit(0.3)).alias("j"))
    return j.select("vec_id", F.round("j.yaw", 9).alias("yaw"), F.round("j.pitch", 9).alias("pitch"), F.col("j.insertion").alias("insertion"), F.round(G.field_of_view(F.lit(1.0), F.col("j.insertion")), 9).alias("fov"))


@query("""
    WITH s AS (SELECT DISTINCT c_custkey % 40 AS x, floor((c_acctbal + 1000) / 275)::BIGINT AS y FROM customer), q AS (SELECT a.x, a.y FROM s a JOIN s b ON b.x = a.x + 1 AND b.y = a.y JOIN s c ON c.x = a.x AND c.y = a.y + 1 JOIN s d ON d.x = a.x + 1 AND d.y = a.y + 1)
    SELECT x AS ax, y AS ay, x + 1 AS bx, CASE WHEN k = 0 THEN y ELSE y + 1 END AS "by", CASE WHEN k = 0 THEN x + 1 ELSE x END AS cx, y + 1 AS cy FROM q, (VALUES (0), (1)) t(k)
""")
def grid_mesh(spark, sf):
    return S.grid_mesh(table(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("x"), F.floor((F.col("c_acctbal") + 1000) / 275).alias("y")))
