"""Selections and constructions on bodies, sheets, tubes and tools, as relations and small per-group kernels.

Vertices are rows (v, x, y, z), with a frame k where they move; faces (f, a, b, c); pixels (k, u, v). Poses are (k, rot, f,
pos), one row a frame. A frame, a mesh or a curve is a group, so its size is that of the thing and not of the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.scalars import clip
from tidemark.operators import windows as W
from tidemark.operators.aggregates import quantiles
from tidemark.operators.joins import neighbours, optional_join
from tidemark.operators.kernels import _grouped, _on_mesh, mesh_hits
from tidemark.operators.measures import fill_nearest, indentation, ring_median
from tidemark.operators.mesh import vertex_normals
from tidemark.operators.sets import face_edges, min_label_components
from tidemark.session import materialize

Names = Sequence[str]


# ---- vertices


def nonmanifold_vertices(faces: DataFrame) -> DataFrame:
    """Vertices (v) whose faces form more than one fan: around them, faces that share an edge are joined, and more than one
    group is left."""
    corner = faces.select(F.col("f"), F.explode(F.array("a", "b", "c")).alias("v"))
    # a face at one of its corners is a node; two nodes of one corner are joined if their faces share an edge there
    e = face_edges(faces).select("f", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("p")).select("f", "p.v", "p.w")
    first = Window.partitionBy("v", "w")
    star = e.withColumn("g", F.min("f").over(first))
    ids = corner.select("v", "f", F.xxhash64("v", "f").alias("node"))
    links = star.select(F.xxhash64("v", "f").alias("a"), F.xxhash64("v", "g").alias("b"))
    fans = ids.join(min_label_components(links, ids), "node").groupBy("v").agg(F.count_distinct("root").alias("n"))
    return fans.where("n > 1").select("v")


def bed_vertices(vertices: DataFrame, attached: DataFrame, target: str = "backdrop", frac: float = 0.45, depth: str = "depth") -> DataFrame:
    """Vertices (v) attached (v, to) to the target; where there are none, the back part: deeper than the (1 - frac) quantile."""
    own = vertices.join(attached.where(F.col("to") == target).select("v").distinct(), "v", "left_semi").select("v", F.lit(True).alias("own"))
    cut = quantiles(vertices, [], F.col(depth), {"__q": 1 - frac})
    back = vertices.crossJoin(F.broadcast(cut)).where(F.col(depth) > F.col("__q")).select("v", F.lit(False).alias("own"))
    any_own = own.agg((F.count(F.lit(1)) > 0).alias("__any"))
    return own.unionByName(back).crossJoin(F.broadcast(any_own)).where(F.col("own") == F.col("__any")).select("v")


def vertices_facing(vertices: DataFrame, faces: DataFrame, view: tuple[float, float, float], more_than: float) -> DataFrame:
    """Surface vertices (v) whose unit normal has more than so much of the view direction: those that face away."""
    n = vertex_normals(vertices, faces)
    return n.where(F.col("nx") * view[0] + F.col("ny") * view[1] + F.col("nz") * view[2] > more_than).select("v")


def suggested_attachments(vertices: DataFrame, faces: DataFrame, view: tuple[float, float, float], tip: tuple[float, float, float], seen: DataFrame, sheet: DataFrame, cos: float = 0.35, reach: float = 0.006) -> DataFrame:
    """Attachment rows (v, to, ord) in order: the back to the backdrop, vertices within ``reach`` of the tip to the ducts, front
    vertices over a sheet's pixels to the membrane. A vertex may be in several parts and then has several rows.

    seen: (v, u, w, facing), projections and dot of normal and view ray; sheet: (u, v) pixels.
    """
    surface = vertices.join(faces.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct(), "v", "left_semi")
    back = vertices_facing(vertices, faces, view, cos)
    near = surface.where(G.norm(G.sub(F.struct("x", "y", "z"), G.vec(*tip))) < reach).select("v")
    front = seen.where("facing < 0").select(F.col("v"), F.floor("u").cast("long").alias("u"), F.floor("w").cast("long").alias("w"))
    over = front.join(sheet.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("w")).distinct(), ["u", "w"]).select("v").join(surface.select("v"), "v", "left_semi")
    out = None
    for i, (df, to) in enumerate(((back, "backdrop"), (near, "ducts"), (over, "membrane"))):
        part = df.select("v", F.lit(to).alias("to"), F.struct(F.lit(i).alias("part"), "v").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def driven_nodes(cables: DataFrame) -> DataFrame:
    """Nodes of a cable that follow its record, by mode: cables (cable, n, mode, is_duct, start, end) to (cable, node).

    The far end if it hangs on the backdrop; both ends in modes ends, mid and mid2; one inner node in mid and glue_mid (half
    way along a duct, a third along others); two in mid2 and glue_mid2 (a quarter and half; one and two thirds).
    """
    n, mode, duct = F.col("n"), F.col("mode"), F.col("is_duct")
    at = lambda a, b: F.floor(n * a / b).cast("int")
    rules = [
        F.when(F.col("end") == "backdrop", F.array((n - 1).cast("int"))),
        F.when(mode.isin("ends", "mid", "mid2"), F.array(F.lit(0))),
        F.when(mode.isin("mid", "glue_mid"), F.array(F.when(duct, at(1, 2)).otherwise(at(1, 3)))),
        F.when(mode.isin("mid2", "glue_mid2"), F.when(duct, F.array(at(1, 2), at(1, 4))).otherwise(F.array(at(1, 3), at(2, 3)))),
    ]
    empty = F.array().cast("array<int>")
    nodes = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(r, empty) for r in rules])))
    return cables.select("cable", F.explode(nodes).alias("node"))


def simulated_parts(tissues: DataFrame) -> DataFrame:
    """How each tissue is simulated: (tissue, kind, dim): its tubes as cables, a body with tetrahedra as a solid, a surface
    with ``merge`` > 0 as a coarser surface, any other as it is. tissues: (tissue, has_tubes, has_tets, solid, merge)."""
    kind = F.when(F.col("has_tubes"), "cables").when(F.col("solid") & F.col("has_tets"), "solid").when(F.col("merge") > 0, "merged").otherwise("surface")
    return tissues.select("tissue", kind.alias("kind")).withColumn("dim", F.when(F.col("kind") == "cables", 1).when(F.col("kind") == "solid", 3).otherwise(2))


def pushed_outside(points: DataFrame, planes: DataFrame, by: Names, step: float = 0.002, most: int = 40) -> DataFrame:
    """Points (by, id, x, y, z, dx, dy, dz) moved along their rays in whole steps until outside a convex hull, ``most`` steps at
    most: by, id, x, y, z, steps. planes: (by, nx, ny, nz, d), inside where n . p <= d for all.

    Leaving a convex body is crossing one of its planes, so the number of steps is the least over the planes, worked out and
    not tried.
    """
    j = points.join(planes, list(by))
    dot = lambda a, b: sum((F.col(x) * F.col(y) for x, y in list(zip(a, b))[1:]), F.col(a[0]) * F.col(b[0]))
    depth = F.col("d") - dot(("nx", "ny", "nz"), ("x", "y", "z"))
    rate = dot(("nx", "ny", "nz"), ("dx", "dy", "dz")) * F.lit(step)
    j = j.withColumn("__depth", depth).withColumn("__need", F.when(depth < 0, F.lit(0)).when(rate > 0, (F.floor(depth / rate) + 1).cast("int")))
    keys = [*by, "id"]
    g = j.groupBy(*keys).agg(F.min("__need").alias("__n"))
    n = F.least(F.coalesce("__n", F.lit(most)), F.lit(most))
    return points.join(g, keys, "left").withColumn("steps", F.coalesce(n, F.lit(0))).select(*keys, *[(F.col(c) + F.col("steps") * F.lit(step) * F.col(f"d{c}")).alias(c) for c in "xyz"], "steps")


def hull_planes(df: DataFrame, by: Names) -> DataFrame:
    """Planes of the convex hull of points (x, y, z): by, nx, ny, nz, d. Incremental, one body a group."""

    def hull(pdf: pd.DataFrame):
        p = np.unique(pdf[["x", "y", "z"]].to_numpy(float), axis=0)
        if len(p) < 4:
            return []
        a = int(p[:, 0].argmin())
        b = int(((p - p[a]) ** 2).sum(1).argmax())
        c = int(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1).argmax())
        n = np.cross(p[b] - p[a], p[c] - p[a])
        d = int(np.abs((p - p[a]) @ n).argmax())
        if abs((p[d] - p[a]) @ n) < 1e-18:
            return []
        mid = p[[a, b, c, d]].mean(0)

        def plane(i, j, k):
            m = np.cross(p[j] - p[i], p[k] - p[i])
            m /= max(np.linalg.norm(m), 1e-300)
            return ((i, j, k), m, float(m @ p[i])) if m @ (mid - p[i]) <= 0 else ((i, k, j), -m, float(-m @ p[i]))

        faces = [plane(*t) for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))]
        tol = 1e-12 * max(float(np.abs(p).max()), 1.0)
        for q in range(len(p)):
            seen = [f for f in faces if f[1] @ p[q] > f[2] + tol]
            if not seen:
                continue
            edges = {}
            for (i, j, k), _, _ in seen:
                for e in ((i, j), (j, k), (k, i)):
                    edges[e] = True
            rim = [e for e in edges if (e[1], e[0]) not in edges]
            gone = {id(f) for f in seen}
            faces = [f for f in faces if id(f) not in gone] + [plane(i, j, q) for i, j in rim]
        return [(*map(float, m), d) for _, m, d in faces]

    return _grouped(df, by, "nx double, ny double, nz double, d double", hull)


# ---- sheets


def tent(apex: DataFrame, base: DataFrame, grid: DataFrame, by: Names, width: float) -> DataFrame:
    """Surface between an apex line and a base curve: A + s (m - A) + s^p (B(t) - m) + (1 - s) (t - 1/2) width e, with m the mean
    and e the unit span of the base: by, v, x, y, z.

    apex: (by, x, y, z, p); base: (by, node, x, y, z), nodes evenly spaced in t; grid: (v, s, t).
    """
    b = base.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("node", "x", "y", "z"))).alias("b"), F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("m"))
    a = apex.select(*by, F.struct("x", "y", "z").alias("a"), "p").join(b, list(by)).crossJoin(F.broadcast(grid))
    last = F.size("b") - 1
    at = F.col("t") * last
    i = F.least(F.floor(at), last - 1).cast("int")
    curve = lambda c: F.get("b", i)[c] + (F.get("b", i + 1)[c] - F.get("b", i)[c]) * (at - i)
    e = G.unit(G.sub(F.struct(*[F.get("b", last)[c].alias(c) for c in "xyz"]), F.struct(*[F.get("b", F.lit(0))[c].alias(c) for c in "xyz"])), 1e-9)
    s, t = F.col("s"), F.col("t")
    p = lambda c: F.col("a")[c] + s * (F.col("m")[c] - F.col("a")[c]) + F.pow(s, F.col("p")) * (curve(c) - F.col("m")[c]) + (1 - s) * (t - 0.5) * F.lit(width) * e[c]
    return a.select(*by, "v", *[p(c).alias(c) for c in "xyz"])


def best_exponent(scored: DataFrame, k: str = "k") -> DataFrame:
    """Per frame the first of the exponents in grid order that has the largest iou: (k, p, iou). scored: (k, ord, p, iou)."""
    return scored.groupBy(k).agg(F.min(F.struct((-F.col("iou")).alias("i"), "ord", "p")).alias("b")).select(k, "b.p", (-F.col("b.i")).alias("iou"))


def smoothed_tent(track: DataFrame, by: Names, k: str, columns: Names, width: int, sigma: float) -> DataFrame:
    """Columns of a series after a running median of ``width`` and a Gaussian of ``sigma`` frames, ends repeated. Apexes take 5
    and 2, base curves 9 and 4, exponents 9 and 4."""
    t = track
    for c in columns:
        t = W.gaussian_smooth(W.median_filter(t, by, [k], c, width, "__m"), by, [k], "__m", sigma, "__g", edge="nearest").drop("__m", c).withColumnRenamed("__g", c)
    return t.select(*track.columns)


def _on_segment(track: DataFrame, k: str, count: int) -> DataFrame:
    """Rows of a track with places u = 0..1 on its segment (ax, ay, az) to (bx, by, bz), as px, py, pz."""
    t = track.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("__u", F.col("__i") / F.lit(float(count - 1)))
    for c in "xyz":
        t = t.withColumn(f"__p{c}", F.col(f"a{c}") + F.col("__u") * (F.col(f"b{c}") - F.col(f"a{c}")))
    return t


def apex_on_ray(track: DataFrame, by: Names, k: str, sigma: float = 1.5, count: int = 61) -> DataFrame:
    """Point of each frame's viewing ray (ox … dz, direction of any length) nearest to a segment (ax … bz), smoothed over time:
    by, k, x, y, z, u (place on the segment, 0 to 1)."""
    r = G.unit(F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z")))
    t = _on_segment(track, k, count).withColumn("__r", r)
    along = sum(((F.col(f"__p{c}") - F.col(f"o{c}")) * F.col(f"__r.{c}") for c in "yz"), (F.col("__px") - F.col("ox")) * F.col("__r.x"))
    t = t.withColumn("__t", along)
    for c in "xyz":
        t = t.withColumn(c, F.col(f"o{c}") + F.col("__t") * F.col(f"__r.{c}"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"__p{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("__px")) ** 2))
    best = t.groupBy(*by, k).agg(F.min(F.struct(d.alias("d"), F.col("__i").alias("i"), "x", "y", "z", F.col("__u").alias("u"))).alias("b")).select(*by, k, "b.x", "b.y", "b.z", "b.u")
    return smoothed_columns(best, by, k, "xyz", sigma)


def smoothed_columns(df: DataFrame, by: Names, k: str, columns: Names, sigma: float) -> DataFrame:
    """Columns after a Gaussian over time, ends repeated; unchanged where sigma is 0."""
    out = df
    for c in columns if sigma else ():
        out = W.gaussian_smooth(out, by, [k], c, sigma, "__g", edge="nearest").drop(c).withColumnRenamed("__g", c)
    return out.select(*df.columns)


def apex_on_segment(track: DataFrame, by: Names, k: str, seen: Column, sigma: float = 1.5, count: int = 31) -> DataFrame:
    """Point of each frame's segment (ax … bz) that is seen nearest to an image point; its place has a running median of five and a
    Gaussian of two, the point one of ``sigma``: by, k, x, y, z, u. ``seen`` is the image distance of (__px, __py, __pz)."""
    t = _on_segment(track, k, count)
    ends = [f"{e}{c}" for e in "ab" for c in "xyz"]
    best = t.groupBy(*by, k, *ends).agg(F.min(F.struct(seen.alias("d"), F.col("__i").alias("i"), F.col("__u").alias("u"))).alias("b")).select(*by, k, *ends, F.col("b.u").alias("u"))
    best = smoothed_tent(best, by, k, ["u"], 5, 2.0)
    p = best.select(*by, k, *[(F.col(f"a{c}") + F.col("u") * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(c) for c in "xyz"], "u")
    return smoothed_columns(p, by, k, "xyz", sigma)


def cast_on_surface(points: DataFrame, faces: DataFrame, covered: DataFrame, pose: DataFrame, cx: float, cy: float, offset: float, snap: int = 40) -> DataFrame:
    """Points (k, id, x, y, z) put on a surface along their viewing rays: (k, id, x, y, z, way).

    way: ``ray`` where the ray meets the surface (faces k, face, ax … cz); else ``pixel``, the nearest pixel that the surface
    covers (k, u, v, z) within ``snap``; else ``space``, the nearest corner of the surface. ``offset`` is taken off the depth.
    """
    p = points.join(pose.select("k", "rot", "f", "pos"), "k")
    p = p.withColumn("__q", G.project(F.struct("x", "y", "z"), F.col("rot"), F.col("f"), F.col("pos"), F.lit(cx), F.lit(cy)))
    back = lambda u, v, z: G.unproject(u, v, z, F.col("rot"), F.col("f"), F.col("pos"), F.lit(cx), F.lit(cy))
    one = back(F.col("__q.u"), F.col("__q.v"), F.lit(1.0))
    rays = p.select("k", F.col("id").alias("ray"), *[F.col("pos")[c].alias(f"o{c}") for c in "xyz"], *[(one[c] - F.col("pos")[c]).alias(f"d{c}") for c in "xyz"])
    hit = mesh_hits(rays, faces, ["k"]).select("k", F.col("ray").alias("id"), F.col("t").alias("__t"))  # depth, as the direction has depth 1
    p = p.join(hit, ["k", "id"], "left")
    miss = p.where("__t is null")
    # nearest covered pixel: frames lie far apart in the third coordinate, so one search serves all
    gap = 1e6
    number = lambda df, u, v: df.withColumn("__at", F.array(F.round(u).cast("double"), F.round(v).cast("double"), F.col("k") * F.lit(gap)))
    asked = number(miss.withColumn("__id", F.xxhash64("k", "id")), F.col("__q.u"), F.col("__q.v"))
    there = number(covered.withColumn("__id", F.xxhash64("k", "u", "v")), F.col("u"), F.col("v"))
    near = neighbours(asked, there, "__id", "__id", "__at", 1, skip_same=False).where(F.col("d2") <= snap * snap).select("__id", F.col("near___id").alias("__near"))
    px = asked.join(near, "__id").join(there.select(F.col("__id").alias("__near"), F.col("u").alias("__u"), F.col("v").alias("__v"), F.col("z").alias("__z")), "__near")
    corner = faces.select("k", F.explode(F.array(*[F.array(*[F.col(f"{c}{x}") for x in "xyz"]) for c in "abc"])).alias("__c")).distinct()
    there3 = corner.select(F.xxhash64("k", "__c").alias("__id"), "__c", F.concat("__c", F.array(F.col("k") * F.lit(gap))).alias("__at"))
    rest = miss.withColumn("__id", F.xxhash64("k", "id")).join(px.select("__id"), "__id", "left_anti").withColumn("__at", F.array("x", "y", "z", F.col("k") * F.lit(gap)))
    found = neighbours(rest, there3, "__id", "__id", "__at", 1, skip_same=False).select("__id", F.col("near___id").alias("__near"))
    space = rest.join(found, "__id").join(there3.select(F.col("__id").alias("__near"), "__c"), "__near")
    shape = lambda df, w, way: df.select("k", "id", w.alias("w")).select("k", "id", "w.x", "w.y", "w.z", F.lit(way).alias("way"))
    by_ray = shape(p.where("__t is not null"), back(F.col("__q.u"), F.col("__q.v"), F.col("__t") - offset), "ray")
    by_px = shape(px, back(F.col("__u").cast("double"), F.col("__v").cast("double"), F.col("__z") - offset), "pixel")
    by_space = space.select("k", "id", *[F.col("__c")[i].alias(c) for i, c in enumerate("xyz")], F.lit("space").alias("way"))
    return by_ray.unionByName(by_px).unionByName(by_space)


def pushed_forward(need: DataFrame, edges: DataFrame, frozen: DataFrame, sigma: float = 0.0, rounds: int = 30, again: int = 3) -> DataFrame:
    """Pushes of mesh vertices (k, v, need) spread over the mesh and over time, never below what each needs: (k, v, push).

    A round takes the mean of a vertex's push and that of its neighbours; after ``rounds`` of them, a Gaussian of ``sigma``
    frames and the same again, ``again`` times. Frozen vertices (v) stay at 0. Frames are spread by themselves, each beside
    the mesh's edges; over time a vertex is a series.
    """
    held = frozen.select(F.col("v").cast("long").alias("v")).distinct().withColumn("still", F.lit(True))
    least = need.select(F.col("k").cast("long").alias("k"), F.col("v").cast("long").alias("v"), F.greatest(F.coalesce(F.col("need").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("need"))
    least = least.join(held, "v", "left").withColumn("still", F.coalesce("still", F.lit(False))).withColumn("need", F.when(F.col("still"), 0.0).otherwise(F.col("need")))

    def spread(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray):
        n, push, still = (pdf[c].to_numpy() for c in ("need", "push", "still"))
        degree = np.maximum(np.bincount(np.concatenate((a, b)), minlength=len(n)), 1)
        for _ in range(rounds):
            total = np.bincount(a, weights=push[b], minlength=len(n)) + np.bincount(b, weights=push[a], minlength=len(n))
            push = np.where(still, 0.0, np.maximum(n, 0.5 * push + 0.5 * total / degree))
        return list(zip(pdf["v"].tolist(), n.tolist(), still.tolist(), push.tolist()))

    over_mesh = lambda df: _on_mesh(df, edges, ["k"], "v long, need double, still boolean, push double", spread)
    out = over_mesh(least.withColumn("push", F.col("need")))
    for _ in range(again if sigma else 0):
        smooth = W.gaussian_smooth(materialize(out, "pushes"), ["v"], ["k"], "push", sigma, "__s", edge="nearest")
        out = over_mesh(smooth.select("k", "v", "need", "still", F.greatest("need", "__s").alias("push")))
    return out.select("k", "v", "push")


# ---- tubes and tools


def width_scale(obs: DataFrame, centre: DataFrame, frames: int, sigma: float, bounds: tuple[float, float], least: int = 5, reach: float = 4.0, half: int = 15) -> DataFrame:
    """Seen over modelled width of a tube by frame 0..frames-1: median ratio over the samples, gaps filled, a Gaussian over
    2 ``half`` + 1 frames with the ends repeated, limited: (k, scale, raw).

    obs: (k, i, u, v, radius, inside), skeleton samples in order; centre: (k, node, u, v, z, f, r), the fitted centre line.
    A sample counts with its nearest centre point if it is inside the mask, wider than a pixel, nearer than ``reach`` and not
    one of the two at either end; frames with fewer than ``least`` of them have none.
    """
    w, part = Window.partitionBy("k").orderBy("i"), Window.partitionBy("k")
    o = obs.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(part))
    j = o.join(centre.select("k", F.col("node").alias("__node"), F.col("u").alias("cu"), F.col("v").alias("cv"), "z", "f", "r"), "k")
    best = j.groupBy("k", "i", "__i", "__n", "radius", "inside").agg(F.min(F.struct(F.hypot(F.col("u") - F.col("cu"), F.col("v") - F.col("cv")).alias("d"), F.col("__node").alias("node"), "z", "f", "r")).alias("b"))
    ok = F.col("inside") & (F.col("radius") > 1) & (F.col("b.d") < reach) & (F.col("__i") > 2) & (F.col("__i") <= F.col("__n") - 2)
    ratio = F.when(ok, F.col("radius") * F.col("b.z") / F.col("b.f") / F.col("b.r"))
    raw = best.groupBy("k").agg(F.when(F.count(ratio) >= least, F.percentile(ratio, 0.5)).alias("raw"))
    every = obs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("k")).join(raw, "k", "left").withColumn("__tube", F.col("k") * 0)
    t = W.fill_gaps(every, ["__tube"], ["k"], "raw", "__f")
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    o = Window.partitionBy("__tube").orderBy("k")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda i: F.coalesce(F.lag("__f", -i).over(o), (F.first("__f") if i < 0 else F.last("__f")).over(whole))
    smooth = sum((near(i) * F.lit(x / sum(weights)) for i, x in zip(range(-half + 1, half + 1), weights[1:])), near(-half) * F.lit(weights[0] / sum(weights)))
    return t.withColumn("__s", smooth).select("k", clip(F.col("__s"), *bounds).alias("scale"), "raw")


def observed_paths(paths: DataFrame, by: Names, junctions: DataFrame, reach: float, step: float, downward: bool = True) -> DataFrame:
    """Ordered image paths with their near end first, pulled to a junction within ``reach``, at equal steps of about ``step``
    pixels: by, i, u, v, joined.

    paths: (by, i, u, v) in order; the near end is the upper one (or the left one). junctions: (by, u, v), any number a path;
    the nearest to the near end counts. Paths of fewer than four points are left out.
    """
    w = Window.partitionBy(*by).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    axis = "v" if downward else "u"
    p = paths.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("__n") >= 4)
    p = p.withColumn("__turn", F.last(axis).over(whole) < F.first(axis).over(whole)).withColumn("i", F.when(F.col("__turn"), -F.col("i")).otherwise(F.col("i")))
    p = p.select(*by, "i", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    start = p.groupBy(*by).agg(F.min(F.struct("i", "u", "v")).alias("s"))
    j = start.join(junctions.select(*by, F.col("u").cast("double").alias("__u"), F.col("v").cast("double").alias("__v")), list(by))
    d = F.hypot(F.col("__u") - F.col("s.u"), F.col("__v") - F.col("s.v"))
    j = j.groupBy(*by, "s").agg(F.min(F.struct(d.alias("d"), F.col("__u").alias("u"), F.col("__v").alias("v"))).alias("b")).where(F.col("b.d") <= reach)
    head = j.where(F.col("b.d") > 1).select(*by, (F.col("s.i") - 1).alias("i"), "b.u", "b.v")
    every = materialize(p.unionByName(head), "paths")  # written, so that both sides of the union are laid out alike
    seg = F.hypot(F.col("u") - F.lag("u").over(w), F.col("v") - F.lag("v").over(w))
    m = every.withColumn("__d", seg).groupBy(*by).agg(F.greatest(F.round(F.sum("__d") / F.lit(step)) + 1, F.lit(2)).cast("int").alias("__m"))
    # paths differ in their number of points: each is cut at equal shares of its own length
    s = every.withColumn("__s", F.sum(F.coalesce(seg, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("__s2", F.lead("__s").over(w)).withColumn("__u2", F.lead("u").over(w)).withColumn("__v2", F.lead("v").over(w)).withColumn("__len", F.max("__s").over(Window.partitionBy(*by)))
    s = s.join(m, list(by)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__m") - 1))).withColumn("__t", F.col("__len") * F.col("__k") / (F.col("__m") - 1))
    here = ((F.col("__t") >= F.col("__s")) & (F.col("__t") < F.col("__s2"))) | (F.col("__s2").isNull() & (F.col("__t") >= F.col("__s")))
    f = F.coalesce((F.col("__t") - F.col("__s")) / (F.col("__s2") - F.col("__s")), F.lit(0.0))
    out = s.where(here).select(*by, F.col("__k").alias("i"), (F.col("u") + f * F.coalesce(F.col("__u2") - F.col("u"), F.lit(0.0))).alias("u"), (F.col("v") + f * F.coalesce(F.col("__v2") - F.col("v"), F.lit(0.0))).alias("v"))
    return out.join(j.select(*by, F.lit(True).alias("joined")), list(by), "left").fillna(False, ["joined"])


def observed_samples(path: DataFrame, by: Names, mask: DataFrame, radius: DataFrame, depth: DataFrame, unknown: DataFrame, focal: DataFrame, width: int, height: int, margin: int = 4) -> DataFrame:
    """What is seen at the points of ``observed_paths``: by, i, u, v, depth, radius (of the mask there, in metres), radius_px,
    inside, end_ok (an end that is neither at the border nor next to what hides it; null for inner points).

    mask, unknown: (by, u, v); radius: (by, u, v, r), distance to the mask's outline; depth: (by, u, v, z); focal: (by, f).
    """
    cell = lambda c, n: F.least(F.greatest(F.bround(c).cast("int"), F.lit(0)), F.lit(n - 1))
    p = path.withColumn("__u", cell("u", width)).withColumn("__v", cell("v", height))
    at = lambda df, *cols: df.select(*by, F.col("u").cast("int").alias("__u"), F.col("v").cast("int").alias("__v"), *cols).distinct()
    keys = [*by, "__u", "__v"]
    p = p.join(at(mask, F.lit(True).alias("inside")), keys, "left").join(at(radius, F.col("r").alias("radius_px")), keys, "left").join(at(depth, F.col("z").alias("depth")), keys, "left").join(at(unknown, F.lit(True).alias("__unk")), keys, "left").join(focal, list(by))
    w = Window.partitionBy(*by)
    end = (F.col("i") == F.min("i").over(w)) | (F.col("i") == F.max("i").over(w))
    free = ~(F.coalesce("__unk", F.lit(False)) | (F.col("u") < margin) | (F.col("v") < margin) | (F.col("u") > width - margin - 1) | (F.col("v") > height - margin - 1))
    r = F.coalesce("radius_px", F.lit(0.0))
    return p.select(*by, "i", "u", "v", "depth", (r * F.col("depth") / F.col("f")).alias("radius"), r.alias("radius_px"), F.coalesce("inside", F.lit(False)).alias("inside"), F.when(end, free).alias("end_ok"))


def tool_centre(tip: Column, shaft: Column, beyond: float = 0.003) -> Column:
    """Working point between the jaws: so far before their tips along the unit shaft direction."""
    return G.sub(tip, G.scale(shaft, F.lit(beyond)))


def depth_map_indentation(px: DataFrame, tip: DataFrame, depth: DataFrame, tissue: DataFrame, by: Names, band: float = 8.0, least: int = 3, near: float = 4, far: float = 14) -> DataFrame:
    """Indentation by the depth map alone: median depth of a tool's own outermost ``band`` pixels less that of the tissue ring
    ahead of its tip: by, indent (null where either has too few pixels).

    px: (by, u, v), the tool's eroded pixels; tip: (by, pu, pv, pdu, pdv); depth, tissue: (by, u, v, z).
    """
    s = px.join(tip, list(by)).withColumn("__s", (F.col("u") - F.col("pu")) * F.col("pdu") + (F.col("v") - F.col("pv")) * F.col("pdv"))
    s = s.withColumn("__top", F.max("__s").over(Window.partitionBy(*by))).where(F.col("__s") >= F.col("__top") - band)
    own = s.select(*by, "u", "v").join(depth, [*by, "u", "v"]).groupBy(*by).agg(F.when(F.count("z") >= least, F.percentile("z", 0.5)).alias("__own"))
    ring = ring_median(tissue, tip, by, near, far, ahead=True)
    return ring.join(own, list(by), "left").select(*by, (F.col("__own") - F.col("ring")).alias("indent"))


def ring_sensitivity(depth: DataFrame, at: DataFrame, by: Names, rings: Sequence[tuple[float, float]]) -> DataFrame:
    """``indentation`` for several rings: by, ring, indent."""
    out = None
    for near, far in rings:
        part = indentation(depth, at, by, near, far).withColumn("ring", F.lit(f"{near:g}-{far:g}"))
        out = part if out is None else out.unionByName(part)
    return out.select(*by, "ring", "indent")


def sheet_apex(sheet: DataFrame | None, tips: DataFrame, depth: DataFrame, band: float = 6.0) -> DataFrame:
    """A sheet's pixels nearest to a tool's tip by frame: distance, medians of those within ``band`` of it, their depth less
    the tool's: (k, touch, u, v, z, dz, error). tips: (k, pu, pv, z); sheet: (k, u, v), or None, which is an error in each row."""
    if sheet is None:
        return optional_join(tips.select("k"), None, ["k"], {"touch": "double", "u": "double", "v": "double", "z": "double", "dz": "double"})
    d = sheet.select("k", "u", "v").join(tips.select("k", "pu", "pv", F.col("z").alias("__tool")), "k").withColumn("d", F.hypot(F.col("u") - F.col("pu"), F.col("v") - F.col("pv")))
    d = d.withColumn("__least", F.min("d").over(Window.partitionBy("k"))).where(F.col("d") <= F.col("__least") + band)
    g = d.join(depth, ["k", "u", "v"], "left").groupBy("k", "__tool").agg(F.min("d").alias("touch"), F.percentile("u", 0.5).alias("u"), F.percentile("v", 0.5).alias("v"), F.percentile("z", 0.5).alias("z"))
    return tips.select("k").join(g.select("k", "touch", "u", "v", "z", (F.col("__tool") - F.col("z")).alias("dz")), "k", "left").withColumn("error", F.lit(None).cast("string"))


def depth_targets(tissue: DataFrame, tips: DataFrame, tools: Names, near: float = 4, far: float = 14) -> DataFrame:
    """Depth of the tissue ring ahead of a tip as a target with weight 1, for the listed tools only; others and frames
    without enough pixels have weight 0: (tool, k, z, w). tips: (tool, k, pu, pv, pdu, pdv); tissue: (k, u, v, z)."""
    listed = tips.where(F.col("tool").isin(*tools)) if tools else tips.limit(0)
    ring = ring_median(listed.select("tool", "k").join(tissue, "k"), listed, ["tool", "k"], near, far, ahead=True)
    out = tips.select("tool", "k").join(ring, ["tool", "k"], "left")
    return out.select("tool", "k", F.col("ring").alias("z"), F.when(F.col("ring").isNotNull(), 1.0).otherwise(0.0).alias("w"))


# ---- images and height fields


def _window(px: DataFrame, by: Names, radius: int, columns: dict[str, Column]) -> DataFrame:
    """Sums of columns over the square window of every pixel that has a value somewhere in it, by two passes of a running sum
    (rows, then columns): by, u, v and the sums. A pixel costs its row and column neighbours, not its window."""
    out = px.select(*by, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *[c.alias(n) for n, c in columns.items()])
    for axis, other in (("u", "v"), ("v", "u")):
        spread = F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius)).alias("__a")
        out = out.select(*by, other, spread, *columns).groupBy(*by, other, "__a").agg(*[F.sum(n).alias(n) for n in columns]).withColumnRenamed("__a", axis)
    return out.select(*by, "u", "v", *columns)


def local_correlation(px: DataFrame, by: Names, radius: int = 7, support: float = 0.6, least_var: float = 4.0, least: int = 100) -> DataFrame:
    """Mean correlation of two images (a, b) over the windows of common pixels that hold enough of them and vary in both: by,
    lncc (null unless more than ``least`` windows count), n."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    sums = _window(px, by, radius, {"n": F.lit(1.0), "sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b})
    g = px.select(*by, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).join(sums, [*by, "u", "v"])
    n = F.col("n") + 1e-6
    va, vb = F.col("saa") / n - (F.col("sa") / n) ** 2, F.col("sbb") / n - (F.col("sb") / n) ** 2
    cov = F.col("sab") / n - F.col("sa") / n * F.col("sb") / n
    ok = (n > support * (2 * radius + 1) ** 2) & (va > least_var) & (vb > least_var)
    c = F.when(ok, cov / F.sqrt(F.greatest(va, F.lit(1e-3)) * F.greatest(vb, F.lit(1e-3))))
    return g.groupBy(*by).agg(F.when(F.count(c) > least, F.avg(c)).alias("lncc"), F.count(c).alias("n"))


def blurred(px: DataFrame, by: Names, sigma: float, columns: dict[str, Column]) -> DataFrame:
    """Gaussian sums of columns around every pixel within four sigma, by two passes (rows, then columns): by, u, v, sums."""
    r = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    table = F.array(*[F.lit(w / sum(weights)) for w in weights])
    out = px.select(*by, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *[c.cast("double").alias(n) for n, c in columns.items()])
    for axis, other in (("u", "v"), ("v", "u")):
        o = out.select(*by, other, F.col(axis).alias("__c"), *columns, F.explode(F.sequence(F.col(axis) - r, F.col(axis) + r)).alias("__a"))
        w = F.get(table, (F.col("__a") - F.col("__c") + r).cast("int"))
        out = o.groupBy(*by, other, "__a").agg(*[F.sum(w * F.col(n)).alias(n) for n in columns]).withColumnRenamed("__a", axis)
    return out.select(*by, "u", "v", *columns)


def smoothed_known(px: DataFrame, by: Names, sigma: float) -> DataFrame:
    """Known depths (z; null is unknown) smoothed by normalised convolution; unknown ones stay null: by, u, v, z."""
    if sigma <= 0:
        return px.select(*by, "u", "v", "z")
    known = px.where("z is not null")
    s = blurred(known, by, sigma, {"__z": F.col("z"), "__w": F.lit(1.0)})
    keys = [*by, "u", "v"]
    return px.select(*by, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "z").join(s, keys, "left").select(*keys, F.when(F.col("z").isNotNull(), F.col("__z") / F.greatest("__w", F.lit(1e-6))).alias("z"))


def extrapolated_depth(px: DataFrame, fill: DataFrame, by: Names, sigmas: Sequence[float] = (8, 16, 32, 64, 128), support: float = 1e-3) -> DataFrame:
    """Depth of the pixels to fill from known ones: normalised convolution of the smallest radius whose support is enough: by,
    u, v, z (null where no radius has it). With a column ``least`` in ``fill``, depths are at least that."""
    keys = [*by, "u", "v"]
    out = fill.withColumn("u", F.col("u").cast("long")).withColumn("v", F.col("v").cast("long"))
    names = []
    for i, sigma in enumerate(sigmas):
        s = blurred(px.where("z is not null"), by, sigma, {"__z": F.col("z"), "__w": F.lit(1.0)})
        out = out.join(s.where(F.col("__w") > support).select(*keys, (F.col("__z") / F.col("__w")).alias(f"__{i}")), keys, "left")
        names.append(f"__{i}")
    z = F.coalesce(*names) if len(names) > 1 else F.col(names[0])
    if "least" in fill.columns:
        z = F.when(F.col("least").isNull(), z).otherwise(F.greatest(z, F.col("least")))
    return out.select(*keys, z.alias("z"))


def label_cells(px: DataFrame, by: Names, is_label: Column) -> DataFrame:
    """Share of a label by cell (cu, cv), unknown cells from the nearest known one."""
    known = F.count(is_label)
    cells = px.groupBy(*by, "cu", "cv").agg(F.when(known > 0, F.sum(is_label.cast("double")) / known).alias("share"))
    return fill_nearest(cells.drop(*by), "share") if by else fill_nearest(cells, "share")


def shape_residuals(samples: DataFrame, observed: DataFrame, outside: DataFrame, contour: DataFrame, px_to_m: float, weight: float = 2.0, behind: float = 0.008) -> DataFrame:
    """Residuals of a posed shape as rows (kind, id, r): observed points to the nearest front sample (points), samples outside
    the outline by their distance from it unless the visible surface hides them (outline), the contour's pixels to the
    nearest sample in the image (cover). The last two are scaled by their number against the points.

    samples: (id, x, y, z, u, v, depth, front); observed: (id, x, y, z); outside: (u, v, d, z_visible); contour: (id, u, v).
    """
    vec = lambda df, i, *c: df.select(F.col(i).cast("long").alias("id"), F.array(*[F.col(x).cast("double") for x in c]).alias("__p"))
    n = {r["k"]: r["n"] for r in samples.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("s")).unionByName(observed.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("o"))).unionByName(contour.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("c"))).collect()}  # three numbers
    near = lambda q, p: neighbours(q, p, "id", "id", "__p", 1, skip_same=False).select("id", F.sqrt("d2").alias("d"))
    pts = near(vec(observed, "id", "x", "y", "z"), vec(samples.where("front"), "id", "x", "y", "z")).select(F.lit("points").alias("kind"), "id", F.col("d").alias("r"))
    s = samples.withColumn("__u", F.floor("u").cast("long")).withColumn("__v", F.floor("v").cast("long"))
    o = s.join(outside.select(F.col("u").cast("long").alias("__u"), F.col("v").cast("long").alias("__v"), "d", "z_visible"), ["__u", "__v"], "left")
    gone = F.col("depth") > F.col("z_visible") + behind
    out = o.select(F.lit("outline").alias("kind"), F.col("id").cast("long").alias("id"), (F.when(F.col("d").isNull() | F.coalesce(gone, F.lit(False)), 0.0).otherwise(F.col("d")) * F.lit(weight * px_to_m / math.sqrt(max(n["s"], 1) / max(n["o"], 1)))).alias("r"))
    cov = near(vec(contour, "id", "u", "v"), vec(samples, "id", "u", "v")).select(F.lit("cover").alias("kind"), "id", (F.col("d") * F.lit(weight * px_to_m / math.sqrt(max(n["c"], 1) / max(n["o"], 1) + 1e-9))).alias("r"))
    return pts.unionByName(out).unionByName(cov)
