"""Compositions over a clip's tables: colours, fused textures, profiles, occlusion, amodal shapes, warps, cables, gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.scalars import clip, finite
from tidemark.operators import windows as W
from tidemark.operators.kernels import nearest_on_triangles
from tidemark.operators.sets import components_by_size, dilate, erode, pixel_components
from tidemark.session import ship_package

Names = Sequence[str]


def median_colour(px: DataFrame, by: Names, step: int, default: tuple[float, float, float]) -> DataFrame:
    """Median of each channel (r, g, b) over every ``step``-th frame k; the default for keys without pixels there."""
    keys = px.select(*by).distinct()
    m = px.where(F.col("k") % step == 0).groupBy(*by).agg(*[F.percentile(c, 0.5).alias(c) for c in "rgb"])
    out = keys.join(m, list(by), "left") if by else m
    return out.select(*by, *[F.coalesce(c, F.lit(float(d))).alias(c) for c, d in zip("rgb", default)])


def fuse_texture(px: DataFrame, cell: Names, k: str, g: str, least: int = 500, low: float = 0.6, high: float = 1.6, sharp: str | None = None, enough: int = 4, blend: bool = False) -> DataFrame:
    """Median texture by cell after each frame's gain is evened out: cell, value, n, n_sharp.

    A frame's gain is the median of its values + 1 over the median, on the same pixels, of the first fused values + 1,
    limited; frames with ``least`` pixels or fewer keep gain 1. With ``sharp`` (a flag of the frame) the sharp frames'
    median counts where ``enough`` of them see a cell; with ``blend`` it is mixed with that of all frames by its support.
    """
    first = px.groupBy(*cell).agg(F.percentile(g, 0.5).alias("__m"))
    gain = px.join(first, list(cell)).groupBy(k).agg(F.when(F.count(F.lit(1)) > least, clip(F.percentile(F.col(g) + 1, 0.5) / F.percentile(F.col("__m") + 1, 0.5), low, high)).alias("__g"))
    even = px.join(gain, k, "left").withColumn("__v", F.when(F.col("__g").isNull(), F.col(g).cast("double")).otherwise(F.floor(clip(F.col(g) / F.col("__g"), 0.0, 255.0)).cast("double")))
    ok = F.col(sharp) if sharp else F.lit(True)
    t = even.groupBy(*cell).agg(F.percentile("__v", 0.5).alias("__a"), F.percentile(F.when(ok, F.col("__v")), 0.5).alias("__s"), F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("n_sharp"))
    if blend:
        w = clip(F.col("n_sharp") / F.lit(float(enough)), 0.0, 1.0)
        value = F.when(F.col("n_sharp") > 0, w * F.col("__s") + (1 - w) * F.col("__a")).otherwise(F.col("__a"))
    else:
        value = F.when(F.col("n_sharp") >= enough, F.col("__s")).otherwise(F.col("__a")) if sharp else F.col("__a")
    return t.select(*cell, value.alias("value"), "n", "n_sharp")


def carried_shift(df: DataFrame, by: Names, k: str, step: str, least: int) -> DataFrame:
    """Running sum of the median step by frame; frames with fewer than ``least`` rows add nothing: by, k, shift."""
    m = df.groupBy(*by, k).agg(F.when(F.count(step) >= least, F.percentile(step, 0.5)).alias("__m"))
    w = Window.partitionBy(*by).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    return m.select(*by, k, F.sum(F.coalesce("__m", F.lit(0.0))).over(w).alias("shift"))


def nested_band_medians(df: DataFrame, bands: DataFrame, keys: Names, k: str, x: str) -> DataFrame:
    """Median by keys and band [lo, hi), and over all bands (band null)."""
    hit = df.join(F.broadcast(bands), (F.col(k) >= F.col("lo")) & (F.col(k) < F.col("hi")))
    per = hit.groupBy(*keys, "band").agg(F.percentile(finite(F.col(x)), 0.5).alias("median"), F.count(F.lit(1)).alias("n"))
    every = df.groupBy(*keys).agg(F.percentile(finite(F.col(x)), 0.5).alias("median"), F.count(F.lit(1)).alias("n")).withColumn("band", F.lit(None).cast("string"))
    return per.select(*keys, F.col("band").cast("string").alias("band"), "median", "n").unionByName(every.select(*keys, "band", "median", "n"))


def radius_profile(obs: DataFrame, nodes: DataFrame, by: Names, node: str, r: str, low: float, high: float, least: int = 5, width: int = 5) -> DataFrame:
    """Radius at every node: median of at least ``least`` observations, gaps filled, smoothed, limited."""
    m = obs.groupBy(*by, node).agg(F.when(F.count(r) >= least, F.percentile(r, 0.5)).alias("__r"))
    n = nodes.select(*by, node).distinct().join(m, [*by, node], "left")
    return W.fill_smooth(n, by, [node], "__r", width, "__s").select(*by, node, clip(F.col("__s"), low, high).alias("radius"))


def occlusion(px: DataFrame, by: Names) -> DataFrame:
    """How often a surface is in front where both are seen, and its share of seen pixels: rows (z, z_other, seen)."""
    both = F.col("z").isNotNull() & F.col("z_other").isNotNull()
    return px.groupBy(*by).agg(
        F.avg(F.when(both, (F.col("z") <= F.col("z_other")).cast("double"))).alias("in_front"),
        F.avg(F.when(F.col("z").isNotNull(), F.col("seen").cast("double"))).alias("seen_share"),
        F.sum(both.cast("long")).alias("n_both"),
    )


def behind_share(df: DataFrame, by: Names, offset: Column, tol: float = 0.0, only: Column | None = None) -> DataFrame:
    """Share of rows whose offset from a surface is beyond the tolerance, of those selected."""
    flag = (offset > tol).cast("double")
    return df.groupBy(*by).agg(F.avg(flag if only is None else F.when(only, flag)).alias("behind"))


def amodal(px: DataFrame, cover: DataFrame, first: int, width: int, radius: int = 1) -> DataFrame:
    """Full shape: pixels of the first frames that are later covered or seen, closed, the largest component."""
    early = px.where(F.col("k") < first).select("u", "v").distinct()
    seen = early.join(cover.select("u", "v").distinct(), ["u", "v"], "left_semi")
    closed = erode(dilate(seen, [], radius), [], radius).unionByName(seen).distinct()
    return components_by_size(pixel_components(closed, width)).select("u", "v")


def warp(px: DataFrame, pose: DataFrame, i: int, j: int, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """Pixels of frame i with depth, carried into frame j: (u, v, wu, wv, wz), inside the image only.

    ``pose``: k, rot (nine numbers), f, pos. Both frames are one row each.
    """
    a = pose.where(F.col("k") == i).select(*[F.col(c).alias(f"a_{c}") for c in ("rot", "f", "pos")])
    b = pose.where(F.col("k") == j).select(*[F.col(c).alias(f"b_{c}") for c in ("rot", "f", "pos")])
    p = px.where(F.col("k") == i).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))
    p = p.withColumn("__w", G.unproject(F.col("u"), F.col("v"), F.col("z"), F.col("a_rot"), F.col("a_f"), F.col("a_pos"), F.lit(cx), F.lit(cy)))
    p = p.withColumn("__q", G.project(F.col("__w"), F.col("b_rot"), F.col("b_f"), F.col("b_pos"), F.lit(cx), F.lit(cy)))
    p = p.select("u", "v", F.bround("__q.u").cast("int").alias("wu"), F.bround("__q.v").cast("int").alias("wv"), F.col("__q.depth").alias("wz"))
    return p.where((F.col("wz") > 0) & G.inside_image(F.col("wu"), F.col("wv"), F.lit(width), F.lit(height)))


def warped_correlation(px: DataFrame, pairs: DataFrame, img: DataFrame, k: int, share: float, total: int) -> DataFrame:
    """NCC of a frame's pixels and those they are carried to; null under a share of overlap."""
    a = img.where(F.col("k") == k).select("u", "v", F.col("g").alias("a"))
    j = pairs.join(a, ["u", "v"]).join(px.select(F.col("u").alias("wu"), F.col("v").alias("wv"), F.col("g").alias("b")), ["wu", "wv"])
    ncc = F.covar_pop("a", "b") / (F.stddev_pop("a") * F.stddev_pop("b") + 1e-9)
    return j.agg(F.when(F.count(F.lit(1)) >= share * total, ncc).alias("ncc"), F.count(F.lit(1)).alias("n"))


def cable_report(sim: DataFrame, rec: DataFrame, rest: DataFrame, driven: DataFrame) -> DataFrame:
    """Errors of simulated cable nodes (k, node, x, y, z) from the recorded ones: mean error, explained motion of the nodes
    that are not driven, and least and greatest length over the rest length. ``rest``: node, x, y, z."""
    w = Window.partitionBy("k").orderBy("node")
    seg = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    length = sim.withColumn("s", seg).groupBy("k").agg(F.sum("s").alias("l"))
    r = rest.withColumn("k", F.lit(0)).withColumn("s", seg).agg(F.sum("s").alias("l0"))
    j = sim.join(rec.select("k", "node", *[F.col(c).alias(f"r{c}") for c in "xyz"]), ["k", "node"]).join(rest.select("node", *[F.col(c).alias(f"o{c}") for c in "xyz"]), "node")
    dist = lambda a, b: F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "yz"), (F.col(f"{a}x") - F.col(f"{b}x")) ** 2))
    j = j.withColumn("e", dist("", "r")).withColumn("m", dist("o", "r"))
    free = j.join(driven.select("node"), "node", "left_anti")
    return (
        j.agg(F.avg("e").alias("error"), F.percentile("e", 0.5).alias("median_error"))
        .crossJoin(free.agg((1 - F.avg("e") / F.greatest(F.avg("m"), F.lit(1e-9))).alias("explained")))
        .crossJoin(length.crossJoin(F.broadcast(r)).agg(F.min(F.col("l") / F.col("l0")).alias("length_min"), F.max(F.col("l") / F.col("l0")).alias("length_max")))
    )


def gap_summary(df: DataFrame, by: Names, d: str, k: str) -> DataFrame:
    """Median over key frames of each frame's median gap, and the largest; frames without data drop out."""
    per = df.where(F.col(d).isNotNull()).groupBy(*by, k).agg(F.percentile(d, 0.5).alias("__m"), F.max(d).alias("__x"))
    return per.groupBy(*by).agg(F.percentile("__m", 0.5).alias("median"), F.max("__x").alias("max"), F.count(F.lit(1)).alias("frames"))


def closest_faces(df: DataFrame, by: Names) -> DataFrame:
    """Exact distance of a point from a mesh: rows (px, py, pz, face, ax … cz) of one point; by, d, face. For many points on one
    mesh see ``kernels.mesh_distances``, which needs no row for every pair."""
    ship_package(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def near(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("face")
        p = pdf[["px", "py", "pz"]].to_numpy(float)[0]
        tri = pdf[[f"{c}{x}" for c in "abc" for x in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
        d, i = nearest_on_triangles(p, np.ascontiguousarray(tri))
        return pd.DataFrame([(*key, d, int(pdf["face"].iloc[i]))], columns=[*by, "d", "face"])

    return df.groupBy(*by).applyInPandas(near, ", ".join(f"{b} {kinds[b]}" for b in by) + ", d double, face long")


def instrument_track(px: DataFrame, by: Names, k: str, width: int, height: int, n: int, smooth: int = 7, depth: DataFrame | None = None, smooth_depth: int = 9) -> DataFrame:
    """Tip, direction, entry, depth and visibility of an elongated object by frame 0..n-1, gaps filled and smoothed: by, k, tu,
    tv, du, dv, eu, ev, depth, visible.

    ``depth``: (by, k, u, v, z); the object's depth is the median over the band near its end. Without it depth is null.
    """
    from tidemark.operators.measures import axis_band, mask_axis

    keys = [*by, k]
    a = mask_axis(px, keys, width, height)
    t = a.select(*keys, "tu", "tv", "du", "dv", "eu", "ev")
    if depth is None:
        t = t.withColumn("depth", F.lit(None).cast("double"))
    else:
        z = axis_band(px, a, keys).join(depth.select(*keys, "u", "v", "z"), [*keys, "u", "v"]).groupBy(*keys).agg(F.percentile("z", 0.5).alias("depth"))
        t = t.join(z, keys, "left")
    frames = px.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(k)) if by else px.sparkSession.range(n).select(F.col("id").cast("int").alias(k))
    t = frames.join(t, keys, "left").withColumn("visible", F.col("tu").isNotNull())
    for c in ("tu", "tv", "du", "dv", "eu", "ev"):
        t = W.fill_smooth(t, by, [k], c, smooth, f"__{c}").drop(c).withColumnRenamed(f"__{c}", c)
    if depth is not None:
        t = W.fill_smooth(t, by, [k], "depth", smooth_depth, "__z").drop("depth").withColumnRenamed("__z", "depth")
    return t.select(*keys, "tu", "tv", "du", "dv", "eu", "ev", "depth", "visible")


def corrected_depth(px: DataFrame, affine: DataFrame, grid: DataFrame, width: int, height: int, gw: int, gh: int) -> DataFrame:
    """Depth 1 / max(a d + b, 1) by frame times exp of a coarse correction grid (k, gu, gv, c), read bilinearly: k, u, v, z."""
    x, y = F.col("u") * F.lit((gw - 1) / max(width - 1, 1)), F.col("v") * F.lit((gh - 1) / max(height - 1, 1))
    corner = lambda dx, dy: F.struct(F.least(F.floor(x) + dx, F.lit(gw - 1)).alias("gu"), F.least(F.floor(y) + dy, F.lit(gh - 1)).alias("gv"), ((x - F.floor(x) if dx else 1 - (x - F.floor(x))) * (y - F.floor(y) if dy else 1 - (y - F.floor(y)))).alias("w"))
    c = px.select("k", "u", "v", "disp", F.explode(F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("c")).select("k", "u", "v", "disp", "c.*")
    g = c.join(grid.select("k", F.col("gu").cast("long").alias("gu"), F.col("gv").cast("long").alias("gv"), F.col("c").alias("corr")), ["k", "gu", "gv"])
    e = g.groupBy("k", "u", "v", "disp").agg(F.sum(F.col("w") * F.col("corr")).alias("e")).join(affine, "k")
    return e.select("k", "u", "v", (F.exp("e") / F.greatest(F.col("a") * F.col("disp") + F.col("b"), F.lit(1.0))).alias("z"))


def bed_shift(cols: DataFrame, focal: float) -> DataFrame:
    """Displacement by frame: the stored 3D one where there is any, else the image shift (du, dv) at the bed's depth z."""
    any3 = F.max(F.abs(F.coalesce("x", F.lit(0.0))) + F.abs(F.coalesce("y", F.lit(0.0))) + F.abs(F.coalesce("z3", F.lit(0.0)))).over(Window.partitionBy("clip"))
    flat = lambda d: F.col(d) * F.col("z") / F.lit(focal)
    c = cols.withColumn("__any", any3 > 0)
    return c.select("clip", "k", F.when(F.col("__any"), F.col("x")).otherwise(flat("du")).alias("dx"), F.when(F.col("__any"), F.col("y")).otherwise(flat("dv")).alias("dy"), F.when(F.col("__any"), F.col("z3")).otherwise(F.lit(0.0)).alias("dz"))


def depth_offsets(df: DataFrame, by: Names, k: str, seen: str, own: str, sigma: float = 3.0) -> DataFrame:
    """Seen less own depth by frame, gaps filled (all missing: zeros), smoothed over time when more than seven frames."""
    d = df.withColumn("__o", F.col(seen) - F.col(own))
    d = W.gaussian_smooth(W.fill_gaps(d, by, [k], "__o", "__f"), by, [k], "__f", sigma, "__g", edge="nearest")
    many = F.count(F.lit(1)).over(Window.partitionBy(*by)) > 7
    return d.select(*by, k, F.when(many, F.col("__g")).otherwise(F.col("__f")).alias("offset"))


def extend_path(ends: DataFrame, px: DataFrame, by: Names, steps: int = 40) -> DataFrame:
    """Steps of one pixel from an end (eu, ev) along (du, dv) while they stay in a mask: by, i, u, v; stops at the first miss."""
    s = ends.select(*by, "eu", "ev", "du", "dv", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"))
    s = s.withColumn("u", F.bround(F.col("eu") + F.col("i") * F.col("du")).cast("int")).withColumn("v", F.bround(F.col("ev") + F.col("i") * F.col("dv")).cast("int"))
    m = px.select(*by, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")).distinct().withColumn("__in", F.lit(True))
    s = W.still_alive(s.join(m, [*by, "u", "v"], "left"), by, ["i"], F.col("__in"), "__ok")
    return s.where("__ok").select(*by, "i", "u", "v")


def window_min(at: DataFrame, depth: DataFrame, key: str, radius: int = 1) -> DataFrame:
    """Least depth in the window around the nearest pixel of each place (pu, pv): key, z."""
    r = range(-radius, radius + 1)
    off = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in r for y in r])).alias("o")
    a = at.select(key, "pu", "pv", off).select(key, (F.bround("pu").cast("int") + F.col("o.x")).alias("u"), (F.bround("pv").cast("int") + F.col("o.y")).alias("v"))
    m = a.join(depth.select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "z"), ["u", "v"]).groupBy(key).agg(F.min("z").alias("z"))
    return at.select(key).join(m, key, "left")


def free_space(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Bound on a tool's depth: the farther of the tissue depths on both sides, or the one that is known."""
    return rows.withColumn("bound", F.greatest(left, right))


def second_half_gap(df: DataFrame, by: Names, order: str, gap: str, least: int = 3) -> DataFrame:
    """Median gap over the second half of each key's samples; null unless more than ``least``."""
    w, part = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    h = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(part)).where(F.col("__i") > F.floor(F.col("__n") / 2))
    return h.groupBy(*by).agg(F.when(F.count(gap) > least, F.percentile(gap, 0.5)).alias("gap"))


def compare_conditions(scores: DataFrame, runs: DataFrame, key: str = "condition") -> DataFrame:
    """Scores beside run facts, only for conditions that have both."""
    return scores.join(runs, key)


def oriented_faces(faces: DataFrame, vertices: DataFrame, viewpoint: tuple[float, float, float]) -> DataFrame:
    """Faces with corners in an order whose normal points to the viewpoint."""
    from tidemark.operators.mesh import with_corners

    t = with_corners(faces, vertices)
    n = G.cross(G.sub(F.col("pb"), F.col("pa")), G.sub(F.col("pc"), F.col("pa")))
    away = G.dot(n, G.sub(G.vec(*viewpoint), F.col("pa"))) < 0
    return t.select("f", "a", F.when(away, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(away, F.col("b")).otherwise(F.col("c")).alias("c"))


def view_frame(nodes: DataFrame, by: Names, view: tuple[float, float, float], least: float = 0.35) -> DataFrame:
    """Side direction of a polyline at every node: tangent x view where they part by enough, else that of the nearest node
    where they do (the earlier of two), made normal to the tangent again: by, node, sx, sy, sz. One node row each."""
    w = Window.partitionBy(*by).orderBy("node")
    at = lambda f: F.struct(*[F.coalesce(f(c).over(w), F.col(c)).alias(c) for c in "xyz"])
    n = nodes.withColumn("__t", G.unit(G.sub(at(F.lead), at(F.lag)))).withColumn("__c", G.cross(F.col("__t"), G.vec(*view)))
    n = n.withColumn("__i", F.row_number().over(w)).withColumn("__ok", F.when(G.norm(F.col("__c")) >= least, F.struct(F.col("__i").alias("i"), G.unit(F.col("__c")).alias("c"))))
    a = F.last("__ok", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.last("__ok", True).over(Window.partitionBy(*by).orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("__a", a).withColumn("__b", b)
    pick = F.when(F.col("__b").isNull() | (F.col("__i") - F.col("__a.i") <= F.col("__b.i") - F.col("__i")), F.col("__a")).otherwise(F.col("__b"))
    n = n.withColumn("__s", pick["c"])
    s = G.unit(G.sub(F.col("__s"), G.scale(F.col("__t"), G.dot(F.col("__s"), F.col("__t")))))
    return n.select(*by, "node", s["x"].alias("sx"), s["y"].alias("sy"), s["z"].alias("sz"))
