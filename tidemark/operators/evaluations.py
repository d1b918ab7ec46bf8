"""Evaluations of simulated or reconstructed surfaces against what a clip shows: compositions over pixel and vertex tables.

Pixels are rows (k, u, v): ``rendered`` has the depth z (and face) of a surface drawn into frame k, ``mask`` is what the
video shows, ``unknown`` is what hides it, ``depth`` is the measured depth z. ``frames`` (k) lists the frames that count, so
a frame without pixels has a row too. Vertices are rows (k, v, x, y, z). Every function is a few joins and aggregates by
frame; pixel tables meet in one tagged union, so a pixel is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import aggregates as A
from tidemark.operators import mesh as M
from tidemark.operators import windows as W
from tidemark.operators.joins import step_of_frame
from tidemark.operators.kernels import fit_rigid, mesh_contains, mesh_distances
from tidemark.operators.sets import dilate, erode, outline
from tidemark.session import materialize

Names = Sequence[str]

#: Metres that a drawn pixel may lie behind the measured depth and still count as seen.
CUT = 0.006


# ---- pixels of one surface


def pixel_table(frames: DataFrame, rendered: DataFrame, mask: DataFrame, depth: DataFrame, unknown: DataFrame | None = None, cut: float | None = CUT) -> DataFrame:
    """(k, u, v, zm, zd, drawn, vis, real, valid): all pixels that are drawn or in the mask, of the listed frames.

    ``vis`` is drawn and not behind the measured depth by ``cut`` or more (without ``cut``: drawn).
    """
    none = F.lit(None).cast("double")
    part = lambda df, zm, zd, real, unk: df.select("k", "u", "v", zm.alias("zm"), zd.alias("zd"), F.lit(real).alias("real"), F.lit(unk).alias("unk"))
    rows = part(rendered, F.col("z").cast("double"), none, False, False).unionByName(part(mask, none, none, True, False)).unionByName(part(depth, none, F.col("z").cast("double"), False, False))
    if unknown is not None:
        rows = rows.unionByName(part(unknown, none, none, False, True))
    px = rows.groupBy("k", "u", "v").agg(F.min("zm").alias("zm"), F.min("zd").alias("zd"), F.max("real").alias("real"), F.max("unk").alias("unk"))
    drawn = F.col("zm").isNotNull()
    seen = drawn if cut is None else drawn & F.coalesce(F.col("zm") < F.col("zd") + cut, F.lit(False))
    px = px.join(frames.select("k").distinct(), "k", "left_semi")
    return px.where(drawn | F.col("real")).select("k", "u", "v", "zm", "zd", drawn.alias("drawn"), seen.alias("vis"), "real", (~F.col("unk")).alias("valid"))


def _ratio(a: Column, b: Column, nothing: Column) -> Column:
    """Sum of a over the sum of b; ``nothing`` where b never holds."""
    n = F.sum(b.cast("long"))
    return F.when(n > 0, F.sum(a.cast("long")) / n).otherwise(nothing)


def overlap_scores(px: DataFrame, frames: DataFrame, least: int = 30, empty: float | None = 0.0) -> DataFrame:
    """Per frame of a ``pixel_table``: iou, depth_residual (null unless more than ``least`` pixels), cut_by_depth, mesh_px,
    mask_px. ``empty`` is the iou where neither shows anything."""
    ok = F.col("valid")
    a, b = F.col("vis") & ok, F.col("real") & ok
    both = F.col("drawn") & F.col("real") & ok
    off = F.when(both, F.abs(F.col("zm") - F.col("zd")))
    hidden = both & ~F.col("vis")
    g = px.groupBy("k").agg(
        _ratio(a & b, a | b, F.lit(empty).cast("double")).alias("iou"),
        F.when(F.count(off) > least, F.percentile(off, 0.5)).alias("depth_residual"),
        (F.sum(hidden.cast("long")) / F.greatest(F.sum(both.cast("long")), F.lit(1))).alias("cut_by_depth"),
        F.sum(a.cast("long")).alias("mesh_px"),
        F.sum(b.cast("long")).alias("mask_px"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = frames.select("k").distinct().join(g, "k", "left")
    return out.select("k", F.when(F.col("mesh_px").isNull(), F.lit(empty).cast("double")).otherwise(F.col("iou")).alias("iou"), "depth_residual", F.coalesce("cut_by_depth", F.lit(0.0)).alias("cut_by_depth"), zero("mesh_px"), zero("mask_px"))


def outline_scores(px: DataFrame, frames: DataFrame, unknown: DataFrame | None, tol: int = 4, one_empty: float = 0.0, both_empty: float | None = 0.0) -> DataFrame:
    """Per frame the F of two outlines: shares of known outline pixels within ``tol`` of the other's: (k, boundary_f)."""
    known = (lambda df: df.join(unknown.select("k", "u", "v").distinct(), ["k", "u", "v"], "left_anti")) if unknown is not None else (lambda df: df)
    a, b = (known(outline(px.where(c).select("k", "u", "v"), ["k"])) for c in ("vis", "real"))
    near = lambda df, other: df.join(dilate(other, ["k"], tol, "disc"), ["k", "u", "v"], "left_semi")
    parts = [df.select("k", F.lit(n).alias("what")) for n, df in (("a", a), ("b", b), ("p", near(a, b)), ("r", near(b, a)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    g = frames.select("k").distinct().join(rows.groupBy("k").agg(*[F.sum((F.col("what") == n).cast("long")).alias(n) for n in "abpr"]), "k", "left").fillna(0, list("abpr"))
    p, r = F.col("p") / F.greatest("a", F.lit(1)), F.col("r") / F.greatest("b", F.lit(1))
    none, one = (F.col("a") == 0) & (F.col("b") == 0), (F.col("a") == 0) | (F.col("b") == 0)
    return g.select("k", F.when(none, F.lit(both_empty).cast("double")).when(one, F.lit(one_empty)).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("boundary_f"))


def frame_scores(frames: DataFrame, rendered: DataFrame, mask: DataFrame, depth: DataFrame, unknown: DataFrame | None = None, tol: int = 4, least: int = 30, cut: float | None = CUT, empty: float | None = 0.0) -> DataFrame:
    """Overlap, outline and depth of a drawn surface by frame: k, iou, boundary_f, depth_residual, cut_by_depth, mesh_px, mask_px.

    ``empty`` is the iou and outline score of a frame where neither shows anything (null leaves it out of summaries).
    """
    px = pixel_table(frames, rendered, mask, depth, unknown, cut)
    return overlap_scores(px, frames, least, empty).join(outline_scores(px, frames, unknown, tol, both_empty=empty), "k")


def dual_mask_scores(frames: DataFrame, rendered: DataFrame, masks: dict[str, DataFrame], depth: DataFrame, unknown: dict[str, DataFrame], tol: int = 4, cover: DataFrame | None = None) -> DataFrame:
    """``frame_scores`` of one surface against several masks, each with its own unknown pixels: columns <score>_<mask>.

    With ``cover`` also the share of its pixels that the surface covers, drawn (covered) and seen (covered_visible).
    """
    out = frames.select("k").distinct()
    for name, mask in masks.items():
        s = frame_scores(frames, rendered, mask, depth, unknown.get(name), tol)
        out = out.join(s.select("k", *[F.col(c).alias(f"{c}_{name}") for c in ("iou", "boundary_f", "depth_residual")]), "k")
    if cover is not None:
        px = pixel_table(frames, rendered, cover, depth)
        share = lambda c: F.sum((F.col(c) & F.col("real")).cast("long")) / F.greatest(F.sum(F.col("real").cast("long")), F.lit(1))
        out = out.join(px.groupBy("k").agg(share("drawn").alias("covered"), share("vis").alias("covered_visible")), "k", "left").fillna(0.0, ["covered", "covered_visible"])
    return out


def in_front_scores(frames: DataFrame, front: DataFrame, behind: DataFrame, tol: float = 0.0005) -> DataFrame:
    """Two drawn surfaces where both are: pixels of overlap, share where the first is in front of the second by more than
    ``tol``, and by how much at most: k, overlap_px, front_share, front_max."""
    j = front.select("k", "u", "v", F.col("z").alias("__a")).join(behind.select("k", "u", "v", F.col("z").alias("__b")), ["k", "u", "v"])
    d = F.col("__b") - F.col("__a")
    g = j.groupBy("k").agg(F.count(F.lit(1)).alias("overlap_px"), F.avg((d > tol).cast("double")).alias("front_share"), F.max(d).alias("front_max"))
    return frames.select("k").distinct().join(g, "k", "left").fillna(0, ["overlap_px"]).fillna(0.0, ["front_share", "front_max"])


def tube_scores(frames: DataFrame, rendered: DataFrame, mask: DataFrame, depth: DataFrame, unknown: DataFrame, neighbour: DataFrame, tol: int = 4) -> DataFrame:
    """``frame_scores`` of a thin body (depth from more than 15 pixels, null where nothing shows), and iou_apart: the iou
    with the pixels of a ``neighbour`` outside the mask unknown as well."""
    own = frame_scores(frames, rendered, mask, depth, unknown, tol, least=15, empty=None)
    apart = unknown.select("k", "u", "v").unionByName(neighbour.select("k", "u", "v").join(mask, ["k", "u", "v"], "left_anti"))
    more = overlap_scores(pixel_table(frames, rendered, mask, depth, apart), frames, 15, None)
    return own.join(more.select("k", F.col("iou").alias("iou_apart")), "k")


# ---- summaries


def metric_summary(scores: DataFrame, metrics: Names, bands: DataFrame | None = None, k: str = "k") -> DataFrame:
    """n, mean, median, p10, min and max of each metric over all frames (band 'all') and by band [lo, hi): one row a metric
    and band, n = 0 where a band has none."""
    long = scores.unpivot([k], list(metrics), "metric", "value").withColumn("value", F.col("value").cast("double"))
    every = A.summarize(long, ["metric"], "value").withColumn("band", F.lit("all"))
    if bands is None:
        return every.select("metric", "band", "n", "mean", "median", "p10", "min", "max")
    per = A.band_summary(long, bands, long.select("metric").distinct(), ["metric"], k, "value")
    return every.select("metric", "band", "n", "mean", "median", "p10", "min", "max").unionByName(per.select("metric", "band", "n", "mean", "median", "p10", "min", "max"))


def document(series: Sequence[tuple[DataFrame, Names]], bands: DataFrame | None = None, banded: Names = ()) -> DataFrame:
    """Rows (metric, band, n, mean, median, p10, min, max) of many per-frame tables at once.

    Each table (k, metrics) is stacked as it is made, so it is scanned once, and all are summarised together; the metrics in
    ``banded`` also by the bands [lo, hi).
    """
    long = None
    for df, metrics in series:
        part = df.select(F.col("k").cast("long").alias("k"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["k"], list(metrics), "metric", "value")
        long = part if long is None else long.unionByName(part)
    cols = ["metric", "band", "n", "mean", "median", "p10", "min", "max"]
    every = F.array(F.lit("all"))
    if bands is None or not banded:
        return A.summarize(long.withColumn("band", F.lit("all")), ["metric", "band"], "value").select(*cols)
    # a row counts for all frames and for each band that it is in: bands are a dimension of a few rows
    listed = bands.agg(F.collect_list(F.struct("band", "lo", "hi")).alias("__bands"))
    own = F.transform(F.filter("__bands", lambda b: (F.col("k") >= b["lo"]) & (F.col("k") < b["hi"])), lambda b: b["band"])
    tagged = long.crossJoin(F.broadcast(listed)).withColumn("band", F.explode(F.when(F.col("metric").isin(*banded), F.concat(every, own)).otherwise(every)))
    got = A.summarize(tagged, ["metric", "band"], "value")
    none = bands.sparkSession.createDataFrame([(m,) for m in banded], "metric string").crossJoin(F.broadcast(bands.select("band")))
    empty = none.join(got, ["metric", "band"], "left_anti").select("metric", "band", F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(c) for c in cols[3:]])
    return got.select(*cols).unionByName(empty)


def prefixed(df: DataFrame, name: str, cols: Names) -> tuple[DataFrame, list[str]]:
    """A table's columns as metrics ``<name>_<column>``."""
    return df.select("k", *[F.col(c).alias(f"{name}_{c}") for c in cols]), [f"{name}_{c}" for c in cols]


def silhouette_block(scores: DataFrame, bands: DataFrame, baseline: DataFrame | None = None, metrics: Names = ("iou", "iou_apart", "boundary_f", "depth_residual")) -> DataFrame:
    """Summaries of a body's scores by band, and of the iou of a ``baseline`` (the body held still) as static_iou."""
    out = metric_summary(scores, [m for m in metrics if m in scores.columns], bands)
    if baseline is None:
        return out
    return out.unionByName(metric_summary(baseline.select("k", F.col("iou").alias("static_iou")), ["static_iou"]))


# ---- one condition: outline, depth, tracks


def outline_curve(frames: DataFrame, rendered: DataFrame, mask: DataFrame, hidden: DataFrame, depth: DataFrame, refs: dict[str, DataFrame] | None = None, background: DataFrame | None = None, behind: float = 0.004, least_mask: int = 300, least_ref: int = 50, empty: float = 0.0, unwalled: bool = False) -> DataFrame:
    """Per frame whose mask has ``least_mask`` pixels: iou of the surface and the mask where neither is hidden, and median
    depth error on common pixels, against the measured depth and each further reference (k, u, v, z valid pixels only;
    null unless more than ``least_ref``): k, iou, depth_err_monocular, depth_err_<name>. ``empty`` is the iou of frames where
    everything is hidden.

    What lies behind ``background`` (k, u, v, z) does not count as visible; without it, what lies ``behind`` or more
    behind the measured depth. A pixel of which neither is known shows nothing, or with ``unwalled`` all that is drawn there.
    """
    enough = mask.groupBy("k").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least_mask).join(frames, "k", "left_semi").select("k")
    wall = depth.select("k", "u", "v", (F.col("z") + behind).alias("__wall")) if background is None else background.select("k", "u", "v", F.col("z").alias("__wall"))
    seen = F.col("z") < F.col("__wall")
    shown = rendered.join(wall, ["k", "u", "v"], "left").where(F.col("__wall").isNull() | seen if unwalled else seen).select("k", "u", "v", "z")
    free = lambda df: df.join(hidden.select("k", "u", "v").distinct(), ["k", "u", "v"], "left_anti")
    px = pixel_table(enough, free(shown), free(mask), depth, cut=None)
    for name, ref in (refs or {}).items():
        px = px.join(ref.select("k", "u", "v", F.col("z").alias(f"__{name}")), ["k", "u", "v"], "left")
    both = F.col("drawn") & F.col("real")
    cols = [_ratio(both, F.col("drawn") | F.col("real"), F.lit(empty)).alias("iou"), F.percentile(F.when(both, F.abs(F.col("zm") - F.col("zd"))), 0.5).alias("depth_err_monocular")]
    for name in refs or {}:
        e = F.when(both, F.abs(F.col("zm") - F.col(f"__{name}")))
        cols.append(F.when(F.count(e) > least_ref, F.percentile(e, 0.5)).alias(f"depth_err_{name}"))
    return enough.join(px.groupBy("k").agg(*cols), "k", "left").withColumn("iou", F.coalesce("iou", F.lit(empty)))


def bound_tracks(starts: DataFrame, rendered: DataFrame, corners: DataFrame) -> DataFrame:
    """Tracks on the face that is seen under their start, by its barycentric weights: (track, seed, face, w0, w1, w2).

    starts: track, seed, u, v. rendered: (k, u, v, face) of the seed frames. corners: (k, face, ax, ay, … cy), the faces
    in pixels. Tracks over no face, or over one seen edge on, are left out.
    """
    at = starts.select("track", "seed", "u", "v", F.floor("u").cast("int").alias("pu"), F.floor("v").cast("int").alias("pv"))
    hit = at.join(rendered.select(F.col("k").alias("seed"), F.col("u").alias("pu"), F.col("v").alias("pv"), "face"), ["seed", "pu", "pv"])
    j = hit.join(corners.withColumnRenamed("k", "seed"), ["seed", "face"])
    w = G.barycentric2(*[F.col(c) for c in ("u", "v", "ax", "ay", "bx", "by", "cx", "cy")])
    return j.select("track", "seed", "face", w.alias("w")).where("w.w0 is not null").select("track", "seed", "face", "w.*")


def track_errors(bound: DataFrame, tracks: DataFrame, corners: DataFrame, still: DataFrame) -> DataFrame:
    """Image distance of every later sample of a bound track from its place on the moving surface, and from its place on the
    surface held still: (track, seed, k, e, e_static).

    tracks: track, seed, k, u, v (rows that are seen only). corners: (k, face, ax, … cy) of the moving surface. still:
    (seed, k, face, ax, … cy), the surface as it was at the seed frame, seen from frame k.
    """
    t = bound.join(tracks, ["track", "seed"]).where(F.col("k") > F.col("seed"))
    place = lambda p, x: F.col("w0") * F.col(f"{p}.a{x}") + F.col("w1") * F.col(f"{p}.b{x}") + F.col("w2") * F.col(f"{p}.c{x}")
    pack = lambda df, keys, n: df.select(*keys, F.struct("ax", "ay", "bx", "by", "cx", "cy").alias(n))
    t = t.join(pack(corners, ["k", "face"], "__m"), ["k", "face"]).join(pack(still, ["seed", "k", "face"], "__s"), ["seed", "k", "face"])
    far = lambda p: F.hypot(place(p, "x") - F.col("u"), place(p, "y") - F.col("v"))
    return t.select("track", "seed", "k", far("__m").alias("e"), far("__s").alias("e_static"))


def track_summary(errors: DataFrame, least: int = 10, bound: DataFrame | None = None, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row: pooled medians, samples, seeds, tracks, seeds better than static, first-seed median; a row a seed of ``least`` samples).

    Tracks are those that were ``bound``, with later samples or not, and seeds all seeds of ``starts``; without these tables
    both are counted among the samples.
    """
    pooled = A.with_quantiles(errors, [], F.col("e"), {"track_err": 0.5}, F.count(F.lit(1)).alias("n_samples"), F.count_distinct("seed").alias("n_seeds"), F.count_distinct("track", "seed").alias("n_tracks"))
    if bound is not None:
        pooled = pooled.drop("n_tracks").crossJoin(bound.select("track", "seed").distinct().agg(F.count(F.lit(1)).alias("n_tracks")))
    if starts is not None:
        pooled = pooled.drop("n_seeds").crossJoin(starts.agg(F.count_distinct("seed").alias("n_seeds")))
    static = A.quantiles(errors, [], F.col("e_static"), {"track_err_static": 0.5})
    first = A.with_quantiles(errors.where("seed = 0"), [], F.col("e"), {"track_err_first_seed": 0.5}, F.count(F.lit(1)).alias("n_samples_first_seed"))
    both = errors.unpivot(["seed"], ["e", "e_static"], "which", "x")
    med = A.with_quantiles(both, ["seed", "which"], F.col("x"), {"m": 0.5}, F.count(F.lit(1)).alias("n"))
    pick = lambda w, c: F.max(F.when(F.col("which") == w, F.col(c)))
    by = med.groupBy("seed").agg(pick("e", "m").alias("sim"), pick("e_static", "m").alias("static"), pick("e", "n").alias("n")).where(F.col("n") >= least)
    better = by.agg(F.coalesce(F.sum((F.col("sim") < F.col("static")).cast("long")), F.lit(0)).alias("seeds_better_than_static"))
    return pooled.crossJoin(static).crossJoin(first).crossJoin(better), by


def condition_evaluation(curve: DataFrame, errors: DataFrame, bound: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """One condition's document, a row: mean outline iou and its curve (k, iou), for each depth its mean over the frames that
    have one and its curve depth_curve_<name> (k, value, null where a frame has none), and the track summary with track_by_seed
    (seed, sim, static, n). Curves have a point a frame."""
    depth = [c for c in curve.columns if c.startswith("depth_err_")]
    curves = [F.sort_array(F.collect_list(F.struct("k", F.col(c).alias("value")))).alias(c.replace("depth_err_", "depth_curve_")) for c in depth]
    a = curve.agg(F.avg("iou").alias("outline_iou"), F.count(F.lit(1)).alias("n_frames"), F.sort_array(F.collect_list(F.struct("k", "iou"))).alias("iou_curve"), *[F.avg(c).alias(c) for c in depth], *curves)
    one, by = track_summary(errors, bound=bound, starts=starts)
    return a.crossJoin(one).crossJoin(by.agg(F.sort_array(F.collect_list(F.struct("seed", "sim", "static", "n"))).alias("track_by_seed")))


def texture_tracking(sim: DataFrame, static: DataFrame, far: float = 15.0) -> DataFrame:
    """Motion change of a simulated surface against the same surface held still: seeds whose median ``static`` error is at
    least ``far`` pixels count: track_err, track_err_static, value, baseline, n, change. Both: track errors (seed, e)."""
    med = lambda df, n: A.quantiles(df, [], F.col("e"), {n: 0.5})
    per = lambda df, n: df.groupBy("seed").agg(F.percentile("e", 0.5).alias(n), F.count(F.lit(1)).alias(f"n_{n}")).where(F.col(f"n_{n}") >= 10)
    moving = per(static, "m").where(F.col("m") >= far).select("seed")
    both = per(sim, "sim").join(per(static, "st"), "seed")
    return med(sim, "track_err").crossJoin(med(static, "track_err_static")).crossJoin(A.change_percent(both, moving, "seed", "sim", "st"))


# ---- motion against optical flow


def flow_errors(px: DataFrame, faces: DataFrame, at: DataFrame, after: DataFrame, held: DataFrame, flow: DataFrame, least: int = 50) -> DataFrame:
    """Median end-point error of a surface's motion over a gap against optical flow, and of the same surface held still:
    (k, epe, epe_static, n); frames with fewer than ``least`` pixels are left out.

    px: (k, u, v, face) where the surface is seen and shown. at / after / held: (k, v, u, w) projections of the vertices in
    frame k, after the gap, and of the shape of frame k after the gap (camera motion only). flow: (k, u, v, du, dv).
    A pixel moves by the mean motion of its face's corners.
    """
    moved = lambda df, n: df.select("k", "v", F.col("u").alias(f"__{n}u"), F.col("w").alias(f"__{n}w"))
    j = moved(at, "a").join(moved(after, "b"), ["k", "v"]).join(moved(held, "s"), ["k", "v"])
    corners = faces.select("f", F.explode(F.array("a", "b", "c")).alias("v"))
    mean = lambda n, x: F.avg(F.col(f"__{n}{x}") - F.col(f"__a{x}"))
    per_face = corners.join(j, "v").groupBy("k", "f").agg(mean("b", "u").alias("mu"), mean("b", "w").alias("mv"), mean("s", "u").alias("su"), mean("s", "w").alias("sv"))
    p = px.select("k", "u", "v", F.col("face").alias("f")).join(per_face, ["k", "f"]).join(flow, ["k", "u", "v"])
    e = lambda a, b: F.percentile(F.hypot(F.col(a) - F.col("du"), F.col(b) - F.col("dv")), 0.5)
    return p.groupBy("k").agg(e("mu", "mv").alias("epe"), e("su", "sv").alias("epe_static"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---- vertices against recorded ones


def to_frames(states: DataFrame, frames: DataFrame, fps: float, dt: float, steps: int) -> DataFrame:
    """States by control step (step, …) as states by video frame (k, …): the nearest step."""
    return frames.select("k", step_of_frame(F.col("k").cast("double"), fps, dt, steps).alias("step")).join(states, "step").drop("step")


def recorded_errors(sim: DataFrame, rec: DataFrame, rest: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Per frame the mean distance of vertices from the recorded ones, and of the rest shape from them: (k, e, e_static).
    With ``free`` (v) only those vertices."""
    j = sim.select("k", "v", F.struct("x", "y", "z").alias("s")).join(rec.select("k", "v", F.struct("x", "y", "z").alias("r")), ["k", "v"]).join(rest.select("v", F.struct("x", "y", "z").alias("o")), "v")
    if free is not None:
        j = j.join(free.select("v"), "v", "left_semi")
    return j.groupBy("k").agg(F.avg(G.norm(G.sub(F.col("s"), F.col("r")))).alias("e"), F.avg(G.norm(G.sub(F.col("o"), F.col("r")))).alias("e_static"))


def motion_explained(errors: DataFrame) -> DataFrame:
    """1 - mean(e) / max(mean(e_static), 1e-9)."""
    return errors.agg((1.0 - F.avg("e") / F.greatest(F.avg("e_static"), F.lit(1e-9))).alias("explained"))


def tissue_evaluation(frames: DataFrame, bands: DataFrame, scores: dict[str, DataFrame], sim: DataFrame, rest: DataFrame, faces: DataFrame, rec: DataFrame | None = None, flow: dict[str, DataFrame] | None = None) -> DataFrame:
    """One tissue's document as rows (metric, band, n, mean, median, p10, min, max).

    ``scores``: ``frame_scores`` by name (sim, recon, static, …); ``flow``: ``flow_errors`` by name. From the vertices: the
    errors against the record and how much of its motion is explained, area and volume, edge stretch over rest, fold.
    """
    series, banded = [], []
    for name, t in scores.items():
        df, metrics = prefixed(t, name, [c for c in ("iou", "boundary_f", "depth_residual") if c in t.columns])
        series.append((df, metrics))
        banded += metrics
    for name, f in (flow or {}).items():
        series.append(prefixed(f, name, ["epe", "epe_static"]))
    sim = sim.join(frames.select("k").distinct(), "k", "left_semi")
    series.append((M.stretch(rest, sim, M.edge_use(faces).select("a", "b")).select("k", F.col("max").alias("stretch_max"), F.col("p95").alias("stretch_p95")), ["stretch_max", "stretch_p95"]))
    series.append((M.area_and_volume(sim, faces, ["k"]), ["area", "volume"]))
    series.append((M.fold(sim, faces).select(F.lit(0).alias("k"), "fold_p90"), ["fold_p90"]))
    if rec is not None:
        e = recorded_errors(sim, rec, rest)
        series.append((e.select("k", F.col("e").alias("err_vs_record"), F.col("e_static").alias("err_static_vs_record")), ["err_vs_record", "err_static_vs_record"]))
        series.append((motion_explained(e).select(F.lit(0).alias("k"), F.col("explained").alias("motion_explained")), ["motion_explained"]))
    return document(series, bands, banded)


def temporal_scores(verts: DataFrame) -> DataFrame:
    """One row: largest, 99th percentile and mean speed of a vertex, largest acceleration, path and range of the centroid."""
    w = Window.partitionBy("v").orderBy("k")
    step = lambda f: F.sqrt(sum((f(c) ** 2 for c in "yz"), f("x") ** 2))
    m = verts.withColumn("speed", step(lambda c: F.col(c) - F.lag(c).over(w))).withColumn("accel", step(lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)))
    a = A.with_quantiles(m, [], F.col("speed"), {"p99_speed": 0.99}, F.max("speed").alias("max_speed"), F.avg("speed").alias("mean_speed"), F.max("accel").alias("max_accel"))
    c = verts.groupBy("k").agg(*[F.avg(x).alias(x) for x in "xyz"]).withColumn("path", F.lit("all"))
    wk = Window.partitionBy("path").orderBy("k")  # one row a frame
    c = c.withColumn("d", step(lambda x: F.col(x) - F.lag(x).over(wk)))
    return a.crossJoin(c.agg(F.sum("d").alias("centroid_path"), *[(F.max(x) - F.min(x)).alias(f"range_{x}") for x in "xyz"]))


#: Least quality at rest of a cell that is no sliver.
WELL_SHAPED = 0.01


def largest_stretch(c: dict[str, Column]) -> Column:
    """Largest singular value of a 3 x 3 matrix from the entries xx, yy, zz, xy, xz, yz of its product with its own transpose:
    the root of the largest eigenvalue, in closed form."""
    mean = (c["xx"] + c["yy"] + c["zz"]) / 3
    spread = F.sqrt(((c["xx"] - mean) ** 2 + (c["yy"] - mean) ** 2 + (c["zz"] - mean) ** 2 + 2 * (c["xy"] ** 2 + c["xz"] ** 2 + c["yz"] ** 2)) / 6)
    x, y, z = c["xx"] - mean, c["yy"] - mean, c["zz"] - mean
    det = x * (y * z - c["yz"] ** 2) - c["xy"] * (c["xy"] * z - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - y * c["xz"])
    turn = F.acos(F.least(F.greatest(det / (2 * spread**3), F.lit(-1.0)), F.lit(1.0))) / 3
    return F.sqrt(F.greatest(F.when(spread > 0, mean + 2 * spread * F.cos(turn)).otherwise(mean), F.lit(0.0)))


def tet_strain(rest: DataFrame, verts: DataFrame, tets: DataFrame, well: float = WELL_SHAPED) -> DataFrame:
    """Per frame of a tetrahedral body: least determinant of a cell's deformation, cells turned over, those of them that are
    well shaped at rest (quality of ``well`` or more), and how far the largest principal stretch of a cell is from 1: (k,
    min_det, inverted, inverted_well, principal). Cells without volume at rest are left out. Cells meet their corners once.

    A cell's deformation takes its edges at rest to its edges now; in barycentric terms it is sum of p_i grad_i^T over the
    corners, grad_i the rest cell's shape gradients, which come with the rest table.
    """
    corners = ("a", "b", "c", "d")
    p = {n: F.col(f"p{n}") for n in corners}
    vol = G.tet_volume(*p.values())
    e1, e2, e3 = (G.sub(p[n], p["a"]) for n in "bcd")
    r = M.with_corners(tets, rest, corners).withColumn("v0", vol).where("v0 <> 0")
    grads = [G.scale(G.cross(x, y), 1.0 / (6.0 * F.col("v0"))) for x, y in ((e2, e3), (e3, e1), (e1, e2))]
    r = r.select("t", "v0", (G.tet_quality(*p.values()) >= well).alias("well"), *[g.alias(f"g{n}") for g, n in zip(grads, "bcd")])
    n = M.with_corners(tets, verts, corners, ("k",)).select("k", "t", vol.alias("v"), e1.alias("eb"), e2.alias("ec"), e3.alias("ed")).join(r, "t")
    row = lambda i: [sum((F.col(f"e{m}")[i] * F.col(f"g{m}")[j] for m in "cd"), F.col("eb")[i] * F.col("gb")[j]) for j in "xyz"]
    f = [row(i) for i in "xyz"]
    dot = lambda i, j: sum((f[i][q] * f[j][q] for q in (1, 2)), f[i][0] * f[j][0])
    n = n.select("k", "well", (F.col("v") / F.col("v0")).alias("det"), *[dot(i, j).alias("xyz"[i] + "xyz"[j]) for i in range(3) for j in range(i, 3)])
    off = F.abs(largest_stretch({c: F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")}) - 1)
    turned = F.col("det") <= 0
    return n.groupBy("k").agg(F.min("det").alias("min_det"), F.sum(turned.cast("long")).alias("inverted"), F.sum((turned & F.col("well")).cast("long")).alias("inverted_well"), F.max(off).alias("principal"))


def slivers(rest: DataFrame, tets: DataFrame, well: float = WELL_SHAPED) -> DataFrame:
    """One row: cells whose quality at rest is under ``well``."""
    t = M.with_corners(tets, rest, ("a", "b", "c", "d"))
    return t.agg(F.coalesce(F.sum((G.tet_quality(*[F.col(f"p{n}") for n in "abcd"]) < well).cast("long")), F.lit(0)).alias("slivers"))


def rigid_remainder(rest: DataFrame, verts: DataFrame) -> DataFrame:
    """Per frame the best rigid motion from rest and what it leaves: (k, degrees, shift, rms, max)."""
    j = verts.select("k", "v", *[F.col(c).alias(f"b{c}") for c in "xyz"]).join(rest.select("v", *[F.col(c).alias(f"a{c}") for c in "xyz"]), "v")
    fit = fit_rigid(j, ["k"], ["ax", "ay", "az"], ["bx", "by", "bz"]).select("k", "rotation", F.col("shift").alias("t"), "rms")
    moved = lambda i: sum((F.col("rotation")[3 * i + q] * F.col(f"a{c}") for q, c in ((1, "y"), (2, "z"))), F.col("rotation")[3 * i] * F.col("ax")) + F.col("t")[i]
    left = F.sqrt(sum(((moved(i) - F.col(f"b{c}")) ** 2 for i, c in ((1, "y"), (2, "z"))), (moved(0) - F.col("bx")) ** 2))
    g = j.join(fit, "k").groupBy("k").agg(F.max(left).alias("max"), F.sqrt(sum(((F.avg(f"b{c}") - F.avg(f"a{c}")) ** 2 for c in "yz"), (F.avg("bx") - F.avg("ax")) ** 2)).alias("shift"))
    return fit.join(g, "k").select("k", G.rotation_degrees(F.col("rotation")).alias("degrees"), "shift", "rms", "max")


def body_evaluation(scores: dict[str, DataFrame], rest: DataFrame, verts: DataFrame, faces: DataFrame, tets: DataFrame) -> DataFrame:
    """A tetrahedral body's document as rows (metric, band, n, mean, median, p10, min, max): scores against each mask, speed
    and acceleration, volume over rest, strain, edge stretch, rigid motion and remainder."""
    series = [prefixed(t, name, ("iou", "boundary_f", "depth_residual")) for name, t in scores.items()]
    one = temporal_scores(verts)
    series.append((one.select(F.lit(0).alias("k"), *one.columns), one.columns))
    v0 = M.enclosed_volume(rest, faces).select(F.col("volume").alias("__v0"))
    series.append((M.enclosed_volume(verts, faces, ["k"]).crossJoin(F.broadcast(v0)).select("k", (F.col("volume") / F.col("__v0")).alias("volume_ratio")), ["volume_ratio"]))
    series.append((tet_strain(rest, verts, tets), ["min_det", "inverted", "inverted_well", "principal"]))
    series.append((slivers(rest, tets).select(F.lit(0).alias("k"), "slivers"), ["slivers"]))
    pairs = F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in ("ab", "ac", "ad", "bc", "bd", "cd")]))
    edges = tets.select(pairs.alias("e")).select("e.*").distinct()
    series.append((M.stretch(rest, verts, edges).select("k", F.col("max").alias("stretch_max"), F.col("p95").alias("stretch_p95")), ["stretch_max", "stretch_p95"]))
    series.append((rigid_remainder(rest, verts).select("k", "degrees", "shift", F.col("rms").alias("nonrigid_rms"), F.col("max").alias("nonrigid_max")), ["degrees", "shift", "nonrigid_rms", "nonrigid_max"]))
    return document(series)


def anatomy_gaps(surface: DataFrame, faces: DataFrame, ducts: DataFrame | None, sheet: DataFrame | None, attached: DataFrame | None, tip: DataFrame | None, inside: float = 0.001) -> DataFrame:
    """Five gaps between parts that are attached: (metric, median, max, n) over the frames that have data; metrics without any
    are left out.

    duct_start_gap: farthest first node of a duct from the body's surface; duct_nodes_inside: share of the other nodes more
    than ``inside`` within it; sheet_base_gap: median distance of the sheet's vertices attached to the body; sheet_inside:
    share of its free vertices inside; jaw_tip: distance of the middle of the vertices held by a tool from its tip.
    surface: (k, v, x, y, z) of a closed body with ``faces``; ducts: (k, duct, node, x, y, z); sheet: (k, v, x, y, z); attached:
    (v, target) with target body, backdrop or a tool; tip: (k, x, y, z). All points are measured against the surface at once.
    """
    held = None if sheet is None else sheet.join(attached.select("v", "target"), "v", "left")
    parts = []
    if ducts is not None:
        first = F.min("node").over(Window.partitionBy("k", "duct"))
        parts.append(ducts.withColumn("__f", first).select("k", F.when(F.col("node") == F.col("__f"), "start").otherwise("node").alias("role"), "x", "y", "z"))
    if held is not None:
        role = F.when(F.col("target") == "body", "base").when(F.col("target").isNull() | (F.col("target") == "backdrop"), "free").otherwise("jaw")
        parts.append(held.select("k", role.alias("role"), "x", "y", "z"))
    if not parts:
        return surface.sparkSession.createDataFrame([], "metric string, median double, max double, n long")
    points = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()), "anatomy")
    asked = points.where("role <> 'jaw'")
    tri = M.with_corners(faces, surface, ("a", "b", "c"), ("k",))
    tri = tri.select("k", F.col("f").alias("face"), *[F.col(f"p{p}.{x}").alias(f"{p}{x}") for p in "abc" for x in "xyz"])
    near = mesh_distances(asked.select("k", "id", "x", "y", "z"), tri, ["k"])
    sign = mesh_contains(asked.select("k", "id", "x", "y", "z"), tri, ["k"])
    sd = asked.select("k", "id", "role").join(near.select("k", "id", "d"), ["k", "id"]).join(sign, ["k", "id"]).withColumn("in", F.when(F.col("inside"), F.col("d")).otherwise(-F.col("d")))
    at = lambda role, c: F.when(F.col("role") == role, c)
    deep = (F.col("in") > inside).cast("double")
    per = sd.groupBy("k").agg(F.max(at("start", F.col("d"))).alias("duct_start_gap"), F.avg(at("node", deep)).alias("duct_nodes_inside"), F.percentile(at("base", F.col("d")), 0.5).alias("sheet_base_gap"), F.avg(at("free", deep)).alias("sheet_inside"))
    series = [(per, ["duct_start_gap", "duct_nodes_inside", "sheet_base_gap", "sheet_inside"])]
    if held is not None and tip is not None:
        jaw = points.where("role = 'jaw'").groupBy("k").agg(*[F.avg(x).alias(f"j{x}") for x in "xyz"]).join(tip.select("k", *[F.col(x).alias(f"t{x}") for x in "xyz"]), "k")
        series.append((jaw.select("k", F.sqrt(sum(((F.col(f"j{x}") - F.col(f"t{x}")) ** 2 for x in "yz"), (F.col("jx") - F.col("tx")) ** 2)).alias("jaw_tip")), ["jaw_tip"]))
    return document(series).where("n > 0").select("metric", "median", "max", "n")


def instrument_block(tips: DataFrame, planned: DataFrame, forces: DataFrame | None = None, bands: DataFrame | None = None) -> DataFrame:
    """Instruments of a run as document rows: <tool>_tip_lag, the distance of the simulated tip from the planned point, and
    <tool>_force by band. tips, planned: (tool, k, x, y, z); forces: (tool, k, force)."""
    j = tips.join(planned.select("tool", "k", *[F.col(c).alias(f"p{c}") for c in "xyz"]), ["tool", "k"])
    lag = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("px")) ** 2))
    long = j.select("k", F.concat("tool", F.lit("_tip_lag")).alias("metric"), lag.alias("value"))
    cols = ["metric", "band", "n", "mean", "median", "p10", "min", "max"]
    if forces is not None:
        long = long.unionByName(forces.select("k", F.concat("tool", F.lit("_force")).alias("metric"), F.col("force").cast("double").alias("value")))
    every = A.summarize(long.withColumn("band", F.lit("all")), ["metric", "band"], "value").select(*cols)
    if bands is None or forces is None:
        return every
    pushed = long.where(F.endswith("metric", F.lit("_force")))
    return every.unionByName(A.band_summary(pushed, bands, pushed.select("metric").distinct(), ["metric"], "k", "value").select(*cols))


def split_depth(px: DataFrame, side: DataFrame, least: int = 30) -> DataFrame:
    """Depth residual of two parts of a surface by frame, and the sign of the second's: (k, lower, upper, upper_sign).

    px: a ``pixel_table`` with ``face``; side: (face, s), the mean grid row of a face, 0.5 and more is the lower part.
    """
    j = px.where(F.col("drawn") & F.col("real") & F.col("valid")).join(side, "face")
    low, up = F.col("s") >= 0.5, F.col("s") < 0.5
    med = lambda c, x: F.when(F.count(F.when(c, x)) > least, F.percentile(F.when(c, x), 0.5))
    off = F.col("zm") - F.col("zd")
    return j.groupBy("k").agg(med(low, F.abs(off)).alias("lower"), med(up, F.abs(off)).alias("upper"), med(up, -off).alias("upper_sign"))


def sheet_evaluation(scores: DataFrame, raw: DataFrame, split: DataFrame, verts: DataFrame, rest: DataFrame, faces: DataFrame, apex: DataFrame, base: DataFrame, image_apex: DataFrame, others: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """A sheet's document as rows (metric, band, n, …, error).

    scores / raw: ``frame_scores`` with and without the visibility cut; split: ``split_depth``. apex / base: (v) vertices of
    the held edge and of the base. image_apex: (k, u, v, pu, pv), the apex in the image and the projected one. others:
    further series (k, value) of tracks that may be missing; a missing one is a row with its error.
    """
    edges = M.edge_use(faces).select("a", "b")
    pick = lambda df, who: df.join(who.select("v"), "v", "left_semi")
    mean = lambda df, n: df.groupBy("k").agg(F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias(n))
    lift = mean(pick(verts, apex), "__a").join(mean(pick(verts, base), "__b"), "k").select("k", G.norm(G.sub(F.col("__a"), F.col("__b"))).alias("lift"))
    low = M.edge_lengths(rest, edges).select("a", "b", F.col("length").alias("__l0"))
    s05 = M.edge_lengths(verts, edges, ("k",)).join(low, ["a", "b"]).groupBy("k").agg(F.percentile(F.col("length") / F.col("__l0"), 0.05).alias("stretch_p05"))
    w = Window.partitionBy("v").orderBy("k")
    acc = F.sqrt(sum(((F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)) ** 2 for c in "yz"), (F.lead("x").over(w) - 2 * F.col("x") + F.lag("x").over(w)) ** 2))
    parts = [
        (scores.select("k", "iou", "boundary_f", "depth_residual"), ["iou", "boundary_f", "depth_residual"]),
        (raw.select("k", F.col("iou").alias("iou_raw")), ["iou_raw"]),
        (split.select("k", F.col("lower").alias("depth_lower"), F.col("upper").alias("depth_upper"), F.col("upper_sign").alias("depth_upper_sign")), ["depth_lower", "depth_upper", "depth_upper_sign"]),
        (M.surface_area(verts, faces, ["k"]), ["area"]),
        (lift, ["lift"]),
        (M.stretch(rest, verts, edges).select("k", F.col("max").alias("stretch_max"), F.col("p95").alias("stretch_p95")), ["stretch_max", "stretch_p95"]),
        (s05, ["stretch_p05"]),
        (verts.withColumn("__a", acc).groupBy("k").agg(F.avg("__a").alias("accel")), ["accel"]),
        (image_apex.select("k", F.hypot(F.col("u") - F.col("pu"), F.col("v") - F.col("pv")).alias("apex_to_image")), ["apex_to_image"]),
    ]
    out = None
    for df, metrics in parts + [(o.select("k", F.col("value").alias(n)), [n]) for n, o in (others or {}).items() if o is not None]:
        part = metric_summary(df, metrics)
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("error", F.lit(None).cast("string"))
    missing = [n for n, o in (others or {}).items() if o is None]
    if missing:
        spark = verts.sparkSession
        gone = spark.createDataFrame([(n, "all", 0, f"{n}: side input missing") for n in missing], "metric string, band string, n long, error string")
        out = out.unionByName(gone, allowMissingColumns=True)
    return out


def surface_report(frames: DataFrame, versions: dict[str, DataFrame], masks: DataFrame, other: DataFrame, occluders: DataFrame) -> DataFrame:
    """How each version of a sheet lies against another surface, as rows (version, metric, band, n, mean, …).

    versions: rendered pixels (k, u, v, z). hidden_share: share of the sheet's pixels with the other surface in front;
    visible_iou: iou of what is left with the mask, occluders unknown.
    """
    out = None
    for name, sheet in versions.items():
        j = sheet.join(other.select("k", "u", "v", F.col("z").alias("__o")), ["k", "u", "v"], "left").withColumn("__hid", F.coalesce(F.col("__o") < F.col("z"), F.lit(False)))
        hid = j.groupBy("k").agg(F.avg(F.col("__hid").cast("double")).alias("hidden_share"))
        px = pixel_table(frames, j.where(~F.col("__hid")).select("k", "u", "v", "z"), masks, sheet.limit(0).select("k", "u", "v", "z"), occluders, cut=None)
        both = frames.select("k").distinct().join(hid, "k", "left").fillna(0.0, ["hidden_share"]).join(overlap_scores(px, frames).select("k", F.col("iou").alias("visible_iou")), "k")
        part = metric_summary(both, ["hidden_share", "visible_iou"]).withColumn("version", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("version", "metric", "band", "n", "mean", "median", "p10", "min", "max")


# ---- static backdrop


def backdrop_scores(frames: DataFrame, rendered: DataFrame, static: DataFrame, depth: DataFrame, images: DataFrame, organ: DataFrame, occluders: DataFrame, least: int = 50) -> DataFrame:
    """A fused background against every frame: k, coverage, depth_med, depth_bias, depth_p90, front_violation, organ_violation,
    organ_gap, photo_l1, photo_ncc, frame_iou.

    rendered: (k, u, v, z, g); static: (k, u, v) that shows the background; images: (k, u, v, g, specular); organ: (k, u, v)
    in front of it, eroded by three pixels here; occluders are dilated by two. One row of ``images`` a pixel of the frame.
    """
    keep = frames.select("k").distinct()
    inner = erode(organ, ["k"], 3)  # a square of three each way is three erosions by one
    flag = lambda df, n: df.select("k", "u", "v").distinct().withColumn(n, F.lit(True))
    px = images.join(keep, "k", "left_semi").select("k", "u", "v", F.col("g").alias("gi"), "specular")
    px = px.join(rendered.select("k", "u", "v", F.col("z").alias("zr"), F.col("g").alias("gr")), ["k", "u", "v"], "left")
    px = px.join(depth.select("k", "u", "v", F.col("z").alias("zd")), ["k", "u", "v"], "left")
    for df, n in ((static, "st"), (inner, "org"), (dilate(occluders, ["k"], 2), "occ")):
        px = px.join(flag(df, n), ["k", "u", "v"], "left")
    on = lambda n: F.coalesce(F.col(n), F.lit(False))
    drawn = F.col("zr").isNotNull()
    both, dz = drawn & on("st"), F.col("zr") - F.col("zd")
    over = drawn & on("org")
    photo = both & ~F.col("specular")
    when = lambda c, x: F.when(c, x)
    many = lambda c, value: F.when(F.sum(c.cast("long")) > least, value)
    a, b = when(photo, F.col("gr").cast("double")), when(photo, F.col("gi").cast("double"))
    g = px.groupBy("k").agg(
        (F.sum(both.cast("long")) / F.greatest(F.sum(on("st").cast("long")), F.lit(1))).alias("coverage"),
        many(both, F.percentile(when(both, F.abs(dz)), 0.5)).alias("depth_med"),
        many(both, F.percentile(when(both, dz), 0.5)).alias("depth_bias"),
        many(both, F.percentile(when(both, F.abs(dz)), 0.9)).alias("depth_p90"),
        F.avg(when(both, (dz < -0.005).cast("double"))).alias("front_violation"),
        many(over, F.avg(when(over, (dz < -0.002).cast("double")))).alias("organ_violation"),
        many(over, F.percentile(when(over, dz), 0.5)).alias("organ_gap"),
        many(photo, F.avg(when(photo, F.abs(F.col("gr") - F.col("gi"))))).alias("photo_l1"),
        many(photo, F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b) + 1e-9)).alias("photo_ncc"),
        (F.sum((drawn & ~on("occ")).cast("long")) / F.sum((~on("occ")).cast("long"))).alias("frame_iou"),
    )
    return keep.join(g, "k", "left")


def backdrop_report(scores: DataFrame, bands: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Summaries of all ``backdrop_scores``; with a baseline's also the difference of the means (change)."""
    names = [c for c in scores.columns if c != "k"]
    out = metric_summary(scores, names, bands)
    if baseline is None:
        return out
    old = metric_summary(baseline, names, bands).select("metric", "band", F.col("mean").alias("__old"))
    return out.join(old, ["metric", "band"], "left").withColumn("change", F.col("mean") - F.col("__old")).drop("__old")


def warp_consistency(warps: dict[str, DataFrame], images: DataFrame, least: int = 500) -> DataFrame:
    """Pairs of frames carried into each other by several depths, compared on the pixels that all of them carry: rows
    (i, j, way, l1, ncc, n); pairs with fewer than ``least`` common pixels are left out.

    warps: by name (i, j, u, v, g), the grey value that frame j shows where pixel (u, v) of frame i is carried to.
    images: (k, u, v, g).
    """
    every = None
    for name, w in warps.items():
        part = w.select("i", "j", "u", "v", F.lit(name).alias("way"), F.col("g").alias("gw"))
        every = part if every is None else every.unionByName(part)
    common = every.groupBy("i", "j", "u", "v").agg(F.count_distinct("way").alias("__n")).where(F.col("__n") == len(warps)).select("i", "j", "u", "v")
    j = every.join(common, ["i", "j", "u", "v"], "left_semi").join(images.select(F.col("k").alias("i"), "u", "v", F.col("g").cast("double").alias("g")), ["i", "u", "v"])
    a, b = F.col("gw").cast("double"), F.col("g")
    g = j.groupBy("i", "j", "way").agg(F.avg(F.abs(a - b)).alias("l1"), (F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b) + 1e-9)).alias("ncc"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least)


# ---- tools and tissue


def interaction_facts(track: DataFrame, order: str = "k", tol: float = 1.0, push: float = 4.0, min_on: int = 3, min_off: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (tool, k, indent, visible, label): the indentation with gaps filled and a running median of seven, contact
    (visible and not above the tissue by ``tol``, short gaps and runs cleaned), pushing (contact deeper than ``push``,
    cleaned): (per frame, intervals of both (tool, what, start, end, n), labels in contact (tool, label, n))."""
    by, o = ["tool"], [order]
    t = W.median_filter(W.fill_gaps(track, by, o, "indent", "__f"), by, o, "__f", 7, "smooth").drop("__f")
    t = W.clean_runs(t, by, o, F.col("visible") & (F.col("smooth") > -tol), min_on, min_off, "contact")
    t = W.clean_runs(t, by, o, F.col("contact") & (F.col("smooth") > push), min_on, min_off, "pushing")
    runs = W.flag_intervals(t, by, o, F.col("contact")).withColumn("what", F.lit("contact")).unionByName(W.flag_intervals(t, by, o, F.col("pushing")).withColumn("what", F.lit("push")))
    labels = t.where("contact").groupBy("tool", "label").agg(F.count(F.lit(1)).alias("n"))
    return t, runs.select("tool", "what", "start", "end", "n"), labels


def interaction_report(facts: DataFrame, series: Names, after: int | None = None) -> DataFrame:
    """Summaries of named series of ``interaction_facts`` over all frames, over frames in contact, and from frame ``after``
    on: (tool, metric, part, n, mean, median, p10, min, max)."""
    long = facts.unpivot(["tool", "k", "contact"], list(series), "metric", "value")
    parts = [long.withColumn("part", F.lit("all")), long.where("contact").withColumn("part", F.lit("contact"))]
    if after is not None:
        parts.append(long.where(F.col("k") >= after).withColumn("part", F.lit("after")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return A.summarize(every.withColumn("value", F.col("value").cast("double")), ["tool", "metric", "part"], "value")


def free_space_bound(samples: DataFrame, radius: float, least: int = 4) -> DataFrame:
    """How far a shaft may move away from the camera by what is seen beside it: 20th percentile of (tissue - shaft - radius)
    over the second half of a frame's samples (k, i, tissue, shaft), null under ``least`` samples: (k, away)."""
    w, part = Window.partitionBy("k").orderBy("i"), Window.partitionBy("k")
    s = samples.where("tissue is not null").withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(part))
    half = F.when(F.col("__i") >= F.floor(F.col("__n") / 2), F.col("tissue") - F.col("shaft") - F.lit(radius))
    return s.groupBy("k").agg(F.when(F.max("__n") >= least, F.percentile(half, 0.2)).alias("away"))


def width_only_depth(samples: DataFrame, focal: DataFrame, diameter: float, least: int = 4, narrow: float = 5.0) -> DataFrame:
    """Depth of a shaft's end from its apparent width alone: a line through (s, w) of a frame's samples, read at ``s_end``:
    f * diameter / width, null under ``least`` samples or ``narrow`` pixels: (k, z). focal: (k, f, s_end)."""
    line = A.weighted_line(samples, ["k"], F.col("s"), F.col("w"), F.lit(1.0)).join(samples.groupBy("k").agg(F.count(F.lit(1)).alias("__n")), "k")
    j = line.join(focal, "k").withColumn("__w", F.col("a") * F.col("s_end") + F.col("b"))
    return j.select("k", F.when((F.col("__n") >= least) & (F.col("__w") > narrow), F.col("f") * F.lit(diameter) / F.col("__w")).alias("z"))


def under_sheet(around: DataFrame, share: float = 0.5) -> DataFrame:
    """Frames whose pixels around a tip are sheet for ``share`` or more, and the median depth of those: (k, under, sheet_z).
    around: (k, is_sheet, z) of pixels within reach that are no tool."""
    sheet = F.sum(F.col("is_sheet").cast("long"))
    under = (sheet >= share * F.count(F.lit(1))) & (sheet > 0)
    return around.groupBy("k").agg(under.alias("under"), F.when(under, F.percentile(F.when(F.col("is_sheet"), F.col("z")), 0.5)).alias("sheet_z"))


def depth_evidence(frames: DataFrame, tip: DataFrame, away: DataFrame, width: DataFrame, sheet: DataFrame, contact: DataFrame, slack: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """Evidence on a tip's depth by frame (away_max, toward_max, width_only, under), and over frames in contact its
    summaries and the share of frames that a shift of ``slack`` towards the camera would agree with.

    tip: (k, z); away: ``free_space_bound``; width: ``width_only_depth``; sheet: ``under_sheet``; contact: (k).
    """
    e = frames.select("k").distinct().join(tip.select("k", F.col("z").alias("__z")), "k", "left").join(away, "k", "left").join(width.select("k", F.col("z").alias("__w")), "k", "left").join(sheet, "k", "left")
    under = F.coalesce(F.col("under"), F.lit(False))
    e = e.select("k", F.col("away").alias("away_max"), F.when(under, F.col("__z") - F.col("sheet_z")).alias("toward_max"), (F.col("__w") - F.col("__z")).alias("width_only"), under.alias("under"))
    c = e.join(contact.select("k"), "k", "left_semi")
    ok = F.when(F.col("under"), F.coalesce(F.col("toward_max") >= slack, F.lit(False))).otherwise(F.lit(True)) & F.coalesce(F.col("away_max") >= -slack, F.lit(False))
    one = c.agg(F.avg(ok.cast("double")).alias("consistent_share"), F.avg((F.col("away_max") < 0).cast("double")).alias("away_negative_share"), F.sum(F.col("under").cast("long")).cast("double").alias("under_frames"))
    doc = metric_summary(c, ["away_max", "toward_max", "width_only"]).unionByName(metric_summary(one.select(F.lit(0).alias("k"), *one.columns), one.columns))
    return e, doc


def tip_track(tip: DataFrame, target: DataFrame) -> DataFrame:
    """A body's end against its target by frame: depths, distance in space and in the image: (k, z_tip, z_target, d, px).
    Both: (k, x, y, z, u, v, depth)."""
    j = tip.select("k", F.struct("x", "y", "z").alias("p"), F.struct("u", "v", "depth").alias("q")).join(target.select("k", F.struct("x", "y", "z").alias("tp"), F.struct("u", "v", "depth").alias("tq")), "k")
    return j.select("k", F.col("q.depth").alias("z_tip"), F.col("tq.depth").alias("z_target"), G.norm(G.sub(F.col("p"), F.col("tp"))).alias("d"), F.hypot(F.col("q.u") - F.col("tq.u"), F.col("q.v") - F.col("tq.v")).alias("px"))


# ---- across runs and shapes


def hold_out_scores(runs: DataFrame, states: DataFrame, frames: DataFrame, fps: float, dt: float, draw, masks: DataFrame, depth: DataFrame, unknown: DataFrame) -> DataFrame:
    """Iou by run, tissue and frame, worked out again from stored states: (run, tissue, k, iou).

    runs: (run, tissue, steps); states: (run, tissue, step, v, x, y, z). ``draw`` gives the pixels (run, tissue, k, u, v, z)
    of vertices by frame. masks: (tissue, k, u, v); depth and unknown by frame.
    """
    at = runs.crossJoin(F.broadcast(frames.select("k").distinct())).select("run", "tissue", "k", step_of_frame(F.col("k").cast("double"), fps, dt, F.col("steps").cast("long")).alias("step"))
    pixels = draw(at.join(states, ["run", "tissue", "step"]).drop("step"))
    seen = pixels.join(depth.select("k", "u", "v", F.col("z").alias("__d")), ["k", "u", "v"]).where(F.col("z") < F.col("__d") + CUT).select("run", "tissue", "k", "u", "v")
    both = seen.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(runs.select("run", "tissue").join(masks, "tissue").join(frames.select("k").distinct(), "k", "left_semi").select("run", "tissue", "k", "u", "v").withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    both = both.join(unknown.select("k", "u", "v").distinct(), ["k", "u", "v"], "left_anti").groupBy("run", "tissue", "k", "u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    iou = both.groupBy("run", "tissue", "k").agg((F.sum(F.col("a") * F.col("b")) / F.count(F.lit(1))).alias("iou"))
    return at.select("run", "tissue", "k").join(iou, ["run", "tissue", "k"], "left").fillna(0.0, ["iou"])


def shape_study(shapes: DataFrame, mask: DataFrame, depth: DataFrame, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Shapes drawn into one frame (shape, u, v, z) against its mask and depths: (shape, outline_iou, depth_err, and with a
    reference depth (u, v, z) depth_err_reference, n_px); and the depth itself against the reference: error and scale."""
    # a pixel of a shape meets the mask; what only the mask has is a number, the same for all shapes
    size = mask.select("u", "v").distinct().agg(F.count(F.lit(1)).alias("__mask"))
    px = shapes.groupBy("shape", "u", "v").agg(F.min(F.col("z").cast("double")).alias("zm"))
    px = px.join(mask.select("u", "v").distinct().withColumn("real", F.lit(True)), ["u", "v"], "left").join(depth.select("u", "v", F.col("z").alias("zd")), ["u", "v"], "left").crossJoin(F.broadcast(size))
    both = F.coalesce("real", F.lit(False))
    common = F.sum(both.cast("long"))
    cols = [(common / (F.count(F.lit(1)) + F.max("__mask") - common)).alias("outline_iou"), F.percentile(F.when(both, F.abs(F.col("zm") - F.col("zd"))), 0.5).alias("depth_err")]
    if reference is None:
        return px.groupBy("shape").agg(*cols), None
    px = px.join(reference.select("u", "v", F.col("z").alias("zr")), ["u", "v"], "left")
    e = F.when(both, F.abs(F.col("zm") - F.col("zr")))
    own = depth.join(mask, ["u", "v"], "left_semi").join(reference.select("u", "v", F.col("z").alias("__r")), ["u", "v"])
    scale = own.agg(F.percentile(F.abs(F.col("z") - F.col("__r")), 0.5).alias("depth_vs_reference"), F.percentile(F.col("__r") / F.col("z"), 0.5).alias("scale_ratio"))
    return px.groupBy("shape").agg(*cols, F.percentile(e, 0.5).alias("depth_err_reference"), F.count(e).alias("n_px")), scale
