"""Dense kernels per group: small linear algebra, rasterising, skeletons. Arrow-batched NumPy, one group a call.

A group is one frame, one mesh or one object, so its size is that of the thing measured and not of the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

Names = Sequence[str]


def _schema(df: DataFrame, by: Names, extra: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in by] + list(T._parse_datatype_string(extra).fields))


def _grouped(df: DataFrame, by: Names, extra: str, f) -> DataFrame:
    """applyInPandas whose function gives a list of tuples of the extra columns."""
    ship_package(df.sparkSession)
    schema = _schema(df, by, extra)
    names = [x.name for x in schema.fields]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in f(pdf)], columns=names)

    return df.groupBy(*by).applyInPandas(run, schema)


def rigid_motion(a: np.ndarray, b: np.ndarray, scaled: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(R, t, s) with s R a + t nearest to b in least squares; R is a proper rotation."""
    ca, cb = a.mean(0), b.mean(0)
    u, d, vt = np.linalg.svd((b - cb).T @ (a - ca))
    flip = np.diag([1.0] * (a.shape[1] - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    rot = u @ flip @ vt
    s = float((d * np.diag(flip)).sum() / max(((a - ca) ** 2).sum(), 1e-30)) if scaled else 1.0
    return rot, cb - s * rot @ ca, s


def fit_rigid(df: DataFrame, by: Names, a: Names, b: Names, scaled: bool = False) -> DataFrame:
    """Rigid (or similarity) motion from columns a to columns b by key: rotation (by rows), shift, scale, rms, n."""

    def fit(pdf: pd.DataFrame):
        x, y = pdf[list(a)].to_numpy(float), pdf[list(b)].to_numpy(float)
        ok = np.isfinite(x).all(1) & np.isfinite(y).all(1)
        x, y = x[ok], y[ok]
        if len(x) < 3:
            return [(None, None, None, None, len(x))]
        rot, t, s = rigid_motion(x, y, scaled)
        rms = float(np.sqrt((((s * x @ rot.T + t) - y) ** 2).sum(1).mean()))
        return [(rot.ravel().tolist(), t.tolist(), s, rms, len(x))]

    return _grouped(df, by, "rotation array<double>, shift array<double>, scale double, rms double, n long", fit)


def rigid_split(df: DataFrame, by: Names, rest: Names, one: Names, two: Names) -> DataFrame:
    """How much of a motion is rigid: for two shapes the displacement from rest, its rigid part and what is left (means),
    and the angle between the two rotations in degrees."""

    def split(pdf: pd.DataFrame):
        r = pdf[list(rest)].to_numpy(float)
        out, rots = [], []
        for cols in (one, two):
            x = pdf[list(cols)].to_numpy(float)
            rot, t, _ = rigid_motion(r, x)
            moved = r @ rot.T + t
            out += [float(np.linalg.norm(x - r, axis=1).mean()), float(np.linalg.norm(moved - r, axis=1).mean()), float(np.linalg.norm(x - moved, axis=1).mean())]
            rots.append(rot)
        angle = float(np.degrees(np.arccos(np.clip((np.trace(rots[0].T @ rots[1]) - 1) / 2, -1, 1))))
        return [(*out, angle)]

    return _grouped(df, by, "moved_1 double, rigid_1 double, left_1 double, moved_2 double, rigid_2 double, left_2 double, angle double", split)


def common_point(df: DataFrame, by: Names, origin: Names, direction: Names) -> DataFrame:
    """Point nearest to a set of 3D lines, and the mean distance from them."""

    def meet(pdf: pd.DataFrame):
        o, d = pdf[list(origin)].to_numpy(float), pdf[list(direction)].to_numpy(float)
        d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
        m = np.eye(3)[None] - d[:, :, None] * d[:, None, :]
        p = np.linalg.lstsq(m.sum(0), (m @ o[:, :, None]).sum(0)[:, 0], rcond=None)[0]
        return [(*p.tolist(), float(np.linalg.norm((m @ (p - o)[:, :, None])[:, :, 0], axis=1).mean()))]

    return _grouped(df, by, "x double, y double, z double, spread double", meet)


_CORNERS = [f"{c}{x}" for c in "abc" for x in "xyz"]
#: Candidate pixels that a drawing kernel looks at in one step.
STEP = 2_000_000


def _runs(n: np.ndarray) -> np.ndarray:
    """0, 1, … within each of several runs of the given lengths."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _steps(n: np.ndarray) -> np.ndarray:
    """Cuts of a list of items so that each stretch has about STEP candidates."""
    return np.append(np.flatnonzero(np.diff(np.cumsum(n) // STEP, prepend=-1)), len(n))


def rasterize(df: DataFrame, by: Names, width: int, height: int, far: bool = False) -> DataFrame:
    """Nearest triangle at every pixel centre: by, u, v, face, depth, w0, w1, w2; with ``far`` also far_depth, the depth of
    the furthest triangle there.

    Rows are triangles: face, ax, ay, az, bx, … cz in pixels and depth. Of equal depths the smallest face wins. Depth is
    interpolated in 1 / z. Flat triangles and those behind the camera are left out. All triangles of a frame are tested
    together, a bounded number of candidate pixels at a time.
    """

    def draw(pdf: pd.DataFrame):
        pdf = pdf.sort_values("face")
        p, face = pdf[_CORNERS].to_numpy(float).reshape(-1, 3, 3), pdf["face"].to_numpy(np.int64)
        det = (p[:, 1, 0] - p[:, 0, 0]) * (p[:, 2, 1] - p[:, 0, 1]) - (p[:, 2, 0] - p[:, 0, 0]) * (p[:, 1, 1] - p[:, 0, 1])
        lo = np.maximum(np.ceil(p[:, :, :2].min(1)), 0).astype(np.int64)
        hi = np.minimum(np.floor(p[:, :, :2].max(1)), (width - 1, height - 1)).astype(np.int64)
        ok = (det != 0) & (p[:, :, 2] > 0).all(1) & (hi >= lo).all(1)
        p, face, det, lo, size = p[ok], face[ok], det[ok], lo[ok], (hi - lo + 1)[ok]
        depth, last = np.full(width * height, np.inf), np.full(width * height, -np.inf)
        ids, w = np.full(width * height, -1, np.int64), np.zeros((width * height, 3))
        cuts = _steps(size.prod(1))
        for a, b in zip(cuts, cuts[1:]):
            n = size[a:b].prod(1)
            t = np.repeat(np.arange(a, b), n)
            at = _runs(n)
            u, v = lo[t, 0] + at % size[t, 0], lo[t, 1] + at // size[t, 0]
            w1 = ((u - p[t, 0, 0]) * (p[t, 2, 1] - p[t, 0, 1]) - (p[t, 2, 0] - p[t, 0, 0]) * (v - p[t, 0, 1])) / det[t]
            w2 = ((p[t, 1, 0] - p[t, 0, 0]) * (v - p[t, 0, 1]) - (u - p[t, 0, 0]) * (p[t, 1, 1] - p[t, 0, 1])) / det[t]
            bary = np.stack((1 - w1 - w2, w1, w2), -1)
            inside = (bary >= 0).all(1)
            t, bary, px = t[inside], bary[inside], (v * width + u)[inside]
            z = 1.0 / (bary / p[t, :, 2]).sum(1)
            np.maximum.at(last, px, z)
            order = np.lexsort((t, z, px))
            px, z, t, bary = px[order], z[order], t[order], bary[order]
            first = np.concatenate(([True], px[1:] != px[:-1])) if len(px) else np.zeros(0, bool)
            win = first & (z < depth[px])  # triangles come in order of face, so an equal depth changes nothing
            depth[px[win]], ids[px[win]], w[px[win]] = z[win], face[t[win]], bary[win]
        return [(int(i % width), int(i // width), int(ids[i]), float(depth[i]), *w[i].tolist(), *([float(last[i])] if far else [])) for i in np.flatnonzero(ids >= 0)]

    return _grouped(df, by, "u int, v int, face long, depth double, w0 double, w1 double, w2 double" + (", far_depth double" if far else ""), draw)


def paint(df: DataFrame, by: Names, width: int, height: int) -> DataFrame:
    """Painter's drawing with one depth a face: by, u, v, face, z. Rows are triangles as in ``rasterize``.

    Faces are drawn from far to near by the mean depth of their corners, each over what was there; of equals the smallest
    face lies on top. Corners are cut to whole pixels; a face covers its outline, drawn step by step along the longer side
    of each edge, and all between on every line. Faces with a corner behind the camera are left out.
    """

    def draw(pdf: pd.DataFrame):
        p, face = pdf[_CORNERS].to_numpy(float).reshape(-1, 3, 3), pdf["face"].to_numpy(np.int64)
        z, ok = p[:, :, 2].mean(1), (p[:, :, 2] > 0).all(1)
        p, face, z = np.trunc(p[ok][:, :, :2]).astype(np.int64), face[ok], z[ok]
        out = (p.max(1) < 0).any(1) | (p[:, :, 0].min(1) >= width) | (p[:, :, 1].min(1) >= height)
        p, face, z = p[~out], face[~out], z[~out]
        if not len(face):
            return []
        a, d = p[:, [0, 1, 2]].reshape(-1, 2), (p[:, [1, 2, 0]] - p[:, [0, 1, 2]]).reshape(-1, 2)
        of, n = np.repeat(np.arange(len(face)), 3), np.abs(d).max(1) + 1
        e = np.repeat(np.arange(len(of)), n)
        share = _runs(n) / np.maximum(n[e] - 1, 1)
        x, y = (np.floor(a[e, i] + share * d[e, i] + 0.5).astype(np.int64) for i in (0, 1))
        key = of[e] * (height + 2) + np.clip(y, -1, height) + 1
        order = np.argsort(key, kind="stable")
        key, x = key[order], x[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        f, line = key[first] // (height + 2), key[first] % (height + 2) - 1
        left, right = np.maximum(np.minimum.reduceat(x, first), 0), np.minimum(np.maximum.reduceat(x, first), width - 1)
        keep = (line >= 0) & (line < height) & (left <= right)
        f, line, left, right = f[keep], line[keep], left[keep], right[keep]
        top, best = np.full(width * height, np.inf), np.full(width * height, -1, np.int64)
        by_depth = np.lexsort((face[f], z[f]))  # near to far, so what is there stays
        f, line, left, right = f[by_depth], line[by_depth], left[by_depth], right[by_depth]
        cuts = _steps(right - left + 1)
        for lo, hi in zip(cuts, cuts[1:]):
            n = right[lo:hi] - left[lo:hi] + 1
            r = np.repeat(np.arange(lo, hi), n)
            px, one = np.unique(line[r] * width + left[r] + _runs(n), return_index=True)
            new = best[px] < 0
            best[px[new]], top[px[new]] = face[f[r[one[new]]]], z[f[r[one[new]]]]
        return [(int(i % width), int(i // width), int(best[i]), float(top[i])) for i in np.flatnonzero(best >= 0)]

    return _grouped(df, by, "u int, v int, face long, z double", draw)


def composite(*layers: DataFrame, by: Names = ("k",)) -> DataFrame:
    """Several drawn surfaces (by, u, v, face, z) in one: the nearest wins, of equals the first: by, u, v, z, layer, face, id;
    ``id`` packs layer and face (layer * 2**32 + face)."""
    every = None
    for i, layer in enumerate(layers):
        part = layer.select(*by, "u", "v", F.struct("z", F.lit(i).cast("long").alias("layer"), F.col("face").cast("long").alias("face")).alias("__b"))
        every = part if every is None else every.unionByName(part)
    g = every.groupBy(*by, "u", "v").agg(F.min("__b").alias("__b"))
    return g.select(*by, "u", "v", "__b.z", "__b.layer", "__b.face", (F.shiftleft("__b.layer", 32) + F.col("__b.face")).alias("id"))


def structural_similarity(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, top: float = 255.0) -> float:
    """SSIM with an 11-tap Gaussian window, mean over the image."""
    r = np.arange(-5, 6)
    g = np.exp(-0.5 * (r / sigma) ** 2)
    g /= g.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            pad = [(0, 0)] * 2
            pad[axis] = (5, 5)
            y = np.pad(x, pad, mode="reflect")
            x = sum(w * np.take(y, np.arange(k, k + x.shape[axis]), axis) for k, w in enumerate(g))
        return x

    a, b = a.astype(float), b.astype(float)
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def image_similarity(df: DataFrame, by: Names, width: int, height: int) -> DataFrame:
    """SSIM and mean squared error of two images given as pixels (u, v, a, b)."""

    def both(pdf: pd.DataFrame):
        x, y = np.zeros((height, width)), np.zeros((height, width))
        x[pdf["v"], pdf["u"]], y[pdf["v"], pdf["u"]] = pdf["a"], pdf["b"]
        return [(structural_similarity(x, y), float(((x - y) ** 2).mean()))]

    return _grouped(df, by, "ssim double, mse double", both)


def longest_path(df: DataFrame, by: Names) -> DataFrame:
    """Longest shortest path through skeleton pixels (u, v), by two breadth-first searches: by, i, u, v."""

    def walk(pdf: pd.DataFrame):
        px = set(zip(pdf["u"].astype(int), pdf["v"].astype(int)))
        if not px:
            return []

        def far(start):
            seen, queue = {start: None}, [start]
            for p in queue:
                for d in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)):
                    q = (p[0] + d[0], p[1] + d[1])
                    if q in px and q not in seen:
                        seen[q] = p
                        queue.append(q)
            return queue[-1], seen

        end, _ = far(min(px))
        p, back = far(end)
        path = []
        while p is not None:
            path.append(p)
            p = back[p]
        return [(i, u, v) for i, (u, v) in enumerate(path)]

    return _grouped(df, by, "i int, u int, v int", walk)


def surface_samples(df: DataFrame, by: Names, n: int, seed: int = 0) -> DataFrame:
    """n points on triangles (ax … cz), chosen by area with a seeded generator: by, i, x, y, z, nx, ny, nz."""

    def sample(pdf: pd.DataFrame):
        p = pdf[[f"{c}{x}" for c in "abc" for x in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
        nrm = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        area = np.linalg.norm(nrm, axis=1)
        rng = np.random.default_rng(seed)
        f = rng.choice(len(p), n, p=area / area.sum())
        a, b = rng.random((2, n))
        over = a + b > 1
        a[over], b[over] = 1 - a[over], 1 - b[over]
        x = p[f, 0] + a[:, None] * (p[f, 1] - p[f, 0]) + b[:, None] * (p[f, 2] - p[f, 0])
        m = nrm[f] / np.maximum(area[f], 1e-12)[:, None]
        return [(i, *x[i].tolist(), *m[i].tolist()) for i in range(n)]

    return _grouped(df, by, "i int, x double, y double, z double, nx double, ny double, nz double", sample)


class CellIndex:
    """Points in a hash of grid cells; nearest points are found by growing rings of cells, exactly."""

    def __init__(self, points: np.ndarray, per_cell: float = 2.0):
        self.points = points
        self.low = points.min(0)
        span = np.maximum(points.max(0) - self.low, 1e-12)
        self.size = float((span.prod() * per_cell / len(points)) ** (1 / points.shape[1])) or 1.0
        self.size = max(self.size, float(span.max()) / 512)
        cell = np.floor((points - self.low) / self.size).astype(np.int64)
        self.shape = cell.max(0) + 1
        flat = self._flat(cell)
        self.order = np.argsort(flat, kind="stable")
        self.keys, self.start = np.unique(flat[self.order], return_index=True)
        self.stop = np.append(self.start[1:], len(flat))

    def _flat(self, cell: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for i in range(cell.shape[1]):
            out = out * (self.shape[i] + 2) + cell[:, i]
        return out

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest point, squared distance) of each query; of equals the smallest index."""
        at = np.clip(np.floor((queries - self.low) / self.size).astype(np.int64), 0, self.shape - 1)
        best, d2 = np.full(len(queries), -1, np.int64), np.full(len(queries), np.inf)
        # a query outside the box is at least so far from every cell
        gap = np.sqrt((np.maximum(np.maximum(self.low - queries, queries - (self.low + self.shape * self.size)), 0) ** 2).sum(1))
        live, ring = np.arange(len(queries)), 0
        while len(live):
            span = np.arange(-ring, ring + 1)
            shell = np.stack(np.meshgrid(*[span] * queries.shape[1], indexing="ij"), -1).reshape(-1, queries.shape[1])
            shell = shell[np.abs(shell).max(1) == ring]
            for off in shell:
                cell = at[live] + off
                ok = ((cell >= 0) & (cell < self.shape)).all(1)
                key = np.searchsorted(self.keys, self._flat(cell[ok]))
                hit = (key < len(self.keys)) & (self.keys[np.minimum(key, len(self.keys) - 1)] == self._flat(cell[ok]))
                who, key = live[ok][hit], key[hit]
                n = self.stop[key] - self.start[key]
                q = np.repeat(who, n)
                p = self.order[np.repeat(self.start[key], n) + _runs(n)]
                d = ((queries[q] - self.points[p]) ** 2).sum(1)
                o = np.lexsort((p, d, q))
                q, p, d = q[o], p[o], d[o]
                one = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
                q, p, d = q[one], p[one], d[one]
                win = (d < d2[q]) | ((d == d2[q]) & (p < best[q]))
                best[q[win]], d2[q[win]] = p[win], d[win]
            # cells of the next ring are at least ``ring`` cells away from the query's own cell's border
            live = live[~(np.sqrt(d2[live]) < np.maximum(ring * self.size, gap[live]))]
            ring += 1
            if ring > int(self.shape.max()) + 1:
                break
        return best, d2


def signed_distance(points: DataFrame, samples: DataFrame, by: str) -> DataFrame:
    """Distance of points (id, x, y, z) from surface samples with normals; positive outside. by, id, d (null without samples).

    Samples of a surface are put into grid cells, so a point meets only those around it.
    """
    ship_package(points.sparkSession)

    def near(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, s, m = left[["x", "y", "z"]].to_numpy(float), right[["x", "y", "z"]].to_numpy(float), right[["nx", "ny", "nz"]].to_numpy(float)
        out = np.full(len(p), np.nan)
        if len(s) and len(p):
            k, d2 = CellIndex(s).nearest(p)
            out = np.sqrt(d2) * np.where(((p - s[k]) * m[k]).sum(1) >= 0, 1.0, -1.0)
        return pd.DataFrame({by: left[by], "id": left["id"], "d": out})

    kind = points.schema[by].dataType.simpleString()
    return points.groupBy(by).cogroup(samples.groupBy(by)).applyInPandas(near, f"{by} {kind}, id long, d double")


def triangle_distances(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Exact distance of each point from the triangle beside it (arrays of the same length)."""
    a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
    n = np.cross(b - a, c - a)
    nn = (n * n).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = p - n * (((p - a) * n).sum(1) / nn)[:, None]
        inside = nn > 0
        for s, e in ((a, b), (b, c), (c, a)):
            inside &= (np.cross(e - s, q - s) * n).sum(1) >= 0
    edge = np.full(len(p), np.inf)
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        t = np.clip(((p - s) * d).sum(1) / np.maximum((d * d).sum(1), 1e-18), 0, 1)
        edge = np.minimum(edge, np.linalg.norm(p - s - t[:, None] * d, axis=1))
    return np.where(inside, np.linalg.norm(p - np.where(inside[:, None], q, 0.0), axis=1), edge)


def nearest_on_triangles(p: np.ndarray, tri: np.ndarray) -> tuple[float, int]:
    """(distance, index) of the closest triangle to a point, exact; the first of equals."""
    d = triangle_distances(np.broadcast_to(p, (len(tri), 3)), tri)
    i = int(d.argmin())
    return float(d[i]), i


def mesh_distances(points: DataFrame, faces: DataFrame, by: Names) -> DataFrame:
    """Exact distance of points (by, id, x, y, z) from the mesh (by, face, ax, … cz) of their group: by, id, d, face; of equals
    the smallest face. Triangles' centres and radii rule most of them out before any exact test."""
    ship_package(points.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def near(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*by, "id", "d", "face"]).astype({"id": "int64", "d": float, "face": "int64"})
        right = right.sort_values("face")
        p, tri = left[["x", "y", "z"]].to_numpy(float), right[_CORNERS].to_numpy(float).reshape(-1, 3, 3)
        mid = tri.mean(1)
        reach = np.linalg.norm(tri - mid[:, None], axis=2).max(1)
        d, at = np.empty(len(p)), np.empty(len(p), np.int64)
        step = max(1, STEP // len(tri))
        for lo in range(0, len(p), step):
            part = p[lo : lo + step]
            far = np.sqrt(np.maximum((part**2).sum(1)[:, None] + (mid**2).sum(1) - 2 * part @ mid.T, 0))
            q, t = np.nonzero(far - reach <= (far + reach).min(1)[:, None] + 1e-9)
            e = triangle_distances(part[q], tri[t])
            order = np.lexsort((t, e, q))
            first = np.searchsorted(q[order], np.arange(len(part)))
            d[lo : lo + step], at[lo : lo + step] = e[order][first], t[order][first]
        out = {b: left[b].to_numpy() for b in by}
        return pd.DataFrame({**out, "id": left["id"].to_numpy(np.int64), "d": d, "face": right["face"].to_numpy(np.int64)[at]})

    return points.groupBy(*by).cogroup(faces.groupBy(*by)).applyInPandas(near, ", ".join(f"{b} {kinds[b]}" for b in by) + ", id long, d double, face long")


def solid_angles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Sum over triangles (t, 3, 3) of the signed solid angle that each is seen under from each point, in full turns."""
    a, b, c = (tri[None, :, i] - p[:, None] for i in range(3))
    la, lb, lc = (np.linalg.norm(x, axis=2) for x in (a, b, c))
    top = (a * np.cross(b, c)).sum(2)
    low = la * lb * lc + (a * b).sum(2) * lc + (b * c).sum(2) * la + (c * a).sum(2) * lb
    return np.arctan2(top, low).sum(1) / (2 * np.pi)


def mesh_contains(points: DataFrame, faces: DataFrame, by: Names) -> DataFrame:
    """Whether points (by, id, x, y, z) lie inside the closed mesh (by, face, ax, … cz) of their group: by, id, inside. A bounded
    number of point-triangle pairs is in memory at a time."""
    ship_package(points.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def turns(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, tri = left[["x", "y", "z"]].to_numpy(float), right[_CORNERS].to_numpy(float).reshape(-1, 3, 3)
        inside = np.zeros(len(p), bool)
        step = max(1, STEP // (12 * max(len(tri), 1)))
        for lo in range(0, len(p), step):
            inside[lo : lo + step] = np.abs(solid_angles(p[lo : lo + step], tri)) > 0.5
        return pd.DataFrame({**{b: left[b].to_numpy() for b in by}, "id": left["id"].to_numpy(np.int64), "inside": inside})

    return points.groupBy(*by).cogroup(faces.groupBy(*by)).applyInPandas(turns, ", ".join(f"{b} {kinds[b]}" for b in by) + ", id long, inside boolean")


def mesh_hits(rays: DataFrame, faces: DataFrame, by: Names) -> DataFrame:
    """First triangle of the group's mesh (by, face, ax, … cz) that each ray (by, ray, ox, oy, oz, dx, dy, dz) meets: by, ray,
    t, face; no row where none is met. Triangles' bounding spheres rule most pairs out; a bounded number is tested at a
    time, so rays and faces are never multiplied into rows."""
    ship_package(rays.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rays.schema.fields}

    def first(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "ray", "t", "face"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names).astype({"ray": "int64", "t": float, "face": "int64"})
        right = right.sort_values("face")
        o, d = left[["ox", "oy", "oz"]].to_numpy(float), left[["dx", "dy", "dz"]].to_numpy(float)
        tri, face = right[_CORNERS].to_numpy(float).reshape(-1, 3, 3), right["face"].to_numpy(np.int64)
        mid = tri.mean(1)
        reach = np.linalg.norm(tri - mid[:, None], axis=2).max(1) * (1 + 1e-6) + 1e-12
        unit = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-18)
        rows, step = [], max(1, STEP // len(tri))
        for lo in range(0, len(o), step):
            off = mid[None] - o[lo : lo + step, None]
            along = (off * unit[lo : lo + step, None]).sum(2)
            apart = np.sqrt(np.maximum((off**2).sum(2) - along**2, 0))
            r, t = np.nonzero(apart <= reach)
            oo, dd, p = o[lo + r], d[lo + r], tri[t]
            e1, e2 = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
            h = np.cross(dd, e2)
            det = (e1 * h).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = oo - p[:, 0]
                u, q = (s * h).sum(1) / det, np.cross(s, e1)
                v, at = (dd * q).sum(1) / det, (e2 * q).sum(1) / det
            ok = (np.abs(det) > 1e-15) & (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & (at > 0)
            r, t, at = r[ok], t[ok], at[ok]
            order = np.lexsort((t, at, r))
            r, t, at = r[order], t[order], at[order]
            one = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
            rows.append((lo + r[one], at[one], face[t[one]]))
        i, t, f = (np.concatenate(x) for x in zip(*rows))
        return pd.DataFrame({**{b: left[b].to_numpy()[i] for b in by}, "ray": left["ray"].to_numpy(np.int64)[i], "t": t, "face": f})[names]

    return rays.groupBy(*by).cogroup(faces.groupBy(*by)).applyInPandas(first, ", ".join(f"{b} {kinds[b]}" for b in by) + ", ray long, t double, face long")


def ray_hits(df: DataFrame, by: Names) -> DataFrame:
    """First triangle that each ray meets. Rows: ray, ox … dz and triangles face, ax … cz, crossed by the caller in
    blocks; gives by, t, face with the least positive t, of equals the smallest face; no row where none is met."""

    def first(pdf: pd.DataFrame):
        o, d = pdf[["ox", "oy", "oz"]].to_numpy(float), pdf[["dx", "dy", "dz"]].to_numpy(float)
        p = pdf[[f"{c}{x}" for c in "abc" for x in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
        e1, e2 = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
        h = np.cross(d, e2)
        det = (e1 * h).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = o - p[:, 0]
            u = (s * h).sum(1) / det
            q = np.cross(s, e1)
            v = (d * q).sum(1) / det
            t = (e2 * q).sum(1) / det
        ok = (np.abs(det) > 1e-15) & (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & (t > 0)
        hits = sorted(zip(t[ok], pdf["face"].to_numpy()[ok]))
        return [(float(hits[0][0]), int(hits[0][1]))] if hits else []

    return _grouped(df, by, "t double, face long", first)


class _Grid:
    """Cells (x, y) of a domain as numbers, with the four-neighbour Laplacian as index lists."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.width = int(y.max() - y.min()) + 3
        key = (x - x.min() + 1) * self.width + (y - y.min() + 1)
        self.order = np.argsort(key)
        self.key = key[self.order]
        links = []
        for step in (1, self.width):
            at = np.searchsorted(self.key, self.key + step)
            ok = (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == self.key + step)
            links.append(np.stack((np.flatnonzero(ok), at[ok])))
        self.a, self.b = np.concatenate(links, 1)
        self.degree = np.bincount(np.concatenate((self.a, self.b)), minlength=len(key)).astype(float)

    def laplacian(self, z: np.ndarray) -> np.ndarray:
        n = len(z)
        return self.degree * z - np.bincount(self.a, weights=z[self.b], minlength=n) - np.bincount(self.b, weights=z[self.a], minlength=n)


def _conjugate(apply, rhs: np.ndarray, start: np.ndarray, tol: float) -> np.ndarray:
    """Conjugate gradients for a symmetric positive (semi)definite operator; an error where they do not settle."""
    x = start.copy()
    r = rhs - apply(x)
    p, rr = r.copy(), float(r @ r)
    goal = tol * tol * max(float(rhs @ rhs), 1e-30)
    for _ in range(20 * len(x) + 100):
        if rr <= goal:
            return x
        q = apply(p)
        step = rr / max(float(p @ q), 1e-300)
        x += step * p
        r -= step * q
        new = float(r @ r)
        p, rr = r + (new / rr) * p, new
    raise RuntimeError("the height field did not settle")


def harmonic_fill(df: DataFrame, by: Names, biharmonic: bool = False, lower: bool = False, tol: float = 1e-10, rounds: int = 3) -> DataFrame:
    """Missing cells (x, y, z null) filled smoothly from the known ones: each the mean of its four-neighbours in the domain
    (or, ``biharmonic``, with the least squared Laplacian): by, x, y, z; null where a group has no known cell.

    With ``lower`` (a column, null where open) filled cells below their bound are put on it and the rest is filled again,
    ``rounds`` times at most, as the bound is a plausibility and not a constraint.
    """

    def fill(pdf: pd.DataFrame):
        x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
        grid = _Grid(x, y)
        z = pdf["z"].to_numpy(float)[grid.order]
        bound = pdf["lower"].to_numpy(float)[grid.order] if lower else None
        known = np.isfinite(z)
        out = np.full(len(z), np.nan)
        if known.any():
            out = np.where(known, z, z[known].mean())
            apply = (lambda v: grid.laplacian(grid.laplacian(v))) if biharmonic else grid.laplacian
            for _ in range(rounds if lower else 1):
                free = np.flatnonzero(~known)
                if not len(free):
                    break
                base = np.where(known, out, 0.0)

                def inner(v, free=free):
                    full = np.zeros(len(out))
                    full[free] = v
                    return apply(full)[free]

                out[free] = _conjugate(inner, -apply(base)[free], out[free], tol)
                if bound is None:
                    break
                low = ~known & np.isfinite(bound) & (out < bound)
                if not low.any():
                    break
                out[low] = bound[low]
                known = known | low
        return [(int(x[i]), int(y[i]), None if np.isnan(v) else float(v)) for i, v in zip(grid.order, out)]

    return _grouped(df, by, "x int, y int, z double", fill)


def smooth_surface(df: DataFrame, by: Names, grad: float, bend: float, lower: bool = False, tol: float = 1e-10, rounds: int = 4) -> DataFrame:
    """Height field of least sum w (f - z)^2 + grad |gradient f|^2 + bend |Laplacian f|^2 over the cells (x, y, z, w): by, x, y, z.

    Cells of weight 0 (or without z) are filled. With ``lower`` cells below their bound are pulled to just above it with a
    weight of at least 20, ``rounds`` times at most.
    """

    def fit(pdf: pd.DataFrame):
        x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
        grid = _Grid(x, y)
        z, w = pdf["z"].to_numpy(float)[grid.order], np.nan_to_num(pdf["w"].to_numpy(float)[grid.order])
        w = np.where(np.isfinite(z), w, 0.0)
        d = np.where(w > 0, np.nan_to_num(z), 0.0)
        bound = pdf["lower"].to_numpy(float)[grid.order] if lower else None
        if not (w > 0).any():
            return [(int(x[i]), int(y[i]), None) for i in grid.order]
        out = np.full(len(z), float(d[w > 0].mean()))
        for _ in range(rounds if lower else 1):

            def apply(v, w=w):
                lap = grid.laplacian(v)
                return w * v + grad * lap + bend * grid.laplacian(lap)

            out = _conjugate(apply, w * d, out, tol)
            if bound is None:
                break
            low = np.isfinite(bound) & (out < bound - 1e-4)
            if not low.any():
                break
            d, w = np.where(low, bound + 5e-4, d), np.where(low, np.maximum(w, 20.0), w)
        return [(int(x[i]), int(y[i]), float(v)) for i, v in zip(grid.order, out)]

    return _grouped(df, by, "x int, y int, z double", fit)


def _on_mesh(vertices: DataFrame, edges: DataFrame, by: Names, extra: str, f) -> DataFrame:
    """``_grouped`` with the edges (a, b) of one mesh beside every group: ``f`` gets the group's rows in order of v, and the
    places of the edges' ends in them. Edges travel to the groups as rows; none comes to the driver."""
    ship_package(vertices.sparkSession)
    schema = _schema(vertices, by, extra)
    names = [x.name for x in schema.fields]
    everywhere = vertices.select(*[F.col(c).alias(c) for c in by]).distinct().crossJoin(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("v")
        v = left["v"].to_numpy(np.int64)
        right = right[right["a"].isin(v) & right["b"].isin(v)]
        ends = (np.searchsorted(v, right[c].to_numpy(np.int64)) for c in "ab")
        return pd.DataFrame([(*key, *row) for row in (f(left, *ends) if len(left) else [])], columns=names)

    return vertices.groupBy(*by).cogroup(everywhere.groupBy(*by)).applyInPandas(run, schema)


def laplacian_offsets(vertices: DataFrame, edges: DataFrame, by: Names, smooth: float = 2.0) -> DataFrame:
    """Offsets of mesh vertices (by, v, w, target, fixed) along their rays: least sum w (o - target)^2 + smooth * o L o with
    fixed vertices at 0: by, v, offset. edges: (a, b), the same mesh in every group."""

    def solve(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray):
        v, w, t = pdf["v"].to_numpy(np.int64), pdf["w"].to_numpy(float), np.nan_to_num(pdf["target"].to_numpy(float))
        free = ~pdf["fixed"].to_numpy(bool)
        degree = np.bincount(np.concatenate((a, b)), minlength=len(v))

        def apply(o):
            full = np.zeros(len(v))
            full[free] = o
            lap = degree * full - np.bincount(a, weights=full[b], minlength=len(v)) - np.bincount(b, weights=full[a], minlength=len(v))
            return (w * full + smooth * lap)[free]

        out = np.zeros(len(v))
        if free.any():
            out[free] = _conjugate(apply, (w * t)[free], np.zeros(int(free.sum())), 1e-12)
        return [(int(i), float(o)) for i, o in zip(v, out)]

    return _on_mesh(vertices, edges, by, "v long, offset double", solve)


def parallel_frames(df: DataFrame, by: Names) -> DataFrame:
    """Normals carried along a polyline (node, x, y, z) without twist: by, node, nx, ny, nz."""

    def carry(pdf: pd.DataFrame):
        pdf = pdf.sort_values("node")
        c = pdf[["x", "y", "z"]].to_numpy(float)
        t = np.gradient(c, axis=0) if len(c) > 1 else np.array([[0.0, 0.0, 1.0]])
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        n = np.cross(t[0], [0.0, 0.0, 1.0] if abs(t[0][2]) < 0.9 else [1.0, 0.0, 0.0])
        out = []
        for node, tan in zip(pdf["node"], t):
            n = n - tan * (n @ tan)
            n /= max(np.linalg.norm(n), 1e-12)
            out.append((int(node), *n.tolist()))
        return out

    return _grouped(df, by, "node long, nx double, ny double, nz double", carry)


def follow_blob(df: DataFrame, by: Names, start: tuple[float, float], reach: float = 120.0, least: float = 150.0) -> DataFrame:
    """Per frame k the blob (u, v, area) of enough area nearest to the last one within reach; frames without are left out."""

    def follow(pdf: pd.DataFrame):
        at, out = np.array(start, float), []
        for k, g in pdf.sort_values("k").groupby("k"):
            g = g[g["area"] >= least]
            if len(g):
                d = np.hypot(g["u"] - at[0], g["v"] - at[1]).to_numpy()
                if d.min() <= reach:
                    r = g.iloc[int(d.argmin())]
                    at = np.array([r["u"], r["v"]])
                    out.append((int(k), float(r["u"]), float(r["v"])))
        return out

    return _grouped(df, by, "k int, u double, v double", follow)


def repair_manifold(df: DataFrame, by: Names) -> DataFrame:
    """Tetrahedra (t, a, b, c, d, quality) without those that make an edge of the boundary shared by more than two
    boundary faces: the worst offender goes first, until none is left: by, t. Each round takes one away, so it ends."""

    def repair(pdf: pd.DataFrame):
        tets = {int(r.t): (r.a, r.b, r.c, r.d) for r in pdf.itertuples()}
        quality = dict(zip(pdf["t"].astype(int), pdf["quality"]))
        while True:
            owner: dict[tuple, list[int]] = {}
            for t, (a, b, c, d) in tets.items():
                for f in ((b, c, d), (a, c, d), (a, b, d), (a, b, c)):
                    owner.setdefault(tuple(sorted(f)), []).append(t)
            edges: dict[tuple, list[int]] = {}
            for f, ts in owner.items():
                if len(ts) == 1:
                    for e in ((f[0], f[1]), (f[1], f[2]), (f[0], f[2])):
                        edges.setdefault(e, []).append(ts[0])
            bad = [(quality[t], t) for ts in edges.values() if len(ts) > 2 for t in ts]
            if not bad:
                break
            heapq.heapify(bad)
            tets.pop(heapq.heappop(bad)[1])
        return [(t,) for t in sorted(tets)]

    return _grouped(df, by, "t long", repair)
