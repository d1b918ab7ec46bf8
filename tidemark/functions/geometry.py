"""Vector and camera arithmetic as column expressions. A vector is a struct (x, y, z); a matrix is nine numbers by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip


def vec(x, y, z) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, s: Column) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    return scale(a, 1.0 / F.greatest(norm(a), F.lit(least)))


def apply(m: Column, a: Column) -> Column:
    """Matrix times vector."""
    row = lambda i: m[3 * i] * a["x"] + m[3 * i + 1] * a["y"] + m[3 * i + 2] * a["z"]
    return vec(row(0), row(1), row(2))


def apply_transposed(m: Column, a: Column) -> Column:
    col = lambda i: m[i] * a["x"] + m[3 + i] * a["y"] + m[6 + i] * a["z"]
    return vec(col(0), col(1), col(2))


def rotation(axis: Column, angle: Column) -> Column:
    """Rotation matrix about a unit axis (Rodrigues), nine numbers by rows."""
    c, s = F.cos(angle), F.sin(angle)
    t = 1.0 - c
    x, y, z = axis["x"], axis["y"], axis["z"]
    return F.array(
        t * x * x + c, t * x * y - s * z, t * x * z + s * y,
        t * x * y + s * z, t * y * y + c, t * y * z - s * x,
        t * x * z - s * y, t * y * z + s * x, t * z * z + c,
    )


def rotation_vector(r: Column) -> Column:
    """Rotation matrix of a rotation vector; the zero vector turns nothing."""
    return rotation(unit(r), norm(r))


def rotation_degrees(m: Column) -> Column:
    """Angle of a rotation matrix from its trace."""
    return F.degrees(F.acos(clip((m[0] + m[4] + m[8] - 1.0) / 2.0, -1.0, 1.0)))


def field_of_view(focal: Column, height: Column) -> Column:
    return F.degrees(2.0 * F.atan(height / 2.0 / focal))


def project(p: Column, rot: Column, focal: Column, pos: Column, cx: Column, cy: Column) -> Column:
    """World point to (u, v, depth): rotate into the camera, divide by depth. ``pos`` null is the origin."""
    q = apply(rot, vec(p["x"] - F.coalesce(pos["x"], F.lit(0.0)), p["y"] - F.coalesce(pos["y"], F.lit(0.0)), p["z"] - F.coalesce(pos["z"], F.lit(0.0))))
    return F.struct((cx + focal * q["x"] / q["z"]).alias("u"), (cy + focal * q["y"] / q["z"]).alias("v"), q["z"].alias("depth"))


def unproject(u: Column, v: Column, depth: Column, rot: Column, focal: Column, pos: Column, cx: Column, cy: Column) -> Column:
    """Pixel and depth to the world point: the inverse of :func:`project`."""
    q = vec((u - cx) / focal * depth, (v - cy) / focal * depth, depth)
    w = apply_transposed(rot, q)
    return vec(w["x"] + F.coalesce(pos["x"], F.lit(0.0)), w["y"] + F.coalesce(pos["y"], F.lit(0.0)), w["z"] + F.coalesce(pos["z"], F.lit(0.0)))


def inside_image(u: Column, v: Column, width: Column, height: Column) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


def border_distance(u: Column, v: Column, width: Column, height: Column) -> Column:
    return F.least(u, width - 1 - u, v, height - 1 - v)


def faces_viewer(normal: Column, view: Column) -> Column:
    return dot(normal, view) < 0


def visible(z: Column, depth: Column, cut: float = 0.006) -> Column:
    """A drawn point is seen unless the measured depth is nearer by ``cut`` or more."""
    return z < depth + F.lit(cut)


def shaft_direction(yaw: Column, pitch: Column, heading: Column) -> Column:
    """Unit direction of a straight shaft: along y at zero, pitched downwards, turned about z by heading + yaw."""
    a = heading + yaw
    return vec(-F.sin(a) * F.cos(pitch), F.cos(a) * F.cos(pitch), -F.sin(pitch))


def shaft_tip(port: Column, yaw: Column, pitch: Column, insertion: Column, heading: Column, offset: float = 0.0) -> Column:
    """Forward kinematics: the port plus insertion and tool offset along the shaft."""
    return add(port, scale(shaft_direction(yaw, pitch, heading), insertion + F.lit(offset)))


def shaft_joints(port: Column, tip: Column, heading: Column, reach: float | None = None, offset: float = 0.0) -> Column:
    """Inverse kinematics: (yaw, pitch, insertion); null beyond ``reach``."""
    d = sub(tip, port)
    length = norm(d)
    x, y = d["x"] * F.cos(heading) + d["y"] * F.sin(heading), d["y"] * F.cos(heading) - d["x"] * F.sin(heading)
    out = F.struct(F.atan2(-x, y).alias("yaw"), F.asin(clip(-d["z"] / F.greatest(length, F.lit(1e-12)), -1.0, 1.0)).alias("pitch"), (length - F.lit(offset)).alias("insertion"))
    return out if reach is None else F.when(length <= F.lit(reach), out)


def checked_joints(joints: Column, bounds: dict[str, tuple[float, float]], slack: dict[str, float]) -> Column:
    """Joints kept within bounds; an error where one is outside by more than its slack, as the tip cannot be reached then."""
    far = F.lit(False)
    for name, (lo, hi) in bounds.items():
        far = far | (joints[name] < lo - slack.get(name, 0.0)) | (joints[name] > hi + slack.get(name, 0.0))
    kept = F.struct(*[clip(joints[n], *bounds[n]).alias(n) if n in bounds else joints[n].alias(n) for n in ("yaw", "pitch", "insertion")])
    return F.when(far, F.raise_error(F.lit("the tip is out of reach")).cast("struct<yaw:double,pitch:double,insertion:double>")).otherwise(kept)


def heading(port: Column, target: Column) -> Column:
    """Turn about z that points a shaft's zero direction at a (mean) target."""
    d = sub(target, port)
    return F.atan2(-d["x"], d["y"])


def pose_position(pos: Column, fixed: Column) -> Column:
    """Where the camera is: its own position, or the fixed one where a clip has none."""
    return F.coalesce(pos, fixed)


def canvas_uv(u: Column, v: Column, margin: int, width: int, height: int) -> Column:
    """Texture place (0 to 1) of an image point in a canvas that reaches ``margin`` pixels beyond the image on every side."""
    return F.struct(((u + margin) / F.lit(float(width + 2 * margin))).alias("u"), ((v + margin) / F.lit(float(height + 2 * margin))).alias("v"))


def silhouette_thickness(distance: Column, half_width: Column, z: Column, focal: Column, low: float = 0.002, high: float = 0.03) -> Column:
    """Thickness of a body seen in outline as if it were round: 2 sqrt(R^2 - (R - d)^2) pixels at depth z, limited."""
    chord = 2.0 * F.sqrt(F.greatest(half_width * half_width - (half_width - distance) * (half_width - distance), F.lit(0.0)))
    return clip(chord * z / focal, low, high)


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2.0


def triangle_min_angle(a: Column, b: Column, c: Column) -> Column:
    """Smallest interior angle in degrees."""

    def angle(p: Column, q: Column, r: Column) -> Column:
        u, v = sub(q, p), sub(r, p)
        return F.degrees(F.acos(clip(dot(u, v) / F.greatest(norm(u) * norm(v), F.lit(1e-18)), -1.0, 1.0)))

    return F.least(angle(a, b, c), angle(b, c, a), angle(c, a, b))


def tet_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed volume of a tetrahedron."""
    return dot(sub(b, a), cross(sub(c, a), sub(d, a))) / 6.0


def tet_quality(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Volume over the cube of the longest edge."""
    longest = F.greatest(*[norm(sub(p, q)) for p, q in ((a, b), (a, c), (a, d), (b, c), (b, d), (c, d))])
    return F.abs(tet_volume(a, b, c, d)) / F.greatest(longest * longest * longest, F.lit(1e-30))


def barycentric2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """(w0, w1, w2) of a point in a plane triangle; null where the triangle is flat."""
    det = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    w1 = ((px - ax) * (cy - ay) - (cx - ax) * (py - ay)) / det
    w2 = ((bx - ax) * (py - ay) - (px - ax) * (by - ay)) / det
    return F.when(det != 0, F.struct((1.0 - w1 - w2).alias("w0"), w1.alias("w1"), w2.alias("w2")))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    d = sub(b, a)
    t = clip(dot(sub(p, a), d) / F.greatest(dot(d, d), F.lit(1e-18)), 0.0, 1.0)
    return norm(sub(p, add(a, scale(d, t))))


def in_polygon(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    """Even-odd test against a polygon given as two arrays."""
    n = F.size(xs)

    def crosses(i: Column) -> Column:
        j = F.when(i + 1 < n, i + 1).otherwise(F.lit(0))
        x0, y0, x1, y1 = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        over = (y0 > py) != (y1 > py)
        return F.when(over, F.when(px < (x1 - x0) * (py - y0) / (y1 - y0) + x0, 1).otherwise(0)).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def orient_tet(vol: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Corners in an order with positive volume."""
    return F.when(vol < 0, F.array(a, c, b, d)).otherwise(F.array(a, b, c, d))


def array_distance2(a: Column, b: Column, dims: int | None = None) -> Column:
    """Squared distance of two number arrays, summed in order in double precision.

    With a known number of dimensions the sum is written out, so that it stays inside generated code; arrays of another
    length then give null.
    """
    if dims is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    terms = [(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(dims)]
    return F.when((F.size(a) == dims) & (F.size(b) == dims), sum((t * t for t in terms[1:]), terms[0] * terms[0]))


def lattice_weights(x: Column, y: Column, z: Column, low: float, high: float, n: int) -> Column:
    """Trilinear weights of a point in an n^3 lattice: array of eight (i, j, k, w)."""
    g = lambda c: clip((c - F.lit(low)) / F.lit(high - low) * F.lit(n - 1.0), 0.0, n - 1 - 1e-9)
    gx, gy, gz = g(x), g(y), g(z)
    cells = []
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                w = F.lit(1.0)
                for c, d in ((gx, dx), (gy, dy), (gz, dz)):
                    f = c - F.floor(c)
                    w = w * (f if d else 1.0 - f)
                cells.append(F.struct((F.floor(gx) + dx).alias("i"), (F.floor(gy) + dy).alias("j"), (F.floor(gz) + dz).alias("k"), w.alias("w")))
    return F.array(*cells)
