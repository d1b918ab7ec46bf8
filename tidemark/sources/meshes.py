"""STL meshes as tables: triangles read by ranges of records, corners welded to vertices, the largest part in its own frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.sets import face_pairs, min_label_components
from tidemark.session import materialize, ship_package
from tidemark.sources.arrays import open_file

#: Fixed by the format: bytes before the first record, and the record (normal, three corners, two spare bytes).
HEADER, RECORD = 84, np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("spare", "<u2")])
#: Triangles that one task reads, and that one batch holds.
SPLIT, BATCH = 1 << 20, 1 << 15

_CORNERS = [f"{p}{c}" for p in "abc" for c in "xyz"]
_SCHEMA = "f long, " + ", ".join(f"{c} double" for c in _CORNERS)


class _Range(InputPartition):
    def __init__(self, first: int, last: int, text: bool):
        super().__init__((first, last))
        self.first, self.last, self.text = first, last, text


class StlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        with open_file(self.path) as f:
            size, head = f.size(), f.read(HEADER)
        n = int(np.frombuffer(head[80:84], "<u4")[0]) if len(head) == HEADER else -1
        if n >= 0 and size == HEADER + n * RECORD.itemsize:
            return [_Range(at, min(at + self.split, n), False) for at in range(0, n, self.split)] or [_Range(0, 0, False)]
        if not head.lstrip().startswith(b"solid"):
            raise ValueError(f"{self.path} is no STL file: {size} bytes for {n} triangles")
        return [_Range(0, 0, True)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as f:
            if part.text:
                yield from _text(f)
                return
            for at in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - at)
                f.seek(HEADER + at * RECORD.itemsize)
                data = f.read(n * RECORD.itemsize)
                yield _batch(at, np.frombuffer(data, RECORD)["corners"].reshape(n, 9).astype(np.float64))


def _batch(first: int, corners: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(corners), dtype=np.int64)), *[pa.array(np.ascontiguousarray(corners[:, i])) for i in range(9)]], ["f", *_CORNERS])


def _text(f) -> Iterator[pa.RecordBatch]:
    """Triangles of a text file, streamed: every three ``vertex`` lines are one."""
    rest, held, first = b"", [], 0
    while True:
        piece = f.read(1 << 20)
        lines = (rest + piece).split(b"\n")
        rest = lines.pop() if piece else b""
        held += [[float(x) for x in w[1:4]] for w in map(bytes.split, lines) if w[:1] == [b"vertex"]]
        whole = len(held) // 3 * 3
        if whole and (whole >= 3 * BATCH or not piece):
            yield _batch(first, np.array(held[:whole]).reshape(-1, 9))
            first, held = first + whole // 3, held[whole:]
        if not piece:
            if held:
                raise ValueError("a triangle is cut short")
            return


class StlSource(DataSource):
    """``read.format("stl").load(path)``: (f, ax, ay, az, bx, ...), a row a triangle, f its place in the file."""

    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StlReader(self.options)


def stl(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(StlSource)
    return spark.read.format("stl").option("split", str(split)).load(path)


def welded(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (v, x, y, z), faces (f, a, b, c)): corners at one place are one vertex, numbered from 0 in the order of x, y, z.

    Numbers come from a range sort of the distinct places and the sizes of its partitions. Triangles that lose an edge by
    it are left out.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[(F.col(f"{p}{c}") + 0.0).alias(c) for c in "xyz"]) for i, p in enumerate("abc")])).alias("p")
    corners = materialize(triangles.select("f", corner).select("f", "p.*"), "corners")  # -0.0 + 0.0 is 0.0
    placed = materialize(corners.select("x", "y", "z").distinct().orderBy("x", "y", "z").withColumn("m", F.monotonically_increasing_id()), "places")
    placed = placed.withColumn("__p", F.shiftright("m", 33)).withColumn("__i", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    vertices = placed.join(F.broadcast(before), "__p").select((F.col("__before") + F.col("__i")).alias("v"), "x", "y", "z")
    at = lambda k, n: F.max(F.when(F.col("i") == k, F.col("v"))).alias(n)
    faces = corners.join(vertices, ["x", "y", "z"]).groupBy("f").agg(at(0, "a"), at(1, "b"), at(2, "c"))
    return vertices, faces.where("a <> b and b <> c and a <> c")


def largest_component(faces: DataFrame) -> DataFrame:
    """The faces of the part with the most, joined by shared edges; of equals that with the least face."""
    pairs = face_pairs(faces).select(F.col("f1").alias("a"), F.col("f2").alias("b"))
    parts = materialize(min_label_components(pairs, faces.select(F.col("f").alias("node"))), "parts")
    best = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1).select("root")
    return faces.join(parts.join(F.broadcast(best), "root", "left_semi").select(F.col("node").alias("f")), "f", "left_semi")


def principal_frame(vertices: DataFrame) -> DataFrame:
    """Vertices about their mean along their principal axes, largest first: right-handed, an axis' largest part positive."""
    c = "xyz"
    m = vertices.agg(*[F.avg(x).alias(x) for x in c], *[F.covar_pop(x, y).alias(x + y) for i, x in enumerate(c) for y in c[i:]]).first()
    if m.x is None:
        return vertices
    cov = np.array([[m["".join(sorted(x + y))] for y in c] for x in c])
    axes = np.linalg.eigh(cov)[1][:, ::-1].T
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    if np.linalg.det(axes) < 0:
        axes[2] *= -1
    along = lambda a: sum((F.lit(float(a[i])) * (F.col(x) - F.lit(float(m[x]))) for i, x in enumerate(c)), F.lit(0.0))
    return vertices.select("v", *[along(a).alias(x) for a, x in zip(axes, c)])


def load_shape(spark: SparkSession, path: str, scale: float = 1e-3, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a template's largest part, scaled, in its own principal frame. Meshes are not thinned out."""
    vertices, faces = welded(stl(spark, path, split))
    part = materialize(largest_component(faces), "shape")
    used = part.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    own = vertices.join(used, "v", "left_semi").select("v", *[(F.col(x) * scale).alias(x) for x in "xyz"])
    return principal_frame(own), part
