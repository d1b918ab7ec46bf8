"""Readers for documents and text formats: JSON, OBJ meshes, kinematics logs, batch and event logs, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import timestamp_ms

CLIP = ("name string, title string, source struct<type:string,path:string,frames:array<int>,crop_rows:array<int>,fix_borders:boolean>, size array<int>, fps int, camera struct<fovy:double,f:double,static:boolean,motion:string>, multiview string, note string, objects map<string,struct<role:string,template:string,prompts:array<struct<frame:int,pos:array<array<int>>,neg:array<array<int>>>>>>")


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a file under a declared schema; fields that a file lacks are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): whole documents as variant values, for schemas that differ from file to file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))


def clip_objects(clips: DataFrame) -> DataFrame:
    """(clip, name, role, template) of every object, in the order of the document."""
    return clips.select(F.col("name").alias("clip"), F.posexplode(F.map_entries("objects")).alias("idx", "e")).select("clip", "idx", F.col("e.key").alias("name"), F.col("e.value.role").alias("role"), F.col("e.value.template").alias("template"))


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (v, x, y, z), faces (f, a, b, c)) of a Wavefront text, ids from 0 in the order of the file.

    A file is one row of text, so that lines keep their order; a mesh file is small against a task's memory.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    parts = lines.select("i", F.split(F.trim("line"), r"\s+").alias("p"))
    w = Window.partitionBy(F.col("p")[0]).orderBy("i")
    parts = parts.where(F.col("p")[0].isin("v", "f")).withColumn("n", F.row_number().over(w) - 1)
    v = parts.where(F.col("p")[0] == "v").select(F.col("n").cast("long").alias("v"), *[F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")])
    at = lambda k: (F.split(F.col("p")[k], "/")[0].cast("long") - 1)
    f = parts.where(F.col("p")[0] == "f").select(F.col("n").cast("long").alias("f"), *[at(k + 1).alias(c) for k, c in enumerate("abc")])
    return v, f


def kinematics(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(t, columns…) from a log whose first column is a wall clock; repeated headers and short rows are dropped."""
    schema = T.StructType([T.StructField("clock", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in columns] + [T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    ok = raw.where(F.col("_bad").isNull() & ~F.startswith(F.col("clock"), F.lit("Date:")))
    return ok.select(timestamp_ms(F.col("clock")).alias("t"), *columns).where("t is not null")


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """(time, clip, stage, conditions, status, seconds) from lines ``HH:MM:SS clip stage cond… ok|FAILED (rc) n s``."""
    line = F.col("value")
    pattern = r"^(\d\d:\d\d:\d\d) (\S+) (\S+)((?: \S+)*?) (ok|FAILED \(-?\d+\)) (\d+) s$"
    g = lambda k: F.regexp_extract(line, pattern, k)
    return spark.read.text(path).where(line.rlike(pattern)).select(g(1).alias("time"), g(2).alias("clip"), g(3).alias("stage"), F.array_remove(F.split(F.trim(g(4)), " "), "").alias("conditions"), g(5).alias("status"), g(6).cast("int").alias("seconds"))


def event_log(spark: SparkSession, path: str, field: str = "tool") -> DataFrame:
    """Counts by a field of JSON lines; lines that are no JSON are counted under null."""
    v = F.try_parse_json("value")
    return spark.read.text(path).groupBy(F.try_variant_get(v, f"$.{field}", "string").alias(field)).agg(F.count(F.lit(1)).alias("n"))


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, modified, length) of files by name pattern, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def latest_version(listing: DataFrame, pattern: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """Greatest folder name among files that exist."""
    return listing.select(F.regexp_extract("path", pattern, 1).alias("version")).agg(F.max("version").alias("version"))


def reference_depth(px: DataFrame, scale: float) -> DataFrame:
    """Depth in metres and where it is valid."""
    return px.withColumn("z", F.col("raw") * F.lit(scale)).withColumn("valid", F.col("z") > 0)


def frames_between(frames: DataFrame, first: int, last: int, rows: tuple[int, int] | None = None, borders: tuple[int, int] | None = None) -> DataFrame:
    """Frames of an inclusive range; pixels of a row range, numbered from its start. The range is a plain filter on ``k``, which
    reaches a scan that knows frames. ``borders`` (width, height after the crop) repairs dark edges by ``repaired``."""
    out = frames.where((F.col("k") >= first) & (F.col("k") <= last))
    if rows is not None:
        out = out.where((F.col("v") >= rows[0]) & (F.col("v") < rows[1])).withColumn("v", F.col("v") - rows[0])
    return out if borders is None else repaired(out, *borders)


def repaired(px: DataFrame, width: int, height: int) -> DataFrame:
    """Row 0 takes row 1, the last two rows the one before them, then the last two columns the one before them: each pixel goes
    to the places that show it, so nothing is joined."""
    to_rows = F.when(F.col("v") == 1, F.array(F.lit(0), F.lit(1))).when(F.col("v") == height - 3, F.array(*[F.lit(height - d) for d in (3, 2, 1)])).otherwise(F.array(F.col("v").cast("int")))
    to_columns = F.when(F.col("u") == width - 3, F.array(*[F.lit(width - d) for d in (3, 2, 1)])).otherwise(F.array(F.col("u").cast("int")))
    kept = px.where((F.col("v") > 0) & (F.col("v") < height - 2) & (F.col("u") < width - 2))
    kinds = dict(px.dtypes)
    places = lambda c, n: F.explode(c.cast(f"array<{kinds[n]}>"))
    return kept.withColumn("v", places(to_rows, "v")).withColumn("u", places(to_columns, "u")).select(*px.columns)


def metric_depth(px: DataFrame, calib: DataFrame, offsets: DataFrame) -> DataFrame:
    """1 / max(a * disp + b_k, 1): frames without an offset are left out. Calibration tables have a row a clip and frame."""
    return px.join(calib, "clip").join(offsets, ["clip", "k"]).withColumn("z", 1.0 / F.greatest(F.col("a") * F.col("disp") + F.col("b"), F.lit(1.0)))
