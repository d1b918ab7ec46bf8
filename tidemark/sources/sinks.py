"""Writers: JSON documents, atomic replacement, upserts, quantised exports, text tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, quantize16
from tidemark.operators.experiments import upsert

Names = Sequence[str]


def write_json(df: DataFrame, path: str) -> None:
    """One document a line; non-finite numbers are left out as nulls are."""
    cols = [finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").json(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    fs, where = _file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(where)


#: File beside a published table's versions that names the current one.
CURRENT = "CURRENT"


def replace_table(df: DataFrame, path: str) -> str:
    """Publishes a table under ``path``: rows are written to a version folder of their own, then the pointer file that names it is
    put in place by one rename. A crash leaves the old version current; readers of the old one keep their files. Returns
    the version's folder. ``df`` may have been read from the same table."""
    spark = df.sparkSession
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    fs, pointer = _file_system(spark, f"{path.rstrip('/')}/{CURRENT}")
    _, fresh = _file_system(spark, f"{path.rstrip('/')}/{CURRENT}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.rsplit("/", 1)[1].encode()))
    out.close()
    # FileContext renames over what is there in one step
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = next(o for o in rename if str(o) == "OVERWRITE")
    context.rename(fresh, pointer, options)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that a published table's pointer names; None where nothing is published."""
    fs, pointer = _file_system(spark, f"{path.rstrip('/')}/{CURRENT}")
    if not fs.exists(pointer):
        return None
    name = spark.read.text(str(pointer.toString())).first().value  # one line
    return f"{path.rstrip('/')}/{name}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table is published under {path}")
    return spark.read.parquet(version)


def upsert_table(new: DataFrame, path: str, keys: Names, version: str) -> None:
    """Rows by key, the newest version of each; creates the table where there is none. Published in one step."""
    now = current_version(new.sparkSession, path)
    if now is None:
        replace_table(new, path)
    else:
        replace_table(upsert(new.sparkSession.read.schema(new.schema).parquet(now), new, keys, version), path)


def index_first(index: DataFrame, entry: DataFrame, name: str) -> DataFrame:
    """An index with the entry at the front and older entries of that name gone; ``ord`` gives the order."""
    rest = index.join(entry.select(name), name, "left_anti")
    return entry.withColumn("ord", F.lit(0).cast("long")).unionByName(rest.withColumn("ord", F.col("ord") + 1), allowMissingColumns=True)


def quantized(df: DataFrame, columns: Names, low: float, high: float) -> DataFrame:
    """Numbers as signed 16-bit steps between two bounds."""
    return df.select(*[quantize16(F.col(c), low, high).alias(c) if c in columns else F.col(c) for c in df.columns])


def base64_series(df: DataFrame, by: Names, order: Names, q: str) -> DataFrame:
    """A series of 16-bit numbers as Base64 of its little-endian bytes."""
    two = lambda x: F.concat(F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftrightunsigned(x.cast("int").bitwiseAND(F.lit(65535)), 8)), 2, "0"))
    s = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, q))).alias("__s"))
    return s.select(*by, F.base64(F.unhex(F.array_join(F.transform("__s", lambda e: two(e[q])), ""))).alias("data"))


def _cell(df: DataFrame, c: str, digits: int) -> Column:
    """A value as text, numbers with fixed digits, missing as a dash."""
    text = F.format_string(f"%.{digits}f", F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
    return F.when(F.col(c).isNull(), "-").otherwise(text)


def text_table(df: DataFrame, columns: Names, digits: int = 3) -> DataFrame:
    """Rows as lines of text, numbers with fixed digits, missing as a dash."""
    return df.select(F.concat_ws(" | ", *[_cell(df, c, digits) for c in columns]).alias("line"))


def markdown_table(df: DataFrame, columns: Names, order: Names, digits: int = 3) -> DataFrame:
    """(ord, line): a table as Markdown lines, its head, the rule under it and its rows in order; numbers with fixed digits.

    Rows are numbered by a range sort, so a table of any length has its lines in order."""
    from tidemark.operators.sets import renumber

    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(df, c, digits) for c in columns]), F.lit(" |"))
    lines = df.select(F.struct(*order).alias("__o"), text.alias("line"))
    _, places = renumber(lines, [], lines.select(F.col("__o").alias("old")).distinct())
    rows = lines.join(places, lines["__o"] == places["old"]).select((F.col("new") + 2).alias("ord"), "line")
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "ord long, line string")
    return head.unionByName(rows)


def rounded_flat(values: Column, digits: int = 5) -> Column:
    """An array of arrays of numbers as one array, rounded half to even; what is not finite is null."""
    return F.transform(F.flatten(values), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.bround(x, digits)))


def append_points(df: DataFrame, path: str, part: str) -> None:
    df.write.mode("append").partitionBy(part).parquet(path)
