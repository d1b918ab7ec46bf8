"""The Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns stored as local time stamps; operators want points in time.
TIMES = {"events": ["ts"], "orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder, time stamps as points in time (the session's zone is UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    kinds = dict(df.dtypes)
    for c in TIMES.get(name, ()):
        if kinds.get(c) == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df
