"""Exact duplicates by digest, with the frequent digests split off.

Method: a frequent-items sketch (Misra-Gries counters, merged from partial sketches of every task) names the digests
that may be frequent; their exact counts and smallest ids are verified by a map-side combined aggregate; the verified
winners, at most ``counters`` rows, are broadcast so that their rows never enter a shuffle; all other digests take one
ordinary shuffle: sizes and smallest ids are combined before it, and each row meets its group's by a join. The sketch
(``approx_top_k``) tracks 8 x ``counters`` items and, when it is full, takes the median count off all and drops what falls
to zero; an item's count is off by at most about rows / (6 x ``counters``), so a digest that it misses is not frequent:
the ordinary path's groups have that many rows at most, unless more digests than ``counters`` are as frequent. The texts
are read once: digests go to a written table first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import collapse_space
from tidemark.session import materialize

#: Frequent-item counters, and so the most rows that are ever broadcast (48 bytes each).
COUNTERS = 1024


def text_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with runs of white space made one space; null text counts as empty."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.encode(collapse_space(F.col(text_col)), "UTF-8"), 256)).alias("digest"),
    )


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified winners (digest, keep_id, group_size): at most ``counters`` rows, counts exact."""
    key = F.xxhash64("digest")
    sketch = digests.agg(F.expr(f"approx_top_k(xxhash64(digest), {counters}, {8 * counters})").alias("top"))
    # the sketch's answer is one row of at most `counters` 64-bit keys: bounded whatever the input
    named = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("key"))
    return (
        digests.join(F.broadcast(named), key == F.col("key"), "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .orderBy(F.desc("group_size"), "digest")
        .limit(counters)
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The smallest id of equal texts stays. Null text equals empty text. Rows that repeat an id share its decision, so
    a repeated winner is kept as often as it occurs. Null ids never win against others; a group of null ids only has
    keep_id null and keeps all. Other columns, whatever their names, are ignored. Empty input gives no rows.
    """
    digests = materialize(text_digests(df, id_col, text_col), "digests")
    winners = materialize(frequent_digests(digests, counters), "frequent")
    heavy = digests.join(F.broadcast(winners), "digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    light = light.join(groups, "digest")
    return heavy.select("digest", "doc_id", "keep_id", "group_size").unionByName(light.select("digest", "doc_id", "keep_id", "group_size")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
