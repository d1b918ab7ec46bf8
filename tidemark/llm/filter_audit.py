"""What five filters take out, in every order they can be applied: an incidence matrix product.

Method: each document has a mask of the filters that it fails. Counts of the 32 masks by part, and the same counts of
good and of toxic documents, are the rows of a matrix; four fixed 32 x 600 matrices of zeros and ones say, for each of
the 120 orders and their 5 steps, which masks are kept after the step, removed in it, removed before although they fail
its filter, and fail it alone. Their integer products are the results, so the documents are read once and no order is
ever run. Filters A to D are expressions over the text. E (an equal text has a smaller id) is the smallest id of each
text's digest: heavy digests' ids are broadcast (``join_hot``), the others meet by an ordinary join of narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of
from tidemark.operators.joins import join_hot
from tidemark.session import materialize, ship_package

#: Fixed by the contract: filters in order of their bits, least first.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: All orders, first to last as strings.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_AUDIT_SQL = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in _MEASURES)


def incidence() -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique: 32 x 600 matrices of 0 and 1; column 5 * order + step - 1."""
    masks = np.arange(MASKS)[:, None]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    own = np.array([bit[f] for o in ORDERS for f in o])
    before = np.array([sum(bit[f] for f in o[:s]) for o in ORDERS for s in range(len(FILTERS))])
    fails, gone = (masks & own) > 0, (masks & before) > 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": masks == own}
    return {k: m.astype(np.int64) for k, m in out.items()}


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) per row. Null text and null part are empty strings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    capitals = F.char_length("t") - F.char_length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    words = narrow.withColumn("w", words_of(F.col("t")))
    facts = words.select("doc_id", "part", F.sha2(F.encode("t", "UTF-8"), 256).alias("digest"), F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("u"), capitals.alias("c"), F.char_length("t").alias("l"), F.col("t").rlike(r"[#$%&*|]").alias("d"))
    fails = [F.col("n") < 50, 100 * F.col("u").cast("long") < 65 * F.col("n").cast("long"), 100 * F.col("c").cast("long") > 5 * F.col("l").cast("long"), F.col("d")]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    rows = materialize(facts.select("doc_id", "part", F.unhex("digest").alias("digest"), mask.alias("mask")), "masks")
    # a null id has no smaller one and is nobody's smaller one
    first = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "first")
    single = rows.join(first.select("digest"), "digest", "left_anti").select("doc_id", "part", "mask")
    copies = join_hot(rows.join(first.select("digest"), "digest", "left_semi"), first, ["digest"], "copies")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return single.unionByName(copies.select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask")))


def mask_histograms(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): three arrays of 32 counts a part; good and toxic are documents with such a label."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = masks.join(known, F.col("doc_id") == F.col("label_id"), "left")
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    at = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0)) for k in range(MASKS)]).alias(c)
    return cells.groupBy("part").agg(at("n"), at("good"), at("toxic"))


def outcomes(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of parts (rows) by order and step (600 columns), from counts by mask."""
    m = incidence()
    out = {"kept": counts @ m["kept"], "removed": counts @ m["removed"], "redundant": counts @ m["redundant"], "unique_fails": counts @ m["unique"], "good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"]}
    letter = np.array([FILTERS.index(f) for o in ORDERS for f in o])
    by_filter = np.equal.outer(letter, np.arange(len(FILTERS))).astype(np.int64)
    out["shapley"] = (out["removed"] @ by_filter)[:, letter]
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = len(FILTERS)
    orders, at = pa.array(np.repeat(ORDERS, steps).tolist()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS)))
    for b in batches:
        for lo in range(0, b.num_rows, 64):  # 64 parts make 38,400 rows
            some = b.slice(lo, 64)
            counts, good, toxic = (some.column(c).flatten().to_numpy().reshape(-1, MASKS) for c in ("n", "good", "toxic"))
            got = outcomes(counts, good, toxic)
            n = some.num_rows
            parts = some.column("part").take(pa.array(np.repeat(np.arange(n), steps * len(ORDERS))))
            yield pa.RecordBatch.from_arrays([parts, pa.concat_arrays([orders] * n), pa.concat_arrays([at] * n), *[pa.array(got[m].ravel()) for m in _MEASURES]], ["part", "filter_order", "step", *_MEASURES])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of the step's filter there: 600 rows a part that occurs, zeros included.

    Null texts and null parts are empty strings. Rows that repeat an id are documents of their own and none the other's
    copy; a null id is no copy and makes none. A document is good (toxic) if any label of its id has quality (toxic) 1;
    labels without an id or with nulls say nothing. Other columns are ignored; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    return mask_histograms(failure_masks(docs, id_col, text_col, part_col), labels).mapInArrow(_products, _AUDIT_SQL)
