"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Learning: each coordinate has its own rate alpha / (beta + sqrt(sum of squared gradients)); L1 keeps a coordinate at
exactly zero until its evidence outweighs it, so what is left is a short list of (slot, weight). It is learnt on at most
``max_rows`` labelled rows and ``max_bytes`` of their texts (documented bounds; the rows with the smallest seeded hashes of
their ids), streamed in that order through one task, ``epochs`` times. Settings are chosen by ``cross_validate`` inside the
folds that are learnt from. The weights have at most 2**bits entries, so their broadcast is bounded by
``bits`` and not by the data. Scoring is one map over whole texts; nothing is shuffled.

Features of a text: words (runs of a-z after lower-casing A-Z, digits, apostrophes and all non-ASCII bytes), pairs of
neighbours, and pairs with one word left out, each hashed to a slot and counted once per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text_hash import series_slices
from tidemark.session import materialize, ship_package

BITS = 22
#: Most labelled rows that are learnt from.
MAX_ROWS = 20_000
#: Most bytes of text that are learnt from; features of a text take about as much.
MAX_BYTES = 128_000_000
SEED = 11
L1 = 15.0
EPOCHS = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _word_table() -> np.ndarray:
    """Byte -> byte with A-Z lowered, and 0 where a byte parts words."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        ch = bytes([b]).lower()
        if b >= 128 or ch.isalnum() or b == 0x27:
            t[b] = ch[0]
    return t


_TABLE = _word_table()


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) over several texts, by whole-array arithmetic."""
    joined = np.frombuffer(b"\x20".join(texts) + b"\x20", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    b = _TABLE[joined]
    inside = b != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # polynomial in the byte's distance from its word's start: powers come from a table, words of any length work
    at = np.arange(len(b)) - np.repeat(np.concatenate((starts, [0])), np.diff(np.concatenate(([0], starts[1:], [len(b)], [len(b)]))))
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(255, _STEP))), dtype=np.uint64)
    terms = b.astype(np.uint64) * powers[at & 255] + (at >> 8).astype(np.uint64) * inside
    h = np.add.reduceat(terms, starts)
    text_ends = np.cumsum(sizes)
    return _scramble(h), np.searchsorted(text_ends, starts, side="right")


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def feature_slots(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot), each pair once, ordered by text."""
    h, of = hash_words(texts)
    keep, mask = [(of, h)], np.uint64((1 << bits) - 1)
    for gap, salt in ((1, np.uint64(0xA24BAED4963EE407)), (2, np.uint64(0x9FB21C651E98DF25))):
        if len(h) > gap:
            same = of[:-gap] == of[gap:]
            keep.append((of[:-gap][same], _scramble(h[:-gap] * salt + h[gap:])[same]))
    text = np.concatenate([x for x, _ in keep]).astype(np.uint64)
    slot = np.concatenate([x for _, x in keep]) >> np.uint64(64 - bits) & mask
    both = np.unique(text << np.uint64(bits) | slot)
    return (both >> np.uint64(bits)).astype(np.int64), (both & mask).astype(np.int64)


class Ftrl:
    """FTRL-proximal state for 2**bits coordinates and a bias that is not penalised."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = L1, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.zb = self.nb = 0.0

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha)

    def learn(self, slots: np.ndarray, y: float) -> None:
        w = self.weights(slots)
        b = self.bias
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g
        self.zb += g - (np.sqrt(self.nb + g * g) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += g * g


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS, seed: int = SEED, l1: float = L1, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(slot, weight) rows, the bias under slot -1. At most 2**bits + 1 rows.

    Rows whose label is null are left out; null text is empty. Only whether the label is 1 counts. Of the ``max_rows`` rows
    with the smallest hashes of their ids, those are learnt from whose texts fit into ``max_bytes`` together with the ones
    before them; a text that does not fit is passed over, and the next is tried. This is decided on sizes alone.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(order.alias("o"), F.col(id_col).alias("i"), (F.col(label_col) == 1).alias("y"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("n", F.octet_length("t"))
    # the documented bound: at most max_rows rows of numbers come to the driver
    first, used, fits = rows.select("o", "i", "h", "n").orderBy("o", "i", "h").limit(max_rows).collect(), 0, {}
    for r in first:
        if used + r.n <= max_bytes:
            used += r.n
            fits[r.o, r.h] = fits.get((r.o, r.h), 0) + 1
    some = spark.createDataFrame([(*k, c) for k, c in fits.items()], "o long, h long, c int")
    again = Window.partitionBy("o", "h").orderBy("i")
    rows = rows.join(F.broadcast(some), ["o", "h"]).withColumn("k", F.row_number().over(again)).where("k <= c").select("o", "i", "h", "y", "t")
    rows = rows.repartition(1).sortWithinPartitions("o", "i", "h", "y")  # at most max_bytes of text

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = Ftrl(bits, l1=l1), []
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                of, slots = feature_slots([t.encode() for t in part["t"]], bits)
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                for k, y in enumerate(part["y"]):
                    seen.append((slots[cuts[k] : cuts[k + 1]].astype(np.int32), float(y)))
                    model.learn(slots[cuts[k] : cuts[k + 1]], float(y))
        for _ in range(epochs - 1):
            for slots, y in seen:
                model.learn(slots, y)
        live = np.flatnonzero(np.abs(model.z) > model.l1)
        yield pd.DataFrame({"slot": np.concatenate(([-1], live)), "weight": np.concatenate(([model.bias], model.weights(live)))})

    return rows.mapInPandas(learn, "slot long, weight double")


def score(df: DataFrame, weights: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The input's rows as a struct ``row`` and their ``score``. Empty and null texts score as the bias alone."""
    spark = df.sparkSession
    ship_package(spark)
    got = weights.toPandas()  # bounded by 2**bits + 1 rows, and far fewer after L1
    bias = float(got.loc[got["slot"] == -1, "weight"].sum())  # nothing was learnt from: no row, bias 0
    live = got[got["slot"] >= 0]
    shared = spark.sparkContext.broadcast((live["slot"].to_numpy(), live["weight"].to_numpy()))
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(1 << bits, np.float32)
        slots, values = shared.value
        w[slots] = values
        for s in batches:
            out = [_score_slice(texts, w, bias, bits) for texts in series_slices(s)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return rows.select("row", scores("t").alias("score"))


def _score_slice(texts: list[bytes], w: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """A slot counts once per text, so only slots with weight are sorted for distinctness: they are few."""
    h, of = hash_words(texts)
    total = np.full(len(texts), bias, np.float64)
    found = []
    shift = np.uint64(64 - bits)
    for gap, salt in ((0, None), (1, np.uint64(0xA24BAED4963EE407)), (2, np.uint64(0x9FB21C651E98DF25))):
        if len(h) <= gap:
            continue
        slot = (h if gap == 0 else _scramble(h[:-gap] * salt + h[gap:])) >> shift
        text = of if gap == 0 else of[:-gap]
        hit = np.flatnonzero(w[slot])
        if gap:
            hit = hit[of[hit] == of[hit + gap]]
        found.append(text[hit].astype(np.uint64) << np.uint64(bits) | slot[hit])
    if found:
        both = np.unique(np.concatenate(found))
        np.add.at(total, (both >> np.uint64(bits)).astype(np.int64), w[(both & np.uint64((1 << bits) - 1)).astype(np.int64)])
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _labelled(labels: DataFrame, left_out: list[int]) -> DataFrame:
    """(label_id, toxic) of the labels that are in none of the folds ``left_out``; the largest if labels repeat an id."""
    ok = F.col("toxic").isNotNull() & ~fold(F.col("doc_id")).isin(*left_out)
    return labels.where(ok).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, left_out: tuple[int, ...] = (0,), **settings) -> DataFrame:
    """Weights learnt from labelled documents outside the folds ``left_out``. One label per id: the largest if labels repeat one."""
    known = _labelled(labels, list(left_out))
    # the sample is taken from the narrow table, so the side that is broadcast has at most max_rows rows and no text moves
    # but the sample's
    some = materialize(known.orderBy(F.xxhash64(F.lit(SEED), F.col("label_id")), "label_id").limit(max_rows), "sample")
    pairs = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    return materialize(train(pairs, "doc_id", "text", "toxic", max_rows, **settings), "ftrl")


def cross_validate(docs: DataFrame, labels: DataFrame, grid: list[dict], folds: tuple[int, ...] = (1, 2, 3, 4)) -> list[dict]:
    """Sum of log losses, misses and false alarms for each setting of ``grid``, over ``folds`` in turn; fold 0 is never looked at."""
    out = []
    for settings in grid:
        total = {"loss": 0.0, "missed": 0, "false": 0, "rows": 0}
        for k in folds:
            weights = fit_toxicity(docs, labels, left_out=(0, k), **settings)
            truth = _labelled(labels, [f for f in range(5) if f != k])
            bits = settings.get("bits", BITS)
            got = score(docs.select("doc_id", "text").join(truth, F.col("doc_id") == F.col("label_id")), weights, bits=bits).select("score", (F.col("row.toxic") == 1).alias("y"))
            p = F.greatest(F.least("score", F.lit(1 - 1e-9)), F.lit(1e-9))
            r = got.agg(F.sum(-F.log(F.when(F.col("y"), p).otherwise(1 - p))).alias("loss"), F.sum((F.col("y") & (F.col("score") < 0.5)).cast("int")).alias("missed"), F.sum((~F.col("y") & (F.col("score") >= 0.5)).cast("int")).alias("false"), F.count(F.lit(1)).alias("rows")).first()
            for n in total:
                total[n] += r[n] or 0
        out.append({**settings, **total})
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels are used for learning only.

    Null and empty texts score as the bias alone. Rows that repeat an id are scored each by its own text; if such rows are
    labelled, each is learnt from. A null id is in the fold of the empty text and has no label. Without labels every
    score is 0.5. Other columns are ignored; an empty table gives no rows.
    """
    s = score(docs.select("doc_id", "text"), fit_toxicity(docs, labels, max_rows))
    return s.select(F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns as they were. Where no weight but the bias was learnt (there are
    no labels, or nothing tells the labelled texts apart) nothing is known to be toxic and all stay; other edge cases are those of ``toxicity_scores``."""
    weights = fit_toxicity(docs, labels, max_rows)
    if weights.where("slot >= 0").isEmpty():
        return docs
    return score(docs, weights).where("score < 0.5").select("row.*")
