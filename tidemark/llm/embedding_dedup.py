"""Near duplicates among embeddings of one label: a subspace pigeonhole join, exact.

Method: vectors are made unit vectors and turned by a seeded rotation, which spreads what parts two of them over all
coordinates, and their coordinates are split into blocks of ``WIDTH``. Cosine >= t is squared distance <= 2 - 2t, and a
pair within that is, in some block, within the block's share of it (in proportion to its coordinates). So each block is
joined by itself under its budget, and the union of what the blocks find is verified by the cosine in double precision.

A block's range join: points lie in grid cells over the block's first ``GRID`` coordinates, twice the block's radius wide,
and probe the cells that come after their own and may hold something within the radius; two points meet in the cell of the
later one, once. In a cell a matrix product of the block's coordinates leaves the pairs within budget. A pair counts in the
first block that it is within budget of, whichever cells it met in. Only counts and the edges of stars leave a cell.

Equal vectors are one class with its number of rows. A cell of more than ``MOST`` points is dealt to slots that meet two by
two, so no task holds more than two slots; counting the links of a cluster of distinct vectors that all resemble each
other takes a product for each two slots, but no pair of it is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_hot
from tidemark.operators.sets import connected_components
from tidemark.session import materialize, ship_package

#: Fixed by the contract: least cosine of a link.
LEAST_COSINE = 0.93
#: Coordinates of a block, those of them that the grid uses, and points of a cell that meet in one task.
WIDTH, GRID, MOST = 8, 2, 4096
#: Seed of the rotation; coordinates that are turned together.
SEED, TURN = 11, 256
#: Room for rounding in squared distances of unit vectors; far more than double precision needs.
SLACK = 1e-9

_BUCKET = ["label", "dim", "block", "cx", "cy"]


@lru_cache(maxsize=64)
def _turns(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def turned(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows turned by one rotation for their length: coordinates shuffled, then ``TURN`` at a time by an orthogonal matrix.

    Sums run over the coordinates in order, so a vector has the same digits whatever rows it is turned with."""
    dim = unit.shape[1]
    order = np.random.default_rng(seed).permutation(dim)
    out = np.zeros_like(unit)
    for lo in range(0, dim, TURN):
        some = order[lo : lo + TURN]
        for c, weights in zip(some, _turns(len(some), seed)):
            out[:, lo : lo + len(some)] += unit[:, c, None] * weights
    return out


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish and no digit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def blocks_of(dim: int, width: int = WIDTH) -> list[tuple[int, int]]:
    return [(lo, min(lo + width, dim)) for lo in range(0, dim, width)]


def budgets(dim: int, least: float, width: int = WIDTH) -> np.ndarray:
    """Squared distance allowed in each block: its share of 2 - 2 * least, with room for rounding."""
    return np.array([(hi - lo) / dim for lo, hi in blocks_of(dim, width)]) * (2 - 2 * least + SLACK) + SLACK


def _cell_size(budget: float) -> float:
    return 2 * float(np.sqrt(budget))


def cells(turn: np.ndarray, least: float, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(block, rows, their cells as two numbers, whether it is home): a row's own cell, and later ones it may have to meet."""
    for k, ((lo, hi), budget) in enumerate(zip(blocks_of(turn.shape[1], width), budgets(turn.shape[1], least, width))):
        side, reach = _cell_size(budget), float(np.sqrt(budget)) * (1 + 1e-9) + 1e-12
        x = np.zeros((len(turn), 2))
        used = min(GRID, hi - lo)
        x[:, :used] = turn[:, lo : lo + used]
        home = np.floor(x / side).astype(np.int32)
        low, high = np.floor((x - reach) / side).astype(np.int32), np.floor((x + reach) / side).astype(np.int32)
        yield k, np.arange(len(turn)), home, True
        for step in product((-1, 0, 1), repeat=2):
            if step > (0, 0):
                other = home + np.array(step, np.int32)
                rows = np.flatnonzero(((other >= low) & (other <= high)).all(1))
                if len(rows):
                    yield k, rows, other[rows], False


def _matrix(column: pa.Array) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _place(least: float, width: int):
    """node, label, v -> a row for each cell the node is in or probes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                some = b.take(pa.array(np.flatnonzero(sizes == dim)))
                w = _matrix(some.column("v"))
                for k, at, cell, home in cells(turned(w / lengths(w)[:, None]), least, width):
                    n, pick = len(at), pa.array(at)
                    yield pa.RecordBatch.from_arrays([some.column("label").take(pick), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, 1]), some.column("node").take(pick), pa.array(np.full(n, home))], [*_BUCKET, "node", "home"])

    return place


def linked(a: np.ndarray, b: np.ndarray, block: int, least: float, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) of turned unit vectors that may have a cosine of ``least`` and whose first block within
    budget is ``block``."""
    spans, limit = blocks_of(a.shape[1], width), budgets(a.shape[1], least, width)
    lo, hi = spans[block]
    ours, theirs = a[:, lo:hi], b[:, lo:hi]
    square = (theirs * theirs).sum(1)
    for at in range(0, len(a), 512):
        part = ours[at : at + 512]
        i, j = np.nonzero((part * part).sum(1)[:, None] + square[None] - 2 * (part @ theirs.T) <= limit[block] + SLACK)
        for cut in range(0, len(i), 65_536):
            s, t = at + i[cut : cut + 65_536], j[cut : cut + 65_536]
            ok = np.einsum("nd,nd->n", a[s], b[t]) >= least - SLACK
            s, t = s[ok], t[ok]
            # the same digits in whichever cell, so all cells name the same first block
            within = np.add.reduceat((a[s] - b[t]) ** 2, [x for x, _ in spans], axis=1) <= limit
            ok = within.argmax(1) == block
            yield s[ok], t[ok]


def _join_slots(least: float, width: int):
    """One cell, or two slots of a full one. Out: (u, v) edges to the least node of what is joined here, and (u, links)
    rows of the classes linked to u."""

    def join(table: pa.Table) -> pa.Table:
        out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])
        if table.num_rows < 2:
            return out.empty_table()
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        node, size, home, slot = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("node", "size", "home", "slot"))
        w = _matrix(table.column("v").combine_chunks().take(pa.array(order)))
        long = lengths(w)
        x = turned(w / long[:, None])
        block, i, j = (table.column(c)[0].as_py() for c in ("block", "i", "j"))
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        h, p = np.flatnonzero(home), np.flatnonzero(~home)
        pairs = [(h[slot[h] == i], h[slot[h] == j], i == j), (h[slot[h] == i], p[slot[p] == j], False)]
        if i != j:
            pairs.append((h[slot[h] == j], p[slot[p] == i], False))
        for left, right, same in pairs:
            if not len(left) or not len(right):
                continue
            for s, t in linked(x[left], x[right], block, least, width):
                s, t = left[s], right[t]
                ok = np.einsum("nd,nd->n", w[s], w[t]) / (long[s] * long[t]) >= least
                if same:
                    ok &= s < t
                s, t = s[ok], t[ok]
                np.add.at(links, s, size[t])
                np.add.at(links, t, size[s])
                _merge(label, s, t)
        some = np.flatnonzero(links)
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, label, node)
        edge = np.flatnonzero(node != low[label])
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(edge), pa.int64())
        return pa.table({"u": pa.concat_arrays([pa.array(node[edge]), pa.array(node[some])]), "v": pa.concat_arrays([pa.array(low[label[edge]]), none[0]]), "links": pa.concat_arrays([none[1], pa.array(links[some])])}).cast(out)

    return join


def _merge(label: np.ndarray, s: np.ndarray, t: np.ndarray) -> None:
    """Joins the trees of s[k] and t[k]: labels fall to the least of their neighbours until none changes."""
    while True:
        a, b = label[s], label[t]
        if (a == b).all():
            return
        low = np.arange(len(label))
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
        label[:] = low[label]


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component and one that is not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept per row: links join rows of one label with cosine >= ``least``.

    Rows without a label, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing,
    nor do vectors of different lengths. Equal vectors link, rows that repeat an id included: each is a row. A null id is
    never the smallest; component_id is null, and all is kept, where no row of the component has one. Of rows that share
    the smallest id each is kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    kind = df.schema[vec_col].dataType.elementType.typeName()
    v = F.col(vec_col) if kind in ("float", "double") else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    ok = F.col("label").isNotNull() & _usable(F.col("v"))
    # 128 bits name a vector: two of 10**12 share a name with a chance under 10**-14
    names = [F.xxhash64(F.lit(1), "v").alias("d1"), F.xxhash64(F.lit(2), "v").alias("d2")]
    named = rows.where(ok).select("vec_id", "label", "v", *names)
    classes = named.groupBy("label", "d1", "d2").agg(F.any_value("v").alias("v"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    placed = materialize(classes.select("node", "label", "v").mapInArrow(_place(least, width), "label string, dim int, block int, cx int, cy int, node long, home boolean"), "cells")
    full = placed.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("met")).where(F.col("met") & (F.col("n") > 1))
    slots = F.ceil(F.col("n") / F.lit(most)).cast("int")
    dealt = join_hot(placed, full.withColumn("slots", slots).drop("met"), _BUCKET, "n").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    two = F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("i"), F.greatest(k, F.col("slot")).alias("j"))))
    dealt = dealt.select(*_BUCKET, "node", "home", "slot", two.alias("ij")).select(*_BUCKET, "node", "home", "slot", "ij.i", "ij.j")
    meeting = dealt.join(classes.select("node", "size", "v").hint("shuffle_hash"), "node")
    found = materialize(meeting.groupBy(*_BUCKET, "i", "j").applyInArrow(_join_slots(least, width), "u long, v long, links long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    members = materialize(connected_components(found.where("v is not null").select("u", "v")), "components").join(classes.select("node", "first"), "node")
    roots = members.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members"))
    moved = join_hot(members.select("node", "root"), roots, ["root"], "members").select("node", "least")
    facts = classes.select("label", "d1", "d2", "node", "first", "size").join(moved, "node", "left").join(counts, "node", "left")
    facts = facts.select("label", "d1", "d2", "size", F.coalesce("least", "first").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    some = join_hot(named.drop("v"), materialize(facts, "facts"), ["label", "d1", "d2"], "size").select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
