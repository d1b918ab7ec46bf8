"""Series that are too long for one task: cut in segments, scanned each by itself, joined by what passes their edges.

``in_segments`` leaves short series whole and cuts the longest ones at quantiles of their first order column, so that a
segment is a range of the series and windows over (key, segment) are linear and bounded. What a row needs from other
segments (the last known value, a running sum, a follower's state) is worked out from one row a segment and joined by
(key, segment), by which the rows lie already. Followers (``Slew``, ``Clock``) reduce a segment to what it does to any number
that comes in, a function of a few numbers, so no task needs a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, ship_package, stored_bytes

Names = Sequence[str]

#: Rows of a series that stays whole; most series that are cut (all others have fewer rows than one in ``HOT`` of all);
#: segments of a series that is cut.
LONG, HOT, SPLITS = 4_000_000, 1024, 256
#: A smaller table than so many bytes a row of a long series is not asked for one.
ROW_BYTES = 16

_KEY = ["__key", "__seg"]


@dataclass(frozen=True)
class Segments:
    """``df`` with __key and __seg; ``cuts`` has a row for each segment of the series that are cut, None if none can be."""

    df: DataFrame
    order: tuple[str, ...]
    cuts: DataFrame | None

    def window(self, back: bool = False) -> Window:
        return Window.partitionBy(*_KEY).orderBy(*[F.col(c).desc_nulls_last() if back else F.col(c) for c in self.order])

    def done(self) -> DataFrame:
        return self.df.drop("__key", "__seg")


def in_segments(df: DataFrame, by: Names, order: Names, long: int = LONG, splits: int = SPLITS) -> Segments:
    """The table with its series in segments.

    Tables that are too small for a long series, by the planner's statistics, are left as they are: no pass is made. Larger
    ones are written once, rows counted by key, and the ``HOT`` longest series of more than ``long`` rows cut at
    ``splits`` - 1 quantiles of their first order column, which are numbers, dates or times; rows that tie stay together.
    """
    df = df.withColumn("__key", F.struct(*[F.col(c) for c in by]))
    size = stored_bytes(df)
    if size and size < ROW_BYTES * long:
        return Segments(df.withColumn("__seg", F.lit(0)), tuple(order), None)
    df = materialize(df, "series")
    heavy = df.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).orderBy(F.desc("n"), F.xxhash64("__key")).limit(HOT)
    shares = F.array(*[F.lit(k / splits) for k in range(1, splits)])
    cuts = df.join(F.broadcast(heavy.select("__key")), "__key", "left_semi").groupBy("__key").agg(F.percentile_approx(order[0], shares, F.lit(10 * splits)).alias("__cuts"))
    cuts = materialize(cuts, "cuts")  # at most HOT rows of SPLITS numbers
    seg = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(order[0]))), F.lit(0))
    df = df.join(F.broadcast(cuts), "__key", "left").withColumn("__seg", F.when(F.col("__cuts").isNull(), 0).otherwise(F.greatest(seg, F.lit(0)))).drop("__cuts")
    every = cuts.select("__key", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("__seg"))
    return Segments(df, tuple(order), every)


def _carried(s: Segments, facts: list[Column], carry: Callable[[Window], list[Column]]) -> DataFrame:
    """(__key, __seg, carried columns): ``facts`` aggregate each segment of the cut series, ``carry`` looks along a series'
    segments, empty ones included."""
    heavy = s.df.join(F.broadcast(s.cuts.select("__key").distinct()), "__key", "left_semi")
    by_seg = s.cuts.join(heavy.groupBy(*_KEY).agg(*facts), _KEY, "left")
    return by_seg.select(*_KEY, *carry(Window.partitionBy("__key").orderBy("__seg")))


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def known_around(s: Segments, known: Column, before: str = "__p", after: str = "__n") -> Segments:
    """Adds the last and the next value of ``known`` that is not null, the row's own included; null where there is none.

    Each is ``last`` over a growing frame, forwards and backwards, so the cost is linear in the rows.
    """
    s = replace(s, df=s.df.withColumn("__known", known))
    so_far = (Window.unboundedPreceding, 0)
    df = s.df.withColumn(before, F.last("__known", True).over(s.window().rowsBetween(*so_far))).withColumn(after, F.last("__known", True).over(s.window(back=True).rowsBetween(*so_far)))
    if s.cuts is not None:
        spot = F.when(F.col("__known").isNotNull(), F.struct(*s.order))
        facts = [F.min_by("__known", spot).alias("a"), F.max_by("__known", spot).alias("z")]
        back = Window.partitionBy("__key").orderBy(F.desc("__seg"))
        edges = _carried(s, facts, lambda w: [F.last("z", True).over(_before(w)).alias("__before"), F.last("a", True).over(_before(back)).alias("__after")])
        df = df.join(edges, _KEY, "left").withColumn(before, F.coalesce(before, "__before")).withColumn(after, F.coalesce(after, "__after")).drop("__before", "__after")
    return replace(s, df=df.drop("__known"))


def previous(s: Segments, x: str, out: str) -> Segments:
    """Adds the value of the row before; null in a series' first row."""
    df = s.df.withColumn(out, F.lag(x).over(s.window()))
    if s.cuts is not None:
        facts = [F.max_by(F.struct(x), F.struct(*s.order)).alias("z")]
        edges = _carried(s, facts, lambda w: [F.last("z", True).over(_before(w)).alias("__before")])
        first = F.row_number().over(s.window()) == 1
        df = df.withColumn("__head", first).join(edges, _KEY, "left").withColumn(out, F.when(F.col("__head"), F.col("__before")[x]).otherwise(F.col(out))).drop("__before", "__head")
    return replace(s, df=df)


def running(s: Segments, x: Column, out: str) -> Segments:
    """Adds the running sum of whole numbers, the row's own included."""
    s = replace(s, df=s.df.withColumn("__x", x.cast("long")))
    df = s.df.withColumn(out, F.sum("__x").over(s.window().rowsBetween(Window.unboundedPreceding, 0)))
    if s.cuts is not None:
        edges = _carried(s, [F.sum("__x").alias("z")], lambda w: [F.sum("z").over(_before(w)).alias("__before")])
        df = df.join(edges, _KEY, "left").withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__before")
    return replace(s, df=df.drop("__x"))


def positions(s: Segments, out: str) -> Segments:
    """Adds the row's number in its series, from 1."""
    return running(s, F.lit(1), out)


def framed(s: Segments, reach: int, columns: Callable[[Window], dict[str, Column]], block: int = LONG) -> DataFrame:
    """The rows with ``columns`` of the window of ``reach`` rows to both sides.

    Series that are cut are laid out anew in blocks of ``block`` rows by position, each with the ``reach`` rows around it.
    """
    if s.cuts is None:
        w = s.window().rowsBetween(-reach, reach)
        return s.df.select("*", *[c.alias(n) for n, c in columns(w).items()]).drop("__key", "__seg")
    block = max(block, reach)
    rows = positions(s, "__i").df.withColumn("__own", F.floor((F.col("__i") - 1) / F.lit(block)))
    at = (F.col("__i") - 1) % block
    blocks = F.array_compact(F.array(F.col("__own"), F.when((at < reach) & (F.col("__own") > 0), F.col("__own") - 1), F.when(at >= block - reach, F.col("__own") + 1)))
    w = Window.partitionBy("__key", "__block").orderBy("__i").rowsBetween(-reach, reach)
    out = rows.withColumn("__block", F.explode(blocks)).select("*", *[c.alias(n) for n, c in columns(w).items()])
    return out.where("__block = __own").drop("__key", "__seg", "__i", "__own", "__block")


class Slew:
    """y goes to the reading, by at most ``limit`` a row.

    What a segment does to any y that comes in is a line of slope 1 with flat pieces: its corners, a few where readings
    and y meet, are all that is kept. A reading adds two corners at most and takes out those that end on it.
    """

    def __init__(self, limit: float):
        self.limit = limit

    def step(self, y: float, v: float) -> float:
        return y + min(max(v - y, -self.limit), self.limit)

    def corners(self, at: np.ndarray, to: np.ndarray, v: float) -> tuple[np.ndarray, np.ndarray]:
        """The line (at -> to, slope 1 beyond its ends) after one more reading."""
        low, high = v - self.limit, v + self.limit
        if len(at):
            i, j = np.searchsorted(to, low), np.searchsorted(to, high, side="right")  # corners i..j-1 end on the reading
            left = at[i] - (to[i] - low) if i < len(at) else at[-1] + (low - to[-1])
            right = at[j - 1] + (high - to[j - 1]) if j else at[0] - (to[0] - high)
            # between corners of one height the line is flat and does not reach low or high in between
            left = max(left, at[i - 1]) if i else left
            right = min(right, at[j]) if j < len(at) else right
        else:
            i, j, left, right = 0, 0, low, high
        to = np.concatenate((to[:i] + self.limit, [v, v], to[j:] - self.limit))
        return np.concatenate((at[:i], [left, right], at[j:])), to

    def summary(self) -> "_SlewLine":
        return _SlewLine(self)

    def through(self, numbers: list[float], y: float) -> float:
        half = len(numbers) // 2
        at, to = numbers[:half], numbers[half:]
        if y <= at[0]:
            return to[0] - (at[0] - y)
        return to[-1] + (y - at[-1]) if y >= at[-1] else _on_line(at, to, y)


def _on_line(at: list[float], to: list[float], y: float) -> float:
    """Pieces have slope 1 or 0, so a value is taken from the corner before, no further than the corner after."""
    k = int(np.searchsorted(at, y, side="right")) - 1
    return min(to[k] + (y - at[k]), to[k + 1])


class _SlewLine:
    def __init__(self, rule: Slew):
        self.rule, self.at, self.to = rule, np.zeros(0), np.zeros(0)

    def add(self, v: float) -> None:
        self.at, self.to = self.rule.corners(self.at, self.to, v)

    def numbers(self) -> list[float]:
        return [*self.at.tolist(), *self.to.tolist()]


class Clock:
    """Whole numbers are added to a reading until it is not below the last one less ``slack``.

    What is added is the state; a reading makes it max(it + the fall of the readings in whole numbers, 0). Two such maps
    after each other are one, so a segment is its first and last reading and two numbers.
    """

    def __init__(self, slack: float):
        self.slack = slack

    def step(self, y: float, v: float) -> float:
        return v + max(math.ceil(y - self.slack - v), 0)

    def summary(self) -> "_ClockFall":
        return _ClockFall(self)

    def through(self, numbers: list[float], y: float) -> float:
        first, last, fall, least = numbers
        return last + max(max(math.ceil(y - self.slack - first), 0) + fall, least)


class _ClockFall:
    def __init__(self, rule: Clock):
        self.rule, self.first, self.last, self.fall, self.least = rule, None, None, 0, 0

    def add(self, v: float) -> None:
        if self.first is None:
            self.first = v
        else:
            d = math.ceil(self.last - self.rule.slack - v)
            self.fall, self.least = self.fall + d, max(self.least + d, 0)
        self.last = v

    def numbers(self) -> list[float]:
        return [float(x) for x in (self.first, self.last, self.fall, self.least)]


def _keys_of(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*[batch.column(k).to_pylist() for k in names]))


def scan(df: DataFrame, by: Names, order: Names, x: str, out: str, rule: Slew | Clock, long: int = LONG, splits: int = SPLITS) -> DataFrame:
    """by, order, x and ``out``: x in a series' first reading, then ``rule.step`` (last y, x). Rows without x keep the last y,
    and have none before the first reading.

    Rows stream through sorted partitions with one number of state, so time is linear and memory does not grow with a
    series. A series that is cut goes twice: each segment is first reduced to what it does to the number that comes in,
    which gives every segment its own start.
    """
    ship_package(df.sparkSession)
    s = in_segments(df.select(*by, *order, F.col(x).cast("double").alias(x)), by, order, long, splits)
    names = [f"__key{i}" for i in range(len(by))] + ["__seg"]
    named = [F.col(c).alias(k) for c, k in zip(by, names)]
    lay = lambda rows: rows.repartition(*names).sortWithinPartitions(*names, *order)
    rows = s.df.withColumn("__carry", F.lit(None).cast("double"))
    if s.cuts is not None:
        heavy = s.df.join(F.broadcast(s.cuts.select("__key").distinct()), "__key", "left_semi").where(F.col(x).isNotNull())
        lone = lay(heavy.select(*named, "__seg", *order, x))
        kinds = {f.name: f for f in lone.schema.fields}
        maps = lone.select(*names, x).mapInArrow(_fold(names, rule), T.StructType([*[kinds[k] for k in names], T.StructField("__map", T.ArrayType(T.DoubleType())), T.StructField("__from", T.DoubleType())]))
        key = F.struct(*[F.col(k).alias(c) for c, k in zip(by, names)]).alias("__key")
        listed = s.cuts.join(maps.select(key, "__seg", "__map", "__from"), _KEY, "left")
        fields = T.StructType([f for f in s.cuts.select(*_KEY).schema.fields] + [T.StructField("__carry", T.DoubleType())])
        rows = s.df.join(listed.groupBy("__key").applyInArrow(_chain(rule), fields), _KEY, "left")
    rows = lay(rows.select(*named, "__seg", *by, *order, x, "__carry"))
    held = [*by, *order, x]
    return rows.mapInArrow(_stream(names, held, x, out, rule), T.StructType([*[f for f in rows.schema.fields if f.name in held], T.StructField(out, T.DoubleType())]))


def _fold(names: list[str], rule: Slew | Clock):
    """Sorted readings -> what each run of one key does to a number that comes in, and its first reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, first, done, schema = None, None, None, [], None
        for b in batches:
            schema = b.schema
            for k, v in zip(_keys_of(b, names), b.column(b.num_columns - 1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, line.numbers(), first))
                    key, line, first = k, rule.summary(), v
                line.add(v)
            if done:
                yield rows_of(done, schema)
                done = []
        if key is not None:
            yield rows_of([(key, line.numbers(), first)], schema)

    def rows_of(done: list, schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([d[0][i] for d in done], schema.field(k).type) for i, k in enumerate(names)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([d[1] for d in done], pa.list_(pa.float64())), pa.array([d[2] for d in done], pa.float64())], [*names, "__map", "__from"])

    return run


def _chain(rule: Slew | Clock):
    """The segments of one series, at most ``SPLITS`` rows, -> the number that comes into each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("__seg")))
        y, carry = None, []
        for numbers, first in zip(table.column("__map").to_pylist(), table.column("__from").to_pylist()):
            carry.append(y)
            if numbers is not None:  # a series starts at its first reading, which a step from itself does not move
                y = rule.through(numbers, first if y is None else y)
        return table.select(_KEY).append_column("__carry", pa.array(carry, pa.float64()))

    return run


def _stream(names: list[str], held: list[str], x: str, out: str, rule: Slew | Clock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y = None, None
        for b in batches:
            ys = []
            for k, v, c in zip(_keys_of(b, names), b.column(x).to_pylist(), b.column("__carry").to_pylist()):
                if k != key:
                    key, y = k, c
                if v is not None:
                    y = v if y is None else rule.step(y, v)
                ys.append(y)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in held], pa.array(ys, pa.float64())], [*held, out])

    return run
