"""Operators over an ordered series: filling, smoothing, differences, runs, recurrences, resampling.

Each takes a table, the columns that part the series, the columns that order it (together unique), and a value column,
and adds columns. Series are window partitions: one shuffle by the series' key, none where the table is laid out so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, finite
from tidemark.operators.joins import join_hot
from tidemark.operators.series import LONG, Clock, Segments, Slew, framed, in_segments, known_around, positions, previous, running, scan
from tidemark.session import materialize

Names = Sequence[str]


def _w(by: Names, order: Names) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def fill_gaps(df: DataFrame, by: Names, order: Names, x: str, out: str, at: str | None = None, long: int = LONG) -> DataFrame:
    """Missing values by straight lines between the neighbours that are known, flat at the ends, 0 where none is known.

    ``at`` is the numeric place of a row; its row number by default. Series of more than ``long`` rows go in segments.
    """
    s = in_segments(df.withColumn("__v", finite(F.col(x))), by, order, long)
    s = replace(s, df=s.df.withColumn("__p", F.col(at).cast("double"))) if at else positions(s, "__p")
    s = known_around(s, F.when(F.col("__v").isNotNull(), F.struct(F.col("__p").cast("double").alias("p"), F.col("__v").alias("v"))), "__a", "__b")
    a, b, p = F.col("__a"), F.col("__b"), F.col("__p")
    line = a["v"] + (b["v"] - a["v"]) * (p - a["p"]) / (b["p"] - a["p"])
    filled = F.when(F.col("__v").isNotNull(), F.col("__v")).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)
    return s.done().withColumn(out, F.coalesce(filled, F.lit(0.0))).drop("__v", "__p", "__a", "__b")


def moving_mean(df: DataFrame, by: Names, order: Names, x: str, width: int, out: str, long: int = LONG) -> DataFrame:
    """Centred mean of odd ``width``; beyond the ends the end value counts again."""
    h = width // 2
    s = positions(in_segments(df, by, order, long), "__at")
    parts = framed(s, h, lambda w: {"__sum": F.sum(x).over(w), "__n": F.count(F.lit(1)).over(w), "__first": F.first(x).over(w), "__last": F.last(x).over(w)}, long)
    # a frame that is short begins or ends with the series
    before = F.greatest(F.lit(h + 1) - F.col("__at"), F.lit(0))
    after = F.lit(width) - F.col("__n") - before
    total = F.col("__sum") + F.when(before > 0, before * F.col("__first")).otherwise(0.0) + F.when(after > 0, after * F.col("__last")).otherwise(0.0)
    return parts.withColumn(out, total / F.lit(float(width))).drop("__at", "__sum", "__n", "__first", "__last")


def fill_smooth(df: DataFrame, by: Names, order: Names, x: str, width: int, out: str, long: int = LONG) -> DataFrame:
    """:func:`fill_gaps`, then :func:`moving_mean`."""
    return moving_mean(fill_gaps(df, by, order, x, "__f", long=long), by, order, "__f", width, out, long).drop("__f")


def same_convolution(df: DataFrame, by: Names, order: Names, x: str, width: int, out: str) -> DataFrame:
    """Sum over ``width`` rows / width with zeros beyond the ends; an even width reaches one row further back."""
    w = _w(by, order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn(out, F.sum(x).over(w) / F.lit(float(width)))


def first_difference(df: DataFrame, by: Names, order: Names, x: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(x) - F.lag(x).over(_w(by, order)))


def second_difference(df: DataFrame, by: Names, order: Names, x: str, out: str) -> DataFrame:
    w = _w(by, order)
    return df.withColumn(out, F.lead(x).over(w) - 2 * F.col(x) + F.lag(x).over(w))


def _islands(df: DataFrame, by: Names, order: Names, flag: Column) -> DataFrame:
    """Adds __f (0/1) and __run, the number of the run of equal flags that the row is in."""
    w = _w(by, order)
    df = df.withColumn("__f", F.coalesce(flag.cast("int"), F.lit(0)))
    change = F.when(F.col("__f") == F.lag("__f").over(w), 0).otherwise(1)
    return df.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def flag_intervals(df: DataFrame, by: Names, order: Names, flag: Column) -> DataFrame:
    """Runs of a true flag: by, start and end (first and last of the first order column), n."""
    runs = _islands(df, by, order, flag).where("__f = 1")
    return runs.groupBy(*by, "__run").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n")).drop("__run")


def _flip_short(df: DataFrame, by: Names, order: Names, value: int, least: int) -> DataFrame:
    """Runs of ``value`` shorter than ``least`` that touch no end take the other value."""
    df = _islands(df, by, order, F.col("__clean") == 1)
    part = Window.partitionBy(*by)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "__run"))
    inner = (F.col("__run") > 1) & (F.col("__run") < F.max("__run").over(part))
    flip = inner & (F.col("__f") == value) & (size < least)
    return df.withColumn("__clean", F.when(flip, 1 - F.col("__f")).otherwise(F.col("__f"))).drop("__f", "__run")


def clean_runs(df: DataFrame, by: Names, order: Names, flag: Column, min_on: int, min_off: int, out: str, long: int = LONG) -> DataFrame:
    """Inner gaps shorter than ``min_off`` close, then inner runs shorter than ``min_on`` go; runs at the ends stay.

    Where a series is long, runs are counted across its segments and flipped in a table of one row a run.
    """
    df = df.withColumn("__clean", F.coalesce(flag.cast("int"), F.lit(0)))
    s = in_segments(df, by, order, long)
    if s.cuts is None:
        df = _flip_short(_flip_short(s.done(), by, order, 0, min_off), by, order, 1, min_on)
        return df.withColumn(out, F.col("__clean") == 1).drop("__clean")
    numbered = _numbered(s, "__clean", "__run")
    rows = materialize(numbered.df.drop("__seg"), "runs")
    runs = rows.groupBy("__key", "__run").agg(F.max("__clean").alias("__clean"), F.count(F.lit(1)).alias("n"))
    closed = _flip_runs(runs, "__run", 0, min_off).withColumnsRenamed({"__run": "__first", "__key": "__series"})
    merged = _numbered(in_segments(closed, ["__series"], ["__first"], long), "__clean", "__run").done()
    merged = materialize(merged.withColumnRenamed("__series", "__key"), "merged")
    whole = merged.groupBy("__key", "__run").agg(F.max("__clean").alias("__clean"), F.sum("n").alias("n"))
    final = _flip_runs(whole, "__run", 1, min_on).select("__key", "__run", F.col("__clean").alias("__final"), F.col("n").alias("__size"))
    by_run = join_hot(merged.select("__key", "__run", F.col("__first"), "n"), final, ["__key", "__run"], "__size")
    flags = by_run.select("__key", F.col("__first").alias("__run"), "n", "__final")
    return join_hot(rows, flags, ["__key", "__run"], "n").withColumn(out, F.col("__final") == 1).select(*[c for c in df.columns if c != "__clean"], out)


def _numbered(s: Segments, flag: str, out: str) -> Segments:
    """Adds the number, from 1, of the run of equal flags that a row is in."""
    s = previous(s, flag, "__last")
    s = running(s, F.when(F.col(flag).eqNullSafe(F.col("__last")), 0).otherwise(1), out)
    return replace(s, df=s.df.drop("__last"))


def _flip_runs(runs: DataFrame, number: str, value: int, least: int) -> DataFrame:
    """Runs of ``value`` of fewer than ``least`` rows that are neither a series' first nor its last take the other value."""
    last = runs.groupBy("__key").agg(F.max(number).alias("__end"), F.count(F.lit(1)).alias("__runs"))
    runs = join_hot(runs, last, ["__key"], "__runs")
    flip = (F.col(number) > 1) & (F.col(number) < F.col("__end")) & (F.col("__clean") == value) & (F.col("n") < least)
    return runs.select("__key", number, F.when(flip, 1 - F.col("__clean")).otherwise(F.col("__clean")).alias("__clean"), "n")


def withdrawn(df: DataFrame, by: Names, order: Names, seen: Column, out: str, longest: int = 5, width: int = 12, gain: float = 1.6) -> DataFrame:
    """0..1: how far something is withdrawn; gaps longer than ``longest`` or touching an end, smeared and limited."""
    df = _islands(df, by, order, ~seen)
    part = Window.partitionBy(*by)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "__run"))
    edge = (F.col("__run") == 1) | (F.col("__run") == F.max("__run").over(part))
    df = df.withColumn("__g", F.when((F.col("__f") == 1) & (edge | (size > longest)), 1.0).otherwise(0.0))
    df = same_convolution(df, by, order, "__g", width, "__m")
    return df.withColumn(out, clip(F.col("__m") * gain, 0.0, 1.0)).drop("__f", "__run", "__g", "__m")


def _series(df: DataFrame, by: Names, order: Names, x: str) -> DataFrame:
    """One row per series: __s, its (order…, value) structs in order."""
    entry = F.struct(*order, F.col(x).alias("__x"))
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("__s"))


def slew_follow(df: DataFrame, by: Names, order: Names, x: str, limit: float, out: str, long: int = LONG) -> DataFrame:
    """y follows x by at most ``limit`` a row, starting at x. Gives by, order, x and ``out``; rows without x keep the last y."""
    return scan(df, by, order, x, out, Slew(limit), long)


def monotonic_clock(df: DataFrame, by: Names, order: Names, x: str, out: str, slack: float = 0.5, long: int = LONG) -> DataFrame:
    """Whole seconds are added to a reading until it is not below the last one less ``slack``."""
    return scan(df, by, order, x, out, Clock(slack), long)


def resample_path(df: DataFrame, by: Names, order: Names, coords: Names, n: int) -> DataFrame:
    """n points at equal steps of arc length along a path: by, i (0-based) and the coordinates."""
    w = _w(by, order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in coords[1:]), (F.col(coords[0]) - F.lag(coords[0]).over(w)) ** 2))
    df = df.withColumn("__d", F.coalesce(step, F.lit(0.0)))
    df = df.withColumn("__s", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nxt = {c: F.lead(c).over(w) for c in (*coords, "__s")}
    df = df.select(*by, "__s", *coords, *[v.alias(f"__n{c}") for c, v in nxt.items()], F.max("__s").over(Window.partitionBy(*by)).alias("__len"), F.lead("__s").over(w).isNull().alias("__end"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    df = df.select("*", grid).withColumn("__t", F.col("__len") * F.col("i") / F.lit(float(n - 1)))
    here = ((F.col("__t") >= F.col("__s")) & (F.col("__t") < F.col("__n__s"))) | (F.col("__end") & (F.col("__t") >= F.col("__s")))
    f = F.when(F.col("__end"), 0.0).otherwise((F.col("__t") - F.col("__s")) / (F.col("__n__s") - F.col("__s")))
    return df.where(here).select(*by, "i", *[(F.col(c) + F.coalesce(f * (F.col(f"__n{c}") - F.col(c)), F.lit(0.0))).alias(c) for c in coords])


def resample_rows(df: DataFrame, by: Names, order: Names, x: str, n: int) -> DataFrame:
    """n values at equal steps of the row number, by straight lines."""
    s = _series(df, by, order, x)
    last = F.size("__s") - 1
    s = s.select(*by, "__s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("__t", last * F.col("i") / F.lit(float(n - 1)))
    a = F.floor("__t").cast("int")
    va, vb = F.get("__s", a)["__x"], F.get("__s", F.least(a + 1, last))["__x"]
    return s.select(*by, "i", (va + (vb - va) * (F.col("__t") - a)).alias(x))


def trim_still(df: DataFrame, by: Names, order: Names, coords: Names, far: float) -> DataFrame:
    """From the first row further than ``far`` from the start to one row past the last further than ``far`` from the end."""
    w = _w(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = lambda ref: F.sqrt(sum(((F.col(c) - ref(c).over(whole)) ** 2 for c in coords[1:]), (F.col(coords[0]) - ref(coords[0]).over(whole)) ** 2))
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__a", off(F.first) > far).withColumn("__b", off(F.last) > far)
    part = Window.partitionBy(*by)
    df = df.withColumn("__lo", F.min(F.when(F.col("__a"), F.col("__i"))).over(part)).withColumn("__hi", F.max(F.when(F.col("__b"), F.col("__i"))).over(part))
    return df.where("__i between coalesce(__lo, 1) and coalesce(__hi, __i) + 1").drop("__i", "__a", "__b", "__lo", "__hi")


def gaussian_smooth(df: DataFrame, by: Names, order: Names, x: str, sigma: float, out: str, edge: str = "reflect") -> DataFrame:
    """Gaussian weights to four sigma. Beyond the ends: ``reflect`` (end value repeated, then mirrored) or ``nearest``.

    Neighbours come by lag and lead; only the first and last values that mirroring can reach are kept beside each row.
    """
    r = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(weights)
    w, part = _w(by, order), Window.partitionBy(*by)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(x).cast("double")
    df = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(part).cast("int"))
    if edge == "nearest":
        df = df.withColumn("__first", F.first(v).over(whole)).withColumn("__last", F.last(v).over(whole))
        at = lambda k: F.when(F.col("__i") + k < 0, F.col("__first")).when(F.col("__i") + k >= F.col("__n"), F.col("__last")).otherwise(F.lag(v, -k).over(w))
    else:
        near = lambda ok: F.collect_list(F.when(ok, F.struct(v.alias("v")))).over(whole)
        df = df.withColumn("__head", near(F.col("__i") < r)).withColumn("__tail", near(F.col("__i") >= F.col("__n") - r))
        n = F.col("__n")

        def at(k: int) -> Column:
            i = F.col("__i") + k
            m = F.pmod(i, 2 * n)
            j = F.when(m < n, m).otherwise(2 * n - 1 - m)
            far = F.when(j < r, F.get("__head", j)["v"]).otherwise(F.get("__tail", j - (n - F.size("__tail")))["v"])
            return F.when((i < 0) | (i >= n), far).otherwise(F.lag(v, -k).over(w))

    y = sum((at(k) * F.lit(weights[k + r] / total) for k in range(-r + 1, r + 1)), at(-r) * F.lit(weights[0] / total))
    return df.withColumn(out, y).drop("__i", "__n", "__first", "__last", "__head", "__tail")


def median_filter(df: DataFrame, by: Names, order: Names, x: str, width: int, out: str) -> DataFrame:
    """Median of an odd number of neighbours; beyond the ends the end value counts again."""
    h = width // 2
    w = _w(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.coalesce(F.lag(x, -k).over(w), (F.first(x) if k < 0 else F.last(x)).over(whole)) for k in range(-h, h + 1)]
    return df.withColumn(out, F.sort_array(F.array(*near))[h])


def carry_forward(df: DataFrame, by: Names, order: Names, x: str, out: str) -> DataFrame:
    return df.withColumn(out, F.last(x, True).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def still_alive(df: DataFrame, by: Names, order: Names, ok: Column, out: str) -> DataFrame:
    """True while every check up to the row has passed: once lost, lost."""
    return df.withColumn(out, F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)) == 1)


def first_n(df: DataFrame, by: Names, order: Names, n: int) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(_w(by, order))).where(F.col("__i") <= n).drop("__i")


def running_from_start(df: DataFrame, by: Names, order: Names, x: str, out: str) -> DataFrame:
    """Running sum (missing counts as 0) less its first value."""
    w = _w(by, order)
    run = F.sum(F.coalesce(x, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__r", run)
    return df.withColumn(out, F.col("__r") - F.first("__r").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("__r")


def every_nth(df: DataFrame, k: str, step: int) -> DataFrame:
    return df.where(F.col(k) % step == 0)


def smoothstep(x: Column) -> Column:
    t = clip(x, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)
