"""Aggregates of the metric layer. Percentiles are exact; sums combine before the shuffle where Spark can.

Groups that are cells, frames or objects take Spark's ``percentile``: their size is that of the thing measured. Where a group
may be a large part of the table (all rows, a band, a region) ``quantiles`` finds the same numbers without bringing a
group's values into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite
from tidemark.operators.joins import HOT, join_hot
from tidemark.session import materialize, stored_bytes

Names = Sequence[str]


#: Accuracy of a round's sketch and the ranks it is asked for: a round leaves about 4 in GRID of a bracket's rows.
ACCURACY, GRID = 10_000, 1_000
#: Values that are ordered in one place; a bracket of more goes through another round.
FEW = 10_000
#: Tables with fewer stored bytes have no group that is too large for Spark's ``percentile``.
SMALL_BYTES = 64 << 20


def quantiles(df: DataFrame, by: Names, x: Column, wanted: dict[str, float], few: int = FEW, small: int = SMALL_BYTES) -> DataFrame:
    """by and one column for each wanted quantile of x, exact, by straight lines between ranks; null for groups without x.
    With no ``by`` there is one row.

    Groups of ``few`` values, and small tables by the planner's statistics, take Spark's ``percentile``. Larger groups are
    narrowed down (``_narrowed``): rounds of sketches and counts, so no sort, window or array ever holds more than ``few``
    values of a group. The rounds run while the query is built.
    """
    by, names = list(by), list(wanted)
    rows = df.select(F.struct(*by).alias("__key") if by else F.lit(0).alias("__key"), finite(x).alias("__x"))
    whole = rows.groupBy("__key") if by else rows.groupBy()
    direct = [F.percentile("__x", F.array(*[F.lit(float(q)) for q in wanted.values()])).alias("__qs")]  # one buffer for all
    apart = lambda g: g.select("*", *[F.get("__qs", F.lit(i)).alias(n) for i, n in enumerate(names)])
    give = lambda g: g.select(*[F.col(f"__key.{c}").alias(c) for c in by], *names)
    size = stored_bytes(df)
    if size and size < small:
        return give(apart(whole.agg(*direct)))
    rows = materialize(rows, "values")
    facts = rows.groupBy("__key").agg(F.count("__x").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.percentile_approx("__x", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]), F.lit(ACCURACY)).alias("grid"))
    large = materialize(facts.where(F.col("n") > few), "large")
    if not by:
        return give(apart(whole.agg(*direct)) if large.isEmpty() else _narrowed(rows, large, wanted, few))
    keys = large.select("__key")
    rest = rows.join(F.broadcast(keys) if keys.count() <= HOT else keys, "__key", "left_anti")
    small_ones = apart(rest.groupBy("__key").agg(*direct)).drop("__qs")
    return give(small_ones.unionByName(_narrowed(rows, large, wanted, few)))


def _bracket(grid: Column, n: Column, first: Column, last: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Values between which the ranks ``first`` and ``last`` of n lie, from a grid of quantiles that are off by n / ACCURACY."""
    step = F.lit(float(GRID)) / n
    j, k = F.floor(first * step - 1).cast("int"), F.ceil((last + 1) * step + 1).cast("int")
    return F.when(j <= 0, lo).otherwise(F.get(grid, j)), F.when(k >= GRID, hi).otherwise(F.get(grid, k))


def _narrowed(rows: DataFrame, large: DataFrame, wanted: dict[str, float], few: int) -> DataFrame:
    """(__key, wanted quantiles) of the groups in ``large``.

    Each quantile needs two ranks. A round reads the rows once: it counts what lies below and inside each bracket and
    sketches the inside, which gives a bracket of about 4 in ``GRID`` of its rows; counts prove that the ranks are in it. A
    bracket of one value is that value. When none holds more than ``few`` rows, the insides are ordered.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("pos")) for i, q in enumerate(wanted.values())]))
    state = large.select("*", asked.alias("a")).select("__key", "n", "a.i", "a.pos", F.floor("a.pos").alias("first"), F.ceil("a.pos").alias("last"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "lo", "hi", "grid")
    solved = None
    while True:
        within = (F.col("first") - F.col("below"), F.col("last") - F.col("below"))
        lo, hi = _bracket(F.col("grid"), F.col("inside"), *within, F.col("lo"), F.col("hi"))
        state = materialize(state.select("__key", "n", "i", "pos", "first", "last", lo.alias("lo"), hi.alias("hi")), "brackets")
        met = _meeting(rows.where("__x is not null"), state)
        inside = F.when(F.col("__x") >= F.col("lo"), F.col("__x"))
        facts = met.groupBy("__key", "i").agg(F.sum((F.col("__x") < F.col("lo")).cast("long")).alias("below"), F.count(inside).alias("inside"), F.min(inside).alias("lo"), F.max(inside).alias("hi"), F.percentile_approx(inside, F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]), F.lit(ACCURACY)).alias("grid"))
        good = (F.col("below") <= F.col("first")) & (F.col("last") < F.col("below") + F.col("inside"))
        checked = F.when(good, F.col("below")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("long"))
        state = materialize(state.drop("lo", "hi").join(facts, ["__key", "i"]).withColumn("below", checked), "counts")
        one = state.where("lo = hi").select("__key", "i", "pos", F.col("lo").alias("a"), F.col("lo").alias("z"))
        solved = one if solved is None else solved.unionByName(one)
        state = state.where("lo < hi")
        most = state.agg(F.max("inside").alias("n")).first().n
        if most is None or most <= few:
            break
    listed = _meeting(rows.where("__x is not null"), state.drop("grid", "below", "inside")).where("__x >= lo").groupBy("__key", "i").agg(F.sort_array(F.collect_list("__x")).alias("vs"))
    at = lambda rank: F.get("vs", (F.col(rank) - F.col("below")).cast("int"))
    rest = state.join(listed, ["__key", "i"]).select("__key", "i", "pos", at("first").alias("a"), at("last").alias("z"))
    value = F.col("a") + (F.col("z") - F.col("a")) * (F.col("pos") - F.floor("pos"))
    every = solved.unionByName(rest).select("__key", "i", value.alias("v"))
    return every.groupBy("__key").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(wanted)])


def _meeting(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows beside each of their group's brackets that they do not exceed. Up to ``HOT`` groups' brackets are broadcast."""
    packed = state.groupBy("__key").agg(F.max("n").alias("__n"), F.collect_list(F.struct("i", "lo", "hi")).alias("__b"))
    packed = materialize(packed, "packed")
    met = rows.join(F.broadcast(packed), "__key") if packed.count() <= HOT else join_hot(rows, packed, ["__key"], "__n")
    return met.select("__key", "__x", F.explode(F.filter("__b", lambda b: F.col("__x") <= b["hi"])).alias("b")).select("__key", "__x", "b.i", "b.lo", "b.hi")


def with_quantiles(df: DataFrame, by: Names, x: Column, wanted: dict[str, float], *others: Column) -> DataFrame:
    """by, ``others`` aggregated, and ``quantiles``; one pass where the table is small."""
    by, v = list(by), finite(x)
    size = stored_bytes(df)
    if size and size < SMALL_BYTES:
        g = df.groupBy(*by).agg(*others, F.percentile(v, F.array(*[F.lit(float(q)) for q in wanted.values()])).alias("__qs"))
        return g.select("*", *[F.get("__qs", F.lit(i)).alias(n) for i, n in enumerate(wanted)]).drop("__qs")
    rest = df.groupBy(*by).agg(*others)
    q = quantiles(df, by, x, wanted)
    if not by:
        return rest.crossJoin(F.broadcast(q))
    keys = F.lit(True)
    for c in by:
        keys = keys & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return rest.join(q.select(*[F.col(c).alias(f"__r_{c}") for c in by], *wanted), keys, "left").drop(*[f"__r_{c}" for c in by])


def summary_columns(x: Column, prefix: str = "") -> list[Column]:
    """n, mean, median, p10, min, max of finite values; all but n are null where there is none."""
    v = finite(x)
    return [
        F.count(v).alias(f"{prefix}n"),
        F.avg(v).alias(f"{prefix}mean"),
        F.percentile(v, 0.5).alias(f"{prefix}median"),
        F.percentile(v, 0.1).alias(f"{prefix}p10"),
        F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"),
    ]


def summarize(df: DataFrame, by: Names, x: str) -> DataFrame:
    """by, n, mean, median, p10, min, max of finite values, for groups of any size."""
    v = finite(F.col(x))
    s = with_quantiles(df, by, F.col(x), {"median": 0.5, "p10": 0.1}, F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return s.select(*by, "n", "mean", "median", "p10", "min", "max")


def band_summary(df: DataFrame, bands: DataFrame, by: DataFrame | None, keys: Names, k: str, x: str) -> DataFrame:
    """Summary by band [lo, hi) of ``k`` and keys; bands (and keys of ``by``) without rows stay with n = 0.

    ``bands`` (band, lo, hi) is a dimension of a few rows, and the only side that is broadcast.
    """
    frame = bands if by is None else by.crossJoin(F.broadcast(bands))
    hit = df.join(F.broadcast(bands), (F.col(k) >= F.col("lo")) & (F.col(k) < F.col("hi")))
    got = summarize(hit, ["band", *keys], x)
    return frame.select("band", *keys).join(got, ["band", *keys], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def overlap_ratio(both: DataFrame, by: Names, in_a: str, in_b: str) -> DataFrame:
    """Intersection over union of two sets given as rows with membership flags; an empty union counts as one."""
    a, b = F.coalesce(F.col(in_a), F.lit(False)), F.coalesce(F.col(in_b), F.lit(False))
    i, u = F.sum((a & b).cast("long")), F.sum((a | b).cast("long"))
    return both.groupBy(*by).agg((i / F.greatest(u, F.lit(1))).alias("iou"), i.alias("n_both"), u.alias("n_any"))


def set_overlap(a: DataFrame, b: DataFrame, by: Names, item: Names) -> DataFrame:
    """IoU of two item sets by key, by one tagged union: no join, duplicates count once."""
    tag = lambda df, x, y: df.select(*by, *item, F.lit(x).alias("__a"), F.lit(y).alias("__b"))
    u = tag(a, 1, 0).unionByName(tag(b, 0, 1)).groupBy(*by, *item).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    n = F.sum(F.col("__a") * F.col("__b"))
    return u.groupBy(*by).agg((n / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("iou"))


def guarded_median(df: DataFrame, by: Names, x: Column, more_than: int, out: str) -> DataFrame:
    """Median, null unless more than so many rows support it."""
    m = with_quantiles(df, by, x, {"__m": 0.5}, F.count(finite(x)).alias("__n"))
    return m.select(*by, F.when(F.col("__n") > more_than, F.col("__m")).alias(out))


def pooled_and_grouped(df: DataFrame, group: str, x: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(one pooled median over all rows, medians of groups with at least ``least`` rows). Pooled is not a median of medians."""
    v = finite(F.col(x))
    pooled = with_quantiles(df, [], F.col(x), {"median": 0.5}, F.count(v).alias("n")).select("median", "n")
    by = with_quantiles(df, [group], F.col(x), {"median": 0.5}, F.count(v).alias("n")).where(F.col("n") >= least).select(group, "median", "n")
    return pooled, by


def moving_groups(df: DataFrame, group: str, baseline: str, far: float) -> DataFrame:
    """Groups whose baseline median is at least ``far``."""
    return quantiles(df, [group], F.col(baseline), {"m": 0.5}).where(F.col("m") >= far).select(group)


def change_percent(by_group: DataFrame, groups: DataFrame, group: str, value: str, baseline: str) -> DataFrame:
    """Mean of both columns over the chosen groups and the change in percent; nulls where no group is left."""
    c = by_group.join(groups, group, "left_semi").agg(F.avg(value).alias("value"), F.avg(baseline).alias("baseline"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("change", (F.col("value") / F.col("baseline") - 1) * 100)


def explained(df: DataFrame, by: Names, error: Column, baseline: Column) -> DataFrame:
    """1 - mean(error) / max(mean(baseline), 1e-9): a ratio of means."""
    return df.groupBy(*by).agg((1.0 - F.avg(error) / F.greatest(F.avg(baseline), F.lit(1e-9))).alias("explained"))


def correlation(df: DataFrame, by: Names, a: str, b: str, soft: float = 1e-9) -> DataFrame:
    """Normalised cross-correlation with a term that keeps the denominator from zero."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    cov = F.covar_pop(x, y)
    return df.groupBy(*by).agg((cov / (F.stddev_pop(x) * F.stddev_pop(y) + F.lit(soft))).alias("ncc"), F.count(F.lit(1)).alias("n"))


def robust_fuse(df: DataFrame, by: Names, x: str, k: float, least: float, rounds: int = 2, few: int = FEW) -> DataFrame:
    """Median by cell after rejecting, ``rounds`` times, values further from it than max(k * 1.4826 * MAD, least).

    Gives by, value, n (values left) and n_all; cells without a value are left out. One shuffle brings a cell's values into
    one array; cells of more than ``few`` values are narrowed down by ``quantiles`` instead.
    """
    by = list(by)
    v = df.select(F.struct(*by).alias("__key"), finite(F.col(x)).alias("__v")).where("__v is not null")
    sizes = v.groupBy("__key").agg(F.count(F.lit(1)).alias("n_all"))
    size = stored_bytes(df)
    heavy = None
    if not size or size >= SMALL_BYTES:
        heavy = materialize(sizes.where(F.col("n_all") > few), "cells")
        heavy = None if heavy.isEmpty() else heavy
    light = v if heavy is None else v.join(heavy.select("__key"), "__key", "left_anti")
    cells = light.groupBy("__key").agg(F.sort_array(F.collect_list("__v")).alias("__s")).withColumn("n_all", F.size("__s").cast("long"))
    for _ in range(rounds):
        far = lambda s, m: F.greatest(F.lit(k * 1.4826) * _middle(F.array_sort(F.transform(s, lambda y: F.abs(y - m)))), F.lit(least))
        kept = lambda s, m: _with(far(s, m), lambda d: F.filter(s, lambda y: F.abs(y - m) <= d))
        cells = cells.withColumn("__s", _with(F.col("__s"), lambda s: _with(_middle(s), lambda m: kept(s, m))))
    out = cells.select("__key", _middle(F.col("__s")).alias("value"), F.size("__s").cast("long").alias("n"), "n_all")
    if heavy is not None:
        live = v.join(heavy.select("__key"), "__key", "left_semi")
        for _ in range(rounds):
            off = join_hot(live, quantiles(live, ["__key"], F.col("__v"), {"__m": 0.5}, few).join(heavy, "__key"), ["__key"], "n_all").withColumn("__d", F.abs(F.col("__v") - F.col("__m"))).drop("n_all")
            mad = quantiles(off, ["__key"], F.col("__d"), {"__mad": 0.5}, few).join(heavy, "__key")
            live = materialize(join_hot(off, mad, ["__key"], "n_all").where(F.col("__d") <= F.greatest(F.lit(k * 1.4826) * F.col("__mad"), F.lit(least))).select("__key", "__v"), "live")
        large = with_quantiles(live, ["__key"], F.col("__v"), {"value": 0.5}, F.count(F.lit(1)).alias("n"))
        out = out.unionByName(large.join(heavy, "__key").select(*out.columns))
    return out.select(*[F.col(f"__key.{c}").alias(c) for c in by], "value", "n", "n_all")


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though used for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _middle(s: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def two_level(df: DataFrame, inner: Names, outer: Names, x: str) -> DataFrame:
    """Mean by inner cell, then median of the means by outer cell."""
    means = df.groupBy(*inner).agg(F.avg(x).alias("__m"))
    return with_quantiles(means, outer, F.col("__m"), {"median_of_means": 0.5}, F.count(F.lit(1)).alias("cells")).select(*outer, "median_of_means", "cells")


def first_n_percentile(df: DataFrame, by: Names, order: Names, n: int, x: str, pct: float) -> DataFrame:
    from tidemark.operators.windows import first_n

    return first_n(df, by, order, n).groupBy(*by).agg(F.percentile(F.col(x), pct).alias("value"), F.count(F.lit(1)).alias("n"))


def weighted_line(df: DataFrame, by: Names, x: Column, y: Column, w: Column | None = None) -> DataFrame:
    """Weighted least squares y = a x + b: by, a, b, from sums that combine before the shuffle. Values are taken from their
    means, so large offsets cost no digits: without weights as the sums grow, in one pass, else by a pass for the means."""
    if w is None:
        u, v = x.cast("double"), y.cast("double")
        return df.groupBy(*by).agg(F.regr_slope(v, u).alias("a"), F.regr_intercept(v, u).alias("b"))
    rows = df.select(*by, x.cast("double").alias("__x"), y.cast("double").alias("__y"), w.cast("double").alias("__w")).where("__x is not null and __y is not null and __w > 0")
    mean = rows.groupBy(*by).agg((F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")).alias("__mx"), (F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).alias("__my"))
    off = rows.join(mean, list(by)) if by else rows.crossJoin(F.broadcast(mean))
    dx, dy = F.col("__x") - F.col("__mx"), F.col("__y") - F.col("__my")
    g = off.groupBy(*by).agg(F.sum(F.col("__w") * dx * dy).alias("__xy"), F.sum(F.col("__w") * dx * dx).alias("__xx"), F.first("__mx").alias("__mx"), F.first("__my").alias("__my"))
    a = F.when(F.col("__xx") > 0, F.col("__xy") / F.col("__xx"))
    return g.select(*by, a.alias("a"), (F.col("__my") - a * F.col("__mx")).alias("b"))


def trimmed_line(df: DataFrame, by: Names, x: str, y: str, keep: float = 3.0, weight: str | None = None) -> DataFrame:
    """Weighted least squares y = a x + b, once more without rows whose residual is not under ``keep`` times the median
    residual: by, slope, intercept, n (rows of the second fit). Weights are 1 by default; the median does not weigh."""
    w = F.col(weight) if weight else None
    one = weighted_line(df, by, F.col(x), F.col(y), w)
    e = F.abs(F.col("a") * F.col(x).cast("double") + F.col("b") - F.col(y).cast("double"))
    off = (df.join(one, list(by)) if by else df.crossJoin(F.broadcast(one))).withColumn("__e", e)
    med = quantiles(off, by, F.col("__e"), {"__m": 0.5})
    kept = (off.join(med, list(by)) if by else off.crossJoin(F.broadcast(med))).where(F.col("__e") < keep * F.col("__m") + 1e-9).drop("a", "b")
    n = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    two = weighted_line(kept, by, F.col(x), F.col(y), w).select(*by, F.col("a").alias("slope"), F.col("b").alias("intercept"))
    return two.join(n, list(by)) if by else two.crossJoin(F.broadcast(n))


def ratio_scale(df: DataFrame, by: Names, num: str, den: str) -> DataFrame:
    """Median ratio and spread of its logarithm, over positive ratios."""
    r = F.col(num) / F.col(den)
    ok = df.where((F.col(den) > 0) & (F.col(num) > 0))
    return with_quantiles(ok, by, r, {"scale": 0.5}, F.stddev_pop(F.log(r)).alias("log_spread"), F.count(F.lit(1)).alias("n")).select(*by, "scale", "log_spread", "n")


def class_medians(df: DataFrame, x: str, classes: dict[str, Column]) -> DataFrame:
    """Medians of overlapping classes, and their sizes: each row counts once for every class it is in."""
    v = finite(F.col(x))
    of = F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in classes.items()]), lambda c: c.isNotNull()))
    long = with_quantiles(df.select(of.alias("__class"), v.alias("__v")), ["__class"], F.col("__v"), {"__m": 0.5}, F.count("__v").alias("__n"))
    pick = lambda name, c: F.max(F.when(F.col("__class") == name, F.col(c)))
    return long.agg(*[pick(name, "__m").alias(name) for name in classes], *[F.coalesce(pick(name, "__n"), F.lit(0)).cast("long").alias(f"n_{name}") for name in classes])


def rate_by(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """Share of successes by group and over all (group null, ``total`` 1)."""
    return df.select(F.col(group).alias("g"), ok.cast("double").alias("s")).rollup("g").agg(F.avg("s").alias("rate"), F.count("s").alias("n"), F.grouping("g").cast("int").alias("total")).withColumnRenamed("g", group)


def median_by(df: DataFrame, group: str, x: str) -> DataFrame:
    """Median by group and over all (group null, ``total`` 1)."""
    both = df.select(F.explode(F.array(F.struct(F.col(group).alias("g"), F.lit(0).alias("total")), F.struct(F.lit(None).cast(df.schema[group].dataType).alias("g"), F.lit(1).alias("total")))).alias("s"), F.col(x).cast("double").alias("v"))
    both = both.select(F.col("s.g").alias(group), F.col("s.total").alias("total"), "v")
    return with_quantiles(both, [group, "total"], F.col("v"), {"median": 0.5}, F.count("v").alias("n")).select(group, "median", "n", "total")


def mean_or_median(long: DataFrame, by: Names, metric: str, value: str, median_if: str = "depth|max") -> DataFrame:
    """Per metric the median where its name matches, else the mean. Only values of metrics whose name matches are ordered.

    Of larger tables, metrics of at most about ``FEW`` numbers are counted by number, in sums that combine before the shuffle;
    the others are for ``quantiles``.
    """
    v, asked = finite(F.col(value)), F.col(metric).rlike(median_if)
    keys = [*by, metric]
    of = F.when(asked, F.col("__m")).otherwise(F.col("__a")).alias("value")
    size = stored_bytes(long)
    if size and size < SMALL_BYTES:
        g = with_quantiles(long, keys, F.when(asked, F.col(value)), {"__m": 0.5}, F.avg(v).alias("__a"), F.count(v).alias("n"))
        return g.select(*keys, of, "n")
    rows = long.select(F.struct(*keys).alias("__key"), metric, v.alias("__x"))
    facts = materialize(rows.groupBy("__key").agg(F.avg("__x").alias("__a"), F.count("__x").alias("n"), F.approx_count_distinct(F.when(asked, F.col("__x"))).alias("__d")), "facts")
    many = facts.where(F.col("__d") > FEW).select("__key")
    wanted = rows.where(asked & F.col("__x").isNotNull()).select("__key", "__x")
    counted = wanted.join(many, "__key", "left_anti").groupBy("__key", "__x").agg(F.count(F.lit(1)).alias("__c"))
    medians = counted.groupBy("__key").agg(F.percentile("__x", 0.5, F.col("__c")).alias("__m"))
    if not many.isEmpty():
        medians = medians.unionByName(quantiles(wanted.join(many, "__key", "left_semi"), ["__key"], F.col("__x"), {"__m": 0.5}))
    return facts.join(medians, "__key", "left").select(*[F.col(f"__key.{c}").alias(c) for c in keys], F.when(F.col(f"__key.{metric}").rlike(median_if), F.col("__m")).otherwise(F.col("__a")).alias("value"), "n")


def band_extremes(df: DataFrame, band: str, x: str) -> DataFrame:
    """Mean, least and n by band and over all."""
    v = finite(F.col(x))
    return df.select(F.col(band).alias("g"), v.alias("v")).rollup("g").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.count("v").alias("n"), F.grouping("g").cast("int").alias("total")).withColumnRenamed("g", band)


def alternating_calibration(df: DataFrame, frame: str, x: str, y: str, rounds: int = 10, least: int = 3, a: float = 3.0, b: float = 5.0, keep: float = 3.0) -> DataFrame:
    """y = a x + b_frame: per-frame median offsets and one slope, in turn, from the given start: (frame, a, b, n).

    Frames with fewer than ``least`` rows keep the offset ``b`` while the slope is found and are left out of the result.
    The slope is that of rows whose residual is under ``keep`` times the median residual. A round is two small aggregates
    and one exact median over all rows; only the slope comes to the driver.
    """
    rows = materialize(df.select(F.col(frame).alias("f"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null"), "calibration")

    def offsets(a: float) -> DataFrame:
        return rows.groupBy("f").agg(F.percentile(F.col("y") - F.lit(a) * F.col("x"), 0.5).alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)

    for _ in range(rounds):
        off = rows.join(offsets(a), "f", "left").withColumn("r", F.col("y") - F.coalesce("b", F.lit(b))).withColumn("e", F.abs(F.col("r") - F.lit(a) * F.col("x")))
        cut = quantiles(off, [], F.col("e"), {"m": 0.5}).first().m
        z = off.where(F.col("e") < keep * (cut or 0.0) + 1e-6).agg(F.sum(F.col("x") * F.col("r")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx")).first()
        a = z.xy / z.xx if z.xx else a
    return offsets(a).select(F.col("f").alias(frame), F.lit(a).alias("a"), "b", "n")


def percent_errors(df: DataFrame, x: str) -> DataFrame:
    v = finite(F.col(x))
    return with_quantiles(df, [], F.col(x), {"median": 0.5, "p90": 0.9}, F.count(v).alias("n")).select("median", "p90", "n")


def scatter(df: DataFrame, index: str, x: str) -> DataFrame:
    """Sum, least and count at each index."""
    return df.groupBy(index).agg(F.sum(x).alias("sum"), F.min(x).alias("min"), F.count(F.lit(1)).alias("n"))


def dominant_label(df: DataFrame, by: Names, label: str, share: float = 0.3, other: str = "other") -> DataFrame:
    """Most frequent label, or ``other`` under the share; of equals the least."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
    g = n.groupBy(*by).agg(F.sum("c").alias("all"), F.min(F.struct((-F.col("c")).alias("m"), F.col(label).alias("l"))).alias("b"))
    return g.select(*by, F.when(-F.col("b.m") / F.col("all") >= share, F.col("b.l")).otherwise(F.lit(other)).alias(label))
