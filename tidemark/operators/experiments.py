"""Experiment analytics: sweeps, leaderboards, hold-out selection, constraint reports, rollouts, configuration overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quantiles, with_quantiles
from tidemark.session import materialize

Names = Sequence[str]


def leaderboard(df: DataFrame, score: str, order: Names, by: Names = (), digits: int | None = None) -> DataFrame:
    """Adds ``rank``: scores from high to low, equals in the given order; with ``digits`` scores are rounded first.

    Without ``by`` the table is sorted by range; a row's rank is its place in its range and the rows of those before.
    """
    s = F.bround(score, digits) if digits is not None else F.col(score)
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(s.desc_nulls_last(), *order)))
    placed = materialize(df.orderBy(s.desc_nulls_last(), *order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    # the identifier's upper bits number the range, its lower 33 the row in it
    ranges = placed.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    ranges = ranges.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__range", F.shiftright("__at", 33)).join(F.broadcast(ranges), "__range")
    return ranked.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, "rank")


def first_best(df: DataFrame, by: Names, cost: Column, order: Names, take: Names) -> DataFrame:
    """Row of least cost by key, the first in order of equals."""
    key = F.struct(cost.alias("__cost"), *order, *[F.col(c).alias(f"__{c}") for c in take])
    return df.groupBy(*by).agg(F.min(key).alias("__b")).select(*by, F.col("__b.__cost").alias("cost"), *[F.col(f"__b.__{c}").alias(c) for c in take])


def hold_out(df: DataFrame, config: str, part: str, select_on: str, test_on: str, score: str) -> DataFrame:
    """The configuration chosen on one part, its score on the other, the best there, and the regret. One row.

    Scores are means by configuration and part; of equals the first configuration wins.
    """
    m = df.where(F.col(part).isin(select_on, test_on)).groupBy(config).agg(F.avg(F.when(F.col(part) == select_on, F.col(score))).alias("s"), F.avg(F.when(F.col(part) == test_on, F.col(score))).alias("t"))
    best = m.where("s is not null and t is not null").agg(F.min(F.struct((-F.col("s")).alias("k"), F.col(config).alias("c"), "t")).alias("a"), F.min(F.struct((-F.col("t")).alias("k"), F.col(config).alias("c"))).alias("b"))
    return best.select(F.col("a.c").alias("chosen"), (-F.col("a.k")).alias("select_score"), F.col("a.t").alias("test_score"), F.col("b.c").alias("best"), (-F.col("b.k")).alias("best_score"), (-F.col("b.k") - F.col("a.t")).alias("regret"))


def greedy_select(df: DataFrame, item: str, covers: str, rounds: int) -> DataFrame:
    """Items chosen one at a time by how many uncovered things they cover; of equals the least: (round, item, gain).

    A round is one aggregate, whose winner is one row, and one join against what it covers; what is left is written, so
    the plan does not grow. Ends early when nothing is left to cover.
    """
    left = materialize(df.select(F.col(item).alias("i"), F.col(covers).alias("c")).where("i is not null and c is not null").distinct(), "uncovered")
    chosen = None
    for k in range(rounds):
        best = left.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), "i")).alias("b")).where("b is not null")
        best = materialize(best.select(F.lit(k + 1).alias("round"), F.col("b.i").alias(item), (-F.col("b.k")).alias("gain")), "winner")
        chosen = best if chosen is None else chosen.unionByName(best)
        if k + 1 < rounds:
            taken = left.join(F.broadcast(best.select(F.col(item).alias("i"))), "i", "left_semi").select("c")
            left = materialize(left.join(taken, "c", "left_anti").select("i", "c"), "uncovered")
    return chosen


def constraint_report(df: DataFrame, keys: Names, rules: dict[str, Column]) -> DataFrame:
    """A row (keys, rule) for every broken rule; a null test counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def first_offender(report: DataFrame, order: Names) -> DataFrame:
    """First broken row of every rule."""
    return report.groupBy("rule").agg(F.min(F.struct(*order)).alias("b"), F.count(F.lit(1)).alias("n")).select("rule", "n", "b.*")


def slew_violations(df: DataFrame, by: Names, order: Names, x: str, limit: float) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("jump", F.abs(F.col(x) - F.lag(x).over(w))).where(F.col("jump") > limit)


def unpivot_metrics(df: DataFrame, keys: Names, metrics: Names) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def pivot_metrics(long: DataFrame, keys: Names, metrics: Sequence[str]) -> DataFrame:
    """One column a metric; the list is given, so no pass is spent on finding it."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value", True))


def flatten_documents(df: DataFrame, keys: Names, doc: str, paths: dict[str, str]) -> DataFrame:
    """Named numbers out of nested documents, null where missing."""
    v = F.try_parse_json(F.col(doc))
    return df.select(*keys, *[F.try_variant_get(v, p, "double").alias(n) for n, p in paths.items()])


def overlay_config(base: DataFrame, variant: DataFrame, key: str) -> DataFrame:
    """Columns of the variant where it has them, else of the base."""
    v = variant.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in variant.columns if c != key])
    both = base.join(v, key, "left")
    return both.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in variant.columns else F.col(c) for c in base.columns if c != key])


def package_score(df: DataFrame, errors: Names, weights: Sequence[float], scale: float, built: Column) -> Column:
    """Weighted mean of exp(-error / scale); 0 unless built."""
    total = sum(weights)
    s = sum((F.lit(w) * F.exp(-F.col(e) / F.lit(scale)) for e, w in zip(errors[1:], weights[1:])), F.lit(weights[0]) * F.exp(-F.col(errors[0]) / F.lit(scale)))
    return F.when(built, s / F.lit(total)).otherwise(F.lit(0.0))


def matched_gap(a: DataFrame, b: DataFrame, keys: Names, x: str, by: Names = ()) -> DataFrame:
    """Median absolute difference over rows with the same keys."""
    j = a.select(*keys, *[c for c in by if c not in keys], F.col(x).alias("__a")).join(b.select(*keys, F.col(x).alias("__b")), list(keys))
    return with_quantiles(j, by, F.abs(F.col("__a") - F.col("__b")), {"gap": 0.5}, F.count(F.lit(1)).alias("n")).select(*by, "gap", "n")


def best_frame(df: DataFrame, k: str, distance: str) -> DataFrame:
    """Frame of least mean distance, the first of equals."""
    return df.groupBy(k).agg(F.avg(distance).alias("d")).agg(F.min(F.struct("d", k)).alias("b")).select("b.*")


def rest_candidates(df: DataFrame, candidate: str, ratio: Column) -> DataFrame:
    """1st and 99th percentile of a length ratio by candidate."""
    return quantiles(df, [candidate], ratio, {"p1": 0.01, "p99": 0.99})


def trim_tails(df: DataFrame, by: Names, x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two percentiles of their key."""
    cut = quantiles(df, by, F.col(x), {"__lo": low, "__hi": high})
    return df.join(cut, list(by)).where((F.col(x) >= F.col("__lo")) & (F.col(x) <= F.col("__hi"))).drop("__lo", "__hi") if by else df.crossJoin(F.broadcast(cut)).where((F.col(x) >= F.col("__lo")) & (F.col(x) <= F.col("__hi"))).drop("__lo", "__hi")


def upsert(old: DataFrame, new: DataFrame, keys: Names, version: str) -> DataFrame:
    """Union of both, the newest row of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("__new").desc())
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def tail_of(names: DataFrame, name: str, ok: Column) -> DataFrame:
    """Latest name (greatest as text) among those that pass."""
    return names.where(ok).agg(F.max(name).alias(name))
