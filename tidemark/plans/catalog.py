"""Queries over the driver's tables, each a use of the operators, with the same result as DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import at_path, parse_config
from tidemark.operators import aggregates as A
from tidemark.operators import experiments as X
from tidemark.operators import joins as J
from tidemark.operators import sets as S
from tidemark.operators import windows as W
from tidemark.session import materialize
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("day", F.dayofmonth("ts")).withColumn("sec", F.unix_micros("ts") / 1e6)


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""
    WITH bands(band, lo, hi) AS (VALUES ('early', 1, 11), ('middle', 11, 21), ('late', 21, 32), ('never', 40, 50)),
    kinds AS (SELECT DISTINCT event_type FROM events),
    e AS (SELECT event_type, value, day(ts) AS d FROM events)
    SELECT b.band, k.event_type, count(e.value) AS n, avg(e.value) AS mean, quantile_cont(e.value, 0.5) AS median,
           quantile_cont(e.value, 0.1) AS p10, min(e.value) AS min, max(e.value) AS max
    FROM bands b CROSS JOIN kinds k LEFT JOIN e ON e.event_type = k.event_type AND e.d >= b.lo AND e.d < b.hi GROUP BY 1, 2
""")
def summarize_by_band(spark, sf):
    bands = spark.createDataFrame([("early", 1, 11), ("middle", 11, 21), ("late", 21, 32), ("never", 40, 50)], "band string, lo int, hi int")
    e = events(spark, sf)
    return A.band_summary(e, bands, e.select("event_type").distinct(), ["event_type"], "day", "value").select("band", "event_type", "n", "mean", "median", "p10", "min", "max")


@query("""
    SELECT l_returnflag, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS median,
           quantile_cont(l_extendedprice, 0.1) AS p10, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1
""")
def summarize_all(spark, sf):
    return A.summarize(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""
    WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    n AS (SELECT s, count(*) AS c FROM p GROUP BY 1),
    i AS (SELECT a.s AS s1, b.s AS s2, count(*) AS c FROM p a JOIN p b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2)
    SELECT x.s AS s1, y.s AS s2, coalesce(i.c, 0) / greatest(x.c + y.c - coalesce(i.c, 0), 1) AS iou
    FROM n x JOIN n y ON x.s < y.s LEFT JOIN i ON i.s1 = x.s AND i.s2 = y.s
""")
def set_iou_pairs(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    return _iou_pairs(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).join(s, "s"))


def _iou_pairs(p, block=4096):
    """Every pair s1 < s2 of sets (s, p) and its intersection over union.

    A part hands each of its sets the list of those after it, so shared parts are counted where s1 is. All other pairs are
    made last, from blocks of sets less those that share a part with s1: no pair enters a shuffle unless it shares one.
    """
    p = materialize(p.distinct(), "members")
    n = materialize(p.groupBy("s").agg(F.count(F.lit(1)).alias("c")), "sizes")
    lists = p.where("p is not null").groupBy("p").agg(F.sort_array(F.collect_list("s")).alias("all")).select(F.posexplode("all").alias("i", "s1"), "all")
    later = lists.where(F.col("i") + 1 < F.size("all")).select("s1", F.slice("all", F.col("i") + 2, F.size("all")).alias("later")).repartition("s1")
    shared = materialize(later.select("s1", F.explode("later").alias("s2")).groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("c")), "shared")
    of = lambda k: n.select(F.col("s").alias(f"s{k}"), F.col("c").alias(f"c{k}"))
    some = shared.join(of(1), "s1").join(of(2), "s2").select("s1", "s2", (F.col("c") / (F.col("c1") + F.col("c2") - F.col("c"))).alias("iou"))
    placed = J.numbered(n.select("s"), ["s"], "j")[0].select("s", F.floor(F.col("j") / block).alias("b"))
    blocks = placed.groupBy("b").agg(F.collect_list("s").alias("all"))
    known = shared.join(placed.select(F.col("s").alias("s2"), "b"), "s2").groupBy("s1", "b").agg(F.collect_list("s2").alias("known"))
    each = placed.select(F.col("s").alias("s1"), F.col("b").alias("own")).join(F.broadcast(blocks.select("b")), F.col("own") <= F.col("b"))
    rest = each.join(known, ["s1", "b"], "left").join(F.broadcast(blocks), "b")
    after = F.when(F.col("own") == F.col("b"), F.filter("all", lambda y: y > F.col("s1"))).otherwise(F.col("all"))
    none = rest.select("s1", F.explode(F.array_except(after, F.coalesce("known", F.array().cast("array<bigint>")))).alias("s2"), F.lit(0.0).alias("iou"))
    return some.unionByName(none)


@query("""
    WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'),
    b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
    unknown AS (SELECT p_partkey FROM part WHERE p_size > 40),
    u AS (SELECT s, p, max(x) AS a, max(y) AS b FROM (SELECT s, p, 1 AS x, 0 AS y FROM a UNION ALL SELECT s, p, 0, 1 FROM b) WHERE p NOT IN (SELECT p_partkey FROM unknown) GROUP BY 1, 2)
    SELECT s, sum(a * b) / greatest(count(*), 1) AS iou FROM u GROUP BY 1
""")
def masked_iou(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), "l_returnflag")
    unknown = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("p"))
    known = S.difference(li, unknown, ["p"])
    return A.set_overlap(known.where("l_returnflag = 'A'"), known.where("l_returnflag = 'R'"), ["s"], ["p"])


@query("""
    WITH m AS (
        SELECT event_type, 'value' AS metric, value AS v FROM events UNION ALL SELECT event_type, 'max_hour', hour(ts)::DOUBLE FROM events
        UNION ALL SELECT event_type, 'depth_k', try_cast(json_extract(props, '$.k') AS DOUBLE) FROM events)
    SELECT event_type, max(CASE WHEN metric = 'value' THEN a END) AS value, max(CASE WHEN metric = 'max_hour' THEN a END) AS max_hour, max(CASE WHEN metric = 'depth_k' THEN a END) AS depth_k
    FROM (SELECT event_type, metric, CASE WHEN metric LIKE '%depth%' OR metric LIKE '%max%' THEN quantile_cont(v, 0.5) ELSE avg(v) END AS a FROM m GROUP BY 1, 2) GROUP BY 1
""")
def band_pivot(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value", F.hour("ts").cast("double").alias("max_hour"), at_path(F.col("props"), "$.k").alias("depth_k"))
    long = X.unpivot_metrics(e, ["event_type", "event_id"], ["value", "max_hour", "depth_k"])
    return X.pivot_metrics(A.mean_or_median(long, ["event_type"], "metric", "value"), ["event_type"], ["value", "max_hour", "depth_k"])


@query("""
    WITH g AS (SELECT user_id, quantile_cont(CASE WHEN event_type = 'click' THEN value END, 0.5) AS sim, quantile_cont(CASE WHEN event_type = 'view' THEN value END, 0.5) AS st,
                      count(CASE WHEN event_type = 'click' THEN 1 END) AS n FROM events GROUP BY 1 HAVING count(CASE WHEN event_type = 'click' THEN 1 END) >= 5)
    SELECT avg(sim) AS value, avg(st) AS baseline, count(*) AS n, (avg(sim) / avg(st) - 1) * 100 AS change FROM g WHERE st >= 15
""")
def motion_seeds_change(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    g = e.groupBy("user_id").agg(F.percentile(pick("click"), 0.5).alias("sim"), F.percentile(pick("view"), 0.5).alias("st"), F.count(pick("click")).alias("n_click")).where("n_click >= 5")
    far = A.moving_groups(e.withColumn("st", pick("view")).join(g.select("user_id"), "user_id", "left_semi"), "user_id", "st", 15.0)
    return A.change_percent(g, far, "user_id", "sim", "st").select("value", "baseline", "n", "change")


@query("SELECT l_returnflag, 1 - avg(abs(l_discount - l_tax)) / greatest(avg(l_discount + l_tax), 1e-9) AS explained FROM lineitem GROUP BY 1")
def explained_motion(spark, sf):
    return A.explained(table(spark, sf, "lineitem"), ["l_returnflag"], F.abs(F.col("l_discount") - F.col("l_tax")), F.col("l_discount") + F.col("l_tax"))


@query("""
    SELECT c.event_id, c.user_id, (SELECT p.event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id
        ORDER BY abs(epoch_us(p.ts) - epoch_us(c.ts)), p.ts, p.event_id LIMIT 1) AS purchase_id FROM events c WHERE c.event_type = 'click'
""")
def nearest_asof(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("t"))
    got = J.nearest_in_time(e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'"), ["user_id"], "t", "t", ["event_id"])
    return got.select("event_id", "user_id", F.col("near_event_id").alias("purchase_id"))


@query("""
    SELECT event_id, least(greatest(round_even((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600.0, 0)::BIGINT, 0), 500) AS step_even,
           least(greatest(ceil((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600.0 - 0.5)::BIGINT, 0), 500) AS step_first
    FROM events
""")
def grid_steps(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.unix_micros("ts") / 1e6 - 1704067200.0).alias("s"))
    k = F.col("s") / 3600.0
    return e.select("event_id", J.step_of_frame(k, 1.0, 1.0, 501).alias("step_even"), J.step_of_frame_first(k, 1.0, 1.0, 501).alias("step_first"))


@query("""
    WITH s AS (SELECT user_id, epoch_us(ts)::DOUBLE AS t, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    q AS (SELECT event_id, user_id, epoch_us(ts)::DOUBLE AS t FROM events WHERE event_type = 'error'),
    b AS (SELECT q.*, (SELECT max(s.t) FROM s WHERE s.user_id = q.user_id AND s.t <= q.t) AS ta, (SELECT min(s.t) FROM s WHERE s.user_id = q.user_id AND s.t >= q.t) AS tb FROM q)
    SELECT b.event_id, CASE WHEN ta IS NULL THEN y.v WHEN tb IS NULL OR ta = tb THEN x.v ELSE x.v + (y.v - x.v) * (b.t - ta) / (tb - ta) END AS value
    FROM b LEFT JOIN s x ON x.user_id = b.user_id AND x.t = ta LEFT JOIN s y ON y.user_id = b.user_id AND y.t = tb
""")
def interp_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("t"))
    q = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    return J.interpolate_at(q, e.where("event_type = 'view'"), ["user_id"], "t", "t", "value", "v").select("event_id", F.col("v").alias("value"))


@query("""
    WITH x AS (SELECT event_id, user_id, row_number() OVER u AS i, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN event_type <> 'error' THEN value END AS v FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS ia, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM x),
    f AS (SELECT b.event_id, b.user_id, b.i, b.n, coalesce(CASE WHEN b.v IS NOT NULL THEN b.v WHEN ia IS NULL THEN y.v WHEN ib IS NULL THEN p.v ELSE p.v + (y.v - p.v) * (b.i - ia) / (ib - ia)::DOUBLE END, 0) AS f
          FROM b LEFT JOIN x p ON p.user_id = b.user_id AND p.i = ia LEFT JOIN x y ON y.user_id = b.user_id AND y.i = ib)
    SELECT event_id, (sum(f) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(4 - i, 0) * first(f) OVER w + greatest(i + 3 - n, 0) * last(f) OVER w) / 7.0 AS smooth
    FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def fill_smooth(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return W.fill_smooth(e, ["user_id"], ["ts", "event_id"], "v", 7, "smooth").select("event_id", "smooth")


@query("""
    SELECT event_id, value - lag(value) OVER u AS speed, lead(value) OVER u - 2 * value + lag(value) OVER u AS accel FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def diff2(spark, sf):
    e = W.first_difference(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", "speed")
    return W.second_difference(e, ["user_id"], ["ts", "event_id"], "value", "accel").select("event_id", "speed", "accel")


@query("""
    WITH x AS (SELECT user_id, ts, event_id, (value > 10)::INT AS f FROM events),
    c AS (SELECT *, CASE WHEN f = lag(f) OVER u THEN 0 ELSE 1 END AS c FROM x WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM r WHERE f = 1 GROUP BY user_id, run
""")
def contact_intervals(spark, sf):
    e = table(spark, sf, "events")
    return W.flag_intervals(e, ["user_id"], ["ts", "event_id"], F.col("value") > 10).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""
    WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (value > 25)::INT AS f FROM events),
    c1 AS (SELECT *, CASE WHEN f = lag(f) OVER u THEN 0 ELSE 1 END AS c FROM x WINDOW u AS (PARTITION BY user_id ORDER BY i)),
    r1 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c1),
    s1 AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, max(run) OVER (PARTITION BY user_id) AS top FROM r1),
    y AS (SELECT user_id, event_id, i, CASE WHEN f = 0 AND run > 1 AND run < top AND n < 3 THEN 1 ELSE f END AS f FROM s1),
    c2 AS (SELECT *, CASE WHEN f = lag(f) OVER u THEN 0 ELSE 1 END AS c FROM y WINDOW u AS (PARTITION BY user_id ORDER BY i)),
    r2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c2),
    s2 AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, max(run) OVER (PARTITION BY user_id) AS top FROM r2)
    SELECT event_id, CASE WHEN f = 1 AND run > 1 AND run < top AND n < 4 THEN false ELSE f = 1 END AS clean FROM s2
""")
def clean_runs(spark, sf):
    return W.clean_runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 25, 4, 3, "clean").select("event_id", "clean")


@query("""
    WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (value <= 40)::INT AS gone FROM events),
    c AS (SELECT *, CASE WHEN gone = lag(gone) OVER u THEN 0 ELSE 1 END AS c FROM x WINDOW u AS (PARTITION BY user_id ORDER BY i)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c),
    s AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, max(run) OVER (PARTITION BY user_id) AS top FROM r),
    g AS (SELECT *, CASE WHEN gone = 1 AND (run = 1 OR run = top OR n > 5) THEN 1.0::DOUBLE ELSE 0.0 END AS g FROM s)
    SELECT event_id, least(greatest(sum(g) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12.0::DOUBLE * 1.6::DOUBLE, 0), 1) AS w FROM g
""")
def withdraw(spark, sf):
    return W.withdrawn(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 40, "w").select("event_id", "w")


@query("""
    WITH RECURSIVE x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, value AS y FROM x WHERE i = 1
          UNION ALL SELECT x.user_id, x.event_id, x.i, f.y + least(greatest(x.value - f.y, -5), 5) FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
    SELECT event_id, y FROM f
""")
def slew_follow(spark, sf):
    return W.slew_follow(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5.0, "y").select("event_id", "y")


@query("""
    WITH RECURSIVE x AS (SELECT user_id, event_id, second(ts)::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, s AS y FROM x WHERE i = 1
          UNION ALL SELECT x.user_id, x.event_id, x.i, x.s + greatest(ceil(f.y - 0.5 - x.s), 0) FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
    SELECT event_id, y FROM f
""")
def clock_repair(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.second("ts").cast("double"))
    return W.monotonic_clock(e, ["user_id"], ["ts", "event_id"], "s", "y").select("event_id", "y")


@query("""
    WITH x AS (SELECT event_id, user_id, ts, value FROM events)
    SELECT event_id, list_sort([coalesce(lag(value) OVER u, value), value, coalesce(lead(value) OVER u, value)])[2] AS med FROM x WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def median_filter(spark, sf):
    return W.median_filter(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 3, "med").select("event_id", "med")


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER u AS carried, min((value > 1)::INT) OVER u = 1 AS alive
    FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def carry_and_alive(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    e = W.carry_forward(e, ["user_id"], ["ts", "event_id"], "p", "carried")
    return W.still_alive(e, ["user_id"], ["ts", "event_id"], F.col("value") > 1, "alive").select("event_id", "carried", "alive")


@query("""
    WITH x AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
    SELECT o_custkey, quantile_cont(o_totalprice, 0.3) AS value, count(*) AS n FROM x WHERE i <= 5 GROUP BY 1
""")
def first_n_percentile(spark, sf):
    return A.first_n_percentile(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5, "o_totalprice", 0.3)


@query("""
    WITH v AS (SELECT l_suppkey AS s, l_extendedprice AS x FROM lineitem),
    m1 AS (SELECT s, quantile_cont(x, 0.5) AS m FROM v GROUP BY 1), d1 AS (SELECT v.s, x, abs(x - m) AS d FROM v JOIN m1 USING (s)),
    a1 AS (SELECT s, quantile_cont(d, 0.5) AS a FROM d1 GROUP BY 1), v1 AS (SELECT d1.s, x FROM d1 JOIN a1 USING (s) WHERE d <= greatest(1.0 * 1.4826 * a, 100.0)),
    m2 AS (SELECT s, quantile_cont(x, 0.5) AS m FROM v1 GROUP BY 1), d2 AS (SELECT v1.s, x, abs(x - m) AS d FROM v1 JOIN m2 USING (s)),
    a2 AS (SELECT s, quantile_cont(d, 0.5) AS a FROM d2 GROUP BY 1), v2 AS (SELECT d2.s, x FROM d2 JOIN a2 USING (s) WHERE d <= greatest(1.0 * 1.4826 * a, 100.0)),
    n AS (SELECT s, count(*) AS n_all FROM v GROUP BY 1), o AS (SELECT s, quantile_cont(x, 0.5) AS value, count(*) AS n FROM v2 GROUP BY 1)
    SELECT n.s AS l_suppkey, value, coalesce(o.n, 0) AS n, n_all FROM n LEFT JOIN o USING (s)
""")
def robust_fuse(spark, sf):
    return A.robust_fuse(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 1.0, 100.0)


@query("""
    WITH m AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS mo, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
    SELECT l_partkey, quantile_cont(m, 0.5) AS median_of_means, count(*) AS cells FROM m GROUP BY 1
""")
def two_level_mean(spark, sf):
    return A.two_level(table(spark, sf, "lineitem").withColumn("mo", F.date_trunc("month", "l_shipdate")), ["l_partkey", "mo"], ["l_partkey"], "l_quantity")


@query("""
    WITH v AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, (1 + l_linenumber)::DOUBLE AS w FROM lineitem),
    m AS (SELECT g, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM v GROUP BY 1),
    l AS (SELECT g, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2) AS a, any_value(mx) AS mx, any_value(my) AS my FROM v JOIN m USING (g) GROUP BY 1),
    e AS (SELECT v.*, abs(a * x + my - a * mx - y) AS e FROM v JOIN l USING (g)), c AS (SELECT g, quantile_cont(e, 0.5) AS m FROM e GROUP BY 1),
    k AS (SELECT e.* FROM e JOIN c USING (g) WHERE e < 3.0::DOUBLE * m + 1e-9),
    m2 AS (SELECT g, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM k GROUP BY 1),
    l2 AS (SELECT g, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2) AS a, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n FROM k JOIN m2 USING (g) GROUP BY 1)
    SELECT g AS l_returnflag, round(a, 4) AS slope, round(my - a * mx, 2) AS intercept, n FROM l2
""")
def trimmed_affine(spark, sf):
    r = A.trimmed_line(table(spark, sf, "lineitem").withColumn("w", 1 + F.col("l_linenumber")), ["l_returnflag"], "l_quantity", "l_extendedprice", weight="w")
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("""
    SELECT p_brand, quantile_cont(l_extendedprice / p_retailprice, 0.5) AS scale, round(stddev_pop(ln(l_extendedprice / p_retailprice)), 8) AS log_spread, count(*) AS n
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_retailprice > 0 AND l_extendedprice > 0 GROUP BY 1
""")
def ratio_scale(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.ratio_scale(j, ["p_brand"], "l_extendedprice", "p_retailprice").withColumn("log_spread", F.round("log_spread", 8))


_D2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"
_KNN = f"WITH d AS (SELECT a.vec_id, b.vec_id AS near, {_D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, near) AS rank FROM d)"


def _neighbours(spark, sf, k):
    e = table(spark, sf, "embeddings")
    return J.neighbours(e, e, "vec_id", "vec_id", "embedding", k)


@query(_KNN + " SELECT vec_id, near AS near_vec_id, round(d2, 6) AS d2 FROM r WHERE rank = 1")
def nn_embeddings(spark, sf):
    return _neighbours(spark, sf, 1).select("vec_id", "near_vec_id", F.round("d2", 6).alias("d2"))


@query(_KNN + """ SELECT r.vec_id, round(sum(1 / (sqrt(d2) + 1e-4) * e.label) / sum(1 / (sqrt(d2) + 1e-4)), 5) AS label FROM r JOIN embeddings e ON e.vec_id = near WHERE rank <= 4 GROUP BY 1""")
def idw_knn4(spark, sf):
    n = _neighbours(spark, sf, 4)
    return J.inverse_distance(n, table(spark, sf, "embeddings"), "vec_id", "near_vec_id", "vec_id", "label", "label").select("vec_id", F.round("label", 5).alias("label"))


@query(_KNN + """ SELECT a.vec_id, a.near AS near_vec_id FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.rank = 1 AND b.rank = 2 WHERE sqrt(a.d2) < 0.97 * sqrt(b.d2)""")
def ratio_test(spark, sf):
    return J.ratio_test(_neighbours(spark, sf, 2), "vec_id", "near_vec_id", 0.97).select("vec_id", "near_vec_id")


@query("""
    WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    d AS (SELECT a.vec_id, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id)
    SELECT vec_id, count(*) FILTER (d < 0.1) AS n, min(d) AS nearest FROM d WHERE d <= 0.1 GROUP BY 1 HAVING count(*) FILTER (d < 0.1) >= 3 AND min(d) <= 0.05
""")
def radius_join(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    near = J.radius_join(e, e, "vec_id", "vec_id", "xyz", 0.1, strict=False).where("vec_id <> near_vec_id")
    g = near.groupBy("vec_id").agg(F.sum((F.col("d") < 0.1).cast("long")).alias("n"), F.min("d").alias("nearest"))
    return g.where("n >= 3 and nearest <= 0.05")


@query("""
    WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), m AS (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM p)
    SELECT floor((x - a) / 0.1)::BIGINT AS cell_x, floor((y - b) / 0.1)::BIGINT AS cell_y, floor((z - c) / 0.1)::BIGINT AS cell_z, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n FROM p, m GROUP BY 1, 2, 3
""")
def voxel_cluster(spark, sf):
    e = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    v = S.voxel_means(e, "xyz", 0.1)
    return v.select("cell_x", "cell_y", "cell_z", *[F.round(c, 9).alias(c) for c in "xyz"], "n")


_EDGES = "WITH e AS (SELECT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


def _part_pairs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    j = li.withColumnRenamed("l_partkey", "p").join(li.withColumnRenamed("l_partkey", "q"), "l_orderkey").where("p < q")
    return S.undirected_edges(j, "p", "q")


@query(_EDGES + " SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2")
def edges_of(spark, sf):
    return _part_pairs(spark, sf)


@query(_EDGES + " SELECT a, b FROM e GROUP BY 1, 2 HAVING count(*) = 1")
def boundary_once(spark, sf):
    return _part_pairs(spark, sf).where("n = 1").select("a", "b")


@query("""
    WITH c AS (SELECT DISTINCT s_nationkey AS x, (s_suppkey % 10) AS y FROM supplier)
    SELECT c.x, c.y, (SELECT count(*) FROM c d WHERE (abs(d.x - c.x) = 1 AND d.y = c.y) OR (d.x = c.x AND abs(d.y - c.y) = 1)) AS degree FROM c
""")
def grid_degree(spark, sf):
    return S.grid_degree(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 10).alias("y")))


@query("""
    WITH c AS (SELECT DISTINCT s_nationkey::BIGINT AS u, (s_suppkey % 20)::BIGINT AS v FROM supplier),
    near AS (SELECT c.u, c.v, count(*) AS n FROM c JOIN c d ON abs(c.u - d.u) <= 1 AND abs(c.v - d.v) <= 1 GROUP BY 1, 2)
    SELECT u, v, n = 9 AS inner_px FROM near
""")
def erode_pixels(spark, sf):
    px = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("u"), (F.col("s_suppkey") % 20).alias("v")).distinct()
    return px.join(S.erode(px, []).withColumn("i", F.lit(True)), ["u", "v"], "left").select("u", "v", F.coalesce("i", F.lit(False)).alias("inner_px"))


@query("""
    WITH c AS (SELECT DISTINCT s_nationkey::BIGINT AS u, (s_suppkey % 20)::BIGINT AS v FROM supplier), o AS (SELECT unnest(range(-2, 3)) AS d)
    SELECT DISTINCT u + a.d AS u, v + b.d AS v FROM c, o a, o b WHERE a.d * a.d + b.d * b.d <= 4
""")
def dilate_pixels(spark, sf):
    px = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("u"), (F.col("s_suppkey") % 20).alias("v"))
    return S.dilate(px, [], 2, "disc")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_nationkey * 1000000 + floor(c_acctbal)::BIGINT + 100000000 AS b FROM customer),
    eb AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM eb UNION SELECT eb.b, r.root FROM r JOIN eb ON eb.a = r.node)
    SELECT node, min(root) AS root FROM r GROUP BY 1
""")
def components(spark, sf):
    """Customers joined by nation and whole balance: most stand alone with their balance, some share one."""
    e = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("a"), (F.col("c_nationkey") * 1000000 + F.floor("c_acctbal") + 100000000).cast("long").alias("b"))
    return S.min_label_components(e)


@query("""
    WITH RECURSIVE p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) < 0.05),
    r(node, root) AS (SELECT vec_id, vec_id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
    SELECT node AS vec_id, min(root) AS root FROM r GROUP BY 1
""")
def point_clusters(spark, sf):
    """Points joined by chains of neighbours nearer than 0.05."""
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    near = J.radius_join(e, e, "vec_id", "vec_id", "xyz", 0.05).where("vec_id <> near_vec_id")
    return S.min_label_components(near.select(F.col("vec_id").alias("a"), F.col("near_vec_id").alias("b")), e.select(F.col("vec_id").alias("node"))).select(F.col("node").alias("vec_id"), "root")


@query("""
    WITH d AS (SELECT l_suppkey AS c, CASE WHEN year(l_shipdate) <= 1997 THEN 'select' ELSE 'test' END AS part, l_quantity AS s FROM lineitem),
    m AS (SELECT c, avg(CASE WHEN part = 'select' THEN s END) AS s, avg(CASE WHEN part = 'test' THEN s END) AS t FROM d GROUP BY 1),
    ok AS (SELECT * FROM m WHERE s IS NOT NULL AND t IS NOT NULL),
    a AS (SELECT * FROM ok ORDER BY s DESC, c LIMIT 1), b AS (SELECT * FROM ok ORDER BY t DESC, c LIMIT 1)
    SELECT a.c AS chosen, a.s AS select_score, a.t AS test_score, b.c AS best, b.t AS best_score, b.t - a.t AS regret FROM a, b
""")
def holdout_rank(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("c"), F.when(F.year("l_shipdate") <= 1997, "select").otherwise("test").alias("part"), F.col("l_quantity").alias("s"))
    return X.hold_out(d, "c", "part", "select", "test", "s")


@query("""
    SELECT s_suppkey, score, row_number() OVER (ORDER BY round_even(score, 0) DESC, s_suppkey) AS rank FROM (SELECT s_suppkey, s_acctbal / 1000 AS score FROM supplier)
""")
def leaderboard(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("score"))
    return X.leaderboard(s, "score", ["s_suppkey"], digits=0).select("s_suppkey", "score", F.col("rank").cast("long").alias("rank"))


@query("""
    SELECT source, avg(quality) AS rate, count(quality) AS n, grouping(source)::INT AS total FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)
""")
def success_by_group(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return A.rate_by(j, "source", F.col("quality"))


@query("""
    SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median, count(*) AS n, grouping(o_orderpriority)::INT AS total FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def median_by_region(spark, sf):
    return A.median_by(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@query("""
    WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
    SELECT c_mktsegment, quantile_cont(abs(a.v - b.v), 0.5) AS gap, count(*) AS n FROM y a JOIN y b ON a.o_custkey = b.o_custkey JOIN customer ON c_custkey = a.o_custkey WHERE a.y = 1996 AND b.y = 1997 GROUP BY 1
""")
def matched_gap(spark, sf):
    y = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return X.matched_gap(y.where("y = 1996").join(c, "o_custkey"), y.where("y = 1997"), ["o_custkey"], "v", ["c_mktsegment"])


@query("""
    WITH p AS (SELECT b.turn - a.turn AS gap, abs(length(a.text) - length(b.text)) AS d, a.turn = 0 AS first FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn + 1)
    SELECT quantile_cont(d, 0.5) FILTER (gap <= 2) AS near, quantile_cont(d, 0.5) FILTER (gap BETWEEN 3 AND 9) AS mid, quantile_cont(d, 0.5) FILTER (gap >= 10) AS far, quantile_cont(d, 0.5) FILTER (first) AS from_first,
           count(*) FILTER (gap <= 2) AS n_near, count(*) FILTER (gap BETWEEN 3 AND 9) AS n_mid, count(*) FILTER (gap >= 10) AS n_far, count(*) FILTER (first) AS n_from_first FROM p
""")
def gap_class_medians(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    p = J.gap_pairs(c, ["conv_id"], "turn", "n", 1).withColumn("d", F.abs(F.col("n_i") - F.col("n_j"))).withColumn("gap", F.col("j") - F.col("i"))
    g = F.col("gap")
    return A.class_medians(p, "d", {"near": g <= 2, "mid": g.between(3, 9), "far": g >= 10, "from_first": F.col("i") == 0})


@query("""
    WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), n AS (SELECT count(DISTINCT y) AS n FROM y)
    SELECT l_suppkey, y, q FROM y WHERE l_suppkey IN (SELECT l_suppkey FROM y GROUP BY 1 HAVING count(DISTINCT y) = (SELECT n FROM n))
""")
def common_pairs(spark, sf):
    y = table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("y")).agg(F.sum("l_quantity").alias("q"))
    n = y.select("y").distinct().count()  # the number of years: one number
    return J.common_to_all(y, ["l_suppkey"], "y", n, "q").select("l_suppkey", "y", "q")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rule FROM lineitem, (VALUES ('discount'), ('quantity'), ('tax')) r(rule)
    WHERE (rule = 'discount' AND NOT l_discount <= 0.09) OR (rule = 'quantity' AND NOT l_quantity BETWEEN 2 AND 49) OR (rule = 'tax' AND NOT l_tax < 0.08)
""")
def constraint_report(spark, sf):
    return X.constraint_report(table(spark, sf, "lineitem"), LINE_KEY, {"discount": F.col("l_discount") <= 0.09, "quantity": F.col("l_quantity").between(2, 49), "tax": F.col("l_tax") < 0.08})


@query("""
    SELECT event_id, jump FROM (SELECT event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS jump FROM events) WHERE jump > 100
""")
def slew_violations(spark, sf):
    return X.slew_violations(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 100.0).select("event_id", "jump")


@query("""
    SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN (40 * exp(-abs(s_acctbal) / 10000) + 20 * exp(-s_nationkey / 10000.0::DOUBLE) + 20 * exp(-(s_suppkey % 7) / 10000.0::DOUBLE) + 20 * exp(-length(s_name) / 10000.0::DOUBLE)) / 100 ELSE 0 END AS score FROM supplier
""")
def score_decay(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("a"), F.col("s_nationkey").alias("b"), (F.col("s_suppkey") % 7).alias("c"), F.length("s_name").alias("d"), (F.col("s_acctbal") > 0).alias("ok"))
    return s.select("s_suppkey", X.package_score(s, ["a", "b", "c", "d"], [40.0, 20.0, 20.0, 20.0], 10000.0, F.col("ok")).alias("score"))


@query("""
    SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type AS name, event_id::VARCHAR AS id FROM events
""")
def config_parse(spark, sf):
    e = table(spark, sf, "events")
    m = parse_config(F.concat(F.lit("name="), "event_type", F.lit(",id="), F.col("event_id").cast("string")))
    return e.select("event_id", at_path(F.col("props"), "$.k").alias("k"), m["name"].alias("name"), m["id"].alias("id"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_exact(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("""
    SELECT l_returnflag, (avg(l_quantity * l_extendedprice) - avg(l_quantity) * avg(l_extendedprice)) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice) + 1e-9) AS ncc, count(*) AS n FROM lineitem GROUP BY 1
""")
def cross_correlation(spark, sf):
    return A.correlation(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("""
    WITH c AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders) SELECT o_orderkey, o_totalprice FROM orders, c WHERE o_totalprice BETWEEN a AND b
""")
def trim_tails(spark, sf):
    return X.trim_tails(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice")


@query("""
    SELECT p_brand, CASE WHEN c / n >= 0.03 THEN p_type ELSE 'other' END AS p_type FROM (
        SELECT p_brand, p_type, c, sum(c) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY 1, 2)) WHERE r = 1
""")
def dominant_label(spark, sf):
    return A.dominant_label(table(spark, sf, "part"), ["p_brand"], "p_type", 0.03)


@query("""
    WITH t AS (SELECT l_orderkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1), k AS (SELECT least(lo, hi) || ':' || greatest(lo, hi) AS key, l_orderkey FROM t)
    SELECT key, min(l_orderkey) AS l_orderkey FROM k GROUP BY 1
""")
def first_occurrence(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"))
    k = t.withColumn("key", F.concat_ws(":", F.least("lo", "hi").cast("string"), F.greatest("lo", "hi").cast("string")))
    return S.first_occurrence(k, F.col("key"), ["l_orderkey"]).select("key", "l_orderkey")


@query("""
    WITH old AS (SELECT o_custkey, o_orderdate AS d, o_totalprice AS p, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_custkey, o_orderdate, o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 2 = 1),
    u AS (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new)
    SELECT o_custkey, k AS o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, n DESC) AS r FROM u) WHERE r = 1
""")
def upsert_newest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return X.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


_BRANDS = "WITH j AS (SELECT DISTINCT p_brand AS i, l_orderkey AS c FROM lineitem JOIN part ON p_partkey = l_partkey)"
for _k in range(1, 4):
    _old = f"w{_k - 1}" if _k > 1 else ""
    _left = f"SELECT * FROM l{_k - 1} WHERE c NOT IN (SELECT c FROM l{_k - 1} WHERE i = (SELECT i FROM {_old}))" if _k > 1 else "SELECT * FROM j"
    _BRANDS += f", l{_k} AS MATERIALIZED ({_left}), w{_k} AS MATERIALIZED (SELECT {_k} AS round, i, count(*) AS gain FROM l{_k} GROUP BY i ORDER BY gain DESC, i LIMIT 1)"


@query(_BRANDS + " SELECT round, i AS p_brand, gain FROM w1 UNION ALL SELECT round, i, gain FROM w2 UNION ALL SELECT round, i, gain FROM w3")
def greedy_select(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_orderkey")
    return X.greedy_select(j, "p_brand", "l_orderkey", 3)
