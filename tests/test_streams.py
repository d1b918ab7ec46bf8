"""Stateful streams beside the batch operators: arrival in any order, restarts, late rows, silence."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.streaming import extensions as T

START = datetime.datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp, x double"


def at(seconds):
    return START + datetime.timedelta(seconds=float(seconds))


class Feed:
    """A folder that a stream reads a file a trigger, in the order in which they were added."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0
        os.makedirs(self.path)

    def add(self, rows):
        self.n += 1
        held = f"{self.path}-part{self.n}"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(held)
        (part,) = [f for f in os.listdir(held) if f.endswith(".parquet")]
        os.rename(f"{held}/{part}", f"{self.path}/{self.n:03d}.parquet")
        os.utime(f"{self.path}/{self.n:03d}.parquet", (1_700_000_000 + self.n,) * 2)

    def stream(self):
        return T.event_stream(self.spark, self.path, self.spark.createDataFrame([], SCHEMA).schema)


def readings(seed, n=90):
    r = np.random.default_rng(seed)
    return [(k, at(i + 0.25 * k), None if r.random() < 0.1 else float(r.uniform(-9, 9))) for i in range(n) for k in range(3)]


FORMS = {
    "slew": (lambda s: T.slew_follow(s, "k", "ts", "x", 2.0, "20 seconds", 3_600_000, ordered=True), lambda df: W.slew_follow(df, ["k"], ["ts"], "x", 2.0, "y")),
    "clock": (lambda s: T.monotonic_clock(s, "k", "ts", "x", 0.5, "20 seconds", 3_600_000, ordered=True), lambda df: W.monotonic_clock(df, ["k"], ["ts"], "x", "y")),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_stopped_and_started_again(spark, tmp_path, form):
    """Rows come out of order, the stream stops in the middle and goes on from its checkpoint: the batch result, each row once."""
    flow, batch = FORMS[form]
    rows = readings(1)
    feed, out, check = Feed(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    r = np.random.default_rng(5)
    parts = [rows[lo : lo + 54] for lo in range(0, len(rows), 54)]
    for part in parts[:3]:
        feed.add([part[i] for i in r.permutation(len(part))])
    T.append_to(flow(feed.stream()), out, check)
    first = spark.read.parquet(out).count()
    for part in parts[3:]:
        feed.add([part[i] for i in r.permutation(len(part))])
    feed.add([(9, at(5000), 0.0)])
    feed.add([(9, at(9000), 0.0)])
    T.append_to(flow(feed.stream()), out, check)
    got = {(x.k, x.ts): x.y for x in spark.read.parquet(out).where("k < 9").collect()}
    want = {(x.k, x.ts): x.y for x in batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 0 < first < len(rows) and got == pytest.approx(want) and spark.read.parquet(out).where("k < 9").count() == len(rows)


def test_late_rows_are_those_of_a_batch_without_them(spark, tmp_path):
    """A row behind the watermark changes nothing; one that is out of order but in time counts in its place."""
    feed, out, check = Feed(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    early = [(1, at(s), v) for s, v in ((0, 1.0), (10, 9.0), (40, 2.0))]
    in_time, late = [(1, at(30), -5.0), (1, at(41), 8.0)], [(1, at(2), 99.0)]
    feed.add(early)
    feed.add([(2, at(41), 0.0)])
    feed.add(in_time + late)
    feed.add([(9, at(5000), 0.0)])
    feed.add([(9, at(9000), 0.0)])
    T.append_to(T.slew_follow(feed.stream(), "k", "ts", "x", 2.0, "20 seconds", 3_600_000, ordered=True), out, check)
    got = {x.ts: x.y for x in spark.read.parquet(out).where("k = 1").collect()}
    want = {x.ts: x.y for x in W.slew_follow(spark.createDataFrame(early + in_time, SCHEMA), ["k"], ["ts"], "x", 2.0, "y").collect()}
    assert got == want


def test_a_silent_key_starts_anew(spark, tmp_path):
    feed, out, check = Feed(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    feed.add([(1, at(0), 0.0), (1, at(1), 50.0)])
    feed.add([(2, at(4000), 0.0)])
    feed.add([(2, at(4001), 0.0)])
    feed.add([(1, at(8000), 50.0)])
    T.append_to(T.slew_follow(feed.stream(), "k", "ts", "x", 2.0, "1 second", 1_000_000), out, check)
    assert [x.y for x in spark.read.parquet(out).where("k = 1").orderBy("ts").collect()] == [0.0, 2.0, 50.0]


def test_runs_in_order(spark, tmp_path):
    feed, out, check = Feed(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    r = np.random.default_rng(6)
    rows = [(k, at(i), float(r.random() < 0.3 + 0.4 * (i // 10 % 2))) for k in range(2) for i in range(60)]
    by_time = sorted(rows, key=lambda x: x[1])
    for lo in range(0, len(rows), 30):
        part = by_time[lo : lo + 30]
        feed.add([part[i] for i in r.permutation(len(part))])
    feed.add([(9, at(900_000), 0.0)])
    feed.add([(9, at(1_900_000), 0.0)])
    flow = T.clean_runs(feed.stream().withColumn("f", F.col("x").cast("int")), "k", "ts", "f", 3, 2, "15 seconds", 3_600_000, ordered=True)
    T.append_to(flow, out, check)
    want = W.clean_runs(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts"], F.col("x") == 1, 3, 2, "clean")
    assert {(x.k, x.ts): x.clean for x in spark.read.parquet(out).where("k < 9").collect()} == {(x.k, x.ts): x.clean for x in want.collect()}
