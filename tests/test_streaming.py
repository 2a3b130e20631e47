"""Streaming operators on rows that the registered tables do not hold."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from siteready.session import shared_dir
from siteready.streaming import streams


def test_step_upsert_over_midnight_and_rows_without_step_or_time(spark):
    at = lambda h, m=0, day=1: datetime(2024, 1, day, h, m)
    schema = "run_id long, step long, line_no long, t_wall timestamp, operation string, seen timestamp"
    files = [
        [(1, 1, 1, at(23, 59), "CLICK", at(1)), (1, 1, 2, at(0, 1, 2), "CLICK done", None), (1, None, 3, at(0, 2, 2), "note", at(2)), (1, 2, 4, None, "no time", None)],
        [(1, 1, 5, at(0, 3, 2), "CLICK again", at(3)), (1, None, 6, None, "neither", None), (2, 1, 1, at(0, 4, 2), "TYPE", None)],
    ]
    path = shared_dir(spark, "steps")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    raw = streams.read_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = streams.drain(streams.stream_steps_upsert(raw, "1 hour"), "upsert", "update").select("run_id", "step", "line_no", "last_line", "operation", F.col("seen"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [
        (1, 1, 1, 2, "CLICK done", None), (1, None, 3, 3, "note", at(2)), (1, 2, 4, 4, "no time", None),
        (1, 1, 1, 5, "CLICK again", at(3)), (1, None, 6, 6, "neither", None), (2, 1, 1, 1, "TYPE", None)]))


def test_step_upsert_of_times_beyond_pandas(spark):
    """Python's nanosecond times end in 2262, its times in 9999."""
    path = shared_dir(spark, "far")
    lines = spark.range(6).selectExpr("1L as run_id", "id div 2 as step", "id as line_no", "timestamp_seconds(1704067200 + id * 100000000000) as t_wall", "concat('o', id) as operation")
    lines.coalesce(1).write.parquet(path)
    raw = streams.read_stream(spark, path, lines.schema)
    got = streams.drain(streams.stream_steps_upsert(raw, "1 hour"), "far", "update").select("step", "line_no", "last_line", "operation").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, "o1"), (1, 2, 3, "o3"), (2, 4, 5, "o5")]


def test_many_keys_are_folded_together(spark):
    """40,000 steps and tasks in one batch: a call of Python for each takes minutes."""
    path = shared_dir(spark, "many")
    lines = spark.range(80_000).selectExpr("id % 7 as run_id", "id div 2 as step", "id as line_no", "timestamp_seconds(1704067200 + id) as t_wall", "concat('o', id) as operation")
    lines.coalesce(2).write.parquet(f"{path}/steps")
    votes = spark.range(120_000).selectExpr("id % 40000 as task_id", "concat('j', id div 80000) as judge_id", "id as arrival", "if(id < 40000 and id % 2 = 0, 'unknown_label', null) as problem", "2 as samples_required")
    votes.coalesce(2).write.parquet(f"{path}/votes")
    began = time.monotonic()
    steps = streams.drain(streams.stream_steps_upsert(streams.read_stream(spark, f"{path}/steps", lines.schema), "1 hour"), "many", "update")
    assert steps.where("line_no = last_line and operation = concat('o', last_line)").count() == 80_000
    done = streams.drain(streams.stream_verdicts(streams.read_stream(spark, f"{path}/votes", votes.schema)), "votes")
    assert {(r.reason, r.n) for r in done.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {
        (None, 80_000), ("unknown_label", 20_000), ("duplicate_judge", 20_000)}
    assert time.monotonic() - began < 60
