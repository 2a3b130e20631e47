"""Structured Streaming forms of the step, event, verdict and score operators.

Built-in state wherever it expresses the rule (aggregations, session windows, interval joins). The five rules that
need their own state keep a few values per key and fold a micro-batch's rows in order, many keys in one call; bound a
micro-batch with maxFilesPerTrigger or maxBytesPerTrigger. Sinks write one folder per batch id, so a replayed batch replaces itself.
"""

from __future__ import annotations

import json
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteready.dims import constants as K
from siteready.dims.catalog import Catalog, default_catalog
from siteready.operators import scoring as S
from siteready.session import shared_dir
from siteready.sources.run_table import RunTable
from siteready.streaming.stateful import rocksdb_state


def read_stream(spark: SparkSession, path: str, schema: Ty.StructType, fmt: str = "parquet", files_per_trigger: int | None = None,
                pattern: str | None = None) -> DataFrame:
    """A file stream over a folder with an explicit schema; each new file is read once."""
    r = spark.readStream.schema(schema).format(fmt)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def drain(df: DataFrame, name: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over what is available now into per-batch folders, and reads them back with their batch_id.

    timers: the stream has operators of ``stateful``, which need the state store with timers."""
    spark = df.sparkSession
    base = shared_dir(spark, name)
    empty = spark.createDataFrame([], df.schema).withColumn("batch_id", F.lit(-1).cast("long"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    empty.write.mode("overwrite").parquet(f"{base}/out/batch=-1")
    with rocksdb_state(spark) if timers else nullcontext():
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{base}/out/batch=*")


def stream_rates(events: DataFrame, keys: list[str], window: str, slide: str | None, delay: str) -> DataFrame:
    """Actions, errors and dead clicks per window. events: ts, is_action, is_error, is_dead and the keys."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(
        F.count_if("is_action").alias("actions"), F.count_if("is_error").alias("errors"), F.count_if("is_dead").alias("dead"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "actions", "errors", "dead")


def stream_sessions(events: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Sessions closed by inactivity: a quiet page, or a journey's end. Emitted once, when the watermark passes."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("is_dead").alias("dead"), F.max("ts").alias("last_ts"))
    return g.select(*keys, F.col("w.start").alias("start"), "last_ts", "steps", "dead")


def stream_dead_clicks(clicks: DataFrame, responses: DataFrame, key: str, within: str, delay: str) -> DataFrame:
    """Every click with its responses within the interval; a click without one comes out alone: it is dead.

    clicks: key, click_id, click_ts. responses: key, resp_id, resp_ts.
    """
    c = clicks.withWatermark("click_ts", delay).alias("c")
    r = responses.withWatermark("resp_ts", delay).alias("r")
    on = (F.col(f"c.{key}") == F.col(f"r.{key}")) & (F.col("resp_ts") >= F.col("click_ts")) & (F.col("resp_ts") <= F.col("click_ts") + F.expr(f"interval {within}"))
    return c.join(r, on, "left_outer").select(F.col(f"c.{key}").alias(key), "click_id", "resp_id")


# Keys are folded in this many groups: a call of Python for each group, not for each key, and one state row for all keys
# of a group, which is written again when one of them has rows. More groups suit streams of many millions of live keys.
BUCKETS = 1024


def stream_steps_upsert(raw: DataFrame, delay: str, idle_ms: int = 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """Last-write-wins steps as an update stream: the execution line shows at once, the measurement line replaces it.

    A step's state is dropped when the watermark is ``idle_ms`` past its newest line, whatever days its lines fall on.
    Rows without a step are no update of another and rows without a time have no watermark: both pass through as they
    are, as their own first and last line. The watermark moves in whole seconds. raw: run_id, step, line_no, t_wall and
    content columns.
    """
    content = [f for f in raw.schema if f.name not in ("run_id", "step", "line_no", "t_wall")]
    kind = {f.name: f.dataType.simpleString() for f in raw.schema}
    named = Ty.StructType([raw.schema["run_id"], raw.schema["step"]])
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    packed = F.to_json(F.struct(*[F.col(f.name) for f in content]), exact)
    idle = idle_ms // 1000

    def fold(bucket, chunks, state: GroupState):
        steps = json.loads(state.get[0]) if state.exists else {}
        now, seen = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            for rows in chunks:
                for key, line, at, row in zip(*[rows[c].tolist() for c in ("key", "line_no", "at", "row")]):
                    old = seen.get(key)
                    if old is None:
                        seen[key] = [line, line, at, row]
                        continue
                    old[0], old[2] = min(old[0], line), max(old[2], at)
                    if line > old[1]:
                        old[1], old[3] = line, row
        for key, new in seen.items():
            old = steps.get(key)
            if old is not None:
                new[0], new[2] = min(old[0], new[0]), max(old[2], new[2])
                if old[1] > new[1]:
                    new[1], new[3] = old[1], old[3]
        steps = {key: old for key, old in steps.items() if max(old[2] + idle, old[4]) >= now} | {key: [*new, now + 1] for key, new in seen.items()}
        if steps:
            state.update((json.dumps(steps),))
            state.setTimeoutTimestamp(max(1, now, min(max(old[2] + idle, old[4]) for old in steps.values())))
        else:
            state.remove()
        if seen:
            yield pd.DataFrame([(key, new[0], new[1], new[3]) for key, new in seen.items()], columns=["key", "line_no", "last_line", "row"])

    whole = "step is not null and t_wall is not null and line_no is not null"
    # A thousandth of the time: Python gets no times beyond 2262, and lines may be spread further.
    clock = F.timestamp_micros(F.unix_millis("t_wall"))
    delay_us = raw.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {delay}"))).first()[0]
    timed = raw.where(whole).withColumn("clock", clock).withWatermark("clock", f"{delay_us // 1000} microseconds").select(
        F.pmod(F.xxhash64("run_id", "step"), F.lit(buckets)).alias("bucket"), F.to_json(F.struct("run_id", "step"), exact).alias("key"),
        F.col("line_no").cast("long").alias("line_no"), "clock", F.unix_millis("clock").alias("at"), packed.alias("row"))
    folded = timed.groupBy("bucket").applyInPandasWithState(
        fold, "key string, line_no long, last_line long, row string", "steps string", "update", GroupStateTimeout.EventTimeTimeout)
    folded = folded.withColumns({"key": F.from_json("key", named, exact), "row": F.from_json("row", Ty.StructType(content), exact)})
    steps = folded.select("key.run_id", "key.step", *[F.col(c).cast(kind["line_no"]).alias(c) for c in ("line_no", "last_line")], *[F.col("row")[f.name].alias(f.name) for f in content])
    rest = raw.where(f"not ({whole})").select("run_id", "step", "line_no", F.col("line_no").alias("last_line"), *[f.name for f in content])
    return steps.unionByName(rest)


def latest(updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row per key of an update log."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_l")).select(*keys, *[F.col("_l")[c].alias(c) for c in rest])


# ---------------------------------------------------------------- rules with their own state
_NO_ORDER = 2**63 - 1


def _fold_keys(rows: DataFrame, key: str, order: str, cols: list[str], new: list, step, out: str, mode: str = "append",
               newest: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """A fold of each key's rows in order, with a state of a few values per key; rows without an order come last.

    step(state, *cols) changes the state, a list of JSON values that begins as ``new``, and returns the row's output values
    or None. newest: only a key's last output of a batch. The result has the key, the order column unless newest, and out.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def fold(bucket, chunks, state: GroupState):
        known = dict(json.loads(state.get[0])) if state.exists else {}
        batch = pd.concat(list(chunks), ignore_index=True).sort_values([key, order], kind="stable")
        found, last = [], {}
        for k, o, *values in zip(*[batch[c].tolist() for c in (key, order, *cols)]):
            if k not in known:
                known[k] = json.loads(json.dumps(new))
            result = step(known[k], *values)
            if newest:
                last[k] = result
            elif result is not None:
                found.append((bucket[0], k, o, *result))
        state.update((json.dumps(list(known.items())),))
        found += [(bucket[0], k, None, *result) for k, result in last.items()]
        yield pd.DataFrame(found, columns=["_bucket", key, order, *names])

    # keys and orders without nulls: a null would make its whole column a double
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    plain = rows.select(bucket.cast("long").alias("_bucket"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias(key),
                        F.coalesce(F.col(order).cast("long"), F.lit(_NO_ORDER)).alias(order), *cols)
    folded = plain.groupBy("_bucket").applyInPandasWithState(
        fold, f"_bucket long, {key} long, {order} long, {out}", "keys string", mode, GroupStateTimeout.NoTimeout)
    place = [] if newest else [F.when(F.col(order) != _NO_ORDER, F.col(order)).alias(order)]
    return folded.select(F.when(F.col("_bucket") >= 0, F.col(key)).alias(key), *place, *names)


def stream_rage(acting: DataFrame) -> DataFrame:
    """Rage flags online: the state of a run is the node and its streak. acting: run_id, ord, dead_node (null: the step
    had an effect or none was measured); neutral steps are left out before."""
    run = K.RAGE_RUN

    def step(state, value):
        value = None if pd.isna(value) else int(value)
        state[1] = 0 if value is None else state[1] + 1 if value == state[0] else 1
        state[0] = value
        return state[1] >= run, state[1] == run

    return _fold_keys(acting, "run_id", "ord", ["dead_node"], [None, 0], step, "rage boolean, rage_start boolean")


def stream_layout_shift(shifts: DataFrame) -> DataFrame:
    """CLS online: window start, last shift, window sum, best sum. An update per page and batch.
    shifts: run_id, seq, start_ms, value, had_input."""
    def step(state, at, value, had_input):
        first, last, win, best = state
        if had_input is not None and not had_input:
            first, win = (first, win + value) if first >= 0 and at - last < 1000 and at - first < 5000 else (at, value)
            state[:] = first, at, win, max(best, win)
        return (state[3],)

    return _fold_keys(shifts, "run_id", "seq", ["start_ms", "value", "had_input"], [-1.0, -1.0, 0.0, 0.0], step, "cls double", "update", newest=True)


def stream_spontaneous(events: DataFrame, quiet_ms: float = 2000.0, ticks: int = 3) -> DataFrame:
    """Pollers and tickers online: the latest mark and a counter per key of the page.
    events: run_id, seq, ts_ms, kind, key, load_ms."""
    def step(state, ts_ms, kind, name, load_ms):
        if kind == "mark":
            state[0] = float(ts_ms)
            return None
        ref = max(load_ms, state[0])
        late = ts_ms >= load_ms and ts_ms - ref > quiet_ms
        name = "" if name is None else f"={name}"
        count = state[1][name] = state[1].get(name, 0) + int(late)
        return bool(late), count >= ticks

    return _fold_keys(events, "run_id", "seq", ["ts_ms", "kind", "key", "load_ms"], [-1.0, {}], step, "spontaneous boolean, excluded boolean")


def stream_verdicts(checked: DataFrame) -> DataFrame:
    """Verdict intake online: a task's accepted count and judges seen. Refused verdicts use up no place.
    checked: task_id, judge_id, arrival, problem, samples_required."""
    def step(state, judge, problem, required):
        why = "samples_complete" if state[0] >= required else "duplicate_judge" if judge in state[1] else None if pd.isna(problem) else problem
        if why is None:
            state[0] += 1
            state[1].append(judge)
        return judge, why is None, why

    known = checked.withColumn("samples_required", F.col("samples_required").cast("double"))
    return _fold_keys(known, "task_id", "arrival", ["judge_id", "problem", "samples_required"], [0, []], step, "judge_id string, accepted boolean, reason string").select(
        "task_id", "judge_id", "arrival", "accepted", "reason")


# ---------------------------------------------------------------- late rows and re-scoring
def high_water(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    """One row: the newest time of all batches before a batch, as the batch before it left it."""
    return spark.read.schema("one int, high timestamp").parquet(f"{base}/marks/batch={batch_id - 1}")


def write_with_late(batch: DataFrame, batch_id: int, base: str, ts: str, delay_s: int) -> None:
    """Writes a batch's rows as accepted or late, then its own high-water row.

    The mark comes from the one row of the batch before, never from accepted rows, and a batch that is run again finds
    the same row and decides alike.
    """
    spark = batch.sparkSession
    before = high_water(spark, base, batch_id)
    marked = batch.withColumn("__one", F.lit(0)).join(F.broadcast(before), F.col("__one") == F.col("one"), "left")
    old = F.coalesce(F.col(ts) < F.col("high") - F.expr(f"interval {int(delay_s)} seconds"), F.lit(False))
    rows = marked.select(*[F.col(c) for c in batch.columns], F.lit(batch_id).cast("long").alias("batch_id"), old.alias("late"))
    path = f"{base}/rows/batch={batch_id}"
    rows.write.mode("overwrite").partitionBy("late").parquet(path)
    newest = spark.read.schema(batch.schema).parquet(path).agg(F.lit(0).alias("one"), F.max(ts).cast("timestamp").alias("high"))
    newest.unionByName(before).groupBy("one").agg(F.max("high").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")


def split_late(events: DataFrame, ts: str, delay_s: int, name: str = "late", base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, late): rows older than the newest earlier batch's time minus the delay go to a side table.

    base: the folder of a stream that goes on (its checkpoint lies there too); as a rule a new one.
    """
    spark = events.sparkSession
    base = base or shared_dir(spark, name)
    schema = Ty.StructType([*events.schema.fields, Ty.StructField("batch_id", Ty.LongType()), Ty.StructField("late", Ty.BooleanType()), Ty.StructField("batch", Ty.LongType())])
    spark.createDataFrame([(0, None)], "one int, high timestamp").coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch=-1")
    q = events.writeStream.foreachBatch(lambda batch, batch_id: write_with_late(batch, batch_id, base, ts, delay_s)).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame([], schema).drop("batch").write.mode("overwrite").partitionBy("late").parquet(f"{base}/rows/batch=-1")
    rows = spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows").drop("batch")
    return rows.where(~F.col("late")).drop("late"), rows.where("late").drop("late")


def score_batch(batch: DataFrame, batch_id: int, tables: tuple[RunTable, RunTable, RunTable], catalog: Catalog) -> None:
    """Merges a batch's partial aggregates with those of the runs it touches, and scores these runs again.

    Reads the batch and the touched runs' aggregates; no earlier observation is read, and no other run's aggregates
    beyond those that share a shard's files.
    """
    cells, values, scores = tables
    batch = batch.persist()
    runs = batch.select("run_id").distinct()
    new_cells, new_values = S.partials(batch, catalog)
    merged = S.merge_partials(cells.rows_of(runs, batch_id - 1).unionByName(new_cells), values.rows_of(runs, batch_id - 1).unionByName(new_values))
    cells.replace(merged[0], batch_id, runs)
    values.replace(merged[1], batch_id, runs)
    scores.replace(S.score_partials(cells.written(batch_id, runs), values.written(batch_id, runs), catalog), batch_id, runs)
    batch.unpersist()


def score_tables(observations: DataFrame, base: str, catalog: Catalog) -> tuple[RunTable, RunTable, RunTable]:
    """The tables of a re-scoring stream: cells, values and scores by run."""
    spark = observations.sparkSession
    none = spark.createDataFrame([], observations.schema)
    cells, values = S.partials(none, catalog)
    schemas = (cells.schema, values.schema, S.score_partials(cells, values, catalog).schema)
    return tuple(RunTable(spark, f"{base}/{name}", schema) for name, schema in zip(("cells", "values", "scores"), schemas))


def stream_scores(observations: DataFrame, catalog: Catalog | None = None, name: str = "scores", base: str | None = None) -> DataFrame:
    """Incremental re-score: each batch adds its rows to the aggregates of the runs it touches, and scores only these.

    Returns the newest scores of every run. base: the folder of a stream that goes on; as a rule a new one.
    """
    catalog = catalog or default_catalog()
    base = base or shared_dir(observations.sparkSession, name)
    tables = score_tables(observations, base, catalog)
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, tables, catalog)
        done.append(batch_id)

    q = observations.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return tables[2].read(max(done, default=-1))
