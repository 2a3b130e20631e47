"""Checks that the streaming operators give the batch answer: the tables are replayed as streams over what is there, those
with state of their own in several micro-batches.

An event-time operator emits only what its watermark has passed, so the SQL stops there too.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siteready.functions import friction as P
from siteready.functions.numbers import round_half_even
from siteready.operators import friction as R
from siteready.operators import scoring as S
from siteready.session import shared_dir
from siteready.streaming import stateful as Sf
from siteready.streaming import streams as St
from siteready.verify.base import DUCK_VIEWS, ORACLES, VIEWS, duck_view, half_even, query, spark_view, table, view
from siteready.verify.scoring import CAT


def _ts(e):
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _source(spark, d, name="events"):
    return St.read_stream(spark, d, spark.read.parquet(f"{d}/{name}.parquet").schema, pattern=f"{name}.parquet")


def _replay_slices(spark, df, piece, key="run_id", slices=4, files=2):
    """A table written as several time slices, each as files by key, and read one slice a micro-batch: keys come back in
    every batch, and rows cross the cuts out of order."""
    path = shared_dir(spark, "replay")
    for i in range(slices):
        df.where(piece == i).repartition(files, key).write.mode("append").parquet(path)
    return St.read_stream(spark, path, df.schema, files_per_trigger=files)


def _replay_in_order(spark, df, order, key):
    """Four slices by the order column: state is carried from batch to batch, and every key comes back."""
    top = df.agg(F.max(order)).first()[0]
    return _replay_slices(spark, df, F.least(F.lit(3), F.floor(F.col(order) * 4 / F.lit(top + 1))), key)


# Cuts of the 30 days; up to two hours of disorder at each cut.
def _slice(t_us, k):
    return F.least(F.lit(3), F.greatest(F.lit(0), F.floor((t_us - F.lit(1704067200 * 10**6) + (k % 3).cast("long") * (3600 * 10**6)) / F.lit(7.5 * 86400 * 10**6)))).cast("int")


# One second of a page is a day of the table: the limits are stretched alike.
_H = 3_600_000
_LIMITS = {"quiet": 6 * _H, "net_quiet": 4 * _H, "min_wait": 2 * _H, "dead_window": 12 * _H, "inflight_max": 36 * _H, "timeout": 60 * _H, "forget": 10_000 * _H}
view("v_page_rows", """SELECT run_id, ord AS seq, t_us, k, CASE event_type WHEN 'click' THEN 'action' WHEN 'view' THEN 'activity' WHEN 'error' THEN 'request' WHEN 'purchase' THEN 'finish'
 ELSE CASE WHEN k % 2 = 0 THEN 'load_start' ELSE 'load_stop' END END AS kind, k % 4 AS rid,
 CASE event_type WHEN 'click' THEN k % 3 <> 0 WHEN 'error' THEN k % 11 = 0 ELSE FALSE END AS flag FROM v_ev""")


@query("str_04_settled_pages", """WITH p AS (SELECT *, t_us // 1000 AS ms, row_number() OVER r AS pos, count(*) FILTER (WHERE kind = 'action') OVER r AS act, max(CASE WHEN kind = 'activity' THEN t_us // 1000 END) OVER r AS active,
  lead(t_us // 1000) OVER r AS nxt FROM v_page_rows WINDOW r AS (PARTITION BY run_id ORDER BY t_us // 1000, seq)),
c AS (SELECT *, kind = 'request' AND NOT flag AND row_number() OVER (PARTITION BY run_id, act, kind, rid ORDER BY pos) <= 2 AS counted FROM p),
s AS (SELECT run_id, act, rid, pos, ms, (SELECT min(f.pos) FROM c f WHERE f.run_id = c.run_id AND f.act = c.act AND f.kind = 'finish' AND f.rid = c.rid AND f.pos > c.pos) AS fin FROM c WHERE counted AND act > 0 AND NOT EXISTS (
  SELECT 1 FROM c b WHERE b.run_id = c.run_id AND b.act = c.act AND b.rid = c.rid AND b.counted AND b.pos < c.pos AND c.ms - b.ms < INFLIGHT
   AND NOT EXISTS (SELECT 1 FROM c g WHERE g.run_id = c.run_id AND g.act = c.act AND g.rid = c.rid AND g.kind = 'finish' AND g.pos BETWEEN b.pos AND c.pos))),
net AS (SELECT run_id, act, pos, ms FROM c WHERE counted UNION ALL SELECT s.run_id, s.act, f.pos, f.ms FROM s JOIN c f ON f.run_id = s.run_id AND f.pos = s.fin WHERE f.ms - s.ms < INFLIGHT),
t AS (SELECT c.*, first_value(ms) OVER a AS start, first_value(seq) OVER a AS action, first_value(flag) OVER a AS answer, bool_or(kind IN ('activity', 'load_start')) OVER a AS responded, count(*) FILTER (WHERE kind = 'request') OVER a AS requests,
  arg_max(CASE WHEN kind = 'load_start' THEN ms ELSE -1 END, CASE WHEN kind IN ('load_start', 'load_stop') THEN pos END) OVER a AS load,
  (SELECT max(n.ms) FROM net n WHERE n.run_id = c.run_id AND n.act = c.act AND n.pos <= c.pos) AS last_net,
  (SELECT max(s.ms) FROM s WHERE s.run_id = c.run_id AND s.act = c.act AND s.pos <= c.pos AND (s.fin IS NULL OR s.fin > c.pos)) AS held
  FROM c WHERE act > 0 WINDOW a AS (PARTITION BY run_id, act ORDER BY pos)),
u AS (SELECT *, greatest(ms, start + CASE WHEN responded OR NOT answer THEN MIN_WAIT ELSE DEAD END, coalesce(last_net, start) + NET, active + QUIET, CASE WHEN load >= 0 THEN load + INFLIGHT END, held + INFLIGHT) AS quiet_at FROM t),
x AS (SELECT run_id, act, arg_min({'ms': least(quiet_at, start + LIMIT), 'reason': CASE WHEN quiet_at <= start + LIMIT THEN 'quiet' ELSE 'timeout' END, 'responded': responded, 'requests': requests, 'pos': pos}, pos)
   FILTER (WHERE nxt IS NULL OR least(quiet_at, start + LIMIT) <= nxt) AS closing,
  arg_max({'ms': nxt, 'reason': 'next_action', 'responded': responded, 'requests': requests, 'pos': pos}, pos) AS cut, min(start) AS start, min(action) AS action, max(pos) AS final FROM u GROUP BY run_id, act),
y AS (SELECT *, coalesce(closing, cut) AS z FROM x)
SELECT y.run_id, y.action, y.start AS started_ms, y.z.reason AS reason, y.z.ms AS settled_ms, y.z.responded AS responded, y.z.requests AS requests,
 CASE WHEN y.act = 1 THEN (SELECT count(*) FROM c WHERE c.run_id = y.run_id AND c.act = 0) ELSE w.final - w.z.pos END AS earlier_activity
FROM y LEFT JOIN y w ON w.run_id = y.run_id AND w.act = y.act - 1 WHERE y.z.ms <= (SELECT max(ms) FROM c) - 10800000
""".replace("INFLIGHT", str(_LIMITS["inflight_max"])).replace("MIN_WAIT", str(_LIMITS["min_wait"])).replace("DEAD", str(_LIMITS["dead_window"])).replace("NET", str(_LIMITS["net_quiet"]))
       .replace("QUIET", str(_LIMITS["quiet"])).replace("LIMIT", str(_LIMITS["timeout"])))
def _(spark, d):
    rows = spark_view(spark, d, "v_page_rows").withColumn("ts", F.timestamp_micros("t_us"))
    stream = _replay_slices(spark, rows.select("run_id", "ts", "t_us", "k", "seq", "kind", F.col("rid").alias("request_id"), F.col("rid").alias("path"), "flag"), _slice(F.col("t_us"), F.col("k")))
    return St.drain(Sf.stream_settles(stream, "3 hours", **_LIMITS), "settled", timers=True).drop("batch_id")


# Journeys that end: the steps with DONE and BLOCKED rows, cut at the end of the run's first journey.
_IDLE = 60 * _H
view("v_jsteps", VIEWS["v_steps"].replace("CASE event_type WHEN", "CASE CASE WHEN k % 40 = 39 AND run_id % 3 = 0 THEN 'DONE' WHEN k % 40 = 39 AND run_id % 3 = 1 THEN 'BLOCKED' ELSE event_type END "
                                          "WHEN 'DONE' THEN 'DONE' WHEN 'BLOCKED' THEN 'BLOCKED' WHEN"))
view("v_budget", "SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 4 = 0 THEN CAST(12 + user_id % 30 AS INT) END AS max_steps FROM events")
duck_view("v_closing", f"""SELECT run_id, min(pos) AS pos, arg_min(reason, pos) AS reason, arg_min(end_ms, pos) AS closed_ms FROM (
 SELECT *, CASE WHEN operation = 'DONE' THEN 'done' WHEN operation = 'BLOCKED' THEN 'blocked' WHEN n >= max_steps THEN 'budget' WHEN nxt IS NULL OR nxt - ms >= {_IDLE} THEN 'idle' END AS reason,
  CASE WHEN operation IN ('DONE', 'BLOCKED') OR n >= max_steps THEN ms ELSE ms + {_IDLE} END AS end_ms FROM (
  SELECT s.run_id, s.operation, b.max_steps, t_us // 1000 AS ms, row_number() OVER r AS pos, lead(t_us // 1000) OVER r AS nxt,
   count(*) FILTER (WHERE source IS NULL AND operation NOT IN ('NAVIGATION', 'DONE', 'BLOCKED') AND NOT stale AND NOT guard_blocked) OVER r AS n
  FROM v_jsteps s JOIN v_budget b USING (run_id) WINDOW r AS (PARTITION BY s.run_id ORDER BY t_us // 1000, ord))) WHERE reason IS NOT NULL GROUP BY run_id
 HAVING arg_min(end_ms, pos) <= (SELECT max(t_us // 1000) FROM v_ev) - 10800000""")
duck_view("v_c_steps", """SELECT s.* EXCLUDE (pos) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_us // 1000, ord) AS pos FROM v_jsteps) s JOIN v_closing c ON c.run_id = s.run_id AND s.pos <= c.pos""")
duck_view("v_c_journeys", "SELECT j.run_id, profile, CASE WHEN reason <> 'idle' THEN success END AS success, CASE WHEN reason <> 'idle' THEN unverified END AS unverified, optimal_steps, optimal_pages FROM v_journeys j JOIN v_closing USING (run_id)")
for _name in ("v_flags", "v_flags2", "v_visits", "v_rage", "v_sum", "v_fric"):
    duck_view(_name.replace("v_", "v_c_"), re.sub(r"\bv_(steps|journeys|flags2?|visits|rage|sum|fric)\b", r"v_c_\1", DUCK_VIEWS[_name]).replace("operation <> 'NAVIGATION' AND NOT stale", "operation NOT IN ('NAVIGATION', 'DONE', 'BLOCKED') AND NOT stale"))


@query("str_09_closed_journeys", "SELECT c.reason AS close_reason, c.closed_ms, c.pos AS steps, f.* FROM v_c_fric f JOIN v_closing c USING (run_id)")
def _(spark, d):
    """Closed journeys' friction KPIs from the stream's state, over four batches; they equal the batch KPIs of the same steps."""
    steps = spark_view(spark, d, "v_jsteps").join(spark_view(spark, d, "v_budget"), "run_id").withColumn("ts", F.timestamp_micros("t_us"))
    closed = St.drain(Sf.stream_journeys(_replay_slices(spark, steps, _slice(F.col("t_us"), F.col("k"))), "3 hours", _IDLE, 10_000 * _H), "closed", timers=True).drop("batch_id")
    told = F.col("close_reason") != "idle"
    summary = closed.withColumnRenamed("reason", "close_reason").join(spark_view(spark, d, "v_journeys"), "run_id").withColumns({"success": F.when(told, F.col("success")), "unverified": F.when(told, F.col("unverified"))})
    kpis = R.observations(summary).select("run_id", "profile", "kpi_id", "value_num", "value_bool", "reason")
    return kpis.join(closed.select("run_id", F.col("reason").alias("close_reason"), "closed_ms", "steps"), "run_id")


def _flagged(e):
    t = F.col("event_type")
    return _ts(e).select(F.col("user_id").alias("run_id"), "ts", "event_id", (t != "error").alias("is_action"), (t == "error").alias("is_error"), ((t == "click") & (F.col("value") < 40)).alias("is_dead"))


for _name, _slide in (("str_07_tumbling_rates", None), ("str_07_sliding_rates", "6 hours")):
    def _run(spark, d, slide=_slide):
        s = St.stream_rates(_flagged(_source(spark, d)), ["run_id"], "1 day", slide, "2 hours")
        return St.drain(s, "rates").select("run_id", F.unix_seconds("start").alias("start"), "actions", "errors", "dead")
    query(_name, f"""SELECT user_id AS run_id, s AS start, count(*) FILTER (WHERE event_type <> 'error') AS actions, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click' AND value < 40) AS dead
 FROM (SELECT *, {"CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400" if _slide is None else "CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 - o * 21600"} AS s FROM events{"" if _slide is None else ", unnest(range(0, 4)) u(o)"}) WHERE s + 86400 <= (SELECT max(epoch(ts)) - 7200 FROM events) GROUP BY ALL""")(_run)

_SESS = """SELECT run_id, CAST(floor(min(e)) AS BIGINT) AS start, count(*) AS steps, count(*) FILTER (WHERE event_type = 'click' AND value < 40) AS dead FROM (SELECT *, sum(b) OVER (PARTITION BY run_id ORDER BY event_id) AS sid FROM (
 SELECT user_id AS run_id, event_id, event_type, value, epoch(ts) AS e, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY event_id) < GAP THEN 0 ELSE 1 END AS b FROM events)) GROUP BY run_id, sid HAVING max(e) + GAP <= (SELECT max(epoch(ts)) - 3600 FROM events)"""
for _name, _gap, _s in (("str_04_settles", "2 hours", 7200), ("str_09_journey_sessions", "12 hours", 43200)):
    def _run(spark, d, gap=_gap):
        s = St.stream_sessions(_flagged(_source(spark, d)), ["run_id"], gap, "1 hour")
        return St.drain(s, "sessions").select("run_id", F.unix_seconds("start").alias("start"), "steps", "dead")
    query(_name, _SESS.replace("GAP", str(_s)))(_run)


@query("str_02_dead_clicks", """SELECT c.user_id AS run_id, c.event_id AS click_id, v.event_id AS resp_id FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id AND epoch(v.ts) BETWEEN epoch(c.ts) AND epoch(c.ts) + 21600
 WHERE v.event_id IS NOT NULL OR epoch(c.ts) + 21600 < (SELECT least(max(epoch(ts)) FILTER (WHERE event_type = 'click'), max(epoch(ts)) FILTER (WHERE event_type = 'view')) - 3600 FROM events)""")
def _(spark, d):
    e = _ts(_source(spark, d)).select(F.col("user_id").alias("run_id"), "event_type", "event_id", "ts")
    e2 = _ts(_source(spark, d)).select(F.col("user_id").alias("run_id"), "event_type", "event_id", "ts")
    c = e.where("event_type = 'click'").select("run_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    r = e2.where("event_type = 'view'").select("run_id", F.col("event_id").alias("resp_id"), F.col("ts").alias("resp_ts"))
    return St.drain(St.stream_dead_clicks(c, r, "run_id", "6 hours", "1 hour"), "dead").drop("batch_id")


@query("str_01_step_upsert", "SELECT run_id, step, arg_max(operation, line_no) AS operation, arg_max(url, line_no) AS url, min(line_no) AS line_no FROM v_steps_raw WHERE step IS NOT NULL GROUP BY run_id, step")
def _(spark, d):
    raw = spark_view(spark, d, "v_steps_raw").withColumn("t_wall", F.timestamp_seconds(F.lit(1704067200) + F.col("line_no")))
    up = St.drain(St.stream_steps_upsert(_replay_in_order(spark, raw, "line_no", "run_id"), "1 hour"), "upsert", "update").where("step is not null")
    lines = up.groupBy("run_id", "step").agg(F.min("line_no").alias("line_no"))
    return St.latest(up.drop("line_no"), ["run_id", "step"], "last_line").join(lines, ["run_id", "step"]).select("run_id", "step", "operation", "url", "line_no")


@query("str_01_step_upsert_midnight", """WITH r AS (SELECT run_id, CASE WHEN line_no % 5 <> 0 THEN step END AS step, line_no, operation, url FROM v_steps_raw),
 g AS (SELECT run_id, step, arg_max({'o': operation, 'u': url}, line_no) AS l, min(line_no) AS line_no FROM r WHERE step IS NOT NULL AND line_no % 7 <> 0 GROUP BY run_id, step)
 SELECT run_id, step, l.o AS operation, l.u AS url, line_no FROM g UNION ALL SELECT run_id, step, operation, url, line_no FROM r WHERE step IS NULL OR line_no % 7 = 0""")
def _(spark, d):
    """Lines half a day apart, some without a step and some without a time; one update for each step, all other rows kept."""
    at = F.when(F.col("line_no") % 7 != 0, F.timestamp_seconds(F.lit(1704067200) + 43200 * F.col("line_no")))
    raw = spark_view(spark, d, "v_steps_raw").withColumn("step", F.when(F.col("line_no") % 5 != 0, F.col("step"))).withColumn("t_wall", at)
    return St.drain(St.stream_steps_upsert(_replay_in_order(spark, raw, "line_no", "run_id"), "1 hour"), "upsert", "update").select("run_id", "step", "operation", "url", "line_no")


@query("str_03_rage", "SELECT run_id, ord, rage, rage_start FROM v_rage")
def _(spark, d):
    s = spark_view(spark, d, "v_steps").where(P.executed() & (F.col("operation") != "WAIT")).select("run_id", "ord", F.when(P.interaction() & P.no_effect(), F.col("node")).cast("long").alias("dead_node"))
    return St.drain(St.stream_rage(_replay_in_order(spark, s, "ord", "run_id")), "rage").drop("batch_id")


@query("str_05_layout_shift", ORACLES["win_07_layout_shift"].replace(f", {half_even('s.post', 4)} AS cls_post_input", ""))
def _(spark, d):
    s = spark_view(spark, d, "v_shift").select("run_id", "seq", F.col("start_ms").cast("double").alias("start_ms"), F.col("value").cast("double").alias("value"), "had_input")
    return St.latest(St.drain(St.stream_layout_shift(_replay_in_order(spark, s, "seq", "run_id")), "cls", "update"), ["run_id"], "batch_id").select("run_id", round_half_even(F.col("cls"), 4).alias("cls"))


@query("str_06_spontaneous", ORACLES["win_08_spontaneous"])
def _(spark, d):
    s = spark_view(spark, d, "v_pev").select("run_id", "seq", F.col("ts_ms").cast("double").alias("ts_ms"), "kind", "key", F.col("load_ms").cast("double").alias("load_ms"))
    return St.drain(St.stream_spontaneous(_replay_in_order(spark, s, "seq", "run_id")), "spontaneous").drop("batch_id")


@query("str_08_verdict_intake", """SELECT task_id, judge_id, arrival, accepted FROM (SELECT c.task_id, c.judge_id, c.arrival, h.head IS NOT NULL AND c.arrival = h.head AND h.rk <= t.samples_required AS accepted FROM v_checked c JOIN (SELECT task_id, samples_required FROM v_tasks) t USING (task_id) LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY head) AS rk FROM (SELECT task_id, judge_id, min(arrival) AS head FROM v_checked WHERE problem IS NULL GROUP BY ALL)) h USING (task_id, judge_id))""")
def _(spark, d):
    v = spark_view(spark, d, "v_checked").join(spark_view(spark, d, "v_tasks").select("task_id", "samples_required"), "task_id").select("task_id", "judge_id", "arrival", "problem", "samples_required")
    return St.drain(St.stream_verdicts(_replay_in_order(spark, v, "arrival", "task_id")), "verdicts").select("task_id", "judge_id", "arrival", "accepted")


@query("str_10_late_rows", """SELECT event_id, k % 2 = 1 AND epoch(ts) < (SELECT max(epoch(ts)) - 86400 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) WHERE k % 2 = 0) AS late FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""")
def _(spark, d):
    e = _ts(table(spark, d, "events")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")).select("event_id", "ts", "k")
    ok, late = St.split_late(_replay_slices(spark, e, F.col("k") % 2, "event_id", 2), "ts", 86400)
    return ok.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query("str_10_late_rows_many_batches", """WITH e AS (SELECT event_id, ts, least(9, greatest(0, CAST(floor((epoch_us(ts) - 1704067200000000 + (k % 7) * 36000000000) / 259200000000) AS INT))) AS b FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)),
 m AS (SELECT b, max(ts) AS newest FROM e GROUP BY b)
 SELECT event_id, b AS batch_id, coalesce(ts < (SELECT max(newest) FROM m WHERE m.b < e.b) - INTERVAL 6 HOURS, false) AS late FROM e""")
def _(spark, d):
    """Ten batches of three days each; a seventh of the rows is 10, 20, ... 60 hours behind its place."""
    e = _ts(table(spark, d, "events")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    b = F.least(F.lit(9), F.greatest(F.lit(0), F.floor((F.unix_micros("ts") - F.lit(1704067200 * 10**6) + (F.col("k") % 7) * 36_000_000_000) / 259_200_000_000)))
    ok, late = St.split_late(_replay_slices(spark, e.select("event_id", "ts", b.alias("b")), F.col("b"), "event_id", 10), "ts", 6 * 3600)
    return ok.select("event_id", "batch_id", F.lit(False).alias("late")).unionByName(late.select("event_id", "batch_id", F.lit(True).alias("late")))


@query("str_11_incremental_scores", ORACLES["score_headline"])
def _(spark, d):
    """Every run's rows arrive in three batches; the newest scores equal one batch run over all."""
    o = spark_view(spark, d, "v_obs")
    return St.stream_scores(_replay_slices(spark, o, F.pmod(F.hash("ord"), F.lit(3)), slices=3), CAT)
