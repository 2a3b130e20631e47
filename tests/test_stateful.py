"""Settles, journeys, late rows and re-scoring over several micro-batches, against plain Python or the batch result."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from siteready.session import shared_dir
from siteready.sources.run_table import RunTable
from siteready.streaming import stateful, streams

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream(spark, batches, schema):
    path = shared_dir(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def at(ms):
    return (ZERO + timedelta(milliseconds=ms)).replace(tzinfo=None)


def test_settled_timed_out_reopened_and_cut_short(spark):
    schema = "run_id string, ts timestamp, seq long, kind string, request_id string, path string, flag boolean"
    rows, n = [], 0

    def add(page, ms, kind, request=None, path=None, flag=False):
        nonlocal n
        n += 1
        rows.append((page, at(ms), n, kind, request, path, flag))

    add("a", 0, "action", flag=True)        # 1: nothing answers: the dead-click window
    add("a", 1500, "activity")              # after the settle
    add("a", 5000, "action", flag=True)     # 3: answered at 100, quiet 500 later
    add("a", 5100, "activity")
    add("b", 0, "action")                   # 5: a request holds until it ends
    add("b", 100, "request", "r1", "/x")
    add("b", 2000, "finish", "r1")
    add("b", 9000, "action")                # 8: a request that never ends holds 3 s
    add("b", 9100, "request", "r2", "/x")
    add("c", 0, "action")                   # 10: activity without pause: the limit
    for ms in range(100, 12000, 400):
        add("c", ms, "activity")
    add("d", 0, "action", flag=True)        # cut short by the next action
    first_d = n
    add("d", 300, "action")
    add("d", 310, "request", "p1", "/poll")
    add("d", 320, "request", "p2", "/poll")
    add("d", 330, "finish", "p1")
    add("d", 340, "finish", "p2")
    add("d", 600, "request", "p3", "/poll")  # the third on one path holds nothing
    add("e", 0, "action")                   # a load holds
    add("e", 50, "load_start")
    add("e", 1000, "load_stop")
    add("z", 30000, "activity")             # moves the watermark
    add("z", 60000, "activity")
    rows.sort(key=lambda r: r[1])
    rng = random.Random(2)
    cuts = [[r for r in rows if lo <= (r[1] - at(0)).total_seconds() * 1000 < hi] for lo, hi in ((0, 200), (200, 1200), (1200, 5050), (5050, 20000), (20000, 40000), (40000, 10**9))]
    for part in cuts:
        rng.shuffle(part)
    out = streams.drain(stateful.stream_settles(stream(spark, cuts, schema), "1 second"), "settled", timers=True)
    start = int(ZERO.timestamp() * 1000)
    got = {(r.run_id, r.action): (r.reason, r.settled_ms - start, r.responded, r.requests, r.earlier_activity) for r in out.collect()}
    assert got == {
        ("a", 1): ("quiet", 1000, False, 0, 0), ("a", 3): ("quiet", 5600, True, 0, 1), ("b", 5): ("quiet", 2300, False, 1, 0), ("b", 8): ("quiet", 12100, False, 1, 0),
        ("c", 10): ("timeout", 10000, True, 0, 0), ("d", first_d): ("next_action", 300, False, 0, 0), ("d", first_d + 1): ("quiet", 640, False, 3, 0),
        ("e", [r[2] for r in rows if r[0] == "e"][0]): ("quiet", 1000, True, 0, 0)}
    assert out.select("batch_id").distinct().count() >= 3


def test_settles_do_not_depend_on_batches(spark):
    schema = "run_id string, ts timestamp, seq long, kind string, request_id string, path string, flag boolean"
    rng, rows = random.Random(9), []
    for page in "abcd":
        ms = 0
        for _ in range(60):
            ms += rng.choice([20, 90, 300, 700, 2500])
            rows.append((page, at(ms), len(rows), rng.choice(["action", "activity", "request", "finish", "data", "load_start", "load_stop"]), str(rng.randint(1, 3)), rng.choice("xyz"), rng.random() < 0.3))
    rows.append(("z", at(10**6), len(rows), "activity", None, None, False))
    rows.append(("z", at(2 * 10**6), len(rows), "activity", None, None, False))
    rows.sort(key=lambda r: r[1])
    found = []
    for cuts in (1, 5):
        size = -(-len(rows) // cuts)
        parts = [rows[i:i + size] for i in range(0, len(rows), size)]
        out = streams.drain(stateful.stream_settles(stream(spark, [*parts, []], schema), "10 seconds"), "settled", timers=True).drop("batch_id")
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] and len(found[0]) > 20


STEP = ("run_id string, ts timestamp, ord long, max_steps int, operation string, source string, stale boolean, guard_blocked boolean, node long, role string, role_recorded boolean, "
        "since_available boolean, mutations int, mutations_total int, navigations int, requests int, shifts_post_input double, page_changed boolean, state_changed boolean, new_tab boolean, "
        "external_nav boolean, navigation_error boolean, new_document boolean, new_document_recorded boolean, first_request_recorded boolean, first_response_ms double, follows_timeout boolean, "
        "url_before string, url_after string, event_timing_max_ms double, execution_ms double, settle_ms double, settle_reason string, decision_latency_ms double")


def step(run, ms, ord, operation, budget=None, node=None, mutations=0, url="https://s.example/a"):
    return (run, at(ms), ord, budget, operation, None, False, False, node, "button", True, True, mutations, mutations, 0, 0, 0.0, False, None, False, False, False, False, True, True, 120.0 + ord, False,
            url, url, None, 10.0, 20.0, "quiet", 5.0)


def test_journeys_close_by_their_reasons_and_report_rows_after_the_close(spark):
    hour = 3_600_000
    done = [step("done", i * 1000, i, "CLICK", node=7) for i in range(5)] + [step("done", 6000, 9, "DONE"), step("done", 7000, 10, "CLICK")]
    blocked = [step("blocked", 0, 1, "CLICK", mutations=3), step("blocked", 500, 2, "BLOCKED")]
    budget = [step("budget", i * 1000, i, "CLICK", 3, mutations=1, url=f"https://s.example/{i % 2}") for i in range(6)]
    idle = [step("idle", 0, 1, "WAIT"), step("idle", 1000, 2, "CLICK", node=1), step("idle", 5 * hour, 3, "CLICK", node=1)]
    late = [step("clock", 20 * hour, 1, "WAIT"), step("clock", 60 * hour, 2, "WAIT"), step("clock", 61 * hour, 3, "WAIT")]
    rows = sorted(done + blocked + budget + idle + late, key=lambda r: r[1])
    size = -(-len(rows) // 4)
    parts = [rows[i:i + size][::-1] for i in range(0, len(rows), size)]
    out = streams.drain(stateful.stream_journeys(stream(spark, parts, STEP), "10 minutes", hour, 24 * hour), "journeys", timers=True)
    start = int(ZERO.timestamp() * 1000)
    got = {(r.run_id, r.reason, r.closed_ms - start): r for r in out.collect()}
    assert {k for k in got if k[0] != "clock"} == {
        ("done", "done", 6000), ("done", "after_close", 6000 + 24 * hour), ("blocked", "blocked", 500), ("budget", "budget", 2000), ("budget", "after_close", 2000 + 24 * hour),
        ("idle", "idle", 1000 + hour), ("idle", "after_close", 1000 + 25 * hour)}
    first = got["done", "done", 6000]
    assert (first.steps, first.acts, first.dead, first.rage_events, first.visits, first.unique_pages, first.response_ms) == (6, 5, 5, 1, 1, 1, None)
    assert got["done", "after_close", 6000 + 24 * hour].steps == 1
    b = got["budget", "budget", 2000]
    assert (b.steps, b.acts, b.visits, b.unique_pages, b.response_ms, b.site_ms) == (3, 3, 3, 2, 121.0, 90.0) and got["budget", "after_close", 2000 + 24 * hour].steps == 3


def test_late_rows_over_fifty_batches_and_a_replayed_one(spark):
    rng = random.Random(4)
    rows = [(i, at(i * 60_000 - rng.choice([0, 0, 0, 3_000_000])), i // 4) for i in range(200)]
    schema, base = "event_id long, ts timestamp, piece long", shared_dir(spark, "late")
    spark.createDataFrame([(0, None)], "one int, high timestamp").coalesce(1).write.parquet(f"{base}/marks/batch=-1")
    want, high = {}, None
    for b in range(50):
        mine = [r for r in rows if r[2] == b]
        for r in mine:
            want[r[0]] = high is not None and r[1] < high - timedelta(minutes=20)
        df = spark.createDataFrame(mine, schema).coalesce(1)
        streams.write_with_late(df, b, base, "ts", 1200)
        if b in (20, 30):  # the driver failed after the batch was written: it runs again
            streams.write_with_late(df, b, base, "ts", 1200)
        high = max([r[1] for r in mine] + ([high] if high else []))
    got = spark.read.schema("event_id long, ts timestamp, piece long, batch_id long, late boolean, batch int").option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    assert {r.event_id: r.late for r in got.collect()} == want and any(want.values()) and got.count() == 200
    assert streams.high_water(spark, base, 50).count() == 1


def test_run_table_replaces_empties_and_compacts(spark):
    facts = random.Random(6)
    schema = spark.createDataFrame([], "run_id string, x long").schema
    table = RunTable(spark, shared_dir(spark, "facts"), schema, shards=4, most=3)
    want = {}
    for i in range(9):
        runs = [f"r{j}" for j in range(12) if i == 0 or facts.random() < 0.4]
        gone = {r for r in runs if facts.random() < 0.3}
        rows = [(r, 100 * i + n) for r in runs if r not in gone for n in range(2)]
        named = spark.createDataFrame([(r,) for r in runs], "run_id string")
        table.replace(spark.createDataFrame(rows, schema), i, named)
        if i == 5:  # the same write again
            table.replace(spark.createDataFrame(rows, schema), i, named)
        for r in runs:
            want[r] = sorted(x for q, x in rows if q == r)
        kept = {}
        for q, x in table.read(i).collect():
            kept.setdefault(q, []).append(x)
        assert {q: sorted(v) for q, v in kept.items()} == {q: v for q, v in want.items() if v}
        assert max(map(len, table.live(i).values())) <= 3
    some = spark.createDataFrame([("r1",), ("r2",), ("nobody",)], "run_id string")
    assert sorted(x for _, x in table.rows_of(some, 8).collect()) == sorted(want["r1"] + want["r2"])


def test_a_timer_that_changes_nothing_makes_no_needless_state_calls():
    class Calls(list):
        def __init__(self, found):
            self.found = found

        def get(self):
            return self.found

        def __getattr__(self, name):
            return lambda *a: self.append((name, a))

    rule = stateful.Journeys(idle=1000)
    state = rule.start() | {"last": 5000, "steps": 1, "opened": 5000}
    rule.kept, rule.waiting, rule.handle = Calls(tuple(state[f] for f in rule.state_fields)), Calls([]), Calls(None)
    times = type("T", (), {"getCurrentWatermarkInMs": lambda self: 5500})()
    assert list(rule.handleExpiredTimer((1,), times, None)) == []
    assert (rule.kept, rule.waiting, rule.handle) == ([], [], [("registerTimer", (6000,))])
    times = type("T", (), {"getCurrentWatermarkInMs": lambda self: 6000})()
    closed, = rule.handleExpiredTimer((1,), times, None)
    assert closed.reason == "idle" and closed.closed_ms == 6000 and [c[0] for c in rule.kept] == ["update"]
    rule.kept, rule.handle = Calls(None), Calls(None)
    assert list(rule.handleExpiredTimer((2,), times, None)) == [] and (rule.kept, rule.handle) == ([], [])
