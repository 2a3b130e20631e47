"""Rules that wait for time to pass: settled pages and closed journeys, with timers on the watermark.

Rows of a key may arrive in any order and in any number of micro-batches. They wait in list state until the watermark
has passed them and are then folded in event order, so a stream gives the same rows however its input was cut.
Everything a rule remembers is one small state row per key; timers on event time end what no further row will end.
Rows behind the watermark are dropped by Spark (``streams.split_late`` keeps them in a side table before they come here).

Predicates over raw rows are evaluated as columns before the state, and KPIs as columns after it: Python sees a few
numbers and flags per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteready.dims import constants as K
from siteready.functions import friction as P
from siteready.functions.urls import page_key

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Starts streams with the state store that timers need. A started stream keeps it; the session's own setting is
    put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class InEventOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then folds them in the order of (ms, seq).

    A rule names its state's fields and gives ``start`` (the state of a new key), ``fold`` (one row), ``due`` (when the
    state ends or changes by itself) and ``end`` (what happens then). ``fold`` and ``end`` change the state and yield
    output rows; the key is forgotten once ``end`` marks its state as gone.
    """

    row_fields: list[str]
    row_schema: str
    state_fields: list[str]
    state_schema: str

    def start(self) -> dict:
        raise NotImplementedError

    def fold(self, key: tuple, state: dict, row: dict) -> Iterator[Row]:
        raise NotImplementedError

    def due(self, state: dict) -> int:
        raise NotImplementedError

    def end(self, key: tuple, state: dict, at: int) -> Iterator[Row]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.kept = handle.getValueState("kept", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[f] for f in self.row_fields) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        # each call on a state is a round trip to the JVM, which is most of a key's time: none is made that tells nothing
        kept = self.kept.get()
        state = None if kept is None else dict(zip(self.state_fields, kept))
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] <= mark]
        changed = bool(ready) or (state is not None and self.due(state) <= mark)
        if ready:
            rows = rows[len(ready):]
            if rows:
                self.waiting.put([tuple(r) for r in rows])
            else:
                self.waiting.clear()
        for r in ready:
            row = dict(zip(self.row_fields, r))
            if state is not None:
                yield from self._until(key, state, row["ms"])
            if state is None or "gone" in state:
                state = self.start()
            yield from self.fold(key, state, row)
        if state is not None:
            yield from self._until(key, state, mark)
        coming = [r[0] for r in rows[:1]]
        if state is None or "gone" in state:
            if kept is not None:
                self.kept.clear()
        else:
            if changed:
                self.kept.update(tuple(state[f] for f in self.state_fields))
            coming.append(self.due(state))
        if coming:
            self.handle.registerTimer(max(min(coming), mark + 1))

    def _until(self, key: tuple, state: dict, at: int) -> Iterator[Row]:
        """Ends everything that is due at or before a time."""
        while "gone" not in state and (due := self.due(state)) <= at:
            yield from self.end(key, state, due)

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- settled pages
class Settles(InEventOrder):
    """After an action a page settles once nothing has happened for a while, or at a hard limit.

    Quiet means: ``wait`` ms after the action (``dead_window`` for one that expects an answer and has none yet), no
    load and no request under way (each holds for ``inflight_max`` ms at most), ``net_quiet`` ms without network and
    ``quiet`` ms without page activity. ``due`` is the earliest moment all of that holds if no further row comes, or the
    limit; a row before it moves it. Repeated requests for one path (from the third on) and long-lived ones hold
    nothing. The next action cuts an open settle short; activity after a settle reopens nothing but is counted until
    the next action.
    """

    row_fields = ["ms", "seq", "kind", "request_id", "path", "flag"]
    row_schema = "ms long, seq long, kind string, request_id string, path string, flag boolean"
    state_fields = ["open", "action", "started", "answer", "responded", "last_net", "last_active", "loading", "inflight", "seen", "requests", "after", "touched"]
    state_schema = ("open boolean, action long, started long, answer boolean, responded boolean, last_net long, last_active long, loading long, "
                    "inflight map<string,long>, seen map<string,long>, requests long, after long, touched long")
    output = "run_id {key}, action long, started_ms long, reason string, settled_ms long, responded boolean, requests long, earlier_activity long"

    def __init__(self, quiet=500, net_quiet=300, min_wait=200, dead_window=1000, inflight_max=3000, timeout=10_000, forget=3_600_000):
        self.quiet, self.net_quiet, self.min_wait, self.dead_window = quiet, net_quiet, min_wait, dead_window
        self.inflight_max, self.timeout, self.forget = inflight_max, timeout, forget

    def start(self):
        return {"open": False, "action": None, "started": None, "answer": False, "responded": False, "last_net": None, "last_active": None, "loading": None,
                "inflight": {}, "seen": {}, "requests": 0, "after": 0, "touched": 0}

    def _settles(self, s):
        wait = self.min_wait if s["responded"] or not s["answer"] else max(self.min_wait, self.dead_window)
        moments = [s["started"] + wait, s["last_net"] + self.net_quiet, s["touched"]]
        if s["last_active"] is not None:
            moments.append(s["last_active"] + self.quiet)
        if s["loading"] is not None:
            moments.append(s["loading"] + self.inflight_max)
        moments += [at + self.inflight_max for at in s["inflight"].values()]
        return max(moments)

    def due(self, s):
        return min(self._settles(s), s["started"] + self.timeout) if s["open"] else s["touched"] + self.forget

    def end(self, key, s, at):
        if not s["open"]:
            s["gone"] = True
            return
        reason = "quiet" if self._settles(s) <= s["started"] + self.timeout else "timeout"
        yield self._out(key, s, reason, at)

    def _out(self, key, s, reason, at):
        s["open"], s["touched"] = False, at
        earlier, s["after"] = s["after"], 0
        return Row(run_id=key[0], action=s["action"], started_ms=s["started"], reason=reason, settled_ms=at, responded=s["responded"], requests=s["requests"], earlier_activity=earlier)

    def fold(self, key, s, r):
        at, kind = r["ms"], r["kind"]
        s["touched"] = max(s["touched"], at)
        if kind == "action":
            if s["open"]:
                yield self._out(key, s, "next_action", at)
            s.update(open=True, action=r["seq"], started=at, answer=bool(r["flag"]), responded=False, last_net=at, loading=None, inflight={}, seen={}, requests=0)
            return
        if kind == "activity":
            s["last_active"] = at
        if not s["open"]:
            s["after"] += 1
            return
        held = {k: v for k, v in s["inflight"].items() if at - v < self.inflight_max}
        if kind == "activity":
            s["responded"] = True
        elif kind == "load_start":
            s["loading"], s["responded"] = at, True
        elif kind == "load_stop":
            s["loading"] = None
        elif kind == "request":
            s["requests"] += 1
            seen = dict(s["seen"])
            seen[r["path"]] = seen.get(r["path"], 0) + 1
            s["seen"] = seen
            if not r["flag"] and seen[r["path"]] <= 2:
                held.setdefault(r["request_id"], at)
                s["last_net"] = at
        elif kind in ("finish", "data") and r["request_id"] in held:
            if kind == "finish":
                held.pop(r["request_id"])
            s["last_net"] = at
        s["inflight"] = held


def stream_settles(events: DataFrame, delay: str, **limits: int) -> DataFrame:
    """One row for every action of a page: when and why the page counted as settled.

    events: run_id, ts, seq (breaks ties and names the action), kind (action, activity, request, data, finish,
    load_start, load_stop), request_id, path, flag (of an action: it expects an answer; of a request: it is long-lived).
    reason: quiet, timeout, or next_action. earlier_activity: rows between the settle before and this action.
    limits: quiet, net_quiet, min_wait, dead_window, inflight_max, timeout, forget, all in ms.
    """
    key = dict(events.dtypes)["run_id"]
    rows = events.where("run_id is not null and ts is not null").withWatermark("ts", delay).select(
        "run_id", "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("long").alias("seq"), "kind", F.col("request_id").cast("string").alias("request_id"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce("flag", F.lit(False)).alias("flag"))
    return rows.groupBy("run_id").transformWithState(Settles(**limits), Settles.output.format(key=key), "append", "EventTime")


# ---------------------------------------------------------------- closed journeys
_FLAGS = ("done", "acts", "seen", "timed", "indoc", "answered", "unsettled", "settle_timeouts", "every_click", "clicks", "dead", "judged", "moved", "unexpected", "new_tabs",
          "chosen_external", "request_inclusive")
_SUMS = ("shifts", "site_ms", "decision_ms")
_MOST = ("max_shift", "longest")


def step_values(steps: DataFrame) -> DataFrame:
    """What a journey's fold needs of each step, as flags and numbers: the row form of the batch summary."""
    seen = P.interaction() & P.measured()
    timed = seen & F.col("operation").isin(*K.TRUSTED_INPUT) & ~P.new_document()
    indoc = seen & ~P.new_document()
    answer = F.when(indoc, P.visible_response())
    click, moved = P.countable_click(), P.executed() | P.between_steps()
    shift = F.when(seen, F.coalesce("shifts_post_input", F.lit(0.0)))
    site = F.when(P.executed(), F.coalesce("execution_ms", F.lit(0.0)) + F.coalesce("settle_ms", F.lit(0.0)))
    tab, external = F.coalesce("new_tab", F.lit(False)), F.coalesce("external_nav", F.lit(False))
    flags = {
        "done": P.executed(), "acts": P.interaction(), "seen": seen, "timed": timed, "indoc": indoc, "answered": answer.isNotNull(),
        "unsettled": P.executed() & F.col("settle_ms").isNull(), "settle_timeouts": P.executed() & (F.col("settle_reason") == "timeout"),
        "every_click": click, "clicks": click & P.effect().isNotNull(), "dead": click & P.no_effect(), "judged": P.interaction() & P.effect().isNotNull(),
        "moved": P.between_steps(), "unexpected": moved & P.unexpected_nav(), "new_tabs": moved & P.unexpected_nav() & tab,
        "chosen_external": P.executed() & F.col("operation").isin("CLICK", "SELECT") & external & ~P.unexpected_nav(),
        "request_inclusive": answer.isNotNull() & P.request_inclusive()}
    numbers = {"shifts": shift, "site_ms": site, "decision_ms": F.coalesce("decision_latency_ms", F.lit(0.0)), "max_shift": shift, "longest": F.when(timed, F.col("event_timing_max_ms"))}
    acting = P.executed() & (F.col("operation") != "WAIT")
    pages = F.when(moved, F.array(page_key(F.col("url_before")), page_key(F.col("url_after"))))
    return steps.select(
        "*", F.array(*[F.coalesce(flags[n], F.lit(False)).cast("int") for n in _FLAGS]).alias("_flags"), F.array(*[numbers[n].cast("double") for n in (*_SUMS, *_MOST)]).alias("_numbers"),
        answer.alias("_answer"), acting.alias("_acting"), F.when(P.interaction() & P.no_effect(), F.col("node")).cast("long").alias("_dead_node"), pages.alias("_pages"))


class Journeys(InEventOrder):
    """A journey ends with a DONE or BLOCKED row, when its budget of executed steps is used up, or when it is idle.

    The state holds the sums, maxima and counts of the batch summary, the rage streak, the last page, the visits of each
    page and a count for each response time, so the closing row carries every friction KPI's input. A closed journey is
    remembered for ``forget`` ms; rows in that time are counted and reported when it is forgotten.
    """

    row_fields = ["ms", "seq", "ending", "budget", "flags", "numbers", "answer", "acting", "dead_node", "pages"]
    row_schema = "ms long, seq long, ending string, budget long, flags array<int>, numbers array<double>, answer double, acting boolean, dead_node long, pages array<string>"
    state_fields = ["closed", "last", "steps", "flags", "numbers", "node", "streak", "rage", "page", "visited", "answers", "counts", "after", "opened"]
    state_schema = ("closed boolean, last long, steps long, flags array<long>, numbers array<double>, node long, streak long, rage long, page string, visited map<string,long>, "
                    "answers array<double>, counts array<long>, after long, opened long")
    output = ("run_id {key}, reason string, opened_ms long, closed_ms long, steps long, " + ", ".join(f"{n} long" for n in _FLAGS) + ", " + ", ".join(f"{n} double" for n in (*_SUMS, *_MOST))
              + ", rage_events long, visits long, unique_pages long, response_ms double")

    def __init__(self, idle=1_800_000, forget=86_400_000):
        self.idle, self.forget = idle, forget

    def start(self):
        return {"closed": False, "last": None, "steps": 0, "flags": [0] * len(_FLAGS), "numbers": [None] * 5, "node": None, "streak": 0, "rage": 0, "page": None, "visited": {},
                "answers": [], "counts": [], "after": 0, "opened": None}

    def due(self, s):
        return s["last"] + (self.forget if s["closed"] else self.idle)

    def end(self, key, s, at):
        if s["closed"]:
            s["gone"] = True
            if s["after"]:
                yield self._out(key, s, "after_close", at, s["after"])
        else:
            yield from self._close(key, s, "idle", at)

    def _close(self, key, s, reason, at):
        yield self._out(key, s, reason, at, s["steps"])
        fresh = self.start()
        s.update(fresh, closed=True, last=at, opened=s["opened"])

    def _out(self, key, s, reason, at, steps):
        visits = sum(s["visited"].values())
        row = dict(zip(_FLAGS, s["flags"])) | dict(zip((*_SUMS, *_MOST), s["numbers"]))
        return Row(run_id=key[0], reason=reason, opened_ms=s["opened"], closed_ms=at, steps=steps, **row, rage_events=s["rage"], visits=visits, unique_pages=len(s["visited"]),
                   response_ms=_median(dict(zip(s["answers"], s["counts"]))))

    def fold(self, key, s, r):
        if s["closed"]:
            s["after"] += 1
            return
        s["opened"] = r["ms"] if s["opened"] is None else s["opened"]
        s["last"], s["steps"] = r["ms"], s["steps"] + 1
        s["flags"] = [a + b for a, b in zip(s["flags"], r["flags"])]
        mine, new = s["numbers"], r["numbers"]
        s["numbers"] = [b if a is None else a if b is None else a + b if i < len(_SUMS) else max(a, b) for i, (a, b) in enumerate(zip(mine, new))]
        if r["acting"]:
            node = r["dead_node"]
            s["streak"] = 0 if node is None else s["streak"] + 1 if node == s["node"] else 1
            s["node"] = node
            s["rage"] += s["streak"] == K.RAGE_RUN
        visited = dict(s["visited"])
        for page in r["pages"] or ():
            if page is not None and page != s["page"]:
                visited[page] = visited.get(page, 0) + 1
                s["page"] = page
        s["visited"] = visited
        if r["answer"] is not None:
            counts = dict(zip(s["answers"], s["counts"]))
            counts[r["answer"]] = counts.get(r["answer"], 0) + 1
            s["answers"], s["counts"] = list(counts), list(counts.values())
        if r["ending"]:
            yield from self._close(key, s, r["ending"], r["ms"])
        elif r["budget"] is not None and s["flags"][_FLAGS.index("done")] >= r["budget"]:
            yield from self._close(key, s, "budget", r["ms"])


def _median(counts: dict[float, int]) -> float | None:
    total, values = sum(counts.values()), sorted(counts.items())
    if not total:
        return None

    def at(rank: int) -> float:
        upto = 0
        for value, n in values:
            upto += n
            if upto >= rank:
                return value

    return (at((total + 1) // 2) + at(total // 2 + 1)) / 2


def stream_journeys(steps: DataFrame, delay: str, idle_ms: int = 1_800_000, forget_ms: int = 86_400_000) -> DataFrame:
    """One row for every closed journey: reason (done, blocked, budget, idle), times, and the summary of its steps.

    steps: the columns of a step, ts, ord and max_steps (null: no budget). Rows after the close come as one more row,
    reason after_close with their number as steps, when the journey is forgotten. ``friction.observations`` turns
    closed journeys into the friction KPIs.
    """
    key = dict(steps.dtypes)["run_id"]
    ending = F.when(F.col("operation") == "DONE", "done").when(F.col("operation") == "BLOCKED", "blocked")
    rows = step_values(steps.where("run_id is not null and ts is not null").withWatermark("ts", delay)).select(
        "run_id", "ts", F.unix_millis("ts").alias("ms"), F.col("ord").cast("long").alias("seq"), ending.alias("ending"), F.col("max_steps").cast("long").alias("budget"),
        F.col("_flags").alias("flags"), F.col("_numbers").alias("numbers"), F.col("_answer").cast("double").alias("answer"), F.col("_acting").alias("acting"),
        F.col("_dead_node").alias("dead_node"), F.col("_pages").alias("pages"))
    return rows.groupBy("run_id").transformWithState(Journeys(idle_ms, forget_ms), Journeys.output.format(key=key), "append", "EventTime")
