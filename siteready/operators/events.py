"""Browser event logs -> page facts: newest document, network and error summaries, layout shifts, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.dims import constants as K
from siteready.functions import text as T
from siteready.functions import urls as U
from siteready.functions.numbers import round_half_even
from siteready.operators.quantiles import nearest_rank
from siteready.operators.scan import follow, with_last, with_previous, with_running

PAGE = ["run_id", "page_id"]


def doc_bounds(net: DataFrame, main_frame: Column | None = None) -> DataFrame:
    """(run, page) -> start: index of the newest main-frame document request; commit: the first commit after it.

    The main frame is the given column or else the frame of the page's first document request, so a document inside
    an iframe starts nothing. A page whose log has no commit takes the main frame's first new script context instead.

    net: run_id, page_id, idx, method (request|response|data|finished|failed|commit|context), request_id, loader_id,
    frame_id, type, redirect_status, ts.
    """
    is_start = ((F.col("method") == "request") & (F.col("type") == "Document") & F.col("redirect_status").isNull()
                & (F.col("request_id") == F.col("loader_id")))
    if main_frame is not None:
        is_start = is_start & (F.col("frame_id") == main_frame)
    frames = net.where(is_start).groupBy(*PAGE, "frame_id").agg(
        F.max_by(F.struct("idx", "request_id", "loader_id", "frame_id", "ts"), "idx").alias("_s"), F.min("idx").alias("_first"))
    starts = frames.groupBy(*PAGE).agg(F.min_by("_s", "_first").alias("_s"))
    starts = starts.select(*PAGE, F.col("_s.idx").alias("start"), F.col("_s.request_id").alias("doc_request"),
                           F.col("_s.loader_id").alias("doc_loader"), F.col("_s.frame_id").alias("doc_frame"),
                           F.col("_s.ts").alias("doc_ts"))
    commit, context = F.col("method") == "commit", (F.col("method") == "context") & (F.col("frame_id") == F.col("doc_frame"))
    commits = (net.where(F.col("method").isin("commit", "context")).select(*PAGE, "idx", "method", "frame_id").join(starts, PAGE)
               .where(F.col("idx") > F.col("start")).groupBy(*PAGE)
               .agg(F.coalesce(F.min(F.when(commit, F.col("idx"))), F.min(F.when(context, F.col("idx")))).alias("commit")))
    return starts.join(commits, PAGE, "left")


def document_events(net: DataFrame, main_frame: Column | None = None) -> DataFrame:
    """Events of each page's newest document, without requests that belong to an earlier one.

    Stale: another document's request sent before the commit, the old main-frame loader's at any time, or one whose
    clock is older than the document request. A page without a document request keeps all its events.
    """
    rows = net.join(doc_bounds(net, main_frame), PAGE, "left")
    rows = rows.where(F.col("start").isNull() | (F.col("idx") >= F.col("start")))
    other = ((F.col("method") == "request") & ~F.col("request_id").eqNullSafe(F.col("doc_request"))
             & ~F.col("loader_id").eqNullSafe(F.col("doc_loader")))
    early = F.coalesce(F.col("idx") < F.col("commit"), F.lit(False))
    old_frame = F.col("loader_id").isNotNull() & F.coalesce(F.col("frame_id") == F.col("doc_frame"), F.lit(False))
    older = F.coalesce(F.col("ts") < F.col("doc_ts"), F.lit(False))
    stale = rows.where(F.col("start").isNotNull() & other & (early | old_frame | older)).select(*PAGE, "request_id").distinct()
    return rows.join(stale, [*PAGE, "request_id"], "left_anti").drop("doc_request", "doc_loader", "doc_frame", "doc_ts")


def requests(net: DataFrame) -> DataFrame:
    """One row per request and redirect hop: url, type, status, bytes, failed, mixed, and the idx it was last sent at.

    A finished request has its final byte count, an unfinished one what arrived so far. A real failure is not hidden
    by a later cancel.
    """
    key = [*PAGE, "request_id"]
    is_request = (F.col("method") == "request") & ~F.coalesce(F.col("url").rlike(r"^(data:|blob:|about:)"), F.lit(False))
    n = net.where(is_request | F.col("method").isin("response", "data", "finished", "failed"))
    final = n.groupBy(*key).agg(
        F.max(F.col("method") == "request").alias("_known"),
        F.coalesce(F.max_by(F.when(F.col("method") == "response", F.col("url")), F.when(F.col("method") == "response", F.col("idx"))),
                   F.max_by(F.when(F.col("method") == "request", F.col("url")), F.when(F.col("method") == "request", F.col("idx")))).alias("url"),
        F.coalesce(F.max_by(F.when(F.col("method") == "response", F.col("type")), F.when(F.col("method") == "response", F.col("idx"))),
                   F.min_by(F.when(F.col("method") == "request", F.col("type")), F.when(F.col("method") == "request", F.col("idx"))),
                   F.lit("Other")).alias("type"),
        F.max_by("status", F.when(F.col("method") == "response", F.col("idx"))).alias("status"),
        F.max_by("encoded_bytes", F.when(F.col("method") == "finished", F.col("idx"))).alias("_done"),
        F.sum(F.when(F.col("method") == "data", F.col("encoded_bytes")).otherwise(0)).alias("_data"),
        F.max((F.col("method") == "failed") & ~F.coalesce("canceled", F.lit(False))).alias("failed"),
        F.max("mixed_content").alias("mixed"), F.max("initiator").alias("initiator"), F.max(F.when(F.col("method") == "request", F.col("idx"))).alias("idx"))
    final = final.where("_known")
    favicon = (F.col("initiator") == "other") & (U.path(F.col("url")) == "/favicon.ico")
    final = final.select(*key, "url", "type", "status", F.coalesce("_done", "_data").cast("long").alias("bytes"), "failed",
                         "mixed", F.coalesce(favicon, F.lit(False)).alias("browser_probe"), "idx")
    hops = n.where((F.col("method") == "request") & F.col("redirect_status").isNotNull()).select(
        *key, "url", "type", F.col("redirect_status").alias("status"), F.coalesce("redirect_bytes", F.lit(0)).cast("long").alias("bytes"),
        F.lit(False).alias("failed"), F.col("mixed_content").alias("mixed"), F.lit(False).alias("browser_probe"), "idx")
    return final.unionByName(hops)


def resource_type(initiator: Column, url: Column) -> Column:
    """Type of a resource-timing row: from its initiator, else its file extension, else Other."""
    by_init = F.create_map(*[F.lit(v) for p in K.INITIATOR_TYPES.items() for v in p])[initiator]
    by_ext = F.create_map(*[F.lit(v) for p in K.EXTENSION_TYPES.items() for v in p])[
        F.lower(F.regexp_extract(url, r"/[^/?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))]
    return F.coalesce(by_init, by_ext, F.lit("Other"))


def network_summary(reqs: DataFrame, documents: DataFrame, domains: int | None = 20) -> DataFrame:
    """Per page: requests, bytes in all and by asset kind, third parties, errors, failures, mixed content.

    Two levels: (page, domain, type) first, so a page with very many requests combines before it meets in one row.
    documents: run_id, page_id, document_url. A page that is not in documents keeps its counts; it has no third parties
    and no mixed content. domains: how many third-party domains are listed, None for all.
    """
    r = reqs.withColumn("domain", U.registrable_domain(U.host(F.col("url"))))
    r = r.join(documents, PAGE, "left")
    https = F.coalesce(F.startswith("document_url", F.lit("https:")), F.lit(False))
    error = (F.coalesce("status", F.lit(0)) >= 400) & ~F.col("browser_probe")
    mixed = https & (F.startswith("url", F.lit("http:")) | F.coalesce(F.col("mixed").isin("blockable", "optionally-blockable"), F.lit(False)))
    level1 = r.groupBy(*PAGE, "document_url", "domain", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_if(error).alias("e"), F.count_if("failed").alias("f"),
        F.count_if(mixed).alias("m"))
    own = F.coalesce(U.registrable_domain(U.host(F.col("document_url"))), F.lit(""))
    third = F.coalesce((F.col("domain") != "") & (own != "") & (F.col("domain") != own), F.lit(False))
    # ranked before they are collected, so that a page's list never holds more than is shown
    foreign = F.when(third, F.col("domain"))
    level1 = level1.withColumn("_d", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy(foreign.asc_nulls_last())))
    listed = foreign if domains is None else F.when(F.col("_d") <= domains, foreign)
    g = level1.groupBy(*PAGE).agg(
        F.sum("n").alias("requests"), F.sum("b").alias("bytes_transfer"),
        *[F.sum(F.when(F.col("type") == t, F.col("b")).otherwise(0)).alias(c) for t, c in K.ASSET_BYTES.items()],
        F.sum(F.when(third, F.col("b")).otherwise(0)).alias("bytes_third_party"),
        F.array_sort(F.collect_set(listed)).alias("third_party_domains"),
        F.sum("e").alias("http_errors"), F.sum("f").alias("failed"), F.sum("m").alias("mixed_content"))
    share = F.when(F.col("bytes_transfer") > 0, round_half_even(F.col("bytes_third_party") / F.col("bytes_transfer"), 4)).otherwise(0.0)
    return g.withColumn("third_party_share", share)


def http_errors(reqs: DataFrame, n: int = 10) -> DataFrame:
    """Per page: its first n failed responses as (url, status), in the order they were sent. A browser's own favicon
    request is none of the page's."""
    wrong = reqs.where((F.col("status") >= 400) & ~F.col("browser_probe"))
    sample = wrong.select(*PAGE, F.struct("idx", "url", "status").alias("_at"), F.struct("url", "status").alias("sample"))
    return first_samples(sample, PAGE, "_at", "sample", n, "http_error_samples")


def resource_rows(resources: DataFrame) -> DataFrame:
    """Resource-timing rows in the form of ``requests``: typed by initiator or extension, a status of 0 is unknown.

    Bytes are a lower bound, as other origins may hide theirs. resources: run_id, page_id, idx, name (the URL), type (the
    initiator), status, transfer.
    """
    r = resources.where(~F.coalesce(F.col("name").rlike("^(data:|blob:)"), F.lit(False)))
    url = F.coalesce("name", F.lit(""))
    return r.select(*PAGE, url.alias("url"), resource_type(F.col("type"), url).alias("type"), F.when(F.col("status") != 0, F.col("status")).alias("status"),
                    F.coalesce("transfer", F.lit(0)).cast("long").alias("bytes"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("mixed"),
                    F.lit(False).alias("browser_probe"), "idx")


def page_network(net: DataFrame, resources: DataFrame, documents: DataFrame, domains: int | None = 20) -> DataFrame:
    """``network_summary`` of every page with its source and error samples: from browser events where the page has a
    request among them, else from resource timing."""
    seen = requests(net)
    rest = resource_rows(resources).join(seen.select(*PAGE).distinct(), PAGE, "left_anti")
    both = seen.drop("request_id").withColumn("source", F.lit("events")).unionByName(rest.withColumn("source", F.lit("resource_timing")))
    source = both.groupBy(*PAGE).agg(F.first("source").alias("source"))
    return network_summary(both.drop("source"), documents, domains).join(source, PAGE).join(http_errors(both), PAGE, "left")


def by_type(reqs: DataFrame) -> DataFrame:
    """Per page: a map from lower-cased resource type to its requests and bytes."""
    g = reqs.groupBy(*PAGE, F.lower("type").alias("type")).agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))
    entries = F.array_sort(F.collect_list(F.struct("type", F.struct("requests", "bytes").alias("v"))))
    return g.groupBy(*PAGE).agg(F.map_from_entries(entries).alias("by_type"))


def first_samples(df: DataFrame, keys: list[str], order: str, value: str, n: int, name: str) -> DataFrame:
    """The first n values per key in order, as a list: ranked first, so only n rows per key are collected."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    top = df.withColumn("_r", rank).where(F.col("_r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias(name))


def page_errors(logs: DataFrame) -> DataFrame:
    """Per page: console errors, uncaught exceptions, ten trimmed samples.

    logs: run_id, page_id, idx, method (exception|console|log), type, level, log_source, message. Network log entries
    are left out: failed responses are counted as HTTP errors.
    """
    keep = ((F.col("method") == "exception") | ((F.col("method") == "console") & F.col("type").isin("error", "assert"))
            | ((F.col("method") == "log") & (F.col("level") == "error") & ~F.coalesce(F.col("log_source") == "network", F.lit(False))))
    e = logs.where(keep).withColumn("sample", F.substring(T.squash(F.col("message")), 1, 200))
    counts = e.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("console"), F.count_if(F.col("method") == "exception").alias("page"))
    return counts.join(first_samples(e, PAGE, "idx", "sample", 10, "samples"), PAGE, "left")


def blocking_time(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: blocking time of long tasks between first paint and load + 3 s, total long-task time, long frames.

    tasks: run_id, page_id, start_ms, duration_ms, kind (long_task|long_frame). pages: run_id, page_id, fcp_ms, load_ms.
    A page whose load time is not known has no blocking time, but keeps its other sums.
    """
    t = tasks.join(pages, PAGE, "left")
    long = F.col("kind") == "long_task"
    inside = long & (F.col("start_ms") >= F.coalesce("fcp_ms", F.lit(0.0))) & (F.col("start_ms") <= F.col("load_ms") + 3000)
    return t.groupBy(*PAGE).agg(
        round_half_even(F.sum(F.when(F.col("load_ms").isNull(), None).when(inside, F.greatest(F.col("duration_ms") - 50, F.lit(0.0)))
                              .otherwise(0.0)), 1).alias("tbt_approx"),
        round_half_even(F.sum(F.when(long, F.col("duration_ms")).otherwise(0.0)), 1).alias("long_tasks_ms"),
        F.count_if(F.col("kind") == "long_frame").alias("loaf_count"))


def layout_shift(shifts: DataFrame, gap_ms: float = 1000.0, span_ms: float = 5000.0) -> DataFrame:
    """Per page: CLS (largest session window) and the sum of input-caused shifts.

    A window closes on a gap of 1 s or at a span of 5 s. Gaps cut a page into islands; an island within the span is one
    window and its sum needs no order. In a longer island the window that would begin at a shift ends where the next
    one begins, and following these links from the island's first shift gives its windows: rows are spread by (page,
    island, 5 s), so a page that shifts without a pause is many tasks. Start times do not fall along seq.
    shifts: run_id, page_id, seq, start_ms, value, had_input.
    """
    free = shifts.where("not had_input").select(*PAGE, "seq", "start_ms", "value")
    free = with_previous(free, PAGE, "seq", ["start_ms"], 1)
    gap = F.col("prev1").isNull() | (F.col("start_ms") - F.col("prev1.start_ms") >= gap_ms)
    free = with_running(free, PAGE, "seq", {"island": F.when(gap, 1).otherwise(0), "_upto": F.col("value")})
    part = [*PAGE, "island"]
    spans = free.groupBy(*part).agg(F.min("start_ms").alias("_from"), F.max("start_ms").alias("_to"), F.sum("value").alias("win"), F.min("seq").alias("_first"), F.max("_upto").alias("_all"))
    capped = F.col("_to") - F.col("_from") >= span_ms
    windows = spans.where(~capped).select(*PAGE, "win").unionByName(_capped_windows(free, spans.where(capped), part, span_ms))
    cls = windows.groupBy(*PAGE).agg(round_half_even(F.max("win"), 4).alias("cls"))
    post = shifts.groupBy(*PAGE).agg(round_half_even(F.sum(F.when(F.col("had_input"), F.col("value")).otherwise(0.0)), 4).alias("cls_post_input"))
    return post.join(cls, PAGE, "left").withColumn("cls", F.coalesce("cls", F.lit(0.0)))


def _capped_windows(free: DataFrame, spans: DataFrame, part: list[str], span_ms: float) -> DataFrame:
    """(page, win): the windows of islands longer than the span."""
    rows = free.join(spans.select(*part, "_first", "_all"), part)
    slot = lambda at: F.floor(at / span_ms)
    here = rows.select(*part, slot(F.col("start_ms")).alias("_slot"), F.col("start_ms").alias("_at"), F.lit(1).alias("_kind"), "seq", F.lit(None).cast("long").alias("_of"))
    end = F.col("start_ms") + span_ms
    ends = rows.select(*part, slot(end).alias("_slot"), end.alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("seq"), F.col("seq").alias("_of"))
    # The first shift at or after a window's end lies in the end's slot, or is the first of the next one: slots of an
    # island are not empty, as the span exceeds the gap.
    # Read backwards, as a frame that runs on to the end of its partition is evaluated anew for each row.
    ahead = Window.partitionBy(*part, "_slot").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = here.unionByName(ends).withColumn("_next", F.last("seq", ignorenulls=True).over(ahead)).where("_kind = 0")
    heads = rows.groupBy(*part, (slot(F.col("start_ms")) - 1).alias("_slot")).agg(F.min("seq").alias("_head"))
    links = found.join(heads, [*part, "_slot"], "left").select(*part, F.col("_of").alias("pos"), F.coalesce("_next", "_head").alias("nxt"))
    starts = follow(links, spans.select(*part, F.col("_first").alias("pos")), part)
    begun = rows.select(*part, F.col("seq").alias("pos"), (F.col("_upto") - F.col("value")).alias("_before"), "_all").join(starts, [*part, "pos"])
    after = F.lead("_before").over(Window.partitionBy(*part).orderBy("pos"))
    return begun.select(*[k for k in part if k != "island"], (F.coalesce(after, F.col("_all")) - F.col("_before")).alias("win"))


def mark_spontaneous(events: DataFrame, quiet_ms: float = 2000.0, ticks: int = 3) -> DataFrame:
    """Events with flags: spontaneous (over 2 s after load and the latest mark) and excluded (its key repeats: a poller
    or ticker, from its third spontaneous time on).

    events: run_id, page_id, seq, ts_ms, kind, key, load_ms. Marks are rows of kind "mark".
    """
    e = with_last(events, PAGE, "seq", {"last_mark": F.when(F.col("kind") == "mark", F.col("ts_ms"))})
    ref = F.greatest(F.col("load_ms"), F.coalesce("last_mark", F.col("load_ms")))
    e = e.where("kind != 'mark'").withColumn("spontaneous", F.coalesce(
        (F.col("ts_ms") >= F.col("load_ms")) & (F.col("ts_ms") - ref > quiet_ms), F.lit(False)))
    e = with_running(e, [*PAGE, "key"], "seq", {"_spont": F.col("spontaneous").cast("int")})
    return e.withColumn("excluded", F.col("_spont") >= ticks).drop("_spont")


def since(actions: DataFrame, events: DataFrame) -> DataFrame:
    """What happened after each action's mark up to the next one: an as-of carry of the action id over its page's
    events, then one grouped aggregation. A new document counts as a navigation.

    actions: run_id, page_id, seq, ts_ms, action_id. events: run_id, page_id, seq, ts_ms, kind, value, had_input,
    excluded. seq orders both together.
    """
    a = actions.select(*PAGE, "seq", "ts_ms", "action_id")
    both = a.unionByName(events, allowMissingColumns=True)
    carried = with_last(both, PAGE, "seq", {"_of": F.when(
        F.col("action_id").isNotNull(), F.struct("action_id", F.col("ts_ms").alias("t0")))})
    e = carried.where("kind is not null and _of is not null").withColumn("_a", F.col("_of.action_id")).withColumn(
        "_dt", F.col("ts_ms") - F.col("_of.t0"))
    kind, fresh = F.col("kind"), ~F.coalesce("excluded", F.lit(False))
    mutation, nav = (kind == "mutation") & fresh, kind == "navigation"
    g = e.groupBy(*PAGE, F.col("_a").alias("action_id")).agg(
        F.min(F.when(mutation | nav, F.col("_dt"))).alias("first_response_ms"),
        F.min(F.when((kind == "request") & fresh, F.col("_dt"))).alias("first_request_ms"),
        F.count_if(mutation).alias("mutations"), F.count_if(kind == "mutation").alias("mutations_total"),
        F.count_if(nav).alias("navigations"), F.count_if((kind == "request") & fresh).alias("requests"),
        F.count_if(kind == "error").alias("errors"),
        round_half_even(F.sum(F.when((kind == "shift") & F.coalesce("had_input", F.lit(False)), F.col("value")).otherwise(0.0)), 4).alias("shifts_post_input"),
        F.max(F.when(kind == "event_timing", F.col("value"))).alias("event_timing_max_ms"))
    out = actions.select(*PAGE, "action_id").join(g, [*PAGE, "action_id"], "left")
    return out.na.fill(0, ["mutations", "mutations_total", "navigations", "requests", "errors", "shifts_post_input"])


def call_stats(calls: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Per key: requests, sum, max and nearest-rank p50/p95 of call latencies."""
    g = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum(value).alias("sum"), F.max(value).alias("max"))
    return g.join(nearest_rank(calls, keys, F.col(value), {"p50": 0.5, "p95": 0.95}), keys, "left")


def model_costs(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: requests, latency, input tokens and the model of the latest answer. Merging earlier totals is a union
    before this aggregation."""
    return calls.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("latency_ms").alias("latency_ms"), F.sum("input_tokens").alias("input_tokens"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("model"))


def journey_costs(decisions: DataFrame, steps: DataFrame) -> DataFrame:
    """Per run: what deciding cost, kept apart from the site's time.

    decisions: run_id, ord, kind (choose|text|idle|failed), ok, latency_ms, model, input_tokens, output_tokens.
    steps: run_id, executed, execution_ms, settle_ms.
    """
    choose, text = F.col("kind") == "choose", F.col("kind") == "text"
    d = decisions.groupBy("run_id").agg(
        F.count_if(choose).alias("choose"), F.count_if(text & F.col("ok")).alias("text"), F.count_if(text & ~F.col("ok")).alias("text_failed"),
        F.count_if(F.col("kind") == "idle").alias("stale_or_refused"), F.count_if(F.col("kind") == "failed").alias("failed"),
        round_half_even(F.sum(F.when(choose, F.col("latency_ms")).otherwise(0.0)), 0).alias("decision_ms"),
        round_half_even(F.sum(F.when(text, F.col("latency_ms")).otherwise(0.0)), 0).alias("text_ms"),
        F.sum(F.when(choose, F.col("input_tokens")).otherwise(0)).alias("input_tokens"),
        F.max_by("model", F.when(choose, F.col("ord"))).alias("model"))
    site = F.coalesce("execution_ms", F.lit(0.0)) + F.coalesce("settle_ms", F.lit(0.0))
    s = steps.groupBy("run_id").agg(round_half_even(F.sum(F.when(F.col("executed"), site).otherwise(0.0)), 0).alias("site_ms"))
    return d.join(s, "run_id", "full")


def error_groups(errors: DataFrame) -> DataFrame:
    """Per run and message (300 characters): tasks and distinct pages hit, in first-seen order.

    (message, page) pairs combine first, so a message with very many errors is spread by page.
    """
    e = errors.withColumn("error", F.substring("error", 1, 300))
    pairs = e.groupBy("run_id", "error", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    return pairs.groupBy("run_id", "error").agg(F.count("page_id").alias("pages"), F.sum("n").alias("tasks"), F.min("o").alias("first_seen"))
