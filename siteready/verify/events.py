"""Checks of the browser-event operators on events-derived logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteready.operators import events as E
from siteready.verify.base import ORACLES, duck_view, half_even, query, spark_view, view
from siteready.verify.scoring import CAT  # noqa: F401  (loads the shared views)

view("v_net", """SELECT run_id, CAST(k % 3 AS BIGINT) AS page_id, ord AS idx, t_us / 1000.0 AS ts, k,
 CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' WHEN 'purchase' THEN 'finished' WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN CASE WHEN run_id % 3 = 0 THEN 'data' ELSE 'commit' END WHEN k % 4 = 2 THEN 'context' ELSE 'data' END ELSE 'failed' END AS method,
 CASE WHEN k % 20 = 0 THEN concat('d', CAST(k % 40 AS VARCHAR(3))) ELSE concat('r', CAST(k % 12 AS VARCHAR(3))) END AS request_id,
 CASE WHEN k % 20 = 0 THEN concat('d', CAST(k % 40 AS VARCHAR(3))) ELSE concat('d', CAST(k % 5 * 20 AS VARCHAR(3))) END AS loader_id,
 CASE WHEN k % 6 < 4 THEN 'main' ELSE 'sub' END AS frame_id,
 CASE WHEN k % 20 = 0 THEN 'Document' WHEN k % 4 = 1 THEN 'Script' WHEN k % 4 = 2 THEN 'Image' ELSE 'XHR' END AS type,
 concat(CASE WHEN k % 9 = 0 THEN 'http' ELSE 'https' END, '://a.site', CAST(k % 4 AS VARCHAR(2)), '.example/x', CAST(k AS VARCHAR(3)), '.js') AS url,
 CASE WHEN k % 7 = 0 THEN 404 ELSE 200 END AS status, CAST(floor(value * 1000) AS BIGINT) AS encoded_bytes, k % 3 = 0 AS canceled,
 CASE WHEN k % 10 = 5 THEN 302 END AS redirect_status, CAST(k AS BIGINT) AS redirect_bytes,
 CASE WHEN k % 50 = 1 THEN 'blockable' END AS mixed_content, 'script' AS initiator FROM v_ev""")
duck_view("v_bounds", """SELECT s.*, coalesce((SELECT min(idx) FROM v_net c WHERE c.method = 'commit' AND c.run_id = s.run_id AND c.page_id = s.page_id AND c.idx > s.start),
  (SELECT min(idx) FROM v_net c WHERE c.method = 'context' AND c.frame_id = s.df AND c.run_id = s.run_id AND c.page_id = s.page_id AND c.idx > s.start)) AS commit FROM (
 SELECT run_id, page_id, max(idx) AS start, arg_max(request_id, idx) dr, arg_max(loader_id, idx) dl, arg_max(frame_id, idx) df, arg_max(ts, idx) dts FROM (SELECT * FROM v_net
  WHERE method = 'request' AND type = 'Document' AND redirect_status IS NULL AND request_id = loader_id QUALIFY frame_id = first_value(frame_id) OVER (PARTITION BY run_id, page_id ORDER BY idx)) GROUP BY ALL) s""")
duck_view("v_tail", "SELECT n.*, b.start, b.commit, b.dr, b.dl, b.df, b.dts FROM v_net n LEFT JOIN v_bounds b USING (run_id, page_id) WHERE b.start IS NULL OR n.idx >= b.start")
duck_view("v_stale", """SELECT DISTINCT run_id, page_id, request_id FROM v_tail WHERE start IS NOT NULL AND method = 'request' AND request_id <> dr AND loader_id <> dl
 AND (coalesce(idx < commit, false) OR frame_id = df OR ts < dts)""")
duck_view("v_reqs", """SELECT run_id, page_id, url, type, status, bytes, failed, mixed FROM (
 SELECT run_id, page_id, request_id, bool_or(method = 'request') known, coalesce(arg_max(url, idx) FILTER (WHERE method = 'response'), arg_max(url, idx) FILTER (WHERE method = 'request')) url,
  coalesce(arg_max(type, idx) FILTER (WHERE method = 'response'), arg_min(type, idx) FILTER (WHERE method = 'request')) type, arg_max(status, idx) FILTER (WHERE method = 'response') status,
  coalesce(arg_max(encoded_bytes, idx) FILTER (WHERE method = 'finished'), coalesce(sum(encoded_bytes) FILTER (WHERE method = 'data'), 0)) bytes,
  bool_or(method = 'failed' AND NOT canceled) failed, max(mixed_content) mixed FROM v_net WHERE method NOT IN ('commit', 'context') GROUP BY ALL) WHERE known
 UNION ALL SELECT run_id, page_id, url, type, redirect_status, redirect_bytes, false, mixed_content FROM v_net WHERE method = 'request' AND redirect_status IS NOT NULL""")
_DOMAIN = "regexp_extract(url, 'a\\.(site[0-9])', 1) || '.example'"


def _net(spark, d):
    return spark_view(spark, d, "v_net")


def _docs(net):
    return net.select("run_id", "page_id").distinct().withColumn("document_url", F.lit("https://www.site1.example/"))


@query("win_09_doc_bounds", "SELECT run_id, page_id, start, commit FROM v_bounds")
def _(spark, d):
    return E.doc_bounds(_net(spark, d)).select("run_id", "page_id", "start", "commit")


@query("join_22_document_events", "SELECT run_id, page_id, idx, method FROM v_tail WHERE (run_id, page_id, request_id) NOT IN (SELECT run_id, page_id, request_id FROM v_stale)")
def _(spark, d):
    return E.document_events(_net(spark, d)).select("run_id", "page_id", "idx", "method")


@query("agg_23_network_summary", f"""SELECT run_id, page_id, count(*) requests, CAST(sum(bytes) AS BIGINT) bytes_transfer, CAST(coalesce(sum(bytes) FILTER (WHERE type = 'Script'), 0) AS BIGINT) bytes_js,
 CAST(coalesce(sum(bytes) FILTER (WHERE type = 'Image'), 0) AS BIGINT) bytes_img, CAST(coalesce(sum(bytes) FILTER (WHERE {_DOMAIN} <> 'site1.example'), 0) AS BIGINT) bytes_third_party,
 coalesce(string_agg(DISTINCT CASE WHEN {_DOMAIN} <> 'site1.example' THEN {_DOMAIN} END, ',' ORDER BY CASE WHEN {_DOMAIN} <> 'site1.example' THEN {_DOMAIN} END), '') domains,
 count(*) FILTER (WHERE status >= 400) http_errors, count(*) FILTER (WHERE failed) failed, count(*) FILTER (WHERE starts_with(url, 'http:') OR mixed = 'blockable') mixed_content,
 CASE WHEN sum(bytes) > 0 THEN {half_even(f"coalesce(sum(bytes) FILTER (WHERE {_DOMAIN} <> 'site1.example'), 0)/sum(bytes)", 4)} ELSE 0 END third_party_share FROM v_reqs GROUP BY run_id, page_id""")
def _(spark, d):
    net = _net(spark, d)
    s = E.network_summary(E.requests(net), _docs(net))
    return s.withColumn("domains", F.array_join("third_party_domains", ",")).select(
        "run_id", "page_id", "requests", "bytes_transfer", "bytes_js", "bytes_img", "bytes_third_party", "domains", "http_errors", "failed", "mixed_content", "third_party_share")


@query("agg_24_by_type", "SELECT run_id, page_id, lower(type) AS type, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_reqs GROUP BY ALL")
def _(spark, d):
    return E.by_type(E.requests(_net(spark, d))).select("run_id", "page_id", F.explode("by_type").alias("type", "v")).select(
        "run_id", "page_id", "type", F.col("v.requests").alias("requests"), F.col("v.bytes").alias("bytes"))


@query("agg_25_resource_types", """SELECT CASE WHEN k % 5 = 0 THEN 'Fetch' WHEN k % 4 = 0 THEN 'Script' WHEN k % 4 = 1 THEN 'Image' WHEN k % 4 = 2 THEN 'Font' ELSE 'Other' END AS type, count(*) AS n FROM v_ev GROUP BY 1""")
def _(spark, d):
    e = spark_view(spark, d, "v_ev")
    ext = F.when(F.col("k") % 4 == 0, "js").when(F.col("k") % 4 == 1, "PNG").when(F.col("k") % 4 == 2, "woff2").otherwise("xyz")
    url = F.concat(F.lit("https://a.example/b.c/f."), ext, F.lit("?v=1.css"))
    return e.groupBy(E.resource_type(F.when(F.col("k") % 5 == 0, "fetch").otherwise("link"), url).alias("type")).agg(F.count(F.lit(1)).alias("n"))


# Resource timing of every page, and browser events of two thirds of them.
view("v_timing", """SELECT run_id, CAST(k % 3 AS BIGINT) AS page_id, ord AS idx, CASE WHEN k % 13 = 0 THEN 'data:x' ELSE concat(CASE WHEN k % 9 = 0 THEN 'http' ELSE 'https' END, '://a.site', CAST(k % 4 AS VARCHAR(2)), '.example/y',
 CASE k % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.PNG' WHEN 2 THEN '.woff2' ELSE '' END) END AS name, CASE WHEN k % 6 = 0 THEN 'fetch' ELSE 'link' END AS type, CASE WHEN k % 8 = 0 THEN 500 WHEN k % 8 = 1 THEN 0 ELSE 200 END AS status,
 CASE WHEN k % 10 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS transfer FROM v_ev""")
duck_view("v_all_reqs", """SELECT 'events' AS source, run_id, page_id, url, type, status, bytes, failed, mixed, idx FROM (
 SELECT run_id, page_id, request_id, bool_or(method = 'request') known, coalesce(arg_max(url, idx) FILTER (WHERE method = 'response'), arg_max(url, idx) FILTER (WHERE method = 'request')) url,
  coalesce(arg_max(type, idx) FILTER (WHERE method = 'response'), arg_min(type, idx) FILTER (WHERE method = 'request')) type, arg_max(status, idx) FILTER (WHERE method = 'response') status,
  coalesce(arg_max(encoded_bytes, idx) FILTER (WHERE method = 'finished'), coalesce(sum(encoded_bytes) FILTER (WHERE method = 'data'), 0)) bytes,
  bool_or(method = 'failed' AND NOT canceled) failed, max(mixed_content) mixed, max(idx) FILTER (WHERE method = 'request') idx FROM v_net WHERE method NOT IN ('commit', 'context') AND run_id % 3 <> 0 GROUP BY ALL) WHERE known
 UNION ALL SELECT 'events', run_id, page_id, url, type, redirect_status, redirect_bytes, false, mixed_content, idx FROM v_net WHERE method = 'request' AND redirect_status IS NOT NULL AND run_id % 3 <> 0
 UNION ALL SELECT 'resource_timing', run_id, page_id, name, CASE WHEN type = 'fetch' THEN 'Fetch' WHEN name LIKE '%.js' THEN 'Script' WHEN name LIKE '%.PNG' THEN 'Image' WHEN name LIKE '%.woff2' THEN 'Font' ELSE 'Other' END,
  nullif(status, 0), coalesce(transfer, 0), false, NULL, idx FROM v_timing WHERE name <> 'data:x' AND (run_id, page_id) NOT IN (SELECT run_id, page_id FROM v_net WHERE method = 'request' AND run_id % 3 <> 0)""")


@query("agg_25_page_network", f"""SELECT run_id, page_id, min(source) AS source, count(*) requests, CAST(sum(bytes) AS BIGINT) bytes_transfer, CAST(coalesce(sum(bytes) FILTER (WHERE type = 'Script'), 0) AS BIGINT) bytes_js,
 CAST(coalesce(sum(bytes) FILTER (WHERE type = 'Font'), 0) AS BIGINT) bytes_font, CAST(coalesce(sum(bytes) FILTER (WHERE {_DOMAIN} <> 'site1.example'), 0) AS BIGINT) bytes_third_party,
 count(*) FILTER (WHERE status >= 400) http_errors, count(*) FILTER (WHERE failed) failed, count(*) FILTER (WHERE starts_with(url, 'http:') OR mixed = 'blockable') mixed_content,
 coalesce(array_to_string(list_slice(list(url || ' ' || status ORDER BY idx, url, status) FILTER (WHERE status >= 400), 1, 10), '|'), '') AS samples FROM v_all_reqs GROUP BY run_id, page_id""")
def _(spark, d):
    net, timing = _net(spark, d).where("run_id % 3 <> 0"), spark_view(spark, d, "v_timing")
    s = E.page_network(net, timing, _docs(_net(spark, d)))
    samples = F.array_join(F.transform(F.coalesce("http_error_samples", F.array()), lambda x: F.concat(x["url"], F.lit(" "), x["status"].cast("string"))), "|")
    return s.withColumn("samples", samples).select(
        "run_id", "page_id", "source", "requests", "bytes_transfer", "bytes_js", "bytes_font", "bytes_third_party", "http_errors", "failed", "mixed_content", "samples")


view("v_logs", """SELECT run_id, CAST(k % 3 AS BIGINT) AS page_id, ord AS idx, ord, CASE k % 4 WHEN 0 THEN 'exception' WHEN 1 THEN 'console' ELSE 'log' END AS method,
 CASE WHEN k % 5 = 0 THEN 'warning' ELSE 'error' END AS type, CASE WHEN k % 7 = 0 THEN 'info' ELSE 'error' END AS level,
 CASE WHEN k % 8 = 2 THEN 'network' ELSE 'js' END AS log_source, concat('boom   ', CAST(k AS VARCHAR(3))) AS message, concat('E', CAST(k % 9 AS VARCHAR(3))) AS error FROM v_ev WHERE event_type = 'error'""")


@query("agg_26_page_errors", """SELECT run_id, page_id, count(*) AS console, count(*) FILTER (WHERE method = 'exception') AS page, array_to_string(list_slice(list('boom ' || k ORDER BY idx), 1, 10), '|') AS samples FROM (
 SELECT *, regexp_extract(message, '([0-9]+)', 1) AS k FROM v_logs WHERE method = 'exception' OR (method = 'console' AND type = 'error') OR (method = 'log' AND level = 'error' AND log_source <> 'network')) GROUP BY run_id, page_id""")
def _(spark, d):
    return E.page_errors(spark_view(spark, d, "v_logs")).withColumn("samples", F.array_join("samples", "|"))


@query("top_06_first_samples", "SELECT run_id, array_to_string(list_slice(list(error ORDER BY ord), 1, 5), ',') AS errors FROM v_logs GROUP BY run_id")
def _(spark, d):
    return E.first_samples(spark_view(spark, d, "v_logs"), ["run_id"], "ord", "error", 5, "errors").withColumn("errors", F.array_join("errors", ","))


@query("agg_38_error_groups", "SELECT run_id, error, count(DISTINCT page_id) AS pages, count(*) AS tasks, min(ord) AS first_seen FROM v_logs GROUP BY run_id, error")
def _(spark, d):
    return E.error_groups(spark_view(spark, d, "v_logs"))


view("v_long", """SELECT run_id, CAST(k % 3 AS BIGINT) AS page_id, k * 100.0 AS start_ms, value AS duration_ms, CASE WHEN event_type = 'view' THEN 'long_frame' ELSE 'long_task' END AS kind FROM v_ev""")


@query("agg_27_blocking_time", f"""SELECT run_id, page_id, {half_even("sum(CASE WHEN page_id = 2 THEN NULL WHEN kind = 'long_task' AND start_ms >= 500*page_id AND start_ms <= 6000 THEN greatest(duration_ms-50,0) ELSE 0 END)", 1)} AS tbt_approx,
 {half_even("coalesce(sum(duration_ms) FILTER (WHERE kind='long_task'),0)", 1)} AS long_tasks_ms, count(*) FILTER (WHERE kind='long_frame') AS loaf_count FROM v_long GROUP BY run_id, page_id""")
def _(spark, d):
    t = spark_view(spark, d, "v_long")
    p = t.select("run_id", "page_id").distinct().withColumn("fcp_ms", F.col("page_id") * 500.0).withColumn("load_ms", F.lit(3000.0)).where("page_id <> 2")
    return E.blocking_time(t, p)


# shifts: one page per user; ms compressed so windows and gaps both occur
view("v_shift", """SELECT run_id, CAST(0 AS BIGINT) AS page_id, ord AS seq, floor(t_us / 1000000000.0) * 1.0 AS t_s, (t_us / 1000.0 - 1704067200000.0) / 20000.0 AS start_ms,
 CAST(CAST(floor(value) AS INT) % 32 AS DOUBLE) / 64 AS value, k % 5 = 0 AS had_input FROM v_ev""")


@query("win_07_layout_shift", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM v_shift WHERE NOT had_input),
 w(run_id, rn, first, last, win) AS (SELECT run_id, rn, start_ms, start_ms, value FROM t WHERE rn = 1 UNION ALL SELECT t.run_id, t.rn,
  CASE WHEN t.start_ms - w.last < 1000 AND t.start_ms - w.first < 5000 THEN w.first ELSE t.start_ms END, t.start_ms,
  CASE WHEN t.start_ms - w.last < 1000 AND t.start_ms - w.first < 5000 THEN w.win + t.value ELSE t.value END FROM w JOIN t ON t.run_id = w.run_id AND t.rn = w.rn + 1)
 SELECT s.run_id, {half_even("coalesce(c.cls, 0)", 4)} AS cls, {half_even("s.post", 4)} AS cls_post_input FROM (SELECT run_id, coalesce(sum(value) FILTER (WHERE had_input), 0) AS post FROM v_shift GROUP BY 1) s
 LEFT JOIN (SELECT run_id, max(win) AS cls FROM w GROUP BY 1) c USING (run_id)""")
def _(spark, d):
    return E.layout_shift(spark_view(spark, d, "v_shift")).select("run_id", "cls", "cls_post_input")


view("v_busy_shift", "SELECT CAST(run_id % 2 AS BIGINT) AS run_id, page_id, seq, start_ms * 2 AS start_ms, value, had_input FROM v_shift")


@query("win_07_layout_shift_without_pause", ORACLES["win_07_layout_shift"].replace("v_shift", "v_busy_shift"))
def _(spark, d):
    """Two pages that shift without a pause: nearly every window is closed by its span."""
    return E.layout_shift(spark_view(spark, d, "v_busy_shift")).select("run_id", "cls", "cls_post_input")


view("v_pev", """SELECT run_id, CAST(0 AS BIGINT) AS page_id, ord AS seq, (t_us / 1000.0 - 1704067200000.0) / 10000.0 AS ts_ms, k, value,
 CASE event_type WHEN 'click' THEN 'mark' WHEN 'view' THEN 'mutation' WHEN 'purchase' THEN 'request' WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'shift' ELSE 'event_timing' END ELSE CASE WHEN k % 3 = 0 THEN 'navigation' ELSE 'error' END END AS kind,
 concat('k', CAST(k % 4 AS VARCHAR(2))) AS key, 20000.0 AS load_ms, k % 4 = 0 AS had_input, k % 6 = 0 AS excluded FROM v_ev""")


@query("win_08_spontaneous", """SELECT run_id, seq, spontaneous, sum(spontaneous::INT) OVER (PARTITION BY run_id, key ORDER BY seq) >= 3 AS excluded FROM (
 SELECT *, ts_ms >= load_ms AND ts_ms - greatest(load_ms, coalesce(lm, load_ms)) > 2000 AS spontaneous FROM (
  SELECT *, last_value(CASE WHEN kind = 'mark' THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS lm FROM v_pev) WHERE kind <> 'mark')""")
def _(spark, d):
    return E.mark_spontaneous(spark_view(spark, d, "v_pev").drop("excluded")).select("run_id", "seq", "spontaneous", "excluded")


@query("join_18_as_of_since", f"""SELECT a.run_id, a.seq AS action_id, count(*) FILTER (WHERE kind = 'mutation' AND NOT excluded) AS mutations, count(*) FILTER (WHERE kind = 'mutation') AS mutations_total,
 count(*) FILTER (WHERE kind = 'navigation') AS navigations, count(*) FILTER (WHERE kind = 'request' AND NOT excluded) AS requests, count(*) FILTER (WHERE kind = 'error') AS errors,
 {half_even("coalesce(sum(e.value) FILTER (WHERE kind = 'shift' AND had_input), 0)", 4)} AS shifts_post_input, max(e.value) FILTER (WHERE kind = 'event_timing') AS event_timing_max_ms,
 {half_even("min(e.ts_ms - a.ts_ms) FILTER (WHERE kind = 'navigation' OR (kind = 'mutation' AND NOT excluded))", 3)} AS first_response_ms
 FROM (SELECT run_id, seq, ts_ms FROM v_pev WHERE kind = 'mark') a LEFT JOIN (SELECT *, last_value(CASE WHEN kind = 'mark' THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS of FROM v_pev) e
 ON e.run_id = a.run_id AND e.of = a.seq AND e.kind <> 'mark' GROUP BY a.run_id, a.seq""")
def _(spark, d):
    from siteready.functions.numbers import round_half_even
    p = spark_view(spark, d, "v_pev")
    a = p.where("kind = 'mark'").select("run_id", "page_id", "seq", "ts_ms", F.col("seq").alias("action_id"))
    e = p.where("kind != 'mark'").drop("k", "key", "load_ms")
    return E.since(a, e).drop("page_id", "first_request_ms").withColumn("first_response_ms", round_half_even(F.col("first_response_ms"), 3))


@query("agg_35_call_quantiles", """SELECT k AS run_id, count(*) AS requests, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM v_ev GROUP BY k""")
def _(spark, d):
    e = spark_view(spark, d, "v_ev").select(F.col("k").alias("run_id"), F.col("value").alias("latency_ms"))
    return E.call_stats(e, ["run_id"]).select("run_id", "requests", "max", "p50", "p95")


@query("agg_34_model_costs", """SELECT run_id, count(*) AS requests, CAST(sum(floor(value)) AS DOUBLE) AS latency_ms, CAST(sum(k) AS BIGINT) AS input_tokens, arg_max('m' || (k % 3), ord) FILTER (WHERE k % 4 <> 0) AS model FROM v_ev GROUP BY run_id""")
def _(spark, d):
    e = spark_view(spark, d, "v_ev").select("run_id", "ord", F.lit(1).alias("requests"), F.floor("value").cast("double").alias("latency_ms"), F.col("k").cast("long").alias("input_tokens"),
                                            F.when(F.col("k") % 4 != 0, F.concat(F.lit("m"), (F.col("k") % 3).cast("string"))).alias("model"))
    return E.model_costs(e, ["run_id"])


@query("agg_50_journey_costs", f"""SELECT run_id, count(*) FILTER (WHERE kind='choose') AS choose, count(*) FILTER (WHERE kind='text' AND ok) AS text, count(*) FILTER (WHERE kind='text' AND NOT ok) AS text_failed,
 count(*) FILTER (WHERE kind='idle') AS stale_or_refused, count(*) FILTER (WHERE kind='failed') AS failed, {half_even("coalesce(sum(value) FILTER (WHERE kind='choose'),0)", 0)} AS decision_ms,
 {half_even("coalesce(sum(value) FILTER (WHERE kind='text'),0)", 0)} AS text_ms, CAST(coalesce(sum(k) FILTER (WHERE kind='choose'),0) AS BIGINT) AS input_tokens, arg_max('m' || (k % 3), ord) FILTER (WHERE kind='choose') AS model,
 {half_even("coalesce(sum(value/2) FILTER (WHERE k % 3 = 0),0)", 0)} AS site_ms FROM (SELECT *, k % 2 = 0 AS ok, CASE event_type WHEN 'click' THEN 'choose' WHEN 'view' THEN 'choose' WHEN 'purchase' THEN 'text' WHEN 'signup' THEN 'idle' ELSE 'failed' END AS kind FROM v_ev) GROUP BY run_id""")
def _(spark, d):
    e = spark_view(spark, d, "v_ev")
    t = F.col("event_type")
    dec = e.select("run_id", "ord", F.when(t.isin("click", "view"), "choose").when(t == "purchase", "text").when(t == "signup", "idle").otherwise("failed").alias("kind"),
                   (F.col("k") % 2 == 0).alias("ok"), F.col("value").alias("latency_ms"), F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model"), F.col("k").cast("long").alias("input_tokens"))
    st = e.select("run_id", (F.col("k") % 3 == 0).alias("executed"), (F.col("value") / 2).alias("execution_ms"), F.lit(0.0).alias("settle_ms"))
    return E.journey_costs(dec, st)
