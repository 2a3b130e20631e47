"""Checks of the step-log operators on events-derived steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteready.functions import friction as P
from siteready.functions import urls as U
from siteready.operators import friction as R
from siteready.operators import scoring as S
from siteready.verify.base import duck_view, half_even, query, spark_view, table, view
from siteready.verify.scoring import CAT

view("v_ev", "SELECT user_id AS run_id, event_id AS ord, EPOCH_US(ts) AS t_us, event_type, value, "
             "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
view("v_steps", """
SELECT run_id, ord, t_us, k, value,
 CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'purchase' THEN 'SELECT' WHEN 'signup' THEN 'TYPE_TEXT'
  WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'WAIT' ELSE 'SCROLL_DOWN' END ELSE 'NAVIGATION' END AS operation,
 CASE WHEN k % 17 = 0 THEN NULL ELSE k % 2 END AS node,
 CASE k % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'textbox' END AS role,
 k % 11 <> 0 AS role_recorded, CASE WHEN k % 29 = 0 THEN 'consent' END AS source,
 concat('https://Shop.example/p', CAST(k % 9 AS VARCHAR(2))) AS url_before,
 CASE WHEN k % 13 = 0 THEN concat('https://shop.example/p', CAST((k + 1) % 9 AS VARCHAR(2)), '?b=2&a=1#f')
  ELSE concat('https://Shop.example/p', CAST(k % 9 AS VARCHAR(2))) END AS url_after,
 CASE WHEN k % 9 = 0 THEN NULL ELSE value >= 90 END AS page_changed, k % 10 <> 0 AS since_available,
 CASE WHEN value >= 70 THEN CAST(floor(value) AS INT) % 7 ELSE 0 END AS mutations,
 CASE WHEN value >= 70 THEN CAST(floor(value) AS INT) % 7 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS mutations_total,
 CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS navigations, k % 5 AS requests,
 value AS first_response_ms, k % 7 <> 0 AS first_request_recorded,
 CASE WHEN k % 23 = 0 THEN 0.05 ELSE 0.0 END AS shifts_post_input,
 CASE WHEN k % 6 <> 0 THEN value END AS event_timing_max_ms,
 k % 31 = 0 AS stale, k % 37 = 0 AS guard_blocked, k % 41 = 0 AS new_tab, k % 26 = 0 AS new_document,
 k % 2 = 0 AS new_document_recorded, k % 43 = 0 AS external_nav, k % 47 = 0 AS navigation_error,
 CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 = 1 END AS state_changed, k % 8 = 0 AS follows_timeout,
 value / 2 AS execution_ms, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS settle_ms,
 CASE WHEN k % 10 = 3 THEN 'timeout' ELSE 'quiet' END AS settle_reason, value * 3 AS decision_latency_ms
FROM v_ev
""")
view("v_journeys", """
SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS profile,
 CASE user_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS success,
 CASE WHEN user_id % 8 = 3 THEN 'bot_challenge' END AS unverified,
 CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 5 + 8 AS INT) END AS optimal_steps,
 CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 7 AS INT) END AS optimal_pages FROM events
""")
view("v_steps_raw", """
SELECT run_id, ord AS step, 2 * ord AS line_no, operation, CAST(NULL AS DOUBLE) AS settle_ms, url_before AS url FROM v_steps
UNION ALL
SELECT run_id, ord AS step, 2 * ord + 1 AS line_no, operation, settle_ms, url_after AS url FROM v_steps WHERE k % 7 <> 3
UNION ALL
SELECT run_id, CAST(NULL AS BIGINT) AS step, 2 * ord + 1 AS line_no, operation, settle_ms, url_after AS url FROM v_steps WHERE k % 50 = 3
""")
duck_view("v_flags", """
SELECT *, act AND since_available AS seen, act AND operation = 'CLICK' AND (NOT role_recorded OR coalesce(role IN ('button','link'), false)) AS click,
 CASE WHEN new_tab OR external_nav OR navigation_error THEN true
  WHEN since_available AND (mutations > 0 OR navigations > 0 OR shifts_post_input > 0) THEN true
  WHEN since_available AND page_changed AND mutations_total = 0 THEN true
  WHEN since_available AND state_changed IS NOT NULL THEN state_changed ELSE page_changed END AS eff,
 CASE WHEN new_document_recorded THEN new_document ELSE navigations > 0 AND url_after <> url_before END AS newdoc,
 CASE WHEN mutations > 0 OR navigations > 0 THEN first_response_ms END AS resp
FROM (SELECT *, done AND operation IN ('CLICK','TYPE_TEXT','SELECT') AS act FROM (SELECT *, source IS NULL AND operation <> 'NAVIGATION' AND NOT stale AND NOT guard_blocked AS done FROM v_steps))
""")
duck_view("v_flags2", """
SELECT *, NOT (operation = 'NAVIGATION' AND follows_timeout) AND (new_tab OR (operation NOT IN ('CLICK','SELECT') AND (newdoc OR external_nav))) AS unexp
FROM v_flags
""")
duck_view("v_visits", """
SELECT run_id, ord, page FROM (SELECT *, lag(page) OVER (PARTITION BY run_id ORDER BY ord) AS prev FROM (
 SELECT run_id, 2 * ord AS ord, lower(url_before) AS page FROM v_flags WHERE done OR operation = 'NAVIGATION' UNION ALL
 SELECT run_id, 2 * ord + 1, replace(replace(lower(url_after), '#f', ''), '?b=2&a=1', '?a=1&b=2') FROM v_flags WHERE done OR operation = 'NAVIGATION'))
WHERE prev IS DISTINCT FROM page
""")
duck_view("v_rage", """
SELECT run_id, ord, n >= 3 AS rage, n = 3 AS rage_start FROM (
 SELECT *, CASE WHEN dn IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY run_id, isl ORDER BY ord) END AS n FROM (
  SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY ord) AS isl FROM (
   SELECT run_id, ord, dn, CASE WHEN dn IS NOT NULL AND dn = lag(dn) OVER (PARTITION BY run_id ORDER BY ord) THEN 0 ELSE 1 END AS brk FROM (
    SELECT run_id, ord, CASE WHEN act AND eff = false THEN node END AS dn FROM v_flags WHERE done AND operation <> 'WAIT'))))
""")
_NUM = {
    "PERF.CLS_POST_INPUT": ("CASE WHEN seen > 0 THEN " + half_even("shifts", 4) + " END", "CASE WHEN seen = 0 THEN untried END"),
    "PERF.INP_SYNTH": ("CASE WHEN timed > 0 THEN " + half_even("greatest(coalesce(longest,0),16)", 1) + " END",
                       "CASE WHEN timed > 0 THEN CASE WHEN coalesce(longest,0) < 16 THEN 'upper_bound:below_threshold' END WHEN seen > 0 THEN 'not_applicable:no_timed_interaction' ELSE untried END"),
    "PERF.ACTION_RESPONSE_MS": ("CASE WHEN answered > 0 THEN " + half_even("med", 1) + " END",
                                "CASE WHEN answered > 0 THEN NULL WHEN indoc > 0 THEN 'not_applicable:no_visible_response' WHEN seen > 0 THEN 'not_applicable:no_interaction_in_document' ELSE untried END"),
    "FAI.ACTIONS_TO_GOAL": ("CASE WHEN goal IS NULL THEN acts END", "goal"),
    "FAI.ACTIONS_RATIO": ("CASE WHEN goal IS NULL AND optimal_steps >= 1 THEN " + half_even("acts/optimal_steps", 2) + " END",
                          "coalesce(goal, CASE WHEN optimal_steps >= 1 THEN NULL ELSE 'not_applicable:minimum_steps_unknown' END)"),
    "FAI.TIME_ON_TASK_SITE": ("CASE WHEN goal IS NULL THEN " + half_even("coalesce(site_ms,0)", 0) + " END", "goal"),
    "FAI.DEAD_CLICK_RATE": ("CASE WHEN clicks > 0 THEN " + half_even("100.0::DOUBLE*dead/clicks", 1) + " END",
                            "CASE WHEN clicks > 0 THEN NULL WHEN every_click > 0 THEN 'no_measurement' ELSE 'not_applicable:no_click' END"),
    "FAI.RAGE_EVENTS": ("CASE WHEN judged > 0 THEN coalesce(rage_events,0) END", "CASE WHEN judged = 0 THEN untried END"),
    "FAI.BACKTRACK_RATE": ("CASE WHEN vis > 0 THEN " + half_even("100.0::DOUBLE*(vis-uniq)/vis", 1) + " END", "CASE WHEN coalesce(vis,0) = 0 THEN 'not_applicable:no_action_executed' END"),
    "FAI.LOSTNESS": ("CASE WHEN goal IS NULL AND vis > 0 AND optimal_pages >= 1 THEN " + half_even("least(1.0::DOUBLE, sqrt(pow(uniq/vis-1,2)+pow(least(optimal_pages,uniq)/uniq-1,2)))", 3) + " END",
                     "coalesce(goal, CASE WHEN coalesce(vis,0)=0 THEN 'not_applicable:no_action_executed' WHEN optimal_pages >= 1 THEN NULL ELSE 'not_applicable:minimum_pages_unknown' END)"),
    "FAI.UNEXPECTED_NAV": ("CASE WHEN done > 0 OR moved > 0 THEN unexpected END", "CASE WHEN done = 0 AND moved = 0 THEN 'not_applicable:no_action_executed' END"),
}
duck_view("v_sum", """
SELECT j.*, s.* EXCLUDE (run_id), v.vis, v.uniq, g.rage_events, CASE WHEN acts > 0 THEN 'no_measurement' ELSE 'not_applicable:no_interaction' END AS untried,
 CASE WHEN success THEN NULL WHEN success IS NULL THEN coalesce(unverified, 'no_verification') ELSE 'not_applicable:goal_not_reached' END AS goal
FROM v_journeys j LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE done) done, count(*) FILTER (WHERE act) acts, count(*) FILTER (WHERE seen) seen,
  sum(shifts_post_input) FILTER (WHERE seen) shifts, count(*) FILTER (WHERE seen AND operation IN ('CLICK','TYPE_TEXT') AND NOT newdoc) timed,
  max(event_timing_max_ms) FILTER (WHERE seen AND operation IN ('CLICK','TYPE_TEXT') AND NOT newdoc) longest,
  count(*) FILTER (WHERE seen AND NOT newdoc) indoc, count(resp) FILTER (WHERE seen AND NOT newdoc) answered,
  median(resp) FILTER (WHERE seen AND NOT newdoc) med, sum(coalesce(execution_ms,0)+coalesce(settle_ms,0)) FILTER (WHERE done) site_ms,
  count(*) FILTER (WHERE click) every_click, count(*) FILTER (WHERE click AND eff IS NOT NULL) clicks, count(*) FILTER (WHERE click AND eff = false) dead,
  count(*) FILTER (WHERE act AND eff IS NOT NULL) judged, count(*) FILTER (WHERE operation = 'NAVIGATION') moved,
  count(*) FILTER (WHERE (done OR operation = 'NAVIGATION') AND unexp) unexpected FROM v_flags2 GROUP BY run_id) s USING (run_id)
LEFT JOIN (SELECT run_id, count(*) vis, count(DISTINCT page) uniq FROM v_visits GROUP BY run_id) v USING (run_id)
LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE rage_start) rage_events FROM v_rage GROUP BY run_id) g USING (run_id)
""")
duck_view("v_fric", " UNION ALL ".join(
    f"SELECT run_id, profile, '{k}' AS kpi_id, ({v})::DOUBLE AS value_num, NULL::BOOLEAN AS value_bool, {r} AS reason FROM v_sum"
    for k, (v, r) in _NUM.items()) + " UNION ALL SELECT run_id, profile, 'FAI.JOURNEY_SUCCESS', NULL, success, CASE WHEN success IS NULL THEN coalesce(unverified,'no_verification') END FROM v_sum")


def _steps(spark, d):
    return spark_view(spark, d, "v_steps")


_PRED = {
    "prj_05_executed": ("done AS executed, act AS interaction, operation = 'NAVIGATION' AS between_steps",
                        lambda: [P.executed().alias("executed"), P.interaction().alias("interaction"), P.between_steps().alias("between_steps")]),
    "prj_06_countable_click": ("click AS countable_click, since_available AS measured",
                               lambda: [P.countable_click().alias("countable_click"), P.measured().alias("measured")]),
    "prj_07_effect": ("eff AS effect", lambda: [P.effect().alias("effect")]),
    "prj_08_dead_click": ("click AND coalesce(eff = false, false) AS dead_click", lambda: [P.is_dead_click().alias("dead_click")]),
    "prj_09_visible_response": ("resp AS visible_response, NOT first_request_recorded AND requests > 0 AS request_inclusive, newdoc AS new_document",
                                lambda: [P.visible_response().alias("visible_response"), P.request_inclusive().alias("request_inclusive"), P.new_document().alias("new_document")]),
    "prj_10_unexpected_nav": ("unexp AS unexpected_nav", lambda: [P.unexpected_nav().alias("unexpected_nav")]),
}
for _name, (_sql, _cols) in _PRED.items():
    def _run(spark, d, cols=_cols):
        return _steps(spark, d).select("run_id", "ord", *cols())
    query(_name, f"SELECT run_id, ord, {_sql} FROM v_flags2")(_run)


@query("win_01_dedup_steps", """SELECT run_id, step, min(line_no) AS line_no, arg_max(operation, line_no) AS operation,
 arg_max(coalesce(settle_ms, -1), line_no) AS settle_ms, arg_max(url, line_no) AS url FROM v_steps_raw WHERE step IS NOT NULL GROUP BY run_id, step
 UNION ALL SELECT run_id, step, line_no, operation, coalesce(settle_ms, -1), url FROM v_steps_raw WHERE step IS NULL""")
def _(spark, d):
    return R.dedup_steps(spark_view(spark, d, "v_steps_raw")).withColumn("settle_ms", F.coalesce("settle_ms", F.lit(-1.0)))


@query("win_02_visits", "SELECT run_id, ord, page FROM v_visits")
def _(spark, d):
    return R.visits(_steps(spark, d))


@query("win_03_rage", "SELECT run_id, ord, rage, rage_start FROM v_rage")
def _(spark, d):
    return R.rage(_steps(spark, d))


@query("win_04_backtrack", "SELECT run_id, ord, page, row_number() OVER (PARTITION BY run_id, page ORDER BY ord) > 1 AS backtrack FROM v_visits")
def _(spark, d):
    return R.backtracks(R.visits(_steps(spark, d)))


@query("agg_28_friction_kpis", "SELECT * FROM v_fric")
def _(spark, d):
    return R.metrics(_steps(spark, d), spark_view(spark, d, "v_journeys")).select(
        "run_id", "profile", "kpi_id", "value_num", "value_bool", "reason")


@query("agg_29_lostness", f"""SELECT run_id, uniq AS unique_pages, vis AS visits, CASE WHEN optimal_pages >= 1 THEN
 {half_even("least(1.0::DOUBLE, sqrt(pow(uniq/vis-1,2)+pow(least(optimal_pages,uniq)/uniq-1,2)))", 3)} END AS lostness FROM v_sum WHERE vis > 0""")
def _(spark, d):
    v = R.visits(_steps(spark, d)).groupBy("run_id", "page").agg(F.count(F.lit(1)).alias("n"))
    v = v.groupBy("run_id").agg(F.sum("n").alias("visits"), F.count(F.lit(1)).alias("unique_pages"))
    j = spark_view(spark, d, "v_journeys").select("run_id", "optimal_pages")
    return v.join(j, "run_id").select("run_id", "unique_pages", "visits", F.when(
        F.col("optimal_pages") >= 1, R.lostness(F.col("unique_pages"), F.col("visits"), F.col("optimal_pages"))).alias("lostness"))


@query("score_journeys", None)
def _(spark, d):
    """Step log to headline: friction KPIs of every journey, scored."""
    obs = R.metrics(_steps(spark, d), spark_view(spark, d, "v_journeys"))
    return S.score_runs(obs, CAT)


# ---------------------------------------------------------------- URLs
duck_view("v_purl", r"""
SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS sch, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
 regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages
""")
_DOM = ("CASE WHEN len(string_split(host,'.')) > 2 AND len(list_extract(string_split(host,'.'),-1)) = 2 AND list_extract(string_split(host,'.'),-2) IN ('co','com','org') "
        "THEN array_to_string(list_slice(string_split(host,'.'),-3,-1),'.') ELSE array_to_string(list_slice(string_split(host,'.'),-2,-1),'.') END")


@query("prj_01_page_key", """SELECT page_id, sch || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END ||
 CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS page_key FROM v_purl""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.page_key(F.col("url")).alias("page_key"))


@query("prj_02_registrable_domain", f"SELECT page_id, {_DOM} AS domain FROM v_purl")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.registrable_domain(U.host(F.col("url"))).alias("domain"))


@query("prj_03_same_site", f"SELECT page_id, {_DOM} = 'example.com' AS same_site FROM v_purl")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.same_site(F.col("url"), F.lit("https://www.example.com/")).alias("same_site"))


@query("prj_04_clean_cart_url", r"""SELECT page_id, regexp_extract(u, '^([^?#]*)', 1) || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS cleaned, dropped FROM (
 SELECT page_id, u, array_to_string(list_filter(parts, lambda p: NOT regexp_matches(p, '^(qty|add|remove)(=|$)')), '&') AS kept,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(parts, lambda p: regexp_matches(p, '^(qty|add|remove)(=|$)')), lambda p: string_split(p,'=')[1]))), ',') AS dropped
 FROM (SELECT page_id, u, string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&') AS parts FROM (SELECT page_id,
  CASE page_id % 3 WHEN 0 THEN 'https://s.example/cart?qty=2&add=7&ref=x#c' WHEN 1 THEN regexp_extract(url, '^([^?#]*)', 1) || '?remove=1' ELSE url END AS u FROM pages)))""")
def _(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.lit("https://s.example/cart?qty=2&add=7&ref=x#c")).when(
        F.col("page_id") % 3 == 1, F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("?remove=1"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.clean_cart_url(u).alias("cleaned"),
                                           F.array_join(U.cart_action_keys(u), ",").alias("dropped"))
