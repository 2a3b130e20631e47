"""Checks of tasks, votes and routing on orders/lineitem/documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteready.dims import catalog as C
from siteready.operators import judgments as J
from siteready.verify.base import DUCK_VIEWS, ORACLES, duck_view, half_even, query, spark_view, table, view

view("v_tasks", """SELECT o_orderkey % 100 AS run_id, o_orderkey AS task_id, o_orderkey AS task_ord, 'TRI.RETURNS_CLARITY' AS kpi_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'returns_clarity' ELSE 'value_prop' END AS rubric_id,
 CASE WHEN o_orderkey % 11 = 0 THEN 'rubrics.v1' ELSE 'rubrics.v2' END AS rubric_version,
 CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 3 END AS samples_required,
 CASE o_custkey % 6 WHEN 0 THEN 'request_failed' WHEN 1 THEN 'low_probability' END AS escalation_reason,
 CAST(floor(o_totalprice / 20) AS BIGINT) AS chars FROM orders""")
view("v_verdicts", """SELECT l_orderkey % 100 AS run_id, l_orderkey AS task_id, concat('j', CAST(l_suppkey % 5 AS VARCHAR(3))) AS judge_id,
 concat('m', CAST(l_suppkey % 3 AS VARCHAR(3))) AS model, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS arrival,
 l_orderkey * 1000000000000 + l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS verdict_id,
 CASE l_returnflag WHEN 'A' THEN 'clear' WHEN 'N' THEN 'vague' ELSE CASE WHEN l_quantity > 40 THEN 'other' ELSE 'absent' END END AS label,
 CASE WHEN l_quantity = 7 THEN 1.5 ELSE 1 - floor(l_discount * 128) / 128 END AS confidence, l_quantity AS qty FROM lineitem WHERE l_orderkey % 50 <> 49""")
view("v_finals", "SELECT o_orderkey % 100 AS run_id, o_orderkey AS task_id FROM orders WHERE o_orderpriority = '1-URGENT'")
view("v_checked", """SELECT *, CASE WHEN label = 'other' THEN 'unknown_label' WHEN confidence > 1 THEN 'invalid_confidence' END AS problem FROM v_verdicts""")
# valid first verdict per judge, ranked; the others by precedence
duck_view("v_heads", """SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY head) AS rk FROM (SELECT task_id, judge_id, min(arrival) AS head FROM v_checked
 WHERE problem IS NULL AND task_id NOT IN (SELECT task_id FROM v_finals) GROUP BY ALL)""")
duck_view("v_accept", """SELECT c.*, t.samples_required, CASE WHEN t.task_id IS NULL THEN c.problem
 WHEN f.full_at IS NOT NULL AND c.arrival > f.full_at THEN 'samples_complete' WHEN c.task_id IN (SELECT task_id FROM v_finals) THEN 'task_already_final'
 WHEN h.head IS NOT NULL AND c.arrival > h.head AND h.rk <= t.samples_required THEN 'duplicate_judge' ELSE c.problem END AS reason
FROM v_checked c LEFT JOIN v_tasks t USING (task_id) LEFT JOIN v_heads h USING (task_id, judge_id)
LEFT JOIN (SELECT task_id, max(head) FILTER (WHERE rk = samples_required) full_at FROM v_heads JOIN v_tasks USING (task_id) GROUP BY task_id) f ON f.task_id = c.task_id""")
duck_view("v_final", f"""SELECT run_id, task_id, CASE WHEN NOT tie AND top/samples + 1e-9 >= 2.0::DOUBLE/3 THEN best END AS label, {half_even("top/samples", 4)} AS agreement, samples,
 {half_even("CASE WHEN NOT tie AND top/samples + 1e-9 >= 2.0::DOUBLE/3 THEN bc/top ELSE c/samples END", 4)} AS confidence FROM (
 SELECT run_id, task_id, sum(n) samples, max(n) top, arg_max(label, n) best, arg_max(c, n) bc, sum(c) c, count(*) FILTER (WHERE n = mx) > 1 AS tie FROM (
  SELECT *, max(n) OVER (PARTITION BY task_id) mx FROM (SELECT run_id, task_id, label, count(*) n, sum(confidence) c FROM v_checked WHERE problem IS NULL GROUP BY ALL)) GROUP BY ALL)
 JOIN (SELECT task_id, samples_required FROM v_tasks) USING (task_id) WHERE samples >= samples_required""")


def _v(name):
    return lambda spark, d: spark_view(spark, d, name)


def _finals(spark, d):
    good = spark_view(spark, d, "v_checked").where("problem is null")
    return J.finalize(good, spark_view(spark, d, "v_tasks"))


@query("win_11_sample_cap", "SELECT run_id, task_id, judge_id, arrival, reason IS NULL AS accepted, reason FROM v_accept")
def _(spark, d):
    return J.accept_verdicts(spark_view(spark, d, "v_checked"), spark_view(spark, d, "v_tasks"),
                             spark_view(spark, d, "v_finals")).select("run_id", "task_id", "judge_id", "arrival", "accepted", "reason")


@query("agg_30_majority_vote", "SELECT run_id, task_id, label, agreement, CAST(samples AS BIGINT) AS samples, confidence FROM v_final")
def _(spark, d):
    return _finals(spark, d).select("run_id", "task_id", "label", "agreement", "samples", "confidence")


@query("agg_30_sticky_finals", "SELECT run_id, task_id, label, agreement, CAST(samples AS BIGINT) AS samples, confidence FROM (" + DUCK_VIEWS["v_final"].replace("samples >= samples_required", "samples >= least(samples_required, 1)")
       + ") WHERE task_id % 7 <> 0 UNION ALL SELECT run_id, task_id, 'kept', 1.0, 1, 0.5 FROM v_tasks WHERE task_id % 7 = 0")
def _(spark, d):
    """A seventh of the tasks was final before, with other results than a new vote gives; one sample settles the rest."""
    tasks = spark_view(spark, d, "v_tasks")
    stored = tasks.where("task_id % 7 = 0").select("run_id", "task_id", "kpi_id", F.lit("kept").alias("label"), F.lit(1.0).alias("agreement"), F.lit(1).cast("long").alias("samples"), F.lit(0.5).alias("confidence"), F.array(F.lit("m")).alias("models"))
    good = spark_view(spark, d, "v_checked").where("problem is null")
    return J.settle_finals(good, tasks, stored, 1).select("run_id", "task_id", "label", "agreement", "samples", "confidence")


duck_view("v_ev0", "SELECT verdict_id, 0 AS item, CAST(qty AS BIGINT) % 4 AS snippet_id, 'Quote ' || CAST(CAST(qty AS BIGINT) % 6 AS VARCHAR) AS quote FROM v_verdicts")


def _evidence(spark, d):
    v = spark_view(spark, d, "v_verdicts")
    q = F.col("qty").cast("long")
    return v.select("verdict_id", F.lit(0).alias("item"), (q % 4).alias("snippet_id"),
                    F.concat(F.lit("Quote "), (q % 6).cast("string")).alias("quote"))


@query("agg_31_merge_evidence", """SELECT task_id, string_agg(snippet_id || '=' || quote, ',' ORDER BY a) AS evidence FROM (
 SELECT f.task_id, e.snippet_id, min(c.arrival) a, e.quote, row_number() OVER (PARTITION BY f.task_id ORDER BY min(c.arrival)) AS r FROM v_final f
 JOIN v_checked c ON c.task_id = f.task_id AND c.label = f.label AND c.problem IS NULL JOIN v_ev0 e USING (verdict_id)
 GROUP BY f.task_id, e.snippet_id, e.quote) WHERE r <= 5 GROUP BY task_id""")
def _(spark, d):
    good = spark_view(spark, d, "v_checked").where("problem is null")
    e = J.merge_evidence(good, _finals(spark, d), _evidence(spark, d))
    return e.select("task_id", F.array_join(F.transform("evidence", lambda x: F.concat(x["snippet_id"].cast("string"), F.lit("="), x["quote"])), ",").alias("evidence"))


@query("join_19_validate_verdicts", """SELECT v.verdict_id, CASE WHEN t.task_id IS NULL THEN 'unknown_task' WHEN label NOT IN ('clear','vague','absent') THEN 'unknown_label'
 WHEN confidence > 1 THEN 'invalid_confidence' WHEN CAST(qty AS BIGINT) % 5 = 0 THEN CASE WHEN label = 'absent' THEN NULL ELSE 'missing_evidence' END
 WHEN CAST(qty AS BIGINT) % 4 = 3 THEN 'unknown_snippet' WHEN CAST(qty AS BIGINT) % 6 > 3 THEN 'quote_not_verbatim'
 WHEN CAST(qty AS BIGINT) % 4 <> 2 THEN 'quote_too_short' END AS problem
 FROM v_verdicts v LEFT JOIN (SELECT task_id FROM v_tasks WHERE task_id % 7 <> 0) t USING (task_id)""")
def _(spark, d):
    t = spark_view(spark, d, "v_tasks").where("task_id % 7 != 0").withColumn(
        "labels", F.array(F.lit("clear"), F.lit("vague"), F.lit("absent")))
    # snippet 2 is short enough to be quoted whole; 3 does not exist
    s = t.select("run_id", "task_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("snippet_id"))
    s = s.withColumn("snippet_id", F.col("snippet_id").cast("long")).withColumn("text", F.lit("see quote 0, quote 1, quote 2, quote 3"))
    e = _evidence(spark, d).join(spark_view(spark, d, "v_verdicts").where("cast(qty as bigint) % 5 != 0").select("verdict_id"), "verdict_id", "left_semi")
    e = e.withColumn("quote", F.when(F.col("snippet_id") == 2, F.regexp_replace("quote", "Quote ([0-3])", "See  QUOTE 0")).otherwise(F.col("quote")))
    return J.check_verdicts(spark_view(spark, d, "v_verdicts"), t, s, e, ("absent",)).select("verdict_id", "problem")


@query("agg_32_progress", """SELECT run_id, count(*) AS tasks_total, count(*) FILTER (WHERE coalesce(n,0) >= samples_required) AS samples_complete,
 count(*) FILTER (WHERE coalesce(n,0) < samples_required AND task_id NOT IN (SELECT task_id FROM v_finals)) AS tasks_remaining,
 count(*) FILTER (WHERE task_id IN (SELECT task_id FROM v_finals)) AS final FROM v_tasks LEFT JOIN (SELECT task_id, count(*) n FROM v_verdicts GROUP BY 1) USING (task_id) GROUP BY run_id""")
def _(spark, d):
    return J.progress(spark_view(spark, d, "v_tasks"), spark_view(spark, d, "v_verdicts"), spark_view(spark, d, "v_finals"))


@query("agg_33_judgment_summary", """SELECT f.run_id, count(*) finals, count(*) FILTER (WHERE samples = 1) single_sample, count(*) FILTER (WHERE escalation_reason IS NOT NULL) escalated_final,
 count(*) FILTER (WHERE om) by_model, count(*) FILTER (WHERE NOT om) by_panel FROM v_final f JOIN (SELECT task_id, bool_and(judge_id = 'j1') om FROM v_verdicts GROUP BY 1) USING (task_id)
 JOIN (SELECT task_id, escalation_reason FROM v_tasks) USING (task_id) GROUP BY f.run_id""")
def _(spark, d):
    return J.judgment_summary(_finals(spark, d), spark_view(spark, d, "v_verdicts"), spark_view(spark, d, "v_tasks"), "j1").drop("model_kpis", "panel_kpis")


@query("jdg_03_open_tasks", """SELECT run_id, task_id, escalation_reason IS NOT NULL AS asked_before FROM v_tasks WHERE rubric_id = 'returns_clarity' AND rubric_version = 'rubrics.v2'
 AND task_id NOT IN (SELECT task_id FROM v_finals) AND task_id NOT IN (SELECT task_id FROM v_verdicts WHERE qty > 25) AND coalesce(escalation_reason, '') <> 'low_probability'""")
def _(spark, d):
    return J.open_tasks(spark_view(spark, d, "v_tasks"), C.rubric_table(spark), spark_view(spark, d, "v_finals"),
                        spark_view(spark, d, "v_verdicts").where("qty > 25")).select("run_id", "task_id", "asked_before")


@query("jdg_04_settle", """SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM v_verdicts WHERE judge_id = 'j1') AND task_id NOT IN (SELECT task_id FROM v_finals)
 THEN 1 ELSE samples_required END AS samples_required FROM v_tasks""")
def _(spark, d):
    v = spark_view(spark, d, "v_verdicts").where("judge_id = 'j1'")
    return J.settle(spark_view(spark, d, "v_tasks"), v, spark_view(spark, d, "v_finals")).select("task_id", "samples_required")


@query("jdg_05_judged_observations", f"""SELECT task_id, kpi_id, CASE WHEN t.task_id % 5 = 0 AND agreement IS NOT NULL AND label IS NOT NULL THEN {half_even("CASE label WHEN 'clear' THEN 0.8 WHEN 'vague' THEN 0.0 END * agreement", 3)} END AS value_num,
 CASE WHEN t.task_id % 5 <> 0 AND label IS NOT NULL THEN label END AS value_str,
 CASE WHEN agreement IS NULL THEN 'judgment_pending' WHEN label IS NULL THEN 'judgment_uncertain' WHEN t.task_id % 5 = 0 AND label = 'absent' THEN 'judgment_unclear' END AS reason
 FROM v_tasks t LEFT JOIN v_final f USING (task_id)""")
def _(spark, d):
    t = spark_view(spark, d, "v_tasks").withColumn("rubric_id", F.when(F.col("task_id") % 5 == 0, "risk").otherwise("clarity"))
    t = t.withColumn("pages", F.array(F.struct(F.lit("p").alias("page_id"), F.lit("mobile").alias("profile"), F.lit("pdp").alias("stage"))))
    values = spark.createDataFrame([("risk", "clear", 0.8, None), ("risk", "vague", 0.0, None), ("clarity", "clear", None, "clear"),
                                    ("clarity", "vague", None, "vague"), ("clarity", "absent", None, "absent")],
                                   "rubric_id string, label string, value_num double, value_str string")
    return J.judged_observations(t, _finals(spark, d), values).select("task_id", "kpi_id", "value_num", "value_str", "reason")


@query("jdg_07_work_list", """SELECT run_id, task_id, judge_id, CAST((row_number() OVER (PARTITION BY run_id, judge_id ORDER BY task_id) - 1) // 8 AS BIGINT) AS batch FROM v_tasks
 CROSS JOIN (VALUES ('j0'),('j1')) j(judge_id) LEFT JOIN (SELECT task_id, count(*) n FROM v_verdicts GROUP BY 1) USING (task_id)
 WHERE coalesce(n,0) < samples_required AND task_id NOT IN (SELECT task_id FROM v_finals) AND (task_id, judge_id) NOT IN (SELECT task_id, judge_id FROM v_verdicts)""")
def _(spark, d):
    return J.work_list(spark_view(spark, d, "v_tasks"), ["j0", "j1"], spark_view(spark, d, "v_verdicts"),
                       spark_view(spark, d, "v_finals")).select("run_id", "task_id", "judge_id", "batch")


@query("jdg_01_valid_choice", """SELECT event_id, CASE WHEN k % 11 = 0 THEN false WHEN k % 7 = 0 THEN false ELSE p >= 0.5 - 0.0000005 END AS valid FROM
 (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, floor(value) % 101 / 100.0 AS p FROM events)""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    p = (F.floor("value") % 101) / 100.0
    probs = F.when(F.col("k") % 11 == 0, F.create_map(F.lit("a"), p, F.lit("x"), F.lit(1.0) - p)).otherwise(
        F.create_map(F.lit("a"), p, F.lit("b"), F.when(F.col("k") % 7 == 0, F.lit(1.2) - p).otherwise(F.lit(1.0) - p)))
    return e.select("event_id", J.valid_choice(F.lit("a"), p, probs, F.array(F.lit("a"), F.lit("b"))).alias("valid"))


@query("jdg_02_route", """SELECT verdict_id, CASE WHEN q % 13 = 0 THEN 'invalid_response' WHEN confidence < 0.95 THEN 'low_probability' WHEN q % 11 = 0 THEN 'invalid_response' WHEN q % 3 = 0 THEN 'position_flip'
 WHEN label = 'absent' THEN 'accepted' WHEN q % 4 = 0 THEN 'no_evidence' ELSE 'accepted' END AS outcome FROM (SELECT *, CAST(qty AS BIGINT) AS q FROM v_verdicts)""")
def _(spark, d):
    q = F.col("qty").cast("long")
    v = spark_view(spark, d, "v_verdicts").select(
        "verdict_id", "label", F.col("confidence").alias("probability"), (q % 13 != 0).alias("label_valid"), (q % 11 != 0).alias("reverse_valid"),
        F.when(q % 3 == 0, "?").otherwise(F.col("label")).alias("reverse_label"), (F.col("label") != "absent").alias("needs_quote"),
        F.when(q % 4 != 0, q).alias("evidence_choice"), F.lit(True).alias("evidence_valid"))
    return J.route_readings(v, 0.97).select("verdict_id", "outcome")


@query("jdg_06_parse_verdicts", """SELECT task_id, judge_id, label, confidence, '' AS rationale FROM v_verdicts WHERE CAST(qty AS BIGINT) % 6 <> 0 AND task_id IN (SELECT task_id FROM v_tasks)""")
def _(spark, d):
    v = spark_view(spark, d, "v_verdicts")
    body = F.to_json(F.struct(F.array(F.struct(F.col("task_id").cast("string").alias("task_id"), "label", "confidence")).alias("verdicts")))
    raw = v.select("run_id", "judge_id", "model", F.when(F.col("qty").cast("long") % 6 == 0, F.lit("no json here")).otherwise(
        F.concat(F.lit("Here you are: "), body, F.lit(" done"))).alias("payload"))
    t = spark_view(spark, d, "v_tasks").select("run_id", F.col("task_id").cast("string").alias("task_id"))
    return J.parse_verdicts(raw, t).select(F.col("task_id").cast("long").alias("task_id"), "judge_id", "label", "confidence", "rationale")


@query("win_14_page_tasks", """WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY task_ord) AS rn FROM v_tasks),
 w(run_id, rn, task_id, page, n, used) AS (SELECT run_id, rn, task_id, 0, 1, chars FROM t WHERE rn = 1 UNION ALL
 SELECT t.run_id, t.rn, t.task_id, CASE WHEN w.used + t.chars > 36000 OR w.n >= 15 THEN w.page + 1 ELSE w.page END, CASE WHEN w.used + t.chars > 36000 OR w.n >= 15 THEN 1 ELSE w.n + 1 END,
  CASE WHEN w.used + t.chars > 36000 OR w.n >= 15 THEN t.chars ELSE w.used + t.chars END FROM w JOIN t ON t.run_id = w.run_id AND t.rn = w.rn + 1)
 SELECT run_id, task_id, page FROM w""")
def _(spark, d):
    t = spark_view(spark, d, "v_tasks").withColumn("task_id", F.col("task_id").cast("string"))
    return J.page_tasks(t).select("run_id", F.col("task_id").cast("long").alias("task_id"), "page")


@query("win_14_page_tasks_linked", ORACLES["win_14_page_tasks"])
def _(spark, d):
    """Every run of more than 8 tasks through the links of a long run."""
    t = spark_view(spark, d, "v_tasks").withColumn("task_id", F.col("task_id").cast("string"))
    return J.page_tasks(t, together=8).select("run_id", F.col("task_id").cast("long").alias("task_id"), "page")


@query("agg_37_label_stability", f"SELECT task_id, CAST(sum(n) AS BIGINT) AS runs, {half_even('max(n)/sum(n)', 3)} AS agreement, max(n) = sum(n) AS stable FROM (SELECT task_id, label, count(*) n FROM v_verdicts GROUP BY ALL) GROUP BY task_id")
def _(spark, d):
    return J.label_agreement(spark_view(spark, d, "v_verdicts"))


@query("agg_36_per_rubric", f"""SELECT rubric_id, count(*) AS tasks, count(*) FILTER (WHERE escalation_reason IS NULL) AS accepted, {half_even("avg(chars/25000)", 3)} AS mean_p,
 count(*) FILTER (WHERE escalation_reason = 'request_failed') AS failed FROM v_tasks GROUP BY rubric_id""")
def _(spark, d):
    r = spark_view(spark, d, "v_tasks").select("rubric_id", F.col("escalation_reason").alias("escalated"), (F.col("chars") / 25000).alias("probability"))
    return J.per_rubric(r).select("rubric_id", "tasks", "accepted", "mean_p", F.col("escalated")["request_failed"].alias("failed"))


# ---------------------------------------------------------------- snippets, sharing, cache, absence
duck_view("v_blocks", r"SELECT doc_id, CAST(i - 1 AS INT) AS pos, trim(regexp_replace(lines[i], '\s+', ' ', 'g')) AS text, lang FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) u(i)")
duck_view("v_snip", "SELECT doc_id AS page_id, pos, substr(text, 1, 600) AS text, CASE pos % 3 WHEN 0 THEN 'cta' WHEN 1 THEN 'headline' ELSE 'other' END AS kind FROM v_blocks WHERE text <> ''")


def blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))


def _snips(spark, d):
    b = blocks(spark, d).select(F.lit(1).alias("run_id"), F.col("doc_id").alias("page_id"), "pos", "text", F.when(
        F.col("pos") % 3 == 0, "cta").when(F.col("pos") % 3 == 1, "headline").otherwise("other").alias("kind"))
    return J.select_snippets(b, C.rubric_kinds(spark).where("rubric_id = 'value_prop'"))


duck_view("v_sel", r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pri, pos) AS r FROM (
 SELECT page_id, kind, pos, pri, trim(text) AS text, row_number() OVER (PARTITION BY page_id, replace(lower(trim(text)), 'ß', 'ss') ORDER BY pri, pos) AS dup FROM (SELECT *, CASE kind WHEN 'headline' THEN 0 ELSE 1 END AS pri FROM v_snip WHERE kind <> 'other')) WHERE dup = 1) WHERE r <= 8""")


@query("win_10_select_snippets", "SELECT page_id, pos, kind, length(text) AS chars FROM v_sel")
def _(spark, d):
    return _snips(spark, d).select("page_id", "pos", "kind", F.length("text").alias("chars"))


@query("set_06_shared_tasks", """SELECT min(page_id) AS page_id, count(*) AS pages FROM (SELECT page_id, md5(string_agg(replace(lower(text), 'ß', 'ss'), chr(1) ORDER BY pos)) AS k FROM v_sel GROUP BY page_id) GROUP BY k""")
def _(spark, d):
    pages = table(spark, d, "documents").select(F.lit(1).alias("run_id"), F.col("doc_id").alias("page_id"), F.col("doc_id").alias("page_ord"),
                                               F.lit("mobile").alias("profile"), F.lit("pdp").alias("stage"))
    return J.make_tasks(_snips(spark, d), pages, C.rubric_table(spark)).select("page_id", F.size("pages").cast("long").alias("pages"))


@query("join_20_verdict_cache", """SELECT t.doc_id, c.judge_id, c.label FROM documents t JOIN (SELECT text, judge_id, arg_min(label, doc_id) AS label FROM (
 SELECT text, doc_id, doc_id % 3 AS judge_id, lang AS label FROM documents) GROUP BY text, judge_id) c USING (text)""")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("cache_key", J.judge_view_key(F.col("text"), F.lit("m1")))
    samples = docs.select("cache_key", (F.col("doc_id") % 3).alias("judge_id"), F.col("doc_id").alias("arrival"), F.col("lang").alias("label"), F.lit(0.5).alias("confidence"))
    t = docs.select(F.lit(1).alias("run_id"), F.col("doc_id").alias("task_id"), "cache_key")
    return J.apply_cache(t, J.cache_samples(samples)).select(F.col("task_id").alias("doc_id"), "judge_id", "label")


@query("join_21_absence_rows", """SELECT doc_id AS page_id, CASE WHEN n_chars < 300 OR doc_id % 13 = 0 THEN NULL WHEN lang = 'en' THEN 'basic' ELSE 'absent' END AS value_str,
 CASE WHEN n_chars < 300 THEN 'no_audit' WHEN doc_id % 13 = 0 THEN 'bot_challenge' ELSE 'no_snippets' END AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.lit(1).alias("run_id"), F.col("doc_id").alias("page_id"), (F.col("n_chars") >= 300).alias("has_audit"), (F.col("doc_id") % 13 == 0).alias("challenge"),
                        (F.col("lang") == "en").alias("has_rating"), F.lit(False).alias("has_returns_link"), F.lit(False).alias("has_badge"))
    rp = pages.select("run_id", "page_id", F.lit("social_proof").alias("rubric_id"), F.lit("MPI.SOCIAL_PROOF_RICH").alias("kpi_id"))
    tasks = table(spark, d, "labels").select(F.lit(1).alias("run_id"), F.lit("social_proof").alias("rubric_id"), F.col("doc_id").alias("page_id"))
    none = spark.createDataFrame([], "run_id int, rubric_id string, unresolved_reason string")
    return J.absence_rows(pages, tasks, rp, none).select("page_id", "value_str", "reason")
