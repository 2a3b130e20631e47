"""Checks of sources, sinks, reports and the extension surface over files Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteready import api
from siteready.dims import catalog as Cat
from siteready.functions import numbers as N
from siteready.operators import friction as R
from siteready.operators import scoring as S
from siteready.operators.quantiles import weighted_median
from siteready.session import shared_dir
from siteready.sources import records as Rec
from siteready.sources import sinks as Snk
from siteready.sources.run_table import RunTable
from siteready.verify.base import ORACLES, half_even, query, spark_view, table
from siteready.verify.scoring import CAT, _kpis


def _runs(spark, d):
    """Run documents written as JSON: one run per customer, a page per order, an observation per line."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    obs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.lit("PERF.LCP").alias("kpi_id"), F.col("l_extendedprice").cast("string").alias("value"), F.col("l_returnflag").alias("stage"), (F.col("l_quantity") > 5).alias("assessed")))).alias("obs"))
    page = F.struct(F.col("o_orderkey").cast("string").alias("page_id"), F.lit("pdp").alias("stage"), F.struct(F.col("o_totalprice").alias("lcp")).alias("vitals"),
                    F.struct(F.array(F.struct(F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("value"))).alias("prices")).alias("audit"))
    runs = o.join(obs, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(
        F.array_sort(F.collect_list(page)).alias("pages"), F.flatten(F.collect_list("obs")).alias("observations"), F.lit("complete").alias("status"))
    path = shared_dir(spark, "runs")
    runs.write.json(path)
    return Rec.read_runs(spark, path, lines=True)


@query("src_01_read_runs", "SELECT CAST(o_custkey AS VARCHAR) AS run_id, count(*) AS pages, 'complete' AS status FROM orders GROUP BY o_custkey")
def _(spark, d):
    return _runs(spark, d).select("run_id", F.size("pages").alias("pages"), "status")


@query("src_04_normalise", f"SELECT 'pages' AS t, count(*) AS n, {half_even('sum(o_totalprice)', 0)} AS v FROM orders UNION ALL SELECT 'prices', count(*), {half_even('sum(o_totalprice)', 0)} FROM orders UNION ALL SELECT 'observations', count(*), {half_even('sum(l_extendedprice)', 0)} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    t = Rec.normalise(_runs(spark, d))
    def total(n, c): return t[n].agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n"), F.rint(F.sum(c)).alias("v"))
    return total("pages", "vitals.lcp").unionByName(total("prices", "value")).unionByName(total("observations", "value_num"))


@query("src_02_read_steps", """SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE k % 4 <> 3) AS roles, CAST(sum(mutations) AS BIGINT) AS mutations FROM (SELECT CAST(run_id AS VARCHAR) AS run_id, k, mutations FROM v_steps) GROUP BY run_id""")
def _(spark, d):
    s = spark_view(spark, d, "v_steps")
    doc = F.to_json(F.struct(F.col("run_id").cast("string").alias("run_id"), F.col("ord").alias("step"), "operation", "role", F.struct("mutations", F.lit(True).alias("available")).alias("since")))
    path = shared_dir(spark, "steps")
    torn = F.when(F.col("k") % 9 == 0, F.concat(doc, F.lit('\n{"step": 1, "oper'))).when(F.col("k") % 10 == 1, F.concat(doc, F.lit("\n[1, 2]"))).otherwise(doc)
    s.select(torn.alias("value")).write.text(path)
    return Rec.read_steps(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if("role_recorded").alias("roles"), F.sum("mutations").alias("mutations"))


@query("src_03_stream_steps", "SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS steps FROM events GROUP BY user_id")
def _(spark, d):
    from siteready.streaming.streams import drain
    path = shared_dir(spark, "stepstream")
    table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("step")).select(
        F.explode(F.array(F.to_json(F.struct("run_id", "step")), F.when(F.col("step") % 7 == 0, '{"run_id": "1", "st').when(F.col("step") % 7 == 1, "[1, 2]").otherwise(""))).alias("value")).repartition(4).write.text(path)
    return drain(Rec.stream_steps(spark, path, 2).select("run_id", "step"), "steps").groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"))


@query("src_05_dimensions", """SELECT 'registry' AS dim, owner AS part, count(*) AS n, count(DISTINCT kpi_id) AS kpis FROM v_obs JOIN d_reg USING (kpi_id) GROUP BY ALL
 UNION ALL SELECT 'segments', owner, count(*), count(DISTINCT kpi_id) FROM v_obs JOIN d_reg USING (kpi_id) JOIN (SELECT * FROM d_seg WHERE x0 IS NOT NULL AND x1 IS NOT NULL) USING (kpi_id) GROUP BY ALL
 UNION ALL SELECT 'map', owner, count(*), count(DISTINCT kpi_id) FROM v_obs JOIN d_reg USING (kpi_id) JOIN d_map USING (kpi_id) GROUP BY ALL""")
def _(spark, d):
    """The loaded dimensions joined to the observations, by the index that owns the KPI."""
    o = S.enrich(spark_view(spark, d, "v_obs").select("kpi_id"), CAT).select("kpi_id", "owner")
    parts = {"registry": o, "segments": o.join(CAT.segments(spark).select("kpi_id"), "kpi_id"), "map": o.join(CAT.anchor_map(spark).select("kpi_id"), "kpi_id")}
    out = None
    for name, df in parts.items():
        one = df.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kpi_id").alias("kpis")).select(F.lit(name).alias("dim"), F.col("owner").alias("part"), "n", "kpis")
        out = one if out is None else out.unionByName(one)
    return out


@query("src_06_net_events", "SELECT method, count(*) AS n, CAST(coalesce(sum(encoded_bytes), 0) AS BIGINT) AS bytes FROM v_net WHERE method IN ('request','finished','data') GROUP BY method")
def _(spark, d):
    n = spark_view(spark, d, "v_net").where(F.col("method").isin("request", "finished", "data"))
    name = F.when(F.col("method") == "request", "Network.requestWillBeSent").when(F.col("method") == "finished", "Network.loadingFinished").otherwise("Network.dataReceived")
    params = F.to_json(F.struct(F.col("request_id").alias("requestId"), F.col("encoded_bytes").alias("encodedDataLength"), F.struct("url").alias("request")))
    path = shared_dir(spark, "net")
    n.select(F.col("run_id").cast("string").alias("run_id"), F.col("page_id").cast("string").alias("page_id"), "idx", name.alias("method"), params.alias("params")).write.json(path)
    return Rec.read_net_events(spark, path).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("bytes"))


@query("src_07_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(spark, d):
    return Rec.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("chars"))


_CATLG = "SELECT page_id AS run_id, regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN ':8080' ELSE '' END AS host, page_id * 7 % 1009 AS created_at, CASE WHEN page_id % 5 = 0 THEN 'unreadable' ELSE 'complete' END AS status FROM pages"


def _catalogue(spark, d):
    h = F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.when(F.col("page_id") % 3 == 0, ":8080").otherwise(""))
    return table(spark, d, "pages").select(F.col("page_id").alias("run_id"), h.alias("host"), (F.col("page_id") * 7 % 1009).alias("created_at"), F.lit("complete").alias("status"), (F.col("page_id") % 5 != 0).alias("readable"))


@query("src_08_run_catalogue", f"SELECT * FROM ({_CATLG}) WHERE regexp_replace(host, ':8080', '') = 'blog.ththan.example.net' ORDER BY created_at DESC, run_id LIMIT 20")
def _(spark, d):
    return Rec.list_runs(_catalogue(spark, d), "https://blog.ththan.example.net/x", 20)


@query("top_01_newest_runs", f"SELECT * FROM ({_CATLG}) ORDER BY created_at DESC, run_id LIMIT 15")
def _(spark, d):
    return Rec.list_runs(_catalogue(spark, d), None, 15)


@query("src_08_newest_per_host", f"SELECT run_id, host, row_number() OVER (PARTITION BY host ORDER BY created_at DESC, run_id) AS rank FROM ({_CATLG}) QUALIFY rank <= 2")
def _(spark, d):
    return Rec.newest_per_host(_catalogue(spark, d), 2).select("run_id", "host", "rank")


@query("snk_01_replace_runs", "SELECT o_orderstatus AS run_date, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS replaced, count(DISTINCT o_orderkey) AS runs FROM orders GROUP BY 1")
def _(spark, d):
    # two rows a run at first; some runs of one date among many are written again with one
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("run_date"), F.lit(0).alias("version"))
    path = shared_dir(spark, "facts")
    again = (F.col("run_date") == "F") & (F.col("run_id") % 5 == 0)
    Snk.write_facts(o.unionByName(o.where(again)), path, 1)
    Snk.write_facts(o.where(again).withColumn("version", F.lit(1)), path, 2)
    return Snk.read_facts(spark, path).groupBy("run_date").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("replaced"), F.count_distinct("run_id").alias("runs"))


@query("snk_01_many_rewrites", """SELECT o_orderkey AS run_id, o_orderstatus AS status, w AS version FROM (SELECT *, (SELECT max(i) FROM range(0, 12) t(i) WHERE i = 0 OR (o_orderkey + i) % 7 = 0) AS w FROM orders)
 WHERE NOT (w > 0 AND w % 3 = 0) UNION ALL SELECT o_orderkey, o_orderstatus, w FROM (SELECT *, (SELECT max(i) FROM range(0, 12) t(i) WHERE i = 0 OR (o_orderkey + i) % 7 = 0) AS w FROM orders) WHERE w > 0 AND w % 3 = 1""")
def _(spark, d):
    """Twelve writes over the runs of one table: every later one replaces a seventh of them, each third one with nothing,
    the one after it with two rows. Shards reach their limit and are written as a whole on the way."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("version"))
    facts = RunTable(spark, shared_dir(spark, "facts"), o.schema, shards=8, most=4)
    facts.replace(o, 0)
    for i in range(1, 12):
        mine = o.where((F.col("run_id") + i) % 7 == 0)
        rows = mine.withColumn("version", F.lit(i))
        facts.replace(rows.limit(0) if i % 3 == 0 else rows.unionByName(rows) if i % 3 == 1 else rows, i, mine)
    return facts.read(11)


def _report_pages(spark, d):
    return spark_view(spark, d, "v_page").select("run_id", "page_id", "profile", "stage", "q", F.lit("u").alias("url"), F.lit(None).cast("string").alias("final_url"), F.col("price").alias("lcp_ms"), F.col("disc").alias("cls"),
                                                 (F.col("price") * 100).alias("bytes_transfer"), F.when(F.col("n") % 10 == 0, 0).otherwise(F.col("n")).alias("requests"))


_SCORE = ORACLES["score_headline"]


@query("snk_02_report_documents", "SELECT h.run_id, h.coverage, p.pages FROM (SELECT run_id, coverage FROM (SCORE) WHERE scope = 'overall') h LEFT JOIN (SELECT run_id, count(*) AS pages FROM v_page GROUP BY 1) p USING (run_id)".replace("SCORE", _SCORE))
def _(spark, d):
    k = _kpis(spark, d)
    sub = S.sub_indices(k, CAT, with_risk=True)
    gaps = spark_view(spark, d, "v_gaps").select("run_id", "stage", "profile", F.lit(None).cast("string").alias("kpi_id"), "reason")
    docs = Snk.report_documents(S.headline(sub, None, CAT), sub, S.risk_signals(k, 10), _report_pages(spark, d), gaps)
    path = shared_dir(spark, "reports")
    Snk.write_reports(docs, path)
    back = spark.read.schema("run_id long, headline struct<coverage:double>, pages array<struct<page_id:long>>").json(path)
    return back.select("run_id", F.col("headline.coverage").alias("coverage"), F.size("pages").cast("long").alias("pages"))


@query("snk_03_report_rows", """SELECT page_id, CASE WHEN n % 10 <> 0 THEN round_even(price * 100 / 1000, 0) END AS kb, CASE WHEN q >= 80 THEN 'good' WHEN q >= 50 THEN 'mid' ELSE 'bad' END AS band FROM v_page""")
def _(spark, d):
    p = _report_pages(spark, d).withColumn("profile", F.col("q").cast("string"))
    return Snk.report_pages(p).select("page_id", "kb", Snk.score_band(F.col("profile").cast("double")).alias("band"))


@query("snk_03_tags", """SELECT run_id, scope, kpi_id, CASE WHEN NOT applicable THEN 'skipped' WHEN NOT ok THEN 'missing' WHEN weight = 0 AND owner <> 'DPR' THEN 'info' WHEN source = 'judged' THEN 'inferred' ELSE 'observed' END AS tag FROM v_kpi""")
def _(spark, d):
    c = F.col
    return _kpis(spark, d).select("run_id", "scope", "kpi_id", Snk.kpi_tag(c("applicable"), c("assessed"), c("weight"), c("owner"), c("source")).alias("tag"))


@query("join_23_reason_labels", """SELECT reason, CASE reason WHEN 'not_applicable:no_data' THEN 'not applicable: no data' WHEN 'timeout' THEN 'timed out' WHEN 'not_reached' THEN 'stage not reached' END AS reason_label, count(*) AS n FROM v_obs WHERE reason IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    o = spark_view(spark, d, "v_obs").where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return Snk.label_reasons(o)


@query("agg_49_widget_caveats", "SELECT DISTINCT o_custkey AS run_id, o_orderpriority AS kpi_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0 AND (o_custkey, o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("kpi_id"), "o_orderstatus", "o_orderkey")
    s = o.where("o_orderstatus = 'O'").withColumn("assessed", F.lit(True)).withColumn("reason", F.lit("no_snippets"))
    ob = o.where("o_orderstatus = 'F'").withColumn("reason", F.lit("no_snippets")).withColumn("iframes", (F.col("o_orderkey") % 4 == 0).cast("int")).withColumn("shadow_roots", F.lit(0))
    return Snk.caveats(s, ob)


# ---------------------------------------------------------------- extension surface
@query("ext_01_register_kpi", "SELECT page_id, CAST(n % 3 AS DOUBLE) AS value_num FROM v_page WHERE n > 10")
def _(spark, d):
    e = api.Engine(CAT)
    e.register_kpi(Cat.Kpi("CCL.CUSTOM", "CCL", "count", "checks", "page", "max", "number", weight=1.0, points=((0.0, 0.0), (2.0, 100.0))),
                   lambda: F.when(F.col("n") > 10, (F.col("n") % 3).cast("double")), lambda: F.when(F.col("n") <= 10, F.lit("too_small")))
    p = spark_view(spark, d, "v_page").withColumn("signals", F.array("signal"))
    return e.page_kpis(p).where("kpi_id = 'CCL.CUSTOM' and assessed").select("page_id", "value_num")


@query("ext_02_register_risk", "SELECT l_partkey AS run_id, max(l_discount) AS confidence FROM lineitem GROUP BY 1")
def _(spark, d):
    e = api.Engine(CAT)
    e.register_risk(Cat.Kpi("DPR.CUSTOM", "DPR", "confidence", "deception", "site", "max", "confidence", severity=0.5),
                    lambda df: df.groupBy(F.col("l_partkey").alias("run_id")).agg(F.max("l_discount").alias("confidence")))
    return e.risk_tests["DPR.CUSTOM"](table(spark, d, "lineitem"))


@query("ext_03_register_oracle", "SELECT o_orderkey AS run_id, o_totalprice <= 49.9 * 1000 AS passed FROM orders")
def _(spark, d):
    e = api.Engine(CAT)
    e.register_oracle("cheap", {"max_price": (True, "number")}, lambda o, max_price: o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") <= max_price * 1000).alias("passed")))
    return e.verify("cheap", {"max_price": "49,90"}, table(spark, d, "orders"))


@query("ora_05_oracle_params", """SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'unknown_oracle' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'not_a_positive_number' END WHEN 2 THEN 'unknown_parameter' END AS problem FROM orders""")
def _(spark, d):
    i = F.col("o_orderkey")
    o = table(spark, d, "orders").select(i.alias("run_id"), F.when(i % 4 == 0, "nope").when(i % 4 == 1, "cart_contains_item_under_price").when(i % 4 == 2, "cart_not_empty").otherwise("pdp_reached").alias("oracle"),
                                         F.when(i % 4 == 3, "query").otherwise("max_price").alias("name"), F.when(i % 3 == 0, "zero").otherwise("49,90").alias("value"))
    return api.check_param_table(o).select("run_id", "problem")


@query("ext_04_catalog_versions", f"SELECT run_id, ord, {half_even('least(100.0, value_num / 100)', 2)} AS score FROM v_obs WHERE kpi_id = 'PERF.LCP' AND value_num IS NOT NULL")
def _(spark, d):
    cat = Cat.default_catalog()
    cat.version = "anchors.custom"
    cat.kpis["PERF.LCP"] = Cat.Kpi("PERF.LCP", "PERF", "ms", "checks", "page", "wmedian", "number", weight=3.0, points=((0.0, 0.0), (10000.0, 100.0)))
    Cat.check_parity(cat)
    o = spark_view(spark, d, "v_obs").where("kpi_id = 'PERF.LCP' and value_num is not null").withColumn("x", F.col("value_num"))
    return S.score_points(o, cat).select("run_id", "ord", N.round_half_even(N.clamp(F.col("points_score"), 0.0, 100.0), 2).alias("score"))


@query("ext_06_aggregates", f"SELECT l_suppkey AS run_id, {half_even('median(l_extendedprice)', 4)} AS median FROM lineitem GROUP BY 1")
def _(spark, d):
    m = weighted_median(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), "l_extendedprice"), ["run_id"], F.col("l_extendedprice"))
    return m.withColumn("median", N.round_half_even(F.col("median"), 4))


@query("ext_07_table_functions", "SELECT run_id, count(*) AS visits FROM v_visits GROUP BY run_id")
def _(spark, d):
    R.visits(spark_view(spark, d, "v_steps")).createOrReplaceTempView("siteready_visits")
    return spark.sql("SELECT run_id, count(*) AS visits FROM siteready_visits GROUP BY run_id")


@query("ext_08_judge_exchange", "SELECT task_id, 'clear' AS label FROM v_tasks WHERE task_id % 3 = 0")
def _(spark, d):
    t = spark_view(spark, d, "v_tasks").where("task_id % 3 = 0")
    out, back = shared_dir(spark, "tasks"), shared_dir(spark, "verdicts")
    Snk.export_tasks(t.select("run_id", "task_id", "rubric_id"), out)
    # an outside judge reads the tasks and writes verdict rows
    spark.read.schema("run_id long, task_id long").json(out).withColumns({"judge_id": F.lit("j"), "model": F.lit("m"), "label": F.lit("clear"), "confidence": F.lit(0.9), "arrival": F.col("task_id")}).write.json(back)
    return Snk.import_verdicts(spark, back).select("task_id", "label")
