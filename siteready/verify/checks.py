"""Checks of page, site, risk, cart and outcome rules on orders, lineitem, part, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteready.dims import constants as K
from siteready.functions.lexicon import Lexicon
from siteready.functions.numbers import round_half_even
from siteready.operators import checks as C
from siteready.operators import risk as R
from siteready.verify.base import ORACLES, duck_view, half_even, query, spark_view, table, view
from siteready.verify.scoring import CAT

LX = Lexicon()
_STAGE = "CASE l_orderkey % 7 WHEN 0 THEN 'home' WHEN 1 THEN 'plp' WHEN 2 THEN 'plp' WHEN 3 THEN 'pdp' WHEN 4 THEN 'pdp' WHEN 5 THEN 'cart' ELSE 'checkout_entry' END"
# one recorded page per line: run = part, reloads point at a smaller line number of the run
view("v_page", f"""SELECT l_partkey AS run_id, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS page_id, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS page_ord,
 CASE WHEN l_linestatus = 'O' THEN 'mobile' ELSE 'desktop' END AS profile, {_STAGE} AS stage,
 CASE WHEN l_linenumber = 5 THEN CAST(-1 AS BIGINT) END AS repeat_of, CASE WHEN l_quantity <= 2 THEN 'navigation_error' ELSE 'none' END AS signal,
 l_quantity > 3 AS has_doc, FALSE AS has_ctas, l_quantity AS q, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, CAST(l_quantity AS INT) AS n, l_suppkey AS s FROM lineitem""")
view("v_gaps", """SELECT o_orderkey % 2000 AS run_id, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'pdp' WHEN 1 THEN 'cart' ELSE 'checkout_entry' END AS stage,
 CASE o_custkey % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS profile, o_orderpriority AS reason FROM orders WHERE o_custkey % 4 <> 0""")


def _pages(spark, d):
    p = spark_view(spark, d, "v_page")
    return (p.withColumn("signals", F.array("signal")).withColumn("ttfb", F.col("price") / 50).withColumn("cls", F.col("disc")).withColumn("has_vitals", F.lit(True))
            .withColumn("speculative", F.col("n") == 7).withColumn("lcp", F.when(F.col("n") % 5 != 0, F.col("price") / 20)).withColumn("visibility", F.when(F.col("n") % 2 == 0, "hidden").otherwise("visible"))
            .withColumn("bytes_transfer", F.col("price") * 10).withColumn("requests", F.col("n")).withColumn("url", F.when(F.col("n") % 9 == 0, "http://a/").otherwise("https://a/"))
            .withColumn("sort_present", F.col("n") % 2 == 0).withColumn("filters", F.col("n") % 6).withColumn("visible_fields", F.col("n") % 12).withColumn("autocomplete_share", F.col("disc"))
            .withColumn("interactive", F.col("n")).withColumn("lt24", F.floor(F.col("n") / 3).cast("int")).withColumn("rating", F.col("n") / 9).withColumn("h1", F.col("n") % 2).withColumn("h2", F.lit(1))
            .withColumn("cta_present", F.col("n") % 3 != 0).withColumn("cta_above_fold", F.col("n") % 2 == 0).withColumn("cta_contrast", F.col("tax") * 100).withColumn("cta_area", F.col("price") / 5)
            .withColumn("primary_count", F.col("n") % 4).withColumn("cart_lines", F.col("n") % 3).withColumn("cart_editable", F.col("n") % 4 == 0))


duck_view("v_pf", "SELECT *, CASE WHEN signal = 'navigation_error' THEN signal END AS failed, CASE WHEN signal = 'navigation_error' THEN signal WHEN NOT has_doc THEN 'audit_unavailable' END AS dom FROM v_page")
_sal = half_even("100*fold*(0.5*least(1.0,greatest(0.0,(ct-3)/1.5))+0.25*least(1.0,greatest(0.0,ar/10000))+0.25/greatest(1,pc))", 1)
duck_view("v_pk", " UNION ALL ".join(f"SELECT run_id, page_id, '{k}' AS kpi_id, CASE WHEN r IS NULL THEN v END AS num, CASE WHEN r IS NULL THEN s END AS txt, r AS reason FROM (SELECT run_id, page_id, ({v})::DOUBLE AS v, ({s})::VARCHAR AS s, {r} AS r FROM v_pf{w})" for k, v, s, r, w in [
    ("PERF.TTFB", half_even("price/50", 1), "NULL", "coalesce(failed, CASE WHEN n = 7 THEN 'not_applicable:speculative_navigation' END)", ""),
    ("PERF.LCP", half_even("price/20", 1), "NULL", "coalesce(failed, CASE WHEN n = 7 THEN 'not_applicable:speculative_navigation' WHEN n % 5 = 0 THEN CASE WHEN n % 2 = 0 THEN 'background_tab' ELSE 'unavailable' END END)", ""),
    ("PERF.BYTES_TOTAL", half_even("price*10*0.001", 1), "NULL", "failed", ""),
    ("PERF.REQUESTS", "n", "NULL", "failed", ""),
    ("TRI.HTTPS", "NULL", "n % 9 <> 0", "failed", ""),
    ("FAI.PLP_SORT", "NULL", "n % 2 = 0", "dom", " WHERE stage = 'plp'"),
    ("FAI.CHECKOUT_FIELDS", "n % 12", "NULL", "coalesce(dom, CASE WHEN n % 12 = 0 THEN 'not_applicable:no_form_fields' END)", " WHERE stage = 'checkout_entry'"),
    ("FAI.AUTOCOMPLETE_ATTRS", half_even("disc*100", 1), "NULL", "coalesce(dom, CASE WHEN n % 12 = 0 THEN 'not_applicable:no_form_fields' END)", " WHERE stage = 'checkout_entry'"),
    ("FAI.TARGET_SIZE_24", half_even("100.0::DOUBLE*(n-(n//3))/n", 1), "NULL", "dom", ""),
    ("CCL.HEADINGS", "NULL", "n % 2 = 1", "dom", ""),
    ("TRI.RATING_BAND", "NULL", f"CASE WHEN {half_even('n/9', 1)} >= 4.8 THEN '4.8-5.0' WHEN {half_even('n/9', 1)} >= 4.0 THEN '4.0-4.7' WHEN {half_even('n/9', 1)} >= 3.5 THEN '3.5-3.9' ELSE '<3.5' END", "coalesce(dom, CASE WHEN n/9 > 5 THEN 'rating_scale_unknown' END)", " WHERE stage = 'pdp'"),
    ("FAI.CART_EDITABLE", "NULL", "n % 4 = 0", "coalesce(dom, CASE WHEN n % 3 = 0 THEN 'empty_cart' END)", " WHERE stage = 'cart'"),
    ("CCL.CTA_SALIENCE", f"CASE WHEN n % 3 = 0 THEN 0 ELSE (SELECT {_sal} FROM (SELECT tax*100 AS ct, price/5 AS ar, n % 4 AS pc, CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.5 END AS fold)) END", "NULL", "dom", " WHERE stage = 'pdp'"),
]))
_KP = ["PERF.TTFB", "PERF.LCP", "PERF.BYTES_TOTAL", "PERF.REQUESTS", "TRI.HTTPS", "FAI.PLP_SORT", "FAI.CHECKOUT_FIELDS", "FAI.AUTOCOMPLETE_ATTRS", "FAI.TARGET_SIZE_24", "CCL.HEADINGS", "TRI.RATING_BAND", "FAI.CART_EDITABLE"]


def _pk(spark, d, ids):
    rows = C.page_kpis(_pages(spark, d)).where(F.col("kpi_id").isin(*ids))
    return rows.select("run_id", "page_id", "kpi_id", F.col("value_num").alias("num"), F.coalesce("value_str", F.initcap(F.col("value_bool").cast("string"))).alias("txt"), "reason")


@query("txt_21_page_kpis", "SELECT run_id, page_id, kpi_id, num, CASE WHEN txt IN ('true','false') THEN upper(txt[1]) || txt[2:] ELSE txt END AS txt, reason FROM v_pk WHERE kpi_id <> 'CCL.CTA_SALIENCE'")
def _(spark, d):
    return _pk(spark, d, _KP)


@query("txt_15_cta_salience", "SELECT run_id, page_id, num AS salience FROM v_pk WHERE kpi_id = 'CCL.CTA_SALIENCE' AND reason IS NULL")
def _(spark, d):
    return _pk(spark, d, ["CCL.CTA_SALIENCE"]).where("reason is null").select("run_id", "page_id", F.col("num").alias("salience"))


@query("prj_12_visit_failure", "SELECT run_id, page_id, CASE WHEN n = 50 THEN 'bot_challenge' ELSE dom END AS failure FROM v_pf")
def _(spark, d):
    p = _pages(spark, d)
    return p.select("run_id", "page_id", C.visit_failure(F.when(F.col("n") == 50, "challenge").otherwise("pdp"), F.col("signals"), F.col("has_doc"), F.col("has_ctas")).alias("failure"))


@query("prj_11_stage_evidence", """SELECT page_id, t = 'plp' OR (n % 6 >= 4 AND t = 'other') AS listing, t = 'pdp' OR (n % 3 = 0 AND n % 2 = 0 AND t = 'other') AS product,
 t IN ('cart','checkout') OR ((n % 4 > 0 OR n % 5 = 0) AND t NOT IN ('plp','pdp')) AS cart, CASE WHEN n % 5 = 0 THEN true WHEN n % 4 > 0 THEN false ELSE true END AS empty_cart,
 n % 7 < 3 AS gated, CASE WHEN n % 8 = 1 THEN 'availability' WHEN n % 2 = 0 AND n % 7 >= 3 THEN 'cta_disabled' WHEN n % 2 = 1 AND n % 3 = 0 THEN 'stock_text' END AS unavailable
 FROM (SELECT *, CASE n % 9 WHEN 0 THEN 'plp' WHEN 1 THEN 'pdp' WHEN 2 THEN 'cart' WHEN 3 THEN 'checkout' ELSE 'other' END AS t FROM v_page)""")
def _(spark, d):
    n, none = F.col("n"), F.lit(None).cast("double")
    t = F.when(n % 9 == 0, "plp").when(n % 9 == 1, "pdp").when(n % 9 == 2, "cart").when(n % 9 == 3, "checkout").otherwise("other")
    gated = C.variant_gated(F.when(n % 7 < 3, F.array(F.lit(True), F.lit(None).cast("boolean"))).otherwise(F.array(F.lit(True))))
    return spark_view(spark, d, "v_page").select(
        "page_id", C.is_listing(t, n % 6, F.lit(0)).alias("listing"), C.is_product(t, n % 3 == 0, n % 2 == 0, F.lit(False)).alias("product"),
        C.is_cart(t, n % 4, n % 5 == 0, none, none).alias("cart"), C.cart_empty(n % 5 == 0, n % 4, none, none).alias("empty_cart"), gated.alias("gated"),
        C.unavailable(F.lit(1), F.when(n % 8 == 1, "SoldOut").otherwise("InStock"), n % 2 == 0, n % 2 != 0, gated, n % 3 == 0, F.lit(False)).alias("unavailable"))


@query("txt_16_visual_complexity", f"SELECT page_id, {half_even('100*(0.40*least(1.0,disc/0.25)+0.35*least(1.0,tax/0.40)+0.25*least(1.0,q/100))', 1)} AS complexity FROM v_page")
def _(spark, d):
    return spark_view(spark, d, "v_page").select("page_id", C.visual_complexity(F.col("disc"), F.col("tax"), F.col("q")).alias("complexity"))


@query("txt_18_rating_band", f"SELECT p_partkey, CASE WHEN r > 5 THEN 'rating_scale_unknown' WHEN {half_even('r', 1)} >= 4.8 THEN '4.8-5.0' WHEN {half_even('r', 1)} >= 4 THEN '4.0-4.7' WHEN {half_even('r', 1)} >= 3.5 THEN '3.5-3.9' ELSE '<3.5' END AS band FROM (SELECT p_partkey, (p_retailprice - 900) / 37 AS r FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.rating_band((F.col("p_retailprice") - 900) / 37).alias("band"))


@query("txt_17_strike_rule", "SELECT page_id, CASE WHEN n % 4 + s % 3 = 0 THEN NULL WHEN n % 5 + s % 4 = 0 THEN false WHEN n % 2 = 0 THEN true ELSE n % 5 >= n % 4 AND (s % 3 = 0 OR n % 5 >= 1 OR s % 4 >= s % 3) END AS ok FROM v_page")
def _(spark, d):
    n, s = F.col("n"), F.col("s")
    return spark_view(spark, d, "v_page").select("page_id", C.strikethrough_ok(n % 4, s % 3, n % 5, s % 4, n % 2 != 0).alias("ok"))


@query("join_07_valid_pages", """SELECT p.run_id, p.page_id, coalesce(p.rep, p.page_id) AS head_id FROM (SELECT *, CASE WHEN n % 5 = 0 THEN page_id - 10000 END AS rep FROM v_page) p
 WHERE rep IS NULL OR EXISTS (SELECT 1 FROM v_page h WHERE h.n % 5 <> 0 AND h.run_id = p.run_id AND h.page_id = p.rep AND h.stage = p.stage)""")
def _(spark, d):
    p = spark_view(spark, d, "v_page").withColumn("repeat_of", F.when(F.col("n") % 5 == 0, F.col("page_id") - 10000))
    return C.valid_pages(p).select("run_id", "page_id", "head_id")


@query("win_05_first_pages", "SELECT run_id, profile, stage, min(page_id) AS page_id FROM v_page WHERE repeat_of IS NULL GROUP BY ALL")
def _(spark, d):
    return C.first_pages(spark_view(spark, d, "v_page")).select("run_id", "profile", "stage", "page_id")


@query("win_06_funnel_choice", """SELECT run_id, profile, arg_min(choice, o) AS choice FROM (SELECT run_id, profile, list_position(['home','plp','pdp','cart','checkout_entry'], stage) AS o, CASE arg_min(n, page_id) % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'none' END AS choice
 FROM v_page WHERE repeat_of IS NULL GROUP BY run_id, profile, stage) WHERE choice <> 'none' GROUP BY ALL""")
def _(spark, d):
    n = F.col("n") % 4
    return C.funnel_choice(spark_view(spark, d, "v_page").withColumn("consent_choice", F.when(n == 0, "accept").when(n == 1, "reject").otherwise("none")))


duck_view("v_why", """SELECT w.run_id, w.profile, w.stage, coalesce((SELECT arg_min(reason, ord) FROM v_gaps g WHERE g.run_id = w.run_id AND g.stage = w.stage AND g.profile = w.profile),
 (SELECT arg_min(reason, ord) FROM v_gaps g WHERE g.run_id = w.run_id AND g.stage = w.stage AND g.profile IS NULL), 'not_reached') AS reason
 FROM (SELECT DISTINCT run_id, profile, stage FROM (SELECT DISTINCT run_id, profile FROM v_page), (VALUES ('home'),('plp'),('pdp'),('cart'),('checkout_entry')) t(stage)) w""")


@query("join_06_stage_reason", "SELECT * FROM v_why")
def _(spark, d):
    w = spark_view(spark, d, "v_page").select("run_id", "profile").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in K.STAGES])))
    return C.stage_reasons(w, spark_view(spark, d, "v_gaps"))


_pk_stage = ",".join(f"('{k.id}','{s}')" for k in CAT.by_producer("checks") if k.scope == "page" for s in (k.stages or K.STAGES))


@query("join_05_missing_stage_rows", f"SELECT w.run_id, w.profile, w.stage, k.kpi_id, w.reason FROM v_why w JOIN (VALUES {_pk_stage}) k(kpi_id, stage) USING (stage) WHERE (run_id, profile, stage) NOT IN (SELECT run_id, profile, stage FROM v_page)")
def _(spark, d):
    p = spark_view(spark, d, "v_page")
    return C.missing_stage_rows(p, p.select("run_id", "profile").distinct(), spark_view(spark, d, "v_gaps")).drop("assessed")


@query("agg_18_repeats", f"SELECT l_orderkey AS head_id, count(*) FILTER (WHERE l_quantity > 10) AS loads, {half_even('median(l_extendedprice) FILTER (WHERE l_quantity > 10)', 4)} AS value_num, CASE WHEN count(*) FILTER (WHERE l_quantity > 10) = 0 THEN arg_min(l_returnflag, (l_linenumber, l_partkey)) END AS reason FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(1).alias("run_id"), F.lit("k").alias("kpi_id"), F.col("l_orderkey").alias("head_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("load_ord"),
                                            F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.col("l_returnflag").alias("reason"))
    return C.measure_repeats(li).select("head_id", "loads", "value_num", "reason")


@query("agg_19_site_any_max", """SELECT a.run_id, a.profile, a.flag, a.found_on, b.num, b.page_id FROM (SELECT run_id, profile, bool_or(n % 10 = 0) AS flag, array_to_string(list_slice(list(page_id ORDER BY page_id) FILTER (WHERE n % 10 = 0), 1, 5), ',') AS found_on FROM v_page GROUP BY ALL) a
 JOIN (SELECT run_id, profile, max(n) FILTER (WHERE n % 2 = 0) AS num, arg_max(page_id, (n, -page_id)) FILTER (WHERE n % 2 = 0) AS page_id FROM v_page GROUP BY ALL) b USING (run_id, profile)""")
def _(spark, d):
    p = spark_view(spark, d, "v_page").withColumn("kpi_id", F.lit("k"))
    a = C.site_any(p.withColumn("flag", F.col("n") % 10 == 0)).select("run_id", "profile", F.col("value_bool").alias("flag"), F.array_join("found_on", ",").alias("found_on"))
    b = C.site_max(p.withColumn("number", F.when(F.col("n") % 2 == 0, F.col("n")))).select("run_id", "profile", F.col("value_num").alias("num"), "page_id")
    return a.join(b, ["run_id", "profile"])


duck_view("v_site", """SELECT v.run_id, v.profile, CASE WHEN v.bad = 0 AND v.flag IS NULL THEN NULL ELSE v.flag END AS flag, pdp, cart, why_pdp, why_cart, first_bad FROM (SELECT run_id, profile, bool_or(n % 20 = 0) FILTER (WHERE dom IS NULL) AS flag,
 count(*) FILTER (WHERE dom IS NULL AND stage = 'pdp') pdp, count(*) FILTER (WHERE dom IS NULL AND stage = 'cart') cart, arg_min(dom, page_id) FILTER (WHERE dom IS NOT NULL AND stage = 'pdp') why_pdp,
 arg_min(dom, page_id) FILTER (WHERE dom IS NOT NULL AND stage = 'cart') why_cart, arg_min(dom, page_id) FILTER (WHERE dom IS NOT NULL) first_bad, count(*) FILTER (WHERE dom IS NOT NULL) bad FROM v_pf WHERE stage IN ('pdp','cart') AND repeat_of IS NULL GROUP BY ALL) v""")


@query("agg_20_site_rows", """SELECT s.run_id, s.profile, CASE WHEN r IS NULL THEN flag END AS value_bool, r AS reason FROM (SELECT v.*, CASE WHEN pdp + cart = 0 THEN first_bad WHEN flag THEN NULL WHEN pdp = 0 THEN coalesce(why_pdp, wp.reason)
 WHEN cart = 0 THEN coalesce(why_cart, wc.reason) END AS r FROM v_site v LEFT JOIN v_why wp ON wp.run_id = v.run_id AND wp.profile = v.profile AND wp.stage = 'pdp' LEFT JOIN v_why wc ON wc.run_id = v.run_id AND wc.profile = v.profile AND wc.stage = 'cart') s""")
def _(spark, d):
    p = _pages(spark, d).where(F.col("stage").isin("pdp", "cart") & F.col("repeat_of").isNull())
    v = p.select("run_id", "profile", F.lit("PTI.SHIPPING_COST_PRE_CHECKOUT").alias("kpi_id"), "page_id", "page_ord", "stage", (F.col("n") % 20 == 0).alias("flag"),
                 C.visit_failure(F.lit(""), F.col("signals"), F.col("has_doc"), F.col("has_ctas")).alias("reason"))
    return C.site_rows(v, spark_view(spark, d, "v_gaps")).select("run_id", "profile", "value_bool", "reason")


@query("txt_22_site_kpis", """SELECT run_id, profile, 'TRI.POLICY_LINKS' AS kpi_id, max(n % 5)::DOUBLE AS value_num, NULL::BOOLEAN AS value_bool FROM v_pf WHERE dom IS NULL AND repeat_of IS NULL GROUP BY ALL
 UNION ALL SELECT run_id, profile, 'TRI.CONTACT_INFO', NULL, bool_or(n % 20 = 0) FILTER (WHERE dom IS NULL) FROM v_pf WHERE repeat_of IS NULL GROUP BY ALL
 UNION ALL SELECT run_id, profile, 'FAI.SEARCH_WIDTH', max(q * 5), NULL FROM v_pf WHERE dom IS NULL AND repeat_of IS NULL AND stage = 'home' GROUP BY ALL""")
def _(spark, d):
    n, no = F.col("n"), F.lit(False)
    p = _pages(spark, d).withColumns({"search_present": n % 2 == 0, "search_above_fold": n % 3 == 0, "search_width": F.col("q") * 5, "has_contact": n % 20 == 0, "has_legal_id": no, "policy_count": n % 5,
                                      "has_return_policy": no, "has_shipping": no, "payment_logos": n % 4, "shipping_stated": no, "free_shipping": no, "vat_stated": no, "generic_share": F.col("disc")})
    return C.site_kpis(p, spark_view(spark, d, "v_gaps")).where(F.col("kpi_id").isin("TRI.POLICY_LINKS", "TRI.CONTACT_INFO", "FAI.SEARCH_WIDTH")).select("run_id", "profile", "kpi_id", "value_num", "value_bool")


@query("agg_48_account_rows", """SELECT run_id, profile, CASE WHEN g IS NOT NULL THEN g WHEN c THEN true END AS guest_checkout, CASE WHEN g IS NOT NULL THEN fo WHEN c THEN false END AS forced_account FROM (
 SELECT run_id, profile, bool_or(n % 5 = 0 OR n % 3 <> 0) FILTER (WHERE stage = 'checkout_entry' AND has_doc) g, bool_or(NOT (n % 5 = 0 OR n % 3 <> 0)) FILTER (WHERE stage = 'checkout_entry' AND has_doc) fo, coalesce(bool_or(n % 5 = 0) FILTER (WHERE stage = 'cart'), false) c FROM v_page GROUP BY ALL)""")
def _(spark, d):
    p = spark_view(spark, d, "v_page").withColumn("readable", F.col("has_doc")).withColumn("guest_option", F.col("n") % 5 == 0).withColumn("login_required", F.col("n") % 3 == 0)
    return C.account_rows(p).drop("decided_by")


view("v_account", """SELECT run_id, profile, stage, page_id, page_ord, has_doc AND n % 7 <> 0 AS readable, CASE WHEN NOT (has_doc AND n % 7 <> 0) THEN concat('unread_', CAST(n % 4 AS VARCHAR(2))) END AS reason,
 n % 5 = 0 AS guest_option, n % 3 = 0 AS login_required FROM v_page""")


@query("agg_48_account_observations", """WITH f AS (SELECT run_id, profile, bool_or(stage = 'checkout_entry' AND readable) AS decides, bool_or(stage = 'cart' AND guest_option) AS offers, bool_or(stage = 'checkout_entry') AS co, bool_or(stage = 'cart') AS ca,
  arg_min(reason, page_ord) FILTER (WHERE stage = 'checkout_entry' AND NOT readable) AS failed FROM v_account GROUP BY ALL),
 w AS (SELECT run_id, profile, stage, coalesce((SELECT arg_min(reason, ord) FROM v_gaps g WHERE g.run_id = f.run_id AND g.stage = t.stage AND g.profile = f.profile), (SELECT arg_min(reason, ord) FROM v_gaps g WHERE g.run_id = f.run_id AND g.stage = t.stage AND g.profile IS NULL), 'not_reached') AS why
  FROM f, (VALUES ('checkout_entry'), ('cart')) t(stage)),
 r AS (SELECT a.run_id, a.profile, a.stage, page_id, CASE WHEN a.stage = 'cart' THEN true WHEN readable THEN guest_option OR NOT login_required END AS g, CASE WHEN a.stage = 'checkout_entry' AND NOT readable THEN reason END AS reason,
   CASE WHEN a.stage = 'cart' THEN coalesce(failed, (SELECT why FROM w WHERE w.run_id = a.run_id AND w.profile = a.profile AND w.stage = 'checkout_entry')) END AS checkout_reason
  FROM v_account a JOIN f USING (run_id, profile) WHERE (a.stage = 'checkout_entry' AND (readable OR decides OR NOT offers)) OR (a.stage = 'cart' AND guest_option AND NOT decides)
  UNION ALL SELECT run_id, profile, w.stage, NULL, NULL, why, NULL FROM f JOIN w USING (run_id, profile) WHERE NOT decides AND NOT offers AND ((w.stage = 'checkout_entry' AND NOT co) OR (w.stage = 'cart' AND NOT ca)))
 SELECT run_id, profile, kpi_id, stage, page_id, CASE WHEN kpi_id = 'FAI.GUEST_CHECKOUT' THEN g ELSE NOT g END AS value_bool, g IS NOT NULL AS assessed, reason, checkout_reason FROM r, (VALUES ('FAI.GUEST_CHECKOUT'), ('FAI.FORCED_ACCOUNT')) k(kpi_id)""")
def _(spark, d):
    a = spark_view(spark, d, "v_account")
    return C.account_observations(a, a.select("run_id", "profile"), spark_view(spark, d, "v_gaps"))


@query("agg_39_run_status", """SELECT r.run_id, CASE WHEN pages IS NULL THEN 'failed' WHEN lost = 0 AND gaps IS NULL AND r.run_id % 9 <> 0 THEN 'complete' ELSE 'partial' END AS status FROM (SELECT p_partkey AS run_id FROM part) r
 LEFT JOIN (SELECT run_id, count(*) pages FROM v_page GROUP BY 1) USING (run_id) LEFT JOIN (SELECT run_id, 4 - count(*) AS lost FROM (SELECT DISTINCT run_id, profile, stage FROM v_page WHERE stage IN ('pdp','cart')) GROUP BY 1) USING (run_id)
 LEFT JOIN (SELECT run_id, count(*) gaps FROM v_gaps WHERE stage = 'cart' GROUP BY 1) USING (run_id)""")
def _(spark, d):
    runs = table(spark, d, "part").select(F.col("p_partkey").alias("run_id"), F.array(F.lit("mobile"), F.lit("desktop")).alias("profiles"), F.array(F.lit("pdp"), F.lit("cart")).alias("stages"), (F.col("p_partkey") % 9 == 0).cast("int").alias("errors"))
    return C.run_status(runs, spark_view(spark, d, "v_page"), spark_view(spark, d, "v_gaps").withColumn("accepted", F.col("stage") != "cart"))


@query("set_01_all_observations", "SELECT kpi_id, count(*) AS n, count(page) AS pages FROM (SELECT 'a' AS kpi_id, l_orderkey AS page FROM lineitem UNION ALL SELECT 'b', NULL FROM orders) GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "lineitem").select(F.lit("a").alias("kpi_id"), F.col("l_orderkey").alias("page"))
    return C.all_observations(a, table(spark, d, "orders").select(F.lit("b").alias("kpi_id"))).groupBy("kpi_id").agg(F.count(F.lit(1)).alias("n"), F.count("page").alias("pages"))


@query("set_02_replace_judged", "SELECT run_id, source, count(*) AS n FROM (SELECT run_id, source FROM v_obs WHERE source <> 'judged' AND kpi_id NOT LIKE '%CLARITY' AND kpi_id NOT LIKE '%SHAMING' UNION ALL SELECT run_id, source FROM v_obs WHERE source = 'judged' AND run_id % 2 <> 0 UNION ALL SELECT p_partkey, 'fresh' FROM part WHERE p_partkey % 2 = 0) GROUP BY ALL")
def _(spark, d):
    o = spark_view(spark, d, "v_obs").select("run_id", "kpi_id", "source")
    fresh = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("run_id"), F.lit("MPI.AUTHORITY").alias("kpi_id"), F.lit("fresh").alias("source"))
    return C.replace_judged(o, fresh).groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("set_03_profiles", "SELECT DISTINCT run_id, profile FROM v_obs WHERE profile IS NOT NULL UNION SELECT DISTINCT run_id, profile FROM v_page")
def _(spark, d):
    return C.profile_set(spark_view(spark, d, "v_obs"), spark_view(spark, d, "v_page"))


@query("set_04_missing_stages", "SELECT run_id, array_to_string(list_filter(['home','plp','pdp','cart','checkout_entry'], lambda s: NOT list_contains(st, s)), ',') AS missing FROM (SELECT run_id, list(DISTINCT stage) st FROM v_page GROUP BY 1)")
def _(spark, d):
    return C.missing_stages(spark_view(spark, d, "v_page")).withColumn("missing", F.array_join("missing", ","))


# ---------------------------------------------------------------- risk tests
_TOK = "list_distinct(regexp_extract_all(lower(NAME), '[a-z0-9]{2,}'))"
view("v_item", "SELECT DISTINCT p_size % 10 AS run_id, concat(p_name, ' ', p_type, CASE WHEN p_size % 3 = 0 THEN concat(' x', CAST(p_size AS VARCHAR(4))) ELSE '' END) AS nm FROM part")


@query("join_09_same_item", f"""SELECT a.run_id, a.nm AS left_id, b.nm AS right_id FROM (SELECT *, {_TOK.replace('NAME', 'nm')} AS t FROM v_item WHERE length(nm) % 2 = 0) a JOIN (SELECT *, {_TOK.replace('NAME', 'nm')} AS t FROM v_item) b USING (run_id)
 WHERE lower(a.nm) = lower(b.nm) OR (least(len(a.t), len(b.t)) >= 2 AND len(list_intersect(a.t, b.t)) = least(len(a.t), len(b.t))) OR len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.6""")
def _(spark, d):
    i = spark_view(spark, d, "v_item")
    left = i.where("length(nm) % 2 = 0").select("run_id", F.col("nm").alias("left_id"), F.col("nm").alias("left_name"))
    return R.same_item_join(left, i.select("run_id", F.col("nm").alias("right_id"), F.col("nm").alias("right_name")), ["run_id"])


@query("join_10_same_product", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 3 = 0 THEN p_size % 2 = 0 ELSE lower(p_name) = lower(p_type || ' ring') OR starts_with(lower(p_name), 'red ') END AS same FROM part""")
def _(spark, d):
    size, none = F.col("p_size"), F.lit("")
    sku = F.when(size % 3 == 0, F.lit("A1")).otherwise(none)
    other = F.when(size % 3 == 0, F.when(size % 2 == 0, F.lit("a1")).otherwise(F.lit("b2"))).otherwise(none)
    title = F.when(F.startswith("p_name", F.lit("red ")), F.lit("Red")).otherwise(F.concat("p_type", F.lit(" ring")))
    return table(spark, d, "part").select("p_partkey", R.same_product(F.lit("u"), F.when(size % 5 == 0, "u").otherwise("v"), sku, other, F.col("p_name"), title).alias("same"))


view("v_product", """SELECT p_size % 10 AS run_id, p_partkey AS visit_id, CASE WHEN p_partkey % 3 = 0 THEN concat('https://shop.example/p/', CAST(p_partkey % 1000 AS VARCHAR(9))) END AS url,
 CASE WHEN p_partkey % 4 <> 0 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN 'sku ' ELSE 'SKU ' END, CAST(p_partkey % 700 AS VARCHAR(9))) END AS sku,
 concat(p_name, CASE p_partkey % 40 WHEN 0 THEN '' WHEN 1 THEN ' - Large' ELSE concat(' ', CAST(p_partkey % 90 AS VARCHAR(9))) END, CASE WHEN p_partkey % 80 = 5 THEN ' Red' ELSE '' END) AS title FROM part""")


@query("join_10_product_clusters", """WITH RECURSIVE e AS (SELECT a.run_id, a.visit_id AS x, b.visit_id AS y FROM v_product a JOIN v_product b ON a.run_id = b.run_id AND a.visit_id <> b.visit_id AND (coalesce(a.url = b.url, false)
  OR CASE WHEN a.sku IS NOT NULL AND b.sku IS NOT NULL THEN lower(a.sku) = lower(b.sku) ELSE lower(a.title) = lower(b.title) OR starts_with(lower(a.title), lower(b.title) || ' ') OR starts_with(lower(b.title), lower(a.title) || ' ') END)),
 r AS (SELECT run_id, visit_id AS x, visit_id AS root FROM v_product UNION SELECT e.run_id, e.y, r.root FROM r JOIN e ON e.run_id = r.run_id AND e.x = r.x)
 SELECT run_id, x AS visit_id, min(root) AS product FROM r GROUP BY ALL""")
def _(spark, d):
    return R.product_clusters(spark_view(spark, d, "v_product"), ["run_id"])


view("v_line", """SELECT l_orderkey AS run_id, l_linenumber * 1000000 + l_partkey AS line_id, CASE WHEN l_suppkey % 9 = 0 THEN concat('protection ', p_name) ELSE p_name END AS title, l_suppkey % 9 = 0 AS addon,
 CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE floor(l_extendedprice) END AS price_value, CAST(1 + l_quantity % 3 AS INT) AS qty, p_name FROM lineitem JOIN part ON p_partkey = l_partkey""")


@query("join_11_sneak_into_basket", """SELECT run_id, CASE WHEN ours THEN CASE WHEN extra = 0 THEN 0.0 WHEN extra_addon > 0 THEN 1.0 ELSE 0.8 END END AS confidence, extra AS unrequested, CASE WHEN NOT ours THEN 'added_item_not_recognised' END AS reason FROM (
 SELECT run_id, bool_or(o) AS ours, count(*) FILTER (WHERE NOT o AND price_value > 0) AS extra, count(*) FILTER (WHERE NOT o AND price_value > 0 AND addon) AS extra_addon FROM (
 SELECT l.*, NOT addon AND (lower(title) = added OR list_sort(string_split(title,' ')) = list_sort(string_split(added,' '))) AS o FROM v_line l JOIN (SELECT run_id, arg_min(p_name, line_id) AS added FROM v_line GROUP BY 1) a USING (run_id)) GROUP BY run_id)""")
def _(spark, d):
    lines = spark_view(spark, d, "v_line")
    return R.sneak_into_basket(lines, lines.groupBy("run_id").agg(F.min_by("p_name", "line_id").alias("title")))


@query("agg_46_prechecked", "SELECT run_id, max(CASE WHEN addon AND price_value > 0 THEN 1.0 ELSE 0.0 END) AS confidence, count(*) FILTER (WHERE addon AND price_value > 0) AS addons, count(*) FILTER (WHERE NOT addon AND price_value > 0) AS other_prechecked FROM v_line GROUP BY run_id")
def _(spark, d):
    return R.prechecked(spark_view(spark, d, "v_line").withColumn("price_text", F.lit(None).cast("string")))


@query("join_12_unexplained_fees", """SELECT run_id, count(DISTINCT label) AS unexplained FROM (SELECT l_orderkey AS run_id, p_name || ' fee' AS label, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 20) f
 WHERE EXISTS (SELECT 1 FROM unnest(string_split(p_name, ' ')) w(x) WHERE length(x) >= 4 AND (run_id, x) NOT IN (SELECT l_orderkey, unnest(string_split(p_name, ' ')) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 20)) OR NOT regexp_matches(p_name, '[a-z]{4,}') GROUP BY run_id""")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    fees = j.where("l_quantity > 20").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("fee_id"), F.concat("p_name", F.lit(" fee")).alias("label"), F.lit(1.0).alias("value"))
    told = j.where("l_quantity <= 20").select(F.col("l_orderkey").alias("run_id"), F.explode(F.split("p_name", " ")).alias("word"))
    none = spark.createDataFrame([], "run_id bigint, label string")
    return R.unexplained_fees(fees, told, none, LX)


view("v_fee", """SELECT l_orderkey AS run_id, l_linenumber * 1000000 + l_partkey AS fee_id, CASE WHEN l_suppkey % 4 = 0 THEN concat('shipping ', p_name) ELSE concat(p_name, ' fee') END AS label, l_suppkey % 4 = 0 AS freight, p_name,
 l_linenumber = 3 AS counted FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 20""")
view("v_fee_runs", """SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 11 = 0 THEN 'timeout' END AS product_reason, CASE WHEN o_custkey % 13 = 0 THEN 'not_reached' END AS cart_reason, o_custkey % 7 = 0 AS empty, o_orderkey % 3 = 0 AS told FROM orders""")


@query("join_12_fee_results", f"""WITH t AS (SELECT *, {_TOK.replace('NAME', 'label')} AS t FROM v_fee),
 o AS (SELECT f.run_id, count(DISTINCT f.label) AS n FROM t f JOIN v_fee_runs r USING (run_id) WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.counted AND c.run_id = f.run_id AND (c.label = f.label OR (least(len(c.t), len(f.t)) >= 2 AND len(list_intersect(c.t, f.t)) = least(len(c.t), len(f.t)))
   OR len(list_intersect(c.t, f.t))::DOUBLE / len(list_distinct(list_concat(c.t, f.t))) >= 0.6))
  AND CASE WHEN freight THEN NOT told ELSE EXISTS (SELECT 1 FROM unnest(string_split(p_name, ' ')) w(x) WHERE length(x) >= 4 AND (f.run_id, x) NOT IN (SELECT l_orderkey, unnest(string_split(p_name, ' ')) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 20))
   OR NOT regexp_matches(p_name, '[a-z]{{4,}}') END GROUP BY 1)
 SELECT run_id, CASE WHEN reason IS NULL THEN coalesce(n, 0) END AS unexplained, reason FROM (SELECT *, coalesce(product_reason, cart_reason, CASE WHEN empty THEN 'empty_cart' END) AS reason FROM v_fee_runs) LEFT JOIN o USING (run_id)""")
def _(spark, d):
    f, runs = spark_view(spark, d, "v_fee").withColumn("value", F.lit(1.0)), spark_view(spark, d, "v_fee_runs")
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    told = j.where("l_quantity <= 20").select(F.col("l_orderkey").alias("run_id"), F.explode(F.split("p_name", " ")).alias("word"))
    return R.fee_results(runs, R.unexplained_fees(f, told, f.where("counted").select("run_id", "label"), LX, runs.where("told").select("run_id")))


view("v_timer", """SELECT run_id, ord AS pos, concat('Sale ', CAST(k % 4 AS VARCHAR(2)), ' ends ', CAST(ord AS VARCHAR(8))) AS text, k % 4 AS m, CAST(floor(value) AS DOUBLE) AS remaining_s, event_type FROM v_ev""")
duck_view("v_pairs", """SELECT a.run_id, a.pos AS pos1, b.pos AS pos2, a.remaining_s AS s1, b.remaining_s AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS r FROM v_timer WHERE event_type = 'click') a
 JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS r FROM v_timer WHERE event_type = 'view') b ON a.run_id = b.run_id AND a.r = b.r""")


def _pairs(spark, d):
    t = spark_view(spark, d, "v_timer")
    return R.pair_countdowns(t.where("event_type = 'click'"), t.where("event_type = 'view'"))


@query("join_13_pair_countdowns", "SELECT * FROM v_pairs")
def _(spark, d):
    return _pairs(spark, d)


@query("join_14_ticking", """SELECT a.run_id, a.pos, coalesce(a.remaining_s - b.remaining_s BETWEEN 1 AND 62, false) AS ticks FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS r FROM v_timer WHERE event_type = 'click') a
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS r FROM v_timer WHERE event_type = 'view') b ON a.run_id = b.run_id AND a.r = b.r""")
def _(spark, d):
    t = spark_view(spark, d, "v_timer")
    return R.ticking(t.where("event_type = 'click'"), t.where("event_type = 'view'"), F.lit(60.0)).select("run_id", "pos", "ticks")


@query("agg_43_countdown_reset", """SELECT run_id, pairs, dec AS decrease_s, tol AS tolerance_s, dec < el - tol AS reset, CASE WHEN NOT dec < el - tol THEN 0.0 WHEN dec <= tol THEN 1.0 ELSE 0.8 END AS confidence FROM (
 SELECT run_id, count(*) pairs, min(s1 - s2) dec, (20 + run_id % 50)::DOUBLE el, round(greatest(2.0, 0.2::DOUBLE * (20 + run_id % 50)), 1) tol FROM v_pairs GROUP BY run_id)""")
def _(spark, d):
    p = _pairs(spark, d)
    return R.countdown_reset(p, p.select("run_id").distinct().withColumn("elapsed", (F.col("run_id") % 50 + 20).cast("double")))


@query("top_07_worst_with_witness", "SELECT run_id, min(s1 - s2) AS decrease_s, arg_min(pos1, (s1 - s2, pos1)) AS pos1 FROM v_pairs GROUP BY run_id")
def _(spark, d):
    return R.extreme(_pairs(spark, d), ["run_id"], F.col("s1") - F.col("s2"), ["pos1"]).withColumnRenamed("value", "decrease_s")


view("v_timer_visits", """SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') > 5 + user_id % 9 AS first, count(*) FILTER (WHERE event_type = 'purchase') > 5 + user_id % 8 AS second,
 CASE WHEN user_id % 3 = 0 THEN 'navigation_error' END AS failure, count(*) FILTER (WHERE event_type = 'click' AND value > 60) % 3 AS first_timers, count(*) FILTER (WHERE event_type = 'click' AND value < 40) % 3 AS second_timers,
 count(*) FILTER (WHERE event_type = 'error') % 2 AS static, count(*) FILTER (WHERE event_type = 'signup') % 2 AS unverified, count(*) FILTER (WHERE event_type = 'view') % 2 AS funnel_timers FROM events GROUP BY user_id""")


@query("agg_43_countdown_outcome", f"""SELECT run_id, reason IS NULL AS assessed, CASE WHEN reason IS NULL THEN t END AS found, reason, CASE WHEN reason IS NULL AND t THEN decrease_s END AS decrease_s, CASE WHEN reason IS NULL AND t THEN tolerance_s END AS tolerance_s,
 CASE WHEN reason IS NULL AND t THEN reset END AS reset, CASE WHEN reason IS NULL AND t THEN confidence END AS confidence FROM (SELECT v.*, r.* EXCLUDE (run_id), first_timers + second_timers > 0 AS t,
  CASE WHEN NOT (first AND second) THEN coalesce(failure, 'product_page_not_visited_twice') WHEN first_timers + second_timers = 0 AND static = 0 AND unverified > 0 THEN 'ticking_not_verified'
   WHEN first_timers + second_timers = 0 AND static = 0 AND funnel_timers > 0 THEN 'countdown_not_seen_on_revisit' WHEN (first_timers = 0) <> (second_timers = 0) THEN 'countdown_seen_once'
   WHEN first_timers > 0 AND pairs IS NULL THEN 'countdown_not_paired' END AS reason FROM v_timer_visits v LEFT JOIN (SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({ORACLES["agg_43_countdown_reset"]}) WHERE run_id % 3 <> 1) r USING (run_id))""")
def _(spark, d):
    p = _pairs(spark, d).where("run_id % 3 <> 1")
    resets = R.countdown_reset(p, p.select("run_id").distinct().withColumn("elapsed", (F.col("run_id") % 50 + 20).cast("double")))
    return R.countdown_outcome(spark_view(spark, d, "v_timer_visits"), resets)


@query("join_15_site_copy", "SELECT l_orderkey AS run_id, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (l_orderkey, lower(p_name)) NOT IN (SELECT l_orderkey, lower(p_name) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 30)")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("run_id", F.col("l_orderkey"))
    stock = j.select("run_id", "l_linenumber", "l_partkey", F.initcap("p_name").alias("text"))
    return R.without_site_copy(stock, j.where("l_quantity > 30").select("run_id", F.col("p_name").alias("text"))).select("run_id", "l_linenumber", "l_partkey")


@query("win_13_visit_pairs", "SELECT l_partkey AS run_id, l_suppkey AS product, t, q AS number, lag(q) OVER w AS before, q <> lag(q) OVER w AS changed, q < lag(q) OVER w AS decreased FROM (SELECT *, l_orderkey * 10 + l_linenumber AS t, l_quantity AS q FROM lineitem) WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY t)")
def _(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_partkey").alias("run_id"), F.col("l_suppkey").alias("product"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"), F.col("l_quantity").alias("number"))
    return R.visit_pairs(v)


@query("agg_42_low_stock", """SELECT run_id, coalesce(same, 0) AS same_number_products, CASE WHEN (chg > 0)::INT + (coalesce(same,0) >= 3)::INT + (con > 0)::INT >= 2 THEN 0.9 ELSE greatest(chg, CASE WHEN same >= 3 THEN 0.8 WHEN same = 2 THEN 0.4 ELSE 0.0 END, con) END AS confidence FROM (
 SELECT l_partkey AS run_id, max(CASE WHEN l_linenumber = 3 AND l_quantity % 6 <> l_quantity % 5 THEN 0.8 WHEN l_linenumber = 4 AND l_quantity % 6 >= 1 THEN 0.6 ELSE 0.0 END) AS con, max(CASE WHEN l_tax > 0.07 THEN 0.8 WHEN l_discount > 0.095 THEN 0.6 ELSE 0.0 END) AS chg FROM lineitem GROUP BY 1)
 LEFT JOIN (SELECT run_id, max(c) AS same FROM (SELECT l_partkey AS run_id, l_quantity % 6 AS num, count(*) c FROM lineitem WHERE l_quantity % 6 <> 1 AND NOT (l_linenumber = 3 AND l_quantity % 6 = l_quantity % 5) GROUP BY ALL) GROUP BY 1) USING (run_id)""")
def _(spark, d):
    li, ln = table(spark, d, "lineitem"), F.col("l_linenumber")
    p = li.select(F.col("l_partkey").alias("run_id"), F.col("l_orderkey").alias("product"), (F.col("l_quantity") % 6).alias("number"), F.when(ln == 3, F.col("l_quantity") % 5).alias("inventory_level"),
                  F.lit(1).alias("offers"), F.when(ln == 4, "SoldOut").otherwise("InStock").alias("availability"))
    return R.low_stock(p, li.select(F.col("l_partkey").alias("run_id"), (F.col("l_discount") > 0.095).alias("changed"), (F.col("l_tax") > 0.07).alias("decreased")))


view("v_tab", "SELECT run_id, ord, ord AS page_id, k % 8 < 7 AS tabk, CASE WHEN k % 30 = 0 THEN 2 ELSE 1 END AS tab, concat('o', CAST(k % 5 AS VARCHAR(2))) AS key, event_type FROM v_ev")
duck_view("v_epoch", "SELECT *, sum(chg) OVER (PARTITION BY run_id ORDER BY ord) AS epoch FROM (SELECT *, CASE WHEN lag(tab) OVER (PARTITION BY run_id ORDER BY ord) = tab THEN 0 ELSE 1 END AS chg FROM v_tab)")


@query("win_12_tab_epochs", "SELECT run_id, ord, CAST(epoch AS BIGINT) AS epoch FROM v_epoch")
def _(spark, d):
    return R.tab_epochs(spark_view(spark, d, "v_tab")).select("run_id", "ord", "epoch")


def _repeated(spark, d):
    e = R.tab_epochs(spark_view(spark, d, "v_tab"))
    return R.repeated_overlays(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


duck_view("v_again", """SELECT s.run_id, s.key, count(*) + 1 AS pages, arg_min(c.closed_on, c.co) AS closed_on FROM v_epoch s JOIN (SELECT run_id, epoch, key, min(ord) co, arg_min(page_id, ord) closed_on FROM v_epoch WHERE event_type = 'click' GROUP BY ALL) c
 ON c.run_id = s.run_id AND c.epoch = s.epoch AND c.key = s.key AND s.ord > c.co WHERE s.event_type = 'view' GROUP BY ALL""")


@query("join_16_repeated_overlays", "SELECT * FROM v_again")
def _(spark, d):
    return _repeated(spark, d)


@query("agg_44_nagging", "SELECT r.run_id, coalesce(most, 0) AS most, CASE WHEN r.run_id % 10 = 0 THEN 0.9 WHEN most >= 3 THEN 0.8 WHEN most = 2 THEN 0.6 ELSE 0.0 END AS confidence FROM (SELECT DISTINCT user_id AS run_id FROM events) r LEFT JOIN (SELECT run_id, max(pages) most FROM v_again GROUP BY 1) USING (run_id)")
def _(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("run_id")).distinct().withColumn("reappeared", F.col("run_id") % 10 == 0)
    return R.nagging(_repeated(spark, d), r)


view("v_btn", "SELECT l_orderkey AS run_id, CASE l_suppkey % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'close' WHEN 3 THEN 'manage' ELSE 'accept' END AS kind, floor(l_extendedprice) AS area, l_tax * 100 AS contrast, l_quantity > 25 AS filled, l_linenumber * 10000000 + l_partkey AS ord FROM lineitem")


@query("agg_45_consent_asymmetry", """SELECT run_id, CASE WHEN aa IS NULL THEN CASE WHEN kinds = 'close' THEN 0.0 END WHEN ra IS NULL THEN CASE WHEN run_id % 4 = 0 THEN 0.8 ELSE 1.0 END WHEN ra / greatest(1, aa) < 0.25 THEN 0.8 WHEN ra / greatest(1, aa) < 0.5 THEN 0.6 WHEN af AND NOT rf AND rc < ac THEN 0.3 ELSE 0.0 END AS confidence,
 CASE WHEN aa IS NULL AND kinds <> 'close' THEN 'accept_not_recognised' END AS reason FROM (SELECT run_id, kinds, aa, af, ac, CASE WHEN ra0 IS NOT NULL THEN ra0 WHEN run_id % 3 = 0 THEN ca END ra, CASE WHEN ra0 IS NOT NULL THEN rf0 WHEN run_id % 3 = 0 THEN cf END rf, CASE WHEN ra0 IS NOT NULL THEN rc0 WHEN run_id % 3 = 0 THEN cc END rc FROM (
 SELECT run_id, array_to_string(list_sort(list(DISTINCT kind)), ',') kinds, max(area) FILTER (WHERE kind='accept') aa, arg_max(filled, (area,-ord)) FILTER (WHERE kind='accept') af, arg_max(contrast, (area,-ord)) FILTER (WHERE kind='accept') ac,
 max(area) FILTER (WHERE kind='reject') ra0, arg_max(filled, (area,-ord)) FILTER (WHERE kind='reject') rf0, arg_max(contrast, (area,-ord)) FILTER (WHERE kind='reject') rc0, max(area) FILTER (WHERE kind='close') ca, arg_max(filled, (area,-ord)) FILTER (WHERE kind='close') cf, arg_max(contrast, (area,-ord)) FILTER (WHERE kind='close') cc FROM v_btn GROUP BY run_id))""")
def _(spark, d):
    b = spark_view(spark, d, "v_btn")
    ban = b.select("run_id").distinct().withColumns({"clicks_to_reject": F.when(F.col("run_id") % 4 == 0, 2), "second_layer_checked": F.lit(True), "reject_kind": F.when(F.col("run_id") % 3 == 0, "close")})
    return R.consent_asymmetry(b, ban)


@query("agg_47_risk_rows", f"""SELECT p.run_id, p.profile, k.kpi_id, CASE WHEN t.l_quantity > 10 THEN {half_even('t.l_discount', 3)} END AS value_num, CASE WHEN t.l_quantity IS NULL THEN 'deception_not_run' WHEN t.l_quantity <= 5 THEN coalesce(w.reason, 'not_reached') WHEN t.l_quantity <= 10 THEN 'nothing_added' END AS reason
 FROM (SELECT DISTINCT run_id, profile FROM v_page) p CROSS JOIN (VALUES ('DPR.SNEAK_INTO_BASKET'),('DPR.NAGGING_OVERLAYS')) k(kpi_id) LEFT JOIN (SELECT l_partkey AS run_id, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) l_quantity, arg_min(l_discount, l_orderkey * 10 + l_linenumber) l_discount FROM lineitem GROUP BY 1) t
 ON t.run_id = p.run_id AND p.profile = 'mobile' AND k.kpi_id = 'DPR.SNEAK_INTO_BASKET' LEFT JOIN v_why w ON w.run_id = p.run_id AND w.profile = p.profile AND w.stage = 'cart'""")
def _(spark, d):
    p = spark_view(spark, d, "v_page").select("run_id", "profile").distinct()
    first = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("run_id")).agg(F.min_by(F.struct("l_quantity", "l_discount"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("f"))
    q = F.col("f.l_quantity")
    t = first.select("run_id", F.lit("mobile").alias("profile"), F.lit("DPR.SNEAK_INTO_BASKET").alias("kpi_id"), (q > 10).alias("assessed"), F.col("f.l_discount").alias("confidence"), F.lit("nothing_added").alias("reason"), F.lit("cart").alias("stage"), (q <= 5).alias("stage_missing"))
    w = C.stage_reasons(p.withColumn("stage", F.lit("cart")), spark_view(spark, d, "v_gaps")).withColumnRenamed("reason", "stage_reason")
    return R.risk_rows(p, t, w, ["DPR.SNEAK_INTO_BASKET", "DPR.NAGGING_OVERLAYS"]).drop("assessed")


# ---------------------------------------------------------------- carts and outcomes
view("v_cl", "SELECT l_orderkey AS run_id, CASE WHEN l_quantity = 4 THEN '' ELSE 'an item' END AS title, CAST(1 + l_quantity % 3 AS INT) AS qty, CASE WHEN l_quantity = 9 THEN NULL ELSE floor(l_extendedprice / 100) END AS price, l_suppkey % 9 = 0 AS addon FROM lineitem")
view("v_carts", "SELECT run_id, CASE run_id % 3 WHEN 0 THEN sum(price) WHEN 1 THEN sum(price * qty) END AS subtotal, CAST(NULL AS DOUBLE) AS total, FALSE AS marked_empty, CASE WHEN run_id % 50 = 7 THEN 'cart_unreadable' END AS unreadable FROM v_cl GROUP BY run_id")
_cl = "abs(§1-§2) <= greatest(0.05, 0.01*greatest(abs(§1), abs(§2)))"
duck_view("v_read", f"""SELECT c.*, CASE WHEN np = 0 AND mq > 1 AND subtotal IS NOT NULL THEN CASE WHEN ({_cl.replace('§1', 't').replace('§2', 'subtotal')}) AND NOT ({_cl.replace('§1', 'u').replace('§2', 'subtotal')}) THEN 'line_total' WHEN ({_cl.replace('§1', 'u').replace('§2', 'subtotal')}) AND NOT ({_cl.replace('§1', 't').replace('§2', 'subtotal')}) THEN 'unit' END END AS reading
 FROM v_carts c JOIN (SELECT run_id, sum(price) t, sum(price*qty) u, count(*) FILTER (WHERE price IS NULL) np, max(qty) mq FROM v_cl GROUP BY 1) USING (run_id)""")


@query("agg_41_cart_reading", "SELECT run_id, reading FROM v_read")
def _(spark, d):
    return R.cart_reading(spark_view(spark, d, "v_cl"), spark_view(spark, d, "v_carts"))


def _cart(spark, d):
    return spark_view(spark, d, "v_cl").withColumn("amounts", F.array().cast("array<double>")), spark_view(spark, d, "v_carts")


@query("ora_01_cart_not_empty", """SELECT run_id, CASE WHEN w IS NULL THEN items > 0 END AS passed, w AS not_assessable FROM (SELECT c.run_id, items, CASE WHEN items = 0 THEN coalesce(unreadable, CASE WHEN nameless > 0 THEN 'cart_items_unreadable' END) END AS w FROM v_carts c JOIN (
 SELECT run_id, count(*) FILTER (WHERE NOT addon AND length(title) >= 2) items, count(*) FILTER (WHERE NOT addon AND length(title) < 2) nameless FROM v_cl GROUP BY 1) USING (run_id))""")
def _(spark, d):
    return R.verify_cart(*_cart(spark, d))


@query("ora_02_item_under_price", f"""SELECT run_id, CASE WHEN w IS NULL THEN hits > 0 END AS passed, w AS not_assessable FROM (SELECT run_id, hits, CASE WHEN hits = 0 THEN CASE WHEN unreadable IS NOT NULL THEN unreadable WHEN amb THEN 'cart_price_ambiguous' WHEN nop THEN 'cart_price_unreadable' WHEN items = 0 AND nameless > 0 THEN 'cart_items_unreadable' END END AS w FROM (
 SELECT run_id, any_value(unreadable) unreadable, count(*) FILTER (WHERE ok) items, count(*) FILTER (WHERE NOT addon AND NOT ok) nameless, count(*) FILTER (WHERE ok AND CASE WHEN qty > 1 AND reading = 'line_total' THEN {half_even('price/qty', 2)} ELSE price END <= 100) hits,
 coalesce(bool_or(qty > 1 AND price IS NOT NULL AND reading IS NULL AND {half_even('price/qty', 2)} <= 100) FILTER (WHERE ok), false) amb, coalesce(bool_or(price IS NULL) FILTER (WHERE ok), false) nop FROM (SELECT l.*, r.unreadable, r.reading, NOT addon AND length(title) >= 2 AS ok FROM v_cl l JOIN v_read r USING (run_id)) GROUP BY run_id))""")
def _(spark, d):
    return R.verify_cart(*_cart(spark, d), F.lit(100.0))


@query("agg_40_funnel_delta", f"""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {half_even('greatest(0.0, (o_totalprice - 5 - base) / base * 100)', 1)} END AS delta, CASE WHEN o_orderkey % 7 = 0 THEN 'empty_cart' END AS reason FROM orders JOIN (SELECT l_orderkey, sum(floor(l_extendedprice)) AS base FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("cart").alias("stage"), F.col("o_totalprice").alias("total"), F.lit(None).cast("double").alias("subtotal"), F.lit(5.0).alias("shipping"), F.lit(None).cast("double").alias("tax"), (F.col("o_orderkey") % 7 == 0).alias("empty"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum(F.floor("l_extendedprice")).cast("double").alias("price")).withColumn("qty", F.lit(1))
    return R.funnel_delta(o, b)


_STOP = tuple(dict.fromkeys([*K.FUNCTION_WORDS["it"], *K.FUNCTION_WORDS["en"], *K.EXTRA_STOP_WORDS]))


def _final_pages(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("run_id"), F.when(F.col("p_size") % 2 == 0, "pdp").otherwise("plp").alias("page_type"), (F.col("p_size") % 7 != 0).alias("on_site"), (F.col("p_size") % 11 != 0).alias("readable"),
                    F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 4).alias("results"), F.when(F.col("p_size") % 13 == 0, "nothing found").alias("no_results_text"), F.lit("the red ring for you").alias("query"), F.lit(1000.0).alias("max_price"))


_hit = "(contains(p_name, 'red') OR contains(p_name, 'ring'))"


@query("ora_03_pdp_reached", f"SELECT p_partkey AS run_id, CASE WHEN p_size % 11 <> 0 THEN p_size % 2 = 0 AND p_size % 7 <> 0 AND p_retailprice <= 1000 AND {_hit} END AS passed, CASE WHEN p_size % 11 = 0 THEN 'final_page_unreadable' END AS not_assessable FROM part")
def _(spark, d):
    return R.verify_page(_final_pages(spark, d), "pdp_reached", _STOP)


@query("ora_04_search_results", f"SELECT p_partkey AS run_id, CASE WHEN p_size % 11 <> 0 THEN p_size % 2 = 1 AND p_size % 4 >= 1 AND p_size % 7 <> 0 AND p_size % 13 <> 0 AND {_hit} END AS passed, CASE WHEN p_size % 11 = 0 THEN 'final_page_unreadable' END AS not_assessable FROM part")
def _(spark, d):
    return R.verify_page(_final_pages(spark, d), "search_results_shown", _STOP)


@query("txt_23_query_match", "SELECT p_partkey, array_to_string(list_sort(list_filter(['red','ring'], lambda w: list_contains(string_split(p_name, ' '), w))), ',') AS hits FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(R.query_hits(F.lit("the Red ring for you"), F.col("p_name"), _STOP), ",").alias("hits"))


# SQL reads 0.8 as a decimal; the operators give doubles
for _name in ("join_11_sneak_into_basket", "agg_46_prechecked", "agg_43_countdown_reset", "agg_42_low_stock", "agg_44_nagging", "agg_45_consent_asymmetry"):
    ORACLES[_name] = f"SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({ORACLES[_name]})"
