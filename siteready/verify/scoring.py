"""Checks of the scoring operators on lineitem-derived observations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteready.dims.catalog import default_catalog
from siteready.functions import numbers as N
from siteready.operators import scoring as S
from siteready.operators.quantiles import weighted_median
from siteready.verify.base import DUCK_VIEWS, duck_view, half_even, query, spark_view, table, view

CAT = default_catalog()


def _kpi_rows() -> str:
    """Per KPI of the registry: how the checks spread values over its anchor points or keys."""
    rows = []
    for i, k in enumerate(CAT.kpis.values()):
        xs = [x for x, _ in k.points] or [0.0, 1.0]
        keys = "|".join([key for key, _ in k.mapping] + ["other"]) if k.value_type == "enum" else ""
        rows.append(f"({i}, '{k.id}', '{k.value_type}', '{k.scope}', {str(k.judged).lower()}, CAST({min(xs)} AS DOUBLE), CAST({max(xs)} AS DOUBLE), '{keys}', {len(k.mapping) + 1})")
    return ",\n".join(rows)


# Every KPI of the registry. A run is a supplier; every fourth lacks half of its rows, every third shows no risk, some
# have no judged rows or no journey. Numbers run a little past both ends of their anchors, in steps of 1/8.
view("v_kdim", f"SELECT * FROM (VALUES {_kpi_rows()}) AS t(k, kpi_id, kind, kscope, judged, lo, hi, keys, n_keys)")
view("v_obs", f"""
SELECT run_id, ord, kpi_id, page_id, profile, stage, ok AS assessed, CASE WHEN judged THEN 'judged' ELSE 'deterministic' END AS source,
  CASE WHEN ok THEN NULL WHEN qty <= 2 THEN 'not_applicable:no_data' WHEN qty <= 4 THEN 'timeout' ELSE 'not_reached' END AS reason,
  CASE WHEN ok THEN CASE WHEN kind IN ('bool', 'enum') THEN kind ELSE 'number' END END AS value_type,
  CASE WHEN NOT ok THEN NULL WHEN kind = 'confidence' THEN CASE WHEN run_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE disc * 10 END
    WHEN kind = 'number' THEN floor((lo + (hi - lo) * (qty - 10) / 45) * 8) / 8 END AS value_num,
  CASE WHEN ok AND kind = 'bool' THEN qty > 12 END AS value_bool,
  CASE WHEN ok AND kind = 'enum' THEN split_part(keys, '|', 1 + CAST(qty % n_keys AS INT)) END AS value_str
FROM (SELECT s.*, d.*, qty > 4 + run_id % 3 AS ok FROM (
   SELECT l_suppkey AS run_id, l_linenumber * 100000000000 + l_orderkey * 10000 + l_suppkey AS ord,
    CAST((l_orderkey + l_partkey * 3 + l_linenumber * 31) % {len(CAT.kpis)} AS INT) AS kk, concat('p', CAST(l_linenumber AS VARCHAR(2))) AS page_id,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 'mobile' ELSE 'desktop' END AS profile,
    CASE l_returnflag WHEN 'A' THEN 'pdp' WHEN 'N' THEN 'plp' ELSE 'cart' END AS stage,
    l_quantity AS qty, l_discount AS disc FROM lineitem) s JOIN v_kdim d ON d.k = s.kk) r
WHERE NOT (run_id % 4 = 0 AND k % 2 = 1) AND NOT (run_id % 5 = 1 AND judged) AND NOT (run_id % 5 = 2 AND kscope = 'journey')
""")

# ---------------------------------------------------------------- DuckDB dimensions written from the same catalog
_lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
duck_view("d_reg", "SELECT * FROM (VALUES " + ",".join(
    f"({_lit(k.id)},{_lit(k.owner)},{_lit(k.scope)},{_lit(k.aggregate)},{_lit(k.value_type)},{k.weight}::DOUBLE,"
    f"{_lit(k.judged)},{_lit(k.severity)}::DOUBLE,{_lit(k.credit_unless)}::VARCHAR,{_lit(bool(k.points))},"
    f"{_lit(bool(k.mapping))})" for k in CAT.kpis.values())
    + ") t(kpi_id,owner,kscope,mode,ktype,weight,judged,severity,credit,has_points,has_map)")
duck_view("d_pts", "SELECT * FROM (VALUES " + ",".join(
    f"('{k.id}',{i},{x}::DOUBLE,{y}::DOUBLE)" for k in CAT.kpis.values() for i, (x, y) in enumerate(k.points))
    + ") t(kpi_id,i,x,y)")
duck_view("d_map", "SELECT * FROM (VALUES " + ",".join(
    f"('{k.id}',{_lit(key)},{_lit(score)}::DOUBLE)" for k in CAT.kpis.values() for key, score in k.mapping)
    + ") t(kpi_id,key,score)")


def duck_points(kpi: str, x: str) -> str:
    """A correlated scalar: the clamped interpolation of x through the points of kpi."""
    return (f"(SELECT CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= min(p.x) THEN arg_min(p.y, p.x) "
            f"WHEN {x} >= max(p.x) THEN arg_max(p.y, p.x) ELSE (SELECT a.y + (b.y-a.y)*({x}-a.x)/(b.x-a.x) FROM d_pts a "
            f"JOIN d_pts b ON a.kpi_id=b.kpi_id AND b.i=a.i+1 WHERE a.kpi_id={kpi} AND {x}>a.x AND {x}<=b.x) END "
            f"FROM d_pts p WHERE p.kpi_id={kpi})")


duck_view("d_seg", """
SELECT kpi_id, x AS x0, lead(x) OVER w AS x1, y AS y0, lead(y) OVER w AS y1 FROM d_pts WINDOW w AS (PARTITION BY kpi_id ORDER BY i)
UNION ALL SELECT kpi_id, -1e308, min(x), arg_min(y, x), arg_min(y, x) FROM d_pts GROUP BY kpi_id
UNION ALL SELECT kpi_id, max(x), 1e308, arg_max(y, x), arg_max(y, x) FROM d_pts GROUP BY kpi_id
""")
# rows with their facts
duck_view("v_rows", """
SELECT o.*, r.owner, r.kscope, r.mode, r.ktype, r.weight, r.judged, r.severity, r.credit, r.has_points, r.has_map,
  o.assessed AND (o.value_num IS NOT NULL OR o.value_bool IS NOT NULL OR o.value_str IS NOT NULL) AS usable,
  CASE WHEN o.assessed THEN o.value_num END AS x,
  CASE WHEN o.assessed THEN coalesce(o.value_bool, o.value_num <> 0, length(o.value_str) > 0) END AS truth,
  coalesce(o.value_str, CAST(o.value_bool AS VARCHAR)) AS mkey,
  CASE WHEN r.mode = 'wmedian' AND o.stage IN ('pdp','plp') THEN 2 ELSE 1 END AS w,
  CASE WHEN r.has_map THEN (SELECT m.score FROM d_map m WHERE m.kpi_id=o.kpi_id AND m.key=coalesce(o.value_str, CAST(o.value_bool AS VARCHAR)))
    END AS rscore
FROM v_obs o JOIN d_reg r USING (kpi_id)
""")
duck_view("v_prof", "SELECT DISTINCT run_id, profile FROM v_obs WHERE profile IS NOT NULL")
duck_view("v_scoped", """
SELECT r.*, 'overall' AS scope FROM v_rows r UNION ALL
SELECT r.*, r.profile AS scope FROM v_rows r WHERE r.profile IS NOT NULL UNION ALL
SELECT r.*, p.profile AS scope FROM v_rows r JOIN v_prof p USING (run_id) WHERE r.profile IS NULL
""")
# pooled aggregate per scope; the weighted median expands integer weights
duck_view("v_groups", f"""
SELECT run_id, kpi_id, scope, any_value(owner) owner, any_value(kscope) kscope, any_value(mode) mode, any_value(ktype) ktype,
  any_value(weight) weight, any_value(judged) judged, any_value(severity) severity, any_value(credit) credit,
  any_value(has_points) has_points, any_value(has_map) has_map,
  count(*) n_rows, count(*) FILTER (WHERE usable) n_usable, count(x) n_num,
  count(*) FILTER (WHERE profile = scope) own_rows, count(*) FILTER (WHERE profile = scope AND usable) own_usable,
  min(ord) FILTER (WHERE profile = scope) own_row_ord, min(ord) FILTER (WHERE profile = scope AND usable) own_use_ord,
  bool_or(truth) any_true, bool_and(truth) all_true,
  arg_min(reason, ord) FILTER (WHERE NOT usable AND NOT starts_with(reason, 'not_applicable')) pending,
  coalesce(arg_min(reason, ord) FILTER (WHERE NOT usable AND NOT starts_with(reason, 'not_applicable')), arg_min(reason, ord) FILTER (WHERE NOT usable)) why,
  bool_or(usable AND source = 'judged') judged_source,
  coalesce(arg_min(value_str, ord) FILTER (WHERE usable AND rscore IS NOT NULL), arg_min(value_str, ord) FILTER (WHERE usable)) first_s,
  arg_min(value_num, ord) FILTER (WHERE usable AND value_num IS NOT NULL) first_n,
  arg_max(value_str, (coalesce(rscore, -1), -ord)) FILTER (WHERE usable) best_s,
  arg_max(page_id, (coalesce(x, 0), -ord)) FILTER (WHERE usable) strongest_page,
  arg_max(coalesce(profile, '-'), (coalesce(x, 0), -ord)) FILTER (WHERE usable) strongest_profile,
  {half_even("CASE any_value(mode) WHEN 'sum' THEN sum(x) WHEN 'max' THEN max(x) WHEN 'min' THEN min(x) WHEN 'mean' THEN avg(x) WHEN 'median' THEN median(x) WHEN 'wmedian' THEN median(x) FILTER (WHERE true) END", 4)} AS plain_num
FROM v_scoped GROUP BY run_id, kpi_id, scope
""")
duck_view("v_wmed", f"""
SELECT run_id, kpi_id, scope, {half_even("median(x)", 4)} AS wmed FROM
 (SELECT run_id, kpi_id, scope, x FROM v_scoped, unnest(range(0, w)) WHERE mode = 'wmedian' AND x IS NOT NULL) GROUP BY ALL
""")
duck_view("v_pooled", """
SELECT g.*, CASE mode WHEN 'wmedian' THEN wmed WHEN 'first' THEN first_n ELSE plain_num END AS vnum,
 CASE mode WHEN 'any' THEN any_true WHEN 'all' THEN all_true END AS vbool,
 CASE mode WHEN 'first' THEN first_s WHEN 'best' THEN best_s END AS vstr
FROM v_groups g LEFT JOIN v_wmed USING (run_id, kpi_id, scope)
""")
duck_view("v_scored", """
SELECT p.*, CASE WHEN has_points THEN CASE WHEN s.y0 = s.y1 THEN s.y0 ELSE s.y0 + (s.y1-s.y0)*(vnum-s.x0)/(s.x1-s.x0) END
   WHEN has_map THEN m.score END AS ascore, m.kpi_id IS NOT NULL AS mapped,
  coalesce(mode = 'any' AND NOT coalesce(any_true, false) AND pending IS NOT NULL, false) AS drp
FROM v_pooled p LEFT JOIN d_seg s ON s.kpi_id = p.kpi_id AND p.vnum > s.x0 AND p.vnum <= s.x1
LEFT JOIN d_map m ON m.kpi_id = p.kpi_id AND m.key = coalesce(p.vstr, CAST(p.vbool AS VARCHAR))
""")
duck_view("v_worst", """
SELECT run_id, kpi_id, min(ascore) FILTER (WHERE cand) w1, arg_min(scope, (ascore, own_use_ord)) FILTER (WHERE cand) wp,
 count(*) FILTER (WHERE own_usable > 0 AND NOT drp) used, count(*) FILTER (WHERE own_rows > 0) names,
 count(*) FILTER (WHERE own_rows > 0 AND drp) dropped,
 sum(own_usable) own, sum(own_usable) FILTER (WHERE NOT (drp AND own_rows > 0)) kept_own,
 arg_min(pending, own_row_ord) FILTER (WHERE drp AND own_rows > 0) first_pending
FROM (SELECT *, own_usable > 0 AND NOT drp AND ascore IS NOT NULL AS cand FROM v_scored WHERE scope <> 'overall') GROUP BY ALL
""")
duck_view("v_second", """
SELECT s.run_id, s.kpi_id, min(s.ascore) w2 FROM v_scored s JOIN v_worst w USING (run_id, kpi_id)
WHERE s.scope <> 'overall' AND s.own_usable > 0 AND NOT s.drp AND s.ascore IS NOT NULL AND s.scope <> w.wp GROUP BY ALL
""")
duck_view("v_agg", """
SELECT s.run_id, s.scope, s.kpi_id, s.owner, s.kscope, s.mode, s.weight, s.judged, s.severity, s.credit, s.has_points, s.has_map,
 s.n_rows, s.n_usable, s.judged_source, s.strongest_page, s.strongest_profile,
 CASE WHEN sp THEN b.vnum ELSE s.vnum END vnum, CASE WHEN sp THEN b.vbool ELSE s.vbool END vbool, CASE WHEN sp THEN b.vstr ELSE s.vstr END vstr,
 CASE WHEN sp THEN b.ascore ELSE s.ascore END ascore, CASE WHEN sp THEN b.mapped ELSE s.mapped END mapped, s.n_num, gone,
 CASE WHEN n_usable0 = 0 THEN s.why WHEN gone THEN CASE WHEN s.scope = 'overall' AND names > 0 THEN first_pending ELSE s.pending END
   WHEN s.mode NOT IN ('any','all','first','best') AND s.n_num = 0 THEN 'invalid_value' END AS reason,
 n_usable0 > 0 AND NOT gone AND (s.mode IN ('any','all','first','best') OR s.n_num > 0) AS assessed,
 CASE WHEN sp AND w2 IS NOT NULL AND w1 < w2 - 1e-9 THEN wp END AS worst_profile
FROM (SELECT s0.*, s0.n_usable AS n_usable0, w.w1, w.wp, w.names, w.first_pending,
   coalesce(s0.scope = 'overall' AND s0.owner <> 'DPR' AND w.used > 1 AND w.wp IS NOT NULL, false) AS sp,
   CASE WHEN s0.mode <> 'any' OR s0.n_usable = 0 THEN false WHEN s0.scope = 'overall' AND coalesce(w.names, 0) > 0
     THEN w.dropped = w.names OR s0.n_usable - coalesce(w.own, 0) + coalesce(w.kept_own, 0) = 0 ELSE s0.drp END AS gone
   FROM v_scored s0 LEFT JOIN v_worst w USING (run_id, kpi_id)) s
LEFT JOIN v_second USING (run_id, kpi_id)
LEFT JOIN v_scored b ON b.run_id = s.run_id AND b.kpi_id = s.kpi_id AND b.scope = s.wp
""")
duck_view("v_ctx", """
SELECT run_id, scope, bool_or(j) AS journey, bool_or(g) AS judged_run FROM (
 SELECT run_id, scope, kscope = 'journey' AND assessed AS j, false AS g FROM v_scoped UNION ALL
 SELECT s.run_id, s.scope, false, (r.judged OR source = 'judged') FROM (SELECT DISTINCT run_id, scope FROM v_scoped) s
   JOIN v_rows r USING (run_id)) GROUP BY ALL
""")
duck_view("v_kpi0", f"""
SELECT a.*, c.journey, c.judged_run,
 CASE WHEN a.owner = 'DPR' AND a.assessed THEN {half_even("least(1.0, greatest(0.0, vnum))", 4)} END rvalue,
 CASE WHEN a.assessed AND a.owner <> 'DPR' AND ascore IS NOT NULL THEN {half_even("least(100.0, greatest(0.0, ascore))", 2)} END norm0,
 a.assessed AND a.owner <> 'DPR' AND a.has_map AND a.mapped AND a.ascore IS NULL AS to_none,
 a.assessed AND a.owner <> 'DPR' AND (a.has_map OR a.has_points) AND a.ascore IS NULL AND NOT (a.has_map AND a.mapped) AS unscored,
 coalesce(g.sig, 0) AS sig
FROM v_agg a JOIN v_ctx c USING (run_id, scope)
LEFT JOIN (SELECT run_id, scope, kpi_id AS partner, vnum AS sig FROM v_agg WHERE owner = 'DPR' AND assessed) g
  ON g.run_id = a.run_id AND g.scope = a.scope AND g.partner = a.credit
""")
duck_view("v_kpis", """
SELECT run_id, scope, kpi_id, owner, weight, severity, kscope, judged, journey, judged_run,
 CASE WHEN owner = 'DPR' THEN rvalue WHEN assessed THEN vnum END AS value_num, CASE WHEN assessed THEN vbool END AS value_bool,
 CASE WHEN assessed THEN vstr END AS value_str,
 assessed AND NOT to_none AND NOT unscored AS ok,
 CASE WHEN NOT (assessed AND NOT to_none AND NOT unscored) THEN NULL WHEN credit IS NOT NULL AND sig >= 0.5 THEN 30.0 ELSE norm0 END AS normalized,
 CASE WHEN to_none THEN 'not_applicable' WHEN unscored THEN 'invalid_value'
   WHEN credit IS NOT NULL AND sig >= 0.5 AND assessed AND norm0 IS NOT NULL THEN 'credit_withheld:' || credit ELSE reason END AS reason,
 CASE WHEN assessed AND NOT to_none AND NOT unscored THEN worst_profile END AS profile,
 n_rows, CASE WHEN judged THEN 'judged' ELSE 'deterministic' END AS source,
 strongest_page, strongest_profile
FROM v_kpi0
""")
duck_view("v_kpi", """
SELECT *, NOT (kscope = 'journey' AND NOT journey) AND NOT (judged AND NOT judged_run) AND coalesce(reason, '') <> 'not_applicable'
  AND NOT (NOT ok AND starts_with(coalesce(reason, ''), 'not_applicable')) AS applicable FROM v_kpis
""")
duck_view("v_full", """
SELECT s.run_id, s.scope, r.kpi_id, r.owner, r.weight, r.severity, r.judged, k.kpi_id IS NOT NULL AS seen, coalesce(k.ok, false) AS ok,
  k.normalized, k.value_num, k.source,
  coalesce(k.applicable, NOT (r.kscope = 'journey' AND NOT s.journey) AND NOT (r.judged AND NOT s.judged_run)) AS applicable,
  CASE WHEN k.kpi_id IS NOT NULL THEN k.reason WHEN r.judged AND NOT s.judged_run THEN 'not_judged'
   WHEN r.kscope = 'journey' AND NOT s.journey THEN 'no_journey' ELSE 'no_observation' END AS reason
FROM v_ctx s CROSS JOIN d_reg r LEFT JOIN v_kpi k ON k.run_id = s.run_id AND k.scope = s.scope AND k.kpi_id = r.kpi_id
""")
_sc = lambda x: half_even(x, 3)
_three = lambda x: (f"(CASE WHEN floor({_sc(x)}*100+0.5+1e-9) <> floor(({x})*100+0.5+1e-9) "  # noqa: E731
                    f"THEN floor(({x})*1000+1e-6)/1000 ELSE {_sc(x)} END)")
_stored = lambda x: (f"(CASE WHEN list_bool_or([(({x})+1e-9 < t) AND (t <= {_three(x)}+1e-9) for t in [0.85,0.7,0.6,0.5]]) "  # noqa: E731
                     f"THEN floor(({x})*1000+1e-6)/1000 ELSE {_three(x)} END)")
_grade = lambda x: f"(CASE WHEN {x}+1e-9 >= 0.85 THEN 'A' WHEN {x}+1e-9 >= 0.70 THEN 'B' WHEN {x}+1e-9 >= 0.60 THEN 'C' END)"
duck_view("v_sub", """
SELECT run_id, scope, owner, sum(weight) FILTER (WHERE ok AND normalized IS NOT NULL) aw,
 sum(weight*normalized) FILTER (WHERE ok AND normalized IS NOT NULL) / sum(weight) FILTER (WHERE ok AND normalized IS NOT NULL) AS exact_score,
 coalesce(sum(weight) FILTER (WHERE ok AND normalized IS NOT NULL) / sum(weight), 0.0) AS exact_coverage,
 coalesce(coalesce(sum(weight) FILTER (WHERE ok AND normalized IS NOT NULL AND source='judged'), 0.0) / sum(weight) FILTER (WHERE ok AND normalized IS NOT NULL), 0.0) AS exact_share,
 list_slice(list_transform(list_sort(list({'a': normalized, 'b': -weight, 'c': kpi_id}) FILTER (WHERE ok AND normalized < 100)), lambda s: s.c), 1, 3) AS lim
FROM v_full WHERE owner <> 'DPR' AND weight > 0 AND applicable GROUP BY ALL
""")
duck_view("v_risk", f"""
SELECT run_id, scope, {half_even("100*(1-coalesce(product(1-least(1.0,greatest(0.0,severity*value_num))) FILTER (WHERE ok AND value_num <> 0), 1.0))", 2)} AS risk_score,
 {_three("coalesce(sum(severity) FILTER (WHERE ok AND applicable),0)/sum(severity) FILTER (WHERE applicable)")} AS risk_coverage,
 count(*) FILTER (WHERE ok AND applicable) AS assessed, count(*) FILTER (WHERE applicable) AS applicable
FROM v_full WHERE owner = 'DPR' GROUP BY ALL
""")


def _obs(spark, d):
    return spark_view(spark, d, "v_obs")


def _kpis(spark, d):
    return S.kpi_scores(S.aggregate_kpis(_obs(spark, d), CAT), CAT)


@query("join_01_enrich", """SELECT o.run_id, o.ord, o.kpi_id, r.owner, r.mode AS aggregate_mode, r.weight FROM v_obs o
 JOIN d_reg r USING (kpi_id)""")
def _(spark, d):
    return S.enrich(_obs(spark, d), CAT).select("run_id", "ord", "kpi_id", "owner", "aggregate_mode", "weight")


@query("join_02_points_band", f"""SELECT o.run_id, o.ord, {half_even("CASE WHEN s.y0=s.y1 THEN s.y0 ELSE s.y0+(s.y1-s.y0)*(o.value_num-s.x0)/(s.x1-s.x0) END", 2)} AS score
 FROM v_obs o JOIN d_seg s ON s.kpi_id=o.kpi_id AND o.value_num > s.x0 AND o.value_num <= s.x1""")
def _(spark, d):
    obs = _obs(spark, d).where("value_num is not null").withColumn("x", F.col("value_num"))
    return S.score_points(obs, CAT).where("points_score is not null").select(
        "run_id", "ord", N.round_half_even(F.col("points_score"), 2).alias("score"))


@query("join_03_map", """SELECT o.run_id, o.ord, m.score, m.kpi_id IS NOT NULL AS mapped FROM v_obs o LEFT JOIN d_map m
 ON m.kpi_id=o.kpi_id AND m.key=coalesce(o.value_str, CAST(o.value_bool AS VARCHAR)) WHERE o.value_type IN ('bool','enum')""")
def _(spark, d):
    obs = _obs(spark, d).where(F.col("value_type").isin("bool", "enum"))
    obs = obs.withColumn("map_key", N.map_key(*[F.col(c) for c in S.VALUE]))
    return S.score_map(obs, CAT, out="score").select("run_id", "ord", "score", "mapped")


@query("join_04_withhold", """SELECT run_id, scope, kpi_id, normalized, reason FROM v_kpi WHERE kpi_id IN ('MPI.URGENCY_SIGNALS', 'MPI.SCARCITY_SIGNALS')""")
def _(spark, d):
    return _kpis(spark, d).where("kpi_id in ('MPI.URGENCY_SIGNALS', 'MPI.SCARCITY_SIGNALS')").select("run_id", "scope", "kpi_id", "normalized", "reason")


_MODES = {
    "agg_01_numeric_modes": ("CASE WHEN mode IN ('sum','max','min','median')", ["sum", "max", "min", "median"]),
    "agg_02_weighted_median": ("", ["wmedian"]),
    "agg_03_any_all": ("", ["any", "all"]),
    "agg_05_first_scorable": ("", ["first"]),
    "agg_06_best": ("", ["best"]),
}
for _name, (_x, _modes) in _MODES.items():
    def _run(spark, d, modes=_modes):
        agg = S.aggregate_kpis(_obs(spark, d), CAT).where(F.col("aggregate_mode").isin(*modes))
        return agg.select("run_id", "scope", "kpi_id", F.when(F.col("assessed"), F.col("value_num")).alias("value_num"),
                          F.when(F.col("assessed"), F.col("value_bool")).alias("value_bool"),
                          F.when(F.col("assessed"), F.col("value_str")).alias("value_str"))
    query(_name, "SELECT run_id, scope, kpi_id, CASE WHEN assessed THEN vnum END AS value_num, CASE WHEN assessed THEN vbool END "
          "AS value_bool, CASE WHEN assessed THEN vstr END AS value_str FROM v_agg WHERE mode IN ("
          + ",".join(f"'{m}'" for m in _modes) + ")")(_run)


@query("agg_04_conclusive_any", "SELECT run_id, scope, kpi_id, assessed, reason FROM v_agg WHERE mode = 'any'")
def _(spark, d):
    return S.aggregate_kpis(_obs(spark, d), CAT).where("aggregate_mode = 'any'").select(
        "run_id", "scope", "kpi_id", "assessed", "reason")


@query("agg_07_worst_profile", """SELECT run_id, kpi_id, vnum AS value_num, CASE WHEN assessed THEN worst_profile END AS worst_profile
 FROM v_agg WHERE scope = 'overall' AND assessed AND mode IN ('sum','max','min','median','wmedian')""")
def _(spark, d):
    agg = S.aggregate_kpis(_obs(spark, d), CAT)
    return agg.where((F.col("scope") == "overall") & F.col("assessed") & F.col("aggregate_mode").isin(
        "sum", "max", "min", "median", "wmedian")).select("run_id", "kpi_id", "value_num", "worst_profile")


@query("agg_08_null_profile_fan_out", """SELECT run_id, kpi_id, scope, count(*) AS n FROM v_scoped GROUP BY ALL""")
def _(spark, d):
    rows = S.prepare_rows(_obs(spark, d), CAT)
    base = S.run_context(S._base(rows))
    return S.fan_out(base).groupBy("run_id", "kpi_id", "scope").agg(F.sum("n_rows").alias("n"))


@query("agg_09_reason", "SELECT run_id, scope, kpi_id, reason FROM v_agg WHERE NOT assessed")
def _(spark, d):
    return S.aggregate_kpis(_obs(spark, d), CAT).where("not assessed").select("run_id", "scope", "kpi_id", "reason")


@query("agg_10_kpi_scores", """SELECT run_id, scope, kpi_id, value_num, value_bool, value_str, normalized, ok AS assessed, applicable,
 reason, profile, n_rows AS observations, source FROM v_kpi""")
def _(spark, d):
    return _kpis(spark, d).select("run_id", "scope", "kpi_id", "value_num", "value_bool", "value_str", "normalized",
                                  "assessed", "applicable", "reason", "profile", "observations", "source")


@query("agg_10_all_kpis", """SELECT run_id, scope, coalesce(reason, '-') AS reason, count(*) AS n, count(*) FILTER (WHERE applicable) AS n_applicable
 FROM v_full GROUP BY run_id, scope, coalesce(reason, '-')""")
def _(spark, d):
    return S.all_kpis(_kpis(spark, d), CAT).groupBy("run_id", "scope", F.coalesce("reason", F.lit("-")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("applicable").alias("n_applicable"))


_SUB_SQL = f"""SELECT run_id, scope, owner, {half_even("exact_score", 1)} AS score, {_stored("exact_coverage")} AS coverage,
 CASE WHEN aw > 0 THEN {_grade("exact_coverage")} END AS grade, {_three("exact_share")} AS judged_share
 FROM v_sub WHERE aw > 0"""


@query("agg_11_sub_indices", _SUB_SQL)
def _(spark, d):
    return S.sub_indices(_kpis(spark, d), CAT).where("exact_score is not null").select(
        "run_id", "scope", "owner", "score", "coverage", "grade", "judged_share")


@query("agg_12_limiting_kpis", "SELECT run_id, scope, owner, coalesce(array_to_string(lim, ','), '') AS limiting FROM v_sub WHERE aw > 0")
def _(spark, d):
    return S.sub_indices(_kpis(spark, d), CAT).where("exact_score is not null").select(
        "run_id", "scope", "owner", F.array_join("limiting_kpis", ",").alias("limiting"))


@query("agg_13_noisy_or", f"""SELECT l_orderkey AS run_id,
 {half_even("100*(1-product(1-(CASE l_linenumber % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.6 ELSE 0.9 END)::DOUBLE*least(1.0,l_discount*10)))", 2)} AS risk
 FROM lineitem GROUP BY l_orderkey""")
def _(spark, d):
    severity = F.when(F.col("l_linenumber") % 3 == 0, 0.3).when(F.col("l_linenumber") % 3 == 1, 0.6).otherwise(0.9)
    confidence = F.least(F.lit(1.0), F.col("l_discount") * 10)
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        S.noisy_or(severity, confidence).alias("risk"))


@query("agg_14_risk_summary", "SELECT run_id, scope, risk_score, risk_coverage, assessed, applicable FROM v_risk WHERE (run_id, scope) IN "
       "(SELECT run_id, scope FROM v_kpi WHERE owner = 'DPR')")
def _(spark, d):
    return S.risk_summary(_kpis(spark, d), CAT).drop("unassessed")


_SIG_SQL = f"""SELECT run_id, scope, kpi_id, severity, value_num AS confidence, {half_even("severity*value_num", 4)} AS risk, source,
 strongest_page AS page_id, nullif(strongest_profile, '-') AS profile FROM v_kpi WHERE owner = 'DPR' AND ok AND value_num <> 0"""


@query("agg_15_risk_signals", _SIG_SQL)
def _(spark, d):
    return S.risk_signals(_kpis(spark, d)).drop("evidence", "rank")


@query("top_02_top_risks", f"""SELECT run_id, scope, kpi_id, risk, row_number() OVER (PARTITION BY run_id, scope ORDER BY risk DESC, kpi_id) AS rank
 FROM ({_SIG_SQL}) QUALIFY row_number() OVER (PARTITION BY run_id, scope ORDER BY risk DESC, kpi_id) <= 10""")
def _(spark, d):
    return S.risk_signals(_kpis(spark, d), 10).select("run_id", "scope", "kpi_id", "risk", "rank")


_HEAD = f"""SELECT h.run_id, h.scope, CASE WHEN n_reason = 0 THEN {half_even("exp(lg/present)*(1-0.3*coalesce(r.risk_score,0)/100)", 1)} END AS score,
 n_reason = 0 AS published, CASE WHEN n_reason = 0 THEN {_grade("cov")} END AS grade, {_stored("cov")} AS coverage,
 {_three("CASE WHEN ev > 0 THEN jd/ev ELSE 0 END")} AS judged_share, nullif(concat_ws('; ', r0, r1, r2), '') AS reason,
 limiting AS limiting_factor, coalesce(r.risk_score, 0) AS risk_score
 FROM (SELECT *, ev/100 AS cov, (r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT AS n_reason FROM (
 SELECT *, CASE WHEN present IS NULL THEN 'no_index_assessed' END AS r0, CASE WHEN ev/100 + 1e-9 < 0.6 THEN 'coverage_below_minimum' END AS r1,
  CASE WHEN low <> '' THEN 'major_coverage_below_minimum:' || low END AS r2 FROM HSRC)) h LEFT JOIN RSRC r ON r.run_id = h.run_id AND r.scope = h.scope"""
duck_view("d_iw", "SELECT * FROM (VALUES ('PERF',18.0::DOUBLE,1),('FAI',22.0,2),('TRI',20.0,3),('PTI',15.0,4),('CCL',15.0,5),('MPI',10.0,6)) t(owner,iw,oi)")
_HSRC = """(SELECT run_id, scope, sum(iw*exact_coverage) ev, sum(iw*exact_coverage*exact_share) jd,
  sum(iw*ln(greatest(exact_score,10))) FILTER (WHERE exact_score IS NOT NULL) lg, sum(iw) FILTER (WHERE exact_score IS NOT NULL) present,
  array_to_string(list(i.owner ORDER BY oi) FILTER (WHERE iw >= 15 AND coalesce(exact_coverage,0)+1e-9 < 0.5), ',') low,
  arg_min(i.owner, (exact_score, i.owner)) FILTER (WHERE exact_score IS NOT NULL) limiting
  FROM (SELECT DISTINCT run_id, scope FROM KEYSRC) CROSS JOIN d_iw i LEFT JOIN SUBSRC s USING (run_id, scope, owner) GROUP BY ALL)"""


@query("score_headline", _HEAD.replace("HSRC", _HSRC.replace("SUBSRC", "v_sub").replace("KEYSRC", "v_kpi")).replace("RSRC", "v_risk"))
def _(spark, d):
    return S.score_runs(_obs(spark, d), CAT)


# odd suppliers are audits, even ones journeys; some links name an audit, the run itself, or a journey twice
view("v_jruns", """SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'journey' ELSE 'audit' END AS kind, concat('h', CAST(s_suppkey % 3 AS VARCHAR(2))) AS host,
 CASE s_suppkey % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS profile FROM supplier""")
view("v_jlinks", """SELECT s_suppkey AS run_id, s_suppkey + 1 AS journey_run_id, 2 AS pos FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey, s_suppkey + 3, 1 FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, s_suppkey + 3, 4 FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey, s_suppkey + 2, 3 FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey, s_suppkey, 5 FROM supplier WHERE s_suppkey % 8 = 2""")
duck_view("v_jchecked", """SELECT l.run_id, l.journey_run_id, l.pos, j.profile, CASE WHEN l.run_id = l.journey_run_id THEN 'scored_run_itself' WHEN j.kind IS DISTINCT FROM 'journey' THEN 'not_a_journey' END AS error,
 CASE WHEN l.run_id <> l.journey_run_id AND j.kind = 'journey' AND j.host <> r.host THEN 'another_host' END AS warning
 FROM (SELECT run_id, journey_run_id, min(pos) AS pos FROM v_jlinks GROUP BY ALL) l LEFT JOIN v_jruns j ON j.run_id = l.journey_run_id LEFT JOIN v_jruns r ON r.run_id = l.run_id""")


def _checked(spark, d):
    return S.check_links(spark_view(spark, d, "v_jlinks"), spark_view(spark, d, "v_jruns"))


@query("join_08_checked_links", "SELECT * FROM v_jchecked")
def _(spark, d):
    return _checked(spark, d)


@query("join_08_link_journeys", """SELECT run_id, ord, kpi_id, profile, assessed, value_num, value_bool, value_str FROM v_obs UNION ALL
 SELECT c.run_id, o.ord + c.pos * (SELECT max(ord) + 1 FROM v_obs), o.kpi_id, coalesce(o.profile, c.profile), o.assessed, o.value_num, o.value_bool, o.value_str
 FROM v_obs o JOIN d_reg r USING (kpi_id) JOIN v_jchecked c ON c.journey_run_id = o.run_id WHERE r.kscope = 'journey' AND c.error IS NULL""")
def _(spark, d):
    return S.link_journeys(_obs(spark, d), _checked(spark, d), CAT).select("run_id", "ord", "kpi_id", "profile", "assessed", "value_num", "value_bool", "value_str")


@query("join_08_journey_context", """SELECT run_id, array_to_string(list_sort(list(DISTINCT coalesce(profile, ''))), ',') AS profiles FROM v_jchecked WHERE error IS NULL GROUP BY run_id""")
def _(spark, d):
    return S.journey_context(_checked(spark, d)).select("run_id", F.array_join(F.array_sort("journey_profiles"), ",").alias("profiles"))


# A score over linked runs: the whole chain again, with the linked rows as its observations.
_LINKED_OBS = """(SELECT * FROM v_obs UNION ALL SELECT c.run_id, o.ord + c.pos * (SELECT max(ord) + 1 FROM v_obs) AS ord, o.kpi_id, o.page_id, coalesce(o.profile, c.profile) AS profile, o.stage,
 o.assessed, o.source, o.reason, o.value_type, o.value_num, o.value_bool, o.value_str FROM v_obs o JOIN d_reg r USING (kpi_id) JOIN v_jchecked c ON c.journey_run_id = o.run_id
 WHERE r.kscope = 'journey' AND c.error IS NULL)"""
_CHAIN = "rows prof scoped groups wmed pooled scored worst second agg ctx kpi0 kpis kpi full sub risk".split()


def _linked(sql: str) -> str:
    """The same SQL over linked observations: every view of the chain under a name of its own."""
    sql = re.sub(rf"\bv_({'|'.join(_CHAIN)})\b", r"v_l\1", sql)
    return re.sub(r"\bv_obs\b", "v_lobs", sql)


duck_view("v_lobs", _LINKED_OBS[1:-1])
for _name in _CHAIN:
    duck_view(f"v_l{_name}", _linked(DUCK_VIEWS[f"v_{_name}"]))
duck_view("v_lprof", "SELECT DISTINCT run_id, profile FROM v_lobs WHERE profile IS NOT NULL UNION SELECT run_id, profile FROM v_jchecked WHERE error IS NULL AND profile IS NOT NULL")
duck_view("v_lctx", """SELECT c.run_id, c.scope, c.journey OR j.run_id IS NOT NULL AS journey, c.judged_run FROM (""" + _linked(DUCK_VIEWS["v_ctx"]) + """) c
 LEFT JOIN (SELECT DISTINCT k.run_id, s.scope FROM v_jchecked k JOIN (SELECT DISTINCT run_id, scope FROM v_lscoped) s USING (run_id)
  WHERE k.error IS NULL AND (s.scope = 'overall' OR k.profile IS NULL OR k.profile = s.scope)) j ON j.run_id = c.run_id AND j.scope = c.scope""")


@query("score_linked_headline", _linked(_HEAD.replace("HSRC", _HSRC.replace("SUBSRC", "v_sub").replace("KEYSRC", "v_kpi")).replace("RSRC", "v_risk")))
def _(spark, d):
    checked = _checked(spark, d)
    return S.score_runs(S.link_journeys(_obs(spark, d), checked, CAT), CAT, S.journey_context(checked))


# sub-indices straight from lineitem, wide enough to be published
view("v_subs", """SELECT l_orderkey % 5000 AS run_id, 'overall' AS scope,
 CASE l_linenumber % 6 WHEN 0 THEN 'PERF' WHEN 1 THEN 'FAI' WHEN 2 THEN 'TRI' WHEN 3 THEN 'PTI' WHEN 4 THEN 'CCL' ELSE 'MPI' END AS owner,
 avg(l_extendedprice / 1050) AS exact_score, max(l_quantity / 50) AS exact_coverage, min(l_discount) AS exact_share
 FROM lineitem GROUP BY 1, 2, 3""")
view("v_risks", """SELECT o_orderkey AS run_id, 'overall' AS scope, o_totalprice / 10000 AS risk_score FROM orders""")


def _subs(spark, d):
    return S.headline(spark_view(spark, d, "v_subs"), spark_view(spark, d, "v_risks"), CAT)


_SUBHEAD = _HEAD.replace("HSRC", _HSRC.replace("SUBSRC", "v_subs").replace("KEYSRC", "v_subs")).replace("RSRC", "v_risks")


@query("agg_16_geometric_headline", f"SELECT run_id, score, risk_score FROM ({_SUBHEAD})")
def _(spark, d):
    return _subs(spark, d).select("run_id", "score", "risk_score")


@query("agg_17_publication_gate", f"SELECT run_id, published, grade, coverage, reason, limiting_factor FROM ({_SUBHEAD})")
def _(spark, d):
    return _subs(spark, d).select("run_id", "published", "grade", "coverage", "reason", "limiting_factor")


@query("prj_13_typed_values", """SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value < 3 THEN 1.0 ELSE 0.0 END
  WHEN event_type IN ('view','purchase') THEN floor(value) END AS as_number,
 CASE WHEN event_type IN ('view','purchase') THEN floor(value) END AS strict_number,
 CASE WHEN event_type = 'click' THEN CASE WHEN value < 3 THEN 'true' ELSE 'false' END
  WHEN event_type IN ('view','purchase') THEN CASE floor(value) WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END
  ELSE event_type END AS map_key FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    kind = (F.when(F.col("event_type") == "click", "bool").when(F.col("event_type").isin("view", "purchase"), "number")
            .otherwise("string"))
    num = F.when(kind == "number", F.floor("value").cast("double"))
    boolean = F.when(kind == "bool", F.col("value") < 3)
    return e.select("event_id", N.as_number(kind, num, boolean, True).alias("as_number"),
                    N.as_number(kind, num, boolean).alias("strict_number"),
                    N.map_key(kind, num, boolean, F.col("event_type")).alias("map_key"))


@query("txt_19_percent_rounding", f"""SELECT l_orderkey, l_linenumber, l_partkey, {_stored("s")} AS stored,
 CASE WHEN NOT missed THEN CAST(CAST(whole AS BIGINT) AS VARCHAR) || ' %' WHEN tenths % 10 <> 0 AND gate THEN CAST(tenths // 10 AS VARCHAR) || ',' || CAST(tenths % 10 AS VARCHAR) || ' %'
  ELSE CAST(tenths // 10 AS VARCHAR) || ' %' END AS shown FROM (
 SELECT *, CAST(floor(s*1000+1e-6) AS BIGINT) // 1 AS _t, CAST(floor(s*100*10+1e-6) AS BIGINT) AS tenths, floor(s*100+0.5+1e-9) AS whole,
  list_bool_or([(s+1e-9 < t) AND (t <= floor(s*100+0.5+1e-9)/100+1e-9) for t in [0.85,0.7,0.6,0.5]]) AS missed,
  list_bool_or([(s+1e-9 < t) AND (t <= floor(s*100+0.5+1e-9)/100+1e-9) for t in [0.6,0.5]]) AS gate
 FROM (SELECT *, l_extendedprice/105000 AS s FROM lineitem))""")
def _(spark, d):
    s = F.col("l_extendedprice") / 105000
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.stored_share(s, [0.85, 0.7, 0.6, 0.5]).alias("stored"),
        N.format_share(s).alias("shown"))


@query("agg_02_bucketed_median", f"""SELECT l_returnflag, l_linestatus, {half_even("median(l_extendedprice)", 4)} AS median
 FROM lineitem, unnest(range(0, CASE WHEN l_linenumber <= 3 THEN 2 ELSE 1 END)) GROUP BY ALL""")
def _(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    w = F.when(F.col("l_linenumber") <= 3, 2).otherwise(1)
    med = weighted_median(li, ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), w)
    return med.withColumn("median", N.round_half_even(F.col("median"), 4))
