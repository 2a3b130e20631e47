"""Observations -> KPI scores -> sub-indices -> risk -> headline, for any number of runs in one plan.

Shuffles: one on (run, KPI, profile, value bucket) after a partial aggregation of the raw rows. The cells it gives are
written; the median ranks are found on a few of their columns first, and then cells and medians meet in one shuffle on
the run, after which everything stays where it is. Only the two middle values of a median that share their bucket with
other values are read a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.dims import constants as K
from siteready.dims.catalog import Catalog, default_catalog
from siteready.functions import numbers as N
from siteready.operators.quantiles import value_bucket
from siteready.operators.scan import stored

OVERALL = "overall"
VALUE = ["value_type", "value_num", "value_bool", "value_str"]
NUMERIC_MODES = ("sum", "max", "min", "mean", "median", "wmedian")


def enrich(obs: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Observations with their KPI's registry columns; unknown KPI ids are dropped."""
    registry = (catalog or default_catalog()).registry(obs.sparkSession).drop("unit", "producer")
    registry = registry.withColumnRenamed("value_type", "kpi_type").withColumnRenamed("stages", "kpi_stages")
    return obs.join(F.broadcast(registry), "kpi_id")


def score_points(df: DataFrame, catalog: Catalog | None = None, x: str = "x", out: str = "points_score") -> DataFrame:
    """Piecewise-linear score of column x through the KPI's anchor segments (clamped at both ends, not rounded)."""
    seg = (catalog or default_catalog()).segments(df.sparkSession).withColumnRenamed("kpi_id", "_k")
    on = (df["kpi_id"] == F.col("_k")) & (df[x] > F.col("x0")) & (df[x] <= F.col("x1"))
    joined = df.join(F.broadcast(seg), on, "left")
    flat = F.col("y0") == F.col("y1")
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return joined.withColumn(out, F.when(flat, F.col("y0")).otherwise(line)).drop("_k", "x0", "x1", "y0", "y1")


def score_map(df: DataFrame, catalog: Catalog | None = None, key: str = "map_key", out: str = "map_score") -> DataFrame:
    """Mapped score of column `key`; `mapped` tells a missing key from one that maps to null."""
    m = (catalog or default_catalog()).anchor_map(df.sparkSession).withColumn("mapped", F.lit(True))
    m = m.withColumnRenamed("kpi_id", "_k").withColumnRenamed("map_key", "_key").withColumnRenamed("map_score", out)
    joined = df.join(F.broadcast(m), (df["kpi_id"] == F.col("_k")) & (df[key] == F.col("_key")), "left")
    return joined.withColumn("mapped", F.coalesce("mapped", F.lit(False))).drop("_k", "_key")


def _anchor_scores(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds map_key, mapped and anchor_score for the value columns of df (has_points and has_map must be there)."""
    value = [F.col(c) for c in VALUE]
    # a number is written out as a key only where a map may hold it
    df = df.withColumn("map_key", F.when(F.col("has_map"), N.map_key(*value))).withColumn(
        "_px", F.when(F.col("has_points"), N.as_number(*value[:3])))
    df = score_map(score_points(df, catalog, "_px"), catalog)
    return df.withColumn("anchor_score", F.when(F.col("has_map"), F.col("map_score")).otherwise(
        F.col("points_score"))).drop("_px", "map_score", "points_score")


def _row_scores(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds anchor_score where a mode chooses a row by it: best compares it, first asks only whether there is one.

    Few KPIs do, so their maps are literals and no row meets a join; any number has a score on points."""
    value = [F.col(c) for c in VALUE]
    px = F.when(F.col("has_points"), N.as_number(*value[:3]))
    chosen = [k for k in catalog.kpis.values() if k.aggregate in ("first", "best")]
    scored = F.when(px.isNotNull(), F.lit(0.0))
    for k in chosen:
        if k.aggregate == "best" and k.points and not k.mapping:
            scored = F.when(F.col("kpi_id") == k.id, N.interpolate(px, k.points)).otherwise(scored)
    maps = [x for k in chosen if k.mapping for x in (F.lit(k.id), F.create_map(*[
        F.lit(v).cast(kind) for pair in dict(k.mapping).items() for v, kind in zip(pair, ("string", "double"))]))]
    if maps:
        scored = F.when(F.col("has_map"), F.create_map(*maps)[F.col("kpi_id")][N.map_key(*value)]).otherwise(scored)
    return rows.withColumn("anchor_score", F.when(F.col("aggregate_mode").isin("first", "best"), scored))


def prepare_rows(obs: DataFrame, catalog: Catalog) -> DataFrame:
    """Row facts every aggregate mode needs: usable, number, truth, rank, stage weight, median bucket."""
    for name, kind in (("evidence", "string"), ("page_id", "string"), ("source", "string"), ("stage", "string")):
        if name not in obs.columns:
            obs = obs.withColumn(name, F.lit(None).cast(kind))
    rows = _row_scores(enrich(obs, catalog), catalog)
    value = [F.col(c) for c in VALUE]
    is_conf = F.col("kpi_type") == "confidence"
    present = (F.when(F.col("value_type") == "number", F.col("value_num").isNotNull())
               .when(F.col("value_type") == "bool", F.col("value_bool").isNotNull())
               .otherwise(F.col("value_str").isNotNull()))
    rows = rows.withColumns({"usable": F.coalesce(F.col("assessed"), F.lit(True)) & F.coalesce(present, F.lit(False)),
                             "why": F.coalesce("reason", F.lit("not_assessable"))})
    weight = F.lit(1.0)
    for stage, w in catalog.stage_weights.items():
        weight = F.when(F.col("stage") == stage, F.lit(float(w))).otherwise(weight)
    rows = rows.withColumns({
        "x": F.when(F.col("usable"), N.as_number(*value[:3], is_conf)),
        "truth": F.when(F.col("usable"), F.coalesce(N.truthy(*value), F.lit(False))),
        "na": F.startswith("why", F.lit(K.NOT_APPLICABLE)),
        "w": F.when(F.col("aggregate_mode") == "wmedian", weight).otherwise(F.lit(1.0))})
    by_median = F.col("aggregate_mode").isin("wmedian", "median") & F.col("x").isNotNull()
    return rows.withColumn("bucket", F.when(by_median, value_bucket(F.col("x"))).otherwise(F.lit(0).cast("long")))


def _base(rows: DataFrame) -> DataFrame:
    """Mergeable state per (run, KPI, profile, bucket): the only aggregation over raw rows."""
    use = F.col("usable")
    value = F.struct(*VALUE, "source", F.col("reason").alias("why"))
    rank = F.coalesce(F.when(F.col("has_points") | F.col("has_map"), F.col("anchor_score")).otherwise(F.col("x")),
                      F.lit(float("-inf")))
    pick_first, pick_best = F.col("aggregate_mode") == "first", F.col("aggregate_mode") == "best"
    risk = F.col("owner") == K.RISK_INDEX
    judged_row = (F.col("source") == "judged") | (F.col("judged") | F.lit(False))
    # only what the aggregates read is sorted: most rows hold none of the structs
    told = rows.select(
        "run_id", "kpi_id", "profile", "bucket", "usable", "x", "truth", "ord", F.when(F.col("x").isNotNull(), F.col("w")).alias("w"),
        (use & (F.col("source") == "judged")).alias("judged_source"),
        (judged_row & (F.col("why") != "not_judged")).alias("asked_judgment"),
        ((F.col("scope") == "journey") & F.coalesce("assessed", F.lit(True))).alias("journey_row"),
        F.when(~use, F.struct("na", "ord", "why")).alias("worst_reason"),
        F.when(use & pick_first, F.struct(F.col("anchor_score").isNull().alias("unscored"), "ord", value.alias("v"))).alias("first_v"),
        F.when(use & pick_best, F.struct(rank.alias("rank"), (-F.col("ord")).alias("neg"), value.alias("v"))).alias("best_v"),
        F.when(use & risk, F.struct(F.coalesce("x", F.lit(0.0)).alias("x"), (-F.col("ord")).alias("neg"), "page_id",
                                    F.col("profile").alias("at_profile"), "evidence")).alias("strongest"))
    return told.groupBy("run_id", "kpi_id", "profile", "bucket").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(use).alias("n_usable"),
        F.count("x").alias("n_num"),
        F.sum("x").alias("sum_x"), F.max("x").alias("max_x"), F.min("x").alias("min_x"),
        F.sum("w").alias("w"),
        F.max("truth").alias("any_true"), F.min("truth").alias("all_true"),
        F.min("ord").alias("row_ord"), F.min(F.when(use, F.col("ord"))).alias("use_ord"),
        F.max("judged_source").alias("judged_source"), F.max("asked_judgment").alias("asked_judgment"),
        F.max("journey_row").alias("journey_row"), F.min("worst_reason").alias("worst_reason"),
        F.min("first_v").alias("first_v"), F.max("best_v").alias("best_v"), F.max("strongest").alias("strongest"))


def _merge_exprs(own: Column) -> list[Column]:
    """The same state merged over groups; own marks the rows that belong to the scope's own profile."""
    return [
        F.sum("n_rows").alias("n_rows"), F.sum("n_usable").alias("n_usable"), F.sum("n_num").alias("n_num"),
        F.sum("sum_x").alias("sum_x"), F.max("max_x").alias("max_x"), F.min("min_x").alias("min_x"),
        F.max("any_true").alias("any_true"), F.min("all_true").alias("all_true"),
        F.max("judged_source").alias("judged_source"), F.min("worst_reason").alias("worst_reason"),
        F.min("first_v").alias("first_v"), F.max("best_v").alias("best_v"), F.max("strongest").alias("strongest"),
        F.sum(F.when(own, F.col("n_rows")).otherwise(0)).alias("own_rows"),
        F.sum(F.when(own, F.col("n_usable")).otherwise(0)).alias("own_usable"),
        F.min(F.when(own, F.col("row_ord"))).alias("own_row_ord"),
        F.min(F.when(own, F.col("use_ord"))).alias("own_use_ord")]


def fan_out(base: DataFrame, profiles: str = "profiles", given: str | None = None) -> DataFrame:
    """Rows with a profile count for it and overall; rows without one count for every profile and overall.

    given: a column that names the one scope a row counts for, where it is not null."""
    everything = F.array_union(F.array(F.lit(OVERALL)), F.col(profiles))
    own = F.array(F.lit(OVERALL), F.col("profile"))
    scopes = F.when(F.col("profile").isNull(), everything).otherwise(own)
    if given is not None:
        scopes = F.when(F.col(given).isNotNull(), F.array(given)).otherwise(scopes)
    return base.withColumn("scope", F.explode(scopes))


def run_context(base: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Adds, per run: its profiles, the profiles that ran a journey, and whether judgments were requested.

    extra(run_id, profiles array, journey_profiles array, judged boolean) adds what pages and linked journeys say.
    """
    run = Window.partitionBy("run_id")
    journey = F.when(F.col("journey_row"), F.coalesce("profile", F.lit("")))
    out = (base.withColumn("profiles", F.collect_set("profile").over(run))
           .withColumn("journey_profiles", F.collect_set(journey).over(run))
           .withColumn("judged_run", F.max("asked_judgment").over(run)))
    if extra is None:
        return out
    more = extra.select("run_id", F.col("profiles").alias("_p"), F.col("journey_profiles").alias("_j"),
                        F.col("judged").alias("_g"))
    none = F.array().cast("array<string>")
    return (out.join(more, "run_id", "left")
            .withColumn("profiles", F.array_union("profiles", F.coalesce("_p", none)))
            .withColumn("journey_profiles", F.array_union("journey_profiles", F.coalesce("_j", none)))
            .withColumn("profiles", F.array_union("profiles", F.filter("journey_profiles", lambda p: p != "")))
            .withColumn("judged_run", F.col("judged_run") | F.coalesce("_g", F.lit(False))).drop("_p", "_j", "_g"))


def _ranked(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """The values that a median may have to read again: those of KPIs with a median."""
    ids = [k.id for k in catalog.kpis.values() if k.aggregate in ("wmedian", "median")]  # reaches the scan
    return rows.where(F.col("kpi_id").isin(*ids) & F.col("x").isNotNull()).select("run_id", "kpi_id", "bucket", "profile", "x", "w")


def partials(obs: DataFrame, catalog: Catalog | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, values): all that scores need of observations, in a form that merges with that of later observations.

    cells: counts, sums and extremes per (run, KPI, profile, bucket). values: the weight of each value of the KPIs that
    take a median. Both are bounded by the distinct values of a run, not by its rows.
    """
    catalog = catalog or default_catalog()
    rows = prepare_rows(obs, catalog)
    values = _ranked(rows, catalog).groupBy("run_id", "kpi_id", "bucket", "profile", "x").agg(F.sum("w").alias("w"))
    return _base(rows), values


_CELL_SUMS = ("n_rows", "n_usable", "n_num", "sum_x", "w")
_CELL_LEAST = ("min_x", "all_true", "row_ord", "use_ord", "worst_reason", "first_v")
_CELL_MOST = ("max_x", "any_true", "judged_source", "asked_judgment", "journey_row", "best_v", "strongest")


def merge_partials(cells: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and values of the same runs from several sets of observations, as those of all together."""
    kinds = ((F.sum, _CELL_SUMS), (F.min, _CELL_LEAST), (F.max, _CELL_MOST))
    merged = {n: how(n).alias(n) for how, names in kinds for n in names}
    keys = ["run_id", "kpi_id", "profile", "bucket"]
    one = cells.groupBy(*keys).agg(*[merged[n] for n in cells.columns if n not in keys])
    return one, values.groupBy("run_id", "kpi_id", "bucket", "profile", "x").agg(F.sum("w").alias("w"))


def _medians(cells: DataFrame, values: DataFrame, catalog: Catalog, extra: DataFrame | None) -> DataFrame:
    """run_id, kpi_id, scope, low_x, high_x: the values at the two half-way ranks; a scope's two may come as two rows."""
    ids = [k.id for k in catalog.kpis.values() if k.aggregate in ("wmedian", "median")]
    # what the runs' profiles are is said by all cells
    marks = cells.groupBy("run_id", "profile").agg(F.max("journey_row").alias("journey_row"), F.max("asked_judgment").alias("asked_judgment"))
    counted = cells.where(F.col("kpi_id").isin(*ids) & (F.col("n_num") > 0)).select("run_id", "kpi_id", "profile", "bucket", "w", "min_x", "max_x")
    base = run_context(counted.unionByName(marks, allowMissingColumns=True), extra).where("kpi_id is not null")
    spans = fan_out(base.select("run_id", "kpi_id", "profile", "bucket", "w", "min_x", "max_x", "profiles")).groupBy(
        "run_id", "kpi_id", "scope", "bucket").agg(F.sum("w").alias("w"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    part = Window.partitionBy("run_id", "kpi_id", "scope")
    spans = (spans.withColumn("_upto", F.sum("w").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_total", F.sum("w").over(part)).withColumn("_before", F.col("_upto") - F.col("w")))
    zero = F.col("bucket") == 0
    known = zero | (F.col("min_x") == F.col("max_x"))
    here = F.when(zero, F.lit(0.0)).otherwise(F.col("min_x"))

    def side(rank: Column) -> Column:
        at = (F.col("_before") < rank) & (rank <= F.col("_upto"))
        return F.when(at, F.struct(F.when(known, here).alias("x"), (rank - F.col("_before")).cast("long").alias("r")))

    spans = spans.withColumns({"low": side(F.floor((F.col("_total") + 1) / 2)), "high": side(F.floor(F.col("_total") / 2) + 1)})
    spans = spans.where("low is not null or high is not null").select("run_id", "kpi_id", "scope", "bucket", "low", "high")
    spans = stored(spans, "medians")  # read for the open ranks and again for the known values
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.when(F.col(f"{s}.x").isNull(), F.col(f"{s}.r")).alias("r")) for s in ("low", "high")])
    open_ranks = (spans.select("run_id", "kpi_id", "scope", "bucket", F.explode(sides).alias("_side"))
                  .select("run_id", "kpi_id", "scope", "bucket", "_side.side", "_side.r").where("r is not null"))
    read = spans.select("run_id", "kpi_id", "scope", F.col("low.x").alias("low_x"), F.col("high.x").alias("high_x"))
    return read.where("low_x is not null or high_x is not null").unionByName(_fetch_ranks(values, open_ranks))


def _grouped(cells: DataFrame, values: DataFrame, catalog: Catalog, extra: DataFrame | None) -> DataFrame:
    """One row per (run, scope, KPI) with merged state and the median, in the partitions of its run.

    cells are read three times: a table, not a plan. The KPI's mode is a key from here on, so that whoever asks for some
    modes only has their cells merged and no others."""
    medians = _medians(cells, values, catalog, extra).withColumnRenamed("scope", "_scope")
    base = run_context(cells.drop("bucket", "w").unionByName(medians, allowMissingColumns=True), extra)
    modes = catalog.registry(cells.sparkSession).select("kpi_id", "aggregate_mode")
    spread = fan_out(base.join(F.broadcast(modes), "kpi_id"), given="_scope")
    journey = F.when(F.col("scope") == OVERALL, F.size("journey_profiles") > 0).otherwise(
        F.array_contains("journey_profiles", F.col("scope")) | F.array_contains("journey_profiles", F.lit("")))
    spread = spread.withColumn("journey", journey).drop("profiles", "journey_profiles", "_scope")
    own = F.col("profile").eqNullSafe(F.col("scope"))
    grouped = spread.groupBy("run_id", "kpi_id", "aggregate_mode", "scope").agg(
        *_merge_exprs(own), F.max("low_x").alias("low_x"), F.max("high_x").alias("high_x"),
        F.first("journey").alias("journey"), F.first("judged_run").alias("judged_run"))
    # the first reason that is not "not applicable" sorts before all that are
    pending = F.when(~F.col("worst_reason.na"), F.struct("worst_reason.ord", "worst_reason.why"))
    return grouped.withColumns({"pending": pending, "median_x": (F.col("low_x") + F.col("high_x")) / 2}).drop("low_x", "high_x")


def _fetch_ranks(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """Reads the values of the wanted buckets only, and picks the value at the rank inside the bucket."""
    keys = ["run_id", "kpi_id", "scope", "side"]
    inside = (values.join(ranks, ["run_id", "kpi_id", "bucket"])
              .where((F.col("scope") == OVERALL) | F.col("profile").isNull() | (F.col("profile") == F.col("scope")))
              .groupBy(*keys, "x").agg(F.sum("w").alias("vw"), F.first("r").alias("r")))
    run = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hit = (inside.withColumn("cum", F.sum("vw").over(run))
           .where((F.col("cum") >= F.col("r")) & (F.col("cum") - F.col("vw") < F.col("r"))))
    return hit.select("run_id", "kpi_id", "scope", F.when(F.col("side") == "low", F.col("x")).alias("low_x"),
                      F.when(F.col("side") == "high", F.col("x")).alias("high_x"))


def _pooled(df: DataFrame) -> DataFrame:
    """The scope's value by aggregate mode, with the chosen row's source and reason for first and best."""
    mode = F.col("aggregate_mode")
    chosen = F.when(mode == "first", F.col("first_v.v")).when(mode == "best", F.col("best_v.v"))
    number = (F.when(mode == "sum", F.col("sum_x")).when(mode == "max", F.col("max_x"))
              .when(mode == "min", F.col("min_x")).when(mode == "mean", F.col("sum_x") / F.col("n_num"))
              .when(mode.isin("median", "wmedian"), F.col("median_x")))
    truth = F.when(mode == "any", F.col("any_true")).when(mode == "all", F.col("all_true"))
    numeric = mode.isin(*NUMERIC_MODES)
    boolean = mode.isin("any", "all")
    # the number and the chosen row become columns first: rounding repeats its argument
    return (df.withColumns({"_raw": number, "_c": chosen}).withColumns({
        "value_type": F.when(numeric & (F.col("n_num") > 0), F.lit("number")).when(boolean, F.lit("bool"))
        .otherwise(F.col("_c.value_type")),
        "value_num": F.when(numeric, N.tidy(F.col("_raw"))).otherwise(F.col("_c.value_num")),
        "value_bool": F.when(boolean, truth).otherwise(F.col("_c.value_bool")),
        "value_str": F.col("_c.value_str"), "chosen_source": F.col("_c.source"), "chosen_reason": F.col("_c.why")})
        .drop("_raw", "_c"))


def aggregate_kpis(obs: DataFrame, catalog: Catalog | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(run, scope, KPI) -> value, assessed, reason, worst profile: the aggregate of each KPI, before scoring.

    scope is "overall" or a profile. Overall takes the profile whose aggregate scores lowest (named only when it is
    strictly lowest); risk KPIs are pooled. A false any-KPI counts only where no page of it went unobserved.
    """
    catalog = catalog or default_catalog()
    rows = prepare_rows(obs, catalog)
    return aggregate_partials(stored(_base(rows), "cells"), _ranked(rows, catalog), catalog, extra)


def aggregate_partials(cells: DataFrame, values: DataFrame, catalog: Catalog | None = None, extra: DataFrame | None = None) -> DataFrame:
    """``aggregate_kpis`` from the cells and values of ``partials``; the cells are read several times, so store them."""
    catalog = catalog or default_catalog()
    registry = catalog.registry(cells.sparkSession).select(
        "kpi_id", "owner", F.col("scope").alias("kpi_scope"), F.col("value_type").alias("kpi_type"),
        "weight", "judged", "severity", "credit_unless", "has_points", "has_map")
    g = _grouped(cells, values, catalog, extra).join(F.broadcast(registry), "kpi_id")
    g = _anchor_scores(_pooled(g), catalog)
    any_mode = F.col("aggregate_mode") == "any"
    is_profile = F.col("scope") != OVERALL
    dropped = any_mode & (F.col("n_usable") > 0) & ~F.coalesce("any_true", F.lit(False)) & F.col("pending").isNotNull()
    g = g.withColumn("dropped", F.coalesce(dropped, F.lit(False)))
    w = Window.partitionBy("run_id", "kpi_id", "aggregate_mode")
    named = is_profile & (F.col("own_rows") > 0)
    # a profile without usable rows of its own can still be dropped: its group holds the rows without a profile
    own_dropped = named & any_mode & ~F.coalesce("any_true", F.lit(False)) & F.col("pending").isNotNull()
    candidate = (is_profile & (F.col("own_usable") > 0) & ~F.coalesce(own_dropped, F.lit(False))
                 & F.col("anchor_score").isNotNull())
    used = is_profile & (F.col("own_usable") > 0) & ~F.coalesce(own_dropped, F.lit(False))
    worst = F.min(F.when(F.col("_candidate"), F.struct("anchor_score", "own_use_ord", *VALUE, "chosen_source", "chosen_reason",
                                             F.col("scope").alias("at"), "mapped")))
    g = g.withColumns({"own_dropped": F.coalesce(own_dropped, F.lit(False)), "_candidate": candidate, "_is_used": used})
    g = g.withColumns({
        "_names": F.count_if(named).over(w),
        "_used": F.count_if("_is_used").over(w),
        "_worst": worst.over(w),
        "_scores": F.collect_list(F.when(F.col("_candidate"), F.col("anchor_score"))).over(w),
        "_dropped": F.count_if("own_dropped").over(w),
        "_own": F.sum(F.when(is_profile, F.col("own_usable"))).over(w),
        "_kept_own": F.sum(F.when(is_profile & ~F.col("own_dropped"), F.col("own_usable"))).over(w),
        "_first_pending": F.min(F.when(F.col("own_dropped"), F.struct(
            "own_row_ord", F.col("pending.why").alias("why")))).over(w)})

    overall = ~is_profile
    kept = F.col("n_usable") - F.coalesce("_own", F.lit(0)) + F.coalesce("_kept_own", F.lit(0))
    none_left = any_mode & (F.col("n_usable") > 0) & F.when(
        overall & (F.col("_names") > 0), (F.col("_dropped") == F.col("_names")) | (kept == 0)).otherwise(F.col("dropped"))
    g = g.withColumn("none_left", F.coalesce(none_left, F.lit(False)))
    split = overall & (F.col("owner") != K.RISK_INDEX) & (F.col("_used") > 1) & F.col("_worst").isNotNull()
    g = g.withColumns({"_split": F.coalesce(split, F.lit(False)), **{
        c: F.when(split, F.col(f"_worst.{c}")).otherwise(F.col(c))
        for c in (*VALUE, "chosen_source", "chosen_reason", "anchor_score", "mapped")}})
    # one score of each profile: the second is the lowest of all but the worst
    second = F.get(F.array_sort("_scores"), F.lit(1))
    strictly = F.col("_split") & (F.size("_scores") > 1) & (F.col("_worst.anchor_score") < second - K.TOLERANCE)
    valued = F.col("value_type").isNotNull()
    no_rows = F.col("n_usable") == 0
    assessed = ~no_rows & ~F.col("none_left") & valued
    pending = F.when(overall & (F.col("_names") > 0), F.col("_first_pending.why")).otherwise(F.col("pending.why"))
    reason = (F.when(no_rows, F.col("worst_reason.why")).when(F.col("none_left"), pending)
              .when(~valued, F.lit("invalid_value")))
    g = g.withColumns({"assessed": assessed, "reason": reason, "_strictly": strictly})
    kept_values = {c: F.when(F.col("assessed"), F.col(c)) for c in (*VALUE, "chosen_source", "chosen_reason", "anchor_score")}
    worst_profile = F.when(F.col("_strictly") & F.col("assessed"), F.col("_worst.at"))
    return g.withColumns({**kept_values, "worst_profile": worst_profile}).select(
        "run_id", "scope", "kpi_id", "owner", "kpi_scope", "aggregate_mode", "kpi_type", "weight", "judged", "severity",
        "credit_unless", "has_points", "has_map", *VALUE, "anchor_score", "mapped", "assessed", "reason",
        "worst_profile", "chosen_source", "chosen_reason", "n_rows", "n_usable", "judged_source", "strongest",
        "journey", "judged_run")


def kpi_scores(aggregated: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Final KPI rows: applicability, normalised score, withheld credit, clamped risk, source.

    KPIs a run has no row for are left out: ``all_kpis`` adds them, and the sub-index totals count them without.
    """
    catalog = catalog or default_catalog()
    df = aggregated
    risk = F.col("owner") == K.RISK_INDEX
    number = N.as_number(F.col("value_type"), F.col("value_num"), F.col("value_bool"), True)
    no_journey = (F.col("kpi_scope") == "journey") & ~F.col("journey")
    not_judged = F.col("judged") & ~F.col("judged_run")
    score = N.round_half_even(N.clamp(F.col("anchor_score"), 0.0, 100.0), 2)
    has_anchor = F.col("has_points") | F.col("has_map")
    to_none = F.col("assessed") & ~risk & F.col("has_map") & F.col("mapped") & F.col("anchor_score").isNull()
    unscored = F.col("assessed") & ~risk & has_anchor & F.col("anchor_score").isNull() & ~to_none
    df = (df.withColumn("_risk_value", F.when(risk & F.col("assessed"), N.tidy(N.clamp(number))))
          .withColumn("_signal", F.when(F.col("assessed"), number)).withColumn("normalized", F.when(~risk, score)))
    run = Window.partitionBy("run_id", "scope")
    fired = F.lit(False)
    for partner in sorted({k.credit_unless for k in catalog.kpis.values() if k.credit_unless}):
        signal = F.max(F.when(F.col("kpi_id") == partner, F.col("_signal"))).over(run)
        fired = fired | ((F.col("credit_unless") == partner) & (F.coalesce(signal, F.lit(0.0)) >= catalog.risk_fired))
    zero = {k.id: dict((x, y) for x, y in k.points).get(0.0, k.points[0][1]) for k in catalog.kpis.values()
            if k.credit_unless}
    at_zero = F.create_map(*[F.lit(v) for pair in zero.items() for v in pair])[F.col("kpi_id")]
    withheld = fired & F.col("assessed") & F.col("normalized").isNotNull()
    df = df.withColumn("withheld", F.coalesce(withheld, F.lit(False)))
    was = F.col("assessed")
    assessed = F.when(risk, was & F.col("_risk_value").isNotNull()).otherwise(was & ~to_none & ~unscored)
    shown = F.when(was & F.col("judged") & F.col("reason").isNull(), F.col("chosen_reason")).otherwise(F.col("reason"))
    reason = (F.when(to_none, F.lit(K.NOT_APPLICABLE)).when(unscored, F.lit("invalid_value"))
              .when(F.col("withheld"), F.concat(F.lit("credit_withheld:"), F.col("credit_unless"))).otherwise(shown))
    df = df.withColumn("_reason", reason).withColumn("_assessed", assessed)
    applicable = (~no_journey & ~not_judged & ~to_none
                  & ~(~F.col("_assessed") & F.coalesce(F.startswith("_reason", F.lit(K.NOT_APPLICABLE)), F.lit(False))))
    source = (F.when(was & F.col("chosen_source").isNotNull() & F.col("aggregate_mode").isin("first", "best"),
                     F.col("chosen_source") == "judged")
              .when(was & F.col("aggregate_mode").isin("first", "best"), F.lit(False))
              .otherwise(F.coalesce("judged_source", F.lit(False)) | ((F.col("n_usable") == 0) & F.col("judged"))))
    return df.select(
        "run_id", "scope", "kpi_id", "owner", "weight", "severity", "kpi_scope", "judged", "journey", "judged_run",
        F.when(risk, F.when(F.col("_risk_value").isNotNull(), F.lit("number"))).otherwise(F.col("value_type"))
        .alias("value_type"),
        F.when(risk, F.col("_risk_value")).otherwise(F.col("value_num")).alias("value_num"),
        F.when(~risk, F.col("value_bool")).alias("value_bool"), F.when(~risk, F.col("value_str")).alias("value_str"),
        F.when(F.col("_assessed"), F.col("worst_profile")).alias("profile"),
        F.when(F.col("_assessed"), F.when(F.col("withheld"), at_zero).otherwise(F.col("normalized")))
        .alias("normalized"),
        F.when(source, F.lit("judged")).otherwise(F.lit("deterministic")).alias("source"),
        F.col("_assessed").alias("assessed"), F.col("_reason").alias("reason"),
        F.col("n_rows").alias("observations"), applicable.alias("applicable"), "strongest")


def withhold(scores: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Credit withholding on stored KPI rows: a KPI scores as if absent when its paired risk KPI fired."""
    catalog = catalog or default_catalog()
    pairs = [(k.id, k.credit_unless, dict(k.points)[0.0]) for k in catalog.kpis.values() if k.credit_unless]
    dim = scores.sparkSession.createDataFrame(pairs, "kpi_id string, risk_id string, at_zero double")
    partners = [p[1] for p in pairs]
    fired = (scores.where(F.col("kpi_id").isin(*partners) & F.col("assessed")
                          & (F.col("value_num") >= catalog.risk_fired))
             .select("run_id", "scope", F.col("kpi_id").alias("risk_id"), F.lit(True).alias("fired")))
    joined = scores.join(F.broadcast(dim), "kpi_id", "left").join(fired, ["run_id", "scope", "risk_id"], "left")
    hit = F.coalesce("fired", F.lit(False)) & F.col("assessed") & F.col("normalized").isNotNull()
    return (joined.withColumn("reason", F.when(hit, F.concat(F.lit("credit_withheld:"), F.col("risk_id")))
                              .otherwise(F.col("reason")))
            .withColumn("normalized", F.when(hit, F.col("at_zero")).otherwise(F.col("normalized")))
            .drop("risk_id", "at_zero", "fired"))


def all_kpis(scores: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """KPI rows of every (run, scope), with the KPIs nobody observed as not-assessed rows."""
    catalog = catalog or default_catalog()
    scopes = scores.groupBy("run_id", "scope").agg(F.first("journey").alias("journey"),
                                                   F.first("judged_run").alias("judged_run"),
                                                   F.collect_set("kpi_id").alias("seen"))
    ids = F.array(*[F.lit(k) for k in catalog.kpis])
    missing = scopes.select("run_id", "scope", "journey", "judged_run",
                            F.explode(F.array_except(ids, F.col("seen"))).alias("kpi_id"))
    registry = catalog.registry(scores.sparkSession).select("kpi_id", "owner", "weight", "severity",
                                                            F.col("scope").alias("kpi_scope"), "judged")
    missing = missing.join(F.broadcast(registry), "kpi_id")
    no_journey = (F.col("kpi_scope") == "journey") & ~F.col("journey")
    not_judged = F.col("judged") & ~F.col("judged_run")
    missing = (missing.withColumn("assessed", F.lit(False)).withColumn("applicable", ~no_journey & ~not_judged)
               .withColumn("reason", F.when(not_judged, F.lit("not_judged")).when(no_journey, F.lit("no_journey"))
                           .otherwise(F.lit("no_observation")))
               .withColumn("observations", F.lit(0).cast("long"))
               .withColumn("source", F.when(F.col("judged"), F.lit("judged")).otherwise(F.lit("deterministic"))))
    return scores.unionByName(missing, allowMissingColumns=True)


def sub_indices(scores: DataFrame, catalog: Catalog | None = None, complete: bool = False,
                with_risk: bool = False) -> DataFrame:
    """(run, scope, owner) -> score, coverage, judged share, limiting KPIs; exact values beside the stored ones.

    Unless ``complete`` says that every KPI has a row, the weight of KPIs without a row is added from the registry.
    ``with_risk`` keeps the risk index as one more owner row, so that one aggregation feeds the whole headline.
    """
    catalog = catalog or default_catalog()
    wanted = (F.col("owner") != K.RISK_INDEX) & (F.col("weight") > 0)
    df = scores.where(wanted | (F.col("owner") == K.RISK_INDEX)) if with_risk else scores.where(wanted)
    fired = (F.col("owner") == K.RISK_INDEX) & F.col("assessed") & (F.coalesce("value_num", F.lit(0.0)) != 0.0)
    by_default = ~((F.col("kpi_scope") == "journey") & ~F.col("journey")) & ~(F.col("judged") & ~F.col("judged_run"))
    scored = F.col("applicable") & F.col("assessed") & F.col("normalized").isNotNull()
    limiting = F.when(scored & (F.col("normalized") < 100), F.struct("normalized", (-F.col("weight")).alias("neg"),
                                                                     "kpi_id"))
    g = df.groupBy("run_id", "scope", "owner").agg(
        F.sum(F.when(scored, F.col("weight"))).alias("assessed_weight"),
        F.sum(F.when(scored, F.col("weight") * F.col("normalized"))).alias("_points"),
        F.sum(F.when(scored & (F.col("source") == "judged"), F.col("weight")).otherwise(0.0)).alias("_judged"),
        F.sum(F.when(F.col("applicable"), F.col("weight")).otherwise(0.0)).alias("_applicable"),
        F.sum(F.when(by_default, F.col("weight")).otherwise(0.0)).alias("_default"),
        F.product(F.when(fired, F.lit(1.0) - N.clamp(F.col("severity") * F.col("value_num")))).alias("_keep"),
        F.first("journey").alias("journey"), F.first("judged_run").alias("judged_run"),
        F.slice(F.array_sort(F.collect_list(limiting)), 1, catalog.limiting).alias("_limiting"))
    if complete:
        total = F.col("_applicable")
    else:
        expected = F.lit(0.0)
        for owner in K.SUB_INDICES:
            members = [k for k in catalog.by_owner(owner) if k.weight > 0]
            plain = sum(k.weight for k in members if k.scope != "journey" and not k.judged)
            travel = sum(k.weight for k in members if k.scope == "journey")
            asked = sum(k.weight for k in members if k.judged)
            w = (F.lit(plain) + F.when(F.col("journey"), F.lit(travel)).otherwise(0.0)
                 + F.when(F.col("judged_run"), F.lit(asked)).otherwise(0.0))
            expected = F.when(F.col("owner") == owner, w).otherwise(expected)
        total = expected + F.col("_applicable") - F.col("_default")
    return finish_sub_indices(g.withColumn("total_weight", total), catalog)


def finish_sub_indices(g: DataFrame, catalog: Catalog) -> DataFrame:
    has = F.coalesce(F.col("assessed_weight") > 0, F.lit(False))
    exact = F.when(has, F.col("_points") / F.col("assessed_weight"))
    coverage = F.when(has, F.col("assessed_weight") / F.col("total_weight")).otherwise(F.lit(0.0))
    share = F.when(has, F.col("_judged") / F.col("assessed_weight")).otherwise(F.lit(0.0))
    thresholds = [*catalog.grades.values(), catalog.min_coverage, catalog.min_major_coverage]
    g = (g.withColumn("exact_score", exact).withColumn("exact_coverage", coverage).withColumn("exact_share", share))
    return g.select(
        "run_id", "scope", "owner", N.round_half_even(F.col("exact_score"), 1).alias("score"),
        N.stored_share(F.col("exact_coverage"), thresholds).alias("coverage"),
        F.when(has, N.grade(F.col("exact_coverage"), catalog.grades)).alias("grade"),
        N.three_decimals(F.col("exact_share")).alias("judged_share"),
        F.transform("_limiting", lambda s: s["kpi_id"]).alias("limiting_kpis"),
        "exact_score", "exact_coverage", "exact_share",
        F.when(F.col("owner") == K.RISK_INDEX, N.round_half_even(
            F.lit(100.0) * (F.lit(1.0) - F.coalesce("_keep", F.lit(1.0))), 2)).alias("risk_score"))


def noisy_or(severity: Column, confidence: Column) -> Column:
    """Aggregate: 0..100 risk of independent signals; a sure signal (severity x confidence = 1) gives exactly 100."""
    keep = F.product(F.lit(1.0) - N.clamp(severity * confidence))
    return N.round_half_even(F.lit(100.0) * (F.lit(1.0) - keep), 2)


def risk_summary(scores: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """(run, scope) -> risk score, its severity-weighted coverage, counts, and the risk KPIs not assessed."""
    catalog = catalog or default_catalog()
    df = scores.where(F.col("owner") == K.RISK_INDEX)
    fired = F.col("assessed") & (F.coalesce("value_num", F.lit(0.0)) != 0.0)
    on = F.col("applicable") & F.col("assessed")
    by_default = ~(F.col("judged") & ~F.col("judged_run"))
    g = df.groupBy("run_id", "scope").agg(
        F.product(F.when(fired, F.lit(1.0) - N.clamp(F.col("severity") * F.col("value_num")))).alias("_keep"),
        F.sum(F.when(on, F.col("severity")).otherwise(0.0)).alias("_covered"),
        F.sum(F.when(F.col("applicable"), F.col("severity")).otherwise(0.0)).alias("_total"),
        F.sum(F.when(by_default, F.col("severity")).otherwise(0.0)).alias("_default"),
        F.count_if(on).alias("assessed"), F.count_if("applicable").alias("_applicable"),
        F.count_if(by_default).alias("_default_n"), F.first("judged_run").alias("judged_run"),
        F.array_sort(F.collect_list(F.when(F.col("applicable") & ~F.col("assessed"), F.struct(
            "kpi_id", F.coalesce("reason", F.lit("no_observation")).alias("reason"))))).alias("unassessed"))
    risks = catalog.by_owner(K.RISK_INDEX)
    plain, asked = [k for k in risks if not k.judged], [k for k in risks if k.judged]
    expected = F.lit(sum(k.severity for k in plain)) + F.when(
        F.col("judged_run"), F.lit(float(sum(k.severity for k in asked)))).otherwise(0.0)
    expected_n = F.lit(len(plain)) + F.when(F.col("judged_run"), F.lit(len(asked))).otherwise(0)
    total = expected + F.col("_total") - F.col("_default")
    return g.select(
        "run_id", "scope",
        N.round_half_even(F.lit(100.0) * (F.lit(1.0) - F.coalesce("_keep", F.lit(1.0))), 2).alias("risk_score"),
        F.when(total > 0, N.three_decimals(F.col("_covered") / total)).otherwise(0.0).alias("risk_coverage"),
        "assessed", (expected_n + F.col("_applicable") - F.col("_default_n")).alias("applicable"), "unassessed")


def risk_signals(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Fired risk KPIs with severity x confidence and the strongest observation behind each, ranked per scope."""
    fired = scores.where((F.col("owner") == K.RISK_INDEX) & F.col("assessed") & (F.col("value_num") != 0.0))
    fired = fired.select("run_id", "scope", "kpi_id", "severity", F.col("value_num").alias("confidence"), "source",
                         N.round_half_even(F.col("severity") * F.col("value_num"), 4).alias("risk"),
                         F.col("strongest.page_id").alias("page_id"), F.col("strongest.at_profile").alias("profile"),
                         F.col("strongest.evidence").alias("evidence"))
    rank = F.row_number().over(Window.partitionBy("run_id", "scope").orderBy(F.desc("risk"), "kpi_id"))
    fired = fired.withColumn("rank", rank)
    return fired if top is None else fired.where(F.col("rank") <= top)


def check_links(links: DataFrame, runs: DataFrame) -> DataFrame:
    """Links with the journey's profile, an error when it cannot be merged, and a warning when its host is another.

    links: run_id, journey_run_id, pos (from 1, the given order). runs: run_id, kind (audit|journey), host, profile.
    Errors: not_a_journey (also for a run that is unknown), scored_run_itself. A journey that is listed twice counts at
    its first place.
    """
    links = links.groupBy("run_id", "journey_run_id").agg(F.min("pos").alias("pos"))
    journeys = runs.select(F.col("run_id").alias("journey_run_id"), F.col("kind").alias("_kind"), F.col("host").alias("_host"), "profile")
    own = runs.select("run_id", F.col("host").alias("_own"))
    joined = links.join(journeys, "journey_run_id", "left").join(own, "run_id", "left")
    error = (F.when(F.col("run_id") == F.col("journey_run_id"), F.lit("scored_run_itself"))
             .when(~F.col("_kind").eqNullSafe(F.lit("journey")), F.lit("not_a_journey")))
    return joined.withColumn("error", error).select(
        "run_id", "journey_run_id", "pos", "profile", "error",
        F.when(F.col("error").isNull() & ~F.col("_host").eqNullSafe(F.col("_own")), F.lit("another_host")).alias("warning"))


def link_journeys(obs: DataFrame, checked: DataFrame, catalog: Catalog | None = None, stride: int | None = None) -> DataFrame:
    """Observations of every run, followed by the journey-scope rows of the journeys linked to it without an error.

    A linked row takes the journey's profile where it has none of its own. Rows keep their order within a run and come
    after the run's own rows in link order: a row's ord grows by stride for each place, as a rule one more than the
    greatest ord there is. checked comes from ``check_links``.
    """
    catalog = catalog or default_catalog()
    top = obs.agg(F.coalesce(F.max("ord") + 1, F.lit(1)) if stride is None else F.lit(stride)).toDF("_stride").withColumn("_one", F.lit(0))
    ids = [k.id for k in catalog.kpis.values() if k.scope == "journey"]
    links = checked.where("error is null").select(
        F.col("run_id").alias("_to"), F.col("journey_run_id").alias("run_id"), "pos", F.col("profile").alias("_profile"))
    linked = obs.where(F.col("kpi_id").isin(*ids)).join(links, "run_id")
    linked = linked.withColumn("_one", F.lit(0)).join(F.broadcast(top), "_one")  # one row
    linked = linked.withColumns({"run_id": F.col("_to"), "profile": F.coalesce("profile", "_profile"),
                                 "ord": F.col("ord") + F.col("pos") * F.col("_stride")})
    return obs.unionByName(linked.select(*obs.columns))


def journey_context(checked: DataFrame) -> DataFrame:
    """What linked journeys say about a run even without rows: the ``extra`` of ``score_runs``."""
    none = F.array().cast("array<string>")
    return checked.where("error is null").groupBy("run_id").agg(
        F.collect_set(F.coalesce("profile", F.lit(""))).alias("journey_profiles")).select(
        "run_id", none.alias("profiles"), "journey_profiles", F.lit(False).alias("judged"))


def score_runs(obs: DataFrame, catalog: Catalog | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Observations to headline: raw rows are aggregated once to cells, cells once to KPI values, and both are written
    to the shared folder; all after that reads a few rows for each run and KPI."""
    catalog = catalog or default_catalog()
    rows = prepare_rows(obs, catalog)
    return score_partials(stored(_base(rows), "cells"), _ranked(rows, catalog), catalog, extra)


def score_partials(cells: DataFrame, values: DataFrame, catalog: Catalog | None = None, extra: DataFrame | None = None) -> DataFrame:
    """``score_runs`` from the cells and values of ``partials``."""
    catalog = catalog or default_catalog()
    aggregated = stored(aggregate_partials(cells, values, catalog, extra), "kpis")
    return headline(sub_indices(kpi_scores(aggregated, catalog), catalog, with_risk=True), None, catalog)


def headline(sub: DataFrame, risk: DataFrame | None, catalog: Catalog | None = None) -> DataFrame:
    """(run, scope) -> published score: weighted geometric mean with a floor, a risk penalty and coverage gates.

    risk(run_id, scope, risk_score) may be left out when ``sub`` carries the risk index as an owner row.
    """
    catalog = catalog or default_catalog()
    owner = F.col("owner")
    weights = F.create_map(*[F.lit(v) for pair in catalog.index_weights.items() for v in pair])[owner]
    total = float(sum(catalog.index_weights.values()))
    majors = [o for o in K.SUB_INDICES if catalog.index_weights.get(o, 0) >= catalog.major_weight]
    df = sub if risk is None else sub.where(owner.isin(*catalog.index_weights))
    df = df.withColumn("_w", weights)
    own_risk = F.max("risk_score") if risk is None else F.lit(None).cast("double")
    has = F.col("exact_score").isNotNull() & F.col("_w").isNotNull()
    ok_major = owner.isin(*majors) & (F.col("exact_coverage") + K.TOLERANCE >= catalog.min_major_coverage)
    g = df.groupBy("run_id", "scope").agg(
        F.sum(F.col("_w") * F.col("exact_coverage")).alias("_evidence"),
        F.sum(F.col("_w") * F.col("exact_coverage") * F.col("exact_share")).alias("_judged"),
        F.sum(F.when(has, F.col("_w") * F.log(F.greatest("exact_score", F.lit(catalog.floor))))).alias("_log"),
        F.sum(F.when(has, F.col("_w"))).alias("_present"),
        F.array_sort(F.collect_set(F.when(ok_major, owner))).alias("_ok"),
        F.min(F.when(has, F.struct("exact_score", "owner"))).alias("_limiting"), own_risk.alias("_risk"))
    if risk is None:
        g = g.withColumnRenamed("_risk", "risk_score")
    else:
        g = g.drop("_risk").join(risk.select("run_id", "scope", "risk_score"), ["run_id", "scope"], "left")
    coverage = F.coalesce("_evidence", F.lit(0.0)) / total
    share = F.when(F.col("_evidence") > 0, F.col("_judged") / F.col("_evidence")).otherwise(0.0)
    short = F.array_except(F.array(*[F.lit(o) for o in majors]), F.col("_ok"))
    reason = F.array_compact(F.array(
        F.when(F.col("_present").isNull(), F.lit("no_index_assessed")),
        F.when(coverage + K.TOLERANCE < catalog.min_coverage, F.lit("coverage_below_minimum")),
        F.when(F.size(short) > 0, F.concat(F.lit("major_coverage_below_minimum:"), F.array_join(short, ",")))))
    thresholds = [*catalog.grades.values(), catalog.min_coverage, catalog.min_major_coverage]
    value = F.exp(F.col("_log") / F.col("_present")) * (
        F.lit(1.0) - F.lit(catalog.risk_penalty) * F.coalesce("risk_score", F.lit(0.0)) / 100)
    g = g.withColumn("_cov", coverage).withColumn("_share", share).withColumn("_reasons", reason)
    published = F.size("_reasons") == 0
    return g.select(
        "run_id", "scope", F.when(published, N.round_half_even(value, 1)).alias("score"), published.alias("published"),
        F.when(published, N.grade(F.col("_cov"), catalog.grades)).alias("grade"),
        N.stored_share(F.col("_cov"), thresholds).alias("coverage"),
        N.three_decimals(F.col("_share")).alias("judged_share"),
        F.when(~published, F.array_join("_reasons", "; ")).alias("reason"),
        F.col("_limiting.owner").alias("limiting_factor"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"))
