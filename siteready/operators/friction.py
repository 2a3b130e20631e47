"""Step logs -> friction: dedup, visits, rage, backtracks and the twelve friction KPIs of a journey.

Everything per run is one grouped aggregation; the three order-dependent parts (last-write-wins, consecutive visits,
rage runs) use chunked scans, so one very long run is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteready.dims import constants as K
from siteready.dims.catalog import Catalog, default_catalog
from siteready.functions import friction as P
from siteready.functions.numbers import round_half_even
from siteready.functions.urls import page_key
from siteready.operators.scan import with_previous


def dedup_steps(raw: DataFrame) -> DataFrame:
    """One row per (run, step): the last complete line's content at the first line's place.

    Rows without a step number are all kept. An aggregation, not a window: lines of one step combine before the
    shuffle.
    """
    content = [c for c in raw.columns if c not in ("run_id", "step", "line_no")]
    numbered = (raw.where("step is not null").groupBy("run_id", "step")
                .agg(F.max_by(F.struct(*content), "line_no").alias("_last"), F.min("line_no").alias("line_no"))
                .select("run_id", "step", "line_no", *[F.col("_last")[c].alias(c) for c in content]))
    return numbered.unionByName(raw.where("step is null").select("run_id", "step", "line_no", *content))


def visits(steps: DataFrame) -> DataFrame:
    """(run_id, ord, page): pages before and after each executed step or navigation, consecutive repeats collapsed."""
    seen = steps.where(P.executed() | P.between_steps()).select(
        "run_id", F.posexplode(F.array("url_before", "url_after")).alias("_i", "_url"), F.col("ord").alias("_ord"))
    pages = seen.select("run_id", (F.col("_ord") * 2 + F.col("_i")).alias("ord"), page_key(F.col("_url")).alias("page"))
    pages = with_previous(pages.where("page is not null"), ["run_id"], "ord", ["page"], 1)
    return pages.where(~F.col("prev1.page").eqNullSafe(F.col("page"))).select("run_id", "ord", "page")


def backtracks(visited: DataFrame) -> DataFrame:
    """Visits with a flag: the page was already visited earlier in the run."""
    first = visited.groupBy("run_id", "page").agg(F.min("ord").alias("_first"))
    return (visited.join(first, ["run_id", "page"])
            .select("run_id", "ord", "page", (F.col("ord") > F.col("_first")).alias("backtrack")))


def rage(steps: DataFrame) -> DataFrame:
    """(run_id, ord, rage, rage_start): third or later consecutive interaction without effect on the same node.

    WAIT and steps never executed are neutral. A rage run starts at its third step.
    """
    acting = steps.where(P.executed() & (F.col("operation") != "WAIT")).select(
        "run_id", "ord", F.when(P.interaction() & P.no_effect(), F.col("node")).alias("dead_node"))
    n = K.RAGE_RUN
    rows = with_previous(acting, ["run_id"], "ord", ["dead_node"], n)
    same = F.col("dead_node").isNotNull()
    for k in range(1, n):
        same = same & F.coalesce(F.col(f"prev{k}.dead_node") == F.col("dead_node"), F.lit(False))
    longer = F.coalesce(F.col(f"prev{n}.dead_node") == F.col("dead_node"), F.lit(False))
    return rows.select("run_id", "ord", same.alias("rage"), (same & ~longer).alias("rage_start"))


def lostness(n, s, r):
    """sqrt((N/S - 1)^2 + (R/N - 1)^2) with R capped at N and the result at 1, to three decimals."""
    r = F.least(r, n)
    raw = F.sqrt(F.pow(n / s - 1, F.lit(2.0)) + F.pow(r / n - 1, F.lit(2.0)))
    return round_half_even(F.least(raw, F.lit(1.0)), 3)


def step_summary(steps: DataFrame) -> DataFrame:
    """One row of conditional aggregates per run: everything the KPIs need that does not depend on order."""
    s = steps.select(
        "run_id", P.executed().alias("done"), P.interaction().alias("act"), P.measured().alias("meas"),
        P.effect().alias("eff"), P.countable_click().alias("click"), P.new_document().alias("newdoc"),
        P.visible_response().alias("resp"), P.unexpected_nav().alias("unexp"), P.between_steps().alias("between"),
        P.request_inclusive().alias("incl"), "operation", "shifts_post_input", "event_timing_max_ms", "execution_ms",
        "settle_ms", "settle_reason", "decision_latency_ms", F.coalesce("new_tab", F.lit(False)).alias("tab"),
        F.coalesce("external_nav", F.lit(False)).alias("ext"))
    seen = F.col("act") & F.col("meas")
    timed = seen & F.col("operation").isin(*K.TRUSTED_INPUT) & ~F.col("newdoc")
    indoc = seen & ~F.col("newdoc")
    shift = F.coalesce("shifts_post_input", F.lit(0.0))
    site = F.coalesce("execution_ms", F.lit(0.0)) + F.coalesce("settle_ms", F.lit(0.0))
    moved_unexp = (F.col("done") | F.col("between")) & F.col("unexp")
    return s.groupBy("run_id").agg(
        F.count_if("done").alias("done"), F.count_if("act").alias("acts"), F.count_if(seen).alias("seen"),
        F.sum(F.when(seen, shift)).alias("shifts"), F.max(F.when(seen, shift)).alias("max_shift"),
        F.count_if(timed).alias("timed"), F.max(F.when(timed, F.col("event_timing_max_ms"))).alias("longest"),
        F.count_if(indoc).alias("indoc"), F.count_if(indoc & F.col("resp").isNotNull()).alias("answered"),
        F.count_if(indoc & F.col("resp").isNotNull() & F.col("incl")).alias("request_inclusive"),
        F.sum(F.when(F.col("done"), site)).alias("site_ms"),
        F.sum(F.coalesce("decision_latency_ms", F.lit(0.0))).alias("decision_ms"),
        F.count_if(F.col("done") & F.col("settle_ms").isNull()).alias("unsettled"),
        F.count_if(F.col("done") & (F.col("settle_reason") == "timeout")).alias("settle_timeouts"),
        F.count_if("click").alias("every_click"), F.count_if(F.col("click") & F.col("eff").isNotNull()).alias("clicks"),
        F.count_if(F.col("click") & F.col("eff").eqNullSafe(F.lit(False))).alias("dead"),
        F.count_if(F.col("act") & F.col("eff").isNotNull()).alias("judged"),
        F.count_if("between").alias("moved"), F.count_if(moved_unexp).alias("unexpected"),
        F.count_if(moved_unexp & F.col("tab")).alias("new_tabs"),
        F.count_if(F.col("done") & F.col("operation").isin("CLICK", "SELECT") & F.col("ext") & ~F.col("unexp"))
        .alias("chosen_external"))


def response_rows(steps: DataFrame) -> DataFrame:
    """(run_id, response_ms) of in-document interactions that had a visible response."""
    return (steps.where(P.interaction() & P.measured() & ~P.new_document())
            .select("run_id", P.visible_response().alias("response_ms")).where("response_ms is not null"))


def metrics(steps: DataFrame, journeys: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """The twelve friction observations of every journey, each with its value or the reason it has none.

    journeys: run_id, profile, success (null: not verified), unverified (its reason), optimal_steps, optimal_pages.
    """
    from siteready.operators.quantiles import weighted_median

    summary = step_summary(steps)
    response = weighted_median(response_rows(steps), ["run_id"], F.col("response_ms"), 1, "response_ms")
    rages = rage(steps).groupBy("run_id").agg(F.count_if("rage_start").alias("rage_events"))
    path = (visits(steps).groupBy("run_id", "page").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("run_id").agg(F.sum("_n").alias("visits"), F.count(F.lit(1)).alias("unique_pages")))
    j = journeys.join(summary, "run_id", "left").join(response, "run_id", "left").join(rages, "run_id", "left").join(
        path, "run_id", "left")
    return observations(j, catalog)


_COUNTS = ("done", "acts", "seen", "timed", "indoc", "answered", "request_inclusive", "unsettled", "settle_timeouts", "every_click", "clicks", "dead", "judged", "moved",
           "unexpected", "new_tabs", "chosen_external", "rage_events", "visits", "unique_pages")


def observations(summaries: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """The twelve friction observations from one summary row per journey, whether a batch or a stream made it.

    summaries: the columns of journeys (see ``metrics``) and of ``step_summary``, rage_events, visits, unique_pages,
    response_ms; a journey without steps has nulls.
    """
    catalog = catalog or default_catalog()
    j = summaries.na.fill(0, [c for c in _COUNTS if c in summaries.columns])
    acts, seen, has_visits = F.col("acts") > 0, F.col("seen") > 0, F.col("visits") > 0
    none_executed = F.lit("not_applicable:no_action_executed")
    untried = F.when(acts, F.lit("no_measurement")).otherwise(F.lit("not_applicable:no_interaction"))
    goal = (F.when(F.col("success").eqNullSafe(F.lit(True)), F.lit(None))
            .when(F.col("success").isNull(), F.coalesce("unverified", F.lit("no_verification")))
            .otherwise(F.lit("not_applicable:goal_not_reached")))
    reached = goal.isNull()
    longest = F.greatest(F.coalesce("longest", F.lit(0.0)), F.lit(K.EVENT_TIMING_THRESHOLD_MS))
    below = F.coalesce("longest", F.lit(0.0)) < K.EVENT_TIMING_THRESHOLD_MS
    answered = F.col("answered") > 0
    num = {
        "PERF.CLS_POST_INPUT": (F.when(seen, round_half_even(F.col("shifts"), 4)), F.when(~seen, untried)),
        "PERF.INP_SYNTH": (
            F.when(F.col("timed") > 0, round_half_even(longest, 1)),
            F.when(F.col("timed") > 0, F.when(below, F.lit("upper_bound:below_threshold")))
            .when(seen, F.lit("not_applicable:no_timed_interaction")).otherwise(untried)),
        "PERF.ACTION_RESPONSE_MS": (
            F.when(answered, round_half_even(F.col("response_ms"), 1)),
            F.when(answered, F.lit(None)).when(F.col("indoc") > 0, F.lit("not_applicable:no_visible_response"))
            .when(seen, F.lit("not_applicable:no_interaction_in_document")).otherwise(untried)),
        "FAI.ACTIONS_TO_GOAL": (F.when(reached, F.col("acts").cast("double")), goal),
        "FAI.ACTIONS_RATIO": (
            F.when(reached & (F.col("optimal_steps") >= 1), round_half_even(F.col("acts") / F.col("optimal_steps"), 2)),
            F.coalesce(goal, F.when(F.coalesce(F.col("optimal_steps") >= 1, F.lit(False)), F.lit(None))
                       .otherwise(F.lit("not_applicable:minimum_steps_unknown")))),
        "FAI.TIME_ON_TASK_SITE": (F.when(reached, round_half_even(F.coalesce("site_ms", F.lit(0.0)), 0)), goal),
        "FAI.DEAD_CLICK_RATE": (
            F.when(F.col("clicks") > 0, round_half_even(F.lit(100.0) * F.col("dead") / F.col("clicks"), 1)),
            F.when(F.col("clicks") > 0, F.lit(None)).when(F.col("every_click") > 0, F.lit("no_measurement"))
            .otherwise(F.lit("not_applicable:no_click"))),
        "FAI.RAGE_EVENTS": (F.when(F.col("judged") > 0, F.col("rage_events").cast("double")),
                            F.when(F.col("judged") == 0, untried)),
        "FAI.BACKTRACK_RATE": (
            F.when(has_visits, round_half_even(F.lit(100.0) * (F.col("visits") - F.col("unique_pages")) / F.col("visits"), 1)),
            F.when(~has_visits, none_executed)),
        "FAI.LOSTNESS": (
            F.when(reached & has_visits & (F.col("optimal_pages") >= 1),
                   lostness(F.col("unique_pages"), F.col("visits"), F.col("optimal_pages"))),
            F.coalesce(goal, F.when(~has_visits, none_executed)
                       .when(F.coalesce(F.col("optimal_pages") >= 1, F.lit(False)), F.lit(None))
                       .otherwise(F.lit("not_applicable:minimum_pages_unknown")))),
        "FAI.UNEXPECTED_NAV": (F.when((F.col("done") > 0) | (F.col("moved") > 0), F.col("unexpected").cast("double")),
                               F.when((F.col("done") == 0) & (F.col("moved") == 0), none_executed)),
    }
    # values become plain columns first: a generator does not share common subexpressions, a projection does
    ids = list(num)
    j = j.select("run_id", "profile", "success", "unverified",
                 *[num[k][0].cast("double").alias(f"_v{i}") for i, k in enumerate(ids)],
                 *[num[k][1].cast("string").alias(f"_r{i}") for i, k in enumerate(ids)])
    text = F.lit(None).cast("string")
    rows = []
    for i, k in enumerate(catalog.by_producer("friction")):
        if k.id == "FAI.JOURNEY_SUCCESS":
            value, flag, reason = F.lit(None).cast("double"), F.col("success"), F.when(
                F.col("success").isNull(), F.coalesce("unverified", F.lit("no_verification")))
        else:
            at = ids.index(k.id)
            value, reason, flag = F.col(f"_v{at}"), F.col(f"_r{at}"), F.lit(None).cast("boolean")
        rows.append(F.struct(
            F.lit(k.id).alias("kpi_id"), F.lit(i).alias("ord"), F.lit(k.unit).alias("unit"),
            F.when(value.isNotNull(), F.lit("number")).when(flag.isNotNull(), F.lit("bool")).alias("value_type"),
            value.alias("value_num"), flag.alias("value_bool"), text.alias("value_str"),
            (value.isNotNull() | flag.isNotNull()).alias("assessed"), reason.alias("reason")))
    out = j.select("run_id", "profile", F.explode(F.array(*rows)).alias("_o"))
    fields = ("kpi_id", "ord", "unit", "value_type", "value_num", "value_bool", "value_str", "assessed", "reason")
    return out.select("run_id", "profile", *[F.col("_o")[c].alias(c) for c in fields],
                      F.lit("deterministic").alias("source"), text.alias("page_id"), text.alias("stage"))
