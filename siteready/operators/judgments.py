"""Snippets -> tasks -> verdicts -> majority labels -> observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.dims import constants as K
from siteready.dims import catalog as C
from siteready.functions import text as T
from siteready.functions.numbers import round_half_even
from siteready.operators.scan import follow, stored, with_running


def select_snippets(snippets: DataFrame, kinds: DataFrame, limit: int = K.MAX_SNIPPETS) -> DataFrame:
    """Up to `limit` snippets per (run, page, rubric): decisive kinds first, equal texts once, listed in page order.

    Equal texts fall to one row by aggregation; the ranking window keeps only `limit` rows per group before the
    shuffle.
    """
    s = snippets.join(F.broadcast(kinds), "kind")
    s = s.withColumn("text", F.trim(F.substring(T.squash(F.col("text")), 1, K.MAX_SNIPPET_CHARS))).where("text != ''")
    s = s.withColumn("norm", T.fold(F.col("text")))
    key = ["run_id", "page_id", "rubric_id", "norm"]
    first = s.groupBy(*key).agg(F.min(F.struct("kind_pri", "pos", "kind", "text")).alias("_s")).select(
        *key, *[F.col("_s")[c].alias(c) for c in ("kind_pri", "pos", "kind", "text")])
    rank = F.row_number().over(Window.partitionBy("run_id", "page_id", "rubric_id").orderBy("kind_pri", "pos"))
    return first.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def make_tasks(selected: DataFrame, pages: DataFrame, rubrics: DataFrame) -> DataFrame:
    """One task per rubric and distinct snippet set of a run; equal sets on several pages share it.

    pages: run_id, page_id, page_ord, profile, stage. The first page names the task; `pages` lists all it covers, in
    page order. Snippet lists hold at most eight rows; page lists are the pages of one run with one text.
    """
    sets = selected.groupBy("run_id", "rubric_id", "page_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "norm"))).alias("snippets"))
    sets = sets.withColumn("set_key", F.sha2(F.to_json(F.transform("snippets", lambda s: s["norm"])), 256))
    placed = sets.join(pages.select("run_id", "page_id", "page_ord", "profile", "stage"), ["run_id", "page_id"])
    dim = rubrics.select("rubric_id", "kpi_id", "rubric_version", F.col("stages").alias("_st"))
    placed = placed.join(F.broadcast(dim), "rubric_id").where(
        (F.size("_st") == 0) | F.expr("array_contains(_st, stage)"))
    return (placed.groupBy("run_id", "rubric_id", "kpi_id", "rubric_version", "set_key")
            .agg(F.min(F.struct("page_ord", "page_id", "profile", "stage", "snippets")).alias("_head"),
                 F.array_sort(F.collect_list(F.struct("page_ord", "page_id", "profile", "stage"))).alias("pages"))
            .select("run_id", "rubric_id", "kpi_id", "rubric_version", "set_key", "pages",
                    F.concat_ws(":", "rubric_id", F.col("_head.page_id").cast("string")).alias("task_id"),
                    *[F.col("_head")[c].alias(c) for c in ("page_id", "page_ord", "profile", "stage", "snippets")]))


def judge_view_key(task_view: Column, model: Column, prompt: Column | str = "host") -> Column:
    """Content key of a judge-visible task: any change of model, prompt or view misses the cache."""
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.sha2(F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), task_view.alias("view"))), 256)


def cache_samples(samples: DataFrame, keep_best: Column | bool = False) -> DataFrame:
    """One stored sample per (cache_key, judge_id): the first by arrival, or the most confident in such a namespace."""
    best = F.lit(keep_best) if isinstance(keep_best, bool) else keep_best
    rank = F.struct(F.when(best, -F.col("confidence")).otherwise(0.0).alias("r"), F.col("arrival").alias("a"))
    rest = [c for c in samples.columns if c not in ("cache_key", "judge_id")]
    return (samples.groupBy("cache_key", "judge_id").agg(F.min_by(F.struct(*rest), rank).alias("_s"))
            .select("cache_key", "judge_id", *[F.col("_s")[c].alias(c) for c in rest]))


def apply_cache(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored samples for every task with the same content key."""
    return tasks.select("run_id", "task_id", "cache_key").join(cache, "cache_key")


def check_verdicts(verdicts: DataFrame, tasks: DataFrame, snippets: DataFrame, evidence: DataFrame,
                   no_quote: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts with `problem`: the first reason that refuses them, or null.

    evidence: verdict_id, item, snippet_id, quote (exploded). snippets: run_id, task_id, snippet_id, text. Quotes must
    stand in their snippet, whatever their letter case and Unicode form.
    """
    known = tasks.select("run_id", "task_id", "labels", F.lit(True).alias("known"))
    v = verdicts.join(known, ["run_id", "task_id"], "left")
    e = (evidence.join(verdicts.select("verdict_id", "run_id", "task_id"), "verdict_id")
         .join(snippets.select("run_id", "task_id", "snippet_id", F.col("text").alias("_t")),
               ["run_id", "task_id", "snippet_id"], "left"))
    quote, text = T.fold(T.nfc(F.col("quote"))), T.fold(T.nfc(F.col("_t")))
    bad = (F.when(F.col("_t").isNull(), F.lit("unknown_snippet"))
           .when(F.coalesce(quote == "", F.lit(True)), F.lit("empty_quote"))
           .when(~F.contains(text, quote), F.lit("quote_not_verbatim"))
           .when(F.length(quote) < F.least(F.lit(K.MIN_QUOTE_CHARS), F.length(text)), F.lit("quote_too_short")))
    first_bad = e.withColumn("_bad", bad).groupBy("verdict_id").agg(
        F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("item"))).alias("_quote_problem"),
        F.count(F.lit(1)).alias("_quotes"))
    v = v.join(first_bad, "verdict_id", "left")
    problem = (F.when(F.col("known").isNull(), F.lit("unknown_task"))
               .when(~F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False)), F.lit("unknown_label"))
               .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), F.lit("invalid_confidence"))
               .when(F.col("_quote_problem").isNotNull(), F.col("_quote_problem"))
               .when(F.col("_quotes").isNull() & ~F.col("label").isin(*(no_quote or ("",))), F.lit("missing_evidence")))
    return v.withColumn("problem", problem).drop("known", "labels", "_quote_problem", "_quotes")


def accept_verdicts(checked: DataFrame, tasks: DataFrame, finals: DataFrame | None = None) -> DataFrame:
    """Verdicts with accepted and reason: a task takes its required samples, one per judge, in arrival order.

    Refused verdicts use up no place, so the valid first verdict of each judge is found first and ranked next. Only
    (task, judge) heads reach the ranking window.
    """
    need = tasks.select("run_id", "task_id", "samples_required")
    if finals is None:
        need = need.withColumn("is_final", F.lit(False))
    else:
        need = need.join(finals.select("run_id", "task_id", F.lit(True).alias("_f")), ["run_id", "task_id"], "left"
                         ).withColumn("is_final", F.coalesce("_f", F.lit(False))).drop("_f")
    v = checked.join(need, ["run_id", "task_id"], "left")
    heads = (v.where("problem is null and not is_final").groupBy("run_id", "task_id", "judge_id")
             .agg(F.min("arrival").alias("_head"), F.first("samples_required").alias("_need")))
    rank = F.row_number().over(Window.partitionBy("run_id", "task_id").orderBy("_head"))
    heads = heads.withColumn("_rank", rank)
    full = heads.groupBy("run_id", "task_id").agg(
        F.max(F.when(F.col("_rank") == F.col("_need"), F.col("_head"))).alias("_full_at"))
    v = v.join(heads.drop("_need"), ["run_id", "task_id", "judge_id"], "left").join(full, ["run_id", "task_id"], "left")
    reason = (F.when(F.col("problem") == "unknown_task", F.lit("unknown_task"))
              .when(F.col("_full_at").isNotNull() & (F.col("arrival") > F.col("_full_at")), F.lit("samples_complete"))
              .when(F.col("is_final"), F.lit("task_already_final"))
              .when(F.col("_head").isNotNull() & (F.col("arrival") > F.col("_head"))
                    & (F.col("_rank") <= F.col("samples_required")), F.lit("duplicate_judge"))
              .otherwise(F.col("problem")))
    return (v.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
            .drop("_head", "_rank", "_full_at", "problem", "is_final", "samples_required"))


def finalize(accepted: DataFrame, tasks: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Majority label per task with enough samples; a tie or agreement under 2/3 leaves the label null.

    (task, label) counts are combined before the shuffle; a task then has one row per label.
    """
    counts = accepted.groupBy("run_id", "task_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.collect_set("model").alias("models"))
    key = ["run_id", "task_id"]
    g = counts.groupBy(*key).agg(
        F.sum("n").alias("samples"), F.max("n").alias("top"), F.max_by(F.struct("label", "c"), "n").alias("_best"),
        F.sum("c").alias("_c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
        F.array_sort(F.collect_list("n")).alias("_n"))
    tie = (F.size("_n") > 1) & (F.element_at("_n", -2) == F.col("top"))
    agreement = F.col("top") / F.col("samples")
    decided = ~tie & (agreement + K.TOLERANCE >= K.MIN_AGREEMENT)
    out = g.join(tasks.select(*key, "kpi_id", "samples_required"), key).where("samples >= samples_required").select(
        *key, "kpi_id", F.when(decided, F.col("_best.label")).alias("label"),
        round_half_even(agreement, 4).alias("agreement"), "samples",
        round_half_even(F.when(decided, F.col("_best.c") / F.col("top")).otherwise(F.col("_c") / F.col("samples")), 4)
        .alias("confidence"), "models")
    if evidence is None:
        return out
    return out.join(merge_evidence(accepted, out, evidence), key, "left")


def settle_finals(accepted: DataFrame, tasks: DataFrame, stored: DataFrame, samples_required: int | None = None) -> DataFrame:
    """Stored finals as they are, and the majority vote of every task without one: finality is terminal, whatever
    verdicts come later and whatever number of samples is asked for. samples_required may lower the number a task
    needs (early finalisation), never raise it. stored: the columns of ``finalize``."""
    key = ["run_id", "task_id"]
    waiting = tasks.join(stored.select(*key).distinct(), key, "left_anti")
    if samples_required is not None:
        waiting = waiting.withColumn("samples_required", F.least("samples_required", F.lit(samples_required)))
    fresh = finalize(accepted, waiting)
    return stored.select(*fresh.columns).unionByName(fresh)


def merge_evidence(accepted: DataFrame, finals: DataFrame, evidence: DataFrame, limit: int = K.MAX_EVIDENCE) -> DataFrame:
    """First `limit` distinct (snippet, quote) of the verdicts that agree with the final label."""
    key = ["run_id", "task_id"]
    agreeing = accepted.join(finals.select(*key, "label"), [*key, "label"]).select(*key, "verdict_id", "arrival")
    e = agreeing.join(evidence, "verdict_id").withColumn("_q", T.fold(F.col("quote")))
    first = e.groupBy(*key, "snippet_id", "_q").agg(F.min(F.struct("arrival", "item", "quote")).alias("_f"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_f.arrival", "_f.item"))
    return (first.withColumn("_r", rank).where(F.col("_r") <= limit).groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("_r", "snippet_id", F.col("_f.quote").alias("quote")))).alias("evidence")))


def progress(tasks: DataFrame, verdicts: DataFrame, finals: DataFrame) -> DataFrame:
    """Per run: tasks, sample-complete, remaining, final."""
    key = ["run_id", "task_id"]
    n = verdicts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    t = tasks.join(n, key, "left").join(finals.select(*key, F.lit(True).alias("_f")), key, "left")
    complete = F.coalesce("_n", F.lit(0)) >= F.col("samples_required")
    return t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tasks_total"), F.count_if(complete).alias("samples_complete"),
        F.count_if(~complete & F.col("_f").isNull()).alias("tasks_remaining"), F.count("_f").alias("final"))


def judgment_summary(finals: DataFrame, verdicts: DataFrame, tasks: DataFrame, model_judge: str = "model") -> DataFrame:
    """Per run: who judged what. A final is the model judge's when its only verdicts carry that judge id."""
    key = ["run_id", "task_id"]
    who = verdicts.groupBy(*key).agg(F.min(F.col("judge_id") == model_judge).alias("only_model"))
    f = finals.join(who, key, "left").join(tasks.select(*key, "escalation_reason"), key, "left")
    by_model, passed = F.coalesce("only_model", F.lit(False)), F.col("escalation_reason").isNotNull()
    return f.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("finals"), F.count_if(F.col("samples") == 1).alias("single_sample"),
        F.count_if(passed).alias("escalated_final"), F.count_if(by_model).alias("by_model"),
        F.count_if(~by_model).alias("by_panel"),
        F.array_sort(F.collect_set(F.when(by_model, F.col("kpi_id")))).alias("model_kpis"),
        F.array_sort(F.collect_set(F.when(~by_model & ~passed, F.col("kpi_id")))).alias("panel_kpis"))


def valid_choice(choice: Column, confidence: Column, probabilities: Column, options: Column) -> Column:
    """The probabilities cover exactly the options, lie in 0..1, sum to one and peak at the choice."""
    p = F.map_values(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    same = (F.size(F.array_except(F.map_keys(probabilities), options)) == 0) & (
        F.size(F.array_except(options, F.map_keys(probabilities))) == 0)
    inside = F.forall(p, lambda x: x.between(0.0, 1.0) & ~F.isnan(x)) & confidence.between(0.0, 1.0)
    peak = F.element_at(probabilities, choice) >= F.array_max(p) - F.lit(1e-6)
    return F.coalesce(F.array_contains(options, choice) & same & inside & (F.abs(total - 1) < 0.02) & peak, F.lit(False))


def min_probability(value: Column | float | None = None) -> Column:
    """The acceptance floor, 0.6 unless given, kept within 0.5..0.95."""
    raw = F.lit(0.6) if value is None else F.lit(value) if isinstance(value, float) else value
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.coalesce(raw, F.lit(0.6))))


def route_readings(readings: DataFrame, floor: float = 0.6) -> DataFrame:
    """Readings with outcome accepted, or the reason the task passes to the panel.

    Columns: label, probability, label_valid, reverse_label, reverse_valid, needs_quote, evidence_choice,
    evidence_valid. Each later head is read only when the earlier ones pass.
    """
    outcome = (F.when(~F.col("label_valid"), F.lit("invalid_response"))
               .when(F.col("probability") < min_probability(floor), F.lit("low_probability"))
               .when(~F.col("reverse_valid"), F.lit("invalid_response"))
               .when(F.col("reverse_label") != F.col("label"), F.lit("position_flip"))
               .when(~F.col("needs_quote"), F.lit("accepted"))
               .when(~F.col("evidence_valid"), F.lit("invalid_response"))
               .when(F.col("evidence_choice").isNull(), F.lit("no_evidence")).otherwise(F.lit("accepted")))
    return readings.withColumn("outcome", outcome).withColumn("retryable", F.col("outcome").isin(*K.RETRY_REASONS))


def open_tasks(tasks: DataFrame, rubrics: DataFrame, finals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tasks the model judge may still answer: routed to it, not final, untouched, retryable; never-asked ones first."""
    key = ["run_id", "task_id"]
    dim = rubrics.select("rubric_id", "judge", F.col("rubric_version").alias("_v"))
    t = tasks.join(F.broadcast(dim), "rubric_id", "left")
    t = t.where((F.col("judge") == "model") & (F.col("_v") == F.col("rubric_version")))
    t = t.join(finals.select(*key), key, "left_anti").join(verdicts.select(*key), key, "left_anti")
    t = t.where(F.col("escalation_reason").isNull() | F.col("escalation_reason").isin(*K.RETRY_REASONS))
    return t.withColumn("asked_before", F.col("escalation_reason").isNotNull()).drop("_v", "judge")


def settle(tasks: DataFrame, accepted: DataFrame, finals: DataFrame, samples: int = 1) -> DataFrame:
    """samples_required lowered for the accepted open tasks; never raised, final tasks untouched."""
    key = ["run_id", "task_id"]
    t = tasks.join(accepted.select(*key).distinct().withColumn("_a", F.lit(True)), key, "left").join(
        finals.select(*key).withColumn("_f", F.lit(True)), key, "left")
    lower = F.col("_a").isNotNull() & F.col("_f").isNull()
    return t.withColumn("samples_required", F.when(lower, F.least("samples_required", F.lit(samples)))
                        .otherwise(F.col("samples_required"))).drop("_a", "_f")


def work_list(tasks: DataFrame, judges: list[str], verdicts: DataFrame, finals: DataFrame, batch: int = 8) -> DataFrame:
    """Per judge: the tasks it has not answered that are neither final nor complete, numbered into batches per run."""
    key = ["run_id", "task_id"]
    n = verdicts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    t = tasks.join(n, key, "left").where(F.coalesce("_n", F.lit(0)) < F.col("samples_required")).drop("_n")
    t = t.join(finals.select(*key), key, "left_anti")
    t = t.withColumn("judge_id", F.explode(F.array(*[F.lit(j) for j in judges])))
    t = t.join(verdicts.select(*key, "judge_id").distinct(), [*key, "judge_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("run_id", "judge_id").orderBy("task_ord"))
    return t.withColumn("batch", F.floor((rank - 1) / batch))


def absence_rows(pages: DataFrame, tasks: DataFrame, rubric_pages: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Reached pages of absence-readable rubrics without a task: evidence of absence, or why it is none.

    pages: run_id, page_id, has_audit, challenge, plus the evidence columns of ``absence_label``. rubric_pages: the
    (rubric_id, kpi_id, run_id, page_id) pairs whose stage fits. tasks: run_id, rubric_id, page_id covered.
    """
    left = rubric_pages.join(tasks.select("run_id", "rubric_id", "page_id").distinct(),
                             ["run_id", "rubric_id", "page_id"], "left_anti")
    rows = left.join(pages, ["run_id", "page_id"]).join(unresolved, ["run_id", "rubric_id"], "left")
    label = absence_label(F.col("rubric_id"))
    blocked = (F.when(~F.col("has_audit"), F.lit("no_audit")).when(F.col("challenge"), F.lit("bot_challenge"))
               .otherwise(F.col("unresolved_reason")))
    return rows.select("run_id", "kpi_id", "rubric_id", "page_id", F.when(blocked.isNull(), label).alias("value_str"),
                       blocked.isNull().alias("assessed"), F.coalesce(blocked, F.lit("no_snippets")).alias("reason"))


def absence_label(rubric: Column) -> Column:
    """The label a page without snippets still shows: a rating, a returns link or a badge lifts it above absent."""
    return (F.when((rubric == "social_proof") & F.col("has_rating"), F.lit("basic"))
            .when((rubric == "returns_clarity") & F.col("has_returns_link"), F.lit("vague"))
            .when((rubric == "authority") & F.col("has_badge"), F.lit("weak")).otherwise(F.lit("absent")))


def judged_observations(tasks: DataFrame, finals: DataFrame, values: DataFrame) -> DataFrame:
    """One observation per page a task covers: the final label through the rubric's values, or why there is none."""
    key = ["run_id", "task_id"]
    f = finals.select(*key, "label", "agreement", F.lit(True).alias("_final"))
    t = tasks.select(*key, "rubric_id", "kpi_id", "pages").join(f, key, "left")
    v = values.select("rubric_id", "label", "value_num", "value_str")
    t = t.join(F.broadcast(v), ["rubric_id", "label"], "left")
    mapped = F.col("value_num").isNotNull() | F.col("value_str").isNotNull()
    reason = (F.when(F.col("_final").isNull(), F.lit("judgment_pending"))
              .when(F.col("label").isNull(), F.lit("judgment_uncertain")).when(~mapped, F.lit("judgment_unclear")))
    t = (t.withColumn("reason", reason).withColumn("value_num", round_half_even(F.col("value_num") * F.col("agreement"), 3))
         .withColumn("page", F.explode("pages")))
    ok = F.col("reason").isNull()
    return t.select("run_id", "task_id", "kpi_id", F.col("page.page_id").alias("page_id"),
                    F.col("page.profile").alias("profile"), F.col("page.stage").alias("stage"),
                    F.when(ok, F.col("value_num")).alias("value_num"), F.when(ok, F.col("value_str")).alias("value_str"),
                    ok.alias("assessed"), "reason", F.lit("judged").alias("source"))


def parse_verdicts(raw: DataFrame, tasks: DataFrame) -> DataFrame:
    """Verdict payloads ({"verdicts": [...]}) to rows of known tasks; a payload that is not such an object gives none.

    raw: run_id, judge_id, model, payload. Text around the JSON object is ignored.
    """
    body = F.regexp_extract("payload", r"(?s)(\{.*\})", 1)
    kind = "struct<verdicts:array<struct<task_id:string,label:string,confidence:double,rationale:string>>>"
    rows = raw.withColumn("_doc", F.from_json(body, kind)).select(
        "run_id", "judge_id", "model", F.explode("_doc.verdicts").alias("_v"))
    rows = rows.select("run_id", "judge_id", "model", F.col("_v.task_id").alias("task_id"), F.col("_v.label").alias("label"),
                       F.col("_v.confidence").alias("confidence"), F.coalesce("_v.rationale", F.lit("")).alias("rationale"))
    return rows.join(tasks.select("run_id", "task_id"), ["run_id", "task_id"], "left_semi")


def page_tasks(tasks: DataFrame, limit: int = K.TASK_PAGE, budget: int = K.TASK_PAGE_CHARS, together: int = 4096) -> DataFrame:
    """Numbers a run's tasks into pages of at most `limit` tasks and `budget` weighted characters.

    A page always takes its first task; the next starts when either bound would be passed. Runs of up to ``together``
    tasks are folded as one row of ids and sizes; in longer ones the page that would start at a task says where the next
    one starts, and these links are followed from the first task (see ``scan.follow``). Both give the same pages.
    tasks: run_id, task_id, task_ord, chars.
    """
    counted = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    short = tasks.join(counted.where(F.col("_n") > together), "run_id", "left_anti")
    long = tasks.join(counted.where(F.col("_n") > together), "run_id", "left_semi")
    return _folded_pages(short, limit, budget).unionByName(_linked_pages(long, limit, budget))


def _linked_pages(tasks: DataFrame, limit: int, budget: int, chunk: int = 1024) -> DataFrame:
    """Pages of runs of any length. A page holds at most ``limit`` tasks, so the first one that begins in a chunk begins
    at one of its first ``limit`` tasks: a chunk is reduced to where each of these leads to in the next chunk, and only
    those few links are followed over the run. Every chunk is then cut from the one task it is entered at."""
    chunk = max(chunk, limit)
    sized = with_running(tasks.select("run_id", "task_id", "task_ord", "chars"), ["run_id"], "task_ord", {"pos": F.lit(1), "_upto": F.col("chars")})
    here = F.floor((F.col("pos") - 1) / chunk)
    near = F.when((F.col("pos") - 1) % chunk < limit, here - 1)  # the first rows of a chunk also end the one before it
    spread = sized.select("run_id", "task_id", "pos", "chars", "_upto", F.explode(F.array_compact(F.array(here, near))).alias("_chunk"), here.alias("_own"))
    next_rows = F.collect_list("_upto").over(Window.partitionBy("run_id", "_chunk").orderBy("pos").rowsBetween(1, limit))
    fits = F.size(F.filter("_next", lambda x: x <= F.col("_upto") - F.col("chars") + budget))
    step = F.least(F.lit(limit), fits + 1)
    links = (spread.withColumn("_next", next_rows).where("_chunk = _own")
             .select("run_id", "_chunk", "pos", "task_id", F.when(F.size("_next") >= step, F.col("pos") + step).alias("nxt")))
    # the rows of a chunk in order; nxt is null where no further page begins
    rows = stored(links.groupBy("run_id", "_chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "nxt", "task_id"))).alias("_rows")), "chunks")
    first = F.col("_chunk") * chunk + 1

    def walk(at: Column, row: Column) -> Column:
        moved = F.struct(row["nxt"].alias("at"), (at["n"] + 1).alias("n"))
        return F.when(at["at"] == row["pos"], moved).otherwise(at)

    entries = F.transform(F.slice("_rows", 1, limit), lambda r: F.struct(r["pos"].alias("at"), F.lit(0).alias("n")))
    ends = F.aggregate("_rows", entries, lambda state, row: F.transform(state, lambda at: walk(at, row)))
    ways = stored(rows.select("run_id", "_chunk", first.alias("_first"), F.posexplode(ends).alias("_i", "_end"))
                  .select("run_id", "_chunk", (F.col("_first") + F.col("_i")).alias("pos"), F.col("_end.at").alias("nxt"), F.col("_end.n").alias("n")), "ways")
    start = ways.where("pos = 1").select("run_id", "pos")
    taken = ways.join(follow(ways.select("run_id", "pos", "nxt"), start, ["run_id"]), ["run_id", "pos"])
    taken = taken.select("run_id", "_chunk", F.col("pos").alias("_entry"), "n")
    # the last page may hold all of the last chunk: no page begins in it
    before = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    taken = (rows.select("run_id", "_chunk").join(taken, ["run_id", "_chunk"], "left")
             .select("run_id", "_chunk", "_entry", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))

    def cut(state: Column, row: Column) -> Column:
        return F.when(state["at"] == row["pos"], F.struct(row["nxt"].alias("at"), F.concat(state["starts"], F.array(row["pos"])).alias("starts"))).otherwise(state)

    none = F.struct(F.col("_entry").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    paged = rows.join(taken, ["run_id", "_chunk"]).withColumn("_starts", F.aggregate("_rows", none, cut)["starts"])
    bounds = F.concat(F.array(F.col("_rows")[0]["pos"]), F.col("_starts"), F.array(F.col("_rows")[F.size("_rows") - 1]["pos"] + 1))
    pieces = F.transform(F.sequence(F.lit(0), F.size("_starts")), lambda i: F.struct(
        (F.col("_before") - 1 + i).cast("int").alias("page"),
        F.slice("_rows", (F.col("_bounds")[i] - F.col("_bounds")[0] + 1).cast("int"), (F.col("_bounds")[i + 1] - F.col("_bounds")[i]).cast("int")).alias("rows")))
    paged = paged.withColumn("_bounds", bounds).select("run_id", F.explode(pieces).alias("_p"))
    return paged.select("run_id", F.col("_p.page").alias("page"), F.explode("_p.rows.task_id").alias("task_id")).select("run_id", "task_id", "page")


def _folded_pages(tasks: DataFrame, limit: int, budget: int) -> DataFrame:
    sizes = F.array_sort(F.collect_list(F.struct("task_ord", "task_id", "chars")))
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"),
                     F.array().cast("array<struct<task_id:string,page:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        used = a["used"] + t["chars"]
        fresh = (a["n"] > 0) & ((used > budget) | (a["n"] >= limit))
        page = F.when(fresh, a["page"] + 1).otherwise(a["page"])
        return F.struct(page.alias("page"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"),
                        F.when(fresh, t["chars"]).otherwise(used).cast("long").alias("used"),
                        F.concat(a["out"], F.array(F.struct(t["task_id"].alias("task_id"), page.alias("page")))).alias("out"))

    folded = tasks.groupBy("run_id").agg(F.aggregate(sizes, start, step).alias("_f"))
    return folded.select("run_id", F.explode("_f.out").alias("_o")).select(
        "run_id", F.col("_o.task_id").alias("task_id"), F.col("_o.page").alias("page"))


def label_agreement(readings: DataFrame) -> DataFrame:
    """Per task: share of its most frequent label over repeated readings, and whether it was always the same."""
    n = readings.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("task_id").agg(F.max("n").alias("_top"), F.sum("n").alias("runs"))
    return g.select("task_id", "runs", round_half_even(F.col("_top") / F.col("runs"), 3).alias("agreement"),
                    (F.col("_top") == F.col("runs")).alias("stable"))


def per_rubric(readings: DataFrame) -> DataFrame:
    """Per rubric: tasks, accepted, mean probability, escalations by reason as a map."""
    n = readings.groupBy("rubric_id", "escalated").agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p"),
                                                       F.count("probability").alias("np"))
    entry = F.when(F.col("escalated").isNotNull(), F.struct("escalated", "n"))
    return n.groupBy("rubric_id").agg(
        F.sum("n").alias("tasks"), F.sum(F.when(F.col("escalated").isNull(), F.col("n")).otherwise(0)).alias("accepted"),
        round_half_even(F.sum("p") / F.sum("np"), 3).alias("mean_p"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("escalated"))


RUBRICS = C.default_rubrics
