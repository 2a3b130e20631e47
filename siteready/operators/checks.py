"""Page facts -> observations: page and site checks, missing stages, account rules, evidence predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.dims import constants as K
from siteready.dims.catalog import Catalog, default_catalog
from siteready.functions import text as T
from siteready.functions.numbers import clamp, round_half_even
from siteready.operators.quantiles import weighted_median

def stage_ord(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in K.STAGES]), stage)


# ---------------------------------------------------------------- page predicates (columns of the flat page table)
def visit_failure(page_type: Column, signals: Column, has_doc: Column, has_ctas: Column) -> Column:
    """Why a loaded page shows nothing of the shop: challenge, navigation error, no audit; first match wins."""
    return (F.when(page_type == "challenge", F.lit("bot_challenge"))
            .when(F.coalesce(F.array_contains(signals, "navigation_error"), F.lit(False)), F.lit("navigation_error"))
            .when(~F.coalesce(has_doc, F.lit(False)) & ~F.coalesce(has_ctas, F.lit(False)), F.lit("audit_unavailable")))


def is_listing(page_type: Column, main_group: Column, itemlist: Column) -> Column:
    big = (F.coalesce(main_group, F.lit(0)) >= 4) | (F.coalesce(itemlist, F.lit(0)) >= 4)
    return (page_type == "plp") | (big & ~page_type.isin("home", "pdp", "cart", "checkout", "challenge"))


def is_product(page_type: Column, cta_present: Column, has_price: Column, has_structured: Column) -> Column:
    buyable = cta_present & (has_price | has_structured)
    return (page_type == "pdp") | (buyable & ~page_type.isin("home", "plp", "cart", "checkout", "challenge"))


def cart_empty(marked_empty: Column, lines: Column, total: Column, subtotal: Column) -> Column:
    amount = (F.coalesce(total, F.lit(0.0)) > 0) | (F.coalesce(subtotal, F.lit(0.0)) > 0)
    return F.when(F.coalesce(marked_empty, F.lit(False)), True).when(F.coalesce(lines, F.lit(0)) > 0, False).otherwise(~amount)


def is_cart(page_type: Column, lines: Column, marked_empty: Column, total: Column, subtotal: Column) -> Column:
    amount = (F.coalesce(total, F.lit(0.0)) > 0) | (F.coalesce(subtotal, F.lit(0.0)) > 0)
    evidence = (F.coalesce(lines, F.lit(0)) > 0) | F.coalesce(marked_empty, F.lit(False)) | amount
    return page_type.isin("cart", "checkout") | (evidence & ~page_type.isin("home", "plp", "pdp", "challenge"))


def variant_gated(groups: Column) -> Column:
    """A variant group not selected yet, or whose selection is unknown. groups: array of nullable booleans."""
    return F.coalesce(F.exists(groups, lambda g: ~F.coalesce(g, F.lit(False))), F.lit(False))


def unavailable(offers: Column, availability: Column, present: Column, enabled: Column, gated: Column,
                out_of_stock_text: Column, scarcity_text: Column) -> Column:
    return (F.when((offers == 1) & availability.isin(*K.GONE), F.lit("availability"))
            .when(present & (enabled == F.lit(False)) & ~gated, F.lit("cta_disabled"))
            .when(~F.coalesce(present, F.lit(False)) & out_of_stock_text & ~scarcity_text, F.lit("stock_text")))


def cta_salience(present: Column, contrast: Column, area: Column, above_fold: Column, competing: Column) -> Column:
    """0-100 composite of the stage's main control: contrast, area, uniqueness; half below the fold."""
    c = clamp((F.coalesce(contrast, F.lit(1.0)) - 3) / 1.5)
    a = clamp(F.coalesce(area, F.lit(0.0)) / K.SALIENT_AREA)
    u = F.lit(0.25) / F.greatest(F.lit(1), F.coalesce(competing, F.lit(0)))
    fold = F.when(F.coalesce(above_fold, F.lit(False)), 1.0).otherwise(0.5)
    return F.when(F.coalesce(present, F.lit(False)), round_half_even(100 * fold * (0.5 * c + 0.25 * a + u), 1)).otherwise(0.0)


def competing_ctas(ctas: DataFrame) -> DataFrame:
    """Per page: primary-looking controls above the fold; the buttons of product cards count once together."""
    shown = F.col("primary_like") & F.col("above_fold")
    return ctas.groupBy("run_id", "page_id").agg(
        (F.count_if(shown & ~F.col("in_card")) + F.max(F.when(shown & F.col("in_card"), 1).otherwise(0))).alias("competing"),
        F.count_if(shown & F.col("in_card")).alias("card_buttons"))


def visual_complexity(edge: Column, bytes_per_px: Column, colour: Column) -> Column:
    def part(x: Column, unit: float) -> Column:
        return clamp(F.coalesce(x, F.lit(0.0)) / unit)
    return round_half_even(100 * (0.40 * part(edge, 0.25) + 0.35 * part(bytes_per_px, 0.40) + 0.25 * part(colour, 100.0)), 1)


def rating_band(rating: Column) -> Column:
    r = round_half_even(rating, 1)
    return (F.when(~rating.between(0.0, 5.0), F.lit("rating_scale_unknown")).when(r >= 4.8, F.lit("4.8-5.0"))
            .when(r >= 4.0, F.lit("4.0-4.7")).when(r >= 3.5, F.lit("3.5-3.9")).otherwise(F.lit("<3.5")))


def strikethrough_ok(struck_main: Column, struck_card: Column, said_main: Column, said_card: Column, scoped: Column) -> Column:
    """Every struck price has its lowest-price statement; null when nothing is struck. Without known scopes one
    statement is enough."""
    rule = (said_main >= struck_main) & ((struck_card == 0) | (said_main >= 1) | (said_card >= struck_card))
    said, struck = said_main + said_card, struck_main + struck_card
    return F.when(struck > 0, F.when(said == 0, F.lit(False)).when(~scoped, F.lit(True)).otherwise(rule))


def readability(words: Column, sentences: Column, letters: Column, syllables: Column, lang: Column) -> Column:
    s = F.greatest(F.lit(1), sentences)
    gulpease = 89 - 10 * letters / words + 300 * s / words
    flesch = 206.835 - 1.015 * words / s - 84.6 * syllables / words
    score = F.when(lang == "it", gulpease).when(lang == "en", flesch)
    return F.when(words >= K.MIN_PROSE_WORDS, round_half_even(clamp(score, 0.0, 100.0), 1))


# ---------------------------------------------------------------- page KPIs
_COLUMNS = {
    "double": "ttfb fcp lcp cls tbt_approx loaf_count bytes_transfer bytes_js third_party_share autocomplete_share labels_share "
              "coverage rating price_value structured_price colorfulness edge_density bytes_per_px cta_contrast cta_area "
              "cart_total cart_subtotal buy_contrast buy_area checkout_contrast checkout_area syllable_count",
    "int": "requests http_errors mixed_content console_errors oversized filters visible_fields interactive lt24 lt44 img_missing_alt "
           "interrupting review_count cart_lines cards_count main_group primary_count h1 h2 word_count sentence_count letter_count offers "
           "struck_main struck_card said_main said_card",
    "boolean": "speculative soft_navigation has_vitals has_doc has_ctas sort_present breadcrumbs cta_present cta_above_fold cta_enabled "
               "cart_marked_empty cart_editable lang_missing price_above_fold strike_scoped buy_present buy_above_fold "
               "checkout_cta_present checkout_cta_above_fold out_of_stock_text scarcity_text",
    "string": "url stage visibility result_count_text pagination variant_selector rating_text count_text delivery_text price_currency "
              "structured_currency availability lang page_type",
    "array<string>": "signals", "array<boolean>": "variant_groups",
}


def complete_columns(pages: DataFrame) -> DataFrame:
    """The flat page table with every column the checks read; absent ones are null (not observed)."""
    missing = [F.lit(None).cast(kind).alias(c) for kind, names in _COLUMNS.items() for c in names.split() if c not in pages.columns]
    return pages.select("*", *missing)


def _page_checks() -> dict[str, tuple[str, Column, Column]]:
    """KPI id -> (type, value, reason). A null value carries its reason."""
    c, lit = F.col, F.lit
    no = lit(False)
    failed = F.when(F.coalesce(F.array_contains("signals", "navigation_error"), no), lit("navigation_error"))
    dom = F.coalesce(failed, F.when(~F.coalesce(c("has_doc"), no) & ~F.coalesce(c("has_ctas"), no), lit("audit_unavailable")))
    n = lambda name: F.coalesce(c(name), lit(0))
    b = lambda name: F.coalesce(c(name), no)
    out: dict[str, tuple[str, Column, Column]] = {}

    def put(kpi: str, kind: str, value: Column, reason: Column | None = None, base: Column = dom):
        why = base if reason is None else F.coalesce(base, reason)
        out[kpi] = (kind, F.when(why.isNull(), value), why)

    for kpi, key, digits in (("TTFB", "ttfb", 1), ("FCP", "fcp", 1), ("LCP", "lcp", 1), ("CLS", "cls", 4),
                             ("TBT_APPROX", "tbt_approx", 1), ("LOAF_COUNT", "loaf_count", 0)):
        hidden = c("visibility").isNotNull() & (c("visibility") != "visible") if key in K.PAINT_TIMINGS else no
        why = (F.when(b("speculative"), lit("not_applicable:speculative_navigation"))
               .when(b("soft_navigation"), lit("not_applicable:same_document"))
               .when(c(key).isNull(), F.when(hidden, lit("background_tab")).when(b("has_vitals"), lit("unavailable"))
                     .otherwise(lit("vitals_unavailable"))))
        put(f"PERF.{kpi}", "number", round_half_even(c(key), digits), why, failed)
    for kpi, key, scale in (("PERF.BYTES_TOTAL", "bytes_transfer", 0.001), ("PERF.BYTES_JS", "bytes_js", 0.001), ("PERF.REQUESTS", "requests", None),
                            ("PERF.THIRD_PARTY_SHARE", "third_party_share", 100.0), ("PERF.HTTP_ERRORS", "http_errors", None),
                            ("TRI.MIXED_CONTENT", "mixed_content", None)):
        value = c(key).cast("double") if scale is None else round_half_even(c(key) * scale, 1)
        put(kpi, "number", value, F.when(c(key).isNull(), lit("network_unavailable")), failed)
    put("PERF.CONSOLE_ERRORS", "number", c("console_errors").cast("double"), F.when(c("console_errors").isNull(), lit("errors_unavailable")), failed)
    put("PERF.IMG_OVERSIZED", "number", n("oversized").cast("double"))
    put("FAI.PLP_FILTERS", "number", n("filters").cast("double"))
    put("FAI.PLP_SORT", "bool", b("sort_present"))
    put("FAI.PLP_RESULT_COUNT", "bool", F.coalesce(c("result_count_text") != "", no))
    put("FAI.PLP_PAGINATION", "enum", F.when(c("pagination").isin(*K.PAGINATION), c("pagination")).otherwise(lit("none")))
    put("FAI.BREADCRUMBS", "bool", b("breadcrumbs"))
    gated = variant_gated(c("variant_groups"))
    gone = unavailable(c("offers"), c("availability"), b("cta_present"), c("cta_enabled"), gated, b("out_of_stock_text"), b("scarcity_text"))
    sold_out = F.when(gone.isNotNull(), lit("not_applicable:out_of_stock"))
    disabled = F.coalesce(~c("cta_enabled"), no)
    put("FAI.PDP_CTA_ABOVE_FOLD", "bool", b("cta_present") & b("cta_above_fold") & (~disabled | gated), sold_out)
    put("FAI.PDP_VARIANT_SELECTOR", "enum", F.coalesce(c("variant_selector"), lit("none")))
    empty = cart_empty(c("cart_marked_empty"), c("cart_lines"), c("cart_total"), c("cart_subtotal"))
    put("FAI.CART_EDITABLE", "bool", b("cart_editable"), F.when(empty, lit("empty_cart")).when((n("cart_lines") == 0) & ~b("cart_editable"), lit("cart_lines_not_recognised")))
    no_fields = lit("not_applicable:no_form_fields")
    put("FAI.CHECKOUT_FIELDS", "number", c("visible_fields").cast("double"), F.when(n("visible_fields") == 0, no_fields))
    for kpi, key in (("FAI.AUTOCOMPLETE_ATTRS", "autocomplete_share"), ("CCL.FORM_LABELS", "labels_share")):
        put(kpi, "number", round_half_even(c(key) * 100, 1), F.when((n("visible_fields") == 0) | c(key).isNull(), no_fields))
    for kpi, key in (("FAI.TARGET_SIZE_24", "lt24"), ("FAI.TARGET_SIZE_44", "lt44")):
        put(kpi, "number", round_half_even(lit(100.0) * (c("interactive") - n(key)) / c("interactive"), 1),
            F.when(n("interactive") == 0, lit("not_applicable:no_interactive_targets")))
    put("FAI.A11Y_BASIC", "number", (n("img_missing_alt") + b("lang_missing").cast("int")).cast("double"))
    put("FAI.OVERLAY_INTERRUPTIONS", "number", n("interrupting").cast("double"))
    put("FAI.OVERLAY_COVERAGE", "number", round_half_even(100 * F.coalesce(c("coverage"), lit(0.0)), 1))
    put("TRI.HTTPS", "bool", F.startswith("url", lit("https:")), None, failed)
    shown = (n("review_count") > 0) | c("rating").isNotNull() | F.coalesce(c("rating_text") != "", no)
    put("TRI.REVIEWS_PRESENT", "bool", shown)
    put("TRI.REVIEW_COUNT", "number", n("review_count").cast("double"), F.when(
        c("review_count").isNull() & (c("rating").isNotNull() | F.coalesce(c("rating_text") != "", no)), lit("review_count_unavailable")))
    put("TRI.RATING_BAND", "enum", rating_band(c("rating")), F.when(c("rating").isNull(), lit("not_applicable:no_rating"))
        .when(~c("rating").between(0.0, 5.0), lit("rating_scale_unknown")))
    put("TRI.DELIVERY_TIME_STATED", "bool", F.coalesce(c("delivery_text") != "", no), F.when((c("stage") == "cart") & empty, lit("empty_cart")))
    put("PTI.PRICE_VISIBLE_PDP", "bool", c("price_value").isNotNull() & b("price_above_fold"))
    same = F.coalesce(c("price_currency") == c("structured_currency"), lit(True))
    put("PTI.PRICE_JSONLD_MATCH", "bool", same & (F.abs(c("price_value") - c("structured_price")) <= 0.01),
        F.when(c("structured_price").isNull(), lit("not_applicable:no_structured_price")).when(c("price_value").isNull(), lit("not_applicable:no_visible_price")))
    strike = strikethrough_ok(n("struck_main"), n("struck_card"), n("said_main"), n("said_card"), b("strike_scoped"))
    put("PTI.STRIKETHROUGH_LOWEST30", "bool", strike, F.when(strike.isNull(), lit("not_applicable:no_strikethrough_price")))
    on_cart = c("stage") == "cart"
    pick = lambda a, x, y: F.when(on_cart, c(a)).when(b("cta_present"), c(x)).otherwise(c(y))
    salience = cta_salience(pick("checkout_cta_present", "cta_present", "buy_present"), pick("checkout_contrast", "cta_contrast", "buy_contrast"),
                            pick("checkout_area", "cta_area", "buy_area"), pick("checkout_cta_above_fold", "cta_above_fold", "buy_above_fold"), c("primary_count"))
    put("CCL.CTA_SALIENCE", "number", salience, F.when(on_cart, F.when(empty, lit("empty_cart")).when(~b("checkout_cta_present"), lit("checkout_cta_not_found")))
        .otherwise(sold_out))
    put("CCL.PRIMARY_CTA_COUNT", "number", n("primary_count").cast("double"))
    cards = F.greatest(n("main_group"), n("cards_count"))
    put("CCL.CHOICE_SUPPORT", "bool", (n("filters") > 0) | b("sort_present"), F.when(cards < K.LARGE_ASSORTMENT, lit("not_applicable:small_assortment")))
    put("CCL.READABILITY", "number", readability(c("word_count"), n("sentence_count"), c("letter_count"), c("syllable_count"), c("lang")),
        F.when(n("word_count") < K.MIN_PROSE_WORDS, lit("not_applicable:little_prose")).when(~F.coalesce(c("lang").isin("it", "en"), no), lit("unsupported_language"))
        .when(F.when(c("lang") == "it", c("letter_count").cast("double")).otherwise(c("syllable_count")).isNull(), lit("unavailable")))
    put("CCL.HEADINGS", "bool", F.coalesce(c("h1") == 1, no) & (n("h2") >= 1))
    put("CCL.VISUAL_COMPLEXITY", "number", visual_complexity(c("edge_density"), c("bytes_per_px"), c("colorfulness")),
        F.when(c("edge_density").isNull(), lit("no_screenshot")), failed)
    return out


def page_kpis(pages: DataFrame, catalog: Catalog | None = None, extra: dict | None = None) -> DataFrame:
    """(run, page, KPI) observations: every page check of the page's stage, a few checks per projection and unpivot.

    The values become plain columns first, so the projection shares their common parts; the unpivot only arranges
    them. ``extra`` adds registered checks: KPI id -> (type, value, reason).
    """
    catalog = catalog or default_catalog()
    checks = list({**_page_checks(), **(extra or {})}.items())
    keys = [c for c in ("run_id", "profile", "page_id", "page_ord", "stage", "repeat_of") if c in pages.columns]
    pages = complete_columns(pages)
    out = None
    for at in range(0, len(checks), CHECKS_PER_PASS):
        part = _unpivot_checks(pages, dict(checks[at:at + CHECKS_PER_PASS]), keys, catalog)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("assessed", F.col("reason").isNull()).withColumn("source", F.lit("deterministic"))


CHECKS_PER_PASS = 9  # more in one projection and its generated code is too large to be compiled


def _unpivot_checks(pages: DataFrame, checks: dict, keys: list[str], catalog: Catalog) -> DataFrame:
    wide = pages.select(
        *keys, *[v.alias(f"_v{i}") for i, (_, v, _) in enumerate(checks.values())],
        *[r.cast("string").alias(f"_r{i}") for i, (_, _, r) in enumerate(checks.values())])
    null = {"number": F.lit(None).cast("double"), "bool": F.lit(None).cast("boolean"), "enum": F.lit(None).cast("string")}
    cells = []
    for i, (kpi, (kind, _, _)) in enumerate(checks.items()):
        at = {k: (F.col(f"_v{i}") if k == kind else null[k]) for k in null}
        stages = catalog.kpis[kpi].stages if kpi in catalog.kpis else ()
        cell = F.struct(F.lit(kpi).alias("kpi_id"), F.lit(kind).alias("value_type"), at["number"].alias("value_num"),
                        at["bool"].alias("value_bool"), at["enum"].alias("value_str"), F.col(f"_r{i}").alias("reason"))
        cells.append(F.when(F.col("stage").isin(*stages), cell) if stages else cell)
    # the array is a column before it is exploded, so compiled code makes it; cells of other stages go after the explode,
    # since taking them out of the array runs a lambda for each
    out = wide.select(*keys, F.array(*cells).alias("_cells")).select(*keys, F.explode("_cells").alias("_o")).where("_o is not null")
    out = out.select(*keys, *[F.col("_o")[c].alias(c) for c in ("kpi_id", "value_type", "value_num", "value_bool", "value_str", "reason")])
    return out


def measure_repeats(rows: DataFrame) -> DataFrame:
    """A page and its reloads as one observation: the median of numbers, else the first readable load's value.

    rows: run_id, kpi_id, head_id, load_ord, value_num, value_str, reason.
    """
    key = ["run_id", "kpi_id", "head_id"]
    med = weighted_median(rows, key, F.col("value_num"), 1, "median")
    ok = F.col("value_num").isNotNull() | F.col("value_str").isNotNull()
    g = rows.groupBy(*key).agg(
        F.count_if(ok).alias("loads"), F.count("value_num").alias("_numbers"), F.min_by("value_str", F.when(F.col("value_str").isNotNull(), F.col("load_ord"))).alias("value_str"),
        F.min_by("reason", F.when(~ok, F.col("load_ord"))).alias("_reason"))
    g = g.join(med, key, "left")
    return g.select(*key, "loads", round_half_even(F.col("median"), 4).alias("value_num"), F.when(F.col("_numbers") < F.col("loads"), F.col("value_str")).alias("value_str"),
                    F.when(F.col("loads") == 0, F.col("_reason")).alias("reason"))


# ---------------------------------------------------------------- stages, repeats, reasons
def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages with their head: a reload counts only when its head page exists in the same stage."""
    heads = pages.where("repeat_of is null").select("run_id", F.col("page_id").alias("repeat_of"), "stage").distinct()
    joined = pages.join(heads.withColumn("_head", F.lit(True)), ["run_id", "repeat_of", "stage"], "left")
    joined = joined.where(F.col("repeat_of").isNull() | F.col("_head").isNotNull())
    return joined.withColumn("head_id", F.coalesce("repeat_of", "page_id")).drop("_head")


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page per (run, profile, stage), reloads left out: an aggregation that keeps one row."""
    rest = [c for c in pages.columns if c not in ("run_id", "profile", "stage")]
    heads = pages.where(F.col("repeat_of").isNull() & F.col("stage").isin(*K.STAGES))
    return (heads.groupBy("run_id", "profile", "stage").agg(F.min_by(F.struct(*rest), "page_ord").alias("_p"))
            .select("run_id", "profile", "stage", *[F.col("_p")[c].alias(c) for c in rest]))


def funnel_choice(pages: DataFrame) -> DataFrame:
    """Per (run, profile): the first accept or reject in stage order."""
    p = first_pages(pages).where(F.col("consent_choice").isin("accept", "reject"))
    return p.groupBy("run_id", "profile").agg(F.min_by("consent_choice", stage_ord(F.col("stage"))).alias("choice"))


def stage_reasons(wanted: DataFrame, gaps: DataFrame) -> DataFrame:
    """(run, profile, stage) with the recorded reason: the profile's own, else any profile's, else not_reached.

    gaps: run_id, ord, stage, profile (null: any), reason. The first recorded one wins.
    """
    first = gaps.groupBy("run_id", "stage", "profile").agg(F.min_by(F.coalesce("reason", F.lit("not_assessable")), "ord").alias("why"))
    own = first.where("profile is not null").withColumnRenamed("why", "_own")
    anyone = first.where("profile is null").select("run_id", "stage", F.col("why").alias("_any"))
    j = wanted.join(own, ["run_id", "stage", "profile"], "left").join(anyone, ["run_id", "stage"], "left")
    return j.withColumn("reason", F.coalesce("_own", "_any", F.lit("not_reached"))).drop("_own", "_any")


def missing_stage_rows(pages: DataFrame, profiles: DataFrame, gaps: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Not-assessed rows for every (profile, stage of a page KPI) without a page, with the stage's reason."""
    catalog = catalog or default_catalog()
    stages = profiles.select("run_id", "profile", F.explode(F.array(*[F.lit(s) for s in K.STAGES])).alias("stage"))
    missing = stages.join(pages.select("run_id", "profile", "stage").distinct(), ["run_id", "profile", "stage"], "left_anti")
    missing = stage_reasons(missing, gaps)
    by_stage = {s: [p for p in catalog.by_producer("checks") if p.scope == "page" and s in (p.stages or K.STAGES)] for s in K.STAGES}
    ids = F.array().cast("array<string>")
    for s, members in by_stage.items():
        ids = F.when(F.col("stage") == s, F.array(*[F.lit(k.id) for k in members])).otherwise(ids)
    return missing.select("run_id", "profile", "stage", F.explode(ids).alias("kpi_id"), "reason").withColumn("assessed", F.lit(False))


def site_any(values: DataFrame) -> DataFrame:
    """(run, profile, kpi): true with the first five page ids that say so. values: ..., page_id, page_ord, flag."""
    key = ["run_id", "profile", "kpi_id"]
    hit = values.where("flag")
    top = hit.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("page_ord"))).where("_r <= 5")
    found = top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "page_id"))), lambda s: s["page_id"]).alias("found_on"))
    base = values.groupBy(*key).agg(F.max("flag").alias("value_bool"))
    return base.join(found, key, "left")


def site_max(values: DataFrame) -> DataFrame:
    """(run, profile, kpi): largest number and its page, the earliest of equals; unavailable when no page has one."""
    key = ["run_id", "profile", "kpi_id"]
    best = F.max(F.when(F.col("number").isNotNull(), F.struct("number", (-F.col("page_ord")).alias("_o"), "page_id")))
    g = values.groupBy(*key).agg(best.alias("_b"))
    return g.select(*key, F.col("_b.number").alias("value_num"), F.col("_b.page_id").alias("page_id"),
                    F.when(F.col("_b").isNull(), F.lit("unavailable")).alias("reason"))


def site_rows(values: DataFrame, gaps: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Site any-KPIs with the completeness rule: a false one needs a readable page of every stage of the KPI.

    values: run_id, profile, kpi_id, page_id, page_ord, stage, flag, reason (why the page cannot be read, or null).
    """
    catalog = catalog or default_catalog()
    key = ["run_id", "profile", "kpi_id"]
    usable = F.col("reason").isNull()
    g = values.groupBy(*key).agg(
        F.max(F.when(usable, F.col("flag"))).alias("value"), F.collect_set(F.when(usable, F.col("stage"))).alias("checked"),
        F.min(F.when(~usable, F.struct("page_ord", "reason"))).alias("_bad"))
    stage_bad = values.where(~usable).groupBy(*key, "stage").agg(F.min_by("reason", "page_ord").alias("page_reason"))
    stages = F.create_map(*[x for k in catalog.kpis.values() if k.stages for x in (F.lit(k.id), F.array(*[F.lit(s) for s in k.stages]))])
    absent = F.array_except(F.coalesce(stages[F.col("kpi_id")], F.array().cast("array<string>")), F.col("checked"))
    order = {s: i for i, s in enumerate(K.STAGES)}
    first_absent = F.lit(None).cast("string")
    for s in reversed(list(order)):
        first_absent = F.when(F.array_contains(absent, s), F.lit(s)).otherwise(first_absent)
    g = g.withColumn("stage", F.when(F.col("value") == F.lit(False), first_absent))
    need = stage_reasons(g.where("stage is not null").select(*key, "stage"), gaps).join(stage_bad, [*key, "stage"], "left")
    need = need.select(*key, F.coalesce("page_reason", "reason").alias("stage_reason"))
    g = g.join(need, key, "left")
    reason = F.when(F.size("checked") == 0, F.col("_bad.reason")).otherwise(F.col("stage_reason"))
    return g.select(*key, F.when(reason.isNull(), F.col("value")).alias("value_bool"), reason.isNull().alias("assessed"), reason.alias("reason"), "stage")


def site_kpis(pages: DataFrame, gaps: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Site observations of the any and max checks from head pages. pages: the flat page table plus the site columns
    (search_present, search_above_fold, search_width, has_contact, has_legal_id, policy_count, has_return_policy,
    has_shipping, payment_logos, shipping_stated, free_shipping, vat_stated, generic_share)."""
    c = F.col
    fail = visit_failure(F.lit(""), c("signals"), c("has_doc"), c("has_ctas"))
    flags = {"FAI.SEARCH_VISIBLE": c("search_present") & c("search_above_fold"), "TRI.CONTACT_INFO": c("has_contact"), "TRI.LEGAL_ID": c("has_legal_id"),
             "TRI.JSONLD_RETURN_POLICY": c("has_return_policy"), "TRI.JSONLD_SHIPPING": c("has_shipping"), "PTI.SHIPPING_COST_PRE_CHECKOUT": c("shipping_stated"),
             "PTI.FREE_SHIPPING_THRESHOLD": c("free_shipping"), "PTI.VAT_STATED": c("vat_stated")}
    numbers = {"FAI.SEARCH_WIDTH": F.when(c("search_width") > 0, c("search_width")), "TRI.POLICY_LINKS": c("policy_count"), "TRI.PAYMENT_LOGOS": c("payment_logos"),
               "CCL.INFO_SCENT_GENERIC": round_half_even(100 * c("generic_share"), 1)}
    catalog = catalog or default_catalog()
    heads = complete_columns(pages).where("repeat_of is null")
    keys = ["run_id", "profile", "page_id", "page_ord", "stage"]

    def unpivot(items: dict, name: str, kind: str) -> DataFrame:
        cells = [F.when(c("stage").isin(*(catalog.kpis[k].stages or K.STAGES)), F.struct(F.lit(k).alias("kpi_id"), v.cast(kind).alias(name))) for k, v in items.items()]
        return heads.select(*keys, fail.alias("reason"), F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(
            *keys, "reason", c("_c.kpi_id").alias("kpi_id"), c("_c")[name].alias(name))

    anys = site_rows(unpivot(flags, "flag", "boolean").withColumn("flag", F.coalesce("flag", F.lit(False))), gaps, catalog)
    maxs = site_max(unpivot(numbers, "number", "double").where("reason is null"))
    return anys.drop("stage").unionByName(maxs.drop("page_id").withColumn("assessed", c("reason").isNull()), allowMissingColumns=True)


def account_rows(pages: DataFrame) -> DataFrame:
    """(run, profile) guest and forced-account values: the readable checkout entry alone decides, else a cart with a
    guest control; otherwise null. pages: run_id, profile, stage, readable, guest_option, login_required."""
    co, cart = F.col("stage") == "checkout_entry", F.col("stage") == "cart"
    guest = F.coalesce("guest_option", F.lit(False)) | ~F.coalesce("login_required", F.lit(False))
    g = pages.groupBy("run_id", "profile").agg(
        F.max(F.when(co & F.col("readable"), guest)).alias("_guest"), F.max(F.when(co & F.col("readable"), ~guest)).alias("_forced"),
        F.max(cart & F.coalesce("guest_option", F.lit(False))).alias("_cart"))
    decided = F.col("_guest").isNotNull()
    return g.select("run_id", "profile", F.when(decided, F.col("_guest")).when(F.col("_cart"), F.lit(True)).alias("guest_checkout"),
                    F.when(decided, F.col("_forced")).when(F.col("_cart"), F.lit(False)).alias("forced_account"),
                    F.when(decided, F.lit("checkout_entry")).when(F.col("_cart"), F.lit("cart")).alias("decided_by"))


def account_observations(pages: DataFrame, profiles: DataFrame, gaps: DataFrame) -> DataFrame:
    """Guest-checkout and forced-account rows of every (run, profile), each with its value or the reason it has none.

    A readable checkout entry decides alone, and its unreadable neighbours keep their reasons. Without one, carts with a
    guest control decide, and say in checkout_reason why the checkout did not. With neither, the unreadable checkout
    pages or the checkout stage's reason stand, and the cart stage's reason too if no cart was reached.

    pages: run_id, profile, stage, page_id, page_ord, readable, reason (of an unreadable page), guest_option,
    login_required; repeats left out. profiles: run_id, profile. gaps: as in ``stage_reasons``.
    """
    key = ["run_id", "profile"]
    co, cart = F.col("stage") == "checkout_entry", F.col("stage") == "cart"
    readable, option = F.coalesce("readable", F.lit(False)), F.coalesce("guest_option", F.lit(False))
    seen = pages.where(co | cart)
    facts = seen.groupBy(*key).agg(
        F.max(co & readable).alias("_decides"), F.max(cart & option).alias("_offers"), F.max(co).alias("_checkout"), F.max(cart).alias("_cart"),
        F.min(F.when(co & ~readable, F.struct("page_ord", F.coalesce("reason", F.lit("not_assessable")).alias("why")))).alias("_failed"))
    stages = profiles.select(*key).distinct()
    wanted = stages.withColumn("stage", F.explode(F.array(F.lit("checkout_entry"), F.lit("cart"))))
    why = stage_reasons(wanted, gaps).groupBy(*key).agg(F.max(F.when(co, F.col("reason"))).alias("_co_why"), F.max(F.when(cart, F.col("reason"))).alias("_cart_why"))
    flags = ("_decides", "_offers", "_checkout", "_cart")
    facts = stages.join(facts, key, "left").join(why, key, "left").na.fill(False, list(flags))
    undecided = ~F.col("_decides") & ~F.col("_offers")
    guest = option | ~F.coalesce("login_required", F.lit(False))
    rows = seen.join(facts, key).withColumn("_kind", F.when(co & readable, "page").when(co & (F.col("_decides") | undecided), "failed").when(cart & option & ~F.col("_decides"), "cart"))
    rows = rows.where("_kind is not null").select(
        *key, "stage", "page_id", F.when(F.col("_kind") == "page", guest).when(F.col("_kind") == "cart", F.lit(True)).alias("_guest"),
        F.when(F.col("_kind") == "failed", F.coalesce("reason", F.lit("not_assessable"))).alias("reason"),
        F.when(F.col("_kind") == "cart", F.coalesce(F.col("_failed.why"), F.col("_co_why"))).alias("checkout_reason"))
    none = F.lit(None).cast(pages.schema["page_id"].dataType)
    missing = F.array_compact(F.array(F.when(~F.col("_checkout"), F.struct(F.lit("checkout_entry").alias("stage"), F.col("_co_why").alias("why"))),
                                      F.when(~F.col("_cart"), F.struct(F.lit("cart").alias("stage"), F.col("_cart_why").alias("why")))))
    gone = facts.where(undecided).select(*key, F.explode(missing).alias("_m")).select(
        *key, "_m.stage", none.alias("page_id"), F.lit(None).cast("boolean").alias("_guest"), F.col("_m.why").alias("reason"), F.lit(None).cast("string").alias("checkout_reason"))
    both = F.array(F.struct(F.lit("FAI.GUEST_CHECKOUT").alias("kpi_id"), F.col("_guest").alias("v")), F.struct(F.lit("FAI.FORCED_ACCOUNT").alias("kpi_id"), (~F.col("_guest")).alias("v")))
    out = rows.unionByName(gone).withColumn("_k", F.explode(both))
    return out.select(*key, "_k.kpi_id", "stage", "page_id", F.col("_k.v").alias("value_bool"), F.col("_k.v").isNotNull().alias("assessed"), "reason", "checkout_reason")


def profile_set(*tables: DataFrame) -> DataFrame:
    """(run, profile): every profile that any of the tables names."""
    named = [t.select("run_id", "profile").where("profile is not null") for t in tables]
    out = named[0]
    for t in named[1:]:
        out = out.unionByName(t)
    return out.distinct()


def missing_stages(pages: DataFrame) -> DataFrame:
    """(run, missing): the stages of the funnel without a page, in funnel order."""
    seen = pages.groupBy("run_id").agg(F.collect_set("stage").alias("_s"))
    return seen.select("run_id", F.array_except(F.array(*[F.lit(s) for s in K.STAGES]), F.col("_s")).alias("missing"))


def distinct_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Statements counted once per number-masked text, first spelling (160 characters) kept."""
    i = items.withColumn("norm", T.mask_numbers(F.col("text"))).where("norm != ''")
    return i.groupBy(*keys, "norm").agg(F.substring(F.min_by("text", "ord"), 1, 160).alias("text"), F.count(F.lit(1)).alias("shown"))


def benefits(items: DataFrame, patterns: list[str], free_shipping: str) -> DataFrame:
    """Statements grouped by the benefit pattern with the longest match, free-shipping wording removed first.

    items: run_id, ord, text. Texts no pattern matches offer nothing.
    """
    rest = F.regexp_replace("text", f"(?iu){free_shipping}", " ")
    found = [F.struct(F.length(F.regexp_extract(rest, f"(?iu)({p})", 1)).alias("len"), F.lit(-i).alias("neg"), F.lit(i).alias("pattern")) for i, p in enumerate(patterns)]
    i = items.withColumn("_b", F.greatest(*found) if len(found) > 1 else found[0]).where("_b.len > 0")
    return i.groupBy("run_id", F.col("_b.pattern").alias("pattern")).agg(F.min_by("text", "ord").alias("text"), F.count(F.lit(1)).alias("n"))


def run_status(runs: DataFrame, pages: DataFrame, gaps: DataFrame) -> DataFrame:
    """failed: no funnel page; complete: every requested stage on every profile, no unaccepted gap, no error; else
    partial. runs: run_id, profiles array, stages array, errors int. gaps: run_id, stage, reason, accepted."""
    wanted = runs.select("run_id", F.explode("profiles").alias("profile"), "stages").select("run_id", "profile", F.explode("stages").alias("stage"))
    lost = wanted.join(pages.select("run_id", "profile", "stage").distinct(), ["run_id", "profile", "stage"], "left_anti")
    lost = lost.groupBy("run_id").agg(F.count(F.lit(1)).alias("_lost"))
    funnel = pages.where(F.col("stage").isin(*K.STAGES)).groupBy("run_id").agg(F.count(F.lit(1)).alias("_pages"))
    open_gaps = gaps.where("not accepted").groupBy("run_id").agg(F.count(F.lit(1)).alias("_gaps"))
    r = runs.join(funnel, "run_id", "left").join(lost, "run_id", "left").join(open_gaps, "run_id", "left")
    fine = F.col("_lost").isNull() & F.col("_gaps").isNull() & (F.coalesce("errors", F.lit(0)) == 0)
    return r.select("run_id", F.when(F.col("_pages").isNull(), F.lit("failed")).when(fine, F.lit("complete")).otherwise(F.lit("partial")).alias("status"))


def all_observations(*producers: DataFrame) -> DataFrame:
    """The producers' rows in one table; columns a producer lacks are null."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def replace_judged(stored: DataFrame, fresh: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Stored rows with every judged row replaced by freshly derived ones (runs whose judgments were requested)."""
    catalog = catalog or default_catalog()
    judged = [k.id for k in catalog.by_producer("judgments")]
    is_judged = F.coalesce(F.col("source") == "judged", F.lit(False)) | F.col("kpi_id").isin(*judged)
    old = stored.where(is_judged).join(fresh.select("run_id").distinct(), "run_id", "left_anti")
    return stored.where(~is_judged).unionByName(old).unionByName(fresh, allowMissingColumns=True)
