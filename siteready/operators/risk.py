"""Consistency and dark-pattern tests over recorded visits, carts, overlays and consent banners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.dims import constants as K
from siteready.functions import text as T
from siteready.functions.numbers import round_half_even
from siteready.operators.components import components
from siteready.operators.scan import stored, with_previous, with_running


TOGETHER = 16_384  # pairs of names of one key that are compared one by one


def same_item_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of labels of one key that name the same item. left: keys, left_id, left_name; right likewise.

    The few names of a short key are compared one by one; keys with more than TOGETHER pairs block on tokens. Both sides
    are read once more to count their keys, so give tables or cheap plans.
    """
    def names(df: DataFrame, side: str) -> DataFrame:
        d = df.withColumn(f"{side}_norm", T.fold(F.col(f"{side}_name"))).withColumn(f"{side}_tok", T.item_tokens(F.col(f"{side}_name")))
        return d.where(F.length(f"{side}_norm") > 0).select(*keys, f"{side}_id", f"{side}_norm", f"{side}_tok")

    def count(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.lit(int(n == side)).alias(f"_{n}") for n in ("left", "right")])

    a, b = names(left, "left"), names(right, "right")
    counts = count(left, "left").unionByName(count(right, "right")).groupBy(*keys).agg(F.sum("_left").alias("_l"), F.sum("_right").alias("_r"))
    crowded = stored(counts.where(F.col("_l") * F.col("_r") > TOGETHER).select(*keys), "crowded")
    if crowded.isEmpty():
        met = a.join(b, keys)
    else:
        few = a.join(crowded, keys, "left_anti").join(b, keys)
        met = few.unionByName(_met_on_tokens(a.join(crowded, keys, "left_semi"), b.join(crowded, keys, "left_semi"), keys).select(*few.columns))
    met = met.where(T.same_item(F.col("left_norm"), F.col("right_norm"), F.col("left_tok"), F.col("right_tok")))
    return met.select(*keys, "left_id", "right_id").distinct()


def _met_on_tokens(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Names of one key that may name the same item: they share a rare enough token, never all with all.

    A match shares 60 % of all tokens, or one side's tokens are all in the other. So one side's rarest tokens (as many
    as a 60 % match cannot all miss) against every token of the other, plus the reverse with the single rarest, find
    every match exactly.
    """
    def blocks(df: DataFrame, side: str) -> DataFrame:
        tokens = F.when(F.size(f"{side}_tok") > 0, F.col(f"{side}_tok")).otherwise(F.array(f"{side}_norm"))
        return df.withColumn("_t", F.explode(tokens))

    a, b = blocks(left, "left"), blocks(right, "right")
    seen = a.select(*keys, "_t").unionByName(b.select(*keys, "_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_c"))

    def rare(df: DataFrame, side: str, keep: Column) -> DataFrame:
        by = Window.partitionBy(*keys, f"{side}_id").orderBy("_c", "_t")  # the tokens of one name: a handful
        return df.join(seen, [*keys, "_t"]).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= keep).drop("_r", "_c")

    n = F.greatest(F.lit(1), F.size("left_tok"))
    prefix = rare(a, "left", n - F.ceil(n * F.lit(0.6)) + 1)
    rarest = rare(b, "right", F.lit(1))
    return prefix.join(b, [*keys, "_t"]).unionByName(a.join(rarest, [*keys, "_t"]))


def name_groups(items: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Distinct names per key with their row count: what similarity joins should run on, so equal names meet once."""
    return items.groupBy(*keys, T.fold(F.col(name)).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def same_product(a_url: Column, b_url: Column, a_sku: Column, b_sku: Column, a_title: Column, b_title: Column) -> Column:
    """Same URL, else same sku where both have one, else titles equal or one extending the other by a word."""
    x, y = T.fold(a_title), T.fold(b_title)
    title = (F.length(x) > 0) & (F.length(y) > 0) & ((x == y) | F.startswith(x, F.concat(y, F.lit(" "))) | F.startswith(y, F.concat(x, F.lit(" "))))
    return F.coalesce(F.when(F.coalesce(a_url == b_url, F.lit(False)), F.lit(True))
                      .when((a_sku != "") & (b_sku != ""), T.fold(a_sku) == T.fold(b_sku)).otherwise(title), F.lit(False))


def product_clusters(visits: DataFrame, keys: list[str], id: str = "visit_id") -> DataFrame:
    """keys, id, product: the least id of all visits that show one product, over any number of steps.

    Two visits show one product as ``same_product`` says. Visits never meet as pairs: those with one URL or one sku meet
    at a node for it. A title decides only where one of the two has no sku, so visits without a sku meet at a node for
    their title, and every visit joins the nodes of titles that its own extends by a word or that extend its own; a
    title of n words looks up n beginnings. Ids are longs, unique within the keys.
    """
    n = F.coalesce(T.fold(F.col("sku")), F.lit(""))
    rows = visits.select(*keys, F.col(id).cast("long").alias("_id"), F.coalesce("url", F.lit("")).alias("_url"), n.alias("_sku"), F.coalesce(T.fold(F.col("title")), F.lit("")).alias("_title"))

    def node(kind: str, value: Column) -> Column:
        where = [F.lit(kind), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], value]
        return F.struct(F.lit(1).alias("kind"), F.xxhash64(*where).alias("x"), F.xxhash64(F.lit("and"), *where).alias("y"))

    at = F.struct(F.lit(0).alias("kind"), F.col("_id").alias("x"), F.xxhash64(*keys).alias("y"))
    rows = rows.withColumn("a", at)
    urls = rows.where("_url != ''").select("a", node("url", F.col("_url")).alias("b"))
    skus = rows.where("_sku != ''").select("a", node("sku", F.col("_sku")).alias("b"))
    titled = rows.where("_title != ''")
    bare = titled.where("_sku = ''")
    own = bare.select("a", node("title", F.col("_title")).alias("b"))
    words = F.split("_title", " ", -1)
    begins = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
    # Titles by their beginnings: a title meets the shorter ones it extends, equal ones included.
    titles = titled.groupBy(*keys, "_title").agg(F.max(F.col("_sku") == "").alias("_bare"))
    shorter = titles.select(*keys, F.col("_title").alias("_short"), F.col("_bare").alias("_short_bare"))
    pairs = titles.withColumn("_short", F.explode(begins)).join(shorter, [*keys, "_short"])
    up = pairs.where("_short_bare").select(*keys, "_title", node("title", F.col("_short")).alias("b"))
    down = pairs.where("_bare").select(*keys, F.col("_short").alias("_title"), node("title", F.col("_title")).alias("b"))
    extended = titled.join(up.unionByName(down).distinct(), [*keys, "_title"]).select("a", "b")
    found = components(urls.unionByName(skus).unionByName(own).unionByName(extended))
    out = rows.join(found, F.col("a") == F.col("node"), "left")
    return out.select(*keys, F.col("_id").alias(id), F.coalesce(F.col("component.x"), F.col("_id")).alias("product"))


def sneak_into_basket(lines: DataFrame, added: DataFrame) -> DataFrame:
    """Per cart: confidence that items were added unasked, or why it cannot be told.

    lines: run_id, line_id, title, price_value, addon. added: run_id, title. A line is the shopper's when it names the
    added item; an add-on named after the item is not.
    """
    # A run's few added titles travel as one list, so that a line counts once however many there are.
    a = added.groupBy("run_id").agg(F.collect_set(F.struct(T.fold(F.col("title")).alias("n"), T.item_tokens(F.col("title")).alias("t"))).alias("_added"))
    j = lines.join(a, "run_id")
    norm, tok = T.fold(F.col("title")), T.item_tokens(F.col("title"))
    mine = lambda x: F.coalesce(T.same_item(norm, x["n"], tok, x["t"]) & (~F.col("addon") | (F.size(F.array_except(tok, x["t"])) == 0)), F.lit(False))
    j = j.withColumn("ours", F.exists("_added", mine))
    extra = ~F.col("ours") & (F.coalesce("price_value", F.lit(0.0)) > 0)
    g = j.groupBy("run_id").agg(F.max("ours").alias("_ours"), F.count_if(extra).alias("unrequested"), F.max(extra & F.col("addon")).alias("_addon"))
    conf = F.when(F.col("unrequested") == 0, 0.0).when(F.col("_addon"), 1.0).otherwise(0.8)
    return g.select("run_id", F.when(F.col("_ours"), conf).alias("confidence"), "unrequested",
                    F.when(~F.col("_ours"), F.lit("added_item_not_recognised")).alias("reason"))


def prechecked(items: DataFrame) -> DataFrame:
    """Per run: 1.0 when a priced pre-checked add-on is offered; other priced boxes are evidence only."""
    priced = (F.coalesce("price_value", F.lit(0.0)) > 0) | F.coalesce(F.col("price_text") != "", F.lit(False))
    addon = priced & F.coalesce("addon", F.lit(True))
    return items.groupBy("run_id").agg(F.max(F.when(addon, 1.0).otherwise(0.0)).alias("confidence"), F.count_if(addon).alias("addons"),
                                       F.count_if(priced & ~F.coalesce("addon", F.lit(True))).alias("other_prechecked"))


FOLDED = 4096  # a run's fee lines and told words that one task may hold together


def _explained_by_run(fees: DataFrame, told: DataFrame) -> DataFrame:
    """Adds explained: all words of all lines of the fee are told (null without run or fee). A run's words are one list."""
    words = T.words(F.col("label"), 4)
    here = F.coalesce("_told", F.array().cast("array<string>"))
    rows = fees.withColumn("_words", words).join(told.groupBy("run_id").agg(F.collect_set("word").alias("_told")), "run_id", "left")
    rows = rows.withColumn("_all", (F.size("_words") > 0) & (F.size(F.array_except("_words", here)) == 0)).drop("_words", "_told")
    known = F.col("run_id").isNotNull() & F.col("fee_id").isNotNull()
    return rows.withColumn("explained", F.when(known, F.min("_all").over(Window.partitionBy("run_id", "fee_id")))).drop("_all")


def _explained_by_word(fees: DataFrame, told: DataFrame) -> DataFrame:
    """The same for runs of any length: words meet one by one."""
    need = fees.select("run_id", "fee_id", F.explode_outer(F.array_distinct(T.words(F.col("label"), 4))).alias("word"))
    known = need.join(told.distinct().withColumn("_told", F.lit(True)), ["run_id", "word"], "left").groupBy("run_id", "fee_id").agg(
        F.min(F.col("word").isNotNull() & F.col("_told").isNotNull()).alias("explained"))
    return fees.join(known, ["run_id", "fee_id"], "left").select(*fees.columns, "explained")


def unexplained_fees(fees: DataFrame, told_words: DataFrame, counted: DataFrame, lexicon, shipping: DataFrame | None = None) -> DataFrame:
    """Fee lines of a run that its product page does not announce. fees: run_id, fee_id, label, value.

    A fee is explained when all its words (4+ letters) appear on the product page (told_words: run_id, word); tax lines
    and lines other tests count (counted: run_id, label) are left out. With shipping (run_id: the product page states
    shipping or a free-shipping threshold) a shipping line is explained by that statement, and by nothing else.
    """
    f = fees.where(F.coalesce("value", F.lit(0.0)) > 0).withColumn("label", T.squash(F.col("label"))).where("label != ''")
    tax = lexicon.hit("tax_line", F.col("label")) & ~lexicon.hit("customs", F.col("label"))
    # patterns are read once for each line, whatever reads the lines later
    freight = F.lit(False) if shipping is None else lexicon.hit("shipping", F.col("label"))
    f = stored(f.where(~tax).select("run_id", "fee_id", "label", T.mask_numbers(F.col("label")).alias("norm"), freight.alias("freight")), "fees")
    left = f.select("run_id", F.col("fee_id").alias("left_id"), F.col("label").alias("left_name"))
    right = stored(counted.select("run_id", F.col("label").alias("right_name")).distinct(), "counted").withColumn("right_id", F.col("right_name"))
    dup = same_item_join(left, right, ["run_id"]).select("run_id", F.col("left_id").alias("fee_id")).distinct()
    told = told_words.select("run_id", "word")
    crowded = f.select("run_id").unionByName(told.select("run_id")).groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    crowded = stored(crowded.where(F.col("_n") > FOLDED).select("run_id"), "crowded")
    f = f.join(dup, ["run_id", "fee_id"], "left_anti")
    if crowded.isEmpty():
        rows = _explained_by_run(f, told)
    else:
        short, long = ([df.join(crowded, "run_id", how) for df in (f, told)] for how in ("left_anti", "left_semi"))
        rows = _explained_by_run(*short).unionByName(_explained_by_word(*long))
    if shipping is not None:
        rows = rows.join(shipping.select("run_id").distinct().withColumn("_stated", F.lit(True)), "run_id", "left")
        open_fees = rows.where(F.when(F.col("freight"), F.col("_stated").isNull()).otherwise(~F.col("explained")))
    else:
        open_fees = rows.where(~F.col("explained"))
    return open_fees.groupBy("run_id").agg(F.count_distinct("norm").alias("unexplained"))


def fee_results(runs: DataFrame, unexplained: DataFrame) -> DataFrame:
    """Per run: the number of unexplained fees, or why there is none to give.

    runs: run_id, product_reason and cart_reason (null: the page is there), empty (no item in cart and checkout).
    unexplained: ``unexplained_fees``.
    """
    reason = F.coalesce("product_reason", "cart_reason", F.when(F.coalesce("empty", F.lit(False)), F.lit("empty_cart")))
    j = runs.join(unexplained, "run_id", "left").withColumn("reason", reason)
    return j.select("run_id", F.when(F.col("reason").isNull(), F.coalesce("unexplained", F.lit(0))).alias("unexplained"), "reason")


def pair_countdowns(first: DataFrame, second: DataFrame) -> DataFrame:
    """Timers of two visits paired by digit-masked text in order; by position only when each visit shows one timer and
    their words agree. Inputs: run_id, pos, text, remaining_s."""
    def ranked(df: DataFrame, s: str) -> DataFrame:
        r = df.withColumn("mask", T.mask_digits(F.col("text")))
        r = r.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "mask").orderBy("pos")))
        return r.select("run_id", "mask", "rank", F.col("pos").alias(f"pos{s}"), F.col("remaining_s").alias(f"s{s}"))
    a, b = ranked(first, "1"), ranked(second, "2")
    exact = a.join(b, ["run_id", "mask", "rank"]).select("run_id", "pos1", "pos2", "s1", "s2")
    one = lambda df, s: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"n{s}"), F.first("mask").alias(f"m{s}"), F.first(f"pos{s}").alias(f"pos{s}"),
                                                 F.first(f"s{s}").alias(f"s{s}"))
    lone = one(a, "1").join(one(b, "2"), "run_id").where("n1 = 1 and n2 = 1 and m1 <> m2")
    lone = lone.where(T.same_item(F.col("m1"), F.col("m2"), T.item_tokens(F.col("m1")), T.item_tokens(F.col("m2"))))
    return exact.unionByName(lone.select("run_id", "pos1", "pos2", "s1", "s2"))


def ticking(first: DataFrame, second: DataFrame, elapsed: Column) -> DataFrame:
    """Timers of a first reading with `ticks`: the second reading, elapsed seconds later, is lower by 1 s up to
    elapsed + 2 s. Masked twins pair first, in order; the others by list position."""
    a = first.withColumn("mask", T.mask_digits(F.col("text")))
    a = a.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "mask").orderBy("pos")))
    b = second.withColumn("mask", T.mask_digits(F.col("text")))
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "mask").orderBy("pos")))
    twin = b.select("run_id", "mask", "rank", F.col("remaining_s").alias("_twin"))
    by_pos = b.select("run_id", "pos", F.col("remaining_s").alias("_pos"))
    j = a.join(twin, ["run_id", "mask", "rank"], "left").join(by_pos, ["run_id", "pos"], "left")
    drop = F.col("remaining_s") - F.coalesce("_twin", "_pos")
    return j.select("run_id", "pos", "text", "remaining_s", F.coalesce((drop >= 1) & (drop <= elapsed + 2), F.lit(False)).alias("ticks"))


def countdown_reset(pairs: DataFrame, elapsed: DataFrame) -> DataFrame:
    """Per run: the worst pair and its confidence: 1.0 when the timer restarted, 0.8 when it moved too little."""
    j = pairs.join(elapsed, "run_id").withColumn("decrease_s", round_half_even(F.col("s1") - F.col("s2"), 1))
    g = j.groupBy("run_id").agg(F.first("elapsed").alias("elapsed"), F.count(F.lit(1)).alias("pairs"),
                                F.min(F.struct("decrease_s", "pos1", (F.col("s1") - F.col("s2")).alias("exact"))).alias("_w"))
    tol = F.greatest(F.lit(2.0), F.lit(0.2) * F.col("elapsed"))
    reset = F.col("_w.exact") < F.col("elapsed") - tol
    conf = F.when(~reset, 0.0).when(F.col("_w.decrease_s") <= round_half_even(tol, 1), 1.0).otherwise(0.8)
    return g.select("run_id", "pairs", F.col("_w.decrease_s").alias("decrease_s"), round_half_even(tol, 1).alias("tolerance_s"), reset.alias("reset"), conf.alias("confidence"))


def extreme(rows: DataFrame, keys: list[str], value: Column, witness: list[str], largest: bool = False) -> DataFrame:
    """keys, value, witness columns: the smallest (or largest) value of each key and the first row that has it."""
    pick = F.max(F.struct((-value if not largest else value).alias("v"), *[(-F.col(w)).alias(w) for w in witness]))
    out = rows.groupBy(*keys).agg(pick.alias("_p"))
    return out.select(*keys, (F.col("_p.v") if largest else -F.col("_p.v")).alias("value"), *[(-F.col("_p")[w]).alias(w) for w in witness])


def countdown_outcome(visits: DataFrame, resets: DataFrame) -> DataFrame:
    """Per run: whether the countdown test could be made, whether a timer was found, else why not; with the reset result.

    Only ticking timers count. Two visits without any are no finding, unless a timer was there that was not verified
    to tick, or the funnel page showed one; timers on one visit only, or none that pair up, leave the test open.
    visits: run_id, first, second (the visit was made), failure (why not), first_timers, second_timers (ticking ones),
    static, unverified, funnel_timers (numbers). resets: ``countdown_reset``.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    made = F.coalesce("first", F.lit(False)) & F.coalesce("second", F.lit(False))
    neither, one = (n("first_timers") + n("second_timers")) == 0, (n("first_timers") == 0) != (n("second_timers") == 0)
    reason = (F.when(~made, F.coalesce("failure", F.lit("product_page_not_visited_twice")))
              .when(neither & (n("static") == 0) & (n("unverified") > 0), "ticking_not_verified")
              .when(neither & (n("static") == 0) & (n("funnel_timers") > 0), "countdown_not_seen_on_revisit")
              .when(one, "countdown_seen_once").when(~neither & F.col("pairs").isNull(), "countdown_not_paired"))
    j = visits.join(resets, "run_id", "left").withColumn("reason", reason)
    told = F.col("reason").isNull()
    result = [F.when(told & ~neither, F.col(c)).alias(c) for c in ("decrease_s", "tolerance_s", "reset", "confidence")]
    return j.select("run_id", told.alias("assessed"), F.when(told, ~neither).alias("found"), "reason", *result)


def without_site_copy(stock: DataFrame, site_texts: DataFrame) -> DataFrame:
    """Stock statements that are not site copy: not also shown outside cards on the home or listing page."""
    copy = site_texts.select("run_id", T.fold(F.substring("text", 1, 160)).alias("_n")).distinct()
    return stock.withColumn("_n", T.fold(F.substring("text", 1, 160))).join(copy, ["run_id", "_n"], "left_anti").drop("_n")


def visit_pairs(visits: DataFrame) -> DataFrame:
    """Visits of one product in time order with the number of the visit before. visits: run_id, product, t, number."""
    v = with_previous(visits, ["run_id", "product"], "t", ["number"], 1)
    return v.select("run_id", "product", "t", "number", F.col("prev1.number").alias("before"),
                    (F.col("number") != F.col("prev1.number")).alias("changed"), (F.col("number") < F.col("prev1.number")).alias("decreased"))


def low_stock(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Per run: confidence that low-stock messages are fake.

    products: run_id, product, number, inventory_level, offers, availability (one row per distinct product). changes:
    run_id, changed, decreased. One-unit items and numbers the structured data confirms stay out of the shared count.
    """
    level, num = F.col("inventory_level"), F.col("number")
    confirmed = F.coalesce(level == num, F.lit(False))
    p = products.withColumn("_level", F.coalesce(level != num, F.lit(False))).withColumn(
        "_gone", F.coalesce((F.col("offers") == 1) & F.col("availability").isin(*K.GONE) & (num >= 1), F.lit(False)))
    shared = (p.where((num != 1) & ~confirmed).groupBy("run_id", "number").agg(F.count(F.lit(1)).alias("c"))
              .groupBy("run_id").agg(F.max("c").alias("same")))
    sig = p.groupBy("run_id").agg(F.max(F.when(F.col("_level"), 0.8).when(F.col("_gone"), 0.6).otherwise(0.0)).alias("contradicted"))
    ch = changes.groupBy("run_id").agg(F.max(F.when(F.col("decreased"), 0.8).when(F.col("changed"), 0.6).otherwise(0.0)).alias("change"))
    j = sig.join(shared, "run_id", "left").join(ch, "run_id", "left").na.fill(0)
    same = F.when(F.col("same") >= 3, 0.8).when(F.col("same") == 2, 0.4).otherwise(0.0)
    strong = (F.col("change") > 0).cast("int") + (same >= 0.8).cast("int") + (F.col("contradicted") > 0).cast("int")
    return j.select("run_id", F.col("same").alias("same_number_products"), F.when(strong >= 2, 0.9).otherwise(F.greatest("change", same, "contradicted")).alias("confidence"))


def tab_epochs(pages: DataFrame) -> DataFrame:
    """Pages with the epoch of their tab: a new epoch whenever the tab id changes. pages: run_id, ord, tab."""
    p = with_previous(pages, ["run_id"], "ord", ["tab"], 1)
    return with_running(p, ["run_id"], "ord", {"epoch": F.when(F.col("prev1").isNull() | (F.col("prev1.tab") != F.col("tab")), 1).otherwise(0)}).drop("prev1")


def repeated_overlays(shown: DataFrame, closed: DataFrame) -> DataFrame:
    """Overlays shown again after they were closed earlier in the same tab epoch, with how many pages show them (the
    closing page included). shown and closed: run_id, epoch, ord, page_id, key."""
    first = closed.groupBy("run_id", "epoch", "key").agg(F.min("ord").alias("_closed"), F.min_by("page_id", "ord").alias("closed_on"))
    again = shown.join(first, ["run_id", "epoch", "key"]).where(F.col("ord") > F.col("_closed"))
    return again.groupBy("run_id", "key").agg(F.count(F.lit(1)).alias("again"), F.min(F.struct("_closed", "closed_on")).alias("_f")).select(
        "run_id", "key", (F.col("again") + 1).alias("pages"), F.col("_f.closed_on").alias("closed_on"))


def nagging(repeated: DataFrame, reappeared: DataFrame) -> DataFrame:
    """Per run: 0.9 when an overlay came back after a reload, else by the most pages one repeated overlay took."""
    most = repeated.groupBy("run_id").agg(F.max("pages").alias("most"))
    j = reappeared.join(most, "run_id", "left")
    conf = F.when(F.col("reappeared"), 0.9).when(F.col("most") >= 3, 0.8).when(F.col("most") == 2, 0.6).otherwise(0.0)
    return j.select("run_id", F.coalesce("most", F.lit(0)).alias("most"), conf.alias("confidence"))


def consent_asymmetry(buttons: DataFrame, banners: DataFrame) -> DataFrame:
    """Per run: how much harder refusing is than accepting on the consent banner's first layer.

    buttons: run_id, kind, area, contrast, filled, ord. banners: run_id, clicks_to_reject, second_layer_checked,
    reject_kind. The largest control per kind counts, the first of equals.
    """
    top = buttons.groupBy("run_id", "kind").agg(F.max(F.struct(F.coalesce("area", F.lit(0.0)).alias("area"), (-F.col("ord")).alias("_o"), "contrast", "filled")).alias("b"))
    p = top.groupBy("run_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("b"))).alias(k) for k in ("accept", "reject", "close", "manage")],
                                  F.array_sort(F.collect_set("kind")).alias("kinds"))
    j = banners.join(p, "run_id", "left")
    reject = F.coalesce("reject", F.when(F.col("reject_kind") == "close", F.col("close")))
    j = j.withColumn("_r", reject)
    notice = F.array_join("kinds", ",") == "close"
    ratio = F.coalesce("_r.area", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce("accept.area", F.lit(0.0)))
    styled = F.col("accept.filled") & ~F.coalesce("_r.filled", F.lit(False)) & (F.coalesce("_r.contrast", F.lit(0.0)) < F.coalesce("accept.contrast", F.lit(0.0)))
    soft = (F.col("clicks_to_reject") == 2) | (F.col("second_layer_checked") == F.lit(False))
    conf = (F.when(F.col("accept").isNull(), F.when(notice, 0.0))
            .when(F.col("_r").isNull(), F.when(F.coalesce(soft, F.lit(False)), 0.8).otherwise(1.0))
            .when(ratio < 0.25, 0.8).when(ratio < 0.5, 0.6).when(styled, 0.3).otherwise(0.0))
    return j.select("run_id", conf.alias("confidence"), F.when(F.col("accept").isNull() & ~F.coalesce(notice, F.lit(False)), F.lit("accept_not_recognised")).alias("reason"))


def risk_rows(profiles: DataFrame, tests: DataFrame, reasons: DataFrame, kpis: list[str]) -> DataFrame:
    """One observation per (profile, risk KPI): not run, its stage's own reason, the test's reason, or the confidence.

    tests: run_id, profile, kpi_id, assessed, confidence, reason, stage, stage_missing. reasons: run_id, profile,
    stage, stage_reason.
    """
    rows = profiles.withColumn("kpi_id", F.explode(F.array(*[F.lit(k) for k in kpis])))
    j = rows.join(tests, ["run_id", "profile", "kpi_id"], "left").join(reasons, ["run_id", "profile", "stage"], "left")
    missing = F.coalesce("stage_missing", F.lit(False)) & F.col("stage").isNotNull()
    why = (F.when(F.col("assessed").isNull(), F.lit("deception_not_run"))
           .when(~F.col("assessed"), F.when(missing, F.coalesce("stage_reason", F.lit("not_reached"))).otherwise(F.coalesce("reason", F.lit("not_assessed"))))
           .when(F.col("confidence").isNull(), F.col("reason")))
    return j.select("run_id", "profile", "kpi_id", F.when(why.isNull(), round_half_even(F.col("confidence"), 3)).alias("value_num"), why.isNull().alias("assessed"), why.alias("reason"))


# ---------------------------------------------------------------- carts and outcome oracles
def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.05), F.lit(0.01) * F.greatest(F.abs(a), F.abs(b)))


def cart_reading(lines: DataFrame, carts: DataFrame) -> DataFrame:
    """Per cart: whether row prices are line totals or unit prices, as the subtotal decides; null when it does not.

    lines: run_id, qty, price. carts: run_id, subtotal.
    """
    g = lines.groupBy("run_id").agg(F.sum("price").alias("_t"), F.sum(F.col("price") * F.col("qty")).alias("_u"),
                                    F.count_if(F.col("price").isNull()).alias("_np"), F.max("qty").alias("_q"))
    j = carts.join(g, "run_id", "left")
    total, unit = close_to(F.col("_t"), F.col("subtotal")), close_to(F.col("_u"), F.col("subtotal"))
    known = (F.col("_np") == 0) & (F.col("_q") > 1) & F.col("subtotal").isNotNull()
    return j.select("run_id", F.when(known & total & ~unit, F.lit("line_total")).when(known & unit & ~total, F.lit("unit")).alias("reading"))


def unit_prices(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """Lines with unit_price and how it reads; an ambiguous row keeps its price and a lower candidate.

    Without a subtotal, two amounts in the row decide when one is the other times the quantity (amounts: array).
    """
    j = lines.join(readings, "run_id", "left")
    low, high = F.array_min("amounts"), F.array_max("amounts")
    by_row = (F.size("amounts") >= 2) & close_to(high, low * F.col("qty")) & (close_to(F.col("price"), low) | close_to(F.col("price"), high))
    per = round_half_even(F.col("price") / F.col("qty"), 2)
    how = (F.when(F.col("price").isNull() | (F.col("qty") <= 1), F.lit("unit")).when(F.col("reading").isNotNull(), F.col("reading"))
           .when(F.coalesce(by_row, F.lit(False)), F.when(close_to(F.col("price"), low), F.lit("unit")).otherwise(F.lit("line_total"))).otherwise(F.lit("ambiguous")))
    value = (F.when((F.col("qty") > 1) & F.col("reading").isNull() & F.coalesce(by_row, F.lit(False)), low)
             .when((F.col("qty") > 1) & (F.col("reading") == "line_total"), per).otherwise(F.col("price")))
    return j.withColumn("how", how).withColumn("unit_price", value).withColumn("candidate", F.when(F.col("how") == "ambiguous", F.least(per, F.col("price"))))


def row_amounts(text: Column) -> Column:
    """Currency-marked amounts of a cart row (or with two decimals), distinct; never a bare quantity."""
    marked = F.regexp_extract_all(text, F.lit(r"(?i)((?:[€$£]|\b(?:eur|euro|usd|gbp|chf)\b)\s?\d[\d.,']*|\d[\d.,']*\s?(?:[€$£]|\b(?:eur|euro|usd|gbp|chf)\b)|\d+[.,]\d{2}(?!\d))"), 1)
    return F.array_distinct(F.filter(F.transform(marked, T.parse_price), lambda v: v > 0))


def verify_cart(lines: DataFrame, carts: DataFrame, max_price: Column | None = None) -> DataFrame:
    """cart_not_empty, and cart_contains_item_under_price when a limit is given: true, false, or null with a reason.

    lines: run_id, title, qty, price, addon, amounts. carts: run_id, subtotal, total, marked_empty, unreadable.
    """
    priced = unit_prices(lines, cart_reading(lines, carts)).where("not addon and length(title) >= 2")
    limit = F.lit(None).cast("double") if max_price is None else max_price
    priced = priced.withColumn("_limit", limit)
    nameless = lines.where("not addon and length(title) < 2").groupBy("run_id").agg(F.count(F.lit(1)).alias("_nameless"))
    g = priced.groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("unit_price") <= F.col("_limit")).alias("matching"),
                                     F.max(F.col("candidate") <= F.col("_limit")).alias("_ambiguous"), F.max(F.col("unit_price").isNull()).alias("_noprice"))
    any_rows = lines.groupBy("run_id").agg(F.count(F.lit(1)).alias("_rows"))
    j = carts.join(g, "run_id", "left").join(nameless, "run_id", "left").join(any_rows, "run_id", "left").na.fill(0, ["items", "matching"])
    shown = F.when(F.col("subtotal").isNotNull(), F.col("subtotal") > 0).otherwise(F.coalesce(F.col("total") > 0, F.lit(False)))
    blind = (F.col("items") == 0) & (F.col("_nameless").isNotNull() | (F.col("_rows").isNull() & ~F.coalesce("marked_empty", F.lit(False)) & shown))
    unreadable = F.coalesce("unreadable", F.when(blind, F.lit("cart_items_unreadable")))
    if max_price is None:
        why = F.when(F.col("items") == 0, unreadable)
        return j.select("run_id", F.when(why.isNull(), F.col("items") > 0).alias("passed"), why.alias("not_assessable"))
    no = F.lit(False)
    why = F.when(F.col("matching") == 0, F.when(F.col("unreadable").isin("cart_unreadable", "final_page_unreadable"), F.col("unreadable"))
                 .when(F.coalesce("_ambiguous", no), F.lit("cart_price_ambiguous")).when(F.coalesce("_noprice", no), F.lit("cart_price_unreadable")).otherwise(unreadable))
    return j.select("run_id", F.when(why.isNull(), F.col("matching") > 0).alias("passed"), why.alias("not_assessable"))


def funnel_delta(steps: DataFrame, base: DataFrame) -> DataFrame:
    """Per run: largest unexplained rise (%) of cart and checkout totals over the product price times quantity.

    steps: run_id, stage, total, subtotal, shipping, tax, empty. base: run_id, price, qty. Shipping and added tax are
    taken off a total; without a total the subtotal is compared.
    """
    has_total = F.col("total").isNotNull()
    tax = F.coalesce("tax", F.lit(0.0))
    added = F.when(has_total & F.col("subtotal").isNotNull() & (F.col("total") - tax >= F.col("subtotal") + F.coalesce("shipping", F.lit(0.0)) - 0.01), tax).otherwise(0.0)
    paid = F.when(has_total, F.col("total") - F.coalesce("shipping", F.lit(0.0)) - added).otherwise(F.col("subtotal"))
    j = base.join(steps, "run_id")
    expected = F.col("price") * F.col("qty")
    delta = F.greatest(F.lit(0.0), (paid - expected) / expected * 100)
    usable = ~F.col("empty") & paid.isNotNull()
    g = j.withColumn("_d", F.when(usable, round_half_even(delta, 1))).groupBy("run_id").agg(
        F.max("_d").alias("delta"), F.max("empty").alias("_e"), F.first("price").alias("_p"))
    why = F.when(F.coalesce(F.col("_p"), F.lit(0.0)) == 0, F.lit("no_product_price")).when(
        F.col("delta").isNull(), F.when(F.col("_e"), F.lit("empty_cart")).otherwise(F.lit("no_cart_total")))
    return g.select("run_id", F.when(why.isNull(), F.col("delta")).alias("delta"), why.alias("reason"))


def query_hits(query: Column, haystack: Column, stop: tuple[str, ...]) -> Column:
    """The query's own words (3+ letters, stop words off unless nothing else is left) found in the text, sorted."""
    words, own = T.words(query, 3), F.filter(T.words(query, 3), lambda w: ~w.isin(*stop))
    wanted = F.when(F.size(own) > 0, own).otherwise(words)
    return F.array_sort(F.array_intersect(wanted, T.words(haystack, 3)))


def verify_page(pages: DataFrame, want: str, stop: tuple[str, ...]) -> DataFrame:
    """pdp_reached or search_results_shown on final pages: null with a reason when the page could not be read.

    pages: run_id, page_type, on_site, readable, title, price, results, no_results_text, query, max_price.
    """
    hit = F.col("query").isNull() | (F.size(query_hits(F.col("query"), F.col("title"), stop)) > 0)
    if want == "pdp_reached":
        cheap = F.col("max_price").isNull() | F.coalesce(F.col("price") <= F.col("max_price"), F.lit(False))
        ok = (F.col("page_type") == "pdp") & F.col("on_site") & hit & cheap
    else:
        ok = (F.col("page_type") == "plp") & (F.coalesce("results", F.lit(0)) >= 1) & F.col("on_site") & F.coalesce(F.col("no_results_text") == "", F.lit(True)) & hit
    return pages.select("run_id", F.when(F.col("readable"), F.coalesce(ok, F.lit(False))).alias("passed"),
                        F.when(~F.col("readable"), F.lit("final_page_unreadable")).alias("not_assessable"))
