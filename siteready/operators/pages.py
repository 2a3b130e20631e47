"""Raw pages and text -> page features, structured data, prices, persuasion, snippets, language, page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.dims import constants as K
from siteready.functions import text as T
from siteready.functions import urls as U
from siteready.functions.lexicon import Lexicon, effective_language
from siteready.functions.numbers import round_half_even

# ---------------------------------------------------------------- HTML
SCRIPTS = r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->"


def strip_tags(html: Column) -> Column:
    return T.squash(F.regexp_replace(F.regexp_replace(html, SCRIPTS, " "), r"(?s)<[^>]+>", " "))


def page_features(pages: DataFrame) -> DataFrame:
    """One row of features per raw page: language, title, headings, links, images, frames, text size.

    Regular expressions only, so the whole job is one projection over the scan. Geometry, visibility and contrast need
    a browser and are inputs elsewhere. pages: page_id, url, html.
    """
    body = F.regexp_replace("html", SCRIPTS, " ")
    p = pages.select("page_id", "url", "html", body.alias("_b"))
    count = lambda pattern: F.size(F.regexp_extract_all("_b", F.lit(pattern), 0))
    tag = lambda name: T.squash(F.regexp_replace(F.regexp_extract("_b", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<[^>]+>", " "))
    images = r"(?i)<img\b[^>]*>"
    with_alt = r"(?i)<img\b[^>]*\balt\s*=[^>]*>"
    return p.select(
        "page_id", "url", F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)).alias("lang"),
        tag("title").alias("title"), tag("h1").alias("h1_text"), count(r"(?i)<h1\b").alias("h1"), count(r"(?i)<h2\b").alias("h2"),
        count(r"(?i)<a\b[^>]*\bhref\s*=").alias("links"), (count(images) - count(with_alt)).alias("img_missing_alt"),
        count(r"(?i)<iframe\b").alias("frames"), count(r"(?i)<p\b").alias("paragraphs"),
        F.length(T.squash(F.regexp_replace("_b", r"(?s)<[^>]+>", " "))).alias("text_chars"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, label of every link, in page order."""
    body = F.regexp_replace("html", SCRIPTS, " ")
    pattern = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    hrefs, labels = F.regexp_extract_all(body, F.lit(pattern), 1), F.regexp_extract_all(body, F.lit(pattern), 2)
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("pos", "_l"))
    return rows.select("page_id", "url", "pos", F.col("_l.href").alias("href"), T.squash(F.regexp_replace("_l.label", r"<[^>]+>", " ")).alias("label"))


def absolute(href: Column, base: Column) -> Column:
    """A link's URL on its page's site, without its fragment."""
    root = F.concat(U.scheme(base), F.lit("://"), U.authority(base))
    clean = F.regexp_replace(href, "#.*$", "")
    return (F.when(clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), clean).when(F.startswith(clean, F.lit("//")), F.concat(U.scheme(base), F.lit(":"), clean))
            .when(F.startswith(clean, F.lit("/")), F.concat(root, clean)).otherwise(F.concat(root, F.lit("/"), clean)))


def link_profile(page_links: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per page: links, share with generic labels, policy links of four kinds, category links, a cart link."""
    label, path = F.col("label"), U.path_and_query(F.col("target"))
    l = page_links.withColumn("target", absolute(F.col("href"), F.col("url")))  # noqa: E741
    named = F.length(label) > 0
    generic = lexicon.hit("generic_link", label)
    policy = {k: F.max((F.length(label) <= 60) & ~generic & lexicon.hit(k, label)).cast("int") for k in ("returns", "shipping", "privacy", "terms")}
    g = l.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(named).alias("_named"), F.count_if(generic).alias("generic"),
        sum(policy.values(), F.lit(0)).alias("policy_count"), F.count_if(path.rlike(lexicon.regex("category_url"))).alias("category_links"),
        F.max(lexicon.hit("cart", label) & ~lexicon.hit("add_to_cart", label)).alias("cart_link"))
    return g.withColumn("generic_share", F.when(F.col("_named") > 0, round_half_even(F.col("generic") / F.col("_named"), 3))).drop("_named")


def listing_candidates(page_links: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Category links of each page ranked by evidence (category URL 3, visible 1), each URL once; links to carts,
    products, content pages, other sites and the page itself never qualify."""
    l = page_links.withColumn("target", absolute(F.col("href"), F.col("url")))  # noqa: E741
    path = U.path_and_query(F.col("target"))
    bad = path.rlike(lexicon.regex("cart_url")) | path.rlike(lexicon.regex("product_url")) | path.rlike(lexicon.regex("info_url")) | path.rlike(lexicon.regex("checkout_url"))
    l = l.where(U.is_web(F.col("target")) & U.same_site(F.col("target"), F.col("url")) & ~bad & (U.page_key(F.col("target")) != U.page_key(F.col("url"))))
    score = 3 * path.rlike(lexicon.regex("category_url")).cast("int") + F.coalesce("visible", F.lit(True)).cast("int")
    best = l.withColumn("evidence", score).groupBy("page_id", "target").agg(F.min(F.struct((-F.col("evidence")).alias("n"), "pos")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("_b.n", "_b.pos"))
    return best.select("page_id", "target", (-F.col("_b.n")).alias("evidence"), rank.alias("rank"))


def product_candidates(cards: DataFrame, entries: DataFrame) -> DataFrame:
    """Product links of each page: cards in page order, then listed entries; same site, no cart action, each once.
    cards and entries: page_id, url, pos, href."""
    both = cards.withColumn("src", F.lit(0)).unionByName(entries.withColumn("src", F.lit(1)))
    both = both.withColumn("target", absolute(F.col("href"), F.col("url")))
    ok = U.same_site(F.col("target"), F.col("url")) & U.clean_cart_url(F.col("target")).eqNullSafe(F.col("target")) & (F.col("target") != F.col("url"))
    first = both.where(ok).groupBy("page_id", "target").agg(F.min(F.struct("src", "pos")).alias("_f"))
    return first.select("page_id", "target", F.row_number().over(Window.partitionBy("page_id").orderBy("_f.src", "_f.pos")).alias("rank"))


def find_cart(candidates: DataFrame) -> DataFrame:
    """Per run: the cart URL by how it was found: final page, newest visited plain URL, cart link, visited with a query.

    candidates: run_id, url, how (final_page|visited|cart_link), ord.
    """
    c = candidates.withColumn("_clean", F.when(F.col("how") == "final_page", F.col("url")).otherwise(U.clean_cart_url(F.col("url")))).where("_clean is not null")
    pri = (F.when(F.col("how") == "final_page", 0).when((F.col("how") == "visited") & (U.query(F.col("_clean")) == ""), 1)
           .when(F.col("how") == "cart_link", 2).otherwise(3))
    return c.groupBy("run_id").agg(F.min(F.struct(pri.alias("p"), (-F.col("ord")).alias("o"), "url", "how")).alias("_b")).select(
        "run_id", F.col("_b.url").alias("url"), F.col("_b.how").alias("how"))


JSONLD = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def jsonld_objects(pages: DataFrame) -> DataFrame:
    """page_id, pos, node: JSON-LD objects of a page with arrays and @graph flattened; malformed blocks give none."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(JSONLD), 1)).alias("block", "_t"))
    blocks = blocks.withColumn("_v", F.try_parse_json("_t")).where("_v is not null")
    inner = F.coalesce(F.try_variant_get("_v", "$.@graph", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    return blocks.select("page_id", "block", F.posexplode(inner).alias("pos", "node"))


def jsonld_facts(pages: DataFrame) -> DataFrame:
    """Per page: product facts of the first Product object: price, currency, availability, rating, reviews, policies."""
    get = lambda path, kind="string": F.try_variant_get("node", path, kind)
    kind = F.regexp_extract(F.coalesce(get("$.@type"), get("$.@type[0]")), r"([^/#]*)$", 1)
    offer = lambda f, k="string": F.coalesce(get(f"$.offers.{f}", k), get(f"$.offers[0].{f}", k))
    n = jsonld_objects(pages).withColumn("type", kind)
    facts = F.struct(
        get("$.name").alias("name"), get("$.sku").alias("sku"),
        F.coalesce(offer("price"), offer("lowPrice")).try_cast("double").alias("price"), offer("priceCurrency").alias("currency"),
        F.regexp_extract(F.coalesce(offer("availability"), F.lit("")), r"([^/#]*)$", 1).alias("availability"),
        get("$.aggregateRating.ratingValue").try_cast("double").alias("rating"),
        F.coalesce(get("$.aggregateRating.reviewCount"), get("$.aggregateRating.ratingCount")).try_cast("int").alias("review_count"),
        (F.coalesce(get("$.hasMerchantReturnPolicy"), offer("hasMerchantReturnPolicy")).isNotNull()).alias("has_return_policy"),
        (F.coalesce(get("$.shippingDetails"), offer("shippingDetails")).isNotNull()).alias("has_shipping"))
    at = F.struct("block", "pos")
    g = n.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("type") == "Product").alias("products"),
        F.min_by(facts, F.when(F.col("type") == "Product", at)).alias("_p"))
    names = ("name", "sku", "price", "currency", "availability", "rating", "review_count", "has_return_policy", "has_shipping")
    return g.select("page_id", "objects", "products", *[F.col("_p")[c].alias(c) for c in names])


# ---------------------------------------------------------------- text blocks
def text_blocks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents as blocks: one row per line with its position, whitespace collapsed, empty lines left out."""
    rows = docs.select(id_col, "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.withColumn("text", T.squash(F.col("text"))).where("text != ''")


def lexicon_hits(blocks: DataFrame, lexicon: Lexicon, keys: list[str], lang: Column | None = None) -> DataFrame:
    """One row per block and key that matches: one rlike per key in one projection, no pattern join."""
    hit = lambda k: lexicon.hit(k, F.col("text")) if lang is None else lexicon.hit_by_language(k, F.col("text"), lang)
    found = F.array_compact(F.array(*[F.when(hit(k), F.lit(k)) for k in keys]))
    return blocks.withColumn("key", F.explode(found))


def prices(blocks: DataFrame, pattern: str = T.PRICE) -> DataFrame:
    """Every price of a block: amount, currency and position."""
    rows = blocks.select(*[c for c in blocks.columns if c != "text"], "text", F.posexplode(T.price_matches(F.col("text"), pattern)).alias("price_pos", "match"))
    rows = rows.withColumn("value", T.parse_amount(T.amount_text(F.col("match")))).withColumn("currency", T.currency_code(F.col("match")))
    return rows.where("value is not null")


def price_kind(struck: Column, option: Column, label: Column, text: Column, summary: Column, lexicon: Lexicon) -> Column:
    """What an amount is, first match wins: strike, option, threshold, installment, unit, lowest30, subtotal, total,
    shipping, fee, price. Totals count only in summary rows."""
    return (F.when(struck, "strike").when(option, "option").when(lexicon.hit("free_shipping", label), "threshold")
            .when(lexicon.hit("installments", F.concat_ws(" ", label, text)), "installment").when(lexicon.hit("unit_price", F.concat_ws(" ", text, label)), "unit")
            .when(lexicon.hit("lowest_price_30d", label), "lowest30").when(summary & lexicon.hit("subtotal", label), "subtotal")
            .when(summary & lexicon.hit("total", label), "total").when(summary & lexicon.hit("shipping", label), "shipping")
            .when(summary & lexicon.hit("fee", label), "fee").otherwise("price"))


def persuasion(blocks: DataFrame, lexicon: Lexicon, keys: list[str]) -> DataFrame:
    """Persuasion statements (blocks of at most 400 characters) with the scarcity number and whether a deadline is
    stated; equal texts of one page count their showings. blocks: id, pos, text."""
    b = blocks.where(F.length("text") <= 400)
    rest = F.regexp_replace("text", f"(?iu){lexicon.regex('free_shipping')}", " ")
    hits = F.array_compact(F.array(*[F.when(lexicon.hit(k, rest if k == "reciprocity" else F.col("text")), F.lit(k)) for k in keys]))
    b = b.withColumn("kind", F.explode(hits)).withColumn("statement", F.substring("text", 1, 200))
    number = F.regexp_extract(F.regexp_extract("text", f"(?iu)({lexicon.regex('scarcity')})", 1), r"(\d+)", 1).try_cast("int")
    deadline = F.col("text").rlike(r"(^|[^0-9])\d{1,2}[/.-]\d{1,2}([/.-]\d{2,4})?([^0-9]|$)|(^|[^0-9])\d{1,2}[:.]\d{2}([^0-9]|$)")
    return b.groupBy("doc_id", "kind", "statement").agg(
        F.count(F.lit(1)).alias("shown"), F.min("pos").alias("pos"), F.max(F.when(F.col("kind") == "scarcity", number)).alias("number"),
        F.max((F.col("kind") == "urgency") & deadline).alias("deadline"))


def prose_stats(blocks: DataFrame, keys: list[str], minimum: int = 8) -> DataFrame:
    """Words, letters, sentences over running text (blocks of at least eight words)."""
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}]+)?)"), 1)
    b = blocks.select(*keys, "text", F.size(words).alias("_w")).where(F.col("_w") >= minimum)
    ends = F.size(F.regexp_extract_all("text", F.lit(r"([.!?…]+)(\s|$)"), 1))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return b.groupBy(*keys).agg(F.sum("_w").alias("words"), F.sum(letters).alias("letters"), F.sum(F.greatest(F.lit(1), ends)).alias("sentences"), F.count(F.lit(1)).alias("blocks"))


def readable_docs(docs: DataFrame) -> DataFrame:
    """Readability of whole documents: Gulpease (it) or Flesch (en). docs: doc_id, lang, text."""
    from siteready.operators.checks import readability
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)"), 1)
    d = docs.select("doc_id", "lang", words.alias("_ws"), F.size(F.regexp_extract_all("text", F.lit(r"([.!?]+)(\s|$)"), 1)).alias("sentences"))
    d = d.select("doc_id", "lang", "sentences", F.size("_ws").alias("words"), F.aggregate("_ws", F.lit(0), lambda a, w: a + F.length(w)).alias("letters"),
                 F.aggregate("_ws", F.lit(0), lambda a, w: a + T.syllables(w)).alias("syllables"))
    return d.withColumn("score", readability(F.col("words"), F.col("sentences"), F.col("letters"), F.col("syllables"), F.col("lang")))


def document_language(docs: DataFrame, run_lang: str) -> DataFrame:
    return docs.withColumn("effective", effective_language(F.col("lang"), run_lang, T.words(F.col("text"))))


def page_scores(f: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Page types by additive evidence; the winner needs 0.3, else other; confidence from the margin to the second.

    f: url, title, heading, sample and the evidence columns products, has_structured, cta_present, cta_count,
    cta_above_fold, price_above_fold, main_group, itemlist, filters, sort_present, result_count, cart_editable_lines,
    checkout_cta, order_totals, cart_marked_empty, address_fields, visible_fields, cc_present, pay_control, categories,
    captcha_frame, tiny. Missing ones are null and add nothing.
    """
    c = lambda name: F.col(name) if name in f.columns else F.lit(None)
    b = lambda name: F.coalesce(c(name).cast("boolean"), F.lit(False))
    n = lambda name: F.coalesce(c(name).cast("int"), F.lit(0))
    w = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    full, head = U.path_and_query(F.col("url")), F.coalesce("heading", F.lit(""))
    url = lambda key: F.coalesce(full.rlike(lexicon.regex(key)), F.lit(False))
    worded = lexicon.hit("challenge", F.concat_ws(" ", "title", head, F.substring("sample", 1, 600)))
    cart_url = url("cart_url")
    checkout_url = url("checkout_url") & ~cart_url & ~url("info_url")
    contact = lexicon.hit("contact", head) & ~checkout_url
    co_head = lexicon.hit("checkout", head)
    steps = (n("visible_fields") > 0) | b("cc_present") | co_head | b("pay_control")
    titled = F.when(head != "", head).otherwise(F.col("title"))
    home = U.is_home(F.col("url"))
    scores = {
        "home": w(home, 0.45) + w(home & (n("categories") >= 3), 0.1),
        "plp": w(n("main_group") >= 12, 0.45) + w(n("main_group").between(4, 11), 0.3) + w(n("itemlist") >= 4, 0.35) + w(n("products") >= 3, 0.3)
        + w(n("filters") >= 2, 0.15) + w(b("sort_present"), 0.1) + w(b("result_count"), 0.1) + w(url("category_url"), 0.15),
        "pdp": w(n("products").between(1, 2) & b("has_structured"), 0.45) + w(b("cta_present") & (n("cta_count") <= 2), 0.25)
        + w(b("cta_present") & (n("cta_count") <= 2) & b("cta_above_fold"), 0.1) + w(b("price_above_fold") & (head != ""), 0.1) + w(url("product_url"), 0.15),
        "cart": w(b("cart_editable_lines"), 0.35) + w(b("checkout_cta"), 0.3) + w(b("order_totals"), 0.15) + w(b("cart_marked_empty"), 0.45) + w(cart_url, 0.3)
        + w(lexicon.hit("cart", titled) & ~lexicon.hit("add_to_cart", titled), 0.2),
        "checkout": w(~contact & (n("address_fields") >= 4), 0.4) + w(~contact & n("address_fields").between(2, 3) & (n("visible_fields") >= 4), 0.2) + w(b("cc_present"), 0.3)
        + F.when(checkout_url, F.when(steps, 0.35).otherwise(0.2)).otherwise(0.0) + w(co_head, 0.2) + w(b("pay_control"), 0.25),
        "challenge": w(worded, 0.5) + w(worded & b("tiny"), 0.3) + w(b("captcha_frame"), 0.4),
        "other": F.lit(0.2),
    }
    f = f.withColumn("_s", F.array(*[F.struct(round_half_even(scores[t], 3).alias("score"), F.lit(-i).alias("neg"), F.lit(t).alias("type")) for i, t in enumerate(K.PAGE_TYPES)]))
    ranked = F.sort_array("_s", asc=False)
    f = f.withColumn("_top", ranked[0]).withColumn("_second", ranked[1])
    margin = F.least(F.lit(1.0), F.col("_top.score")) * (0.5 + 0.5 * (1 - F.col("_second.score") / F.col("_top.score")))
    return f.withColumn("page_type", F.when(F.col("_top.score") < 0.3, F.lit("other")).otherwise(F.col("_top.type"))).withColumn(
        "confidence", round_half_even(margin, 3)).drop("_s", "_top", "_second")


def trust_facts(blocks: DataFrame, lexicon: Lexicon, keys: list[str]) -> DataFrame:
    """Per site: contact e-mail, phone, address, legal id, badges found in its text blocks."""
    t = F.col("text")
    email = t.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    phone = lexicon.hit("phone", t) & (F.length(F.regexp_replace(F.regexp_extract(t, r"((?:\+\d{1,3}[\s.]?)?(?:\(?\d{2,4}\)?[\s./-]?){2,4}\d{2,4})", 1), r"\D", "")) >= 6)
    return blocks.groupBy(*keys).agg(F.max(email).alias("email"), F.max(phone).alias("phone"), F.max((F.length(t) <= 300) & lexicon.hit("address", t)).alias("address"),
                                     F.max(lexicon.hit("legal_id", t)).alias("legal_id"), F.max((F.length(t) <= 120) & lexicon.hit("trust_badge", t)).alias("badge"))


def snippets(blocks: DataFrame, kinds: dict[str, Column], caps: dict[str, int], per_page: int = 40) -> DataFrame:
    """Snippets per page: each block's kinds, cut on a word boundary, each text once per kind, kinds capped, 40 a page.

    Ranking windows keep only the capped rows before they shuffle. blocks: page_id, pos, text.
    """
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("kind_ord"), F.lit(k).alias("kind"))) for i, (k, cond) in enumerate(kinds.items())]))
    b = blocks.select("page_id", "pos", T.cut_on_word(F.col("text")).alias("text"), F.explode(found).alias("_k")).select("page_id", "pos", "text", F.col("_k.kind_ord").alias("kind_ord"), F.col("_k.kind").alias("kind"))
    once = b.groupBy("page_id", "kind_ord", "kind", "text").agg(F.min("pos").alias("pos"))
    cap = F.create_map(*[F.lit(v) for p in caps.items() for v in p])[F.col("kind")]
    top = once.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("pos"))).where(
        (F.col("_r") <= max(caps.values())) & (F.col("_r") <= cap))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("kind_ord", "pos"))
    return top.withColumn("_n", n).where(F.col("_n") <= per_page).select("page_id", "kind", "pos", "text", F.concat(F.lit("s"), F.col("_n").cast("string")).alias("snippet_id"))


# Fixed patterns: what personal or payment data looks like, first kind in order.
PERSONAL = (
    ("an email address", r"(?i)[^\s@]+\s*@\s*[^\s@]+\.[^\s@]{2,}|[A-Za-z0-9_.+-]+\s*(?:[(\[{]at[)\]}]|\s(?:at|chiocciola)\s)\s*[A-Za-z0-9_-]+(?:\s*(?:\.|[(\[{]dot[)\]}]|\s(?:dot|punto)\s)\s*[a-z]{2,})+"),
    ("a card, phone or account number", r"(?:[0-9][\s./-]?){9,}"),
    ("an IBAN", r"(?i)(?:^|[^A-Za-z0-9])[a-z]{2}[0-9]{2}(?:\s?[a-z0-9]){11,30}(?:$|[^A-Za-z0-9])"),
    ("a fiscal code", r"(?i)(?:^|[^A-Za-z0-9])[a-z]{6}[0-9]{2}[a-z][0-9]{2}[a-z][0-9]{3}[a-z](?:$|[^A-Za-z0-9])"),
    ("a card security code", r"(?i)(?:^|[^A-Za-z0-9])(?:cvv2?|cvc2?|cid|csc)[^A-Za-z0-9_]{0,3}[0-9]{3,4}(?:$|[^A-Za-z0-9])"),
    ("a date", r"(?:^|[^0-9])(?:(?:0?[1-9]|[12][0-9]|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[/.-](?:0?[1-9]|1[0-2])[/.-](?:0?[1-9]|[12][0-9]|3[01]))(?:$|[^0-9])"),
    ("a street address", r"(?:^|[^0-9])[0-9]{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}(?i:street|st|road|rd|avenue|ave|lane|drive|boulevard|blvd)(?:$|[^A-Za-z])"),
)


def pii_kind(text: Column, normalise: bool = True) -> Column:
    """The first kind of personal data a text looks like, or null. Compatibility characters read as what they show; an
    IBAN needs ten digits."""
    t = T.nfkc(text) if normalise else text
    out = None
    for kind, pattern in PERSONAL:
        hit = t.rlike(pattern)
        if kind == "an IBAN":
            hit = F.exists(F.regexp_extract_all(t, F.lit(f"({pattern})"), 1), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= 10)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def shipping_stated(pdp_text: Column, cart_text: Column, cart_value: Column, lexicon: Lexicon) -> Column:
    """A shipping cost is stated, unless the line leaves it to the checkout without naming free shipping."""
    def stated(t: Column) -> Column:
        deferred = lexicon.hit("shipping_deferred", t) & ~lexicon.hit("free_shipping", t)
        return F.coalesce((T.squash(t) != "") & ~deferred, F.lit(False))
    return stated(pdp_text) | stated(cart_text) | cart_value.isNotNull()


def review_facts(blocks: DataFrame, structured: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per page: rating and review count from structured data, else from short review lines ("4.5/5", "120 reviews").

    blocks: page_id, pos, text. structured: page_id, rating, review_count.
    """
    b = blocks.where((F.length("text") <= 200) & lexicon.hit("review", F.col("text")) & F.col("text").rlike("[0-9]"))
    rating = F.replace(F.regexp_extract("text", r"([0-9](?:[.,][0-9]{1,2})?)\s*/\s*5", 1), F.lit(","), F.lit(".")).try_cast("double")
    rating = F.when(rating.between(0.0, 5.0), rating)
    count = F.regexp_replace(F.regexp_extract("text", r"(?iu)([0-9][0-9.,]*)\s*\)?\s+(?:reviews?|ratings?|recension[ei])", 1), "[.,]", "").try_cast("int")
    t = b.select("page_id", "pos", rating.alias("_r"), count.alias("_c")).groupBy("page_id").agg(
        F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("pos"))).alias("_r"), F.min_by("_c", F.when(F.col("_c").isNotNull(), F.col("pos"))).alias("_c"))
    j = t.join(structured, "page_id", "full")
    known = F.col("rating").isNotNull() | F.col("review_count").isNotNull()
    return j.select("page_id", F.when(known, F.col("rating")).otherwise(F.col("_r")).alias("rating"), F.when(known, F.col("review_count")).otherwise(F.col("_c")).alias("review_count"),
                    F.when(known, "structured").when(F.col("_r").isNotNull() | F.col("_c").isNotNull(), "text").alias("source"))


def line_quantity(text: Column, title: Column, lexicon: Lexicon) -> Column:
    """A quantity in a row's text outside its title: after a quantity word, a stand-alone multiplication sign, or a
    number times a price."""
    rest = F.when(title != "", F.replace(text, title, F.lit(" "))).otherwise(text)
    words = "|".join(lexicon.every("quantity"))
    after_word = F.regexp_extract(rest, rf"(?iu)(?:{words})[^\p{{L}}\p{{N}}]{{0,3}}([0-9]+)", 1)
    sign = F.regexp_extract(rest, r"(?:^|[^0-9.,\s]\s|^\s)[xX×]\s?([0-9]{1,3})(?:\s|$)", 1)
    times = F.regexp_extract(rest, r"(?:^|\s)([0-9]{1,3})\s?[xX×]\s?(?:[€$£]\s?[0-9]|[0-9][0-9.,]*\s?[€$£])", 1)
    has_word = rest.rlike(rf"(?iu)(?:^|[^\p{{L}}])(?:{words})(?:$|[^\p{{L}}])")
    return F.when(has_word, after_word.try_cast("int")).otherwise(F.coalesce(F.when(sign != "", sign), F.when(times != "", times)).try_cast("int"))


def control_kind(shown: Column, name: Column, lexicon: Lexicon) -> Column:
    """What a control does: reject before accept, then manage, decline, close; the visible text before the name."""
    def kind(t: Column) -> Column:
        return (F.when(lexicon.hit("consent_reject", t), "reject").when(lexicon.hit("consent_accept", t), "accept").when(lexicon.hit("consent_manage", t), "manage")
                .when(lexicon.hit("decline", t), "decline").when(lexicon.hit("close", t), "close"))
    return F.coalesce(kind(shown), kind(name), F.lit("other"))


# ---------------------------------------------------------------- shopping-safety scan over logged steps
def is_checkout(page_type: Column, url: Column, field_text: Column, lexicon: Lexicon) -> Column:
    """A checkout page: the classifier's word, payment fields, or a checkout URL that is neither cart nor content."""
    full = U.path_and_query(url)
    by_url = full.rlike(lexicon.regex("checkout_url")) & ~full.rlike(lexicon.regex("cart_url")) & ~full.rlike(lexicon.regex("info_url"))
    code = field_text.rlike(r"(?iu)(^|[^\p{L}\p{N}])(cvv2?|cvc2?|csc)($|[^\p{L}\p{N}])")
    words = F.array_distinct(F.transform(F.regexp_extract_all(field_text, F.lit(f"(?iu)({'|'.join(lexicon.every('payment_field'))})"), 1), F.lower))
    strong = F.exists(words, lambda w: ~w.rlike(r"^(scadenza|iban|expir.*|expiry)$"))
    return F.coalesce(page_type == "checkout", F.lit(False)) | F.coalesce(code | ((F.size(words) >= 2) & strong) | by_url, F.lit(False))


def policy_violations(steps: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Logged actions a shopping-safety policy forbids, with the first reason.

    steps: run_id, ord, kind (click|fill|select|scroll|wait), label, role, on_site, checkout.
    """
    control = F.col("kind").isin("scroll", "wait")
    label = F.coalesce("label", F.lit(""))
    fill = (F.col("kind") == "fill") & (lexicon.hit("payment_field", label) | lexicon.hit("personal_field", label))
    why = (F.when(control, F.lit(None)).when(~F.col("on_site"), F.lit("external_page")).when(lexicon.hit("pay_now", label), F.lit("forbidden_label:pay_now"))
           .when(lexicon.hit("place_order", label), F.lit("forbidden_label:place_order"))
           .when(F.col("checkout") & ~((F.col("kind") == "click") & F.coalesce(F.col("role") == "link", F.lit(False))),
                 F.when(F.col("kind").isin("fill", "select"), F.lit("checkout_form")).otherwise(F.lit("checkout_submit")))
           .when(fill, F.lit("personal_field")))
    return steps.withColumn("violation", why).where("violation is not null")


def token_overlap(rows: DataFrame, left: str, right: str, least: int = 3) -> DataFrame:
    """rows with shared: how many distinct words of at least ``least`` letters two text columns have in common."""
    words = F.array_intersect(T.words(F.col(left), least), T.words(F.col(right), least))
    return rows.withColumn("shared", F.size(words))
