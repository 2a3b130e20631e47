"""Checks of page and text jobs on pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteready.dims import constants as K
from siteready.functions import text as T
from siteready.functions.lexicon import Lexicon
from siteready.operators import checks as C
from siteready.operators import pages as P
from siteready.verify.base import duck_view, half_even, query, spark_view, table
from siteready.verify.checks import LX

q = lambda pattern: pattern.replace("'", "''")
rx = lambda key, lang=None: q(LX.regex(key, lang))
hit = lambda key, t, lang=None: f"regexp_matches({t}, '{rx(key, lang)}', 'i')"


def blocks(spark, d):
    return P.text_blocks(table(spark, d, "documents"))


duck_view("v_blk", r"SELECT doc_id, lang, pos, text FROM (SELECT doc_id, lang, CAST(i - 1 AS INT) AS pos, trim(regexp_replace(lines[i], '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) u(i)) WHERE text <> ''")
duck_view("v_body", r"SELECT page_id, url, html, regexp_replace(html, '(?is)(<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->)', ' ', 'g') AS b FROM pages")


@query("txt_01_page_features", r"""SELECT page_id, lower(regexp_extract(html, '(?i)<html\b[^>]*\blang\s*=\s*["'']?([A-Za-z-]+)', 1)) AS lang, len(regexp_extract_all(b, '(?i)<h1\b')) AS h1, len(regexp_extract_all(b, '(?i)<h2\b')) AS h2,
 len(regexp_extract_all(b, '(?i)<a\b[^>]*\bhref\s*=')) AS links, len(regexp_extract_all(b, '(?i)<p\b')) AS paragraphs, length(trim(regexp_replace(regexp_replace(b, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars FROM v_body""")
def _(spark, d):
    return P.page_features(table(spark, d, "pages")).select("page_id", "lang", "h1", "h2", "links", "paragraphs", "text_chars")


duck_view("v_link", r"""SELECT page_id, url, CAST(i - 1 AS INT) AS pos, h[i] AS href, trim(regexp_replace(regexp_replace(l[i], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM (SELECT page_id, url, regexp_extract_all(b, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h,
 regexp_extract_all(b, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS l FROM v_body), unnest(range(1, len(h) + 1)) u(i)""")
duck_view("v_tgt", r"""SELECT *, CASE WHEN starts_with(c, '/') THEN '' ELSE '/' END || c AS tpath FROM (SELECT *, regexp_replace(href, '#.*$', '') AS c FROM v_link)""")


@query("txt_11_links", "SELECT page_id, pos, href, label FROM v_link")
def _(spark, d):
    return P.links(table(spark, d, "pages")).select("page_id", "pos", "href", "label")


@query("txt_11_link_profile", f"""SELECT page_id, count(*) AS links, count(*) FILTER (WHERE {hit('generic_link', 'label')}) AS generic, CASE WHEN count(*) FILTER (WHERE label <> '') > 0 THEN {half_even(f"count(*) FILTER (WHERE {hit('generic_link', 'label')}) / count(*) FILTER (WHERE label <> '')", 3)} END AS generic_share,
 count(*) FILTER (WHERE regexp_matches(tpath, '{rx('category_url')}')) AS category_links FROM v_tgt GROUP BY page_id""")
def _(spark, d):
    return P.link_profile(P.links(table(spark, d, "pages")), LX).select("page_id", "links", "generic", "generic_share", "category_links")


@query("top_03_listing_candidates", f"""SELECT page_id, tpath, evidence, row_number() OVER (PARTITION BY page_id ORDER BY evidence DESC, pos) AS rank FROM (SELECT page_id, tpath, max(ev) AS evidence, arg_min(pos, (-ev, pos)) AS pos FROM (
 SELECT *, 1 + CASE WHEN regexp_matches(tpath, '{rx('category_url')}') THEN 3 ELSE 0 END AS ev FROM v_tgt WHERE NOT regexp_matches(tpath, '{rx('cart_url')}') AND NOT regexp_matches(tpath, '{rx('product_url')}') AND NOT regexp_matches(tpath, '{rx('info_url')}') AND NOT regexp_matches(tpath, '{rx('checkout_url')}')) GROUP BY page_id, tpath)""")
def _(spark, d):
    l = P.listing_candidates(P.links(table(spark, d, "pages")).withColumn("visible", F.lit(True)), LX)  # noqa: E741
    return l.select("page_id", F.regexp_extract("target", "^[a-z]+://[^/]*(.*)$", 1).alias("tpath"), "evidence", "rank")


@query("top_04_product_candidates", """SELECT page_id, tpath, row_number() OVER (PARTITION BY page_id ORDER BY src, pos) AS rank FROM (SELECT page_id, tpath, min(src) AS src, arg_min(pos, (src, pos)) AS pos FROM (SELECT page_id, tpath, pos, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS src FROM v_tgt) GROUP BY page_id, tpath)""")
def _(spark, d):
    l = P.links(table(spark, d, "pages")).select("page_id", "url", "pos", "href")  # noqa: E741
    return P.product_candidates(l.where("pos % 2 = 0"), l.where("pos % 2 = 1")).select("page_id", F.regexp_extract("target", "^[a-z]+://[^/]*(.*)$", 1).alias("tpath"), "rank")


@query("top_05_find_cart", """SELECT run_id, arg_min(url, (p, -ord)) AS url, arg_min(how, (p, -ord)) AS how FROM (SELECT user_id AS run_id, event_id AS ord, u AS url, how, CASE WHEN how = 'final_page' THEN 0 WHEN how = 'visited' AND NOT contains(u, '?ref') THEN 1 WHEN how = 'cart_link' THEN 2 ELSE 3 END AS p FROM (
 SELECT *, CASE event_type WHEN 'click' THEN 'visited' WHEN 'view' THEN 'cart_link' WHEN 'signup' THEN 'visited' ELSE 'final_page' END AS how, CASE event_type WHEN 'click' THEN 'https://s.example/cart?ref=1' WHEN 'view' THEN 'https://s.example/basket' WHEN 'signup' THEN 'https://s.example/cart/add' ELSE 'https://s.example/cart' END AS u FROM events WHERE event_type <> 'purchase' OR user_id % 3 = 0)
 WHERE event_type NOT IN ('signup','error')) GROUP BY run_id""")
def _(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").where("(event_type <> 'purchase' or user_id % 3 = 0) and event_type <> 'error'")
    return P.find_cart(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.when(t.isin("click", "signup"), "visited").when(t == "view", "cart_link").otherwise("final_page").alias("how"),
                                F.when(t == "click", "https://s.example/cart?ref=1").when(t == "view", "https://s.example/basket").when(t == "signup", "https://s.example/cart/add").otherwise("https://s.example/cart").alias("url")))


@query("txt_02_jsonld_facts", """SELECT p_partkey AS page_id, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS objects, 1 AS products, p_name AS name, p_retailprice AS price, 'EUR' AS currency, CASE WHEN p_size % 2 = 0 THEN 'InStock' ELSE 'SoldOut' END AS availability, p_size / 10 AS rating, p_size AS review_count FROM part WHERE p_size % 7 <> 0""")
def _(spark, d):
    p = table(spark, d, "part")
    avail = F.when(F.col("p_size") % 2 == 0, "https://schema.org/InStock").otherwise("SoldOut")
    offer = F.struct(F.col("p_retailprice").alias("price"), F.lit("EUR").alias("priceCurrency"), avail.alias("availability"))
    rating = F.struct((F.col("p_size") / 10).alias("ratingValue"), F.col("p_size").alias("reviewCount"))
    prod = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), offer.alias("offers"), rating.alias("aggregateRating")))
    doc = F.when(F.col("p_size") % 7 == 0, F.lit("{broken")).when(F.col("p_size") % 5 == 0, prod).when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"@graph":[{"@type":"WebSite"},'), prod, F.lit("]}"))).otherwise(
        F.concat(F.lit("["), prod, F.lit(',{"@type":"Organization"}]')))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), doc, F.lit("</script></html>"))
    return P.jsonld_facts(p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))).select("page_id", "objects", "products", "name", "price", "currency", "availability", "rating", "review_count")


_PRICE = r"(?i)((?:€|US\$|\$|£)\s?(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)|(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)\s?(?:€|\$|£))"
duck_view("v_money", """SELECT doc_id, pos, text || ' costs ' || (CASE pos % 4 WHEN 0 THEN '€ ' || (doc_id % 1000) || ',50' WHEN 1 THEN '$' || (doc_id % 9 + 1) || ',299.00' WHEN 2 THEN (doc_id % 9 + 1) || '.299,00 €' ELSE '£' || (doc_id % 90) END) AS text FROM v_blk""")


@query("txt_03_prices", rf"""SELECT doc_id, pos, round(TRY_CAST(CASE WHEN dec THEN regexp_replace(regexp_extract(a, '^(.*)[.,]\d*$', 1), '[.,]', '', 'g') || '.' || regexp_extract(a, '[.,](\d*)$', 1) ELSE regexp_replace(a, '[.,]', '', 'g') END AS DOUBLE), 2) AS value,
 CASE WHEN contains(m, '€') THEN 'EUR' WHEN contains(m, '$') THEN 'USD' ELSE 'GBP' END AS currency FROM (SELECT *, (contains(a, ',') AND contains(a, '.')) OR (regexp_matches(a, '[.,]') AND length(regexp_extract(a, '[.,](\d*)$', 1)) <> 3) AS dec FROM (
 SELECT doc_id, pos, m, regexp_extract(m, '(\d{{1,3}}(?:[.,]\d{{3}})+(?:[.,]\d{{1,2}})?|\d+(?:[.,]\d{{1,2}})?)', 1) AS a FROM (SELECT doc_id, pos, unnest(regexp_extract_all(text, '{_PRICE}')) AS m FROM v_money)))""")
def _(spark, d):
    n, doc = F.col("pos") % 4, F.col("doc_id")
    price = F.when(n == 0, F.concat(F.lit("€ "), (doc % 1000).cast("string"), F.lit(",50"))).when(n == 1, F.concat(F.lit("$"), (doc % 9 + 1).cast("string"), F.lit(",299.00"))).when(
        n == 2, F.concat((doc % 9 + 1).cast("string"), F.lit(".299,00 €"))).otherwise(F.concat(F.lit("£"), (doc % 90).cast("string")))
    return P.prices(blocks(spark, d).withColumn("text", F.concat("text", F.lit(" costs "), price)), _PRICE).select("doc_id", "pos", F.round("value", 2).alias("value"), "currency")


@query("txt_04_price_kind", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'strike' WHEN doc_id % 8 = 0 THEN 'option' WHEN doc_id % 7 = 0 THEN 'threshold' WHEN doc_id % 6 = 0 THEN 'installment' WHEN doc_id % 5 = 0 THEN 'unit' WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'price' ELSE 'subtotal' END
 WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'price' ELSE 'shipping' END WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'price' ELSE 'fee' END ELSE 'price' END AS kind FROM documents""")
def _(spark, d):
    i = F.col("doc_id")
    label = (F.when(i % 7 == 0, "Free shipping over").when(i % 6 == 0, "3 installments").when(i % 5 == 0, "price per kg").when(i % 4 == 0, "Subtotal").when(i % 3 == 0, "Shipping").when(i % 2 == 0, "Handling fee").otherwise("Nice"))
    return table(spark, d, "documents").select("doc_id", P.price_kind(i % 9 == 0, i % 8 == 0, label, F.lit("10"), i % 11 != 0, LX).alias("kind"))


_PK = ["scarcity", "urgency", "reciprocity", "authority", "vat"]


@query("txt_05_persuasion", "SELECT doc_id, kind, substr(text, 1, 200) AS statement, count(*) AS shown, min(pos) AS pos FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, pos, text, '{k}' AS kind FROM v_blk WHERE length(text) <= 400 AND {hit(k, 'text')}" for k in _PK) + ") GROUP BY ALL")
def _(spark, d):
    return P.persuasion(blocks(spark, d), LX, _PK).select("doc_id", "kind", "statement", "shown", "pos")


@query("join_17_lexicon_hits", "SELECT key, lang, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS key, lang, doc_id FROM v_blk WHERE {hit(k, 'text', 'en')}" for k in ["terms", "address", "total", "vat", "close", "urgency", "payment_field"]) + ") GROUP BY ALL")
def _(spark, d):
    h = P.lexicon_hits(blocks(spark, d), LX, ["terms", "address", "total", "vat", "close", "urgency", "payment_field"], F.lit("en"))
    return h.groupBy("key", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("txt_06_countdowns", "SELECT event_id, CASE WHEN k % 2 = 0 THEN k % 5 * 86400.0 ELSE 0 END + k % 24 * 3600 + k % 60 * 60 + floor(value) % 60 AS seconds FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) WHERE k % 7 <> 0")
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat((F.col("k") % 24).cast("string"), F.lit(":"), two(F.col("k") % 60), F.lit(":"), two((F.floor("value") % 60)))
    t = F.when(F.col("k") % 7 == 0, "no time").when(F.col("k") % 2 == 0, F.concat(F.lit("ends in "), (F.col("k") % 5).cast("string"), F.lit(" days "), clock)).otherwise(clock)
    return e.select("event_id", T.countdown_seconds(t).alias("seconds")).where("seconds is not null")


_vg = r"greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(w), 'e$') AND NOT regexp_matches(lower(w), '(le|ee)$') AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"


@query("txt_07_readability", rf"""SELECT doc_id, words, sentences, syllables, CASE WHEN words >= 30 AND lang = 'en' THEN {half_even("least(100.0, greatest(0.0, 206.835 - 1.015*words/greatest(1,sentences) - 84.6*syllables/words))", 1)} END AS score FROM (
 SELECT doc_id, lang, len(ws) AS words, len(regexp_extract_all(text, '[.!?]+(\s|$)')) AS sentences, CAST(coalesce(list_sum(list_transform(ws, lambda w: {_vg})), 0) AS BIGINT) AS syllables FROM (SELECT doc_id, lang, text, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))""")
def _(spark, d):
    return P.readable_docs(table(spark, d, "documents")).select("doc_id", "words", "sentences", "syllables", "score")


@query("txt_08_prose_stats", r"""SELECT doc_id, CAST(sum(w) AS BIGINT) AS words, CAST(sum(length(regexp_replace(text, '[^\p{L}]', '', 'g'))) AS BIGINT) AS letters, CAST(sum(greatest(1, len(regexp_extract_all(text, '[.!?…]+(\s|$)')))) AS BIGINT) AS sentences, count(*) AS blocks
 FROM (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}]+)?')) AS w FROM v_blk) WHERE w >= 8 GROUP BY doc_id""")
def _(spark, d):
    return P.prose_stats(blocks(spark, d), ["doc_id"])


_fw = lambda l: "[" + ",".join(f"'{w}'" for w in K.FUNCTION_WORDS[l]) + "]"


@query("txt_09_effective_language", rf"""SELECT doc_id, CASE WHEN lang NOT IN ('it','en') THEN 'en' WHEN lang = 'it' AND en >= greatest(5, 2*it) THEN 'en' ELSE lang END AS effective FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'it' ELSE lang END AS lang, len(list_filter(ws, lambda w: list_contains({_fw('en')}, w))) AS en, len(list_filter(ws, lambda w: list_contains({_fw('it')}, w))) AS it
 FROM (SELECT *, list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda w: lower(w)) AS ws FROM documents))""")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "it").otherwise(F.col("lang")))
    return P.document_language(docs, "en").select("doc_id", "effective")


@query("txt_10_page_types", f"""SELECT page_id, CASE WHEN plp >= pdp AND plp >= cart AND plp >= 0.3 THEN 'plp' WHEN pdp >= cart AND pdp >= 0.3 THEN 'pdp' WHEN cart >= 0.3 THEN 'cart' ELSE 'other' END AS page_type FROM (
 SELECT page_id, round(CASE WHEN page_id % 20 >= 12 THEN 0.45 WHEN page_id % 20 >= 4 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(pth, '{rx('category_url')}') THEN 0.15 ELSE 0 END, 3) AS plp, CASE WHEN page_id % 3 = 0 THEN 0.45 ELSE 0 END AS pdp, CASE WHEN page_id % 7 = 0 THEN 0.45 ELSE 0 END AS cart
 FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS pth FROM pages))""")
def _(spark, d):
    i = F.col("page_id")
    f = table(spark, d, "pages").select("page_id", "url", F.lit("t").alias("title"), F.lit("").alias("heading"), F.lit("").alias("sample"), (i % 20).alias("main_group"), F.when(i % 3 == 0, 1).otherwise(0).alias("products"),
                                        F.lit(True).alias("has_structured"), (i % 7 == 0).alias("cart_marked_empty"))
    return P.page_scores(f, LX).select("page_id", "page_type")


@query("txt_12_trust_facts", f"""SELECT lang, source, bool_or(regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS email, bool_or(length(text) <= 300 AND {hit('address', 'text')}) AS address, bool_or({hit('legal_id', 'text')}) AS legal_id, bool_or(length(text) <= 120 AND {hit('trust_badge', 'text')}) AS badge
 FROM v_blk JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY ALL""")
def _(spark, d):
    b = blocks(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return P.trust_facts(b, LX, ["lang", "source"]).drop("phone")


@query("txt_13_snippets", """SELECT page_id, kind, pos, chars FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ko, pos) AS n FROM (SELECT page_id, ko, kind, min(pos) AS pos, chars, row_number() OVER (PARTITION BY page_id, kind ORDER BY min(pos)) AS r FROM (
 SELECT doc_id AS page_id, 0 AS ko, 'headline' AS kind, pos, t, length(t) AS chars FROM v_cut WHERE pos % 3 = 0 UNION ALL SELECT doc_id, 1, 'returns_policy', pos, t, length(t) FROM v_cut WHERE length(text) % 2 = 0) GROUP BY page_id, ko, kind, t, chars) WHERE r <= CASE kind WHEN 'headline' THEN 4 ELSE 3 END) WHERE n <= 5""")
def _(spark, d):
    b = blocks(spark, d).withColumnRenamed("doc_id", "page_id")
    s = P.snippets(b, {"headline": F.col("pos") % 3 == 0, "returns_policy": F.length("text") % 2 == 0}, {"headline": 4, "returns_policy": 3}, 5)
    return s.select("page_id", "kind", "pos", F.length("text").alias("chars"))


duck_view("v_cut", r"""SELECT *, CASE WHEN length(text) <= 600 THEN text ELSE trim(CASE WHEN tail <> '' AND 600 - length(tail) > 500 THEN substr(text, 1, 600 - length(tail)) ELSE substr(text, 1, 600) END) END AS t FROM (SELECT *, regexp_extract(substr(text, 1, 600), '(\s\S*)$', 1) AS tail FROM v_blk)""")
_pii = "CASE " + " ".join((f"WHEN len(list_filter(regexp_extract_all(text, '{q(p)}'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 10)) > 0 THEN '{k}'" if k == "an IBAN" else f"WHEN regexp_matches(text, '{q(p)}') THEN '{k}'") for k, p in P.PERSONAL) + " END"


@query("txt_14_pii_kind", f"SELECT doc_id, {_pii} AS kind FROM documents")
def _(spark, d):
    # SQL has no NFKC: the comparison reads the text as it is; the Unicode form has its own test
    return table(spark, d, "documents").select("doc_id", P.pii_kind(F.col("text"), normalise=False).alias("kind"))


@query("txt_14_pii_conversations", None)
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.pii_kind(F.col("text")).alias("kind"))


@query("txt_20_shipping_stated", "SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS stated FROM documents")
def _(spark, d):
    i = F.col("doc_id") % 5
    pdp = F.when(i == 0, "Shipping 4.90").when(i == 1, "Free shipping, otherwise calculated at checkout").when(i == 2, "Shipping calculated at checkout")
    return table(spark, d, "documents").select("doc_id", P.shipping_stated(pdp, F.lit(None).cast("string"), F.when(i == 3, 4.9), LX).alias("stated"))


@query("txt_24_review_facts", """SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 4.0 ELSE round(doc_id % 50 / 10.0, 1) END AS rating, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 1000 + doc_id % 50 END AS review_count, CASE WHEN doc_id % 3 = 0 THEN 'structured' ELSE 'text' END AS source FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("i", F.col("doc_id") % 50)
    score = F.concat((F.floor(F.col("i") / 10)).cast("string"), F.lit("."), (F.col("i") % 10).cast("string"))
    text = F.concat(F.lit("Rated "), score, F.lit("/5 by 1."), F.lpad(F.col("i").cast("string"), 3, "0"), F.lit(" reviews"))
    b = docs.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("pos"), text.alias("text"))
    return P.review_facts(b, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), F.lit(4.0).alias("rating"), F.lit(7).alias("review_count")), LX)


@query("txt_25_line_quantity", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size END AS qty FROM part")
def _(spark, d):
    n, name = F.col("p_size").cast("string"), F.concat("p_name", F.lit(" 360"))
    m = F.col("p_size") % 4
    t = F.when(m == 0, F.concat(name, F.lit(" Qty: "), n)).when(m == 1, F.concat(name, F.lit(" "), n, F.lit(" × 49,90 €"))).when(m == 2, F.concat(name, F.lit(" sum x"), n, F.lit(" left"))).otherwise(F.concat(name, F.lit(" 120 cm")))
    return table(spark, d, "part").select("p_partkey", P.line_quantity(t, name, LX).alias("qty"))


@query("txt_26_control_kind", "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' WHEN 2 THEN 'manage' WHEN 3 THEN 'decline' WHEN 4 THEN 'close' WHEN 5 THEN 'reject' ELSE 'other' END AS kind FROM part")
def _(spark, d):
    m = F.col("p_size") % 7
    t = F.when(m == 0, "Accept only essential cookies").when(m == 1, "Accept all").when(m == 2, "Cookie settings").when(m == 3, "No thanks").when(m == 5, "Rifiuta tutti").otherwise("×")
    return table(spark, d, "part").select("p_partkey", P.control_kind(t, F.when(m == 4, "Chiudi").otherwise("x"), LX).alias("kind"))


@query("agg_21_distinct_texts", r"""SELECT doc_id, substr(arg_min(text, pos), 1, 160) AS text, count(*) AS shown FROM (SELECT *, regexp_replace(replace(lower(text), 'ß', 'ss'), '\d+([.,]\d+)?', '#', 'g') AS k FROM v_blk) GROUP BY doc_id, k""")
def _(spark, d):
    return C.distinct_texts(blocks(spark, d).withColumn("ord", F.col("pos")), ["doc_id"]).select("doc_id", "text", "shown")


_BEN = ["the", "the [a-z]+", "of [a-z]+ the"]


@query("agg_22_benefits", """SELECT run_id, pattern, arg_min(text, pos) AS text, count(*) AS n FROM (SELECT doc_id AS run_id, pos, text, CASE WHEN l2 > 0 AND l2 > l1 AND l2 > l0 THEN 2 WHEN l1 > 0 AND l1 > l0 THEN 1 WHEN l0 > 0 THEN 0 END AS pattern FROM (
 SELECT *, length(regexp_extract(text, '(?i)(the)', 1)) l0, length(regexp_extract(text, '(?i)(the [a-z]+)', 1)) l1, length(regexp_extract(text, '(?i)(of [a-z]+ the)', 1)) l2 FROM v_blk)) WHERE pattern IS NOT NULL GROUP BY run_id, pattern""")
def _(spark, d):
    b = blocks(spark, d).select(F.col("doc_id").alias("run_id"), F.col("pos").alias("ord"), "text")
    return C.benefits(b, _BEN, "free shipping only").select("run_id", "pattern", "text", "n")


@query("prj_14_canonical_forms", r"""SELECT doc_id, pos, replace(lower(text), 'ß', 'ss') AS folded, regexp_replace(replace(lower(text), 'ß', 'ss'), '\d+', '#', 'g') AS masked FROM v_blk""")
def _(spark, d):
    return blocks(spark, d).select("doc_id", "pos", T.fold(F.col("text")).alias("folded"), T.mask_digits(F.col("text")).alias("masked"))


@query("ext_05_unicode_forms", "SELECT doc_id, nfc_normalize(text) AS nfc, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.nfc(F.col("text")).alias("nfc"), T.casefold(F.col("text")).alias("folded"))


@query("set_05_token_overlap", r"""SELECT a.doc_id, len(list_intersect(list_distinct(list_transform(regexp_extract_all(a.text, '\p{L}{3,}'), lambda w: lower(w))), list_distinct(list_transform(regexp_extract_all(b.text, '\p{L}{3,}'), lambda w: lower(w))))) AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def _(spark, d):
    a = table(spark, d, "documents").select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return P.token_overlap(a.join(b, "doc_id"), "text", "other").select("doc_id", "shared")


@query("prj_16_checkout_pages", f"SELECT page_id, page_id % 5 = 0 OR page_id % 7 = 0 OR page_id % 11 = 0 OR (regexp_matches(pth, '{rx('checkout_url')}') AND NOT regexp_matches(pth, '{rx('cart_url')}')) AS checkout FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS pth FROM pages)")
def _(spark, d):
    i = F.col("page_id")
    fields = F.when(i % 7 == 0, "Card number and expiry").when(i % 11 == 0, "Enter CVC2").when(i % 3 == 0, "IBAN Expiry").otherwise("Name")
    return table(spark, d, "pages").select("page_id", P.is_checkout(F.when(i % 5 == 0, "checkout").otherwise("pdp"), F.col("url"), fields, LX).alias("checkout"))


@query("prj_15_policy_violations", """SELECT event_id, CASE WHEN k % 13 = 0 THEN 'external_page' WHEN event_type = 'click' AND k % 5 = 0 THEN 'forbidden_label:pay_now' WHEN event_type = 'click' AND k % 5 = 1 THEN 'forbidden_label:place_order' WHEN k % 7 = 0 THEN CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN NULL ELSE 'checkout_submit' END ELSE 'checkout_form' END
 WHEN event_type = 'signup' AND k % 3 = 0 THEN 'personal_field' END AS violation FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events WHERE event_type IN ('click','signup')) WHERE violation IS NOT NULL""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    click = F.col("event_type") == "click"
    s = e.select("event_id", F.when(click, "click").when(F.col("event_type") == "signup", "fill").otherwise("scroll").alias("kind"),
                 F.when(click, F.when(F.col("k") % 5 == 0, "Paga ora").when(F.col("k") % 5 == 1, "Place your order").otherwise("Details")).otherwise(F.when(F.col("k") % 3 == 0, "Your e-mail").otherwise("Search")).alias("label"),
                 F.when(F.col("k") % 2 == 0, "link").alias("role"), (F.col("k") % 13 != 0).alias("on_site"), (F.col("k") % 7 == 0).alias("checkout"))
    return P.policy_violations(s, LX).select("event_id", "violation")
