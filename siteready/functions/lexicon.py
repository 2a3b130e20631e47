"""Lexicon: patterns per language and semantic key, as one alternation per key.

The packaged lexicon is a small English/Italian one of our own; a full lexicon is data and comes from a file or a
table with the columns lang, key, pattern (see ``load_lexicon``). Patterns avoid look-around and use explicit letter
classes at word ends, so the same text works in every regex engine.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteready.dims import constants as K

START, END = r"(?:^|[^\p{L}\p{N}])", r"(?:$|[^\p{L}\p{N}])"

# Fixed word lists (English, Italian) by key.
WORDS = {
    "en": {
        "add_to_cart": ["add to (?:cart|bag|basket)"],
        "buy_now": ["buy now"],
        "cart": ["cart", "basket", "shopping bag"],
        "checkout": ["checkout", "proceed to checkout"],
        "pay_now": ["pay now", "pay"],
        "place_order": ["place (?:the |my |your )?order", "confirm (?:the |my |your )?order"],
        "close": ["close", "dismiss"],
        "decline": ["no,? thanks", "not now", "maybe later"],
        "consent_accept": ["accept(?: all)?", "allow(?: all)?", "agree"],
        "consent_reject": ["reject(?: all)?", "refuse", "only (?:essential|necessary)"],
        "consent_manage": ["manage", "settings", "preferences", "customi[sz]e"],
        "consent_banner": ["cookies?", "consent"],
        "returns": ["returns?", "refunds?"],
        "shipping": ["shipping", "delivery", "postage"],
        "shipping_deferred": ["calculated at checkout", "calculated in the next step"],
        "free_shipping": ["free (?:shipping|delivery)"],
        "delivery": ["delivered? (?:by|in|within)", "arrives"],
        "privacy": ["privacy"],
        "terms": ["terms", "conditions", "licen[sc]e"],
        "contact": ["contact(?: us)?"],
        "scarcity": ["only (?:\\d+ )?left", "last (?:\\d+ )?(?:items?|pieces?)", "low stock", "only"],
        "urgency": ["ends (?:in|on|today)", "hurry", "last chance", "today"],
        "reciprocity": ["free (?:returns?|gift|samples?|trial)", "gift", "free"],
        "authority": ["certified", "award", "recommended by", "official"],
        "lowest_price_30d": ["lowest price (?:in|of) the last 30 days"],
        "vat": ["vat", "incl(?:uding|\\.)? tax"],
        "tax_line": ["vat", "tax(?:es)?", "sales tax", "gst", "hst"],
        "customs": ["customs", "duty", "duties"],
        "installments": ["installments?", "instalments?"],
        "unit_price": ["per (?:kg|litre|liter|unit|piece)"],
        "subtotal": ["sub-?total"],
        "total": ["total"],
        "fee": ["fee", "surcharge", "handling"],
        "out_of_stock": ["out of stock", "sold out", "unavailable"],
        "review": ["reviews?", "ratings?"],
        "rating_scale": ["out of (?:5|five)"],
        "quantity": ["quantity", "qty"],
        "addon": ["insurance", "protection", "warranty", "donation", "gift wrap"],
        "subscription": ["subscription", "subscribe", "auto-?renew(?:al|s)?"],
        "generic_link": ["click here", "read more", "learn more", "more", "here"],
        "phone": ["phone", "tel", "call us"],
        "address": ["street", "avenue", "road", "square"],
        "legal_id": ["vat (?:no|number|id)", "company (?:no|number)"],
        "trust_badge": ["secure", "trusted", "verified"],
        "personal_field": ["e-?mail", "phone", "first name", "last name", "address"],
        "payment_field": ["card number", "cvv", "cvc", "expiry", "iban", "password", "token"],
        "challenge": ["captcha", "are you (?:a )?human", "verify you are"],
    },
    "it": {
        "add_to_cart": ["aggiungi al carrello"],
        "buy_now": ["acquista ora", "compra ora"],
        "cart": ["carrello"],
        "checkout": ["procedi all'acquisto", "cassa"],
        "pay_now": ["paga ora", "paga"],
        "place_order": ["conferma (?:l'|il )?ordine", "invia ordine"],
        "close": ["chiudi"],
        "decline": ["no,? grazie", "non ora"],
        "consent_accept": ["accetta(?: tutti)?"],
        "consent_reject": ["rifiuta(?: tutti)?", "solo necessari"],
        "consent_manage": ["gestisci", "impostazioni", "preferenze"],
        "returns": ["res[io]", "rimbors[io]"],
        "shipping": ["spedizion[ei]", "consegna"],
        "shipping_deferred": ["calcolat[ao] al checkout"],
        "free_shipping": ["spedizione (?:gratuita|gratis)"],
        "scarcity": ["ultim[ie] (?:\\d+ )?(?:pezzi|articoli)", "solo \\d+ rimast[ie]"],
        "urgency": ["scade", "ultima occasione", "oggi"],
        "reciprocity": ["reso gratuito", "omaggio", "campione gratuito"],
        "vat": ["iva"],
        "tax_line": ["iva", "impost[ae]", "tasse"],
        "customs": ["dazi", "dazio", "dogan\\p{L}*"],
        "subtotal": ["subtotale"],
        "total": ["totale"],
        "out_of_stock": ["esaurito", "non disponibile"],
        "review": ["recensioni", "recensione"],
        "quantity": ["quantità", "q\\.?tà"],
        "addon": ["assicurazione", "protezione", "garanzia", "donazione"],
        "subscription": ["abbonamento", "rinnovo automatico"],
        "generic_link": ["clicca qui", "leggi di più", "scopri di più"],
        "legal_id": ["p\\.? ?iva", "partita iva"],
    },
}
# Fixed URL patterns (language-independent).
URL_PATTERNS = {
    "cart_url": r"/(?:cart|basket|bag|carrello)(?:[/.?]|$)",
    "checkout_url": r"/(?:checkout|onepage|cassa)(?:[/.?]|$)",
    "info_url": r"/(?:help|faq|info|about|blog|policy|policies|terms|privacy)(?:[/.?]|$)",
    "product_url": r"/(?:product|products|item|p|dp)/",
    "category_url": r"/(?:category|categories|collections?|c|shop|en|fr|de|es)/",
}


class Lexicon:
    """Patterns by language and key; a language reads its own patterns first, then the English ones."""

    def __init__(self, words: dict[str, dict[str, list[str]]] | None = None, urls: dict[str, str] | None = None):
        self.words = words or WORDS
        self.urls = urls or URL_PATTERNS

    def keys(self) -> list[str]:
        return list(dict.fromkeys(k for lang in self.words.values() for k in lang))

    def patterns(self, lang: str, key: str) -> list[str]:
        own, english = self.words.get(lang, {}).get(key, []), self.words.get("en", {}).get(key, [])
        return list(dict.fromkeys([*own, *english]))

    def every(self, key: str) -> list[str]:
        """A key's patterns in all languages (a guard reads every language)."""
        return list(dict.fromkeys(p for lang in self.words.values() for p in lang.get(key, [])))

    def regex(self, key: str, lang: str | None = None) -> str | None:
        """One alternation for the key, without flags; None when nobody has patterns for it."""
        if key in self.urls:
            return self.urls[key]
        items = self.every(key) if lang is None else self.patterns(lang, key)
        return f"{START}(?:{'|'.join(items)}){END}" if items else None

    def hit(self, key: str, text: Column, lang: str | None = None) -> Column:
        """text matches the key; one rlike per key, so it stays inside one codegen stage."""
        pattern = self.regex(key, lang)
        return F.lit(False) if pattern is None else F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))

    def hit_by_language(self, key: str, text: Column, lang: Column) -> Column:
        """The same with the page's own language in a column: one rlike per language, chosen by CASE."""
        out = F.lit(False)
        for name in self.words:
            if name != "en":
                out = F.when(lang == name, self.hit(key, text, name)).otherwise(out)
        return F.when(lang.isin(*[n for n in self.words if n != "en"]), out).otherwise(self.hit(key, text, "en"))

    def table(self, spark: SparkSession) -> DataFrame:
        """lang, key, pattern, ord with English merged into each language."""
        rows = [(lang, key, p, i) for lang in self.words for key in self.keys()
                for i, p in enumerate(self.patterns(lang, key))]
        return spark.createDataFrame(rows, "lang string, key string, pattern string, ord int")


def load_lexicon(path: str) -> Lexicon:
    """A lexicon from a JSON file ``{"words": {lang: {key: [patterns]}}, "urls": {key: pattern}}``."""
    with open(path, encoding="utf-8") as handle:
        doc = json.load(handle)
    return Lexicon(doc.get("words"), doc.get("urls"))


def function_word_count(words: Column, lang: str) -> Column:
    vocabulary = F.array(*[F.lit(w) for w in K.FUNCTION_WORDS[lang]])
    return F.size(F.filter(words, lambda w: F.array_contains(vocabulary, w)))


def effective_language(declared: Column, run_lang: str, words: Column) -> Column:
    """The declared language, unless the text reads as the run's language (5 function words, twice the declared's)."""
    base = F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]*)", 1))
    known = list(K.FUNCTION_WORDS)
    if run_lang not in known:
        return F.when(base.isin(*known), base).otherwise(F.lit(run_lang))
    mine = function_word_count(words, run_lang)
    out = F.when(~base.isin(*known), F.lit(run_lang))
    for other in known:
        if other != run_lang:
            theirs = function_word_count(words, other)
            out = out.when((base == other) & (mine >= F.greatest(F.lit(5), theirs * 2)), F.lit(run_lang))
    return out.otherwise(base)
