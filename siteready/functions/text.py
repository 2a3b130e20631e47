"""Text columns: canonical forms, masks, words, prices and countdown times."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NON_ASCII = r"[^\x00-\x7F]"


# The three Unicode forms have no built-in column function; these are the only Python functions of the library, and
# the wrappers below send them non-ASCII rows only.
@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(F.when(text.rlike(NON_ASCII), text)), text)


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(NON_ASCII), text)), text)


def casefold(text: Column) -> Column:
    return F.coalesce(_casefold(F.when(text.rlike(NON_ASCII), text)), F.lower(text))


def squash(text: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed (no Unicode form)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse(text: Column) -> Column:
    """NFC and whitespace collapsed: the form quotes are compared in."""
    return squash(nfc(text))


def normalize(text: Column) -> Column:
    """Key that equal texts share: collapsed and casefolded."""
    return casefold(collapse(text))


def fold(text: Column) -> Column:
    """Collapsed and lower-cased without leaving the JVM: the key of masks and item names.

    ß is the one letter of the supported languages whose casefold differs from its lower case.
    """
    return F.replace(F.lower(squash(text)), F.lit("ß"), F.lit("ss"))


def mask_digits(text: Column) -> Column:
    """fold with every digit run as #."""
    return F.regexp_replace(fold(text), r"\d+", "#")


def mask_numbers(text: Column) -> Column:
    """fold with every number, decimals included, as #."""
    return F.regexp_replace(fold(text), r"\d+([.,]\d+)?", "#")


def words(text: Column, minimum: int = 1) -> Column:
    """Runs of at least `minimum` letters, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}{%d,})" % minimum), 1), F.lower)


def item_tokens(text: Column) -> Column:
    """Distinct letter/digit tokens of two characters or more, folded: what item names are compared by."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]{2,})"), 1))


def same_item(a_norm: Column, b_norm: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """Two labels name one item: equal, all words (two or more) of one in the other, or most words shared."""
    common = F.size(F.array_intersect(a_tokens, b_tokens))
    na, nb = F.size(a_tokens), F.size(b_tokens)
    smaller = F.least(na, nb)
    contained = (smaller >= 2) & (common == smaller)
    jaccard = (na > 0) & (nb > 0) & (common / F.size(F.array_union(a_tokens, b_tokens)) >= F.lit(0.6))
    present = (F.length(a_norm) > 0) & (F.length(b_norm) > 0)
    return present & ((a_norm == b_norm) | contained | jaccard)


# Fixed patterns: a currency mark, an amount with its thousands and decimals, either order.
CURRENCY = r"(?:€|US\$|\$|£|(?<![a-zà-ÿ])(?:euros?|EUR|USD|GBP|CHF)(?![a-zà-ÿ]))"
AMOUNT = (r"(?:\d{1,3}(?:[.,    '’]\d{3})+(?:[.,](?:\d{1,2}|[-–]{1,2}))?"
          r"|\d+(?:[.,](?:\d{1,2}|[-–]{1,2}))?)")
YEAR_AFTER_EURO = r"(?!euros?\s?(?:19|20)\d\d(?![\d.,]))"
PRICE = rf"(?iu)(?:{YEAR_AFTER_EURO}{CURRENCY}\s?{AMOUNT}|{AMOUNT}\s?{CURRENCY})"
CURRENCY_CODES = {"€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "$": "USD", "us$": "USD", "usd": "USD",
                  "£": "GBP", "gbp": "GBP", "chf": "CHF"}


def price_matches(text: Column, pattern: str = PRICE) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def parse_amount(raw: Column) -> Column:
    """The number of an amount as written: the last separator is the decimal one unless exactly three digits follow
    the only kind of separator present."""
    s = F.regexp_replace(F.regexp_replace(raw, r"[    '’]", ""), r"[.,][-–]+$", "")
    both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
    tail = F.length(F.regexp_extract(s, r"[.,](\d*)$", 1))
    any_sep = s.rlike(r"[.,]")
    decimal = both | (any_sep & (tail != 3))
    whole = F.regexp_replace(F.regexp_extract(s, r"^(.*)[.,]\d*$", 1), r"[.,]", "")
    with_decimals = F.concat(whole, F.lit("."), F.regexp_extract(s, r"[.,](\d*)$", 1))
    return F.when(decimal, with_decimals).otherwise(F.regexp_replace(s, r"[.,]", "")).try_cast("double")


def currency_code(match: Column) -> Column:
    mark = F.lower(F.regexp_extract(match, r"(?iu)(€|US\$|\$|£|euros?|EUR|USD|GBP|CHF)", 1))
    codes = F.create_map(*[F.lit(v) for pair in CURRENCY_CODES.items() for v in pair])
    return codes[mark]


def amount_text(match: Column) -> Column:
    return F.regexp_extract(match, f"({AMOUNT})", 1)


def parse_price(text: Column) -> Column:
    """The first number of a text read as a money amount ("1.299,00 €" -> 1299.0); null without one.

    A trailing comma or dot with one or two digits is the decimal part, every other separator groups thousands.
    """
    pattern = (r"(\d{1,3}(?:[.\s']\d{3})+(?:,\d{1,2})?(?!\d)|\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?(?!\d)"
               r"|\d+(?:[.,]\d{1,2})?)")
    raw = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[\s']", "")
    comma = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dot = F.replace(raw, F.lit(","), F.lit(""))
    plain = F.regexp_replace(raw, r"[.,]", "")
    value = F.when(raw.rlike(r",\d{1,2}$"), comma).when(raw.rlike(r"\.\d{1,2}$"), dot).otherwise(plain)
    return value.try_cast("double")


COUNTDOWN = r"(?i)(?:(\d{1,3})\s*(?:days?|d|giorni|giorno|gg?)\.?\s*:?\s*)?(\d{1,2})\s*[:h]\s*(\d{2})\s*[:m]\s*(\d{2})(?!\d)"


def countdown_seconds(text: Column) -> Column:
    """Remaining seconds of "[d days] h:mm:ss"; null without such a time."""
    def part(i):
        return F.coalesce(F.regexp_extract(text, COUNTDOWN, i).try_cast("double"), F.lit(0.0))
    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(text.rlike(COUNTDOWN), total)


def cut_on_word(text: Column, limit: int = 600, keep: int = 500) -> Column:
    """text, or its first `limit` characters cut at the last blank after position `keep`."""
    head = F.substring(text, 1, limit)
    tail = F.regexp_extract(head, r"(\s\S*)$", 1)
    position = F.length(head) - F.length(tail)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.trim(F.when((tail != "") & (position > keep), F.substr(head, F.lit(1), position)).otherwise(head)))


def syllables(word: Column) -> Column:
    """English syllable estimate: vowel groups, a silent final e dropped, at least one."""
    low = F.lower(word)
    groups = F.size(F.regexp_extract_all(low, F.lit(r"([aeiouy]+)"), 1))
    silent = low.rlike("e$") & ~low.rlike("(le|ee)$") & (groups > 1)
    return F.greatest(F.lit(1), groups - silent.cast("int"))
