"""URL columns: page identity, registrable domain, same-site tests and cart-action cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteready.dims import constants as K

# Query keys and path segments whose GET changes a cart.
CART_ACTION_KEYS = (r"(?i)^(add|add[-_]to[-_]cart|add[-_]item|remove|remove[-_]item|removed[-_]item|undo[-_]item|delete"
                    r"|update|update[-_]cart|empty[-_]cart|clear[-_]cart|action|op|quantity|qty|_?wpnonce"
                    r"|aggiungi|rimuovi|elimina|svuota|aggiorna|quantit[aà]|qt[aà]|azione)$")
CART_ACTION_SEGMENTS = ("add", "change", "update", "clear", "remove", "delete", "empty",
                        "aggiungi", "rimuovi", "elimina", "svuota", "aggiorna", "modifica")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased host name without user info and port; empty when there is none."""
    without_user = F.regexp_replace(F.lower(authority(url)), r"^.*@", "")
    return F.regexp_replace(without_user, r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_and_query(url: Column) -> Column:
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(query(url) == "", p).otherwise(F.concat(p, F.lit("?"), query(url)))


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def _decoded(part: Column) -> Column:
    """A query key or value as text; one that is no valid encoding stays."""
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Form encoding: blanks as +, and letters, digits and _.-~ as they are."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def page_key(url: Column) -> Column:
    """The page a web URL shows: scheme and host lower-cased, fragment dropped, query pairs decoded, sorted by key and
    value and encoded again, empty path "/".

    Anything that is not http(s) has no page and gives null.
    """
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    q = F.concat_ws("&", F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))))
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    base = F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), p)
    return F.when(is_web(url), F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))


def registrable_domain(host_col: Column) -> Column:
    """The last two labels of a host, three below a listed or generic second-level suffix; IPs and single labels as is."""
    name = F.regexp_replace(F.lower(F.trim(host_col)), r"\.+$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    suffixes = F.array(*[F.lit(s) for s in K.PUBLIC_SUFFIXES])
    last2 = F.concat_ws(".", F.slice(labels, -2, 2))
    last3 = F.concat_ws(".", F.slice(labels, F.greatest(-n, F.lit(-3)), 3))
    second = F.element_at(labels, -2)
    as_is = (name == "") | F.contains(name, F.lit(":")) | name.rlike(r"^[\d.]+$") | (n < 2)
    listed = (n > 2) & F.array_contains(suffixes, last2)
    generic = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & second.isin(*K.GENERIC_SECOND_LEVEL)
    return F.when(as_is, name).when(listed | generic, last3).otherwise(last2)


def same_site(url: Column, start_url: Column) -> Column:
    """Same registrable domain and a web scheme; an empty URL or about:blank counts as the same site."""
    blank = url.isNull() | (url == "") | (url == "about:blank")
    mine, theirs = registrable_domain(host(url)), registrable_domain(host(start_url))
    return blank | (is_web(url) & (mine != "") & (mine == theirs))


def query_keys(url: Column) -> Column:
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.regexp_extract(p, r"^([^=]*)", 1))


def cart_action_keys(url: Column, pattern: str = CART_ACTION_KEYS) -> Column:
    """The query keys of url that would change a cart, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(query_keys(url), lambda k: k.rlike(pattern))))


def has_cart_action_path(url: Column, segments=CART_ACTION_SEGMENTS) -> Column:
    return F.arrays_overlap(F.split(F.lower(path(url)), "/"), F.array(*[F.lit(s) for s in segments]))


def clean_cart_url(url: Column, pattern: str = CART_ACTION_KEYS, segments=CART_ACTION_SEGMENTS) -> Column:
    """url without fragment and cart-action keys; null when its path itself names a cart action."""
    parts = F.filter(F.split(query(url), "&"),
                     lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(pattern))
    q = F.concat_ws("&", parts)
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return (F.when(has_cart_action_path(url, segments), F.lit(None))
            .otherwise(F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))))


# Locale prefixes, index pages and tracking keys of a home URL.
HOME_PATH = (r"(?i)^/?(((it|en|de|fr|es|pt|nl|pl|sv|da|fi|no|nb|nn|cs|sk|hu|ro|bg|el|hr|sl|sr|ru|uk|tr|ar|he|ja|zh|ko|"
             r"lt|lv|et|ca|eu|gl|ga|is|mt|lb|us|gb|ch|at|be|au|ie|br|mx|int)([-_][a-z]{2})?)/?)?"
             r"((index|home|default)\.(html?|php|aspx?))?$")
INDEX_PAGE = r"(?i)^(.*/)?(index|home|default)\.(html?|php|aspx?)/*$"
NEUTRAL_QUERY = (r"(?i)^(utm_[a-z_]+|gclid|fbclid|msclkid|dclid|srsltid|mc_[a-z]+|ref|lang|language|locale|currency|"
                 r"country|_ga|_gl)$")
HOME_ROUTE = r"(?i)(^|/)(home|index)$"


def is_home(url: Column) -> Column:
    """A root, locale or index path whose query keys route nowhere else."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    routes = F.exists(parts, lambda p: ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(NEUTRAL_QUERY)
                      & ~F.regexp_extract(p, r"^[^=]*=?(.*)$", 1).rlike(HOME_ROUTE))
    return ~routes & (path(url).rlike(HOME_PATH) | path(url).rlike(INDEX_PAGE))


def host_slug(url_or_host: Column) -> Column:
    """A folder-safe host name, with the port when there is one."""
    text = F.when(F.contains(url_or_host, F.lit("//")), F.regexp_extract(url_or_host, r"//([^/?#]*)", 1)).otherwise(
        F.regexp_extract(url_or_host, r"^([^/?#]*)", 1))
    name = F.regexp_replace(F.lower(text), r"^.*@", "")
    with_port = F.regexp_replace(name, r":(\d+)$", "-$1")
    slug = F.regexp_replace(F.regexp_replace(with_port, r"[^a-z0-9.\-]+", "-"), r"^[.\-]+|[.\-]+$", "")
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)
