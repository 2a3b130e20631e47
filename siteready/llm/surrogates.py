"""PII surrogates: detected entities get keyed replacements of their own type, format, gender and script.

An entity is a kind and a canonical value (digits of a phone or card number, lower-cased address or name), so mentions
in other spellings are the same entity. A surrogate is drawn from an HMAC of key, kind, value and attempt and keeps the
format: letters stay letters of the same case, digits digits, punctuation and length stay; card numbers keep their Luhn
check, account numbers their check digits, addresses of one domain share a new domain, names are replaced by names of
the same gender and script. The new value is laid over each mention's own spelling.

Collisions are checked over the whole corpus: a surrogate must not equal an entity that occurs, nor another entity's
surrogate; of those that clash the least entity keeps it and the others draw again, until none clash. The first draws
keep the exact form; from attempt WIDE on, characters without a class of their own (masks, other scripts) and the
lengths of address octets are drawn too, and from attempt LONGER on each attempt is one character longer than the one
before, so that no form can run out. Distinct entities
so stay distinct, and one entity has one surrogate everywhere. All of it is joins on entities and on surrogates; no
list of entities is broadcast or collected.

Defined cases: null texts stay null and empty ones empty; overlapping finds go to the first, then the kind named first
in KINDS; rows with equal doc_id and text are treated alike; an empty table gives no rows; extra columns are kept only
if named.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteready.llm.tasks import map_slices, stored

#: Given names by script and gender, and family names by script; the surrogates are drawn from the same lists.
NAMES = {
    "latin": (
        "James John Robert Michael William David Richard Thomas Charles Daniel Peter Hans Klaus Jürgen Pierre Jean Louis Carlos José Miguel".split(),
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Ursula Monika Sabine Marie Claire Sophie Carmen Lucía Isabel".split(),
        "Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Clark Schmidt Weber Fischer Wagner Dubois Moreau Laurent García Fernández López".split()),
    "cyrillic": (
        "Иван Сергей Дмитрий Алексей Николай Владимир Михаил Андрей".split(), "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
        "Соколенко Шевченко Бондаренко Коваленко Ткаченко Кравченко Павленко Марченко".split()),
    "greek": (
        "Γιώργος Νίκος Δημήτρης Γιάννης Κώστας Παναγιώτης".split(), "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
        "Οικονόμου Παππά Γεωργίου Δημητρίου Κωνσταντίνου Νικολάου".split()),
}
_GIVEN = {n.lower(): (script, gender) for script, lists in NAMES.items() for gender in (0, 1) for n in lists[gender]}
_GIVEN_PATTERN = "|".join(sorted((n for lists in NAMES.values() for g in lists[:2] for n in g), key=len, reverse=True))

KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "account": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?i:(?<=password=)|(?<=passwd=)|(?<=pwd=)|(?<=secret=)|(?<=password: )|(?<=api_key=)|(?<=token=)|(?<=token = \")|(?<=key = \")|(?<=secret = \"))[^\s\"',;]{6,}",
    "token": r"\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w+-])\d{4}(?:[ -]?\d){9,15}(?!\w)",
    "national_id": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "person": rf"\b(?:{_GIVEN_PATTERN}) [^\W\d_a-z][^\W\d_]+\b",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
#: A text without any of these holds no entity; a quick look before the search.
_HINT = re.compile(rf"[@\d]|(?i:passw|pwd|secret|token|key)|(?:{_GIVEN_PATTERN}) ")
_CASELESS = ("email", "person")
#: Attempts from which a surrogate may leave the exact form, and from which it grows.
WIDE, LONGER = 2, 6
_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and canonical value of each entity."""
    if not _HINT.search(text):
        return
    for m in _ANY.finditer(text):
        kind, said = m.lastgroup, m.group()
        if kind == "person" and said.split(" ")[1].islower():
            continue
        if kind in ("phone", "card", "national_id"):
            value = re.sub(r"\D", "", said)
        elif kind == "account":
            value = said.replace(" ", "")
        else:
            value = said.lower() if kind in _CASELESS else said
        yield m.start(), m.end(), kind, value


class _Draws:
    """Keyed choices, the same on every machine."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.number, self.pool = key, "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + b"\0%d" % self.number, hashlib.sha256).digest()
            self.number += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str, wide: bool = False) -> str:
        """Each ASCII letter and digit by another of its class; the rest stays, or if wide becomes a letter or digit.
        Words of other scripts lose no letter class."""
        drawn = (self._one(c) for c in text)
        return "".join(self.some(1) if wide and n == c and not (c.isascii() and c.isalnum()) else n for n, c in zip(drawn, text))

    def some(self, n: int, alphabet: str = _ALNUM) -> str:
        return "".join(alphabet[self.below(len(alphabet))] for _ in range(n))

    def _one(self, c: str) -> str:
        for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"):
            if c in alphabet:
                return alphabet[self.below(len(alphabet))]
        return self._one(c.lower()).upper() if c.isalpha() and c.lower() != c and self._one(c.lower()) != c.lower() else c


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical replacement of a canonical value."""
    draws, more = _Draws(key, kind, value, str(attempt)), max(0, attempt - LONGER + 1)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        name, _, top = domain.rpartition(".")
        # Drawn from the domain alone, so that all its addresses keep one domain; fresh room is in the local part.
        return f"{draws.like(local)}{draws.some(more)}@{_Draws(key, 'domain', domain).like(name)}.{top}"
    if kind == "ip":
        if attempt >= WIDE:
            return ".".join(str(draws.below(256)) for _ in range(4 + more))
        return ".".join(str(draws.below(9) + 1 if len(o) == 1 else draws.below(90) + 10 if len(o) == 2 else draws.below(155) + 100) for o in value.split("."))
    if kind == "phone":
        # The first digit is the country's or the area's and stays.
        return value[0] + "".join(str(draws.below(9) + 1 if i == 0 else draws.below(10)) for i in range(len(value) - 1 + more))
    if kind == "card":
        body = value[0] + draws.like(value[1:-1]) + draws.some(more, "0123456789")
        check = -_luhn(body + "0") % 10
        return body + str(check if _luhn(value) == 0 else (check + 1 + draws.below(9)) % 10)
    if kind == "account":
        body = draws.like(value[4:]) + draws.some(more, "0123456789")
        number = int("".join(str(int(c, 36)) for c in body + value[:2])) * 100
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "access_key":
        return value[:4] + draws.some(len(value) - 4 + more, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    if kind == "token":
        return draws.some(len(value) + more, "0123456789abcdef")
    if kind == "person":
        script, gender = _GIVEN[value.split(" ")[0]]
        lists = NAMES[script]
        family = lists[2][draws.below(len(lists[2]))].lower()
        # The lists are short; later attempts build a family name.
        return f"{lists[gender][draws.below(len(lists[gender]))].lower()} {family if attempt < 4 else draws.like(family + family[:1] * more)}"
    if kind == "national_id":
        return draws.like(value) + draws.some(more, "0123456789")
    return draws.like(value, attempt >= WIDE) + draws.some(more)


def _capitals(new: str, said: str) -> str:
    """new with the capitals of an address: part by part, as the local part may have grown."""
    return "@".join("".join(n.upper() if s.isupper() else n for n, s in zip_longest(a, b[:len(a)], fillvalue="a")) for a, b in zip(new.split("@"), said.split("@")))


def lay_over(kind: str, new: str, said: str) -> str:
    """The canonical replacement in the spelling of a mention: its separators and its capitals."""
    if kind in ("phone", "card", "national_id"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in said) + "".join(digits)
    if kind == "account" and " " in said:
        return " ".join(new[i:i + 4] for i in range(0, len(new), 4))
    if kind == "person":
        return new.upper() if said.isupper() else " ".join(w[:1].upper() + w[1:] for w in new.split(" "))
    if kind == "email" and said != said.lower():
        return _capitals(new, said)
    return new


def _proposed(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([surrogate(k, v, key, attempt) for k, v in zip(kinds, values)], pa.string())], names=["kind", "value", "new"])

    return entities.select("kind", "value").mapInArrow(run, "kind string, value string, new string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, new for distinct entities (kind, value), without clashes."""
    settled, waiting, attempt = None, entities, 0
    while True:
        drawn = _proposed(waiting, key, attempt)
        taken = entities.select("kind", F.col("value").alias("new"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "new"))
        # The first of those that draw the same value and that nobody has.
        state = drawn.withColumn("turn", F.row_number().over(Window.partitionBy("kind", "new").orderBy("value"))).join(taken.distinct().withColumn("used", F.lit(True)), ["kind", "new"], "left")
        state = stored(state.select("kind", "value", "new", ((F.col("turn") == 1) & F.col("used").isNull()).alias("free")), "surrogates")
        done = state.where("free").select("kind", "value", "new")
        settled = done if settled is None else settled.unionByName(done)
        waiting, attempt = state.where(~F.col("free")), attempt + 1
        if waiting.limit(1).count() == 0:
            return settled


def replace_entities(docs: DataFrame, key: bytes, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the kept columns, text with surrogates, n_entities (mentions replaced)."""

    def finder():
        return lambda column: [[[{"kind": k, "value": v} for _, _, k, v in find(t or "")] for t in column.to_pylist()]]

    named = docs.select("doc_id", *(c for c in keep if c not in ("doc_id", "text", "n_entities")), "text", F.xxhash64("text").alias("v"))
    found = stored(map_slices(named, "text", ("doc_id", "v"), "entities array<struct<kind: string, value: string>>", finder).where(F.size("entities") > 0).distinct(), "entities")
    each = found.select("doc_id", "v", F.explode(F.array_distinct("entities")).alias("e")).select("doc_id", "v", "e.kind", "e.value")
    new = assign(stored(each.select("kind", "value").distinct(), "entities"), key)
    maps = each.join(new, ["kind", "value"]).groupBy(F.col("doc_id").alias("d"), F.col("v").alias("w")).agg(F.collect_list(F.struct("kind", "value", "new")).alias("new"))
    joined = named.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("v") == F.col("w")), "left")
    kept = [c for c in named.columns if c not in ("text", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by, parts, at, n = {(e["kind"], e["value"]): e["new"] for e in new or ()}, [], 0, 0
                for start, end, kind, value in find(text) if new else ():
                    parts += text[at:start], lay_over(kind, by[kind, value], text[start:end])
                    at, n = end, n + 1
                texts.append(text if not n else "".join([*parts, text[at:]]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*kept, "text", "n_entities"])

    source = joined.select("text", "new", *kept)
    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType())]))
