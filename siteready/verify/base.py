"""Registry of check queries: each has a Spark side and, where SQL can say it, a DuckDB side over the same tables.

Adapter views give the driver's tables the shapes the operators read. Their SQL text is shared by both engines;
EPOCH_US(ts) is the one spelling that differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteready.session import tune

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}      # shared text
DUCK_VIEWS: dict[str, str] = {}  # DuckDB only; Spark has a DataFrame function instead


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def duck_view(name: str, sql: str) -> None:
    DUCK_VIEWS[name] = sql


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _needed(sql: str, found: list[str]) -> None:
    for name in re.findall(r"\b[vd]_[a-z0-9_]+\b", sql):
        text = VIEWS.get(name) or DUCK_VIEWS.get(name)
        if text and name not in found:
            _needed(text, found)
            found.append(name)


def duck_sql(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    ctes = [f"{n} AS MATERIALIZED ({(VIEWS.get(n) or DUCK_VIEWS.get(n)).strip()})" for n in names]
    body = sql.strip()
    if ctes and body[:15].upper() == "WITH RECURSIVE ":
        out = "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    elif ctes and body[:5].upper() == "WITH ":
        out = "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    elif ctes:
        out = "WITH " + ",\n".join(ctes) + "\n" + body
    else:
        out = body
    return re.sub(r"EPOCH_US\(([^()]+)\)", r"epoch_us(\1)", out)


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(sql) for name, sql in ORACLES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared adapter view as a DataFrame."""
    names: list[str] = []
    _needed(VIEWS[name], names)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + VIEWS[name].strip()
    text = re.sub(r"EPOCH_US\(([^()]+)\)", r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", text)
    text = re.sub(rf"(?i)\b(from|join)\s+({'|'.join(TABLES)})\b",
                  lambda m: f"{m.group(1)} parquet.`{sf_dir}/{m.group(2)}.parquet` {m.group(2)}", text)
    return spark.sql(text)


def half_even(expr: str, digits: int) -> str:
    """DuckDB text that rounds a double by its exact binary value, halves to even (the Spark side's rule)."""
    if digits == 0:
        return f"round_even(({expr})::DOUBLE, 0)"
    s = float(10 ** digits)
    c = s * 134217729.0
    sh = c - (c - s)
    sl = s - sh
    h = "(134217729.0::DOUBLE*v - (134217729.0::DOUBLE*v - v))"
    q = f"(v*{s!r}::DOUBLE)"
    err = (f"((({h}*{sh!r}::DOUBLE - {q}) + {h}*{sl!r}::DOUBLE + (v-{h})*{sh!r}::DOUBLE) + (v-{h})*{sl!r}::DOUBLE)")
    r = f"round_even({q}, 0)"
    return (f"list_transform([({expr})::DOUBLE], lambda v: (CASE WHEN abs({q} - {r}) = 0.5 AND {err} < 0 "
            f"THEN floor({q}) WHEN abs({q} - {r}) = 0.5 AND {err} > 0 THEN ceil({q}) ELSE {r} END) / {s!r}::DOUBLE)[1]")
