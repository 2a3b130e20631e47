"""A cross-section of the registered queries against DuckDB on the smallest tables, and the flagship smoke run."""

import duckdb
import pytest

import __spark_entry__ as entry
from siteready.verify.base import TABLES

SF = "/root/testdata/sf0.001"
PICK = ["join_02_points_band", "agg_13_noisy_or", "win_01_dedup_steps", "win_02_visits", "win_03_rage", "agg_30_majority_vote", "agg_23_network_summary", "win_07_layout_shift", "join_18_as_of_since",
        "join_13_pair_countdowns", "agg_45_consent_asymmetry", "ora_02_item_under_price", "txt_03_prices", "txt_08_prose_stats", "top_03_listing_candidates", "str_03_rage", "str_10_late_rows", "src_02_read_steps"]


def _canon(v):
    number = isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal"
    return None if v is None else f"{float(v):.6g}" if number else str(v)


@pytest.mark.parametrize("name", PICK)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(str([_canon(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted(str([_canon(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
