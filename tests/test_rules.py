"""Rule ladders and pairings on small hand-made tables."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from siteready import api
from siteready.dims.catalog import check_parity, default_catalog, default_rubrics
from siteready.functions import text as T
from siteready.functions import urls as U
from siteready.functions.lexicon import Lexicon
from siteready.operators import judgments as J
from siteready.operators import pages as P
from siteready.operators import risk as R
from siteready.operators import scoring as S


def test_catalog_is_complete():
    catalog = default_catalog()
    check_parity(catalog)
    assert len(catalog.kpis) == 89 and len(default_rubrics()) == 7
    assert [len(catalog.by_owner(o)) for o in ("FAI", "PERF", "TRI", "CCL", "DPR", "PTI", "MPI")] == [29, 16, 13, 9, 9, 8, 5]
    assert [len(catalog.by_producer(p)) for p in ("checks", "friction", "judgments", "deception")] == [64, 12, 7, 6]


@pytest.mark.parametrize("perf, expected", [(55.0, 64.3), (20.0, 53.6)])
def test_headline_worked_example(spark, perf, expected):
    scores = {"FAI": 70.0, "TRI": 80.0, "PTI": 60.0, "CCL": 75.0, "PERF": perf, "MPI": 40.0}
    sub = spark.createDataFrame([(1, "overall", o, s, 1.0, 0.0) for o, s in scores.items()], "run_id int, scope string, owner string, exact_score double, exact_coverage double, exact_share double")
    risk = spark.createDataFrame([(1, "overall", 0.0)], "run_id int, scope string, risk_score double")
    row = S.headline(sub, risk).first()
    assert row.published and row.score == expected and row.grade == "A"


def test_headline_gates(spark):
    rows = [(1, "overall", o, 50.0, 0.4 if o == "TRI" else 0.9, 0.0) for o in ("FAI", "TRI", "PTI", "CCL", "PERF")]
    sub = spark.createDataFrame(rows, "run_id int, scope string, owner string, exact_score double, exact_coverage double, exact_share double")
    row = S.headline(sub, spark.createDataFrame([], "run_id int, scope string, risk_score double")).first()
    assert not row.published and row.score is None and row.reason == "major_coverage_below_minimum:TRI"


def _obs(spark, rows):
    return spark.createDataFrame([(1, i, k, "bool", None, v, None, "deterministic", p, a, r) for i, (k, v, p, a, r) in enumerate(rows)],
                                 "run_id int, ord long, kpi_id string, value_type string, value_num double, value_bool boolean, value_str string, source string, profile string, assessed boolean, reason string")


def test_false_any_needs_every_page(spark):
    rows = [("FAI.GUEST_CHECKOUT", False, "mobile", True, None), ("FAI.GUEST_CHECKOUT", None, "mobile", False, "not_reached"), ("FAI.GUEST_CHECKOUT", True, "desktop", True, None)]
    got = {r.scope: (r.value_bool, r.assessed, r.reason) for r in S.aggregate_kpis(_obs(spark, rows)).collect()}
    assert got == {"overall": (True, True, None), "mobile": (None, False, "not_reached"), "desktop": (True, True, None)}


def test_worst_profile_is_named_only_when_strictly_worse(spark):
    both = [("TRI.HTTPS", False, "mobile", True, None), ("TRI.HTTPS", True, "desktop", True, None)]
    row = S.aggregate_kpis(_obs(spark, both)).where("scope = 'overall'").first()
    assert (row.value_bool, row.worst_profile) == (False, "mobile")
    row = S.aggregate_kpis(_obs(spark, [(k, False, p, a, r) for k, _, p, a, r in both])).where("scope = 'overall'").first()
    assert (row.value_bool, row.worst_profile) == (False, None)


def test_same_item_join_equals_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = ["red", "blue", "shoe", "bag", "big", "kit", "xl", "a"]
    names = sorted({" ".join(rnd.sample(vocabulary, rnd.randint(1, 5))) for _ in range(60)})

    def same(a, b):
        ta, tb = set(re.findall(r"[a-z0-9]{2,}", a)), set(re.findall(r"[a-z0-9]{2,}", b))
        small, big = sorted((ta, tb), key=len)
        return a == b or (len(small) >= 2 and small <= big) or (bool(ta and tb) and len(ta & tb) / len(ta | tb) >= 0.6)

    df = spark.createDataFrame([(1, n) for n in names], "run_id int, n string")
    left, right = df.select("run_id", F.col("n").alias("left_id"), F.col("n").alias("left_name")), df.select("run_id", F.col("n").alias("right_id"), F.col("n").alias("right_name"))
    got = {(r.left_id, r.right_id) for r in R.same_item_join(left, right, ["run_id"]).collect()}
    assert got == {(a, b) for a, b in itertools.product(names, names) if same(a, b)}


def test_modes_that_nobody_asked_for_are_not_merged(spark):
    rows = [("TRI.HTTPS", False, "mobile", True, None), ("TRI.HTTPS", True, "desktop", True, None), ("TRI.HTTPS", True, None, False, "timeout")]
    whole = S.aggregate_kpis(_obs(spark, rows))
    mode = whole.first().aggregate_mode
    some = whole.where(F.col("aggregate_mode") == mode)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"aggregate_mode#\d+ = {mode}\)", plan[plan.index("Generate explode"):])
    result = lambda df: sorted(map(str, df.select("scope", "value_bool", "assessed", "reason", "n_rows").collect()))
    assert result(some) == result(whole) and whole.where(F.col("aggregate_mode") != mode).count() == 0


@pytest.mark.parametrize("together", [0, 150, 10**6])
def test_same_item_join_is_the_same_for_short_and_crowded_keys(spark, monkeypatch, together):
    monkeypatch.setattr(R, "TOGETHER", together)
    names = ["red shoe", "red shoe xl", "blue bag", "bag", "big kit", "red bag", "a", "shoe red"]
    rows = [(k, f"{k}{n}", n) for k, of in ((1, names), (2, names * 2), (None, names)) for n in of]
    left = spark.createDataFrame(rows, "run_id int, left_id string, left_name string")
    right = left.withColumnsRenamed({"left_id": "right_id", "left_name": "right_name"})
    got = [(r.run_id, r.left_id[1:], r.right_id[1:]) for r in R.same_item_join(left, right, ["run_id"]).collect()]
    one = {("red shoe", "red shoe xl"), ("red shoe", "shoe red"), ("red shoe xl", "shoe red")}
    pairs = one | {(b, a) for a, b in one} | {(n, n) for n in names}
    assert sorted(got) == sorted((k, a, b) for k in (1, 2) for a, b in pairs)


@pytest.mark.parametrize("folded, together", [(0, 0), (6, 3), (4096, 16_384)])
def test_unexplained_fees_are_the_same_for_short_and_long_runs(spark, monkeypatch, folded, together):
    monkeypatch.setattr(R, "FOLDED", folded)
    monkeypatch.setattr(R, "TOGETHER", together)
    fees = [(1, 1, "handling fee"), (1, 2, "Packing 2 surcharge"), (1, 2, "Packing 3 surcharge"), (1, 3, "sales tax"), (1, 4, "xyz"),
            (1, 5, "gift wrap"), (1, 6, "shipping desk"), (2, 1, "handling fee"), (2, None, "insurance premium"), (2, 2, "shipping desk"),
            (3, 1, "handling fee"), (3, 1, "handling desk"), (None, 1, "shipping desk"), (None, 2, "handling fee")]
    fees = spark.createDataFrame([(*f, 1.0) for f in fees], "run_id int, fee_id int, label string, value double")
    told = spark.createDataFrame([(1, "packing"), (1, "surcharge"), (2, "handling"), (3, "handling"), (3, None)], "run_id int, word string")
    counted = spark.createDataFrame([(1, "gift wrap"), (1, "gift wrap paper")], "run_id int, label string")
    stated = spark.createDataFrame([(1,), (1,)], "run_id int")

    def result(*shipping):
        return {r.run_id: r.unexplained for r in R.unexplained_fees(fees, told, counted, Lexicon(), *shipping).collect()}

    assert result(stated) == {1: 2, 2: 1, 3: 2, None: 1}
    assert result() == {1: 3, 2: 1, 3: 2}


def test_task_pages_bound_tasks_and_characters(spark):
    rnd = random.Random(8)
    sizes = [rnd.choice([100, 3000, 9000, 40000]) for _ in range(80)]
    expected, page, n, used = [], 0, 0, 0
    for s in sizes:
        if n and (used + s > 36000 or n >= 15):
            page, n, used = page + 1, 0, 0
        n, used = n + 1, used + s
        expected.append(page)
    df = spark.createDataFrame([(1, i, str(i), s) for i, s in enumerate(sizes)], "run_id int, task_ord int, task_id string, chars long")
    got = {int(r.task_id): r.page for r in J.page_tasks(df).collect()}
    assert [got[i] for i in range(80)] == expected


def test_unicode_forms_and_personal_text(spark):
    rows = [("mario＠gmail．com",), ("XR12ABCDEF12345",), ("IT60X0542811101000000123456",), ("12 High Street",), ("nothing here",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.pii_kind(F.col("t"))).collect()]
    assert got == ["an email address", None, "a card, phone or account number", "a street address", None]
    assert spark.createDataFrame([("STRASSE Straße é",)], "t string").select(T.normalize(F.col("t"))).first()[0] == "strasse strasse é"


def test_urls(spark):
    urls = ["HTTPS://Shop.Example/a?b=2&a=1#x", "https://s.example", "about:blank", "https://s.example/cart?add-to-cart=7&x=1", "https://s.example/cart/add"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(U.page_key(F.col("u")).alias("k"), U.clean_cart_url(F.col("u")).alias("c")).collect()
    assert [r.k for r in rows[:3]] == ["https://shop.example/a?a=1&b=2", "https://s.example/", None]
    assert [r.c for r in rows[3:]] == ["https://s.example/cart?x=1", None]
    hosts = ["shop.example.co.uk", "a.b.com.vn", "x.altervista.org", "10.0.0.1", "localhost", "www.site.com"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(U.registrable_domain(F.col("h"))).collect()]
    assert got == ["example.co.uk", "b.com.vn", "x.altervista.org", "10.0.0.1", "localhost", "site.com"]


def test_prices(spark):
    rows = [("1.299,00 €", 1299.0), ("€49.90", 49.9), ("49,90", 49.9), ("1,299.00", 1299.0), ("none", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, v double").select(T.parse_price(F.col("t"))).collect()]
    assert got == [v for _, v in rows]


def test_oracle_parameters():
    spec = api.ORACLE_PARAMS["cart_contains_item_under_price"]
    assert api.check_params(spec, {"max_price": "49,90"}) == {"max_price": 49.9}
    for bad in ({}, {"max_price": 0}, {"max_price": True}, {"max_price": "x"}, {"other": 1, "max_price": 2}):
        with pytest.raises(ValueError):
            api.check_params(spec, bad)


def test_raw_rows_meet_the_registry_only_and_medians_follow_their_scopes(spark):
    catalog = default_catalog()
    kpi = next(k.id for k in catalog.kpis.values() if k.aggregate == "median")
    best = next(k for k in catalog.kpis.values() if k.aggregate == "best" and k.mapping)
    rnd = random.Random(5)
    rows = [(run, i, kpi, rnd.choice([None, "a", "b"]), "number", rnd.choice([0.0, 3.0, 3.001, 3.002, -7.5, 1e6]), None, None)
            for run, n in ((1, 40), (2, 7), (3, 1)) for i in range(n)]
    keys = sorted((key for key, score in best.mapping if score is not None), key=dict(best.mapping).get)
    rows += [(4, i, best.id, "a", "enum", None, None, key) for i, key in enumerate([keys[0], keys[-1], "unknown key"])]
    rows += [(5, 0, kpi, None, "number", None, "timeout", None), (5, 1, kpi, "a", "number", None, "not_applicable", None)]
    obs = spark.createDataFrame(rows, "run_id long, ord long, kpi_id string, profile string, value_type string, value_num double, reason string, value_str string")
    obs = obs.withColumns({"value_bool": F.lit(None).cast("boolean"), "assessed": F.col("reason").isNull()})
    assert S.prepare_rows(obs, catalog)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    grouped = S._grouped(*S.partials(obs, catalog), catalog, None).collect()
    for r in grouped:
        mine = sorted(x[5] for x in rows if x[0] == r.run_id and x[5] is not None and (r.scope == "overall" or x[3] in (None, r.scope)))
        want = (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2 if mine else None
        assert (r.run_id, r.scope, r.median_x) == (r.run_id, r.scope, want if r.kpi_id == kpi else None)
    by = {(r.run_id, r.scope): r for r in grouped}
    assert by[4, "overall"].best_v.v.value_str == keys[-1] and by[5, "overall"].pending.why == "timeout"
    assert by[5, "a"].worst_reason.why == "timeout" and by[5, "a"].pending.why == "timeout" and (by[3, "overall"].pending, by[3, "overall"].worst_reason) == (None, None)


def test_page_checks_make_their_cells_in_compiled_code(spark):
    from siteready.operators import checks as C
    pages = spark.createDataFrame([(1, 10, 1, "a", "pdp", True, 3), (1, 11, 2, "a", "cart", False, 0)],
                                  "run_id long, page_id long, page_ord long, profile string, stage string, has_doc boolean, requests int")
    out = C.page_kpis(pages.withColumn("signals", F.array(F.lit("none"))))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lambdafunction" not in plan and "explode(array(" not in plan and "explode(_cells" in plan
    got = {(r.page_id, r.kpi_id): r for r in out.collect()}
    assert len(got) == out.count() and got[10, "PERF.REQUESTS"].value_num == 3.0 and got[11, "PERF.REQUESTS"].assessed
    assert got[11, "CCL.HEADINGS"].reason == "audit_unavailable" and not got[11, "CCL.HEADINGS"].assessed
    assert (11, "FAI.PDP_CTA_ABOVE_FOLD") not in got and (10, "FAI.CART_EDITABLE") not in got
