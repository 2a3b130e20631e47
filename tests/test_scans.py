"""Chunked scans with tiny chunks against a plain pass in Python: chunk borders must not show."""

import random
import time

from pyspark.sql import functions as F

from siteready.operators import events as E
from siteready.operators import judgments as J
from siteready.operators import risk, scan
from siteready.operators.components import components
from siteready.operators.scan import with_last, with_previous, with_running


def _rows(seed, n=120):
    rnd = random.Random(seed)
    return [(rnd.randint(1, 3), i * rnd.choice([1, 1, 1]) + (i // 40) * 50, rnd.randint(0, 4)) for i in range(n)]


def test_previous_rows_across_chunks(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "k int, o long, v int")
    got = {(r.k, r.o): (r.prev1 and r.prev1.v, r.prev2 and r.prev2.v, r.prev3 and r.prev3.v) for r in with_previous(df, ["k"], "o", ["v"], 3, chunk=4).collect()}
    for k in (1, 2, 3):
        seq = sorted((o, v) for kk, o, v in rows if kk == k)
        for i, (o, _) in enumerate(seq):
            assert got[(k, o)] == tuple(seq[i - j][1] if i >= j else None for j in (1, 2, 3))


def test_running_and_last_across_chunks(spark):
    rows = _rows(4)
    df = spark.createDataFrame(rows, "k int, o long, v int")
    run = {(r.k, r.o): r.s for r in with_running(df, ["k"], "o", {"s": F.col("v")}, chunk=5).collect()}
    last = {(r.k, r.o): r.m for r in with_last(df, ["k"], "o", {"m": F.when(F.col("v") == 4, F.col("o"))}, chunk=5).collect()}
    for k in (1, 2, 3):
        total, mark = 0, None
        for o, v in sorted((o, v) for kk, o, v in rows if kk == k):
            total += v
            mark = o if v == 4 else mark
            assert run[(k, o)] == total and last[(k, o)] == mark


def test_layout_shift_windows(spark):
    rnd = random.Random(5)
    rows, expected = [], {}
    for run in range(12):
        at, first, last, win, best = 0.0, -1.0, -1.0, 0.0, 0.0
        for i in range(40):
            at += rnd.choice([100, 400, 900, 1000, 1500])
            v, hidden = rnd.choice([1, 2, 3]) / 64, rnd.random() < 0.2
            rows.append((run, 0, i, at, v, hidden))
            if not hidden:
                win, first = (win + v, first) if first >= 0 and at - last < 1000 and at - first < 5000 else (v, at)
                last, best = at, max(best, win)
        expected[run] = round(best, 4)
    df = spark.createDataFrame(rows, "run_id int, page_id int, seq long, start_ms double, value double, had_input boolean")
    assert {r.run_id: r.cls for r in E.layout_shift(df).collect()} == expected


def test_layout_shift_of_a_page_without_pause(spark):
    rnd = random.Random(8)
    rows, at, first, last, win, best = [], 0.0, -1.0, -1.0, 0.0, 0.0
    for i in range(3000):
        at += rnd.choice([1, 30, 200, 900])
        v = rnd.choice([1, 2, 3]) / 64
        rows.append((1, 0, i, at, v, False))
        win, first = (win + v, first) if first >= 0 and at - last < 1000 and at - first < 5000 else (v, at)
        last, best = at, max(best, win)
    df = spark.createDataFrame(rows, "run_id int, page_id int, seq long, start_ms double, value double, had_input boolean")
    assert [r.cls for r in E.layout_shift(df).collect()] == [round(best, 4)]


def test_layout_shift_of_many_shifts_in_one_span(spark):
    """80,000 shifts in a span: work that grows with their square takes minutes."""
    df = spark.range(120_000).selectExpr("1L as run_id", "0L as page_id", "id as seq", "id / 16D as start_ms", "1 / 64D as value", "false as had_input")
    began = time.monotonic()
    assert [r.cls for r in E.layout_shift(df).collect()] == [80_000 / 64]
    assert time.monotonic() - began < 90


def test_task_pages_of_short_and_long_runs_agree(spark):
    rnd, rows, want = random.Random(3), [], {}
    for run, n in ((1, 700), (2, 3), (3, 60), (4, 0)):
        page, count, used = 0, 0, 0
        for i in range(n):
            chars = rnd.choice([10, 900, 4000, 20000, 50000])
            rows.append((run, f"t{i}", i * 7, chars))
            if count and (used + chars > 36000 or count >= 15):
                page, count, used = page + 1, 0, 0
            count, used = count + 1, used + chars
            want[run, f"t{i}"] = page
    df = spark.createDataFrame(rows, "run_id long, task_id string, task_ord long, chars long")
    for together in (10_000, 5):
        assert {(r.run_id, r.task_id): r.page for r in J.page_tasks(df, together=together).collect()} == want


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(200, 240)] + [(300, 300), (None, 5), (8, None), (401, 400), (400, 401)]
    links += [(rnd.randint(1000, 1100), rnd.randint(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_product_clusters_match_pairs(spark):
    rnd, rows = random.Random(11), []
    for i in range(160):
        title = rnd.choice(["Shoe", "shoe red", "Shoe Red 42", "Hat", "Hat blue", "Hatter", "", None, "Bag", "Bag - Large"])
        rows.append((i % 3, i, rnd.choice([None, "", f"u{rnd.randint(0, 40)}"]), rnd.choice([None, "", f"S{rnd.randint(0, 30)}", f"s{rnd.randint(0, 30)}"]), title and f"{title} {rnd.randint(0, 9)}" if rnd.random() < 0.7 else title))

    def same(a, b):
        if a[2] and a[2] == b[2]:
            return True
        if a[3] and b[3]:
            return a[3].lower() == b[3].lower()
        x, y = (a[4] or "").lower(), (b[4] or "").lower()
        return bool(x and y) and (x == y or x.startswith(y + " ") or y.startswith(x + " "))

    want = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and same(a, b) and want[a[1]] != want[b[1]]:
                    want[a[1]] = want[b[1]] = min(want[a[1]], want[b[1]])
                    changed = True
    df = spark.createDataFrame(rows, "run_id long, visit_id long, url string, sku string, title string")
    assert {r.visit_id: r["product"] for r in risk.product_clusters(df, ["run_id"]).collect()} == want


def test_linked_pages_cross_chunks_and_follow_few_links(spark, monkeypatch):
    rnd, rows, want = random.Random(9), [], {}
    for run, n in ((1, 400), (2, 33), (3, 17), (4, 16), (5, 1), (6, 160)):
        page, count, used = 0, 0, 0
        for i in range(n):
            chars = 10 if run == 6 or i > n - 4 else rnd.choice([10, 900, 4000, 20000, 50000])
            rows.append((run, f"t{i}", i * 7, chars))
            if count and (used + chars > 36000 or count >= 15):
                page, count, used = page + 1, 0, 0
            count, used = count + 1, used + chars
            want[run, f"t{i}"] = page
    df = spark.createDataFrame(rows, "run_id long, task_id string, task_ord long, chars long")
    seen = []
    monkeypatch.setattr(J, "follow", lambda links, first, keys: seen.append(links.count()) or scan.follow(links, first, keys))
    for chunk in (1, 16, 40, 1024):  # a chunk is never smaller than a page
        got = {(r.run_id, r.task_id): r.page for r in J._linked_pages(df, 15, 36000, chunk).collect()}
        assert got == want
    assert len(got) == len(rows) and seen[-1] == sum(min(15, n) for n in (400, 33, 17, 16, 1, 160))
