"""Recorded formats and sinks on small files: indented and broken documents, torn lines, replaced runs, spellings."""

from pyspark.sql import functions as F

from siteready.functions import urls
from siteready.operators import risk
from siteready.sources import records, sinks


def test_read_runs_takes_indented_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "run_id": "r1",\n  "status": "complete"\n}\n')
    (tmp_path / "b.json").write_text('{\n  "run_id": "r2",\n  "sta')
    rows = records.read_runs(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and {r.run_id for r in rows if r._corrupt is None} == {"r1"}


def test_rewriting_one_run_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = spark.createDataFrame([(1, "d", 1), (1, "d", 2), (2, "d", 3)], "run_id long, run_date string, x int")
    sinks.write_facts(df, path, 1)
    sinks.write_facts(df.where("x = 1").withColumn("x", F.lit(9)), path, 2)
    assert sorted((r.run_id, r.x) for r in sinks.read_facts(spark, path).collect()) == [(1, 9), (2, 3)]


def test_page_key_decodes_and_sorts_pairs(spark):
    rows = [("http://h/p?a-b=1&a=2",), ("http://h/p?a=2&a-b=1",), ("http://h/p?q=x%20y",), ("http://h/p?q=x+y",), ("http://h/p?q=%zz",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(urls.page_key(F.col("u"))).collect()]
    assert got[0] == got[1] == "http://h/p?a=2&a-b=1" and got[2] == got[3] and got[4] is not None


def test_two_added_titles_count_a_line_once(spark):
    lines = spark.createDataFrame([(1, 1, "Red Shoe Classic", 10.0, False), (1, 2, "Blue Hat Winter", 5.0, False)], "run_id long, line_id long, title string, price_value double, addon boolean")
    added = spark.createDataFrame([(1, "Red Shoe Classic"), (1, "Blue Hat Winter")], "run_id long, title string")
    row = risk.sneak_into_basket(lines, added).first()
    assert (row.confidence, row.unrequested) == (0.0, 0)


def test_one_log_is_read_by_many_tasks_with_exact_line_numbers(spark, tmp_path):
    lines = [f'{{"run_id": "r", "step": {i}, "operation": "CLICK"}}' if i % 5 else ("" if i % 2 else '{"torn": ') for i in range(4000)]
    (tmp_path / "long.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "short.jsonl").write_text("\n".join(lines[:7]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        steps = records.read_steps(spark, str(tmp_path))
        assert steps.rdd.getNumPartitions() > 8
        got = sorted((r._file.split("/")[-1], r.line_no, r.step) for r in steps.select("_file", "line_no", "step").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == sorted((name, i, i) for name, n in (("long.jsonl", 4000), ("short.jsonl", 7)) for i in range(n) if i % 5)
