"""Sinks: fact tables whose runs are replaced, report documents, task exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteready.dims import constants as K


def write_facts(df: DataFrame, path: str, write_id: int, partition: str = "run_date") -> None:
    """Adds the runs' rows under a write number; read_facts then gives these instead of the runs' earlier rows.

    Nothing that is there is rewritten or deleted: other runs of the same date stay, and a write that fails leaves all
    as it was. Write numbers must grow.
    """
    rows = df.withColumn("write_id", F.lit(write_id).cast("long")).hint("rebalance", partition)
    rows.write.mode("append").partitionBy(partition).parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Each run's rows of its newest write."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("run_id").agg(F.max("write_id").alias("write_id"))
    return rows.join(newest, ["run_id", "write_id"], "left_semi")


def report_pages(pages: DataFrame) -> DataFrame:
    """Report page rows; kb is null when no request was recorded."""
    measured = F.col("bytes_transfer").isNotNull() & (F.coalesce("requests", F.lit(1)) != 0)
    return pages.select("run_id", "page_id", "profile", "stage", F.coalesce("final_url", "url").alias("url"), "lcp_ms", "cls",
                        F.when(measured, F.rint(F.col("bytes_transfer") / 1000)).alias("kb"))


def not_assessable(gaps: DataFrame, scores: DataFrame) -> DataFrame:
    """Recorded gaps, then applicable KPIs that were not assessed."""
    a = gaps.select("run_id", "stage", "profile", F.lit(None).cast("string").alias("kpi_id"), "reason")
    missing = scores.where(F.col("applicable") & ~F.col("assessed") & (F.col("scope") == "overall"))
    return a.unionByName(missing.select("run_id", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("profile"), "kpi_id", "reason"))


def score_band(score):
    return F.when(score.isNull(), "none").when(score >= 80, "good").when(score >= 50, "mid").otherwise("bad")


def kpi_tag(applicable, assessed, weight, owner, source):
    """The evidence tag of a KPI row."""
    return (F.when(~applicable, "skipped").when(~assessed, "missing").when((F.coalesce(weight, F.lit(0.0)) == 0) & (owner != K.RISK_INDEX), "info")
            .when(source == "judged", "inferred").otherwise("observed"))


# Fixed labels of reason codes, and prefixes whose remainder is labelled or kept.
REASONS = {"no_observation": "no observation", "not_assessable": "not assessable", "not_assessed": "not assessed", "not_applicable": "not applicable", "invalid_value": "value not readable",
           "unavailable": "data not available", "bot_challenge": "bot challenge page", "not_found": "page not found", "not_reached": "stage not reached", "timeout": "timed out",
           "no_data": "no data", "judgment_pending": "judgment pending", "judgment_uncertain": "judges disagree", "judgment_unclear": "unclear", "no_snippets": "no relevant text"}
PREFIXES = {"not_applicable:": "not applicable", "no_measurement:": "not measured", "upper_bound:": "upper bound", "probe:": "search test failed", "revisit_": "revisit failed", "failed:": "action failed", "error:": "unexpected error"}
VALUES = {"credit_withheld:": "credit withheld: risk signal", "forbidden_label:": "forbidden control"}


def label_reasons(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Adds reason_label: the code's label, else the longest prefix's label with the remainder labelled once or kept.

    Both dictionaries are small fixed tables and ride along as literal maps, so there is no join.
    """
    codes = F.create_map(*[F.lit(v) for p in REASONS.items() for v in p])
    c = F.col(reason)
    out = codes[c]
    for prefix, label in VALUES.items():
        out = F.coalesce(out, F.when(F.startswith(c, F.lit(prefix)), F.concat(F.lit(label + " "), F.substr(c, F.lit(len(prefix) + 1)))))
    for prefix, label in sorted(PREFIXES.items(), key=lambda p: -len(p[0])):
        rest = F.trim(F.substr(c, F.lit(len(prefix) + 1)))
        known = F.coalesce(codes[rest], F.when(~rest.rlike("^[a-z][a-z0-9_]*(:[a-z0-9_]+)*$"), rest))
        out = F.coalesce(out, F.when(F.startswith(c, F.lit(prefix)), F.when(rest == "", F.lit(label)).otherwise(F.concat(F.lit(label + ": "), known))))
    return rows.withColumn("reason_label", out)


def caveats(scores: DataFrame, observations: DataFrame) -> DataFrame:
    """(run, KPI) read from absence on pages that hold iframes or closed shadow roots."""
    absent = scores.where(F.col("assessed") & (F.col("reason") == "no_snippets")).select("run_id", "kpi_id").distinct()
    hidden = (F.coalesce("iframes", F.lit(0)) > 0) | (F.coalesce("shadow_roots", F.lit(0)) > 0)
    seen = observations.where((F.col("reason") == "no_snippets") & hidden).select("run_id", "kpi_id").distinct()
    return absent.join(seen, ["run_id", "kpi_id"], "left_semi")


def report_documents(headlines: DataFrame, sub: DataFrame, signals: DataFrame, pages: DataFrame, gaps: DataFrame) -> DataFrame:
    """One report document per run: headline, sub-indices, top risk signals, pages, gaps; lists are sorted structs.

    Page and gap lists are the run's own pages; everything else is bounded by the KPI registry.
    """
    over = lambda df: df.where("scope = 'overall'")
    s = over(sub).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("owner", "score", "coverage", "grade"))).alias("sub_indices"))
    r = over(signals).where("rank <= 10").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "kpi_id", "risk"))).alias("risk_signals"))
    p = report_pages(pages).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "stage", "profile", "lcp_ms", "cls", "kb"))).alias("pages"))
    n = gaps.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage", "profile", "kpi_id", "reason"))).alias("not_assessable"))
    head = over(headlines).select("run_id", F.struct("score", "published", "grade", "coverage", "judged_share", "reason", "limiting_factor", "risk_score").alias("headline"))
    out = head.join(s, "run_id", "left").join(r, "run_id", "left").join(p, "run_id", "left").join(n, "run_id", "left")
    method = F.struct(F.lit(K.RISK_PENALTY).alias("risk_penalty"), F.lit(K.SCORE_FLOOR).alias("floor"), F.lit(K.MIN_COVERAGE).alias("min_coverage"))
    versions = F.struct(F.lit(K.SCHEMA_VERSION).alias("schema"), F.lit(K.ANCHORS_VERSION).alias("anchors"), F.lit(K.RUBRICS_VERSION).alias("rubrics"))
    return out.withColumn("method", method).withColumn("versions", versions)


def write_reports(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def export_tasks(tasks: DataFrame, path: str) -> None:
    """Open tasks for an outside judge, as JSON lines."""
    tasks.write.mode("overwrite").json(path)


def import_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict rows an outside judge wrote, as JSON lines."""
    return spark.read.schema("run_id long, task_id long, judge_id string, model string, label string, confidence double, arrival long").json(path)
