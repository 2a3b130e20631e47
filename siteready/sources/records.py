"""Sources: run documents, step logs, browser event logs, raw pages, the run catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready import schema as S
from siteready.functions.urls import host_slug


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Run documents, one (indented) JSON document per file, or one per line; an unreadable one stays as a row with
    _corrupt set."""
    return spark.read.schema(S.ddl(S.RUN + ", _corrupt string")).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def normalise(runs: DataFrame) -> dict[str, DataFrame]:
    """Child tables of run documents; every list keeps its position in ``ord``."""
    pages = runs.select("run_id", F.posexplode("pages").alias("page_ord", "p")).select("run_id", "page_ord", "p.*")

    def page_list(name: str) -> DataFrame:
        return pages.select("run_id", "page_id", F.posexplode(f"audit.{name}").alias("ord", "x")).select("run_id", "page_id", "ord", "x.*")

    def run_list(path: str) -> DataFrame:
        return runs.select("run_id", F.posexplode(path).alias("ord", "x")).select("run_id", "ord", "x.*")

    obs = run_list("observations")
    number = F.col("value").try_cast("double")
    kind = F.when(F.col("value").isNull(), None).when(F.col("value").isin("true", "false"), "bool").when(number.isNotNull(), "number").otherwise("enum")
    obs = obs.withColumn("value_type", kind).withColumn("value_num", F.when(kind == "number", number)).withColumn(
        "value_bool", F.when(kind == "bool", F.col("value") == "true")).withColumn("value_str", F.when(kind == "enum", F.col("value"))).drop("value")
    return {"pages": pages.drop("audit"), "prices": page_list("prices"), "snippets": page_list("snippets"), "overlays": page_list("overlays"), "observations": obs,
            "gaps": run_list("not_assessable"), "tasks": run_list("judgments.tasks"), "verdicts": run_list("judgments.verdicts"), "finals": run_list("judgments.final")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their exact positions: _file, line_no (from 0), line.

    Files are split as Spark sees fit. Within a split lines are numbered as they are read; the lines of the splits before
    it, a count per split, are added. So one huge log is read by many tasks and keeps its order.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = raw.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = splits.select("_file", "_block", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"))
    return raw.join(offset, ["_file", "_block"]).select("_file", (F.col("_at") + F.col("_offset")).alias("line_no"), F.col("value").alias("line"))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Step logs (JSON lines, one file per run); torn lines and lines that are no object are skipped.

    line_no is the exact file position, also in a log that many tasks read. Absent keys stay distinguishable from nulls.
    """
    lines = read_lines(spark, path).where(F.trim("line") != "")
    doc = lines.withColumn("_v", F.try_parse_json("line")).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    doc = doc.withColumn("s", F.from_json("line", S.ddl(S.STEP)))
    keys = F.json_object_keys("line")
    since, flags = F.json_object_keys(F.get_json_object("line", "$.since")), F.json_object_keys(F.get_json_object("line", "$.flags"))
    inside = lambda arr, k: F.coalesce(F.array_contains(arr, k), F.lit(False))
    flat = [F.col("s")[c].alias(c) for c in ("run_id", "step", "t_wall", "operation", "label", "node", "role", "source", "url_before", "url_after", "page_changed", "execution_ms", "settle_ms", "settle_reason", "decision_latency_ms")]
    flat += [F.col("s.since")[c].alias(c) for c in ("first_response_ms", "first_request_ms", "mutations", "mutations_total", "navigations", "requests", "shifts_post_input", "event_timing_max_ms")]
    flat += [F.col("s.flags")[c].alias(c) for c in ("stale", "guard_blocked", "new_tab", "new_document", "external_nav", "navigation_error", "state_changed", "follows_timeout")]
    return doc.select("_file", F.col("line_no").cast("long").alias("line_no"), *flat, (F.col("s.since").isNotNull() & F.coalesce(F.col("s.since.available"), F.lit(True))).alias("since_available"),
                      inside(keys, "role").alias("role_recorded"), inside(flags, "new_document").alias("new_document_recorded"), inside(since, "first_request_ms").alias("first_request_recorded")
                      ).withColumn("ord", F.col("line_no"))


def stream_steps(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Step lines as a stream: one new file per flushed batch; torn lines and lines that are no object are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    docs = lines.withColumn("_v", F.try_parse_json("value")).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    return docs.select("_file", F.from_json("value", S.ddl(S.STEP)).alias("s")).select("_file", "s.*")


def read_net_events(spark: SparkSession, path: str) -> DataFrame:
    """Recorded browser events ({method, params}) as the flat rows the event operators read."""
    e = spark.read.schema(S.ddl(S.EVENT)).json(path).withColumn("v", F.try_parse_json("params"))
    get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    short = F.create_map(*[F.lit(x) for p in {"Network.requestWillBeSent": "request", "Network.responseReceived": "response", "Network.dataReceived": "data", "Network.loadingFinished": "finished",
                                              "Network.loadingFailed": "failed", "Runtime.executionContextsCleared": "commit", "Runtime.exceptionThrown": "exception", "Runtime.consoleAPICalled": "console",
                                              "Log.entryAdded": "log"}.items() for x in p])
    return e.select("run_id", "page_id", "idx", F.coalesce(short[F.col("method")], F.col("method")).alias("method"), get("requestId").alias("request_id"), get("loaderId").alias("loader_id"), get("frameId").alias("frame_id"),
                    get("type").alias("type"), F.coalesce(get("response.url"), get("request.url")).alias("url"), get("response.status", "int").alias("status"), get("encodedDataLength", "bigint").alias("encoded_bytes"),
                    get("canceled", "boolean").alias("canceled"), get("redirectResponse.status", "int").alias("redirect_status"), get("redirectResponse.encodedDataLength", "bigint").alias("redirect_bytes"),
                    get("timestamp", "double").alias("ts"), get("request.mixedContentType").alias("mixed_content"), get("initiator.type").alias("initiator"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw pages as page_id, url, html; loose HTML files take their path as id and URL."""
    if fmt == "html":
        raw = spark.read.option("wholetext", True).text(path)
        return raw.select(F.col("_metadata.file_path").alias("page_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    return spark.read.format(fmt).load(path)


def list_runs(runs: DataFrame, host: str | None = None, limit: int = 20) -> DataFrame:
    """Newest runs first. A host without a port also matches its runs on any port; unreadable documents are listed.
    runs: run_id, host, created_at, status, readable."""
    r = runs.withColumn("slug", host_slug(F.col("host")))
    if host is not None:
        slug = host_slug(F.lit(host))
        r = r.where((F.col("slug") == slug) | (F.lit(":" not in host.split("//")[-1]) & F.startswith("slug", F.concat(slug, F.lit("-"))) & F.substr("slug", F.length(slug) + 2).rlike(r"^\d+$")))
    r = r.withColumn("status", F.when(F.col("readable"), F.col("status")).otherwise(F.lit("unreadable")))
    return r.orderBy(F.desc("created_at"), "run_id").limit(limit).drop("readable", "slug")


def newest_per_host(runs: DataFrame, n: int) -> DataFrame:
    """The newest n runs of every host."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("created_at"), "run_id"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= n)
