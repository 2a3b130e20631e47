"""Session helpers: local sessions for tests and benches, and the shared folder for cut lineage and stream state."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "siteready", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
        .getOrCreate()
    )


# The JVM never compiles a method above 8000 bytes of bytecode. A fused stage above it runs interpreted, ten times
# slower than the same operators unfused, so such stages are left unfused.
JIT_LIMIT = "8000"


def tune(spark: SparkSession) -> None:
    """Session settings the wide scoring projections need; safe to set on a running session."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local master without that setting falls back to a
    temporary folder, because a machine-local folder is lost with its machine.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
