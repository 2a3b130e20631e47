"""Tables whose rows are replaced run by run, with reads that do not grow with the number of rewrites.

Each write is a folder of its own: the runs it replaces and their new rows, both by shard (a hash of the run). A small
table beside it says which writes of each shard still count. A run's rows are those of the newest write that names the
run, so a run that is named without rows has none from then on, and nothing that is there is changed: a write that
fails or is repeated leaves all others as they were. A shard that has reached ``most`` writes is written as a whole by
the next write that touches it; older folders of it are then no longer read.

Writes are numbered 0, 1, 2, ... (a stream's batch ids fit), one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RunTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "run_id", shards: int = 64, most: int = 8):
        self.spark, self.path, self.schema, self.key, self.shards, self.most = spark, path, schema, key, shards, most

    def _in_shards(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64(self.key), F.lit(self.shards)).cast("int"))

    def live(self, write_id: int) -> dict[int, list[int]]:
        """Which writes count for each shard after a write: at most shards x most numbers."""
        if write_id < 0:
            return {}
        out: dict[int, list[int]] = {}
        for r in self.spark.read.schema("s int, w long").parquet(f"{self.path}/live/write={write_id}").collect():
            out.setdefault(r["s"], []).append(r["w"])
        return out

    def _load(self, kind: str, live: dict[int, list[int]]) -> DataFrame:
        """Stored keys or rows of some shards and writes, with their write number."""
        fields = self.schema.fields if kind == "rows" else [self.schema[self.key]]
        writes = sorted({w for found in live.values() for w in found})
        schema = T.StructType([*fields, T.StructField("write", T.LongType()), T.StructField("shard", T.IntegerType())])
        if not writes:
            return self.spark.createDataFrame([], schema)
        wanted = F.lit(False)
        for w in writes:
            wanted = wanted | ((F.col("write") == w) & F.col("shard").isin([s for s, found in live.items() if w in found]))
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        return read.parquet(*[f"{self.path}/{kind}/write={w}" for w in writes]).where(wanted)

    def _newest(self, live: dict[int, list[int]], runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(keys, rows) of the newest write of every run, or of the given runs, in these shards."""
        named = self._load("keys", live)
        if runs is not None:
            named = named.join(runs.select(self.key).distinct(), self.key, "left_semi")
        keys = named.groupBy(self.key).agg(F.max("write").alias("write"))
        rows = self._load("rows", live).join(keys, [self.key, "write"], "left_semi")
        return keys.select(self.key), rows.select(*self.schema.names)

    def touched(self, runs: DataFrame) -> list[int]:
        return [r["shard"] for r in self._in_shards(runs.select(self.key)).select("shard").distinct().collect()]

    def rows_of(self, runs: DataFrame, write_id: int) -> DataFrame:
        """The rows of some runs after a write; only their shards are read."""
        live = self.live(write_id)
        return self._newest({s: live[s] for s in self.touched(runs) if s in live}, runs)[1]

    def read(self, write_id: int) -> DataFrame:
        """All rows after a write."""
        return self._newest(self.live(write_id))[1]

    def written(self, write_id: int, runs: DataFrame) -> DataFrame:
        """The rows that a write gave these runs."""
        rows = self._load("rows", {s: [write_id] for s in range(self.shards)})
        return rows.join(runs.select(self.key).distinct(), self.key, "left_semi").select(*self.schema.names)

    def replace(self, rows: DataFrame, write_id: int, runs: DataFrame | None = None) -> None:
        """Gives runs new rows. runs: those replaced, also if they have no rows now (as a rule: the runs of the rows)."""
        before = self.live(write_id - 1)
        named = (rows if runs is None else runs).select(self.key).distinct()

        def put(df: DataFrame, kind: str, mode: str) -> None:
            self._in_shards(df).hint("rebalance", "shard").write.mode(mode).partitionBy("shard").parquet(f"{self.path}/{kind}/write={write_id}")

        put(named, "keys", "overwrite")
        mine = self._load("keys", {s: [write_id] for s in range(self.shards)})
        touched = [r["shard"] for r in mine.select("shard").distinct().collect()]
        full = {s: before[s] for s in touched if len(before.get(s, [])) >= self.most}
        rows = rows.select(*self.schema.names)
        if full:
            old_keys, old_rows = self._newest(full)
            given = mine.select(self.key)
            rows = rows.unionByName(old_rows.join(given, self.key, "left_anti"))
            # Runs without rows are not carried on: nothing older is left that they would have to hide.
            kept = old_rows.select(self.key).distinct().join(given, self.key, "left_anti")
            put(kept, "keys", "append")
        put(rows, "rows", "overwrite")
        live = {**before, **{s: [*([] if s in full else before.get(s, [])), write_id] for s in touched}}
        pairs = [(s, w) for s, found in sorted(live.items()) for w in found]
        self.spark.createDataFrame(pairs, "s int, w long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/write={write_id}")
