"""Ordered scans over logs that may be arbitrarily long.

A plain window over a run puts the whole run into one task. These helpers cut each run into chunks of its order
column, keep a short tail per chunk, and carry the tails forward, so rows are spread by (run, chunk) and only the
chunk tails meet per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteready.session import shared_dir

CHUNK = 250_000


def chunk_of(order: Column, size: int = CHUNK) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def with_previous(df: DataFrame, keys: list[str], order: str, cols: list[str], n: int = 1, chunk: int = CHUNK,
                  prefix: str = "prev") -> DataFrame:
    """Adds struct columns prev1..prevN: the given columns of the 1st..Nth earlier row of the same keys.

    Each non-empty chunk keeps its last N rows; at most N chunks back hold the N rows before a chunk.
    """
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(F.col(order), chunk)).withColumn("_row", F.struct(*cols))
    newest = Window.partitionBy(*part).orderBy(F.col(order).desc())
    tails = (rows.select(*part, order, "_row").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
             .groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(order, "_row"))).alias("_tail")))
    back = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-n, -1)
    carried = tails.select(*part, F.flatten(F.collect_list("_tail").over(back)).alias("_carry"))
    joined = rows.join(carried, part, "left")
    here = Window.partitionBy(*part).orderBy(order)
    joined = joined.withColumn("_n", F.row_number().over(here))
    for k in range(1, n + 1):
        joined = joined.withColumn(f"_lag{k}", F.lag("_row", k).over(here))
    for k in range(1, n + 1):
        position = F.size("_carry") - (F.lit(k) - F.col("_n"))
        from_carry = F.when(position >= 1, F.get("_carry", position - 1)["_row"])
        joined = joined.withColumn(f"{prefix}{k}", F.when(F.col("_n") > k, F.col(f"_lag{k}")).otherwise(from_carry))
    return joined.drop("_chunk", "_row", "_n", "_carry", *[f"_lag{k}" for k in range(1, n + 1)])


def with_running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Adds running totals (this row included) of the given expressions in order within keys."""
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(F.col(order), chunk))
    for name, expr in sums.items():
        rows = rows.withColumn(f"_v_{name}", F.coalesce(expr, F.lit(0)))
    totals = rows.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*part, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}")
                                     for n in sums])
    here = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, part, "left")
    for n in sums:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(here) + F.col(f"_c_{n}"))
    return out.drop("_chunk", *[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def with_last(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], chunk: int = CHUNK,
              inclusive: bool = True) -> DataFrame:
    """Adds, per value, its last non-null one up to this row (or before it) in order within keys: an as-of carry."""
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(F.col(order), chunk))
    for name, expr in values.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    lasts = rows.groupBy(*part).agg(*[
        F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}")
        for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*part, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}")
                                    for n in values])
    end = 0 if inclusive else -1
    here = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    out = rows.join(carried, part, "left")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here), F.col(f"_c_{n}")))
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder of the shared checkpoint folder and read again, so that later steps start there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def follow(links: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """The positions that are reached from the first ones by following links, these included: (keys, pos).

    A greedy cut ("start anew when the bound is passed") depends on where the last piece began, which looks sequential;
    but where a piece that begins at a row would end is known for every row. Jumps of 2, 4, 8, ... pieces are made by
    joining the links with themselves; taking the longest jumps first, every reached position doubles the reached ones.
    That is two joins for each doubling of the number of pieces, all spread by (keys, pos), whatever the longest key.

    links: keys, pos, nxt (null: the last piece). first: keys, pos.
    """
    here, there = [*keys, "pos"], [F.col(k).alias(f"_{k}") for k in keys]
    jump = stored(links.where("nxt is not null").select(*here, "nxt"), "links")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        ahead = jump.select(*there, F.col("pos").alias("_pos"), F.col("nxt").alias("_nxt"))
        on = F.col("nxt") == F.col("_pos")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        jump = stored(jump.join(ahead, on).select(*here, F.col("_nxt").alias("nxt")), "links")
    reached = first.select(*here)
    for jump in reversed(jumps):
        ahead = jump.select(*there, F.col("pos").alias("_pos"), "nxt")
        on = F.col("pos") == F.col("_pos")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        reached = stored(reached.unionByName(reached.join(ahead, on).select(*keys, F.col("nxt").alias("pos"))), "reached")
    return reached
