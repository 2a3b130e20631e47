"""Exact quantiles of groups of any size, without holding a group in one task.

First pass: weight per (keys, value bucket); a bucket is a 1/128 octave of the value's magnitude, so buckets are few
and the partial aggregation does the work. The bucket that holds the wanted rank is found over those counts. Second
pass: only rows of that bucket are read again and put in order. Buckets with one distinct value need no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESOLUTION = 128


def value_bucket(x: Column) -> Column:
    """A monotone bucket number of a double."""
    size = (F.floor(F.log2(F.abs(x)) * RESOLUTION) + F.lit(1 << 20)).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.signum(x).cast("long") * size)


def _spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, bucket): weight before it, its weight, the group's total, its smallest and largest value."""
    counts = df.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_bw"), F.min("_x").alias("_lo"),
                                              F.max("_x").alias("_hi"))
    return span_columns(counts, keys)


def span_columns(counts: DataFrame, keys: list[str]) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return (counts.withColumn("_upto", F.sum("_bw").over(run)).withColumn("_total", F.sum("_bw").over(whole))
            .withColumn("_before", F.col("_upto") - F.col("_bw")))


def _rank_value(df: DataFrame, keys: list[str], spans: DataFrame) -> DataFrame:
    """keys, _s, _v: the value at each wanted 1-based weighted rank _r: the first whose running weight reaches it."""
    target = spans.where((F.col("_before") < F.col("_r")) & (F.col("_r") <= F.col("_upto")))
    done = target.where(F.col("_lo") == F.col("_hi")).select(*keys, "_s", F.col("_lo").alias("_v"))
    wide = target.where(F.col("_lo") != F.col("_hi")).select(*keys, "_s", "_bucket", "_r", "_before")
    inside = (df.join(wide, [*keys, "_bucket"])
              .groupBy(*keys, "_s", "_x").agg(F.sum("_w").alias("_vw"), F.first("_r").alias("_r"),
                                              F.first("_before").alias("_before")))
    run = Window.partitionBy(*keys, "_s").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = (inside.withColumn("_cum", F.col("_before") + F.sum("_vw").over(run))
             .where((F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_vw") < F.col("_r")))
             .select(*keys, "_s", F.col("_x").alias("_v")))
    return done.unionByName(found)


def weighted_median(df: DataFrame, keys: list[str], value: Column, weight: Column | int = 1,
                    name: str = "median") -> DataFrame:
    """keys, median: the half-weight crossing; exactly at half it is the mean of the two neighbours.

    Weights are positive integers. With weight 1 it is the ordinary median.
    """
    w = F.lit(weight) if isinstance(weight, int) else weight
    rows = df.select(*keys, value.cast("double").alias("_x"), w.cast("long").alias("_w")).where("_x is not null")
    rows = rows.withColumn("_bucket", value_bucket(F.col("_x")))
    spans = _spans(rows, keys)
    low = F.floor((F.col("_total") + 1) / 2)
    high = F.floor(F.col("_total") / 2) + 1
    sides = F.array(F.struct(F.lit("low").alias("s"), low.alias("r")), F.struct(F.lit("high").alias("s"), high.alias("r")))
    both = (spans.withColumn("_side", F.explode(sides)).withColumn("_s", F.col("_side.s"))
            .withColumn("_r", F.col("_side.r")).drop("_side"))
    return _rank_value(rows, keys, both).groupBy(*keys).agg(F.avg("_v").alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """keys and one column per quantile: nearest rank, never interpolated."""
    rows = df.select(*keys, value.cast("double").alias("_x"), F.lit(1).cast("long").alias("_w")).where("_x is not null")
    rows = rows.withColumn("_bucket", value_bucket(F.col("_x")))
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(q).alias("q")) for n, q in quantiles.items()])
    spans = (_spans(rows, keys).withColumn("_p", F.explode(names))
             .withColumn("_s", F.col("_p.n"))
             .withColumn("_r", F.greatest(F.lit(1), F.ceil(F.col("_p.q") * F.col("_total")))).drop("_p"))
    picked = _rank_value(rows, keys, spans)
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_s") == n, F.col("_v"))).alias(n) for n in quantiles])
