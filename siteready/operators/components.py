"""Connected components of a link table of any size.

Alternates two steps until nothing changes: every node points its larger neighbours at the least node it knows, then
its smaller ones. Links only ever move towards the least node of their component, so what is left is a star around it.
Both steps are a minimum per node and a join; each round is written to the shared folder. The number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteready.operators.scan import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b -> the same kind, one star step on."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    met = near.join(least, "a")
    if large:  # neighbours above a node move to the least it knows, the node itself included
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:  # the node and its smaller neighbours move to the least of them
        out = met.select("b", "_m").unionByName(met.select(F.col("a").alias("b"), "_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each linked node's component; nodes without a link are not listed.

    a and b hold nodes of one orderable type (a struct will do). Links may repeat, point either way or to themselves;
    null ends are ignored.
    """
    known = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = stored(known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    sign = None
    while True:
        now = stored(_star(_star(now, True), False), "links")
        found = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (found[0], found[1]) == sign:
            break
        sign = (found[0], found[1])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
