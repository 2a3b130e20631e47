"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
150 % of all words by weight; a target stops at twice its source's size and the excess is shared again by weight. Each
document of a source asks for target / source_size copies; the whole part is given to all, and the fractional parts
are rounded by pairs: of two documents with fractional probabilities, mass measured in words moves from one to the
other at random, so that one becomes 0 or 1 while their sum of words and each expectation stay. One document of a
group stays fractional; these residuals are combined by a reduction tree whose groups hold about ``fan_in`` documents,
and the one left of each source is rounded to the nearer of its bounds. A source's words thus differ from its target
by at most half of one document.

Groups come from hashes of row contents and random numbers from hashes of rows and levels: nothing depends on how rows
are partitioned, and a hot source is spread over as many groups as its documents fill.

Defined cases: null or empty text has size 0 and takes the whole copies only; equal rows are separate documents; a
null doc_id or source is a value like another; without words all targets are 0; an empty table gives no rows; extra
columns are ignored unless asked for with ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteready.llm.tasks import stored
from siteready.llm.words import WORD, mix

WEIGHTS = (3, 1, 2)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target of sized documents (source, size).

    Sources are filled in the order of size / weight: with the smaller ones at their bound, a source stands at its own
    bound exactly if the level of those that remain would exceed it. One row for each source meets in one window;
    documents never do.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    exact = "decimal(38,0)"
    size, weight = F.col("source_size").cast(exact), F.col("weight").cast(exact)
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    over, under = share
    sums = weighed.select(
        "source", "source_size", "weight", size.alias("s"), weight.alias("w"),
        F.sum(size).over(everything).alias("all_s"), F.sum(weight).over(everything).alias("all_w"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).cast(exact).alias("done_s"), F.coalesce(F.sum(weight).over(before), F.lit(0)).cast(exact).alias("done_w"),
        F.row_number().over(order).alias("rank"))
    # level = (all * over / under - most * done_s) / (all_w - done_w), compared as products of whole numbers
    left = F.expr(f"CAST(all_s * {over} AS {exact}) - CAST(done_s * {most * under} AS {exact})")
    full = (left * F.col("w")).cast(exact) >= (F.col("s") * most * under).cast(exact) * (F.col("all_w") - F.col("done_w")).cast(exact)
    level = (left.cast("double") / under) / (F.col("all_w") - F.col("done_w")).cast("double")
    ranked = sums.withColumn("full", full).withColumn("level", level)
    first = F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(everything)
    bound = F.col("source_size") * F.lit(float(most))
    return ranked.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), bound).otherwise(F.least(bound, F.col("first.level") * F.col("weight"))).alias("target"))


def _settle(keys: np.ndarray, sizes: np.ndarray, share: np.ndarray, salt: int) -> tuple[np.ndarray, int]:
    """Pairs up documents in order; gives the shares after it and which one may still be fractional (-1: none).

    Moving d * size words keeps the sum of share * size; the two ways out are taken with the odds that keep each
    share's expectation.
    """
    share, held = share.copy(), -1
    draws = mix(keys ^ np.uint64(salt * 2 + 1)) >> np.uint64(11)
    for j in range(len(share)):
        if not 0.0 < share[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1.0 - share[i]) * sizes[i], share[j] * sizes[j])    # words that may move from j to i
        down = min(share[i] * sizes[i], (1.0 - share[j]) * sizes[j])  # and from i to j
        if draws[j] * 2.0 ** -53 * (up + down) < down:
            first = (1.0 - share[i]) * sizes[i] <= share[j] * sizes[j]
            share[i], share[j] = (1.0, share[j] - up / sizes[j]) if first else (share[i] + up / sizes[i], 0.0)
        else:
            first = share[i] * sizes[i] <= (1.0 - share[j]) * sizes[j]
            share[i], share[j] = (0.0, share[j] + down / sizes[j]) if first else (share[i] - down / sizes[i], 1.0)
        held = j if first else i
        if min(share[held], 1.0 - share[held]) < 1e-12:
            share[held], held = round(share[held]), -1
    return share, held


def _level(df: DataFrame, salt: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["size"].to_numpy(), table["key"].to_numpy()))
        table = table.take(order)
        share, held = _settle(table["key"].to_numpy().view(np.uint64), table["size"].to_numpy().astype(float), table["share"].to_numpy(), salt)
        open_ = np.zeros(len(share), bool)
        open_[held] = held >= 0
        return table.set_column(table.schema.get_field_index("share"), "share", pa.array(share)).set_column(table.schema.get_field_index("open"), "open", pa.array(open_))

    return df.groupBy("source_key", "node").applyInArrow(run, df.schema)


def mix_sources(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, fan_in: int = 2048) -> DataFrame:
    """doc_id, the kept columns, source, size, source_size, target, copies, taken.

    With ``keep``, rows are matched again with their texts by doc_id and a hash of source and text.
    """
    row = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"), row.alias("key")), "mix-sizes")
    goals = targets(sized, weights)
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    groups = sized.groupBy("source").agg(F.count("*").alias("members")).select(F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("members") / fan_in)).alias("groups"))
    one = sized.join(goals.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").join(groups, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Sources get a key of their own as groups of one level are never shared between sources.
    asked = one.select("doc_id", "source", "size", "key", "source_size", "target", F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("share"),
                       F.coalesce(F.xxhash64("source", F.col("source").isNull()), F.lit(0)).alias("source_key"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("groups")).alias("node"), F.lit(False).alias("open"), "groups")
    moving = (F.col("size") > 0) & (F.col("share") > 0)
    most = asked.agg(F.max("groups")).first()[0] or 1
    state = stored(_level(asked.where(moving).drop("groups"), 0), "mix-level")
    settled, level = [state.where(~F.col("open"))], 1
    rest = state.where("open")
    while most > 1:
        most = -(-most // fan_in)
        state = stored(_level(rest.withColumn("node", F.floor(F.col("node") / fan_in).cast(rest.schema["node"].dataType)), level), "mix-level")
        settled.append(state.where(~F.col("open")))
        rest, level = state.where("open"), level + 1
    settled.append(rest.withColumn("share", F.when(F.col("share") < 0.5, 0.0).otherwise(1.0)))
    out = asked.where(~moving).drop("groups").withColumn("share", F.lit(0.0))
    for part in settled:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.round("share").cast("long")).alias("copies")
    done = out.select("doc_id", "source", "key", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
    if not keep:
        return done.drop("key")
    # Equal rows are told apart by a number, so that each keeps its own copies.
    number = F.row_number().over(Window.partitionBy("key").orderBy("copies"))
    again = docs.select(*[c for c in docs.columns if c in keep], row.alias("key"))
    extra = [c for c in keep if c not in done.columns]
    return done.withColumn("n", number).join(again.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).select("key", "n", *extra), ["key", "n"]).drop("key", "n")
