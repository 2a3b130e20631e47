"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector's components are terms. Candidates are dealt into groups by a hash of their id, and so are the queries, each
group about ``CANDIDATES`` or ``QUERIES`` rows; every pair of groups meets once. There the candidates become postings
(term -> rows with a weight, weights); each query adds its weight times the postings' weights into its dense array of
scores, term after term. Partition selection keeps each query's k best of the group, and a ranking window merges the
groups' rows (Spark keeps k for each query before the shuffle).

Weights are whole numbers, floor(scale * x), and so are the scores: sums are exact in any order. Where a block's weights
could carry a sum past 64 bits it is accumulated in unbounded integers; a score beyond 64 bits is an error, as it has no
value in the result.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, neither do null ids; of
rows with the same id the least vector stands; vectors of different lengths are compared as if padded with zeros; ties
go to the smaller id; with fewer than k candidates all are returned; an empty vector scores 0; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 16_384
QUERIES = 8_192
#: Scores that are held at once: rows of queries times candidates.
_CELLS = 1 << 19


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def unique_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """key (long), vec (doubles): usable vectors, one for each id."""
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(F.col("key").isNotNull() & usable(F.col("vec"))).groupBy("key").agg(F.min("vec").alias("vec"))


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column padded with zeros to a width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _widest(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns), default=0)


def accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Scores of query rows (terms x weights) against all rows of the postings."""
    scores = np.zeros((len(queries), size), queries.dtype)
    for term, (rows, weights) in enumerate(postings):
        used = np.flatnonzero(queries[:, term])
        if not len(used) or not len(rows):
            continue
        added = queries[used, term][:, None] * weights[None, :]
        if len(rows) == size and len(used) == len(queries):
            scores += added
        else:
            scores[np.ix_(used, rows)] += added
    return scores


def whole_weights(candidates: np.ndarray, queries: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as whole numbers: longs where no sum of products can pass 2^62, else Python integers."""
    a, b = np.floor(candidates * scale), np.floor(queries * scale)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0), most) < 2.0 ** 62:
        return a.astype(np.int64), b.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return tuple(whole(x) if x.size else x.astype(object) for x in (a, b))


def as_longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        if any(not -(2 ** 63) <= x < 2 ** 63 for x in scores.flat):
            raise OverflowError("an inner product exceeds 64 bits")
        return scores.astype(np.int64)
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids, in no order; ids ascend."""
    if len(scores) <= k:
        return np.arange(len(scores))
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > floor)
    return np.concatenate((above, np.flatnonzero(scores == floor)[: k - len(above)]))


def top_k(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every query (ids divisible by ``every``)."""
    rows = unique_vectors(table, key, vector)
    size = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("key") % every == 0).alias("asked")).first()
    parts, groups = -(-size["rows"] // CANDIDATES) or 1, -(-size["asked"] // QUERIES) or 1
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = rows.select("*", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")).withColumn("group", each)
    right = rows.where(F.col("key") % every == 0).select("*", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(groups)).cast("int").alias("group")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        width = _widest(candidates["vec"], queries["vec"])
        candidates = candidates.sort_by("key")
        ids, asked = candidates["key"].to_numpy(), queries["key"].to_numpy()
        weights, wanted = whole_weights(dense(candidates["vec"], width), dense(queries["vec"], width), scale)
        postings = [(at := np.flatnonzero(weights[:, t]), weights[at, t]) for t in range(width)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, _CELLS // max(1, len(ids)))
        for start in range(0, len(asked), step):
            for query, line in zip(asked[start:start + step], as_longs(accumulate(wanted[start:start + step], postings, len(ids)))):
                at = select(line, ids, k + 1)
                at = at[ids[at] != query]
                at = at[np.lexsort((ids[at], -line[at]))[:k]]
                found.append((np.full(len(at), query), ids[at], line[at]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
