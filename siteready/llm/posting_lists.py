"""Approximate nearest neighbours with balanced posting lists.

Fitting: a documented sample (the ``SAMPLE`` rows with the least id hashes, all if fewer) is split by balanced 2-means
until clusters hold about ``LIST_ROWS`` rows of the whole table, at most ``MAX_LISTS`` clusters; their centroids are
linked into a neighbour graph. Centroids and graph are broadcast: MAX_LISTS x (width + GRAPH_LINKS) numbers at most.

Indexing: every vector goes to its nearest centroid's list, and boundary vectors to further lists whose centroid is
within (1 + REPLICATE) times the nearest distance, unless a list already chosen has almost the same centroid (nearer
than SPREAD times the vector's distance), where a replica would add nothing. Lists are cut into parts of about ``PART_ROWS`` rows by an id hash, so
neither a dense region nor a hot vector fills one task.

Search: best-first search in the centroid graph finds a query's centroids; lists within (1 + PROBE) times the distance
of the nearest are searched. Distances are computed on the original vectors in double precision; each part keeps the
k best of a query and a ranking window merges them.

Recall follows PROBE: 0.9 and more on vectors without any cluster structure (see README), where most lists must be read.

Defined cases: vectors that are null, zero, or hold null, NaN or infinite components take no part, neither do null
ids; of rows with the same id the least vector stands; of several vector lengths the most frequent (then least) one is
indexed and the others take no part; ties go to the smaller id; with fewer than k candidates all found are returned;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteready.llm.topk import dense, unique_vectors

SAMPLE = 50_000
LIST_ROWS = 400
MAX_LISTS = 4096
GRAPH_LINKS = 24
PART_ROWS = 2048
REPLICATE = 0.01
REPLICAS = 4
SPREAD = 0.25
PROBE = 0.18
BEAM_SHARE = 0.9


@dataclass
class Index:
    centroids: np.ndarray  # lists x width
    links: np.ndarray      # lists x links, padded with the list itself


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two clusters of equal size: rows sorted by how much nearer they are to one of two means, cut in the middle."""
    axis = x[rng.integers(len(x))] - x.mean(0)
    side = np.zeros(len(x), bool)
    for _ in range(6):
        along = x @ axis
        side = np.zeros(len(x), bool)
        side[np.argsort(along, kind="stable")[len(x) // 2:]] = True
        axis = x[side].mean(0) - x[~side].mean(0)
        if not axis.any():
            break
    return side


def fit(sample: np.ndarray, rows: int) -> Index:
    """Centroids of balanced clusters of a sample that stands for so many rows, and their neighbour graph."""
    lists = max(1, min(MAX_LISTS, -(-rows // LIST_ROWS), len(sample)))
    rng, parts = np.random.default_rng(7), [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        largest = parts.pop()
        if len(largest) < 2:
            parts.append(largest)
            break
        side = _halves(sample[largest], rng)
        parts += [largest[side], largest[~side]]
    centroids = np.unique(np.array([sample[p].mean(0) for p in parts]), axis=0)
    near = np.array([np.argsort(((centroids - c) ** 2).sum(1), kind="stable")[: GRAPH_LINKS // 2 + 1] for c in centroids])
    # Links both ways, and a ring over all lists so that every list can be reached.
    links = [set(row.tolist()) for row in near]
    for i, row in enumerate(near):
        links[i].add((i + 1) % len(near))
        for j in row:
            if len(links[j]) < GRAPH_LINKS:
                links[j].add(i)
    width = max(map(len, links))
    table = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(links)])
    return Index(centroids, table)


def walk(index: Index, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest centroids found for each query by best-first search, nearest first, and their distances.

    All queries step together: each opens its nearest unopened centroid, looks at that one's neighbours and keeps the
    best ``beam``; a query is done when all it keeps are open.
    """
    n, lists = len(queries), len(index.centroids)
    beam = min(beam, lists)
    rows = np.arange(n)
    seen, opened = np.zeros((n, lists), bool), np.zeros((n, lists), bool)
    kept = np.zeros((n, 1), np.int64)
    dist = np.sqrt(((queries - index.centroids[0]) ** 2).sum(1))[:, None]
    seen[:, 0] = True
    active = rows
    while len(active):
        shut = np.where(opened[active[:, None], kept[active]], np.inf, dist[active])
        pick = shut.argmin(1)
        go = np.isfinite(shut[np.arange(len(active)), pick])
        active, pick = active[go], pick[go]
        if not len(active):
            break
        node = kept[active, pick]
        opened[active, node] = True
        around = index.links[node]
        new = ~seen[active[:, None], around]
        new &= np.concatenate((np.ones((len(around), 1), bool), around[:, 1:] != around[:, :-1]), 1)
        seen[active[:, None], around] = True
        reach = np.full(around.shape, np.inf)
        r, c = np.nonzero(new)
        reach[r, c] = np.sqrt(((queries[active[r]] - index.centroids[around[r, c]]) ** 2).sum(1))
        both, ids = np.concatenate((dist[active], reach), 1), np.concatenate((kept[active], around), 1)
        order = np.argsort(both, axis=1, kind="stable")[:, :beam]
        if kept.shape[1] < order.shape[1]:
            more = order.shape[1] - kept.shape[1]
            kept = np.concatenate((kept, np.zeros((n, more), np.int64)), 1)
            dist = np.concatenate((dist, np.full((n, more), np.inf)), 1)
        kept[active], dist[active] = np.take_along_axis(ids, order, 1), np.take_along_axis(both, order, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(kept, order, 1), np.take_along_axis(dist, order, 1)


def _chosen(index: Index, vectors: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector: the nearest, and boundary replicas that are not near each other."""
    near, dist = walk(index, vectors, 16)
    out = []
    for ids, d in zip(near, dist):
        chosen = [ids[0]]
        for i, x in zip(ids[1:], d[1:]):
            if x > (1 + REPLICATE) * d[0] or len(chosen) == REPLICAS:
                break
            if all(((index.centroids[i] - index.centroids[c]) ** 2).sum() > (SPREAD * x) ** 2 for c in chosen):
                chosen.append(i)
        out.append(np.array(chosen))
    return out


def _probed(index: Index, vectors: np.ndarray) -> list[np.ndarray]:
    near, dist = walk(index, vectors, max(8, int(len(index.centroids) * BEAM_SHARE)))
    return [ids[d <= (1 + PROBE) * d[0]] for ids, d in zip(near, dist)]


def _listed(rows: DataFrame, shared, width: int, choose) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = choose(shared.value, dense(part.column(1), width))
                at = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(np.concatenate(found).astype(np.int32))], names=["key", "vec", "list"])

    return rows.select("key", "vec").mapInArrow(run, "key long, vec array<double>, list int")


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest found for ids divisible by ``every``."""
    rows = unique_vectors(table, key, vector).where(F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    if sizes is None:
        return rows.select(F.col("key").alias("query_id"), F.lit(1).alias("rank"), F.col("key").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    width = sizes["width"]
    rows = rows.where(F.size("vec") == width)
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    index = fit(dense(sample["vec"], width), sizes["count"])
    shared = table.sparkSession.sparkContext.broadcast(index)
    lists = _listed(rows, shared, width, _chosen)
    # A list's parts are known from its count; queries go to each part of a list.
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).collect()
    cut = np.ones(len(index.centroids), np.int64)
    for r in parts:
        cut[r["list"]] = r["parts"]
    of = F.element_at(F.lit(cut.tolist()), F.col("list") + 1)
    left = lists.withColumn("part", F.pmod(F.xxhash64("key"), of).cast("int"))
    right = _listed(rows.where(F.col("key") % every == 0), shared, width, _probed).withColumn("part", F.explode(F.sequence(F.lit(0), (of - 1).cast("int"))))

    def nearest(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        candidates = candidates.sort_by("key")
        ids, vectors = candidates["key"].to_numpy(), dense(candidates["vec"], width)
        found = []
        if len(ids):
            for query, vec in zip(queries["key"].to_numpy(), dense(queries["vec"], width)):
                d = np.sqrt(((vectors - vec) ** 2).sum(1))
                d[ids == query] = np.inf
                edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                at = np.flatnonzero((d <= edge) & (ids != query))
                at = at[np.lexsort((ids[at], d[at]))[:k]]
                found.append((np.full(len(at), query), ids[at], d[at]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(nearest, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
