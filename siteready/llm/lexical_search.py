"""Ranked lexical search of many items at once: shared term sets are scored once and combined along a graph.

Every document is a candidate for every item. A term is a run of ASCII letters, digits and characters above 0x7F, with
only A-Z lower-cased. Items ask for overlapping terms, so a plain evaluation adds the same term weights of the same
document over and over. Here the items' common subexpressions are mined first: pairs of nodes (terms, or term sets
found before) that several items hold become one node, the most shared pairs first, until no pair is shared. The
result is a graph in which a node is a term or the sum of two nodes, and each item is one node.

1. ``plan``: items are dealt into blocks of about ``BLOCK_ROWS`` item terms by a hash of their id; each block's graph
   is mined in a Spark task. A block's terms and graph are broadcast: their size is bounded by BLOCK_ROWS (and by the
   longest item), not by the documents.
2. ``postings``: one pass over the texts turns each document into its number of terms and its counts of the block's
   terms; the rows are written to the shared folder. N, L and the document frequencies are sums over that table.
3. ``search``: tasks take some documents at a time, so that graph nodes times documents stay within ``CELLS``, lay
   out one accumulator per term, and fill one accumulator for each further node by adding two finished ones: a shared
   term set is added once, whatever the number of its items. Each task keeps each item's k best and a ranking window
   merges the tasks' rows.

Scores are whole numbers: weight * ((10^9 * tf) div (1000 * tf + 8 * m)) summed over the item's terms, with weight
floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 10 + (90 * n * N) div L. Sums are exact in any order.

Defined cases: null texts and texts without a term are no candidates and count for neither N nor L; rows of one item
id are one item that asks for the terms of all its rows; items without an id take no part; repeated documents are
documents of their own; ties go to the smaller doc_id, null ids last; fewer than k matches give fewer rows; a document
or item text of any length is read whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteready.llm.tasks import map_slices, stored
from siteready.llm.words import run_hashes, text_bytes

#: Item terms whose graph is mined, broadcast and evaluated together.
BLOCK_ROWS = 1 << 18
#: Accumulator cells (graph nodes x documents) a task holds at once.
CELLS = 1 << 21
#: How many of the following nodes of an item a node is paired with when shared pairs are counted. It bounds the work of
#: mining, never the result: a shared pair that is not found is only added twice.
NEIGHBOURS = 24

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LAST = np.iinfo(np.int64).max


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a slice of texts in order, and each row's first term with the end last."""
    data, bounds = text_bytes(column)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _INSIDE[data], [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return run_hashes(_FOLD[data], starts, ends).view(np.int64), np.searchsorted(starts, bounds)


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    """One list per row from values sorted by their owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key (long), term (hash): the distinct terms of every item."""

    def distinct(column: pa.Array) -> list:
        hashes, bounds = term_hashes(column)
        owner = np.repeat(np.arange(len(column)), np.diff(bounds))
        order = np.lexsort((hashes, owner))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(hashes[order]) != 0) | (np.diff(owner[order]) != 0)
        return [_lists(hashes[order][first], owner[order][first], len(column))]

    named = items.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")).where("key is not null and body is not null")
    return map_slices(named, "body", ("key",), "terms array<long>", lambda: distinct).select("key", F.explode("terms").alias("term")).distinct()


def _shared_pairs(item: np.ndarray, node: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes that near entries of one item hold, most used nodes first: left, right, items that hold them."""
    order = np.lexsort((node, -uses[node], item))
    item, node = item[order], node[order]
    width = np.int64(node.max(initial=0) + 1)
    packed = []
    for step in range(1, NEIGHBOURS + 1):
        a, b = node[:-step], node[step:]
        near = (item[:-step] == item[step:]) & (uses[a] > 1) & (uses[b] > 1)
        packed.append(np.minimum(a, b)[near] * width + np.maximum(a, b)[near])
    pairs, count = np.unique(np.concatenate(packed), return_counts=True)
    keep = count > 1
    pairs, count = pairs[keep], count[keep]
    best = np.lexsort((pairs, -count))
    return pairs[best] // width, pairs[best] % width, count[best]


def mine(item: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph of item-term rows: left and right child of each node that is not a term, and each item's node.

    Nodes 0 to the number of terms - 1 are the terms; then come the sums, children first. Items and terms are numbers
    from 0 on; every item has a term.
    """
    order = np.lexsort((term, item))
    item, node = item[order].astype(np.int64), term[order].astype(np.int64)
    left: list[int] = []
    right: list[int] = []
    leaves = int(node.max(initial=-1)) + 1
    fresh = leaves
    while True:
        uses = np.bincount(node, minlength=fresh)
        a, b, _ = _shared_pairs(item, node, uses)
        if not len(a):
            break
        # Entries of a node, to intersect the items of two nodes; taken entries are gone in this round.
        by_node = np.argsort(node, kind="stable")
        first = np.searchsorted(node[by_node], np.arange(fresh + 1))
        taken = np.zeros(len(node), bool)
        made_item, made_node = [], []
        for x, y in zip(a.tolist(), b.tolist()):
            at_x, at_y = by_node[first[x]:first[x + 1]], by_node[first[y]:first[y + 1]]
            at_x, at_y = at_x[~taken[at_x]], at_y[~taken[at_y]]
            both, in_x, in_y = np.intersect1d(item[at_x], item[at_y], assume_unique=True, return_indices=True)
            if len(both) < 2:
                continue
            taken[at_x[in_x]] = taken[at_y[in_y]] = True
            left.append(x)
            right.append(y)
            made_item.append(both)
            made_node.append(np.full(len(both), fresh))
            fresh += 1
        if not made_item:
            break
        item = np.concatenate([item[~taken], *made_item])
        node = np.concatenate([node[~taken], *made_node])
    # What is left of an item belongs to it alone: halves are added until one node remains.
    order = np.lexsort((node, item))
    item, node = item[order], node[order]
    while len(item) and (item[1:] == item[:-1]).any():
        start = np.searchsorted(item, item)
        odd = (np.arange(len(item)) - start) % 2 == 1
        at = np.flatnonzero(odd)
        left += node[at - 1].tolist()
        right += node[at].tolist()
        node = node.copy()
        node[at - 1] = fresh + np.arange(len(at))
        fresh += len(at)
        item, node = item[~odd], node[~odd]
    return np.array(left, np.int64), np.array(right, np.int64), node


def plan(terms: DataFrame) -> DataFrame:
    """One row per block: keys (its items), terms (sorted hashes), left, right (children), roots (each item's node)."""
    rows = terms.count()
    blocks = -(-rows // BLOCK_ROWS) or 1

    def run(block: pa.Table) -> pa.Table:
        keys, item = np.unique(block["key"].to_numpy(), return_inverse=True)
        hashes, term = np.unique(block["term"].to_numpy(), return_inverse=True)
        left, right, roots = mine(item, term)
        out = {"keys": keys, "terms": hashes, "left": left, "right": right, "roots": roots}
        return pa.table({"block": [block["block"][0].as_py()]} | {name: [x] for name, x in out.items()})

    named = terms.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("long"))
    return named.groupBy("block").applyInArrow(run, "block long, keys array<long>, terms array<long>, left array<long>, right array<long>, roots array<long>")


def postings(docs: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (the key), n (terms of the document, with repeats), at (positions in ``terms``), tf (counts there)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        known = shared.value

        def count(column: pa.Array) -> list:
            hashes, bounds = term_hashes(column)
            owner = np.repeat(np.arange(len(column)), np.diff(bounds))
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            hit = known[at] == hashes
            cells, tf = np.unique(owner[hit] * np.int64(len(known)) + at[hit], return_counts=True)
            row = cells // len(known)
            return [np.diff(bounds).astype(np.int64), _lists((cells % len(known)).astype(np.int32), row, len(column)), _lists(tf.astype(np.int64), row, len(column))]

        return count

    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("body"))
    return map_slices(named, "body", ("doc",), "n long, at array<int>, tf array<long>", make)


class Best:
    """The k best documents of each item among those offered so far: score downwards, then key upwards."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: items x documents. Only scores above 0 that reach the item's k-th best are looked at."""
        item, doc = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        item, score, key = np.concatenate((self.item, item)), np.concatenate((self.score, scores[item, doc])), np.concatenate((self.key, keys[doc]))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[item[full]] = score[full]
        self.item, self.score, self.key = item[keep], score[keep], key[keep]


def levels(leaves: int, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The sums of a graph in steps: every step's children are terms or sums of the steps before."""
    depth = np.zeros(leaves + len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        depth[leaves + i] = 1 + max(depth[a], depth[b])
    return [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]


def _block_best(spark: SparkSession, found: DataFrame, block: dict, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Every task's k best documents of the block's items: key, doc, score."""
    shared = spark.sparkContext.broadcast((block["keys"], len(block["terms"]), block["left"], block["right"], block["roots"], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, leaves, left, right, roots, weight = shared.value
        steps, nodes = levels(leaves, left, right), leaves + len(left)
        best, width = Best(len(keys), k), max(1, CELLS // nodes)
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                part = batch.slice(start, width)
                doc = part.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(doc)), np.diff(part.column(2).offsets.to_numpy()))
                at, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                m = 10 + (90 * n * n_docs) // n_terms
                sums = np.zeros((nodes, len(doc)), np.int64)
                sums[at, row] = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                for step in steps:
                    sums[step] = sums[left[step - leaves]] + sums[right[step - leaves]]
                best.offer(sums[roots], doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[best.item]), pa.array(best.key, mask=best.key == _LAST), pa.array(best.score)], names=["key", "doc", "score"])

    return found.select("doc", "n", "at", "tf").mapInArrow(run, "key long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    blocks = stored(plan(item_terms(items)), "lexical-plan")
    out = spark.createDataFrame([], "key long, doc long, score long")
    for name in [r["block"] for r in blocks.select("block").collect()]:
        row = blocks.where(F.col("block") == name).drop("block").toArrow()
        block = {c: row[c].combine_chunks().flatten().to_numpy() for c in row.column_names}
        found = stored(postings(docs, block["terms"]), "lexical-postings")
        total = found.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total["docs"]:
            continue
        weight = F.floor(1000 * F.log((F.lit(2.0) * total["docs"] + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
        held = found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).select("at", weight.alias("w")).toArrow()
        weights = np.zeros(len(block["terms"]), np.int64)
        weights[held["at"].to_numpy()] = held["w"].to_numpy()
        out = out.unionByName(_block_best(spark, found, block, weights, total["docs"], total["terms"], k))
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("key").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
