"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles (64-bit hashes); two link when their Jaccard similarity reaches ``percent``. In any
order of all shingles that all documents share, let a document's prefix be its first n - need + l shingles, where need
is the least overlap a partner must have. Two linked documents then share at least min(l1, l2) shingles of their
prefixes. This is used twice, exactly:

1. *Screening.* The order is that of the hashes and l a sixth of the set. Documents whose prefix has too few shingles
   that another set has in its own are linked with nothing. It takes one count of prefix shingles by their hash,
   combined before the shuffle, and one count of unshared ones by document; no list of documents is built.
2. *Joining* those left, with the order of exact document frequencies, rarest first. A shingle of one set only joins
   nothing, so such shingles fill prefixes for free. Each document lengthens its own prefix while that lowers its
   estimated cost: l matches are asked of a candidate, so at most sum(frequencies - 1) / l candidates are verified.

Equal sets are one class from the start. Within a shingle's list all members first meet only the list's leader (the
member with the smallest share of unshared shingles, which in a group of near copies is the text they come from).
Verified links give components, found by repeated joins. Only members of lists that still hold several components
then meet each other, across components: this is the exact rest, and a large group of near copies never forms pairs
among itself once its members share a component. Pairs that cannot reach the threshold by their sizes and the positions of
a shared shingle are never made.

Nothing of the size of the corpus is broadcast; all tables between steps are in the shared folder.

Defined cases: null text is empty; empty sets link with nothing; texts shorter than a shingle are one shingle of all
their words; a null doc_id never names a component unless all of it are null; rows with equal doc_id and text are
alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteready.llm.tasks import map_slices, small_side, stored
from siteready.llm.words import Words, mix, shingles

WIDTH = 5
PERCENT = 75
#: Longest l of the adaptive prefixes, and the cost of verifying a candidate: 1/16 of a set for each list entry.
MOST_MATCHES = 16
VERIFY = 1 / 16


def _need(n, percent: int):
    """The least overlap with any partner."""
    return -(-percent * n // 100)


def _screen(n):
    return np.maximum(1, n // 6)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, v (hash of the text), n, fp (name of the set), prefix (first shingles in hash order)."""

    def make():
        def run(column: pa.Array) -> list:
            words = Words(column)
            sizes, names, prefixes = [], [], []
            for a, b in zip(words.rows[:-1], words.rows[1:]):
                found = np.unique(shingles(words.hashes[a:b], width))
                n = len(found)
                sizes.append(n)
                names.append(mix(np.array([mix(found).sum() + np.uint64(n)], np.uint64)))
                prefixes.append(found[: n - _need(n, percent) + min(int(_screen(n)), n)] if n else found)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32))
            flat = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)
            return [np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *names]).view(np.int64), pa.ListArray.from_arrays(offsets, pa.array(flat))]

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("v"))
    return map_slices(rows, "text", ("doc_id", "v"), "n long, fp long, prefix array<long>", make)


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """fp, n, tokens of each row."""

    def make():
        def run(column: pa.Array) -> list:
            words = Words(column)
            sets = [np.unique(shingles(words.hashes[a:b], width)) for a, b in zip(words.rows[:-1], words.rows[1:])]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))]

        return run

    return map_slices(docs, "text", ("fp", "n"), "tokens array<long>", make)


def _screened(sets: DataFrame, percent: int) -> DataFrame:
    """fp, n, doc_id, v: one row of each class that may have a partner."""
    shared = sets.where("n > 0").select("fp", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"))
    alone = shared.where("fp = other").groupBy("fp").agg(F.count("*").alias("alone"))
    classes = sets.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "v", "n", F.size("prefix").alias("length"))).alias("one"))
    # A partner may be smaller and then asks for fewer matches.
    need = F.ceil(F.col("one.n") * percent / 100)
    least = F.greatest(F.lit(1), F.floor(need / 6))
    kept = classes.join(alone, "fp", "left").where(F.col("one.length") - F.coalesce("alone", F.lit(0)) >= least)
    return kept.select("fp", "one.n", "one.doc_id", "one.v")


def _prefixed(whole: DataFrame, percent: int) -> DataFrame:
    """fp, n, free (unshared shingles), tokens (the others, rarest first), matches (l), length (of the prefix in
    tokens), first (its length for one match); without the classes whose prefix holds no shared shingle."""
    each = whole.select("fp", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = each.join(often, "token").groupBy("fp", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("shared"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    base = lists.select("fp", "n", (F.col("n") - F.size("shared")).cast("int").alias("free"), "shared", need.alias("need")).select("*", (F.col("n") - F.col("need") - F.col("free")).cast("int").alias("slack"))
    # With l matches the prefix takes slack + l shared shingles.
    open_ = base.where("slack + 1 > 0")
    weights = F.transform("shared", lambda s: (s["df"] - 1).cast("double"))
    cost = F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_MATCHES), "need")), lambda m: F.struct(
        (F.aggregate(F.slice("weights", F.lit(1), F.col("slack") + m), F.lit(0.0), lambda a, x: a + x) * (1 + F.col("n") * VERIFY / m)).alias("cost"), m.alias("matches")))
    best = F.array_min(cost)["matches"]
    return open_.withColumn("weights", weights).select("fp", "n", "free", F.transform("shared", lambda s: s["token"]).alias("tokens"), best.alias("matches"), (F.col("slack") + best).alias("length"), (F.col("slack") + 1).alias("first"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether the pair can link if this is the first shingle that both have: what follows it in the shorter rest must
    reach the overlap percent / (100 + percent) * (n1 + n2). A linked pair's first shared shingle always passes."""
    room = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos")) + 1
    return room * (100 + percent) >= (F.col(f"{a}n") + F.col(f"{b}n")) * percent


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: enough matches in the prefixes, then the exact overlap."""
    side = lambda p: candidates.select(F.col("fp").alias(p), F.col("n").alias(f"{p}n"), F.col("tokens").alias(f"{p}t"), F.col("matches").alias(f"{p}m"), F.col("length").alias(f"{p}l"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    matches = F.size(F.array_intersect(F.slice("at", 1, F.col("al")), F.slice("bt", 1, F.col("bl"))))
    overlap = F.size(F.array_intersect("at", "bt"))
    met = both.where(matches >= F.least("am", "bm")).select("a", "b", "an", "bn", overlap.alias("both"))
    return met.where(F.col("both") * 100 >= (F.col("an") + F.col("bn") - F.col("both")) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each linked node's component, by passing labels along links and through labels
    until none changes."""
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "join-edges")
    labels = stored(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "join-labels")
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        passed = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        through = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        moved = stored(passed.join(through, "via").select("node", "old", F.least("via", "next").alias("label")), "join-labels")
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, v (hash of the text), n_shingles, component_id, keeper (the row of its component with the least doc_id)."""
    sets = stored(_sets(docs, width, percent), "join-sets")
    screened = stored(_screened(sets, percent), "join-screened")
    one = screened.select("fp", "n", F.col("doc_id").alias("d"), "v")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("w", F.xxhash64("text"))
    whole = texts.join(small_side(one, screened.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("w") == F.col("v")))
    candidates = stored(_prefixed(stored(_whole_sets(whole.select("fp", "n", "text"), width), "join-whole"), percent), "join-candidates")
    # The first shingle that a linked pair shares lies in both prefixes for one match.
    lists = candidates.select("fp", "n", "free", F.posexplode(F.slice("tokens", F.lit(1), F.col("first"))).alias("at", "token")).withColumn("pos", F.col("free") + F.col("at") + 1)

    leader = lists.groupBy("token").agg(F.min(F.struct((F.col("free") / F.col("n")).alias("share"), "fp", "n", "pos")).alias("l"), F.count("*").alias("members")).where("members > 1")
    stars = lists.join(leader.select("token", F.col("l.fp").alias("a"), F.col("l.n").alias("an"), F.col("l.pos").alias("apos")), "token").select(F.col("fp").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bpos"), "a", "an", "apos")
    first = stored(_verified(stars.where(F.col("a") != F.col("b")).where(_possible("a", "b", percent)).select("a", "b").distinct(), candidates, percent), "join-links")
    labels = components(first)

    labelled = lists.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rest = stored(labelled.join(mixed, "token"), "join-rest")
    side = lambda p: rest.select("token", F.col("fp").alias(p), F.col("n").alias(f"{p}n"), F.col("pos").alias(f"{p}pos"), F.col("label").alias(f"{p}label"))
    across = side("a").join(side("b"), "token").where((F.col("alabel") < F.col("blabel")) & _possible("a", "b", percent)).select("a", "b").distinct()
    second = stored(_verified(across, candidates, percent), "join-links")
    labels = components(first.unionByName(second))

    classes = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "v")).alias("head"))
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("head").alias("head"))
    members = named.select("fp", "label").join(groups, "label").select(F.col("fp").alias("class"), "component_id", "head")
    rows = sets.select("doc_id", "v", F.col("n").alias("n_shingles"), "fp")
    full = rows.where("n_shingles > 0").join(members, F.col("fp") == F.col("class"))
    keeper = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("v") == F.col("head.v"))
    empty = rows.where("n_shingles = 0").select("doc_id", "v", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return full.select("doc_id", "v", "n_shingles", "component_id", keeper.alias("keeper")).unionByName(empty)
