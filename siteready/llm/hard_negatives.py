"""Hard-negative mining: exact bands of inner products, filtered by rotated one-bit codes.

Anchors are the rows whose id is divisible by ``every``; an anchor's positives are the ``positives`` other rows of its
label with the highest inner products. For each of them the ``negatives`` best rows of other labels are wanted whose
product lies between ``least`` percent of the positive's and the positive's own.

Codes. A vector is turned by a fixed random rotation (sign flips and Walsh-Hadamard transforms, on a width padded to a
power of two), and its signs are a code: a unit vector b with an alignment a = <v, b>. What the code does not explain,
v - a b, gets a code in turn; ``LAYERS`` codes, their alignments and the length of the last remainder are stored with
each vector, once.

Intervals. A rotated anchor is cut into ``PLANES`` bit planes, so that <b, anchor> is a sum of popcounts of code and
plane. The estimate of <v, anchor> is the sum of alignment times <b, anchor>; by Cauchy-Schwarz it is off by no more
than |remainder| |anchor| + |explained part| |anchor's rounding|. That bound always holds, so a candidate is dropped
only if its interval cannot reach the band or the k-th best of the block's intervals. Layer by layer the intervals
shrink and fewer candidates are left; the whole-number products of the survivors decide. Results are exact whatever
the codes are worth; ``examined`` tells how many products were formed.

Candidates are dealt into blocks of about ``CELLS`` components and anchors into groups of ``ANCHORS`` by hashes of their
ids; each block meets each group once, for the positives and, with these known, for the negatives. Blocks send k rows for an
anchor (or an anchor and positive), and ranking windows merge them. Labels are compared inside a block and never used
to deal rows, so a label with a third of all rows changes nothing.

Weights are floor(scale * x). Products are formed in double precision where that is exact, else in 64-bit integers,
else in unbounded ones; a product beyond 64 bits is an error.

Defined cases: rows take no part if id, label or vector is null or a component is null, NaN or infinite; of rows with
the same id the one with the least (vector, label) stands; vectors of different lengths are compared as if padded with
zeros; ties go to the smaller id; an anchor without another row of its label gives no rows, neither does a positive
with an empty band (always so below 0); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteready.llm.tasks import stored
from siteready.llm.topk import usable

LAYERS = 4
PLANES = 8
#: Components of the candidates of one block.
CELLS = 1 << 20
ANCHORS = 1024
_SEED = 11
#: Relative room for the rounding of double precision in estimates.
_SLACK = 1e-9


def padded(width: int) -> int:
    """The width of codes: a power of two and whole 64-bit words."""
    return max(64, 1 << max(0, width - 1).bit_length())


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows turned by a fixed random rotation: lengths and products stay. The width is a power of two."""
    n = x.shape[1]
    rng = np.random.default_rng(_SEED)
    for _ in range(2):
        x = x * rng.choice((-1.0, 1.0), n)
        step = 1
        while step < n:
            x = x.reshape(len(x), n // (2 * step), 2, step)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(-1, n)
            step *= 2
        x = x / np.sqrt(n)
    return x


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def encode(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes (rows x layers x words), alignments (rows x layers) and remainders (rows) of rotated rows."""
    left = np.zeros((len(weights), padded(weights.shape[1])))
    left[:, :weights.shape[1]] = weights
    left = rotate(left)
    root = np.sqrt(left.shape[1])
    codes, along = [], []
    for _ in range(LAYERS):
        sign = left >= 0
        a = np.abs(left).sum(1) / root
        left = left - np.where(sign, 1.0, -1.0) * (a / root)[:, None]
        codes.append(_pack(sign))
        along.append(a)
    return np.stack(codes, 1), np.stack(along, 1), np.sqrt((left ** 2).sum(1))


class Planes:
    """One anchor cut into bit planes: whole steps above a floor."""

    def __init__(self, weights: np.ndarray, width: int):
        turned = np.zeros((1, width))
        turned[0, :len(weights)] = weights
        turned = rotate(turned)[0]
        self.length = float(np.sqrt((turned ** 2).sum()))
        self.floor = float(turned.min())
        self.step = float(turned.max() - self.floor) / (2 ** PLANES - 1) or 1.0
        whole = np.rint((turned - self.floor) / self.step).astype(np.int64)
        self.words = [_pack((whole >> p & 1).astype(bool)) for p in range(PLANES)]
        self.total = float((self.floor + self.step * whole).sum())
        self.off = float(np.sqrt(((turned - self.floor - self.step * whole) ** 2).sum()))
        self.root = np.sqrt(width)

    def products(self, codes: np.ndarray) -> np.ndarray:
        """<b, rounded anchor> for rows of code words, by popcounts."""
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        steps = np.zeros(len(codes), np.int64)
        for p, plane in enumerate(self.words):
            steps += np.bitwise_count(codes & plane).sum(1, dtype=np.int64) << p
        return (2 * (self.floor * ones + self.step * steps) - self.total) / self.root


class Block:
    """Candidates of one block, by ascending id."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("key")
        self.ids, self.labels = table["key"].to_numpy(), table["label"].to_numpy()
        self.width = max((len(w) for w in table["w"].to_pylist()), default=0)
        self.weights = whole_rows(table["w"], self.width)
        if not len(self.ids):
            return
        self.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint64).reshape(len(self.ids), LAYERS, -1)
        self.along = np.frombuffer(b"".join(table["along"].to_pylist())).reshape(-1, LAYERS)
        remainder = table["remainder"].to_numpy()
        # Squared lengths: each remainder is at right angles to its own layer's code, so alignments add up from the last.
        squares = np.cumsum(np.concatenate((remainder[:, None], self.along[:, ::-1]), 1) ** 2, axis=1)[:, ::-1]
        self.length, self.open = np.sqrt(squares[:, 0]), np.sqrt(squares[:, 1:])
        # No explained part is longer than its alignments together (codes of two layers need not be at right angles).
        self.reach = np.cumsum(self.along, axis=1)

    def survivors(self, anchor: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Positions left after every layer. keep: positions, lower and upper ends -> which of them stay."""
        at = np.arange(len(self.ids))
        if not len(at):
            return at
        planes = Planes(anchor, self.codes.shape[2] * 64)
        estimate = np.zeros(len(at))
        for layer in range(LAYERS):
            estimate = estimate + self.along[at, layer] * planes.products(self.codes[at, layer])
            off = self.open[at, layer] * planes.length + self.reach[at, layer] * planes.off
            off = off + _SLACK * (1 + self.length[at] * planes.length)
            stay = keep(at, estimate - off, estimate + off)
            at, estimate = at[stay], estimate[stay]
        return at

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return exact_products(self.weights[at], np.pad(anchor, (0, max(0, self.width - len(anchor))))[: self.width])


def whole_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column of longs, padded with zeros or cut to a width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[col < width], col[col < width]] = flat[col < width]
    return out


def exact_products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles below 2^53, in longs below 2^63, else in unbounded integers."""
    most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(anchor.astype(np.float64)).max(initial=0)) * max(1, len(anchor))
    if most < 2.0 ** 53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if most < 2.0 ** 62:
        return rows @ anchor
    out = [sum(int(x) * int(y) for x, y in zip(row, anchor)) for row in rows]
    if any(not -(2 ** 63) <= x < 2 ** 63 for x in out):
        raise OverflowError("an inner product exceeds 64 bits")
    return np.array(out, np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest(block: Block, key: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best other rows of one label, and how many products were formed."""
    fits = (block.labels == label) & (block.ids != key)

    def keep(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return fits[at] & (high >= _kth(low[fits[at]], k))

    at = block.survivors(anchor, keep)
    scores = block.scores(at, anchor)
    first = _first(scores, block.ids[at], k)
    return at[first], scores[first], len(at)


def banded(block: Block, label: int, anchor: np.ndarray, bands: Sequence[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each band (lowest, highest score) positions and scores of the k best rows of other labels, and products formed."""
    other = block.labels != label

    def keep(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay, allowed = np.zeros(len(at), bool), other[at]
        for least, most in bands:
            sure = allowed & (low >= least) & (high <= most)
            stay |= allowed & (high >= max(least, _kth(low[sure], k))) & (low <= most)
        return stay

    at = block.survivors(anchor, keep)
    scores, out = block.scores(at, anchor), []
    for least, most in bands:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        first = inside[_first(scores[inside], block.ids[at[inside]], k)]
        out.append((at[first], scores[first]))
    return out, len(at)


def coded(table: DataFrame, key: str, vector: str, label: Column, scale: float) -> DataFrame:
    """key, label, w (whole weights), codes, along and remainder of the rows that take part."""
    rows = table.select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))).groupBy("key").agg(F.min(F.struct("vec", "label")).alias("r"))
    rows = rows.select("key", "r.label", F.transform("r.vec", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("w"))
    width = rows.agg(F.coalesce(F.max(F.size("w")), F.lit(0))).first()[0]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step := max(1, CELLS // 4 // padded(width))):
                part = batch.slice(start, step)
                codes, along, remainder = encode(whole_rows(part.column(2), width).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([a.tobytes() for a in along], pa.binary()), pa.array(remainder)],
                    names=["key", "label", "w", "codes", "along", "remainder"])

    return rows.mapInArrow(run, "key long, label long, w array<long>, codes binary, along binary, remainder double")


def mine(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 5,
         least: int = 80, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, examined (products formed for
    the anchor's negatives in the block that gave the row)."""
    rows = stored(coded(table, key, vector, F.col(label) if isinstance(label, str) else label, scale), "negatives-codes")
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("w")), F.lit(0)).alias("width"), F.count_if(F.col("key") % every == 0).alias("anchors")).first()
    parts = -(-size["rows"] // max(256, CELLS // max(1, size["width"]))) or 1
    groups = -(-size["anchors"] // ANCHORS) or 1
    group = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(groups)).cast("int").alias("group")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    blocks = rows.select("*", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    anchors = rows.where(F.col("key") % every == 0).select("key", "label", "w", group)

    def seek_positives(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        block, found = Block(candidates), []
        for row in asked.select(["key", "label", "w"]).to_pylist():
            at, scores, _ = nearest(block, row["key"], row["label"], np.array(row["w"], np.int64), positives)
            found.append((np.full(len(at), row["key"]), block.ids[at], scores))
        return _table(found, ("anchor", "positive", "positive_score"))

    def seek_negatives(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        block, found = Block(candidates), []
        for row in asked.to_pylist():
            bands = [(-(-least * p["positive_score"] // 100), p["positive_score"]) for p in row["found"]]
            per_band, formed = banded(block, row["label"], np.array(row["w"], np.int64), bands, negatives)
            for p, (at, scores) in zip(row["found"], per_band):
                n = len(at)
                found.append((np.full(n, row["key"]), np.full(n, p["positive"]), np.full(n, p["positive_score"]), block.ids[at], scores, np.full(n, formed)))
        return _table(found, ("anchor", "positive", "positive_score", "negative", "negative_score", "examined"))

    best = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive")
    near = blocks.groupBy("part", "group").cogroup(anchors.select("*", each).groupBy("part", "group")).applyInArrow(seek_positives, "anchor long, positive long, positive_score long")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score")).alias("found"))
    near = stored(anchors.join(near, anchors["key"] == near["anchor"]).drop("anchor"), "negatives-positives")
    found = blocks.groupBy("part", "group").cogroup(near.select("*", each).groupBy("part", "group")).applyInArrow(
        seek_negatives, "anchor long, positive long, positive_score long, negative long, negative_score long, examined long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score", "examined")


def _table(found: list[tuple[np.ndarray, ...]], names: Sequence[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
