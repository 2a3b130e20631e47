"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by the filter width less one stride, so that
every filter position of the whole text lies in one chunk and no text is cut short. In a chunk each byte is a learned
vector of ``DEPTH`` numbers; ``FILTERS`` learned filters look at ``WIDTH`` bytes every ``STRIDE`` bytes, and their
rectified outputs are max-pooled over the chunk. The pooled values of all chunks are combined into the document's
mean and maximum for each filter, and a logistic layer over both gives one probability.

Filters, byte vectors and the last layer are learned together by gradient descent (Adam, logistic loss, the labels
weighted so that both count alike while learning; the bias is then set back to the labels' own shares) on a bounded
sample: the ``SAMPLE`` labelled rows of each label with the least id hashes. Of a sampled text that is longer than
``STEP_CHUNKS`` chunks, every step draws that many chunks spread over the whole text. The sample is trained on in one
task and the network (about 5,000 numbers) is broadcast; scoring reads all bytes of all texts.

Defined cases: a null or empty text is one chunk of padding and gets the score that gives; with labels of one kind
only, or none, the score is that kind's share (0.5 without any); a label other than 0 and 1, a null label, or a label
without a document is not learned from; several labels of one document all count; documents with the same id keep a
row each; extra columns are kept only if named; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteready.llm.tasks import map_slices

DEPTH = 8
WIDTH = 12
STRIDE = 2
FILTERS = 32
CHUNK = 192
#: Bytes by which one chunk starts after the other; the filter positions of neighbours meet without a gap.
HOP = CHUNK - (WIDTH - STRIDE)
#: Rows of each label that are learned from.
SAMPLE = 1500
EPOCHS = 8
BATCH = 32
STEP_CHUNKS = 16
RATE = 0.004
#: Chunks that are convolved at once while scoring.
_AT_ONCE = 512
_PAD = 256
_POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    """Byte vectors (257 x DEPTH, the last for padding), filters, their bias, the last layer, its bias; a prior if
    there was only one label."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float | None = None


def chunks_of(data: np.ndarray) -> np.ndarray:
    """Rows of CHUNK symbols that cover all bytes of a text; the last is padded."""
    n = max(1, -(-max(0, len(data) - (CHUNK - HOP)) // HOP))
    whole = np.full((n - 1) * HOP + CHUNK, _PAD, np.int16)
    whole[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::HOP]


def _windows(symbols: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Byte vectors under every filter position: (chunks x positions) x (WIDTH * DEPTH)."""
    rows = vectors[symbols].reshape(len(symbols), CHUNK * DEPTH)
    view = np.lib.stride_tricks.sliding_window_view(rows, WIDTH * DEPTH, axis=1)[:, :: STRIDE * DEPTH]
    return view.reshape(-1, WIDTH * DEPTH)


def pooled(net: dict[str, np.ndarray], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filter outputs of chunks (chunks x FILTERS) and the position each comes from."""
    out = (_windows(symbols, net["vectors"]) @ net["filters"]).reshape(len(symbols), _POSITIONS, FILTERS)
    at = out.argmax(1)
    best = np.take_along_axis(out, at[:, None], 1)[:, 0] + net["bias"]
    return np.maximum(best, 0), at


def _combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over each document's chunks; first: where each document's chunks start."""
    counts = np.diff(np.append(first, len(values)))[:, None]
    return np.concatenate((np.add.reduceat(values, first, 0) / counts, np.maximum.reduceat(values, first, 0)), 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gradients(net: dict[str, np.ndarray], symbols: np.ndarray, first: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    values, at = pooled(net, symbols)
    features = _combine(values, first)
    error = (_sigmoid(features @ net["last"] + net["shift"]) - wanted) * weight / len(wanted)
    out = {"last": features.T @ error, "shift": np.array([error.sum()])}
    back = error[:, None] * net["last"][None, :]
    counts = np.diff(np.append(first, len(values)))
    doc = np.repeat(np.arange(len(first)), counts)
    grad = (back[:, :FILTERS] / counts[:, None])[doc]
    top = values == features[doc, FILTERS:]
    grad = (grad + top * back[doc, FILTERS:]) * (values > 0)
    out["bias"] = grad.sum(0)
    # Only the pooled position of each chunk and filter passes a gradient on.
    chunk, filt = np.nonzero(grad)
    start = at[chunk, filt] * STRIDE
    under = symbols[chunk[:, None], start[:, None] + np.arange(WIDTH)]
    g = grad[chunk, filt][:, None]
    seen = net["vectors"][under].reshape(len(chunk), -1) * g
    filters = np.zeros((FILTERS, WIDTH * DEPTH))
    np.add.at(filters, filt, seen)
    out["filters"] = filters.T
    vectors = np.zeros_like(net["vectors"])
    np.add.at(vectors, under.reshape(-1), (net["filters"].T[filt] * g).reshape(-1, DEPTH))
    out["vectors"] = vectors
    return out


def fit(texts: Sequence[bytes], labels: np.ndarray, share: float) -> Network:
    """The network learned from a sample; share: how often label 1 occurs in all rows learned from."""
    if not len(labels) or labels.min() == labels.max():
        return Network(prior=float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(5)
    net = {
        "vectors": rng.normal(0, 0.5, (257, DEPTH)), "filters": rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)), "bias": np.zeros(FILTERS),
        "last": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1)}
    ones = labels.mean()
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    whole = [chunks_of(np.frombuffer(t, np.uint8)) for t in texts]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(whole))
        for start in range(0, len(order), BATCH):
            picked = order[start:start + BATCH]
            parts = []
            for i in picked:
                n = len(whole[i])
                # A long text's chunks: one from each of STEP_CHUNKS equal stretches.
                parts.append(whole[i] if n <= STEP_CHUNKS else whole[i][((np.arange(STEP_CHUNKS) + rng.random(STEP_CHUNKS)) * n / STEP_CHUNKS).astype(np.int64)])
            first = np.cumsum([0, *(len(p) for p in parts[:-1])])
            grads = _gradients(net, np.concatenate(parts), first, labels[picked].astype(float), weight[picked])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for name, g in grads.items():
                one, two = moment[name]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                net[name] = net[name] - rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
    net["shift"] = net["shift"] + np.log(share / (1 - share))
    return Network({k: v.astype(np.float32) for k, v in net.items()})


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """docs: doc_id, text; labels: doc_id, quality. Learns from the labelled documents among docs."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("marked"), F.col("quality").cast("int").alias("quality")).distinct()
    known = marks.join(docs.select(F.col("doc_id").cast("long").alias("marked")), "marked")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return Network(prior=float(share) if counts else 0.5)
    # At most 2 * SAMPLE ids are broadcast; the texts are read for these ids only.
    place = F.xxhash64("marked").alias("place")
    wanted = [known.where(F.col("quality") == q).distinct().select("*", place).orderBy("place", "marked").limit(SAMPLE) for q in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("marked"), "text").join(F.broadcast(wanted[0].unionByName(wanted[1])), "marked")

    def learn(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("place", "ascending"), ("marked", "ascending"), ("quality", "ascending"), ("text", "ascending")])
        texts = [(t or "").encode() for t in sample["text"].to_pylist()]
        net = fit(texts, sample["quality"].to_numpy(), share)
        return pa.table({"name": list(net.weights), "shape": [list(v.shape) for v in net.weights.values()], "data": [v.tobytes() for v in net.weights.values()]},
                        schema=pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())]))

    # Rows that repeat one id may exceed the sample again.
    each = [rows.where(F.col("quality") == q).orderBy("place", "marked", F.xxhash64("text")).limit(SAMPLE) for q in (0, 1)]
    sample = each[0].unionByName(each[1]).withColumn("one", F.lit(0))
    learned = sample.groupBy("one").applyInArrow(learn, "name string, shape array<long>, data binary").collect()
    return Network({r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in learned})


def _slice_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of a slice of texts, some at a time, and the row each belongs to, in order."""
    held, rows, size = [], [], 0
    for row, text in enumerate(pc.fill_null(column, "").cast(pa.binary()).to_pylist()):
        chunks = chunks_of(np.frombuffer(text, np.uint8))
        for start in range(0, len(chunks), _AT_ONCE):
            part = chunks[start:start + _AT_ONCE]
            held.append(part)
            rows.append(np.full(len(part), row))
            size += len(part)
            if size >= _AT_ONCE:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(rows)


def score(docs: DataFrame, net: Network, keep: Sequence[str] = ("doc_id",), least: float = 0.3) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 if score >= least)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        model = shared.value

        def run(column: pa.Array) -> list:
            if model.prior is not None:
                scores = np.full(len(column), model.prior)
                return [scores, (scores >= least).astype(np.int32)]
            total, most, count = np.zeros((len(column), FILTERS)), np.zeros((len(column), FILTERS)), np.zeros(len(column))
            for symbols, rows in _slice_chunks(column):
                values, _ = pooled(model.weights, symbols)
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                at = rows[first]
                total[at] += np.add.reduceat(values, first, 0)
                most[at] = np.maximum(most[at], np.maximum.reduceat(values, first, 0))
                count += np.bincount(rows, minlength=len(count))
            features = np.concatenate((total / count[:, None], most), 1)
            scores = _sigmoid(features @ model.weights["last"].astype(float) + float(model.weights["shift"][0]))
            return [scores, (scores >= least).astype(np.int32)]

        return run

    return map_slices(docs, "text", keep, "score double, predicted int", make)
