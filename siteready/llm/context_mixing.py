"""LM scoring by online logistic context mixing over hashed contexts.

A text is its lower-cased words and one end. A word is coded as its bytes and a space, the end as a space alone, each
byte as eight bits from the highest. For every bit five predictors look up counters under hashes of their context:
the last one, two, three and four bytes of the word and the whole word so far, each with the bits of this byte already
coded. Their log odds are combined by weights chosen by a gate (how often the whole word so far has been seen or else the longest shorter
context that has, and the bit),
and an adaptive map from gate and mixed log odds refines the probability. As each bit is predicted from what comes
before it, the probabilities of all texts sum to one.

What a word costs follows from its bytes, so everything is learned from and computed for the table of distinct words
with their counts: corpus work is one count of words, and it grows with the corpus. Counters are summed over all tasks
of that table; weights are learned online by each task over its share, from counters without the occurrence being
predicted, and averaged; the map's counts are summed. The counters of the whole word so far are exact and in no table:
words are shuffled by their first ``HEAD_BYTES`` bytes, and a task counts its words' common beginnings bit by bit, so
they grow with the corpus and nothing collides. What the first bytes count is summed by groups and broadcast, one row
for each distinct beginning. The shorter contexts (``SLOTS`` pairs of counters, 19 MB whatever the corpus; contexts
that collide share one) and some hundred weights are broadcast. A task holds the words of one beginning at a time.

No context reaches before its word: a text and the same words in another order score alike.

Scoring looks up the ``HEAD`` most frequent words in a broadcast table of that many rows; all other words of a document
are joined with the table of words, where none of them can be hot.

Words are named by 64-bit hashes. Rows with equal doc_id and text are scored alike. Defined cases: null text is empty
(one token, the end); words of any length are scored whole; a null doc_id counts as the empty text where documents are
held out; without training rows every count is zero and all bits are even; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteready.llm.tasks import remainder, stored
from siteready.llm.words import Words, mix, slices

#: Counters of each hashed context, shortest first, as powers of two.
BITS = (16, 18, 20, 20)
CONTEXTS = len(BITS) + 1  # and the whole word so far
BLOCK = 1 << 14
OFFSETS = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
SLOTS = int(OFFSETS[-1])
HEAD = 1 << 18
END = 0  # the name of the end token
_PRIOR = 0.4
_RIDGE = 100.0  # keeps the first steps small
_BUCKETS = 33  # of the refining map, over log odds from -8 to 8
_LEVELS = 14  # of how often the whole word so far has been seen
_GATES = (CONTEXTS + _LEVELS) * 8
#: Bytes of words that are coded at once.
_CHUNK = 1 << 15
#: First bytes of a word (with its space) by which words are shuffled, and bytes of words whose beginnings are counted at once.
HEAD_BYTES, _GROUP_BYTES = 3, 1 << 20


@dataclass
class Model:
    words: DataFrame  # those learned from
    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray  # gates x contexts
    refined: np.ndarray  # gates x buckets: log odds


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each byte to be coded, the word it belongs to, and its contexts as 64-bit values."""
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(data))
    wide, context, contexts = data.astype(np.uint64) + np.uint64(1), np.zeros(len(data), np.uint64), []
    for back in range(1, 5):
        before = at - back
        context = context << np.uint64(9) | np.where(before >= start, wide[before], np.uint64(0))
        contexts.append(context)
    return data, np.repeat(np.arange(len(words)), sizes), [mix(c + np.uint64(k + 1)) for k, c in enumerate(contexts)]


def _slots(contexts: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """Counter of each context for the bits already coded (node)."""
    spread = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([((c ^ spread) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - b)).astype(np.int64) + OFFSETS[k] for k, (c, b) in enumerate(zip(contexts, BITS))])


def _coded(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits: its number, the words, the bits, the counters (contexts x symbols)."""
    data, owner, contexts = _symbols(words)
    for i in range(8):
        node = (1 << i) | (data.astype(np.int64) >> (8 - i))
        yield i, owner, data >> (7 - i) & 1, _slots(contexts, node)


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, start = np.cumsum(sizes + 1), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _CHUNK, "right")))
        yield start, stop
        start = stop


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("word"))
        for start, stop in _chunks(pc.binary_length(column).to_numpy()):
            part = batch.slice(start, stop - start)
            yield part, part.column(batch.schema.get_field_index("word")).to_pylist()


def _beginnings(words: list[bytes], c: np.ndarray, group: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the beginning before each bit of each word was followed by 0 and by 1 (bits x bytes), from byte
    ``level`` on; words of a group share the bytes before it."""
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    starts, counts = np.cumsum(sizes) - sizes, np.zeros((2, 8, len(data)), np.float32)
    alone = sizes.copy()  # from where on a word shares its beginning with no other
    active = np.flatnonzero(sizes > level)
    g = group[active]
    while len(active):
        at, w = starts[active] + level, c[active]
        for i in range(8):
            bit = data[at] >> (7 - i) & 1
            total, ones = np.bincount(g, w), np.bincount(g, w * bit)
            counts[0, i, at], counts[1, i, at] = (total - ones)[g], ones[g]
            g = g * 2 + bit
            used = np.zeros(2 * len(total), np.int64)
            used[g] = 1
            g = (np.cumsum(used) - 1)[g]
        level += 1
        single = np.bincount(g)[g] == 1
        alone[active[single]] = level
        keep = ~single & (sizes[active] > level)
        active, g = active[keep], g[keep]
    at = np.flatnonzero(np.arange(len(data)) - np.repeat(starts, sizes) >= np.repeat(alone, sizes))
    own = np.repeat(c, sizes)[at]
    for i in range(8):
        bit = data[at] >> (7 - i) & 1
        counts[0, i, at], counts[1, i, at] = own * (1 - bit), own * bit
    return counts[0], counts[1]


def _head(words: DataFrame) -> DataFrame:
    return words.withColumn("head", F.substring(F.concat("word", F.lit(b" ")), 1, HEAD_BYTES))


def _heads(words: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The distinct first bytes of words (head, c), and the counts of their beginnings: 2 x heads x bytes x bits."""
    found = words.groupBy("head").agg(F.sum("c").alias("c")).orderBy("head").toArrow()
    heads = found["head"].to_pylist()
    if not heads:
        return [], np.zeros((2, 0, HEAD_BYTES, 8), np.float32)
    sizes = np.array([len(h) for h in heads])
    counts = np.zeros((2, len(heads), HEAD_BYTES, 8), np.float32)
    inside = np.arange(HEAD_BYTES) < sizes[:, None]
    for bit, n in enumerate(_beginnings(heads, found["c"].to_numpy().astype(float), np.zeros(len(heads), np.int64), 0)):
        counts[bit][inside] = n.T
    return heads, counts


def _together(words: DataFrame) -> DataFrame:
    """Words by their first bytes: those of one beginning follow each other in one task, the beginnings in hashed order."""
    return words.repartition("head").sortWithinPartitions(F.xxhash64("head"), "head")


def _with_beginnings(batches: Iterator[pa.RecordBatch], heads: list[bytes], above: np.ndarray) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Chunks of words (head, word, c, ...) from _together with the counts of the whole word so far: 2 x bits x bytes."""
    place = {h: i for i, h in enumerate(heads)}

    def done(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        words, of = table.column(1).to_pylist(), np.array([place[h] for h in table.column(0).to_pylist()])
        group = np.unique(of, return_inverse=True)[1]
        counts = np.stack(_beginnings([w + b" " for w in words], table.column(2).to_numpy().astype(float), group, HEAD_BYTES))
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        first, owner = at < HEAD_BYTES, np.repeat(of, sizes)
        for bit in (0, 1):
            counts[bit][:, first] = above[bit][owner[first], at[first]].T
        # Every chunk takes words of all beginnings, as weights learned on a few would stray.
        k = min(len(words), max(1, int(ends[-1]) // _CHUNK))
        index = np.repeat(np.arange(len(words)), sizes) % k
        for j in range(k):
            yield table.take(pa.array(np.arange(j, len(words), k))), words[j::k], counts[:, :, index == j]

    held, size = [], 0
    for batch in batches:
        head = batch.column(0).to_pylist()
        edges = [i for i in range(batch.num_rows) if (head[i - 1] if i else held[-1].column(0)[-1].as_py() if held else None) != head[i]]
        lengths, start = pc.binary_length(batch.column(1)).to_numpy(), 0
        for stop in [*edges, batch.num_rows]:
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(lengths[start:stop].sum()) + stop - start
            if size > _GROUP_BYTES and stop < batch.num_rows:
                yield from done(held)
                held, size = [], 0
            start = stop
    if held:
        yield from done(held)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + _PRIOR) / (zeros + _PRIOR)), -8.0, 8.0)


def _level(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else from 1 by the power of two of its count."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1.0)).astype(np.int64), _LEVELS - 1) + 1, 0)


def _gate(seen: np.ndarray, level: np.ndarray, bit: int) -> np.ndarray:
    """The bit, and the level of the whole word so far or, below it, the longest shorter context seen (0: none)."""
    shorter = np.where(seen.any(0), CONTEXTS - 1 - seen[::-1].argmax(0), 0)
    return np.where(level > 0, CONTEXTS - 1 + level, shorter) * 8 + bit


def _start() -> np.ndarray:
    """Weights before learning: the longest context counts by how often it has been seen, shorter ones share the rest."""
    shares = np.array([0.05, 0.15, 0.3, 0.5])
    weights = np.zeros((CONTEXTS + _LEVELS, CONTEXTS))
    for gate, row in enumerate(weights):
        level = gate - CONTEXTS + 1
        longest = min(max(gate, 1), len(shares))
        row[:longest] = shares[-longest:] / shares[-longest:].sum()
        if level > 0:
            row[-1] = 2.0 ** level / (2.0 ** level + 16.0)
            row[:-1] *= 1.0 - row[-1]
    return np.repeat(weights, 8, axis=0)


def _likely(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def _bucket(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.clip(z, -8.0, 8.0) + 8.0) / 16.0 * (_BUCKETS - 1)
    low = np.minimum(at.astype(np.int64), _BUCKETS - 2)
    return low, at - low


def _planes(counts: np.ndarray) -> bytes:
    """Whole numbers as byte planes, lowest first: most counts are small, so most planes are zeros and compress."""
    return counts.astype("<u8").reshape(-1, 1).view(np.uint8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.float64)


def _count_words(docs: DataFrame) -> DataFrame:
    """hash, word, n (all occurrences), c (those in training rows); the end token as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                learn = part.column(0).to_numpy(zero_copy_only=False)
                words = Words(part.column(1))
                names, first, of = np.unique(words.hashes, return_index=True, return_inverse=True)
                n = np.bincount(of, minlength=len(names))
                c = np.bincount(of, weights=np.repeat(learn, np.diff(words.rows)), minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(names, np.uint64(END)).view(np.int64)), pa.array([*map(words.word, first), b""], pa.binary()),
                     pa.array(np.append(n, len(learn))), pa.array(np.append(c, learn.sum()))], names=["hash", "word", "n", "c"])

    rows = docs.select((remainder(F.col("doc_id"), 7) != 2).alias("learn"), "text")
    return rows.mapInArrow(run, "hash long, word binary, n long, c long").groupBy("hash", "word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _train_counters(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, SLOTS), np.float64)
        for part, words in _word_batches(batches):
            c = part.column(1).to_numpy().astype(float)
            for _, owner, bits, slots in _coded(words):
                weight = c[owner]
                for bit in (0, 1):
                    hit = bits == bit
                    for k in range(len(BITS)):
                        np.add.at(both[bit], slots[k][hit], weight[hit])
        blocks = np.flatnonzero(both.reshape(2, -1, BLOCK).any((0, 2)))
        for b in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_planes(both[:, b * BLOCK:(b + 1) * BLOCK])])], names=["block", "cells"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BLOCK, np.float64)
        for batch in batches:
            for cells in batch.column(1).to_pylist():
                total += _unplaned(cells)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()])], names=["block", "cells"])

    summed = vocabulary.where("c > 0").select("word", "c").mapInArrow(count, "block int, cells binary").groupBy("block").applyInArrow(add, "block int, cells binary")
    tables = np.zeros((2, SLOTS), np.float32)
    for row in summed.toLocalIterator():
        tables[:, row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["cells"], np.float32).reshape(2, BLOCK)
    return tables[0], tables[1]


def _train_weights(vocabulary: DataFrame, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = _head(vocabulary.where("c > 0")).select("head", "word", "c")
    shared = vocabulary.sparkSession.sparkContext.broadcast((zeros, ones, *_heads(words)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones, heads, above = shared.value
        weights = _start()
        bend = np.tile(np.eye(CONTEXTS) * _RIDGE, (_GATES, 1, 1))
        worth, hits = np.zeros(_GATES), np.zeros((2, _GATES, _BUCKETS))
        for part, words, whole in _with_beginnings(batches, heads, above):
            c = part.column(2).to_numpy().astype(float)
            for i, owner, bits, slots in _coded(words):
                n0, n1 = np.vstack((zeros[slots], whole[0, i])) - (bits == 0), np.vstack((ones[slots], whole[1, i])) - (bits == 1)
                n0, n1 = np.maximum(n0, 0.0), np.maximum(n1, 0.0)
                odds, gate, weight = _odds(n0, n1), _gate(n0[:-1] + n1[:-1] > 0, _level(n0[-1] + n1[-1]), i), c[owner]
                z = (weights[gate] * odds.T).sum(1)
                low, up = _bucket(z)
                for bit in (0, 1):
                    hit = bits == bit
                    for at, share in ((low, 1 - up), (low + 1, up)):
                        np.add.at(hits[bit], (gate[hit], at[hit]), (weight * share)[hit])
                p = _likely(z)
                worth += np.bincount(gate, weight, _GATES)
                # A Newton step on all that this task has seen so far, for each gate.
                slope = np.stack([np.bincount(gate, weight * (bits - p) * x, _GATES) for x in odds], 1)
                for k in range(CONTEXTS):
                    for m in range(k + 1):
                        bend[:, k, m] += np.bincount(gate, weight * np.maximum(p * (1 - p), 1e-3) * odds[k] * odds[m], _GATES)
                        bend[:, m, k] = bend[:, k, m]
                weights += np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        learned = np.concatenate(((weights * worth[:, None]).ravel(), worth, hits.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(learned), dtype=np.int32)), pa.array(learned)], names=["at", "value"])

    sizes = np.cumsum([_GATES * CONTEXTS, _GATES])
    learned = np.zeros(sizes[-1] + 2 * _GATES * _BUCKETS)
    # Some ten thousand numbers, summed over all tasks.
    summed = _together(words).mapInArrow(learn, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    learned[summed["at"].to_numpy()] = summed["value"].to_numpy()
    weights, worth, hits = np.split(learned, sizes)
    weights, hits = weights.reshape(_GATES, CONTEXTS), hits.reshape(2, _GATES, _BUCKETS)
    shared.unpersist()
    weights = np.where(worth[:, None] > 0, weights / np.where(worth > 0, worth, 1.0)[:, None], _start())
    # Each bucket starts as its own log odds, worth a few sightings.
    own = _likely(np.linspace(-8.0, 8.0, _BUCKETS))
    refined = np.log((hits[1] + 4 * own) / (hits[0] + 4 * (1 - own)))
    return weights, refined


def train(vocabulary: DataFrame) -> Model:
    zeros, ones = _train_counters(vocabulary)
    return Model(vocabulary, zeros, ones, *_train_weights(vocabulary, zeros, ones))


def _score_words(vocabulary: DataFrame, model: Model) -> DataFrame:
    """vocabulary with logp: log10 of the model's probability of each word."""
    odds, seen = _odds(model.zeros, model.ones).astype(np.float32), model.zeros + model.ones > 0
    asked = vocabulary.select("word", F.col("c").alias("learned"), "hash", "n", "c", F.lit(True).alias("asked"))
    if vocabulary is not model.words:
        asked = asked.withColumn("learned", F.lit(0).cast("long")).unionByName(
            model.words.where("c > 0").select("word", F.col("c").alias("learned"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("n"), "c", F.lit(False).alias("asked")))
    words = _head(asked).select("head", "word", "learned", "hash", "n", "c", "asked")
    shared = vocabulary.sparkSession.sparkContext.broadcast((odds, seen, model.weights, model.refined, *_heads(words.select("head", F.col("learned").alias("c")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, seen, weights, refined, heads, above = shared.value
        for part, words, whole in _with_beginnings(batches, heads, above):
            cost = np.zeros(len(words))
            for i, owner, bits, slots in _coded(words):
                gate = _gate(seen[slots], _level(whole[0, i] + whole[1, i]), i)
                z = (weights[gate] * np.vstack((odds[slots], _odds(whole[0, i], whole[1, i]))).T).sum(1)
                low, up = _bucket(z)
                r = refined[gate, low] * (1 - up) + refined[gate, low + 1] * up
                p = np.clip((_likely(z) + _likely(r)) / 2, 1e-6, 1 - 1e-6)
                cost += np.bincount(owner, np.log10(np.where(bits == 1, p, 1 - p)), len(words))
            out = pa.RecordBatch.from_arrays([part.column(3), part.column(4), part.column(5), pa.array(cost)], names=["hash", "n", "c", "logp"])
            yield out.filter(part.column(6))

    return _together(words).mapInArrow(run, "hash long, n long, c long, logp double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (words and one byte after
    each token)."""
    vocabulary = stored(_count_words(docs), "lm-words")
    learned = vocabulary.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    total, distinct = learned["n"] or 0, learned["v"] or 0
    words = stored(_score_words(vocabulary, train(vocabulary)), "lm-scores")
    head = words.orderBy(F.col("n").desc(), "hash").limit(HEAD).toArrow().sort_by("hash")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("hash", "c", "logp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, logp = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                words, rows = Words(part.column(2)), part.num_rows
                owner = np.concatenate((np.repeat(np.arange(rows), np.diff(words.rows)), np.arange(rows)))
                token = np.concatenate((words.hashes.view(np.int64), np.full(rows, END)))
                sizes = np.concatenate((words.ends - words.starts + 1, np.ones(rows, np.int64)))
                at = np.minimum(np.searchsorted(names, token), len(names) - 1)
                hit = names[at] == token
                of, where = owner[hit], at[hit]
                one = [part.column(0), part.column(1), part.column(1), np.ones(rows, np.int64), np.bincount(owner, minlength=rows), np.bincount(owner, sizes, rows).astype(np.int64),
                       np.bincount(of, c[where] > 0, rows).astype(np.int64), np.bincount(of, np.log10(c[where] + 1.0), rows), np.bincount(of, logp[where], rows)]
                # Words outside the head: one row for each word of a document.
                pairs, times = np.unique(np.stack((owner[~hit], token[~hit])), axis=1, return_counts=True) if not hit.all() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                take, none = pa.array(pairs[0]), np.zeros(len(times), np.int64)
                rest = [part.column(0).take(take), part.column(1).take(take), pairs[1], none, none, none, times, none.astype(float), none.astype(float)]
                for columns in (one, rest):
                    if len(columns[3]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["doc_id", "v", "hash", "rows", "tokens", "bytes", "known", "logc", "logp"])

    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("v"), "text").mapInArrow(
        run, "doc_id long, v long, hash long, rows long, tokens long, bytes long, known long, logc double, logp double")
    found = seen.join(words.select("hash", F.col("c").alias("c"), F.col("logp").alias("word_logp")), "hash", "left")
    tail = F.col("rows") == 0
    sums = found.groupBy("doc_id", "v").agg(
        F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"),
        F.sum(F.when(tail, F.when(F.col("c") > 0, F.col("known")).otherwise(0)).otherwise(F.col("known"))).alias("known"),
        F.sum(F.when(tail, F.col("known") * F.log10(F.col("c") + 1.0)).otherwise(F.col("logc"))).alias("logc"),
        F.sum(F.when(tail, F.col("known") * F.col("word_logp")).otherwise(F.col("logp"))).alias("logp"))
    per = lambda c: F.col(c) / F.col("rows")  # noqa: E731  equal rows have been summed
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    return each.select(
        "doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), per("tokens").cast("long").alias("n_tokens"), per("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (per("logc") - per("tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), per("logp").alias("score"), (-per("logp") / F.log10(F.lit(2.0)) / per("bytes")).alias("bits_per_byte"))
