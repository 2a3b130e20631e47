"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything between them becomes one space; the features are the n-grams of ``ORDERS``
characters, hashed to ``BUCKETS`` counters. Tasks count their own documents and send the counters that are not
zero; summed by language and bucket they give a matrix of log probabilities of languages x BUCKETS, which is
broadcast: its size follows the number of languages (at most MAX_LANGUAGES, else an error) and not the data. Scoring
gathers the matrix rows of each document's n-grams and sums them.

Log probabilities are whole multiples of 2^-20, so that sums do not depend on their order: reruns and other
partitionings give the same bits.

Defined cases: ``und`` with score 0 for texts that are null or hold no letter, and for all if nothing was learned;
equally likely languages go to the smaller code point; a null doc_id counts as the empty text where documents are held
out; texts of any length are read whole, a slice at a time; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteready.llm.tasks import map_slices
from siteready.llm.words import mix, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
UNKNOWN = "und"
_SCALE = float(1 << 20)
#: Code points that are counted at once; a longer text goes on with the last ones of the piece before it, so that its
#: n-grams are those of the whole text.
PIECE = 1 << 18


def _letters() -> np.ndarray:
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters.table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with one space between words and around each text, and where each text starts."""
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=bounds[1:])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    keep[bounds[:-1]] = True
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def _long_codes(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The codes of one long text in pieces; each begins with the last codes before it, whose number comes with it."""
    whole, carry, after_letter = " " + text.lower() + " ", np.zeros(0, np.uint32), True
    for start in range(0, len(whole), PIECE):
        codes = np.frombuffer(whole[start:start + PIECE].encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        piece = np.concatenate((carry, np.where(letter, codes, np.uint32(32))[keep]))
        yield piece, len(carry)
        carry = piece[len(piece) - min(len(piece), max(ORDERS) - 1):]


def _grams(codes: np.ndarray, bounds: np.ndarray, carried: int = 0, orders: Sequence[int] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams, and for each the text it belongs to. The first ``carried`` codes were
    counted before: n-grams that end in them are left out."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    wide = codes.astype(np.uint64) + np.uint64(1)
    value = np.zeros(len(wide), np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(wide) - n + 1
        if m <= 0:
            return
        value = value[:m] * np.uint64(0x100000001B3) + wide[n - 1:]
        if n not in orders:
            continue
        inside = owner[:m] == owner[n - 1:]
        inside[:max(0, carried - n + 1)] = False
        if n == 1:
            inside &= codes != 32
        yield (mix(value[inside] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), owner[:m][inside]


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], int]]:
    """Codes, text bounds, row numbers and carried codes: many texts, or a piece of a long one; about PIECE characters."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts.to_pylist()):
        text = text or ""
        if len(text) > PIECE:
            for codes, carried in _long_codes(text):
                yield codes, np.array([0, len(codes)]), [row], carried
            continue
        held.append(text)
        rows.append(row)
        size += len(text)
        if size >= PIECE:
            yield *_codes(held), rows, 0
            held, rows, size = [], [], 0
    if held:
        yield *_codes(held), rows, 0


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and their log probabilities times 2^20: BUCKETS rows of counters, then the
    prior. docs: text, lang; rows without either are left out."""
    source = docs.where("text is not null and lang is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                for lang in langs:
                    table.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += 1
                code = np.array([names.index(x) for x in langs], np.int64)
                for codes, bounds, rows, carried in _pieces(part.column(1)):
                    of = code[rows]
                    for buckets, owner in _grams(codes, bounds, carried):
                        seen = np.bincount(of[owner] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                        for i, name in enumerate(names):
                            table[name][:BUCKETS] += seen[i]
        for lang, counts in table.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    summed = source.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = [r[0] for r in source.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    counts = np.zeros((BUCKETS + 1, len(names)))
    if names:
        found = summed.toPandas()
        counts[found["bucket"], np.searchsorted(names, found["lang"])] = found["n"]
    likely = np.empty_like(counts)
    likely[:BUCKETS] = np.log((counts[:BUCKETS] + 0.5) / (counts[:BUCKETS].sum(0) + 0.5 * BUCKETS)) if names else 0
    likely[BUCKETS] = np.log(counts[BUCKETS] / max(counts[BUCKETS].sum(), 1.0)) if names else 0
    return names, np.round(likely * _SCALE).astype(np.int64)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score: the posterior probability of the predicted language."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def make():
        weights = shared.value

        def score(column: pa.Array) -> list:
            total = np.zeros((len(column), len(names)), np.int64)
            lettered = np.zeros(len(column), bool)
            for codes, bounds, rows, carried in _pieces(column):
                at = np.array(rows)
                for buckets, owner in _grams(codes, bounds, carried):
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    if len(first):
                        np.add.at(total, at[owner[first]], np.add.reduceat(weights[buckets], first, axis=0))
                        lettered[at[owner[first]]] = True
            if not names:
                return [[UNKNOWN] * len(column), np.zeros(len(column))]
            scores = (total + weights[BUCKETS]) / _SCALE
            best = scores.argmax(1)
            share = 1.0 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
            return [[names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, share, 0.0)]

        return score

    return map_slices(docs, "text", keep, "lang_pred string, score double", make)


def plausible(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a prediction keeps its document: a language was found and is likelier than all others together."""
    return (lang != UNKNOWN) & (score >= least)
