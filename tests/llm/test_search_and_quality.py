"""Ranked lexical search, hard-negative mining and the quality network against brute force and held-out rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteready.llm import hard_negatives, language_id, lexical_search, quality, queries, topk

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranked(docs, items, k=10):
    """Every item's best documents, one pair at a time."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts += [None, "", " .,;", texts[0], texts[0].upper(), "Only-Here only_here", "日本語 text١٢", " ".join(pool) * 400]
    docs = [(i * 13 % 997, t) for i, t in enumerate(texts)] + [(5, texts[3]), (None, texts[3])]
    shared = " ".join(pool[:8])
    items = [(i, f"{shared} {pool[10 + i]} {' '.join(pool[20 + i % 3: 26 + i % 3])}") for i in range(12)]
    items += [(50, None), (51, "  "), (52, "zzzz"), (53, "Only Here"), (54, shared), (55, shared.upper()), (None, shared), (0, "one more row of item 0 日本語")]
    return docs, items


def test_lexical_search_matches_brute_force(spark, library):
    docs, items = library
    d = spark.createDataFrame([(*x, 1, 2, 3.0) for x in docs], "doc_id long, text string, n int, at int, score double").repartition(7)
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, term string")
    got = sorted(map(tuple, lexical_search.search(d, i).collect()), key=str)
    assert got == ranked(docs, items)


def test_lexical_search_in_blocks_and_small_steps(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.plan(lexical_search.item_terms(i)).count() > 1
    assert sorted(map(tuple, lexical_search.search(d, i, 3).collect()), key=str) == ranked(docs, items, 3)


def test_lexical_search_on_empty_tables(spark, library):
    docs, items = library
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(d.limit(0), i).count() == 0
    assert lexical_search.search(d, i.limit(0)).count() == 0
    assert lexical_search.search(d.where("text is null"), i).count() == 0


def test_shared_term_sets_become_one_node():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        sets = [sorted({0, 1, 2, 3, *rng.integers(0, 40, 6).tolist()}) for _ in range(n)]
        _, term = np.unique(np.concatenate(sets), return_inverse=True)
        item = np.repeat(np.arange(n), [len(s) for s in sets])
        left, right, roots = lexical_search.mine(item, term)
        leaves = term.max() + 1
        held = [{t} for t in range(leaves)]
        for a, b in zip(left, right):
            assert not held[a] & held[b]
            held.append(held[a] | held[b])
        assert [held[r] for r in roots] == [set(term[item == i].tolist()) for i in range(n)]
        if n == 30:  # far fewer additions than the items have terms
            assert len(left) < 0.75 * (len(term) - n)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(420):
        v = rng.normal(size=12) + 3 * (np.arange(12) == i % 4)
        rows.append((i * 10, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 3)) if i % 9 else 1))
    copy = rows[10][1]
    rows += [(5000 + i, copy, i % 3) for i in range(40)]
    rows += [(6000, None, 1), (6100, [0.1, None, 0.3], 1), (6200, [0.1, float("nan")], 1), (6300, [float("inf")], 1), (6400, [0.5, 0.5], None), (None, [0.5], 1),
             (6500, [0.4] * 20, 1), (6600, [], 2), (6700, [0.0] * 12, 1), (100, [0.9] * 12, 2), (6800, [0.2] * 12, 77)]
    return rows


def negatives(rows, every=100, scale=256):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (v, label)), (v, label))
    whole = {i: ([math.floor(scale * x) for x in v], label) for i, (v, label) in best.items()}
    out = []
    for a, (u, label) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i, l) for i, (v, l) in whole.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            band = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 20, 512])
def test_hard_negatives_match_brute_force(spark, vectors, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8 if cells == 512 else 1024)
    table = spark.createDataFrame([(*v, 1, 2, 3) for v in vectors], "vec_id long, embedding array<double>, label int, key int, w int, part int").repartition(3)
    got = hard_negatives.mine(table)
    assert sorted(tuple(r)[:6] for r in got.collect()) == negatives(vectors)


def test_hard_negatives_on_few_rows(spark, vectors):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(table.limit(0)).count() == 0
    assert hard_negatives.mine(table.where("vec_id % 100 != 0")).count() == 0
    assert hard_negatives.mine(table.where("vec_id = 0")).count() == 0


def test_intervals_hold_whatever_the_vectors():
    rng = np.random.default_rng(6)
    for width, scale in ((1, 5), (3, 100), (64, 90), (100, 10 ** 6), (300, 3)):
        x = rng.integers(-scale, scale + 1, (50, width))
        x[0], x[1] = 0, scale
        codes, along, remainder = hard_negatives.encode(x.astype(float))
        for q in (x[1], x[2], x[0]):
            planes = hard_negatives.Planes(q, hard_negatives.padded(width))
            estimate = sum(along[:, i] * planes.products(codes[:, i]) for i in range(hard_negatives.LAYERS))
            off = remainder * planes.length + along.sum(1) * planes.off + 1e-9 * (1 + np.linalg.norm(x, axis=1) * planes.length)
            assert (np.abs(estimate - x @ q) <= off).all()


def test_large_weights_stay_exact():
    rows = np.array([[2 ** 40, 3], [2 ** 40, 4], [-(2 ** 31), 2 ** 31]])
    assert hard_negatives.exact_products(rows, np.array([2 ** 20, 1])).tolist() == [2 ** 60 + 3, 2 ** 60 + 4, -(2 ** 51) + 2 ** 31]
    assert hard_negatives.exact_products(rows[:2], np.array([2 ** 22, 1])).tolist() == [2 ** 62 + 3, 2 ** 62 + 4]
    with pytest.raises(OverflowError):
        hard_negatives.exact_products(rows, np.array([2 ** 24, 1]))


def noisy(rng, n):
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return words


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(400):
        words = noisy(rng, rng.choice([8, 40, 300]))
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " ".join(w + "###" for w in words)))
        marks.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "ü" * 5000), (None, "no id"), (0, rows[0][1]), (903, " ".join(noisy(rng, 60000)))]
    marks += [(905, 1), (None, 1), (1, None), (2, 7)]
    docs = spark.createDataFrame([(*r, "kept", 1.5, 3) for r in rows], "doc_id long, text string, marked string, score double, place int").repartition(6).cache()
    return docs, spark.createDataFrame(marks, "doc_id long, quality int")


def test_quality_tells_held_out_rows_apart(spark, judged):
    docs, labels = judged
    held = F.col("doc_id") % 4 == 0
    net = quality.train(docs.where(~held), labels)
    out = {(r["doc_id"], r["marked"]): r for r in quality.score(docs, net, ("doc_id", "marked", "score")).collect()}
    assert len(out) == docs.count() - 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    asked = [(i, i % 3 > 0) for i in range(0, 400, 4)]
    right = [out[i, "kept"]["predicted"] == good for i, good in asked]
    assert sum(right) >= 0.97 * len(right)
    assert out[900, "kept"]["score"] == out[901, "kept"]["score"]


def test_quality_reads_every_byte_once():
    for n in (0, 1, quality.WIDTH, quality.CHUNK - 1, quality.CHUNK, quality.CHUNK + 1, quality.CHUNK + quality.HOP, 5000):
        data = np.arange(n) % 251
        chunks = quality.chunks_of(data.astype(np.uint8))
        back = np.concatenate([chunks[0], *(c[quality.CHUNK - quality.HOP:] for c in chunks[1:])])
        assert (back[:n] == data).all() and (back[n:] == 256).all() and len(back) - n <= quality.CHUNK
        starts = [i * quality.HOP + p * quality.STRIDE for i in range(len(chunks)) for p in range(quality._POSITIONS)]
        assert starts == list(range(0, len(starts) * quality.STRIDE, quality.STRIDE))


def test_quality_scores_as_one_text_at_a_time(spark, judged):
    docs, labels = judged
    net = quality.train(docs, labels)
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, net, ("doc_id", "text")).collect()}
    w = {k: v.astype(float) for k, v in net.weights.items()}
    for i, text in [(1, None), (902, None), (901, "")]:
        text = text if text is not None else docs.where(F.col("doc_id") == i).first()["text"]
        data, best = text.encode(), []
        for chunk in quality.chunks_of(np.frombuffer(data, np.uint8)):
            rows = [np.concatenate([w["vectors"][b] for b in chunk[p:p + quality.WIDTH]]) @ w["filters"] + w["bias"] for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            best.append(np.maximum(np.max(rows, 0), 0))
        z = np.concatenate((np.mean(best, 0), np.max(best, 0))) @ w["last"] + w["shift"][0]
        assert got[i, text] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_quality_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = {"vectors": rng.normal(size=(257, quality.DEPTH)), "filters": rng.normal(size=(quality.WIDTH * quality.DEPTH, quality.FILTERS)) / 8, "bias": rng.normal(size=quality.FILTERS) / 4,
           "last": rng.normal(size=2 * quality.FILTERS), "shift": np.zeros(1)}
    symbols, first, wanted, weight = rng.integers(0, 257, (5, quality.CHUNK)), np.array([0, 2]), np.array([0.0, 1.0]), np.array([1.0, 2.0])

    def loss():
        p = quality._sigmoid(quality._combine(quality.pooled(net, symbols)[0], first) @ net["last"] + net["shift"])
        return -(weight * (wanted * np.log(p) + (1 - wanted) * np.log(1 - p))).mean()

    grads = quality._gradients(net, symbols, first, wanted, weight)
    for name, g in grads.items():
        for at in rng.choice(net[name].size, 6):
            old = net[name].flat[at]
            net[name].flat[at] = old + 1e-5
            up = loss()
            net[name].flat[at] = old - 1e-5
            down = loss()
            net[name].flat[at] = old
            assert g.flat[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_quality_with_one_kind_of_label_or_none(spark, judged):
    docs, labels = judged
    for marks, want in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.limit(0), 0.5)):
        got = quality.score(docs, quality.train(docs, marks)).select("score").distinct().collect()
        assert [r[0] for r in got] == [want]
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


def test_registered_queries_name_the_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    wanted = {"op11_lexical_search": ["item_id", "rank", "doc_id", "score"], "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
              "op13_quality": ["doc_id", "held_out", "score", "predicted"]}
    for name, columns in wanted.items():
        assert queries.queries()[name](spark, sf).columns == columns


def test_top_k_with_weights_beyond_the_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [3e6, 0.0]), (2, [4e6, 0.0]), (101, [4.0e12, 1.0]), (102, [4.0e12, 9.0]), (3, [10.0, 1.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect() if r.query_id == 0}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in whole.items() if i != 0))[:3]
    assert got == {(0, n): (i, -s) for n, (s, i) in enumerate(want, 1)}


def test_a_long_text_has_the_n_grams_of_its_whole(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé  12.ΣΩ") for _ in range(5000)), "x" * 3000, " " * 6000, " a" * 2500, "12 " * 1500, "b"]

    def grams(pieces):
        return [sorted(x for codes, bounds, rows, carried in pieces if rows == [i] for b, _ in language_id._grams(codes, bounds, carried) for x in b.tolist()) for i in range(len(texts))]

    want = [sorted(x for b, _ in language_id._grams(*language_id._codes([t])) for x in b.tolist()) for t in texts]
    for piece in (7, 64, 1000):
        monkeypatch.setattr(language_id, "PIECE", piece)
        alone = [[(c, b, [i], n) for c, b, _, n in language_id._pieces(pa.array([t]))] for i, t in enumerate(texts)]
        assert grams([p for found in alone for p in found]) == want
