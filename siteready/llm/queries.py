"""One query for each operator, over whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteready.llm import (chat_format, context_mixing, hard_negatives, jaccard_join, language_id, lexical_search, line_dedup, mixing, pieces, posting_lists, quality,
                           surrogates, topk)
from siteready.llm.tasks import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, ("doc_id", "held_out"))


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("end_byte"))


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"), b"siteready surrogates")


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op5_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, text, ('0x' || left(md5(text), 15))::BIGINT AS v FROM documents),
cut AS (SELECT DISTINCT doc_id, v, i - 1 AS line, string_split(text, chr(10))[i] AS body FROM docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
lines AS (SELECT doc_id, v, line, ('0x' || left(md5(body), 15))::BIGINT AS h, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS w FROM cut),
num AS (SELECT doc_id, v, line, h, row_number() OVER d AS n, sum(w) OVER d - w AS pre, sum(w) OVER (PARTITION BY doc_id, v) AS total
  FROM lines WHERE w > 0 WINDOW d AS (PARTITION BY doc_id, v ORDER BY line)),
runs AS (SELECT *, CASE WHEN pre + 25 <= total THEN ('0x' || left(md5((SELECT string_agg(m.h::VARCHAR, ',' ORDER BY m.n) FROM num m
  WHERE m.doc_id IS NOT DISTINCT FROM num.doc_id AND m.v = num.v AND m.pre BETWEEN num.pre AND num.pre + 24)), 15))::BIGINT END AS run FROM num),
marks AS (SELECT DISTINCT doc_id, v, f.n AS n, f.run AS run FROM (SELECT doc_id, v, min(CASE WHEN run IS NOT NULL THEN {'run': run, 'n': n} END)
  OVER (PARTITION BY doc_id, v ORDER BY pre RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) AS f FROM runs) WHERE f IS NOT NULL),
ranked AS (SELECT *, first_value(doc_id) OVER r AS d0, first_value(v) OVER r AS v0, first_value(n) OVER r AS n0 FROM marks WINDOW r AS (PARTITION BY run ORDER BY doc_id NULLS LAST, v, n)),
hits AS (SELECT doc_id, v, d0, v0, n - n0 AS shift, n FROM ranked WHERE NOT (doc_id IS NOT DISTINCT FROM d0 AND v = v0 AND n = n0)),
same AS (SELECT p.*, a.line, a.n FROM (SELECT DISTINCT doc_id, v, d0, v0, shift FROM hits) p
  JOIN num a ON a.doc_id IS NOT DISTINCT FROM p.doc_id AND a.v = p.v JOIN num b ON b.doc_id IS NOT DISTINCT FROM p.d0 AND b.v = p.v0 AND b.n = a.n - p.shift AND b.h = a.h),
chain AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, v, d0, v0, shift ORDER BY n) AS stretch FROM same),
kept AS (SELECT c.*, max(CASE WHEN h.n IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.doc_id, c.v, c.d0, c.v0, c.shift, c.stretch) AS hit FROM chain c
  LEFT JOIN hits h ON h.doc_id IS NOT DISTINCT FROM c.doc_id AND h.v = c.v AND h.d0 IS NOT DISTINCT FROM c.d0 AND h.v0 = c.v0 AND h.shift = c.shift AND h.n = c.n),
gone AS (SELECT DISTINCT doc_id, v, line FROM kept WHERE hit = 1),
left_over AS (SELECT c.doc_id, c.v, count(*) FILTER (WHERE regexp_matches(c.body, '[^\x20\x09-\x0D]')) AS n_lines, count(g.line) AS n_deleted,
  coalesce(string_agg(c.body, chr(10) ORDER BY c.line) FILTER (WHERE g.line IS NULL), '') AS rest
  FROM cut c LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM c.doc_id AND g.v = c.v AND g.line = c.line GROUP BY 1, 2)
SELECT d.doc_id, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_deleted, 0) AS n_deleted, md5(CASE WHEN d.text IS NOT NULL THEN l.rest END) AS text_md5
FROM docs d LEFT JOIN left_over l ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.v = d.v
"""


@_query
def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(_table(spark, sf_dir, "embeddings"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(_table(spark, sf_dir, "documents"))


@_query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat_format.read_back(chat_format.examples(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


ORACLES["op9_chat_format"] = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r)),
sized AS (SELECT *, length(role) + length(text) + 5 + 9
    + length(regexp_replace(text, '(\\|###|</turn>)', '+\1', 'g')) - length(text)
    + length(replace(regexp_replace(role, '(\\|###|</turn>)', '+\1', 'g'), chr(10), 'xx')) - length(role) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM rows),
upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS whole FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN whole ELSE 0 END)::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id
"""


@_query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


ORACLES["op10_exact_top_k"] = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS w FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@_query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
WITH seen AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(terms) AS n, terms FROM seen WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
found AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY term, docs),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total.terms))) AS part FROM found JOIN weights USING (term), total),
scores AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM parts JOIN asked USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label=label).drop("examined")


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, min({'w': list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT), 'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.r.label AS same, list_sum(list_transform(list_zip(a.r.w, c.r.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@_query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    net = quality.train(docs.where(~F.col("held_out")), _table(spark, sf_dir, "labels"))
    return quality.score(docs, net, ("doc_id", "held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
