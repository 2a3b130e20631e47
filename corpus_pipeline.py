"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps with the columns of documents; the last gives
the encoded documents. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteready.llm import jaccard_join, language_id, line_dedup, mixing, pieces, tasks
from siteready.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: without text or letters, or with no language likelier than the
    others together. Learns from all documents with a language; if none has one, only texts without letters go."""
    model = language_id.train(docs)
    found = language_id.predict(docs.select(*COLUMNS, F.col("text").alias("body")), model, ("doc_id", "body", "lang", "source", "n_chars"))
    kept = language_id.plausible(F.col("lang_pred"), F.col("score")) if model[0] else F.regexp_like("body", F.lit(r"\p{L}"))
    return found.where(kept).select("doc_id", F.col("body").alias("text"), "lang", "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; documents of which nothing but deleted lines remains go."""
    out = line_dedup.dedup_lines(docs, ("lang", "source", "n_chars"))
    changed = F.col("n_deleted") > 0
    left = out.where(~changed | (F.col("n_deleted") < F.col("n_lines")))
    return left.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the least doc_id."""
    keepers = jaccard_join.near_duplicates(docs).where("keeper").select("doc_id", "v").distinct()
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("w"))
    kept = named.join(keepers.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("w") == F.col("v")), "left_semi")
    # Equal rows are all keepers; one stays.
    return kept.dropDuplicates(["doc_id", "w"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = mixing.mix_sources(docs, ("text", "lang", "n_chars"))
    return out.select("*", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the hash of the decoded text."""
    coded = pieces.encode_decode(docs, tokenizer_file(), ("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Naive Bayes sums, dependent rounding and piece merges are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tasks.stored(stage(spark, docs, sf_dir), name)
    return docs
