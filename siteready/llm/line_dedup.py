"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are separated by ``\\n``; those without a word are kept and never compared. From each line starts a run: the
shortest one of consecutive lines with ``words`` words or more, named by a hash of its line hashes. A line's window
holds the runs that start less than ``words`` words after the line does; the least run hash of each window (the first
of equal ones) is a fingerprint of the document. Two stretches of equal lines with 2 * words - 1 words or more hold
an equal window and so share a fingerprint, and no stretch of fewer than ``words`` words is ever a match.

Every fingerprint's positions are joined with its first one (by doc_id, then a hash of the text, then line). A match is
extended both ways as long as the lines of the two documents are equal, and the lines of the later one are deleted: any
deleted line has an equal line before it, so the first of all copies stays.

Rows meet by hashes of runs or of lines within one pair of documents, counts are combined before the shuffles, and
joins with a hot fingerprint or a hot first document are those that adaptive execution splits.

Defined cases: null text gives null text and no lines; texts below ``words`` words are left alone; rows that agree in
doc_id and text are treated alike (each loses the same lines); null doc_ids sort last; an empty table gives no rows;
extra columns are kept only if named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteready.llm.tasks import stored
from siteready.llm.words import WORD


def hash60(text: Column) -> Column:
    """The first 60 bits of the md5 as a long, a value that other SQL engines compute as well."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    """d (doc_id), v (hash of the text), line (index), h (hash), w (words); lines without a word are left out."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("line", "body")
    each = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), hash60(F.col("text")).alias("v"), lines)
    words = F.regexp_count("body", F.lit(WORD))
    found = each.select("d", "v", "line", hash60(F.col("body")).alias("h"), words.alias("w")).where("w > 0")
    return found.groupBy("d", "v", "line").agg(F.first("h").alias("h"), F.first("w").alias("w"))


def _numbered(lines: DataFrame) -> DataFrame:
    """n: number among the document's lines with words; at: words before it; total: the document's words."""
    doc = Window.partitionBy("d", "v")
    before = doc.orderBy("line")
    return lines.repartition("d", "v").select(
        "d", "v", "line", "h", F.row_number().over(before).alias("n"), (F.sum("w").over(before) - F.col("w")).cast("long").alias("at"), F.sum("w").over(doc).alias("total"))


def fingerprints(numbered: DataFrame, words: int) -> DataFrame:
    """d, v, n, run: the selected runs of every document and the lines where they start."""
    near = Window.partitionBy("d", "v").orderBy("at").rangeBetween(0, words - 1)
    run = F.when(F.col("at") + words <= F.col("total"), hash60(F.concat_ws(",", F.collect_list("h").over(near).cast("array<string>"))))
    least = F.min(F.when(F.col("run").isNotNull(), F.struct("run", "n"))).over(near)
    return numbered.select("d", "v", "n", "at", run.alias("run")).select("d", "v", least.alias("f")).where("f is not null").select("d", "v", "f.n", "f.run").distinct()


def repeated_lines(docs: DataFrame, words: int = 25) -> DataFrame:
    """d, v, line: every line to be deleted, once."""
    numbered = stored(_numbered(_lines(docs)), "dedup-lines")
    marks = stored(fingerprints(numbered, words), "dedup-marks")
    place = F.struct(F.col("d").isNull().alias("last"), "d", "v", "n")
    firsts = marks.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("run", F.col("first.d").alias("d0"), F.col("first.v").alias("v0"), F.col("first.n").alias("n0"))
    later = marks.join(firsts, "run").where(~(F.col("d").eqNullSafe(F.col("d0")) & (F.col("v") == F.col("v0")) & (F.col("n") == F.col("n0"))))
    pair = ["d", "v", "d0", "v0", "shift"]
    anchors = stored(later.select("d", "v", "d0", "v0", (F.col("n") - F.col("n0")).alias("shift"), "n"), "dedup-matches")
    pairs = anchors.select(*pair).distinct()
    own = pairs.join(numbered.select(F.col("d").alias("d1"), F.col("v").alias("v1"), "line", "h", "n"), F.col("d").eqNullSafe(F.col("d1")) & (F.col("v") == F.col("v1"))).select(*pair, "line", "h", "n")
    first = numbered.select(F.col("d").alias("d1"), F.col("v").alias("v1"), F.col("h").alias("h1"), F.col("n").alias("n1"))
    equal = own.join(first, F.col("d0").eqNullSafe(F.col("d1")) & (F.col("v0") == F.col("v1")) & (F.col("n") - F.col("shift") == F.col("n1")) & (F.col("h") == F.col("h1"))).select(*pair, "line", "n")
    marked = equal.withColumn("anchor", F.lit(0)).unionByName(anchors.withColumn("line", F.lit(None).cast("int")).withColumn("anchor", F.lit(1)))
    flat = marked.groupBy(*pair, "n").agg(F.max("line").alias("line"), F.max("anchor").alias("anchor"))
    chain = Window.partitionBy(*pair).orderBy("n")
    stretch = flat.withColumn("stretch", F.col("n") - F.row_number().over(chain))
    hit = F.max("anchor").over(Window.partitionBy(*pair, "stretch"))
    return stretch.withColumn("hit", hit).where("hit = 1").select("d", "v", "line").distinct()


def dedup_lines(docs: DataFrame, keep: Sequence[str] = (), words: int = 25) -> DataFrame:
    """doc_id, the kept columns, text without the deleted lines, n_lines (with a word), n_deleted."""
    gone = repeated_lines(docs, words).groupBy("d", "v").agg(F.collect_list("line").alias("gone"))
    carried = [c for c in keep if c in docs.columns and c not in ("doc_id", "text", "n_lines", "n_deleted")]
    whole = docs.select("doc_id", *carried, "text", hash60(F.col("text")).alias("v0")).join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("v0") == F.col("v")), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    wordy = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(WORD))))
    return whole.select(
        "doc_id", *carried, F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(wordy).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"))
