"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, and only its own text trainable. What
follows the last assistant turn (or a conversation without one) becomes one more row, the rest, with nothing to
train on, so that the output holds every turn.

A formatted turn is ``### <role>\\n<text>\\n</turn>\\n``. Inside texts a backslash goes before every backslash and
every control string (``###``, ``</turn>``), inside roles also before a line end (as ``\\n``), so the marks ``\\n</turn>\\n``
and the role's line end are never part of a text or role and the escaping is undone exactly.

A conversation's examples hold its turns as one string each, as the format demands, so its turns meet in one row.

Defined cases: null text or role counts as empty; turns are ordered by (turn, role, text) with nulls first, and
repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
_CONTROL = r"(\\|###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _CONTROL, "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Left to right, as a doubled backslash before an n is no line end."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\\n", "\n"), r"\\(###|</turn>)", "$1")), "\\")


def examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), target_turn (index of the trained turn, from 1; null in the rest row), text, and the
    trainable span of the text in characters: loss_start (from 1) and loss_length (0 in the rest row)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            t["role"].alias("role"), F.concat(F.lit("### "), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"))).alias("pieces"))
    count = F.size("pieces")
    # An index over the count stands for the rest; it is there if the last turn is not trained on.
    targets = F.filter(F.sequence(F.lit(1), count + 1), lambda i: F.when(i > count, F.element_at("pieces", -1)["role"] != target_role).otherwise(
        F.get("pieces", i - 1)["role"] == target_role))
    each = pieces.select("conv_id", "pieces", F.posexplode(targets).alias("at", "target"))
    upto = F.least("target", count)
    text = F.array_join(F.transform(F.slice("pieces", F.lit(1), upto), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    trained = F.col("target") <= count
    length = F.when(trained, F.length(F.get("pieces", upto - 1)["body"])).otherwise(0)
    return each.select("conv_id", (F.col("at") + 1).alias("example"), F.when(trained, F.col("target")).alias("target_turn"), text.alias("text"), length.alias("loss_length")).select(
        "conv_id", "example", "target_turn", "text",
        (F.length("text") - F.when(F.col("target_turn").isNotNull(), F.col("loss_length") + len(END)).otherwise(0) + 1).alias("loss_start"), "loss_length")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), trained (the trainable texts in order), formatted_chars; only from examples()."""
    loss = unescape(F.expr("substring(text, loss_start, loss_length)"))
    found = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct("example", loss.alias("text"))))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"))
    segments = F.filter(F.split("longest", END, -1), lambda s: s != "")
    turn = F.transform(segments, lambda s: F.struct(
        unescape_role(F.substring(F.substring_index(s, "\n", 1), 5, 1 << 30)).alias("role"),
        unescape(F.substr(s, F.instr(s, F.lit("\n")) + 1)).alias("text")))
    return found.select("conv_id", turn.alias("turns"), F.transform("losses", lambda x: x["text"]).alias("trained"), "formatted_chars")
