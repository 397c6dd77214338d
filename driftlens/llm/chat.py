"""Chat formatting from an event log, with DataFrame functions only.

Events of a conversation carry a sequence number and one of five kinds: start (a message begins, with its role),
delta (text is appended), edit (the text so far is replaced), regenerate (the text so far is thrown away) and
delete. A message is folded from its last start, edit or regenerate on; it is gone if a delete comes after that.
Messages are then ordered by turn (ties by role, then text, are numbered as copies) and rendered:

    <|turn|>role<|text|>text<|end|>

Control strings inside roles and texts are broken by a backslash after their first character and backslashes are
doubled, so the output can be read back exactly. The loss mask is a list of spans over the output.

Defined results: null text and role are empty; a null conv_id or turn is a value of its own (first in order); rows
repeated are turns of their own; an unknown kind is ignored; an empty table gives no conversations; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Control strings of common chat templates, all of which are escaped inside texts.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BREAK = "|".join(f"\\Q{c[0]}\\E(?=\\Q{c[1:]}\\E)" for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), BREAK, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished rows (conv_id, turn, role, text): each row's start and its whole text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")))
    kinds = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("start").alias("kind"), F.lit("").alias("said")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.col("text").alias("said")),
    )
    return rows.select("conv_id", "turn", "copy", "role", F.inline(kinds)).select("conv_id", "turn", "copy", F.col("step").cast("long").alias("seq"), "kind", "role", F.col("said").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text) of a log (conv_id, turn, copy, seq, kind, role, text)."""
    kind, resets = F.col("kind"), ("start", "edit", "regenerate", "delete")
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.filter(kind.isin(*resets, "delta")).groupBy("conv_id", "turn", "copy").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last = F.aggregate("log", F.struct(F.lit(0).alias("at"), F.lit(0).alias("reset"), F.lit("").alias("role"), F.lit("").alias("kind")), lambda s, e: F.struct(
        (s["at"] + 1).alias("at"),
        F.when(e["kind"].isin(*resets), s["at"] + 1).otherwise(s["reset"]).alias("reset"),
        F.when(e["kind"] == "start", e["role"]).otherwise(s["role"]).alias("role"),
        F.when(e["kind"].isin(*resets), e["kind"]).otherwise(s["kind"]).alias("kind"),
    ))
    logs = logs.withColumn("last", last).filter(F.col("last.kind") != "delete")
    since = F.slice("log", F.greatest("last.reset", F.lit(1)), F.size("log"))
    text = F.array_join(F.transform(F.filter(since, lambda e: e["kind"].isin("delta", "edit")), lambda e: e["text"]), "")
    return logs.select("conv_id", "turn", "copy", F.col("last.role").alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (spans over formatted: turn, turn_start, start,
    length, in code points; the escaped texts of the trained role, in order)."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    parts = messages.select("conv_id", "turn", "copy", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    order = W.partitionBy("conv_id").orderBy("turn", "copy")
    parts = parts.withColumn("part", F.concat("head", "body", F.lit(END))).withColumn("n", F.row_number().over(order))
    parts = parts.withColumn("from", F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == trained, F.struct(F.col("n").alias("turn"), F.col("from").alias("turn_start"), (F.col("from") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    grouped = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "part", span.alias("span")))).alias("parts"))
    return grouped.select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"), F.array_join("parts.part", "").alias("formatted"),
        F.filter("parts.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse formatted: turns (role, text, unescaped) and masked (the unescaped text of each loss span)."""
    cut = rendered.withColumn("pieces", F.slice(F.split("formatted", "<\\|turn\\|>"), 2, F.greatest("n_turns", F.lit(1)).cast("int")))
    after = lambda p: F.substring_index(F.substring_index(p, TEXT, -1), END, 1)
    turns = F.transform("pieces", lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(after(p)).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.element_at("pieces", s["turn"]).substr((s["start"] - s["turn_start"] - len(TURN) + 1).cast("int"), s["length"].cast("int"))))
    return cut.select("conv_id", "n_turns", "formatted", "loss", turns.alias("turns"), masked.alias("masked"))
