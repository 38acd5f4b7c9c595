"""Chat formatting by event-sourced reconstruction, DataFrame functions only.

An event log has rows (conv_id, seq, turn, kind, role, text):

- ``delta``: appends ``text`` to message ``turn``;
- ``edit``: the message's text becomes ``text``;
- ``regenerate``: message ``turn`` starts again from nothing and later turns made so far go.

``fold`` partitions by conversation, sorts by sequence and leaves the final messages; ``render``
writes them in a chat template with a loss mask; ``read_back`` parses a rendered string.

Scale: the fold aggregates per (conversation, turn) and looks across turns with a running maximum
over one row per turn that had a regeneration or message, so streamed deltas never meet in one window.
A rendered conversation is one string, hence one row: its messages meet there because the output demands it.

Edge cases: null text is empty, null role is empty, null conv_id is a conversation of its own, null
turn sorts first; null seq counts as before all others; null kind is a delta; equal (seq, turn) events apply in the order of kind
(regenerate, edit, delta), then text; repeated delta rows append repeatedly; a conversation
whose messages all went gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_LOWEST = -(1 << 63)


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(_LOWEST))
    e = events.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), seq.alias("seq"),
        F.when(kind == "regenerate", 0).when(kind == "edit", 1).otherwise(2).alias("step"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    at = F.struct("seq", "step", "text")
    messages = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("step") == 0, F.col("seq"))).alias("again"),
        F.sort_array(F.collect_list(F.struct("seq", "step", "text", "role"))).alias("log"),
        F.max(F.when(F.col("step") == 1, at)).alias("edit"))
    # Regenerations of earlier turns remove what this turn had before them.
    before = (Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    gone = F.greatest(F.max("again").over(before), F.col("again"))
    m = messages.withColumn("gone", F.coalesce(gone, F.lit(_LOWEST)))
    after_cut = F.filter("log", lambda x: (x["step"] != 0) & (x["seq"] >= F.col("gone")))
    m = m.withColumn("live", after_cut).where(F.size("live") > 0)
    last = F.col("edit")
    edited = last.isNotNull() & (last["seq"] >= F.col("gone"))
    m = m.withColumn("edited", edited)
    added = F.filter("live", lambda x: (x["step"] == 2) & (~F.col("edited") | (x["seq"] >= last["seq"])))
    text = F.concat(F.when(F.col("edited"), last["text"]).otherwise(F.lit("")),
                    F.array_join(F.transform(added, lambda x: x["text"]), ""))
    roles = F.filter(F.transform("live", lambda x: x["role"]), lambda r: r != "")
    return m.select("conv_id", "turn", F.coalesce(F.get(roles, 0), F.lit("")).alias("role"),
                    text.alias("text"))


def escape(text: Column) -> Column:
    """No ``<|`` is left: each ``<``, backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Backslash as ``\\s`` and line feed as ``\\n``, then as texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, segments array<struct<chunk, loss>> (their chunks joined are
    ``formatted``; ``loss`` marks the text of assistant messages).

    Each message renders as ``<|im_start|>role\\ntext<|im_end|>\\n``.
    """
    m = messages.select(
        "conv_id", F.struct(
            F.col("turn"), F.col("role"),
            F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body")).alias("m"))
    whole = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    segments = F.flatten(F.transform("ms", lambda x: F.array(
        F.struct(x["head"].alias("chunk"), F.lit(False).alias("loss")),
        F.struct(x["body"].alias("chunk"), (x["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END + "\n").alias("chunk"), F.lit(False).alias("loss")))))
    out = whole.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["chunk"]), "").alias("formatted"),
                      "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a rendered string."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def message(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.regexp_replace(p, r"(?s)\A[^\n]*\n|<\|im_end\|>\n\z", "")
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, message)


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["chunk"])), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """A finished conversation table as a log: each row is one delta and a message of its own, numbered in the order of turn (null
    turns last, as in SQL), role, text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    number = F.row_number().over(order)
    return conversations.select("conv_id", number.alias("seq"), number.alias("turn"), F.lit("delta").alias("kind"), "role", "text")
