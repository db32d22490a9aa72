"""Chat formatting from an event log, with DataFrame functions only.

The log of a conversation holds, in sequence: ``open`` (starts a message, gives its role), ``delta`` (adds text),
``edit`` (replaces the text), ``regenerate`` (drops the text; new deltas follow). Folding gives the final messages;
rendering gives the formatted text and which pieces of it are under the loss mask.

A message is folded where its own events meet, so a very long conversation is spread over its messages; what meets
per conversation are the final messages, which its one formatted text needs anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks. "<" never stands in escaped text, so no text can form one.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """events(conv_id, message, seq, op, role, text) to (conv_id, message, role, text).

    Per message, by seq: the text is what the last edit set (nothing after a regenerate), and the deltas after it.
    seq orders the events of a message; different events of one seq all apply, in the order of op, role and text. The
    role is the last one given. Null texts are empty; a null or unknown op adds nothing; an event delivered twice counts
    once; null conversations and messages are keys like any other; an empty table gives an empty result; other columns
    are not read.
    """
    rows = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_set(F.struct("seq", "op", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("e"))
    given = F.filter("e", lambda x: x["role"].isNotNull())
    resets = F.filter(F.transform("e", lambda x, k: F.when(x["op"].isin("edit", "regenerate"), k + 1).otherwise(0)), lambda k: k > 0)
    rows = rows.select("conv_id", "message", F.try_element_at(given, F.lit(-1))["role"].alias("role"), "e", F.coalesce(F.array_max(resets), F.lit(1)).alias("from"))
    live = F.filter(F.slice("e", F.col("from"), F.size("e")), lambda x: x["op"].isin("edit", "delta"))
    return rows.select("conv_id", "message", "role", F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, message, role, text) to (conv_id, pieces, formatted): pieces is array<struct<text, loss>>, whose
    texts joined are the formatted text; loss is true for the texts of assistants only. Null roles and texts are empty;
    messages that are equal come as often as they are; an empty table gives an empty result; other columns are not read."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    own = F.array(
        piece(F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), F.lit(False)),
        piece(text, role == "assistant"),
        piece(F.lit(END + "\n"), F.lit(False)),
    )
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", own.alias("own")))).alias("m"))
    rows = rows.select("conv_id", F.flatten(F.transform("m", lambda x: x["own"])).alias("pieces"))
    return rows.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))


def turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    parts = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def read(p: Column) -> Column:
        halves = F.split(F.substring_index(p, END, 1), r"<\|text\|>", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(parts, read)


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log whose outcome is conversations(conv_id, turn, role, text): users first send a draft and edit it,
    assistants stream an answer, are asked again, and stream the final one in two deltas; other roles send one delta.
    Equal rows of a turn are messages of their own, in the order of role and text. Null texts are empty, null turns come
    first; an empty table gives an empty log; other columns are not read."""
    from pyspark.sql import Window

    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", F.struct("turn", F.row_number().over(same).alias("nth")).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    event = lambda seq, op, text: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), text.cast("string").alias("text"))
    opened = event(0, "open", F.lit(None))
    user = F.array(opened, event(1, "delta", F.lit("draft")), event(2, "edit", F.col("text")))
    head, tail = F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))"), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")
    assistant = F.array(opened, event(1, "delta", F.lit("first try")), event(2, "regenerate", F.lit(None)), event(3, "delta", head), event(4, "delta", tail))
    other = F.array(opened, event(1, "delta", F.col("text")))
    events = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(other)
    rows = rows.select("conv_id", "message", "role", F.explode(events).alias("e"))
    return rows.select("conv_id", "message", "e.seq", "e.op", "role", "e.text")
