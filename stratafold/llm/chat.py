"""Chat formatting from event logs, in DataFrame functions only.

A log row is an event of one message of one conversation: ``open`` (begins it, with its role), ``delta`` (adds streamed text),
``edit`` (puts a new text in place of all before), ``regenerate`` (begins the message again). Messages are folded first, each on
its own, so a conversation with very many events is spread over tasks; what reaches one task in the end is the conversation's
text, which is one row of the result. An edit or a regeneration also takes back the messages that were opened between the
message and that event, since they answered the text that is gone.

The template writes ``<|im_start|>role`` + line end + text + ``<|im_end|>`` + line end. Inside roles and texts one backslash is put
before the bar of every ``<|``, ``<\\|``, ``<\\\\|`` .., so no control string is left and the change can be undone; roles also have
their backslashes and line ends written as ``\\b`` and ``\\n``. The loss mask is a list of spans of bytes: each assistant text.

Nulls: a null text or role is empty, a null kind counts as a delta, a null sequence number comes first, null conversation ids form
one conversation. Ties of the sequence number are ordered by kind and text; a repeated row of a log is a repeated event. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def messages(events: DataFrame) -> DataFrame:
    """``conv_id, at, message_id, role, text`` of the final messages from ``conv_id, message_id, seq, kind, role, text``."""
    resets = F.col("kind").isin("edit", "regenerate")
    folded = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("at"), F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))
    since = F.filter("parts", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    text = F.array_join(F.transform(since, lambda p: F.when(F.coalesce(p["kind"], F.lit("delta")) == "regenerate", F.lit("")).otherwise(p["text"])), "")
    before = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    final = folded.select("conv_id", "at", "message_id", "role", text.alias("text"), F.max("reset").over(before).alias("taken_back"))
    return final.filter("taken_back IS NULL OR at IS NULL OR taken_back < at").drop("taken_back")


def rendered(final: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans``: the formatted conversation and ``start, length`` in bytes of what bears loss."""
    head = F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    turns = final.select("conv_id", "at", "message_id", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.octet_length("head")
    turns = turns.select("conv_id", "at", "message_id", "piece", F.when(F.col("loss"), F.struct(start.alias("start"), F.octet_length("body").cast("long").alias("length"))).alias("span"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "message_id", "piece", "span"))).alias("turns"))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns, ``role`` and ``text``, read back from a formatted conversation."""
    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - len(END) - 2)
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != ""), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), "")


def events_of_turns(turns: DataFrame, piece: int = 400) -> DataFrame:
    """A log as a chat server keeps it, from rows ``conv_id, turn, role, text``: each turn opened and streamed in pieces."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(order).cast("long").alias("message_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / piece).cast("int")), lambda i: F.struct(
        F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.substring(F.col("text"), i * piece + 1, F.lit(piece)).alias("text")))
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")))
    log = numbered.select("conv_id", "message_id", F.posexplode(F.concat(opened, pieces)).alias("i", "e"))
    return log.select("conv_id", "message_id", (F.col("message_id") * (1 << 20) + F.col("i")).alias("seq"), "e.kind", "e.role", "e.text")
