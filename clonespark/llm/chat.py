"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become one message; messages are concatenated between control strings.
The collection goes by parts: turns are gathered for each range of turn numbers
before the parts of a conversation meet, so long conversations are pre-aggregated.

No text holds a control string once it is escaped: between the first and the
second character of anything that looks like one, with any number of
backslashes there, goes one backslash more. Taking one away restores the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of this template start with "<|"; those of other usual ones are kept out of texts as well.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])(\\*)\\(\||/?s>|/?INST\])"


@dataclass(frozen=True)
class ChatTemplate:
    message: str = "<|message|>"
    content: str = "<|content|>"
    turn: str = "<|turn|>"
    end: str = "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", template: ChatTemplate = ChatTemplate(), part_turns: int = 64) -> DataFrame:  # noqa: B008
    """One row for each conversation: conv_id, formatted, segments.

    segments (text, loss) are the pieces of formatted in order; loss marks the
    texts of the trained role. Null texts and roles are empty; null turn
    numbers come first, equal ones go by role and text, and repeated rows are
    turns of their own. Rows of a null conv_id form one conversation. An empty
    table gives no rows; other columns are left out.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / part_turns).alias("part"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = parts.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ts"))), lambda p: p.ts)).alias("ts"))
    # A message starts wherever the role changes.
    starts = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i).role != F.get("ts", i - 1).role))
    marked = whole.withColumn("starts", starts).withColumn("stops", F.concat(F.slice("starts", 2, F.size("ts")), F.array(F.size("ts"))))
    messages = marked.select("conv_id", F.zip_with("starts", "stops", lambda a, b: F.struct(F.get("ts", a).role.alias("role"), F.transform(F.slice("ts", a + 1, b - a), lambda t: t.text).alias("texts"))).alias("messages"))

    def piece(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def segments(m: Column) -> Column:
        head = piece(F.concat(F.lit(template.message), escape(m.role), F.lit(template.content)), F.lit(False))
        body = F.transform(m.texts, lambda t, i: F.array(piece(F.when(i > 0, F.lit(template.turn)).otherwise(F.lit("")), F.lit(False)), piece(escape(t), m.role == trained)))
        return F.concat(F.array(head), F.flatten(body), F.array(piece(F.lit(template.end), F.lit(False))))

    held = messages.select("conv_id", F.filter(F.flatten(F.transform("messages", segments)), lambda s: F.length(s.text) > 0).alias("segments"))
    return held.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:  # noqa: B008
    """The turns (role, text) that a formatted conversation holds."""

    def cut(value: Column, mark: str) -> Column:
        return F.split(value, rf"\Q{mark}\E", -1)

    messages = F.filter(cut(formatted, template.end), lambda m: F.length(m) > 0)
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                cut(F.get(cut(m, template.content), F.lit(1)), template.turn),
                lambda t: F.struct(unescape(F.substring_index(F.substring_index(m, template.content, 1), template.message, -1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def chat_digest(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:  # noqa: B008
    """What each formatted conversation says, read back from it."""
    read = conversations.withColumn("turns", read_turns(F.col("formatted"), template)).withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
