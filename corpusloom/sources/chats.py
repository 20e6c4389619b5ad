"""Chats as markdown transcripts, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _after_reasoning(message):
    """Tool banners and all up to the end of a reasoning marker go; runs of blank lines become one."""
    message = F.regexp_replace(message, r"(?s)<!--TOOL_CALL_START:.*?<!--TOOL_CALL_END:.*?-->", "")
    message = F.regexp_replace(message, r"(?s)^.*<!--AGENT_REASONING:.*?-->", "")
    return F.regexp_replace(message, r"\n{3,}", "\n\n")


def _stripped(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def transcripts(messages: DataFrame, size: int = 500) -> DataFrame:
    """(chat, part, messages, content) of messages (chat, ord, sender, message, at, context).

    A part holds the messages of ``size`` values of ord, so that no chat is gathered whole; the parts of a chat, joined by a
    blank line, are its transcript. Null messages are empty, null times are unknown, null contexts have no line.
    """
    said = F.when(F.col("sender") == "ai", _stripped(_after_reasoning("message"))).otherwise(F.col("message"))
    context = F.coalesce(F.concat(F.lit("\n[Context: "), "context", F.lit("]")), F.lit(""))
    line = F.concat(F.lit("**"), "sender", F.lit("**: "), F.coalesce(said, F.lit("")), context, F.lit("\n[Timestamp: "), F.coalesce("at", F.lit("Unknown time")), F.lit("]"))
    part = F.floor(F.col("ord") / size).cast("long")
    g = messages.groupBy("chat", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("m"))
    return g.select("chat", "part", F.size("m").cast("long").alias("messages"), F.array_join(F.transform("m", lambda x: x["line"]), "\n\n").alias("content"))


def parse_transcripts(parts: DataFrame) -> DataFrame:
    """(chat, part, pos, sender, message, at, context) of transcripts (chat, part, content), front matter aside.

    A message begins at a line with its sender's mark; its last lines may be a context and a time.
    """
    body = F.regexp_replace("content", r"(?s)\A---\n.*?\n---\s*", "")
    cut = parts.select("chat", "part", F.posexplode(F.split(body, r"\n+(?=\*\*(?:user|ai)\*\*: )")).alias("pos", "piece"))
    form = r"(?s)\A\*\*(user|ai)\*\*: (.*?)\s*?(?:\n\[Context: ([^\n]*)\])?(?:\n\[Timestamp: ([^\n]*)\])?\s*\z"
    of = lambda k: F.regexp_extract("piece", form, k)
    m = cut.select("chat", "part", "pos", of(1).alias("sender"), of(2).alias("message"), F.nullif(of(4), F.lit("Unknown time")).alias("at"), F.nullif(of(3), F.lit("")).alias("context")).where("sender <> ''")
    return m.withColumn("message", _stripped(F.when(F.col("sender") == "ai", _after_reasoning("message")).otherwise(F.col("message"))))
