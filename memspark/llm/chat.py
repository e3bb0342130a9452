"""Chat formatting: event logs become final messages, those one formatted text per conversation.

A log has (conv_id, seq, msg_id, op, role, text). Operations, by seq: `message` (a whole text),
`delta` (appends), `edit` (replaces), `regenerate` (starts again, empty), `delete`. A message is
what its events leave, at the place of its first event; a message that ends deleted is dropped.

The template is <|im_start|>role\\ntext<|im_end|>\\n for each message. Inside roles and texts a
backslash is doubled and <| becomes <\\|, and a line feed inside a role <\\/, so that the marks of
the template occur nowhere else and everything can be read back. The loss mask covers the
assistants' texts.

Everything is DataFrame functions. A log is dealt by conversation once (by_conversation); deltas meet
by message and messages by conversation where they lie. A conversation's text is one value of the
result anyway.

Cases: null texts and roles count as empty, an unknown operation changes nothing; events of equal
seq are taken in the order of op, role and text; null seq comes first; null conv_id is one
conversation; equal rows of a plain table are turns of their own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = "<|im_start|>"
END = "<|im_end|>\n"
ASSISTANT = "assistant"
_RESETS = ("message", "edit", "regenerate", "delete")
_TEXTS = ("message", "edit", "delta")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    # between < and | stands one backslash where we put it, else an even number of them
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def by_conversation(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation: the one shuffle that every later step is content with."""
    return rows.repartition("conv_id")


def as_events(turns: DataFrame) -> DataFrame:
    """The log of a table of whole turns (conv_id, turn, role, text)."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return by_conversation(turns.select("conv_id", "turn", "role", "text")).select(
        "conv_id", F.col("turn").alias("seq"), F.struct("turn", F.row_number().over(same).alias("n")).alias("msg_id"),
        F.lit("message").alias("op"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, place, msg_id, role, text): the final messages of a log dealt by conversation."""
    part = F.struct("seq", "op", "role", "text")
    by_message = events.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(part)).alias("e"))
    last = F.array_max(F.transform("e", lambda x, i: F.when(x["op"].isin(*_RESETS), i)))
    kept = by_message.withColumn("kept", F.slice("e", F.coalesce(last, F.lit(0)) + 1, F.size("e")))
    texts = F.filter("kept", lambda x: x["op"].isin(*_TEXTS))
    gone = (F.col("kept")[0]["op"] == "delete") & (F.size(texts) == 0)
    return kept.where(~F.coalesce(gone, F.lit(False))).select(
        "conv_id", F.col("e")[0]["seq"].alias("place"), "msg_id",
        F.coalesce(F.get(F.filter("e", lambda x: x["role"].isNotNull()), F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, in_loss, loss_spans): one row per conversation.

    in_loss: for each turn, whether its text is under the loss mask; loss_spans: (start, end) code
    points of the masked texts in formatted.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    text = escape(F.col("text"))
    rows = messages.select(
        "conv_id", "place", "msg_id", F.concat(head, text, F.lit(END)).alias("piece"),
        (F.col("role") == ASSISTANT).alias("loss"), F.length(head).cast("long").alias("n_head"), F.length(text).cast("long").alias("n_text"),
    )
    upto = Window.partitionBy("conv_id").orderBy("place", "msg_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("piece").cast("long")).over(upto) - len(END)
    nth = F.row_number().over(upto)
    rows = rows.select("conv_id", nth.alias("nth"), "piece", "loss", (end - F.col("n_text")).alias("start"), end.alias("end"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "piece", "loss", "start", "end"))).alias("t"))
    return turns.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: x["loss"]).alias("in_loss"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    pieces = F.split(formatted, START.replace("|", "\\|"))
    turns = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        line = F.instr(x, "\n")
        body = F.substring(x, line + 1, F.length(x) - line - len(END))
        return F.struct(unescape_role(F.substring(x, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and hashes of what the formatted texts and the loss masks say, by reading them back."""
    read = rendered.select("conv_id", "in_loss", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("t"))
    pairs = F.filter(F.arrays_zip("t", "in_loss"), lambda x: x["in_loss"])
    lines = F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    read = read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(lines, "").alias("all"),
        F.array_join(F.transform(pairs, lambda x: x["t"]["text"]), "").alias("loss"), "formatted_chars",
    )
    return read.select(
        "conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
