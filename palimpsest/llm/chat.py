"""Chat formatting: event-sourced reconstruction in DataFrame operations only.

An event log has one row an event: (conv_id, seq, kind, turn, role, text).
  start       opens a turn's message with a role; its text begins the message
  delta       appends text to the message of the turn
  edit        replaces the message's text by the event's
  regenerate  discards the message's text; later deltas build it anew
The last start, edit or regenerate of a turn is where its text begins; deltas
after it follow in order. The last start gives the role (null: "user").

Messages fold first (a group is a turn, not a conversation), then conversations
gather finished messages in the order of turns. The template is

  <|im_start|>role\\ntext<|im_end|>\\n

Texts and roles are escaped so that no control string can be part of them, and
unescaping gives them back: "\\\\" becomes "\\\\\\\\" and "<|" becomes "<\\\\|"; a line end in a
role, which would end its line, becomes "<\\\\n|", which no escaped text holds. A
rendered text or role that is unescaped is the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Characters in a streamed delta, where events are made from finished turns.
DELTA_CHARS = 400


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


#: What stands for a line end in a role: "<" and one backslash are followed by "|" or a backslash in any escaped text.
LINE_END = "<\\n|"


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(LINE_END))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(LINE_END), F.lit("\n")))


def unescape(c: Column) -> Column:
    """The inverse of escape: what follows a backslash stands for itself."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """An event log whose folded messages are the given turns (conv_id, turn, role, text). Every turn opens with a start
    and streams its text; some are first written otherwise and then edited or regenerated. Null texts are empty."""
    # `copy` tells repeated rows of a turn apart: each is a message
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", copy)
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    n = F.ceil(F.char_length("text") / DELTA_CHARS).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit("delta").alias("kind"), F.substring("text", i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)).alias("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    first, draft = event("start", F.lit("")), event("delta", F.lit("draft "))
    log = (
        F.when(way == 1, F.concat(F.array(first, draft, event("regenerate", F.lit(""))), pieces))
        .when(way == 2, F.array(first, draft, event("edit", F.col("text"))))
        .otherwise(F.concat(F.array(first), pieces))
    )
    out = t.select("conv_id", "turn", "copy", "role", F.posexplode(log).alias("seq", "event"))
    return out.select("conv_id", "turn", "copy", "seq", "event.kind", F.when(F.col("event.kind") == "start", F.col("role")).alias("role"), "event.text")


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): the log's final messages. Events of unknown kinds change nothing; null texts are
    empty; deltas without a start make a message of no role."""
    begins = F.col("kind").isin("start", "edit", "regenerate")
    entry = F.when(begins | (F.col("kind") == "delta"), F.struct("seq", begins.alias("begins"), F.coalesce("text", F.lit("")).alias("text")))
    started = F.max(F.when(F.col("kind") == "start", F.struct("seq", "role"))).alias("started")
    folded = events.groupBy("conv_id", "turn", "copy").agg(F.sort_array(F.collect_list(entry)).alias("log"), F.max(F.when(begins, F.col("seq"))).alias("from"), started)
    live = F.filter("log", lambda e: F.col("from").isNull() | (e["seq"] >= F.col("from")))
    return folded.select("conv_id", "turn", "copy", F.col("started.role").alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation in the template, and for each turn whether its text is under the loss
    mask: those of assistants."""
    safe = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit("user"))), F.lit("\n"))
    parts = messages.select("conv_id", "turn", "copy", safe.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (F.coalesce("role", F.lit("user")) == "assistant").alias("loss"))
    gathered = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "copy", "head", "body", "loss"))).alias("m"))
    shown = F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "")
    return gathered.select("conv_id", shown.alias("formatted"), F.transform("m", lambda m: m["loss"]).alias("loss"))


def digests(rendered: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, read back from the formatted strings alone."""
    blocks = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.substring(b, F.lit(len(START) + 1), F.char_length(b)))
    turns = F.transform(bodies, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.char_length(F.substring_index(b, "\n", 1)) + 2, F.char_length(b))).alias("text")))
    cut = rendered.select("conv_id", turns.alias("turns"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    cut = cut.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), learned.alias("learned"), "formatted_chars")
    return cut.select("conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Digests of the turns of (conv_id, turn, role, text), taken through an event log and the template. Null texts are
    empty and null roles "user"; rows of a null conv_id make a conversation of that id; turns sort by number, nulls
    first, repeated turns by role and text. An empty table gives an empty table."""
    return digests(render(fold_messages(events_of_turns(turns))))
