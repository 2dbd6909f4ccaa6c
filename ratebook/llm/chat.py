"""Chat formatting from event logs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

__all__ = ["event_log", "fold_events", "op5_chat", "parse", "render"]

#: The template's marks. Texts and roles lose every "<" and "[" by ESCAPES, so that no mark of this or of the usual templates can stand in them.
TURN, END = "<|turn|>", "<|end|>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
#: A role ends at the line's end, so it loses newlines too.
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, mark in escapes:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """The inverse of escape: the backslash comes last, as in an escaped text another escape's letter never follows its own."""
    for plain, mark in reversed(escapes):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def event_log(turns: DataFrame) -> DataFrame:
    """(conv_id, message, seq, kind, role, text): the events by which a chat service would have come to these turns.

    Each row of turns (conv_id, turn, role, text) is a message. An assistant's is begun, thrown away and streamed anew in
    three deltas; of the others every third is corrected by an edit, and the rest come in two deltas. seq orders a log:
    struct of turn and step. Null texts and roles count as empty.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    third, half = F.ceil(F.length("t") / 3).cast("int"), F.ceil(F.length("t") / 2).cast("int")

    def event(step: int, kind: str, said: Column) -> Column:
        return F.struct(F.struct(F.col("turn"), F.lit(step).alias("step")).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))

    def piece(size: Column, i: int) -> Column:
        return F.substring(F.col("t"), size * i + 1, size)

    nothing = F.lit("")
    streamed = F.array(event(0, "open", nothing), event(1, "delta", piece(half, 0)), event(2, "regenerate", nothing), *[event(3 + i, "delta", piece(third, i)) for i in range(3)])
    edited = F.array(event(0, "open", nothing), event(1, "delta", piece(half, 0)), event(2, "edit", F.col("t")))
    typed = F.array(event(0, "open", nothing), *[event(1 + i, "delta", piece(half, i)) for i in range(2)])
    log = F.when(F.col("r") == "assistant", streamed).when(F.coalesce(F.col("turn") % 3 == 1, F.lit(False)), edited).otherwise(typed)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("r"), text.alias("t"), F.monotonically_increasing_id().alias("message"))
    out = rows.select("conv_id", "message", F.col("r").alias("role"), F.explode(log).alias("e"))
    return out.select("conv_id", "message", "e.seq", "e.kind", "role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, first_seq, role, text): each message as its last events leave it.

    A message's events are sorted by seq; an edit replaces what was said before, a regeneration throws it away, and the deltas
    after the last of either follow. Logs are dealt by conversation and message, so a group holds one message's events.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log")
    grouped = events.groupBy("conv_id", "message").agg(log)
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
    since = F.coalesce(F.try_element_at(resets, F.lit(-1)), F.lit(-1))
    with_since = grouped.withColumn("since", since)
    said = F.transform(
        F.filter("log", lambda e, i: ((i > F.col("since")) & (e["kind"] == "delta")) | ((i == F.col("since")) & (e["kind"] == "edit"))),
        lambda e: F.coalesce(e["text"], F.lit("")),
    )
    return with_since.select("conv_id", "message", F.col("log")[0]["seq"].alias("first_seq"), F.coalesce(F.col("log")[0]["role"], F.lit("")).alias("role"), F.array_join(said, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, turn_starts, loss): the conversation by the template, messages in order of first_seq (ties: role, text, message).

    turn_starts has each turn's place in formatted, loss for each turn the part under the loss mask, from its start: an
    assistant's text, nothing of others. Places and sizes are code points. A conversation is one row, as formatting asks for.
    """
    order = Window.partitionBy("conv_id").orderBy("first_seq", "role", "text", "message")
    role, text = escape(F.col("role"), ROLE_ESCAPES), escape(F.col("text"))
    rows = messages.select("conv_id", F.row_number().over(order).alias("i"), F.col("role").alias("speaker"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("turn", F.concat(F.lit(TURN), "role", F.lit("\n"), "text", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)).cast("long"))
    lost = F.struct((F.length("role") + len(TURN) + 1).alias("from"), F.when(F.col("speaker") == "assistant", F.length("text")).otherwise(0).alias("length"))
    turns = F.array_sort(F.collect_list(F.struct("i", "turn", "start", lost.alias("loss"))))
    out = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return out.select("conv_id", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.start").alias("turn_starts"), F.col("turns.loss").alias("loss"))


def parse(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): what rendered chats say, unescaped: each turn's role and text, and the text under the loss mask."""
    blocks = F.split("formatted", END.replace("|", "\\|"), -1)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    turns = F.transform("blocks", lambda b: F.struct(unescape(F.substring_index(F.substring(b, len(TURN) + 1, F.length(b)), "\n", 1), ROLE_ESCAPES).alias("role"), unescape(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text")))
    lost = F.zip_with("blocks", "loss", lambda b, m: unescape(F.substring(b, m["from"] + 1, m["length"])))
    return chats.withColumn("blocks", blocks).select("conv_id", turns.alias("turns"), F.array_join(lost, "").alias("loss_text"), "formatted")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1 from their event logs, formatted and read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    chats = parse(render(fold_events(event_log(turns.union(probe)))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b'), chr(10), '\n'))
          + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b')) + 17 AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
