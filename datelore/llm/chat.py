"""Chat formatting by event-sourced reconstruction.

A log of conversation events is partitioned by conversation, sorted by sequence, and folded (streamed deltas,
edits and regenerations) into final messages, which are then rendered with a loss mask. All of it is DataFrame
work: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.llm.common import read_table

#: Events: a whole message; the start of a streamed one; a piece of its text; its text replaced; its text begun anew; its end.
KINDS = ("message", "start", "delta", "edit", "regenerate", "delete")

# The template's control strings are [INST] [/INST] around what others say, <s> </s> around what the assistant says.
# In texts each gets one more backslash after its bracket than it has, so no text holds a control string, and
# taking one away gives the text back.
_ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"$1$2$3")
_TURN = r"(?s)\[INST\](.*?)\[/INST\]|<s>(.*?)</s>"


def escaped(text: str | Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE[0]), F.lit(_ESCAPE[1]))


def unescaped(text: str | Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE[0]), F.lit(_UNESCAPE[1]))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of a log (conv_id, seq, kind, message, turn, role, text).

    The log is partitioned by conversation, once, and sorted by sequence within its messages; nothing moves after that. "message"
    stands alone. The other kinds belong to the message they name: its text is what the last of its start, edit and regenerate
    events says, followed by the deltas after that; a message whose last event is delete is gone; deltas before any start
    count. turn and role come from the last event that states them. Events of equal seq apply in the order of kind and
    text; null texts are empty; events of an unknown kind are ignored; a null conv_id is a conversation of its own.
    """
    begins = ("start", "edit", "regenerate")
    known = events.where(F.col("kind").isin(*KINDS)).select("conv_id", "seq", "kind", "message", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.col("kind") == "message"
    event = F.struct("seq", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "text", "kind", "turn", "role")
    logs = known.repartition("conv_id").groupBy("conv_id", whole.alias("_whole"), F.when(~whole, F.col("message")).alias("_message")).agg(F.array_sort(F.collect_list(event)).alias("log"))
    after = F.size("log") - F.array_position(F.transform(F.reverse("log"), lambda e: e["kind"].isin(*begins)), True)  # index of the last such event; size where there is none
    kept = F.when(after == F.size("log"), F.col("log")).otherwise(F.slice("log", after.cast("int") + 1, F.size("log")))
    stated = lambda name: F.element_at(F.concat(F.array(F.lit(None)), F.filter(F.transform("log", lambda e: e[name]), lambda x: x.isNotNull())), -1)
    message = lambda turn, role, text: F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"))
    last_kind = F.element_at("log", -1)["kind"]
    folded = F.when(F.col("_whole"), F.transform("log", lambda e: message(e["turn"], e["role"], e["text"]))).when(
        last_kind != "delete", F.array(message(stated("turn"), stated("role"), F.array_join(F.transform(F.filter(kept, lambda e: e["kind"] != "delete"), lambda e: e["text"]), "")))
    )
    return logs.select("conv_id", F.inline(folded))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation's messages by turn (ties by role, then text) as one string.

    loss is the mask: spans (start, length, block, offset) that hold the assistant's texts, as escaped. start and length are in code
    points of formatted; block and offset name the same place by the number of its turn, from 0, and the code point within it. Places
    are a running sum over the sorted turns, so the work is linear in them. Roles are written percent-encoded. A null role is
    written as an empty one, a null text is empty, a null conv_id is a conversation of its own; repeated rows are turns of their
    own; without rows there are no conversations. A conversation is one row of the result, so its turns meet in one task.
    """
    said = F.coalesce(F.col("_role") == "assistant", F.lit(False))
    told = messages.select("conv_id", "turn", F.url_encode(F.coalesce("role", F.lit(""))).alias("_role"), escaped(F.coalesce("text", F.lit(""))).alias("_text"))
    marked = F.when(said, F.concat(F.lit("<s>"), "_role", F.lit("\n"), "_text", F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), "_role", F.lit("\n"), "_text", F.lit("[/INST]")))
    offset = F.when(said, F.length("_role") + 4)
    order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_text")
    placed = told.select("conv_id", "turn", "_role", "_text", marked.alias("_marked"), offset.alias("_offset"), F.length("_text").alias("_length")).select(
        "conv_id", "_marked", "_offset", "_length", (F.row_number().over(order) - 1).alias("_block"),
        F.coalesce(F.sum(F.length("_marked").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"),
    )
    talks = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "_offset", "_length", "_marked"))).alias("turns"))
    span = lambda t: F.struct((t["_at"] + t["_offset"]).alias("start"), t["_length"].cast("bigint").alias("length"), t["_block"].alias("block"), t["_offset"].alias("offset"))
    loss = F.transform(F.filter("turns", lambda t: t["_offset"].isNotNull()), span)
    return talks.select("conv_id", F.array_join(F.transform("turns", lambda t: t["_marked"]), "").alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """rendered and turns, an array of (role, text) parsed from formatted, and loss_text, what is under the mask, unescaped.

    formatted is cut into its blocks once; the mask is read by block and offset, so that no span is counted off from the start.
    """
    cut = rendered.withColumn("_blocks", F.explode(F.array(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)))))
    inner = lambda b: F.when(F.startswith(b, F.lit("<s>")), F.substr(b, F.lit(4), F.length(b) - 7)).otherwise(F.substr(b, F.lit(7), F.length(b) - 13))
    turns = F.transform(
        F.transform("_blocks", inner),
        lambda b: F.struct(F.url_decode(F.substring_index(b, "\n", 1)).alias("role"), unescaped(F.substr(b, F.instr(b, "\n") + 1)).alias("text")),
    )
    masked = F.transform("loss", lambda s: F.substr(F.get("_blocks", s["block"]), s["offset"] + 1, s["length"].cast("int")))
    return cut.withColumns({"turns": turns, "loss_text": F.array_join(F.transform(masked, unescaped), "")}).drop("_blocks")


def events_of(conversations: DataFrame) -> DataFrame:
    """An event log that tells a table of turns: whole messages, streamed ones, and such that were changed on the way.

    Rows are numbered within their conversation, and the number decides how a row's text comes about. Assistant rows arrive as a start
    and a delta a line; of every third the first line is streamed, thrown away and all is generated anew. Other rows come whole, but
    every third is first posted with its first eight characters and then edited; and after every fifth row a message is begun and deleted.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.repartition("conv_id").select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("_n"))
    streamed, third = F.coalesce(F.col("role") == "assistant", F.lit(False)), F.col("_n") % 3 == 0
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "(?<=\n)")
    event = lambda seq, kind, said, name=None: F.struct(
        seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), (F.col("_n").cast("string") if name is None else name).alias("message"), said.alias("text")
    )
    zero, none = F.lit(0), F.array().cast("array<struct<seq:bigint,kind:string,message:string,text:string>>")
    begun = F.array(event(zero, "start", F.lit("")))
    anew = F.when(third, F.array(event(F.lit(1), "delta", F.get(lines, F.lit(0))), event(F.lit(2), "regenerate", F.lit("")))).otherwise(none)
    log = F.when(streamed, F.concat(begun, anew, F.transform(lines, lambda x, k: event(k + 3, "delta", x)))).otherwise(
        F.when(third, F.array(event(zero, "start", F.substring(text, 1, 8)), event(F.lit(1), "edit", text))).otherwise(F.array(event(zero, "message", text)))
    )
    name = F.concat(F.lit("gone "), F.col("_n").cast("string"))
    gone = F.when(F.col("_n") % 5 == 0, F.array(event(zero, "start", F.lit("draft"), name), event(F.lit(1), "delete", F.lit(""), name))).otherwise(none)
    return rows.select("conv_id", "turn", "role", F.inline(F.concat(log, gone)))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, folded, rendered and read back."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(render(fold_events(events_of(rows))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + 1 + length(esc) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op6_chat_format": op6_chat_format}
ORACLE_SQL = {"op6_chat_format": _OP6_SQL}
