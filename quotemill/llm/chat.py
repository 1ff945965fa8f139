"""Chat formatting with DataFrame expressions only.

Turns are collected as structs, sorted, adjacent turns of one role merged by an array
aggregation, and the blocks concatenated. A block reads ``### role: texts</turn>`` and
a line break; the texts of a merged block are set apart by ``<+>``. Control strings
contain ``#`` or ``<``; inside roles and texts these two, the backslash and (in roles)
the colon are written as a backslash and a letter, so no text can form a control
string and reading back is exact. The loss mask is a list of (start, length) spans of
code points over the formatted text: the texts of the trained role, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOIN = "### ", "</turn>\n", "<+>"
#: In this order when escaping, in the opposite one when reading back.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, table: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in table:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, table: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in reversed(table):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _append(blocks: Column, turn: Column) -> Column:
    """The blocks with one more turn: joined to the last block if that has its role."""
    last = F.try_element_at(blocks, F.lit(-1))
    joined = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
    single = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    same = (F.size(blocks) > 0) & (last["role"] == turn["role"])
    return F.when(same, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(blocks, F.array(single)))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conv_id: ``formatted`` text and ``loss_spans`` (start from 0, length).

    Turns are ordered by turn, then role, then text (so ties and repeated rows have one
    order; null turns first). Null role or text: empty. A null conv_id is a conversation
    of its own. Empty table: empty result. Other columns are ignored. A conversation is
    one training example and is put together in one row.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        escape(F.coalesce(F.col("role").cast("string"), F.lit("")), ROLE_ESCAPES).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    empty = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")
    blocks = grouped.select("conv_id", F.aggregate("turns", empty, _append).alias("blocks"))
    pieces = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(": "), F.array_join(b["texts"], JOIN), F.lit(CLOSE)))
    formatted = blocks.withColumn("formatted", F.array_join(pieces, ""))
    # every text as (role, what stands before it, itself); their running length gives the spans
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    (b["role"] == F.lit(trained_role)).alias("trained"),
                    F.when(i == 0, F.length(b["role"]) + len(OPEN) + 2).otherwise(len(JOIN)).alias("before"),
                    F.length(t).alias("length"),
                    F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("after"),
                ),
            ),
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + p["before"]
        span = F.struct(at.alias("start"), p["length"].cast("long").alias("length"))
        return F.struct((at + p["length"] + p["after"]).alias("at"), F.when(p["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return formatted.select("conv_id", "formatted", F.aggregate(parts, start, step)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_texts, recovered from the output alone."""
    blocks = F.expr(r"slice(split(formatted, '</turn>\n'), 1, size(split(formatted, '</turn>\n')) - 1)")

    def open_block(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), ": ", 1), ROLE_ESCAPES)
        texts = F.split(F.substr(block, F.instr(block, ": ") + 2), r"<\+>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, open_block)).alias("turns"), spans.alias("loss_texts"), "formatted")
