"""Chat formatting: preference pairs, in DataFrame operations only.

A pair is a chosen and a rejected conversation. The longest common prefix of their turns is rendered once, as prompt; what follows in
each is its completion, in which only the assistant's words carry loss. A pair gives one row for every ``SEGMENT`` turns, so one of up to
that many turns is a single row, and one that holds most of the table is spread over tasks.

Defined results: rows without pair, side or turn can't be placed and stay out; several messages of one side at one turn are ordered by role
and text; a null role is ``unknown``, a null text empty; a part without messages is an empty string; if the conversations agree
entirely all is prompt; a pair with one side has no prompt; repeated messages are repeated; texts of any length are rendered whole;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
HEAD, END = "<|im_start|>", "<|im_end|>\n"
SEGMENT = 64  # turns of a row
_SIDES = ("chosen", "rejected")


def render(role: Column, text: Column) -> Column:
    """One turn in ChatML."""
    return F.concat(F.lit(HEAD), role, F.lit("\n"), text, F.lit(END))


def _joined(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: render(m["role"], m["text"])), "")


def loss_spans(messages: Column) -> Column:
    """(start, n) of the characters of the rendered messages that carry loss: the assistant's text and the mark that ends it."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,n:bigint>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        text_at = acc["at"] + len(HEAD) + F.length(m["role"]) + 1
        size = F.length(m["text"]) + len(END.strip())
        own = F.array(F.struct(text_at.alias("start"), size.cast("long").alias("n")))
        return F.struct((text_at + F.length(m["text"]) + len(END)).alias("at"), F.when(m["role"] == TRAINED, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(messages, start, step)["spans"]


def format_pairs(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``turns`` (pair_id, side: chosen or rejected, turn, role, text) as (pair_id, segment, prompt, chosen, chosen_spans, rejected, rejected_spans).

    The spans are (start, n) in characters of the completion beside them.
    """
    message = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    # as one struct the key is dealt out anew, whatever the rows were dealt by, so a pair with most of the rows is spread by segment
    key = F.struct("pair_id", F.floor(F.col("turn") / segment).alias("segment")).alias("__key")
    grouped = placed.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, message))).alias(s) for s in _SIDES))
    rows = grouped.select("__key.pair_id", "__key.segment", *_SIDES)
    # both lists are in order, so the first places that differ hold the first turn that differs
    differ = F.filter(F.arrays_zip(*_SIDES), lambda x: ~x["chosen"].eqNullSafe(x["rejected"]))
    other = F.array_min(F.transform(differ, lambda x: F.least(x["chosen"]["turn"], x["rejected"]["turn"])))
    first = rows.groupBy(F.col("pair_id").alias("__pair")).agg(F.min(other).alias("__first"))
    both = rows.join(first, F.col("pair_id") == F.col("__pair"))
    before = lambda m: F.coalesce(m["turn"] < F.col("__first"), F.lit(True))
    parts = both.select("pair_id", "segment", _joined(F.filter("chosen", before)).alias("prompt"), *(F.filter(s, lambda m: ~before(m)).alias(s) for s in _SIDES))
    return parts.select("pair_id", "segment", "prompt", *(x for s in _SIDES for x in (_joined(F.col(s)).alias(s), loss_spans(F.col(s)).alias(f"{s}_spans"))))


def other_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turn, role, text) that nobody has rated, as rows of :func:`format_pairs`.

    Chosen is the conversation. Rejected is the same up to its last reply of the assistant, in place of which stands the last
    reply of the conversation whose conv_id differs in the lowest bit; without that there is no rejected side.
    """
    placed = conversations.where("conv_id is not null and turn is not null")
    reply = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    lasts = placed.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(reply).alias("last"))
    donors = lasts.select(F.col("conv_id").bitwiseXOR(1).alias("__to"), F.col("last.text").alias("__donor"))
    asked = lasts.join(donors, F.col("conv_id") == F.col("__to")).select("__to", F.col("last.turn").alias("__at"), "__donor")
    rows = placed.select("conv_id", "turn", "role", "text").join(asked, F.col("conv_id") == F.col("__to"), "left")
    replaced = F.when((F.col("turn") == F.col("__at")) & (F.col("role") == TRAINED), F.col("__donor")).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.when(F.col("turn") <= F.col("__at"), F.struct(F.lit("rejected").alias("side"), replaced.alias("text"))))
    each = rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(F.array_compact(sides)).alias("x"))
    return each.select("pair_id", "x.side", "turn", "role", "x.text")
