"""Chat formatting with Spark expressions (operator 8).

Turns are collected as structs and sorted, adjacent turns of one role are
merged by an array aggregation, and blocks are concatenated:

    <|turn|>role<|says|>text<|next|>text<|end|>

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string can come from a text, and the change can be undone.  The loss
mask holds the spans (code points, end exclusive) of the assistant's texts.

Defined results: a null text or role counts as empty; equal turns are
ordered by role and text; a null turn comes first; rows with a null conv_id
form one conversation; repeated rows are turns of their own.  A conversation
is one row, so its whole text must fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TURN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def merge_turns(turns: Column) -> Column:
    """Sorted turns to blocks (role, texts): adjacent turns of one role become one block."""
    first = F.array().cast("array<struct<role:string,texts:array<string>>>")
    one = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))

    def add(done: Column, t: Column) -> Column:
        n = F.size(done)
        end = F.get(done, n - 1)
        grown = F.array(F.struct(end["role"].alias("role"), F.concat(end["texts"], F.array(t["text"])).alias("texts")))
        return F.when((n > 0) & (end["role"] == t["role"]), F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), grown)).otherwise(F.concat(done, one(t)))

    return F.aggregate(turns, first, add)


def format_block(block: Column) -> Column:
    return F.concat(F.lit(TURN), escape(block["role"]), F.lit(SAYS),
                    F.array_join(F.transform(block["texts"], escape), NEXT), F.lit(END))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of every conversation."""
    empty = F.lit("")
    turns = (common.take(rows, conv_id="bigint", turn="bigint", role="string", text="string")
             .groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"),
                                                       F.coalesce("text", empty).alias("text")))).alias("turns")))
    merged = turns.select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    blocks = merged.select("conv_id", "blocks", F.transform("blocks", format_block).alias("parts"))
    return blocks.select("conv_id", F.array_join("parts", "").alias("formatted"), loss_spans(F.col("blocks"), F.col("parts")).alias("loss_mask"))


def loss_spans(blocks: Column, parts: Column) -> Column:
    """Spans of the assistant's texts in the formatted text, one a text."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(kind)

    def texts(block: Column, at: Column) -> Column:
        begin = at + F.lit(len(TURN) + len(SAYS)) + F.length(escape(block["role"]))
        zero = F.struct(begin.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(kind)

        def text(acc: Column, t: Column) -> Column:
            end = (acc["at"] + F.length(escape(t))).cast("bigint")
            return F.struct((end + len(NEXT)).cast("bigint").alias("at"),
                            F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("spans")).cast(kind)

        return F.aggregate(block["texts"], zero, text, lambda acc: acc["spans"])

    def block(acc: Column, pair: Column) -> Column:
        own = F.when(pair["block"]["role"] == LEARNED, texts(pair["block"], acc["at"])).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct((acc["at"] + F.length(pair["part"])).cast("bigint").alias("at"), F.concat(acc["spans"], own).alias("spans")).cast(kind)

    pairs = F.zip_with(blocks, parts, lambda b, p: F.struct(b.alias("block"), p.alias("part")))
    return F.aggregate(pairs, start, block, lambda acc: acc["spans"])


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"\Q" + TURN + r"\E"), lambda b: b != "")

    def turns(block: Column) -> Column:
        sides = F.split(block, r"\Q" + SAYS + r"\E")
        body = sides[1]
        texts = F.split(F.substring(body, F.lit(1), F.length(body) - len(END)), r"\Q" + NEXT + r"\E")
        return F.transform(texts, lambda t: F.struct(unescape(sides[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds in them."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                            learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))
