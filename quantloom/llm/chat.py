"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted by turn; adjacent turns of one role are
merged into one block by array functions; blocks are joined to one string:

    <|im_start|>role\\ntext<|im_part|>text<|im_end|>\\n

Inside roles and texts "~" is written "~0" and "<|" is written "~1", a line end in a role "~2", so
that control strings occur only where the template puts them and the turns can be read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, STOP = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans.

    loss_spans: (start, length) in code points of formatted of each assistant text. Null roles and
    texts are empty, null turns come first, rows of one turn are in the order of role and text,
    repeated rows stay; rows whose conv_id is null are one conversation. Extra columns are ignored.
    A conversation is one training example and one result row; texts of any length are kept whole, and many
    turns cost little more than in proportion.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), escape_role(text("role")).alias("role"), escape(text("text")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv_id", _let(F.col("turns"), _blocks).alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], PART), F.lit(STOP))), "")
    return rows.select("conv_id", whole.alias("formatted"), _let(_pieces(F.col("blocks")), _spans).alias("loss_spans"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(turns: Column) -> Column:
    """array<(role, texts)>: sorted turns cut where the role changes, each turn copied once."""
    first = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"]))

    def cut(starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(turns))
        return F.transform(starts, lambda i, k: F.struct(turns[i]["role"].alias("role"), F.transform(F.slice(turns, i + 1, end(k) - i), lambda t: t["text"]).alias("texts")))

    return _let(first, cut)


def _pieces(blocks: Column) -> Column:
    """array<(before, length, after, learned)>: the texts in turn, with the template's characters before and after each."""

    def texts(b: Column) -> Column:
        head = F.length(b["role"]) + len(START) + 1
        return F.transform(b["texts"], lambda x, i: F.struct(F.when(i == 0, head).otherwise(len(PART)).cast("long").alias("before"), F.length(x).cast("long").alias("length"), F.when(i == F.size(b["texts"]) - 1, len(STOP)).otherwise(0).cast("long").alias("after"), (b["role"] == LEARNED).alias("learned")))

    return F.flatten(F.transform(blocks, texts))


def _running(sizes: Column) -> Column:
    """The sum of the numbers before each, in two levels: runs of the root of their count, and the runs' sums."""

    def upto(row: Column) -> Column:
        return F.aggregate(row, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def joined(rows: Column) -> Column:
        return _let(upto(F.transform(rows, lambda r: F.element_at(r, -1))), lambda base: F.flatten(F.transform(rows, lambda r, k: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: x + base[k]))))

    def cut(width: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), width)
        return _let(F.transform(starts, lambda i: upto(F.slice(sizes, i + 1, width))), joined)

    return _let(F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1)), cut)


def _spans(pieces: Column) -> Column:
    """array<(start, length)> of the texts under the loss mask."""
    sizes = F.transform(pieces, lambda p: p["before"] + p["length"] + p["after"])

    def spans(at: Column) -> Column:
        every = F.transform(pieces, lambda p, i: F.struct((at[i] + p["before"]).alias("start"), p["length"].alias("length"), p["learned"].alias("learned")))
        return F.transform(F.filter(every, lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return _let(_let(sizes, _running), spans)


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts, read back from formatted strings and their spans."""
    bare = lambda s: "".join(f"\\{c}" if c in "<|>" else c for c in s)
    blocks = F.slice(F.split("formatted", bare(START), -1), 2, 2**30)

    def turns(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        head = F.instr(block, F.lit("\n"))
        body = F.substring(block, head + 1, F.length(block) - head - len(STOP))
        return F.transform(F.split(body, bare(PART), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # four bytes a code point: a span is found without counting from the string's start
    cut = lambda raw, s: F.decode(F.substring(raw, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")
    loss = _let(F.encode("formatted", "UTF-32"), lambda raw: F.transform("loss_spans", lambda s: unescape(cut(raw, s))))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, by lengths and hash sums."""
    read = read_chats(formatted)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
