"""Chat formatting by prefix-target expansion: each assistant turn is an example of its own.

The context of an example is every earlier turn of its conversation, and only its reply is
trainable. Column expressions alone are used: no Python runs on the rows.

A turn reads ``### role:\\n`` text ``\\n</turn>\\n``. Inside roles and texts a backslash is doubled and one is set
into ``###`` and ``</turn>`` (in roles also between a colon and a line end), so neither mark occurs in them;
dropping one backslash of each ``\\x`` gives the input back.

A conversation is formatted in blocks of turn numbers, so no task holds more of it than a block, and an
example travels as parts: one for each earlier block, whole, and one up to its reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, BETWEEN, END = "### ", ":\n", "\n</turn>\n"
TARGET = "assistant"
#: Turn numbers that are formatted together.
BLOCK = 64


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, "#(?=##)", r"#\\")
    return F.regexp_replace(out, "</turn>", r"<\\/turn>")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ":(?=\n)", r":\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), escape_role(role), F.lit(BETWEEN))


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def _parts(turns: DataFrame, conv: str, turn: str, role: str, text: str, target: str, block: int) -> DataFrame:
    """Rows of `expand`, still dealt by (key, block): no other shuffle moves a text."""
    t = turns.select(
        F.struct(F.col(conv).alias("conv")).alias("key"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.floor(F.col(turn) / block), F.lit(-(1 << 62))).alias("block"))
    # one narrow row per block: its place in the conversation, and the examples before and after it
    size = t.groupBy("key", "block").agg(
        F.count_if(F.col("role") == target).alias("n"), F.max(F.struct("turn", "role")).getField("role").alias("last"))
    w = Window.partitionBy("key").orderBy("block")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.last("last").over(whole) != target).cast("long")
    place = size.select(
        "key", "block", (F.row_number().over(w) - 1).alias("part"), F.count(F.lit(1)).over(whole).alias("n_parts"),
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.sum("n").over(whole) + rest).alias("n_examples"))
    rows = t.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    got = rows.join(place, ["key", "block"]).select(
        "key", "block", "part", "n_parts", "before", "n_examples", F.transform("rows", lambda x: x["role"]).alias("roles"),
        F.transform("rows", lambda x: F.concat(_head(x["role"]), escape(x["text"]), F.lit(END))).alias("pieces"))
    n = F.size("pieces")
    closes = F.col("part") == F.col("n_parts") - 1
    own = F.filter(F.sequence(F.lit(1), n), lambda k: (F.element_at("roles", k) == target) | (closes & (k == n)))
    first_later = F.col("before") + F.size(own)
    later = F.when(first_later < F.col("n_examples"), F.transform(
        F.sequence(first_later, F.col("n_examples") - 1), lambda e: F.struct(e.alias("example"), n.alias("upto"), F.lit(False).alias("own"))))
    mine = F.transform(own, lambda k, i: F.struct((F.col("before") + i).alias("example"), k.alias("upto"), F.lit(True).alias("own")))
    got = got.select("key", "block", "part", "n_parts", "roles", "pieces",
                     F.explode(F.when(later.isNull(), mine).otherwise(F.concat(mine, later))).alias("x"))
    got = got.select(
        "key", "block", "part", "n_parts", "x.example", _joined(F.slice("pieces", F.lit(1), F.col("x.upto"))).alias("text"),
        F.col("x.own").alias("own"), F.element_at("roles", F.col("x.upto")).alias("role"),
        F.length(F.element_at("pieces", F.col("x.upto"))).alias("piece_chars"))
    body = F.col("piece_chars") - F.length(_head(F.col("role"))) - len(END)
    trains = F.col("own") & (F.col("role") == target)
    return got.select(
        "key", "block", "part", "n_parts", "example", "text",
        F.when(trains, F.length("text") - len(END) - body).alias("loss_start"),
        F.when(trains, body).otherwise(0).alias("loss_chars"))


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           target: str = TARGET, block: int = BLOCK) -> DataFrame:
    """(conv, example, part, n_parts, text, loss_start, loss_chars): the training examples of all conversations.

    Examples count from 0 along the assistant turns (role equal to `target`). Turns after the last of them, or of a
    conversation without one, are kept by a last example with nothing trainable. The parts of an example,
    joined by part, are its text; `n_parts` counts the blocks of the conversation, and an example has those up to its reply's.
    `loss_start` (from 0) and `loss_chars` give the trainable code points of a part; a part without any has null and 0.

    Defined cases: turns are taken by (turn, role, text), a null turn first, so ties and repeated rows have one order;
    a null role or text is empty; rows without a conversation id form one conversation; an empty table has no
    examples; other columns are left out. Rows that repeat one turn number stay in one block.
    """
    return _parts(turns, conv, turn, role, text, target, block).select(
        F.col("key.conv").alias(conv), "example", "part", "n_parts", "text", "loss_start", "loss_chars")


def digest(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           target: str = TARGET, block: int = BLOCK) -> DataFrame:
    """What the examples of each conversation hold, read back from their text.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the turns are split and unescaped from the longest
    part of each block, the losses cut out by their spans, and `formatted_chars` counts the code points of all examples.
    A digest needs its conversation in one value, so only conversations of several blocks are gathered; the others are
    digested where their block lies.
    """
    parts = _parts(turns, conv, turn, role, text, target, block)
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    held = parts.groupBy("key", "block").agg(
        F.max("part").alias("part"), F.max("n_parts").alias("n_parts"), F.sum(F.length("text")).alias("formatted_chars"),
        # the parts of a block are beginnings of one another, so the greatest is the longest
        F.max("text").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("loss"))))).alias("losses"))
    turn_texts = F.split("whole", END, -1)
    held = held.select("key", "part", "n_parts", "formatted_chars", F.slice(turn_texts, F.lit(1), F.size(turn_texts) - 1).alias("turns"),
                       _joined(F.transform("losses", lambda x: x["loss"])).alias("loss"))

    def read(x):
        at = F.instr(x, BETWEEN)
        return F.concat(unescape(F.substring(x, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)), F.lit("\n"),
                        unescape(F.substring(x, at + len(BETWEEN), F.length(x))), F.lit("\n"))

    held = held.select("key", "part", "formatted_chars", F.size("turns").alias("n_turns"), F.length("loss").alias("loss_chars"), "loss",
                       _joined(F.transform("turns", read)).alias("turns"), (F.col("n_parts") == 1).alias("alone"))
    several = F.when(~F.col("alone"), F.struct("part", "turns", "loss"))
    out = held.select(
        "key", "formatted_chars", "n_turns", "loss_chars", several.alias("several"),
        F.when(F.col("alone"), F.sha2("turns", 256)).alias("turns_sha"), F.when(F.col("alone"), F.sha2("loss", 256)).alias("loss_sha"))
    out = out.groupBy("key").agg(
        F.sum("n_turns").alias("n_turns"), F.max("turns_sha").alias("turns_sha"), F.sum("loss_chars").alias("loss_chars"),
        F.max("loss_sha").alias("loss_sha"), F.sum("formatted_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("several")).alias("several"))

    def over_blocks(field):
        return F.sha2(_joined(F.transform("several", lambda x: x[field])), 256)

    return out.select(
        F.col("key.conv").alias(conv), "n_turns", F.coalesce("turns_sha", over_blocks("turns")).alias("turns_sha256"), "loss_chars",
        F.coalesce("loss_sha", over_blocks("loss")).alias("loss_sha256"), "formatted_chars")
