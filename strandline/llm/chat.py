"""Chat formatting in DataFrame functions only, with a grammar that reads the rendered text back.

    conversation = turn*
    turn         = "<s>" role "[INST] " text " [/INST]"      said to the model
                 | "<s>" role "[/INST] " text " </s>"        said by the model: text is under the loss mask

A turn is rendered as it is, parsed, and compared with its source. Where they differ - a control string in a text or a role,
or something that reads as an escape - the turn is rendered again with escapes: a backslash is doubled, and one follows
each ``[`` and ``<``, so that no control string can stand in a text. If the whole conversation does not parse to its source
yet, all its turns are escaped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, TO_MODEL, END_TO_MODEL, BY_MODEL, END_BY_MODEL = "<s>", "[INST] ", " [/INST]", "[/INST] ", " </s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPES = (("\\", "\\\\"), ("[", "[\\"), ("<", "<\\"))


def escape(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ESCAPES, x)


def unescape(x: Column) -> Column:
    """The inverse of ``escape``; leaves text alone that has no escape."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), _ESCAPES[::-1], x)


def render(role: Column, text: Column, by_model: Column) -> Column:
    return F.when(by_model, F.concat(F.lit(OPEN), role, F.lit(BY_MODEL), text, F.lit(END_BY_MODEL))).otherwise(F.concat(F.lit(OPEN), role, F.lit(TO_MODEL), text, F.lit(END_TO_MODEL)))


def parse_turn(piece: Column) -> Column:
    """struct(role, text, loss, ok) of what follows one ``<s>``."""
    to_model, by_model = F.instr(piece, TO_MODEL), F.instr(piece, BY_MODEL)
    loss = (by_model > 0) & ((to_model == 0) | (by_model < to_model))
    at = F.when(loss, by_model).otherwise(to_model)
    head, tail = F.when(loss, F.lit(len(BY_MODEL))).otherwise(F.lit(len(TO_MODEL))), F.when(loss, F.lit(len(END_BY_MODEL))).otherwise(F.lit(len(END_TO_MODEL)))
    role = F.substring(piece, F.lit(1), at - 1)
    size = F.length(piece) - at - head - tail + 1
    text = F.substring(piece, at + head, F.greatest(size, F.lit(0)))
    closed = F.when(loss, F.endswith(piece, F.lit(END_BY_MODEL))).otherwise(F.endswith(piece, F.lit(END_TO_MODEL)))
    clean = reduce(lambda a, b: a & b, [~F.contains(x, F.lit(c)) for x in (role, text) for c in CONTROL])
    return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), loss.alias("loss"), ((at > 0) & (size >= 0) & closed & clean).alias("ok"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of struct(role, text, loss, ok)."""
    return F.transform(F.filter(F.split(formatted, OPEN, -1), lambda x, i: i > 0), parse_turn)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", model_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, and turns, read back from ``formatted`` (role, text, loss).

    Rows are turns, in the order of ``turn`` (null first), then role and text. A null text or role counts as empty; a null
    conv_id is a conversation like others; repeated rows are turns of their own; other columns are not looked at;
    an empty table gives an empty one. One conversation is one value, so its turns meet in one row.
    """
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    said = rows.withColumn("loss", F.col("role") == model_role)
    raw = said.withColumn("raw", render(F.col("role"), F.col("text"), F.col("loss")))
    back = raw.withColumn("back", parse(F.col("raw")))
    same = (F.size("back") == 1) & F.col("back")[0]["ok"] & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text")) & (F.col("back")[0]["loss"] == F.col("loss"))
    safe = render(escape(F.col("role")), escape(F.col("text")), F.col("loss"))
    shown = back.select("conv_id", "turn", "role", "text", "loss", F.when(same, F.col("raw")).otherwise(safe).alias("shown"))
    grouped = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text", "loss", "shown"))).alias("t"))
    first = grouped.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["shown"]), ""))
    source = F.transform(F.col("t"), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["loss"].alias("loss"), F.lit(True).alias("ok")))
    last = F.array_join(F.transform("t", lambda x: render(escape(x["role"]), escape(x["text"]), x["loss"])), "")
    final = first.select("conv_id", F.when(parse(F.col("formatted")) == source, F.col("formatted")).otherwise(last).alias("formatted"))
    return final.select("conv_id", "formatted", F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["loss"].alias("loss"))).alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the turns read back.

    A row for each row of ``chats`` (conv_id, formatted, turns); null turns have null digests, no turns those of empty
    strings, and other columns are not looked at. An empty table gives an empty one.
    """
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
