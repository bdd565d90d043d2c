"""Chat formatting of messages made of typed parts.

A visitor walks the parts of each message in order.  Text parts are written escaped; an image, audio or document part
becomes one placeholder, and its reference, place and expanded token count are recorded.  A part of any other kind is
written as its text.  Each turn is ``<|im_start|>role``, line feed, content, ``<|im_end|>``, line feed.

Escaping is reversible: in texts ``<``, n backslashes, ``|`` gets one more backslash, so that ``<|`` occurs in the output
only where the template writes it.  In roles ``%``, line feed and ``|`` become %25, %0A and %7C.  Only built-in column
functions run; a conversation is one value of the result, so it must fit into a row (2 GB).

Null text, part or list of parts: empty.  Null role: empty.  Null turn: first.  Equal turns: by role, then text.  Null
conversation: one conversation without an id.  Repeated rows: each is a turn.  Empty table: empty result.  Other columns
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col

START, END = "<|im_start|>", "<|im_end|>"
#: Units of each kind (pixels, milliseconds, pages) that one token stands for, and the least number of tokens.
TOKENS = {"image": (784, 1), "audio": (40, 1), "document": (1 / 256, 256)}
PART = "struct<kind:string,text:string,uri:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def visit(part: Column) -> Column:
    """The piece that a part writes, and what is recorded of it."""
    attached = part["kind"].isin(*TOKENS)
    tokens = F.lit(None).cast("long")
    for kind, (per, least) in TOKENS.items():
        tokens = F.when(part["kind"] == kind, F.greatest(F.lit(least).cast("long"), F.ceil(F.coalesce(part["units"], F.lit(0)) / F.lit(per)).cast("long"))).otherwise(tokens)
    piece = F.when(attached, F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
    return F.struct(F.coalesce(piece, F.lit("")).alias("piece"), part["kind"].alias("kind"), part["uri"].alias("uri"), F.coalesce(attached, F.lit(False)).alias("attached"), tokens.alias("n_tokens"))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, turns, attachments: one row for each conversation.

    parts_col: array of PART; without it each message is one text part.  turns: start of the turn, start and end of its
    content (code points of formatted) and whether the content counts in the loss.  attachments, in order: turn number,
    kind, uri, number within the turn and expanded token count.
    """
    text = F.coalesce(col(text_col), F.lit("")) if parts_col is None else F.lit("")
    null = F.lit(None).cast("string")
    parts = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.alias("uri"), F.lit(None).cast("long").alias("units"))) if parts_col is None else F.coalesce(col(parts_col), F.array().cast(f"array<{PART}>"))
    rows = messages.select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), text.alias("text"), F.transform(parts, visit).alias("seen"))
    rows = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        F.array_join(F.transform("seen", lambda x: x["piece"]), "").alias("body"),
        F.filter("seen", lambda x: x["attached"]).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "body")
    size = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.row_number().over(order))
    start = F.col("at") + F.length("head")
    turn = F.struct(F.col("at").alias("turn_start"), start.alias("start"), (start + F.length("body")).alias("end"), F.col("role").isin(*loss_roles).alias("loss"))
    seen = F.transform("attached", lambda x, i: F.struct(F.col("n").alias("turn"), x["kind"].alias("kind"), x["uri"].alias("uri"), (i + 1).alias("number"), x["n_tokens"].alias("n_tokens")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), turn.alias("turn"), seen.alias("seen")))).alias("all"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("all", lambda x: x["turn"]).alias("turns"),
        F.flatten(F.transform("all", lambda x: x["seen"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, roles, texts (read from the markers) and loss (the text under the mask, unescaped)."""
    pieces = formatted.select("conv_id", "formatted", "turns", F.split("formatted", r"<\|im_end\|>\n", -1).alias("p"))
    bare = pieces.select("conv_id", "formatted", "turns", "p", F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: F.substring(x, len(START) + 1, 2**31 - 1)).alias("q"))
    under = F.zip_with("p", "turns", lambda x, t: F.when(t["loss"], unescape(F.substr(x, (t["start"] - t["turn_start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int")))).otherwise(F.lit("")))
    return bare.select(
        "conv_id", "formatted",
        F.transform("q", lambda x: unescape_role(F.substring_index(x, "\n", 1))).alias("roles"),
        F.transform("q", lambda x: unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2))).alias("texts"),
        F.array_join(under, "").alias("loss"),
    )


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
