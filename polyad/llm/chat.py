"""Conversations as template text with a loss mask, in Spark expressions only.

A conversation is ``<|turn|>role<|text|>part<|part|>part ... <|end|>`` for each run of adjacent turns of one role. Every
control string starts with ``<|``; inside roles and texts ``&`` is written ``&amp;`` and then ``<|`` is written ``&lt;|``,
so no text holds a control string and the original comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col, formatted, segments``.

    ``segments`` holds (text, loss): put together they are ``formatted``, and those under the loss are the texts of
    ``loss_role``, one each, without markers. All is built in time linear in the number of turns. Turns go by number; ties, nulls first, by role and then text, and repeated rows stay repeated. A null role
    or text counts as empty. Rows with a null conversation id form one conversation. An empty table gives an empty
    result; further columns are ignored.
    """
    turns = (
        df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    )
    first = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    runs = F.transform(
        "firsts",
        lambda s, k: F.struct(
            escape(F.get("t", s)["role"]).alias("role"),
            (F.get("t", s)["role"] == loss_role).alias("loss"),
            F.transform(F.slice("t", s + 1, F.coalesce(F.get("firsts", k + 1), F.size("t")) - s), lambda x: escape(x["text"])).alias("parts"),
        ),
    )
    # A piece is markers (never under the loss) followed by one part; the last one closes the last turn.
    pieces = F.flatten(
        F.transform(
            "runs",
            lambda r, k: F.transform(
                r["parts"],
                lambda p, i: F.struct(
                    F.when(i > 0, F.lit(PART)).otherwise(F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), r["role"], F.lit(TEXT))).alias("mark"),
                    p.alias("part"),
                    r["loss"].alias("loss"),
                ),
            ),
        )
    )
    segments = F.concat(
        F.flatten(F.transform("pieces", lambda p: F.array(F.struct(p["mark"].alias("text"), F.lit(False).alias("loss")), F.struct(p["part"].alias("text"), p["loss"].alias("loss"))))),
        F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))),
    )
    return (
        turns.select("conv", "t", first.alias("firsts"))
        .select("conv", runs.alias("runs"))
        .select("conv", pieces.alias("pieces"))
        .select(
            F.col("conv").alias(conv_col),
            segments.alias("segments"),
        )
        .select(conv_col, F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments")
    )


def parse_turns(formatted: Column) -> Column:
    """The turns in formatted text, as an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    runs = F.transform(turns, lambda x: F.split(F.regexp_replace(x, r"<\|end\|>$", ""), r"<\|text\|>"))
    return F.flatten(
        F.transform(runs, lambda r: F.transform(F.split(r[1], r"<\|part\|>"), lambda p: F.struct(unescape(r[0]).alias("role"), unescape(p).alias("text"))))
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
