"""Chat messages with typed content parts, flattened into marked text.

A turn's content is an ordered list of parts (kind, text, ref, units). A visitor goes through
them: text stays text with its control strings escaped; an image, an audio or a document part
becomes a placeholder, and its reference is recorded with the number of tokens that the
placeholder expands to. Only DataFrame functions are used.

Every control string of the template starts with ``<|``. In texts and roles ``<``, any number of
backslashes and ``|`` gets one backslash more, so no text can hold a control string, and taking
one backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 800}
PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"
MARK = r"<(\\*)\|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MARK, r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    nothing = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), nothing.cast("string").alias("ref"), nothing.cast("long").alias("units"))
    return F.array(part).cast(PARTS)


def _visited(parts: Column) -> Column:
    """The flat text of a turn; unknown kinds are treated as text.

    Neighbouring text parts are joined before they are escaped, so that they can't form a control
    string together.
    """

    def visit(state: Column, part: Column) -> Column:
        more = F.struct(state["flat"].alias("flat"), F.concat(state["run"], F.coalesce(part["text"], F.lit(""))).alias("run"))
        for kind, placeholder in PLACEHOLDERS.items():
            closed = F.concat(state["flat"], escaped(state["run"]), F.lit(placeholder))
            more = F.when(part["kind"] == kind, F.struct(closed.alias("flat"), F.lit("").alias("run"))).otherwise(more)
        return more

    empty = F.struct(F.lit("").alias("flat"), F.lit("").alias("run"))
    return F.aggregate(parts, empty, visit, lambda state: F.concat(state["flat"], escaped(state["run"])))


def _tokens(part: Column) -> Column:
    per_unit = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        per_unit = F.when(part["kind"] == kind, F.lit(n)).otherwise(per_unit)
    return (per_unit * F.coalesce(part["units"], F.lit(1))).cast("long")


def flattened(parts: Column) -> tuple[Column, Column]:
    """A turn's flat text, and its attachments (kind, ref, tokens) in order; a null list is empty."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    attached = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False)))
    return (
        _visited(parts),
        F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
    )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments, attachments, expanded_tokens): one row per conversation.

    ``segments`` are the runs (text, loss) whose texts joined give ``formatted``; loss marks what a
    model learns from, the texts of the role ``learn_from``. ``attachments`` are numbered from 0 in
    the order of their placeholders and carry their turn. Turns come in the order of the turn
    column, nulls first; repeated rows stay, ordered by role and text. Null roles and contents count as
    empty, rows with a null conv_id form one conversation. An empty table gives no rows.
    """
    flat, attached = flattened(F.col(parts_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            flat.alias("flat"),
            attached.alias("attached"),
        ).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def marked(row: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(START), escaped(row["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(row["flat"].alias("text"), (row["role"] == learn_from).alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    def listed(row: Column) -> Column:
        return F.transform(row["attached"], lambda a: F.struct(row["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))

    found = chats.select(
        "conv_id",
        F.flatten(F.transform("rows", marked)).alias("segments"),
        F.flatten(F.transform("rows", listed)).alias("found"),
    )
    numbered = F.transform(
        "found",
        lambda a, i: F.struct(i.cast("long").alias("place"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
    )
    return found.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        numbered.alias("attachments"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay.

    A role ends at its first line break: what a role with a line break holds behind it comes back
    at the head of the text, with a line break after it, so role, line break and text joined are the same.
    """
    marked = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: t != "")

    def turn(text: Column) -> Column:
        line = F.locate("\n", text)
        return F.struct(
            unescaped(text.substr(F.lit(len(START) + 1), line - len(START) - 1)).alias("role"),
            unescaped(text.substr(line + 1, F.length(text))).alias("text"),
        )

    return F.transform(marked, turn)


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
