"""Chat formatting: turns in, one marked text per conversation out, with a loss flag on every text segment.

A declarative template names the marks, the roles under the loss and the allowed role order.  The role order is a finite-state
machine that walks the ordered turns of a conversation.  Everything is column expressions.

Texts may hold the marks themselves.  ``&`` and ``<|`` are escaped inside roles and texts (``&amp;`` and ``&lt;|``, and a line
feed inside a role as ``&#10;``), so no text can open or close a turn, and ``read_back`` restores every character.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks must begin with ``<|``; ``turns`` maps a state (the last role, '' at the start) to the roles that may follow."""
    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not (self.opening.startswith("<|") and self.closing.startswith("<|")):
            raise ValueError("marks must begin with <|")


CHATML = ChatTemplate()


def escape(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if line_feeds else out


def unescape(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(text, F.lit("&#10;"), F.lit("\n")) if line_feeds else text
    return F.replace(F.replace(out, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _machine(turns: Column, template: ChatTemplate) -> Column:
    """(state, n, first_bad): first_bad is the position of the first turn that the machine does not take, or null."""
    arrows = [F.lit(x) for state, roles in template.turns.items() for role in roles for x in (f"{state}\x00{role}", role)]
    step = F.create_map(*arrows)
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("first_bad"))

    def move(at: Column, turn: Column) -> Column:
        to = F.try_element_at(step, F.concat(at["state"], F.lit("\x00"), turn["role"]))
        return F.struct(F.coalesce(to, turn["role"]).alias("state"), (at["n"] + 1).alias("n"),
                        F.coalesce(at["first_bad"], F.when(to.isNull(), at["n"])).alias("first_bad"))

    return F.aggregate(turns, start, move)


def format_chats(rows: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> ``(conv_id, segments, formatted, valid, first_bad)``.

    Rows are ordered by turn (a missing turn first, ties by role and text); repeated rows stay; a null role or text is empty.
    Rows without a conv_id form one conversation.  Conversations that break the turn order are formatted as well and marked:
    ``valid`` is false, and ``first_bad`` is the position of the first turn out of order (null if only the last role is wrong).
    A conversation is one text by definition, so its turns meet in one task; nothing else does.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))

    def parts(turn: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.opening), escape(turn["role"], True), F.lit("\n")), F.lit(False)),
            piece(escape(turn["text"]), turn["role"].isin(*template.loss_roles)),
            piece(F.lit(template.closing), F.lit(False)))

    out = chats.withColumn("segments", F.flatten(F.transform("_turns", parts))).withColumn("_end", _machine(F.col("_turns"), template))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                      (F.col("_end")["first_bad"].isNull() & F.col("_end")["state"].isin(*template.final)).alias("valid"),
                      F.col("_end")["first_bad"].alias("first_bad"))


def read_back(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted text."""
    close = "".join(f"\\{c}" if c in "|<>[](){}.*+?^$\\" else c for c in template.closing)
    pieces = F.filter(F.split(formatted, close), lambda p: F.startswith(p, F.lit(template.opening)))
    skip = len(template.opening)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, "\n")
        return F.struct(unescape(F.substring(piece, F.lit(skip + 1), head - 1 - skip), True).alias("role"),
                        unescape(F.substring(piece, head + 1, F.char_length(piece))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
