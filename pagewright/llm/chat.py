"""Chat formatting by a finite-state machine over roles.

A declarative template names the roles, the transitions between them, the text
around each turn and the roles that carry loss. The machine runs as one
``aggregate`` over the ordered turns of a conversation that carries only its state; segments are
emitted turn by turn. The whole operator is built of SQL functions: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Text around turns, legal turn orders and loss flags.

    ``control`` is the two-character string that opens every control string of the
    template. Inside texts it is escaped, so that a text never forms a control string.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_close: str = "\n"
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


def escape(text: Column, template: ChatTemplate, line_breaks: bool = False) -> Column:
    """Backslashes are doubled, then a single one goes into each control opener.

    After this a backslash between the opener's two characters is always a single
    one, and every other run of backslashes has even length: ``unescape`` is exact.
    With ``line_breaks`` (role names) a line feed becomes the opener's first character, a
    backslash and ``n``.
    """
    first, second = template.control
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(first + second), F.lit(first + "\\" + second))
    return F.replace(out, F.lit("\n"), F.lit(first + "\\n")) if line_breaks else out


def unescape(text: Column, template: ChatTemplate, line_breaks: bool = False) -> Column:
    """The inverse of :func:`escape`."""
    first, second = template.control
    out = F.replace(text, F.lit(first + "\\n"), F.lit("\n")) if line_breaks else text
    out = F.replace(out, F.lit(first + "\\" + second), F.lit(first + second))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _machine(turns: Column, template: ChatTemplate) -> Column:
    """Run the machine: struct(state, error_turn, at)."""
    edges = F.create_map(
        *(
            x
            for state, roles in template.transitions.items()
            for x in (F.lit(state), F.array(*(F.lit(r) for r in roles)))
        )
    )
    zero = F.struct(
        F.lit(template.start).alias("state"),
        F.lit(None).cast("long").alias("error_turn"),
        F.lit(0).cast("long").alias("at"),
    )

    def step(acc: Column, turn: Column) -> Column:
        legal = F.coalesce(F.array_contains(F.try_element_at(edges, acc["state"]), turn["role"]), F.lit(False))
        return F.struct(
            turn["role"].alias("state"),
            F.coalesce(acc["error_turn"], F.when(~legal, acc["at"])).alias("error_turn"),
            (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(turns, zero, step)


def _segments(turns: Column, template: ChatTemplate) -> Column:
    """Array of (text, loss): three for each turn."""

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def emitted(turn: Column) -> Column:
        opened = F.concat(F.lit(template.open), escape(turn["role"], template, True), F.lit(template.after_role))
        return F.array(
            segment(opened, F.lit(False)),
            segment(escape(turn["text"], template), turn["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close + template.after_close), F.lit(False)),
        )

    return F.flatten(F.transform(turns, emitted))


def format_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, valid, complete, error_turn.

    Input columns: conv_id, turn, role, text; any others are ignored. ``segments`` is an
    array of (text, loss) and ``formatted`` is their concatenation. ``valid`` tells whether
    the machine accepts every transition, ``error_turn`` the 0-based position of the first
    one it does not; nothing is dropped. ``complete``: valid, and it ends in a final state.

    Edge cases: a null text or role is empty text (an empty role is never legal). A null
    turn sorts first; equal turns are ordered by role, then text, and repeated rows
    stay. Rows whose conv_id is null form one conversation. An empty table gives no row.
    All turns of one conversation meet in one row, as its formatted text is one value.
    """
    template = template or ChatTemplate()
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Nulls sort first by default in array_sort's natural struct order.
    turns = F.col("turns")
    ran = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _machine(turns, template).alias("m"), _segments(turns, template).alias("segments"))
    return ran.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("m.error_turn").isNull().alias("valid"),
        (F.col("m.error_turn").isNull() & F.col("m.state").isin(*template.final)).alias("complete"),
        F.col("m.error_turn").alias("error_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate) -> Column:
    """Turns parsed from formatted text: array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, _quoted(template.open)), F.lit(2), F.size(F.split(formatted, _quoted(template.open))))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.after_role, 1)
        body = F.substr(piece, F.char_length(role) + 1 + len(template.after_role))
        text = F.substring_index(body, template.close, 1)
        return F.struct(unescape(role, template, True).alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: ChatTemplate) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
