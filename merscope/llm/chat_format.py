"""Chat formatting: a declared template, a state machine over roles, loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like, which role may follow which, and what is learnt.

    A turn is ``<|role:NAME|>TEXT<|/turn|>``. ``follows`` maps a state to the
    roles allowed next; the state is the last role, ``start`` before any.
    """

    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    loss_roles: tuple[str, ...] = ("assistant",)


OPEN, SHUT, END = "<|role:", "|>", "<|/turn|>"
SEGMENT = "array<struct<text:string,loss:boolean>>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash goes behind the ``<`` of ``<|``, ``<\\|``, ``<\\\\|`` ..."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``; ``|>``, which ends a header, is treated likewise."""
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|\\$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def turns_in_order(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the rows of each conversation by turn, ties by role and text.

    A conversation is one training sample and one output row, so its turns meet in one row.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def first_bad_turn(turns: Column, template: ChatTemplate) -> Column:
    """Index of the first turn the state machine has no step for; null if it takes all."""
    steps = [F.lit(x) for state, roles in template.follows.items() for role in roles for x in (f"{state}>{role}", role)]
    table = F.create_map(*steps)
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(s["state"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (s["at"] + 1).alias("at"),
            F.coalesce(s["bad"], F.when(to.isNull(), s["at"])).alias("bad"),
        )

    return F.aggregate(turns, begin, step, lambda s: s["bad"])


def format_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments, valid, first_bad_turn``.

    ``segments`` are the pieces of ``formatted`` in order, each with its loss
    flag. A conversation whose roles come in an order that the template does
    not allow is formatted too, with ``valid`` false. Null role and text count
    as empty, a null ``conv_id`` is a conversation of its own, repeated rows
    are repeated turns, and no rows give no conversations.
    """
    grouped = turns_in_order(rows)

    def pieces(turn: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit(SHUT))
        body_counts = turn["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), body_counts.alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    segments = grouped.select("conv_id", "turns", F.flatten(F.transform("turns", pieces)).cast(SEGMENT).alias("segments"))
    bad = first_bad_turn(F.col("turns"), template)
    return segments.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        bad.isNull().alias("valid"),
        bad.alias("first_bad_turn"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns, as ``array<struct<role, text>>``, that ``formatted`` was made of."""
    blocks = F.split(formatted, r"<\|/turn\|>", -1)
    whole = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        head = F.substring_index(block, SHUT, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        text = F.substr(block, F.length(head) + len(SHUT) + 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(whole, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")


def format_digest(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of each formatted conversation, read back from the output."""
    read = format_conversations(rows, template).select(
        "conv_id",
        "formatted",
        parse_formatted(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("learnt"),
        "valid",
    )
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
