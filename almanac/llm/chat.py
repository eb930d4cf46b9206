"""Chat formatting by a finite-state machine over roles, in native expressions only.

A declarative ``Template`` names the transitions that make a turn order valid, the strings that open and close a turn, and
the roles whose texts bear loss. Control strings inside texts and roles are escaped, so the output can be read back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. ``open`` + role + ``header_end`` + text + ``close`` for each turn.

    ``transitions`` maps (state, role) to the next state; a role without an entry leads to the dead state. ``accepting``
    states may end a conversation. ``loss_roles`` are those whose texts are learnt. A template whose output could not be read
    back is refused: ``open`` and ``close`` must hold a control string, ``header_end`` a line feed or a control string, and
    control strings, nine at most, must not hold a backslash or begin with a digit."""

    open: str = "### "
    header_end: str = "\n"
    close: str = "\n</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    start: str = "start"
    dead: str = "invalid"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        held = lambda text: any(c in text for c in self.controls)
        if len(self.controls) > 9 or any(not c or "\\" in c or c[0].isdigit() for c in self.controls):
            raise ValueError("at most nine control strings, none empty, with a backslash or with a digit first")
        if not held(self.open) or not held(self.close) or not (held(self.header_end) or "\n" in self.header_end):
            raise ValueError("texts or roles could hold what opens or closes a turn")


def escape(text: Column, template: Template) -> Column:
    r"""``\`` becomes ``\0``, a line feed in a role ``\n`` (see ``escape_role``) and the i-th control string ``\i``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for i, control in enumerate(template.controls, 1):
        out = F.replace(out, F.lit(control), F.lit(f"\\{i}"))
    return out


def escape_role(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n"))
    for i, control in reversed(list(enumerate(template.controls, 1))):
        out = F.replace(out, F.lit(f"\\{i}"), F.lit(control))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, n_turns, state, valid, first_bad_turn,
    segments (array of struct<text, loss>) and formatted, the concatenation of the segments.

    Turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one outcome; a repeated row
    is a turn of its own. Null texts and roles are empty. Conversations with an invalid order are formatted too, with
    ``valid`` false and the index (from 0) of the first turn without a transition in ``first_bad_turn`` (null if the order
    only ends in a state that does not accept). Other columns of ``turns`` are ignored; no rows give no rows. A conversation
    becomes one row, so each must fit in one."""
    t = template or Template()
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\n{role}", to)])
    step = lambda acc, turn: F.struct(
        F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"])), F.lit(t.dead)).alias("state"),
        (acc["seen"] + 1).alias("seen"),
        F.when(
            acc["bad"].isNull() & F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"])).isNull(), acc["seen"]
        )
        .otherwise(acc["bad"])
        .alias("bad"),
    )
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    written = lambda turn: F.array(
        segment(F.concat(F.lit(t.open), escape_role(turn["role"], t), F.lit(t.header_end)), F.lit(False)),
        segment(escape(turn["text"], t), turn["role"].isin(*t.loss_roles)),
        segment(F.lit(t.close), F.lit(False)),
    )
    return (
        turns.select(
            "conv_id",
            F.struct(
                F.col("turn").alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.aggregate("turns", begin, step).alias("end"),
            F.flatten(F.transform("turns", written)).alias("segments"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.col("end.state").alias("state"),
            F.col("end.state").isin(*t.accepting).alias("valid"),
            F.col("end.bad").alias("first_bad_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns, an array of struct<role, text>, that ``formatted`` holds."""
    t = template or Template()
    body = F.split(formatted, _literal(t.close))
    return F.transform(
        F.slice(body, 1, F.size(body) - 1),
        lambda s: F.struct(
            unescape(F.substring_index(F.substr(s, F.lit(len(t.open) + 1)), t.header_end, 1), t).alias("role"),
            unescape(F.substr(s, F.instr(s, F.lit(t.header_end)) + len(t.header_end)), t).alias("text"),
        ),
    )


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")


def _literal(text: str) -> str:
    """``text`` as a Java regular expression that matches just it."""
    return "\\Q" + text + "\\E"


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The digests of what is read back from the output of ``format_conversations``."""
    t = template or Template()
    return formatted.select(
        "conv_id", read_back(F.col("formatted"), t).alias("turns"), loss_text(F.col("segments"), t).alias("loss"), "formatted", "valid", "first_bad_turn"
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )
