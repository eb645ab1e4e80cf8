"""Chat formatting by a declarative template.

A template names the markers around a role and a text, the control strings, and the roles that are under
the loss. A finite-state machine over the roles judges the order of turns. Each conversation becomes a
list of segments (text, loss flag); their concatenation is the formatted text, which ``read_back``
turns into the turns again.

Inside roles and texts a backslash is doubled, and a backslash is put after the first character of every
control string, so no marker can occur there; one rule (drop a backslash, keep what follows) reverses it.

Defined cases: a null text or role is empty; a null conversation id is one conversation; turns are
ordered by (turn, role, text) with a null turn first, so ties and repeated rows have one order and all
stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``transitions``: state -> role -> next state; ``ends``: states in which a conversation may end."""

    turn_start: str = "<|turn|>"
    role_end: str = "<|says|>"
    turn_end: str = "<|over|>"
    between: str = "\n"
    control: tuple[str, ...] = ("<|turn|>", "<|says|>", "<|over|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("answered",)


def escape(text: Column, template: Template) -> Column:
    firsts = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.control)
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, firsts, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def order_is_valid(roles: Column, template: Template) -> Column:
    """Runs the machine over an array of roles."""
    table = F.create_map(*(F.lit(x) for state, steps in template.transitions.items() for role, to in steps.items() for x in (f"{state} {role}", to)))
    last = F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(table[F.concat_ws(" ", state, role)], F.lit("invalid")))
    return last.isin(*template.ends)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template | None = None) -> DataFrame:
    """Per conversation: ``conv_id``, ``valid``, ``segments`` (array of struct text, loss) and ``formatted``."""
    t = template or Template()
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    spoken = lambda row: F.array(
        segment(F.concat(F.lit(t.turn_start), escape(row["role"], t), F.lit(t.role_end)), off),
        segment(escape(row["text"], t), row["role"].isin(*t.loss_roles)),
        segment(F.lit(t.turn_end + t.between), off),
    )
    return grouped.select(
        "conv_id",
        order_is_valid(F.transform("rows", lambda r: r["role"]), t).alias("valid"),
        F.flatten(F.transform("rows", spoken)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds ``turns`` (array of struct role, text), parsed from ``formatted``."""
    t = template or Template()
    end = t.turn_end + t.between
    pieces = F.filter(F.split("formatted", re.escape(end)), lambda x: x != "")
    parsed = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(t.turn_start) + 1)), t.role_end, 1)).alias("role"),
            unescape(F.substring_index(x, t.role_end, -1)).alias("text"),
        ),
    )
    return chats.withColumn("turns", parsed)
