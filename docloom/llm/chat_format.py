"""Chat formatting with DataFrame operations only: a state machine over roles, and text segments with loss flags.

The template is data: markers, the roles that carry loss, and the moves of a machine whose state is the role that spoke last.
A turn becomes three segments (opening with the role, text, closing) without looking at other turns; only the order of the
turns of a conversation takes a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is written begin + role_open + role + role_close + text + end.

    Each control string starts with "<" or "[" and has neither further on, so none can begin in a text and end in a marker.
    """

    begin: str = "<s>"
    role_open: str = "[INST] "
    role_close: str = " [/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From the role that spoke last ("" at the start) to the roles that may follow.
    moves: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if any(c[:1] not in "<[" or "<" in c[1:] or "[" in c[1:] or "\\" in c for c in self.controls):
            raise ValueError("a control string must start with < or [ and have neither, nor a backslash, further on")

    def escape(self, text: Column) -> Column:
        """Doubles backslashes and puts backslash and hyphen after the first character of each control string."""
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\-{c[1:]}"))
        return text

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")

    def allowed(self, before: Column, role: Column) -> Column:
        moves = F.array(*[F.lit(f"{a}\n{b}") for a, many in self.moves.items() for b in many])
        return F.array_contains(moves, F.concat(before, F.lit("\n"), role))


def format_turns(conversations: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, place, role, ok, segments): a row for each row of conversations.

    place counts from 1 by turn, then role and text; ok says whether the machine may move here from the role before; segments
    are ARRAY<STRUCT<text, loss>>. Null roles and texts count as empty, a null turn comes first, turns that repeat are turns
    of their own, and other columns are ignored. An empty table gives an empty result. The window keeps one row of a
    conversation in memory at a time, however long it is.
    """
    template = template or ChatTemplate()
    turns = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    order = Window.partitionBy("c").orderBy("t", "role", "x")
    turns = turns.withColumns({"place": F.row_number().over(order).cast("long"), "before": F.coalesce(F.lag("role").over(order), F.lit(""))})
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    opening = F.concat(F.lit(template.begin + template.role_open), template.escape(F.col("role")), F.lit(template.role_close))
    segments = F.array(segment(opening, F.lit(False)), segment(template.escape(F.col("x")), F.col("role").isin(*template.loss_roles)), segment(F.lit(template.end), F.lit(False)))
    return turns.select(F.col("c").alias(conv_col), "place", "role", template.allowed(F.col("before"), F.col("role")).alias("ok"), segments.alias("segments"))


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, valid, segments, formatted) from format_turns(): a row for each conversation, all of it in one string.

    valid: every move is allowed and the last role is a final one. A string holds up to 2 GB: beyond, stay with the turns.
    """
    template = template or ChatTemplate()
    rows = turns.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("place", "role", "ok", "segments"))).alias("turns"))
    last = F.element_at("turns", -1)
    rows = rows.select(conv_col, (F.forall("turns", lambda t: t["ok"]) & last["role"].isin(*template.final)).alias("valid"), F.flatten(F.col("turns.segments")).alias("segments"))
    return rows.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """ARRAY<STRUCT<role, text>>: the turns of a formatted conversation, unescaped."""
    template = template or ChatTemplate()
    opening, close = template.begin + template.role_open, template.role_close
    parts = F.split(formatted, _quoted(template.end), -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    role = lambda p: F.substring_index(p, close, 1)

    def turn(p: Column) -> Column:
        name = F.substr(role(p), F.lit(len(opening) + 1))
        text = F.substr(p, F.length(role(p)) + F.lit(len(close) + 1))
        return F.struct(template.unescape(name).alias("role"), template.unescape(text).alias("text"))

    return F.transform(whole, turn)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
