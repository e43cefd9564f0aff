"""Chat formatting by a declarative template.

The template is a finite-state machine over roles and, for each role, the segments of a turn with
their loss flags. Both are data; they become one expression over the sorted turns of a conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "{text}"


@dataclass(frozen=True)
class Template:
    """``moves[state, role]`` is the next state; ``turns[role]`` the segments (text, loss); TEXT stands for the turn's own text."""

    start: str
    accept: tuple[str, ...]
    moves: dict[tuple[str, str], str]
    turns: dict[str, tuple[tuple[str, int], ...]]
    opening: tuple[tuple[str, int], ...] = ()
    closing: tuple[tuple[str, int], ...] = ()


#: An optional system turn, then user and assistant in turn, the assistant last; the assistant's words and end mark are learnt.
TURN_MARKS = Template(
    start="start",
    accept=("assistant",),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    turns={
        "system": (("<|system|>\n", 0), (TEXT, 0), ("<|end|>\n", 0)),
        "user": (("<|user|>\n", 0), (TEXT, 0), ("<|end|>\n", 0)),
        "assistant": (("<|assistant|>\n", 0), (TEXT, 1), ("<|end|>\n", 1)),
    },
    closing=(("<|done|>", 1),),
)


def final_state(roles: Column, template: Template) -> Column:
    """State after the roles in order; 'stuck' once there is no move."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), r)), F.lit("stuck")))


def _segment(role: Column, text: Column, loss: int) -> Column:
    return F.struct(role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"))


def format_chats(turns: DataFrame, template: Template = TURN_MARKS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, role, text, loss, error).

    A valid conversation gives its segments, numbered from 0, error null; their texts one after the
    other are the training text. Any other gives one row with segment -1 and the first error that
    holds: 'turn missing', 'role missing', 'text missing' (nulls), 'turn repeated' (one number, two
    contents), 'role unknown', 'order' (no move, or no accepting state at the end). Rows without
    conv_id are left out. Equal rows count once. Empty texts are segments without characters. Long
    texts are kept whole. Gaps in the numbers are allowed. Other columns aren't read; an empty table
    gives no rows. Loss is 0 for opening and closing only where the template says so.
    """
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    talks = turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_set(row)).alias("turns"))
    t = F.col("turns")
    known = [F.lit(r) for r in template.turns]
    # roles alone go through the machine: a text can be long
    roles = F.transform(t, lambda x: x["role"])
    error = (
        F.when(F.exists(t, lambda x: x["turn"].isNull()), "turn missing")
        .when(F.exists(t, lambda x: x["role"].isNull()), "role missing")
        .when(F.exists(t, lambda x: x["text"].isNull()), "text missing")
        .when(F.size(F.array_distinct(F.transform(t, lambda x: x["turn"]))) < F.size(t), "turn repeated")
        .when(F.size(F.array_except(roles, F.array(*known))) > 0, "role unknown")
        .when(~final_state(roles, template).isin(*template.accept), "order")
    )

    def of(x: Column) -> Column:
        out = F.array().cast("array<struct<role:string,text:string,loss:int>>")
        for role, parts in template.turns.items():
            out = F.when(x["role"] == role, F.array(*[_segment(x["role"], x["text"] if p == TEXT else F.lit(p), loss) for p, loss in parts])).otherwise(out)
        return out

    frame = lambda parts: [_segment(F.lit(None).cast("string"), F.lit(p), loss) for p, loss in parts]
    segments = F.flatten(F.transform(t, of))
    if template.opening:
        segments = F.concat(F.array(*frame(template.opening)), segments)
    if template.closing:
        segments = F.concat(segments, F.array(*frame(template.closing)))
    judged = talks.select("conv_id", error.alias("error"), "turns")
    # one pass: an invalid conversation explodes into one empty segment
    none = F.array(F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("role", "string"), ("text", "string"), ("loss", "int"))]))
    both = judged.select("conv_id", "error", F.posexplode(F.when(F.col("error").isNull(), segments).otherwise(none)).alias("at", "s"))
    return both.select("conv_id", F.when(F.col("error").isNull(), F.col("at")).otherwise(-1).cast("int").alias("segment"), F.col("s.role").alias("role"), F.col("s.text").alias("text"), F.col("s.loss").alias("loss"), "error")
