"""Chat formatting: a finite-state machine over roles and a declarative template, in built-in functions.

A template gives every role an opening and a closing mark. Texts are escaped, so no mark of the
template occurs inside a formatted text, and reading back restores every turn exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    code: str     # the role's name inside the marks
    close: str    # what ends the turn
    loss: bool    # is the text trained on?


@dataclass(frozen=True)
class Template:
    """``roles`` maps a role to its turn; every other role is written with ``other`` and its name in front of the text.

    ``order`` lists the allowed (state, role) -> state steps, beginning in ``start``.
    """

    roles: dict[str, Turn]
    other: Turn
    order: dict[tuple[str, str], str]
    final: tuple[str, ...]
    reserved: tuple[str, ...] = field(default=("<s>", "</s>"))

    def opening(self, turn: Turn) -> str:
        return f"[{turn.code}] "

    def turns(self) -> list[Turn]:
        return [*self.roles.values(), self.other]

    def controls(self) -> list[str]:
        """The strings that texts must not hold unescaped."""
        marks = {f"[{t.code}]" for t in self.turns()} | {t.close.strip() for t in self.turns()}
        return sorted(marks | set(self.reserved) | {"[/ROLE]"}, key=lambda c: (-len(c), c))

    def __post_init__(self):
        for control in self.controls():
            if len(control) < 2 or " " in control or ESCAPE in control:
                raise ValueError(f"{control!r} can't be a control string")
            for turn in self.turns():
                if any(turn.close.startswith(control[cut:]) for cut in range(1, len(control))):
                    raise ValueError(f"a text before {turn.close!r} could complete {control!r}")


#: Instruction format: user turns between [INST] and [/INST], answers closed by </s>.
INSTRUCT = Template(
    roles={"system": Turn("SYS", " [/SYS]", False), "user": Turn("INST", " [/INST]", False),
           "assistant": Turn("ANS", "</s>", True)},
    other=Turn("MSG", " [/MSG]", False),
    order={("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
           ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    final=("answered",),
)


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in template.controls():
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(template: Template, role: Column, value) -> Column:
    """``value(turn)`` of the role's turn, or of the template's turn for other roles."""
    out = F.lit(value(template.other))
    for name, turn in template.roles.items():
        out = F.when(role == name, F.lit(value(turn))).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation.

    Returns conv_id, n_turns, ``valid`` (the machine accepted the order of roles), ``segments``
    (text, loss: the formatted text is their concatenation) and ``formatted``.

    Rows are ordered by turn, then role and text where turns tie; repeated rows stay. A null text or
    role counts as empty. A null conv_id is a conversation of its own; an empty table gives no rows.
    Other columns are ignored. A conversation is one value of the output, so it has to fit a row.
    """
    rows = turns.select("conv_id", F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, role), to in template.order.items() for x in (f"{state}|{role}", to)])
    last = F.aggregate("turns", F.lit("start"),
                       lambda state, t: F.coalesce(F.element_at(steps, F.concat(state, F.lit("|"), t["role"])), F.lit("rejected")))

    def emit(t: Column) -> Column:
        role = t["role"]
        known = role.isin(*template.roles)
        head = F.concat(_by_role(template, role, template.opening),
                        F.when(known, F.lit("")).otherwise(F.concat(escaped(role, template), F.lit("[/ROLE] "))))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), _by_role(template, role, lambda x: x.loss).alias("loss")),
            F.struct(_by_role(template, role, lambda x: x.close).alias("text"), F.lit(False).alias("loss")))

    return (chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), last.isin(*template.final).alias("valid"),
                         F.flatten(F.transform("turns", emit)).alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The (role, text) turns of a formatted conversation."""
    mark = r"\[(" + "|".join(re.escape(t.code) for t in template.turns()) + r")\] "
    codes = F.regexp_extract_all(formatted, F.lit(mark), F.lit(1))
    bodies = F.slice(F.split(formatted, mark, -1), F.lit(2), F.size(codes))

    def read(code: Column, body: Column) -> Column:
        role, closing = F.lit(""), F.lit(len(template.other.close))
        for name, turn in template.roles.items():
            role = F.when(code == turn.code, F.lit(name)).otherwise(role)
            closing = F.when(code == turn.code, F.lit(len(turn.close))).otherwise(closing)
        inner = F.left(body, F.length(body) - closing)
        other = code == template.other.code
        cut = F.split(inner, r"\[/ROLE\] ", 2)
        return F.struct(F.when(other, unescaped(cut[0])).otherwise(role).alias("role"),
                        F.when(other, unescaped(F.get(cut, F.lit(1)))).otherwise(unescaped(inner)).alias("text"))

    return F.zip_with(codes, bodies, read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def chat_digest(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation the digests of what is read back from the formatted output."""
    read = chats.select("conv_id", "valid", "formatted", read_turns(F.col("formatted"), template).alias("turns"),
                        loss_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def chat_sql(extra: str, template: Template = INSTRUCT) -> str:
    """The digest in SQL, over ``conversations`` and the ``extra`` rows. The role order is a pattern of the machine above."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def escape(column: str) -> str:
        out = f"replace({column}, {quoted(ESCAPE)}, {quoted(ESCAPE * 2)})"
        for control in template.controls():
            out = f"replace({out}, {quoted(control)}, {quoted(control[0] + ESCAPE + control[1:])})"
        return out

    marks = " ".join(f"WHEN {quoted(role)} THEN {len(template.opening(turn)) + len(turn.close)}" for role, turn in template.roles.items())
    other = len(template.opening(template.other)) + len(template.other.close) + len("[/ROLE] ")
    loss = ", ".join(quoted(role) for role, turn in template.roles.items() if turn.loss)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
       CAST(sum(length({escape('text')}) + CASE role {marks} ELSE {other} + length({escape('role')}) END) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END, '' {order}), 'S?(UA)+') AS valid
FROM t GROUP BY conv_id"""
