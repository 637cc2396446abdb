r"""Chat formatting by a declarative template and a finite-state machine over roles. DataFrame functions only.

The machine reads the roles. A known role leads to the state of its name, any other and the null role to states of their
own, and the state entered says which marks and which loss flag a turn has: a turn becomes three segments, the mark before
it, its text, the mark after it. A turn that the template does not allow after the state before is out of place; the machine
goes on from the state it names, so all turns are formatted. A conversation is in order if no turn is out of place and the
last state is an accepting one; ``wrong_turn`` counts from 1 and is null if no turn is out of place.
Inside texts and role names each of the characters ``<``, ``[``, ``]`` and ``\`` is followed by an extra ``\``. Every mark
has a ``<`` or ``[`` with another character after it, so no mark can arise from a text, and dropping the extra
characters gives the text back exactly.

Turns are ordered by turn (null first), then role, then text, so repeated rows are repeated turns and ties have an order.
Null texts count as empty; a null role is written as a role of its own and read back as null. Rows with a null
conversation id form one conversation. A conversation is one row of the result, so its turns do meet in one task.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict  # role to Turn
    other: Turn  # for other roles; the role's name follows ``before``
    name_end: str  # what ends that name
    nameless: Turn  # for a null role
    follows: dict  # state, or START, to the roles that may come next
    accepting: tuple  # states in which a conversation may end


#: States beside those named by roles; a role of such a name is another role.
START, OTHER, NAMELESS = "", "*", "?"


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("<s>[INST] ", " [/INST]"),
        "assistant": Turn("[ANS] ", " </s>\n", loss=True),
    },
    other=Turn("[ROLE ", " [/ROLE]\n"),
    name_end="] ",
    nameless=Turn("[NOBODY] ", " [/NOBODY]\n"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    accepting=("assistant",),
)


def escaped(c):
    return F.regexp_replace(c, r"([<\[\]\\])", r"$1\\")


def unescaped(c):
    return F.regexp_replace(c, r"([<\[\]\\])\\", "$1")


def entered(role, template: Template):
    """The state that a turn of this role leads to."""
    known = [F.lit(name) for name in template.turns]
    return F.when(role.isNull(), F.lit(NAMELESS)).when(role.isin(*known), role).otherwise(F.lit(OTHER))


def _by_state(state, template: Template, known):
    """What ``known`` gives for the Turn of a state."""
    found = F.when(state == OTHER, F.lit(known(template.other))).when(state == NAMELESS, F.lit(known(template.nameless)))
    for name, turn in template.turns.items():
        found = found.when(state == name, F.lit(known(turn)))
    return found


def walked(turns, states, template: Template):
    """Turns with the state each leads to and whether it is allowed after the state before.

    A turn's state follows from its role alone, so the state before is that of the turn before, and long
    conversations take time that grows with their length only.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, following in template.follows.items() for b in following])

    def step(x, k):
        state = F.get(states, k)
        before = F.coalesce(F.get(states, k - 1), F.lit(START))
        in_place = F.array_contains(allowed, F.concat(before, F.lit(">"), state))
        return F.struct(x.alias("turn"), state.alias("state"), in_place.alias("in_place"))

    return F.transform(turns, step)


def formatted(
    df: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", template: Template = INSTRUCT
) -> DataFrame:
    """One row per conversation: conv_id, in_order, wrong_turn, segments (text, loss)."""
    turns = F.sort_array(
        F.collect_list(
            F.struct(column(turn).alias("turn"), column(role).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"))
        )
    )
    t = template

    def segments(x):
        state, role, mark = x["state"], x["turn"]["role"], F.lit(False)
        name = F.when(state == OTHER, F.concat(escaped(role), F.lit(t.name_end))).otherwise("")
        return F.array(
            F.struct(F.concat(_by_state(state, t, lambda k: k.before), name).alias("text"), mark.alias("loss")),
            F.struct(escaped(x["turn"]["text"]).alias("text"), _by_state(state, t, lambda k: k.loss).alias("loss")),
            F.struct(_by_state(state, t, lambda k: k.after).alias("text"), mark.alias("loss")),
        )

    grouped = df.groupBy(column(conv_id).alias("conv_id")).agg(turns.alias("turns"))
    grouped = grouped.withColumn("states", F.transform("turns", lambda x: entered(x["role"], t)))
    walk = grouped.withColumn("walk", walked(F.col("turns"), F.col("states"), t))
    wrong = F.nullif(F.array_position(F.transform("walk", lambda x: x["in_place"]), F.lit(False)), F.lit(0)).cast("int")
    accepted = F.element_at("walk", -1)["state"].isin(*t.accepting)
    return walk.select(
        "conv_id",
        (wrong.isNull() & accepted).alias("in_order"),
        wrong.alias("wrong_turn"),
        F.flatten(F.transform("walk", segments)).alias("segments"),
    )


def joined(segments):
    """The formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def read_back(formatted_text, template: Template = INSTRUCT):
    """The turns (role, text) of a formatted text."""
    t = template
    starts = [k.before for k in (*t.turns.values(), t.other, t.nameless)]
    quoted = "|".join("".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in s) for s in starts)
    parts = F.filter(F.split(formatted_text, f"(?={quoted})"), lambda p: p != "")

    def inner(part, before, after):
        return F.substring(part, before + 1, F.length(part) - before - len(after))

    def parsed(part):
        def known(k):
            return unescaped(inner(part, F.lit(len(k.before)), k.after))

        name = F.substring_index(F.substring(part, F.lit(len(t.other.before) + 1), F.length(part)), t.name_end, 1)
        start = len(t.other.before) + F.length(name) + len(t.name_end)
        role, text = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
        for each, k in t.turns.items():
            role = role.when(part.startswith(k.before), F.lit(each))
            text = text.when(part.startswith(k.before), known(k))
        role = role.when(part.startswith(t.nameless.before), F.lit(None))
        text = text.when(part.startswith(t.nameless.before), known(t.nameless))
        return F.struct(
            role.otherwise(unescaped(name)).alias("role"),
            text.otherwise(unescaped(inner(part, start, t.other.after))).alias("text"),
        )

    return F.transform(parts, parsed)


def digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted conversations hold, read back from their segments, and what the machine says of their order."""
    text = joined("segments")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
    turns = F.transform(
        "turns", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n"))
    )
    return (
        conversations.select("conv_id", "in_order", "wrong_turn", text.alias("formatted"), loss.alias("loss"))
        .withColumn("turns", read_back(F.col("formatted"), template))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "in_order",
            "wrong_turn",
        )
    )
