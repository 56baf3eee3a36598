"""Set operations on lists and the conversation-turn operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def except_keeping(left: Column, right: Column) -> Column:
    """left without right's values, in order and with its repeats."""
    return F.filter(left, lambda x: ~F.exists(right, lambda y: y.eqNullSafe(x)))


def except_by(left: Column, right: Column, field: str) -> Column:
    """Structs of left whose field is no field of right; null equals null."""
    return F.filter(left, lambda x: ~F.exists(right, lambda y: y[field].eqNullSafe(x[field])))


def union_in_order(left: Column, right: Column) -> Column:
    """Both lists' values, each once, as first seen."""
    return F.array_distinct(F.concat(left, right))


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps' entries, right's where both hold a key."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def drop_first(values: Column, n: int) -> Column:
    return F.slice(values, n + 1, F.greatest(F.size(values), F.lit(1))) if n else values


def flatten_turns(turns: Column, keep_empty: bool = False) -> Column:
    """'speaker: text' lines; turns with no speaker or text are left out, or kept with a final line end."""
    shown = turns if keep_empty else F.filter(turns, lambda t: (F.coalesce(t.speaker, F.lit("")) != "") & (F.length(F.trim(F.coalesce(t.text, F.lit("")))) > 0))
    lines = F.transform(shown, lambda t: F.concat(F.coalesce(t.speaker, F.lit("")), F.lit(": "), F.coalesce(t.text if keep_empty else F.trim(t.text), F.lit(""))))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n")) if keep_empty else F.array_join(lines, "\n")


def before_target(turns: Column) -> Column:
    """Turns before the first that holds a target; none holds one: no turns."""
    first = F.array_position(F.transform(turns, lambda t: F.coalesce(t.is_target, F.lit(False))), True)
    return F.when(first > 0, F.slice(turns, F.lit(1), (first - 1).cast("int"))).otherwise(F.slice(turns, 1, 0))


def accepted(outcomes: Column) -> Column:
    return F.filter(outcomes, lambda o: o.reaction == "Accept")


def sources(watch: Column) -> Column:
    return F.filter(watch, lambda r: r.in_session & ~r.target)


def first_target(watch: Column) -> Column:
    return F.try_element_at(F.filter(watch, lambda r: r.target), F.lit(1))


def last_target(watch: Column) -> Column:
    return F.try_element_at(F.filter(watch, lambda r: r.target), F.lit(-1))


def chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Chat messages of one sample."""
    parts = [("system", system), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in parts])


def split_gold(messages: Column) -> tuple[Column, Column]:
    """Messages without the last assistant message, and its content; if the last is no assistant's, all of those drop."""
    last = F.try_element_at(messages, F.lit(-1))
    mine = last.role == "assistant"
    rest = F.when(mine, F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(F.filter(messages, lambda m: m.role != "assistant"))
    return rest, F.when(mine, last.content).otherwise(F.lit(""))


def memory(behavior: Column, dialogue: Column, events: Column, episodic: Column, history: Column, outcomes: Column) -> Column:
    """A state with both names of its memory's lists; a list that is absent is null."""
    names = ("behavior", "dialogue", "session_events", "episodic_memory", "recommendation_history", "recommendation_outcomes")
    return F.struct(*[c.alias(n) for n, c in zip(names, (behavior, dialogue, events, episodic, history, outcomes))])


def fallback_memory(past: Column, extracted: Column) -> Column:
    """The last-resort update of two `memory` states: past behaviour (the new one only if there is none), and of dialogue,
    events and outcomes both states' lists under both names, past first, each value once as first seen."""

    def united(*names: str) -> Column:
        every = [s[n] for s in (past, extracted) for n in names]
        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(*[F.coalesce(c, none) for c in every]))

    return F.struct(
        F.coalesce(past.behavior, extracted.behavior).alias("behavior"), united("dialogue").alias("dialogue"),
        united("session_events", "episodic_memory").alias("events"), united("recommendation_history", "recommendation_outcomes").alias("outcomes"),
    )
