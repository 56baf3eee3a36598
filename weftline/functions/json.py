"""JSON in strings: structural validation with error paths, repair, canonical forms."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sections of a behavioral persona and their string fields.
SECTIONS = {
    "positive_preference": ("content_material", "production_context"),
    "negative_preference": ("content_material", "production_context"),
    "usage_patterns": ("temporal_patterns", "immersion_style"),
    "decision_drivers": ("selection_priority", "motivations"),
}
OUTCOME = ("item", "reaction", "reason")


def _strings(values: object, path: str, errors: list[str]) -> None:
    if not isinstance(values, list):
        errors.append(f"{path}: not a list")
        return
    errors += [f"{path}[{i}]: not a string" for i, v in enumerate(values) if not isinstance(v, str)]


def behavior_errors(value: object, path: str) -> list[str]:
    if not isinstance(value, dict):
        return [f"{path}: not an object"]
    errors = []
    for section, fields in SECTIONS.items():
        part = value.get(section)
        if not isinstance(part, dict):
            errors.append(f"{path}.{section}: not an object")
            continue
        errors += [f"{path}.{section}.{f}: not a string" for f in fields if not isinstance(part.get(f), str)]
    return errors


def memory_errors(value: object, path: str, events: str, outcomes: str) -> list[str]:
    if not isinstance(value, dict):
        return [f"{path}: not an object"]
    errors: list[str] = []
    _strings(value.get(events), f"{path}.{events}", errors)
    rows = value.get(outcomes)
    if not isinstance(rows, list):
        return [*errors, f"{path}.{outcomes}: not a list"]
    for i, row in enumerate(rows):
        if isinstance(row, dict):
            errors += [f"{path}.{outcomes}[{i}].{k}: not a string" for k in OUTCOME if not isinstance(row.get(k), str)]
        else:
            errors.append(f"{path}.{outcomes}[{i}]: not an object")
    return errors


def _parsed(text: object, path: str, errors: list[str]) -> object:
    if not isinstance(text, str):
        errors.append(f"{path}: not a string")
        return None
    try:
        return json.loads(text)
    except ValueError:
        errors.append(f"{path}: not JSON")
        return None


def extracted_errors(kind: str, text: str | None) -> list[str]:
    errors: list[str] = []
    value = _parsed(text, kind, errors)
    if errors:
        return errors
    if kind == "behavior":
        return behavior_errors(value, kind)
    if not isinstance(value, dict):
        return [f"{kind}: not an object"]
    _strings(value.get("dialogue_persona"), f"{kind}.dialogue_persona", errors)
    return errors + memory_errors(value.get("memory"), f"{kind}.memory", "episodic_memory", "recommendation_outcomes")


def canonical_memory(value: object) -> object:
    """Alias names of an updated state's parts brought to one form."""
    if not isinstance(value, dict):
        return value
    inner = value.get("updated_memory", value)
    if not isinstance(inner, dict):
        return inner
    memory = inner.get("memory") if isinstance(inner.get("memory"), dict) else inner
    pick = lambda d, *names: next((d[n] for n in names if n in d), None)
    return {
        "behavior_persona": pick(inner, "behavior_persona", "behavioral_persona", "updated_behavior_persona"),
        "dialogue_persona": pick(inner, "dialogue_persona", "updated_dialogue_persona"),
        "memory": {
            "session_events": pick(memory, "session_events", "episodic_memory", "updated_session_events"),
            "recommendation_history": pick(memory, "recommendation_history", "recommendation_outcomes", "updated_recommendation_history"),
        },
    }


def updated_errors(text: str | None) -> list[str]:
    errors: list[str] = []
    value = canonical_memory(_parsed(text, "updated", errors))
    if errors:
        return errors
    if not isinstance(value, dict):
        return ["updated: not an object"]
    errors = behavior_errors(value["behavior_persona"], "updated.behavior_persona")
    _strings(value["dialogue_persona"], "updated.dialogue_persona", errors)
    return errors + memory_errors(value["memory"], "updated.memory", "session_events", "recommendation_history")


_HISTORY = re.compile(r'\}\s*,\s*(?="updated_recommendation_history"\s*:)')


def _read(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def repair(text: str | None) -> str | None:
    """JSON comes back stripped, a JSON string unwrapped once. Of what is not JSON, the brace that closes a list before
    the recommendation history becomes a bracket, what follows the last brace goes, and an outermost brace that is missing
    behind a closed list of objects is added; if that makes an object, it comes back in compact form, and anything else as
    it was."""
    if text is None:
        return None
    body = text.strip()
    valid, value = _read(body)
    if valid:
        return value.strip() if isinstance(value, str) else body
    body = _HISTORY.sub("],", body)
    head, brace, _ = body.rpartition("}")
    body = (head + brace).strip() if brace else body
    valid, value = _read(body + "}" if body.endswith("}]}") else body)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if valid and isinstance(value, dict) else text


@F.pandas_udf(T.ArrayType(T.StringType()))
def validate_behavior(text: pd.Series) -> pd.Series:
    return text.map(lambda t: extracted_errors("behavior", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def validate_dialogue(text: pd.Series) -> pd.Series:
    return text.map(lambda t: extracted_errors("dialogue", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def validate_updated(text: pd.Series) -> pd.Series:
    return text.map(updated_errors)


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(repair)


@F.pandas_udf(T.StringType())
def values_text(text: pd.Series) -> pd.Series:
    """The values of nested JSON, space-joined; null and what is not JSON are empty."""

    def flat(v: object) -> list[str]:
        if isinstance(v, dict):
            return [x for e in v.values() for x in flat(e)]
        if isinstance(v, list):
            return [x for e in v for x in flat(e)]
        return [] if v is None else [str(v)]

    return text.map(lambda t: " ".join(flat(_read(t)[1])) if isinstance(t, str) else "")


def encoded(text: Column, indent: int | None = None, ascii_only: bool = False) -> Column:
    """JSON in the spacing of Python's encoder, indented or on one line, other characters than ASCII escaped or not; what
    is not JSON is null."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(t: object) -> str | None:
            valid, value = _read(t) if isinstance(t, str) else (False, None)
            return json.dumps(value, indent=indent, ensure_ascii=ascii_only) if valid else None

        return column.map(one)

    return run(text)


def kind_of(variant: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT ... of a variant value."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^[A-Z]+", 0)
