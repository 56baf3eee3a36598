"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value", and spellings of true and false.
NULLS = ("", "nan", "none", "null")
TRUE = ("1", "true", "t", "yes", "y")
FALSE = ("0", "false", "f", "no", "n")
# Countries whose original titles are English.
ENGLISH = ("usa", "uk", "great britain", "canada", "australia", "new zealand", "ireland")
BLANKS = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, BLANKS, "")


def clean(x: Column) -> Column:
    """Null for blank texts and spelt-out nulls."""
    t = strip(x.cast("string"))
    return F.when(F.lower(t).isin(*NULLS), None).otherwise(t)


def to_double(x: Column) -> Column:
    return clean(x).try_cast("double")


def to_boolean(x: Column) -> Column:
    t = F.lower(clean(x))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def first_value(*columns: Column) -> Column:
    return F.coalesce(*map(clean, columns))


def parts(x: Column, by: str = ",") -> Column:
    return F.transform(F.split(x, by), strip)


def from_english_country(countries: Column) -> Column:
    return F.coalesce(F.exists(parts(F.lower(clean(countries))), lambda p: p.isin(*ENGLISH)), F.lit(False))


def preferred_title(title: Column, original: Column, countries: Column) -> Column:
    """The original title for English-speaking countries, else the local one; whichever is there."""
    english = from_english_country(countries)
    return F.when(english, F.coalesce(clean(original), clean(title))).otherwise(F.coalesce(clean(title), clean(original)))


def first_keywords(x: Column, n: int = 5) -> Column:
    """The first n keywords; none: 'Unknown'."""
    shown = F.array_join(F.slice(parts(x), 1, n), ", ")
    return F.when(x.isNull() | (x == ""), "Unknown").otherwise(shown)


def session_key(user: Column, session: Column) -> Column:
    return F.concat_ws("_", user.cast("string"), session.cast("string"))


def key_user(key: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_extract(key, r"(?s)^(.*)_([^_]+)$", 1)


def key_session(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*)_([^_]+)$", 2)


def key_pair(key: Column) -> Column:
    """(user, session) of a key with one underscore; any other key is an error."""
    p = F.split(key, "_")
    fail = F.raise_error(F.concat(F.lit("not a user and a session: "), F.coalesce(key, F.lit("null"))))
    return F.when(F.size(p) == 2, F.struct(p[0].alias("user"), p[1].alias("session"))).otherwise(fail)


def key_last(key: Column) -> Column:
    """What stands after the last underscore; the whole key without one."""
    return F.element_at(F.split(key, "_"), -1)


def day_of(date: Column, weekday: Column) -> Column:
    """'date, weekday' without the commas of what is missing."""
    return F.btrim(F.concat_ws(", ", F.coalesce(date, F.lit("")), F.coalesce(weekday, F.lit(""))), F.lit(", "))


def without_role(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"(?i)^(assistant|agent)\s*:\s*", "")


LETTERS = "ABCDEFGHIJKLMNOPQRST"


def _answer(text: Column, pattern: str, letters: str) -> Column:
    """(letter, place) for a pattern of what stands before the letter and the letter; null without a match."""
    letter = F.upper(F.regexp_extract(text, pattern, 2))
    found = F.array_contains(F.array(*map(F.lit, letters)), letter)
    return F.when(found, F.struct(letter.alias("letter"), F.length(F.regexp_extract(text, pattern, 1)).alias("place")))


def tagged_answer_at(x: Column, letters: str = LETTERS) -> Column:
    """(letter, place in the stripped text) of the first <answer>..</answer>; null where the letter is none of the allowed ones."""
    return _answer(strip(x), r"(?is)^(.*?<answer>\s*)([A-Z])\s*</answer>", letters)


def plain_answer_at(x: Column, letters: str = LETTERS) -> Column:
    """(letter, place in the stripped text) behind the thoughts: the last allowed letter that follows 'answer', 'index'
    or 'final answer', a colon or dash between them or not; else the last allowed letter that stands by itself."""
    text = strip(x)
    gone = F.length(F.regexp_extract(text, r"(?is)^(.*?</think>)", 1))
    said = F.substring(text, gone + 1, F.length(text))
    one = f"([{letters}])(?![A-Z])"
    found = F.coalesce(
        _answer(said, rf"(?is)^(.*(?<![A-Z])(?:final answer|answer|index)\s*[:\-]?\s*){one}", letters), _answer(said, rf"(?is)^(.*(?<![A-Z])){one}", letters)
    )
    return F.when(found.isNotNull(), F.struct(found.letter.alias("letter"), (found.place + gone).alias("place")))


def tagged_answer(x: Column, letters: str = LETTERS) -> Column:
    return tagged_answer_at(x, letters).letter


def plain_answer(x: Column, letters: str = LETTERS) -> Column:
    return plain_answer_at(x, letters).letter


def answer_blocks(x: Column) -> Column:
    """(answer, think): what stands in the first <answer> block, or the whole stripped text without one, and what stands
    in the first <think> block, empty without one."""
    text = strip(x)
    block = lambda name: F.regexp_extract(text, rf"(?is)<{name}>(.*?)</{name}>", 1)
    return F.struct(F.when(text.rlike(r"(?is)<answer>.*?</answer>"), strip(block("answer"))).otherwise(text).alias("answer"), strip(block("think")).alias("think"))


def _marks(family: str) -> tuple[str, str, str]:
    # The families' marks before and after a role and after a message.
    return {"llama": ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>")}.get(family, ("<|im_start|>", "\n", "<|im_end|>\n"))


def chat_spans(messages: Column, role: str = "assistant", family: str = "qwen2.5") -> Column:
    """(start, end) in code points, of what a role's messages hold in `chat_text`."""
    start, mid, end = _marks(family)
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(a: Column, m: Column) -> Column:
        lead = a["at"] + F.length(m.role) + len(start) + len(mid)
        to = lead + F.length(m.content)
        own = F.when(m.role == role, F.array(F.struct(lead.alias("start"), to.alias("end")))).otherwise(none)
        return F.struct((to + len(end)).alias("at"), F.concat(a.spans, own).alias("spans"))

    return F.aggregate(messages, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a.spans)


def chat_text(messages: Column, family: str = "qwen2.5", generate: bool = False) -> Column:
    """Messages as a model family's prompt text; with `generate`, up to where the assistant begins."""
    start, mid, end = _marks(family)
    each = F.transform(messages, lambda m: F.concat(F.lit(start), m.role, F.lit(mid), m.content, F.lit(end)))
    text = F.array_join(each, "")
    return F.concat(text, F.lit(f"{start}assistant{mid}")) if generate else text


def render(template: str, values: dict[str, Column]) -> Column:
    """[[$Name$]] placeholders replaced; one that is left over is an error."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"[[${name}$]]"), F.coalesce(value.cast("string"), F.lit("")))
    left = set(re.findall(r"\[\[\$(\w+)\$\]\]", template)) - set(values)
    return F.when(F.lit(bool(left)), F.raise_error(F.lit(f"placeholders without a value: {sorted(left)}"))).otherwise(out)


def fill(template: str, values: dict[str, Column]) -> Column:
    """{name} fields replaced; {{ and }} stand for braces."""
    made: list[Column] = []
    for lit, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", template):
        made.append(F.coalesce(values[name].cast("string"), F.lit("")) if name else F.lit(lit.replace("{{", "{").replace("}}", "}")))
    return F.concat(*made)


def model_family(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.contains("qwen2.5"), "qwen2.5").when(n.contains("qwen3"), "qwen3").when(n.contains("qwen"), "qwen").when(n.contains("llama"), "llama")
        .otherwise(F.raise_error(F.concat(F.lit("unknown model family: "), name)))
    )


def number_after(x: Column, word: str) -> Column:
    """The number that follows a word in a file name, null where there is none."""
    return F.regexp_extract(x, word + r"[-_]?(\d+)", 1).try_cast("int")
