"""Chat records of many layouts to canonical turns, and turns to training text with a loss mask.

A record's layout is recognised by a hash of the nested field paths it fills; each known hash selects a declarative
mapping to turns. Everything is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that a record may have, over all layouts.
_LISTS = {"messages": ("role", "content"), "conversations": ("from", "value"), "turns": ("speaker", "text")}
_TEXTS = ("prompt", "response", "completion", "instruction", "input", "output", "question", "answer", "system")
#: Fields that the elements of each list may have: the names of all layouts, since one layout's list may hold another's.
_PARTS = tuple(dict.fromkeys(x for v in _LISTS.values() for x in v))
_text = lambda name: T.StructField(name, T.StringType())
FIELDS = T.StructType([*(T.StructField(k, T.ArrayType(T.StructType([*map(_text, _PARTS)]))) for k in _LISTS), *map(_text, _TEXTS)])
#: Layout: paths that it has, paths that it may have, and its turns as (role or path of roles, path of texts).
LAYOUTS = {
    "messages": (("messages[].role", "messages[].content"), ("system",), (("system", "system"), ("messages[].role", "messages[].content"))),
    "conversations": (("conversations[].from", "conversations[].value"), ("system",), (("system", "system"), ("conversations[].from", "conversations[].value"))),
    "turns": (("turns[].speaker", "turns[].text"), ("system",), (("system", "system"), ("turns[].speaker", "turns[].text"))),
    **{
        f"{k}_{role}_{text}": ((f"{k}[].{role}", f"{k}[].{text}"), ("system",), (("system", "system"), (f"{k}[].{role}", f"{k}[].{text}")))
        for k, own in _LISTS.items()
        for role, text in _LISTS.values()
        if (role, text) != own
    },
    "prompt_response": (("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "prompt_completion": (("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    "question_answer": (("question", "answer"), ("system",), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
    "instruction": (("instruction", "output"), ("system",), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    "instruction_input": (("instruction", "input", "output"), ("system",), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
}
#: Other names of roles, and the canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "\n</turn>\n"
TURN = "array<struct<role: string, text: string>>"


def _at(record: str, path: str) -> Column:
    return F.col(f"{record}.`{path.partition('[]')[0]}`")


def _fills(record: str, path: str) -> Column:
    held, part = _at(record, path), path.partition("[].")[2]
    if not part:
        return held.isNotNull()
    filled = F.exists(held, lambda m: m[part].isNotNull())
    return filled | (F.size(held) == 0) if part in _LISTS[path.partition("[]")[0]] else filled


def _given(record: str, kind: T.StructType, f: T.StructField) -> Column:
    """A known field of a struct; fields of a list's elements are taken by their names."""
    held = F.col(f"{record}.`{f.name}`") if f.name in kind.names else F.lit(None)
    element = getattr(kind[f.name].dataType, "elementType", None) if f.name in kind.names else None
    if isinstance(f.dataType, T.ArrayType) and isinstance(element, (T.StructType, T.MapType)):
        has = lambda g: isinstance(element, T.MapType) or g in element.names
        held = F.transform(held, lambda m: F.struct(*((m[g] if has(g) else F.lit(None)).cast("string").alias(g) for g in _PARTS)))
    return held.cast(f.dataType).alias(f.name)


def _hash(paths) -> Column:
    return F.xxhash64(F.lit("|".join(sorted(paths))))


def _turns(messages: Column, role: str, text: str) -> Column:
    return F.transform(messages, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))


def _mapped(record: str, rules, have: set[str]) -> Column:
    parts = []
    for role, path in rules:
        if "[]" in path:
            one, two = role.partition("[].")[2], path.partition("[].")[2]
            parts.append(_turns(_at(record, path), one, two))
        elif path in have or "+" in path:
            text = F.concat_ws("\n\n", *(_at(record, p) for p in path.split("+")))
            parts.append(F.array(F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.concat(*(p.cast(TURN) for p in parts))


def canonical_turns(df: DataFrame, record_col: str, out: str = "turns", layouts=LAYOUTS) -> DataFrame:
    """df with fingerprint long, layout string and the column `out`: the record's turns, an array of (role, text).

    record_col is a struct or a string of JSON. The fingerprint is XXH64 of the sorted nested paths of the known fields
    that the record fills; other fields don't count. A path in a list is filled if some element has it, the list's usual
    two in an empty list too; the list of one layout may hold the fields of another. A record of no known layout (null, empty and malformed ones too)
    gets a null layout and null turns. Roles that have other names become user and assistant; null roles and texts
    become empty strings. Rows that repeat stay; clashing columns of df other than the new ones are kept.
    """
    kind = df.schema[record_col].dataType
    given = F.from_json(F.col(record_col), FIELDS) if isinstance(kind, T.StringType) else F.struct(*(_given(record_col, kind, f) for f in FIELDS))
    rows = df.withColumn("_record_", given)
    paths = [(f"{f.name}[].{g}" if isinstance(f.dataType, T.ArrayType) else f.name) for f in FIELDS for g in (f.dataType.elementType.names if isinstance(f.dataType, T.ArrayType) else [""])]
    filled = F.array_compact(F.array(*(F.when(_fills("_record_", p), F.lit(p)) for p in sorted(paths))))
    rows = rows.withColumn("fingerprint", F.xxhash64(F.array_join(filled, "|")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for layout, (must, may, rules) in layouts.items():
        for more in (c for n in range(len(may) + 1) for c in combinations(may, n)):
            hit = F.col("fingerprint") == _hash({*must, *more})
            name, turns = F.when(hit, F.lit(layout)).otherwise(name), F.when(hit, _mapped("_record_", rules, {*must, *more})).otherwise(turns)
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))

    def tidy(t):
        role = F.coalesce(t["role"], F.lit(""))
        return F.struct(F.coalesce(names[role], role).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return rows.withColumn("layout", name).withColumn(out, F.transform(turns, tidy)).drop("_record_")


def escape(text: Column) -> Column:
    """A backslash before every backslash, # and <: no control string can then stand in a text."""
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def escape_role(role: Column) -> Column:
    """As escape(), and a backslash before every line break, which would end the turn's head."""
    return F.regexp_replace(role, r"([\\#<\n])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<\n])", "$1")


def format_chat(df: DataFrame, turns_col: str = "turns", learn: str = "assistant") -> DataFrame:
    """df with formatted string and loss array<struct<start, end>>: where the escaped texts of the role `learn` stand in
    it, in code points, end exclusive.

    A turn is `### role:`, a new line, the escaped text, a new line and `</turn>`. Null turns give a null text and mask;
    no turns give an empty text and mask. Columns of these names are replaced, others stay.
    """
    role = lambda t: escape_role(F.coalesce(t["role"], F.lit("")))
    parts = F.transform(F.col(turns_col), lambda t: F.struct(F.concat(F.lit(OPEN), role(t), F.lit(AFTER_ROLE)).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == learn, F.lit(False)).alias("learn")))
    rows = df.withColumn("_parts_", parts)
    rows = rows.withColumn("formatted", F.array_join(F.transform("_parts_", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    ends = F.aggregate(
        "_parts_",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
            F.when(p["learn"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.withColumn("loss", ends).drop("_parts_")


def read_chat(formatted: Column) -> Column:
    """The turns that format_chat() wrote, out of its text alone."""
    segments = F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E", -1), lambda s: s != "")
    head = r"^### ((?:[^\\\n]++|\\[\s\S])*+)\n"  # up to the first line break that isn't escaped; a colon ends it
    return F.transform(segments, lambda s: F.struct(unescape(F.regexp_replace(F.regexp_extract(s, head, 1), ":$", "")).alias("role"), unescape(F.regexp_replace(s, head, "")).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the mask."""
    return F.transform(loss, lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))


def conversations_to_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows by turn: turns in order, ties by role and text; nulls first, a null id is one group."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("conv_id", F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).alias("record"))
