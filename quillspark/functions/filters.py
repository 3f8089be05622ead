"""The metadata filter language, compiled to Columns over a JSON string.

or := and (' OR ' and)*; and := not (' AND ' not)*; not := ['NOT '] atom; atom := '(' or ')' | field ':' [op] value. Quotes protect their text from splitting. A leaf on a missing field or of another type is false, and NOT of that is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str  # = != > >= < <= ~ ANY ALL
    value: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def split_outside(text: str, word: str) -> list[str]:
    """Parts of text between ` word `, outside parentheses, brackets and quotes."""
    parts, depth, quote, lo, i = [], 0, "", 0, 0
    sep = f" {word} "
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and text.startswith(sep, i):
            parts.append(text[lo:i])
            lo = i = i + len(sep)
            continue
        i += 1
    if depth or quote:
        raise ValueError(f"unbalanced parentheses or quotes in {text!r}")
    return [*parts, text[lo:]]


def parse_value(text: str) -> object:
    """A list in brackets, a quoted string, true or false, a number, or a string."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1]
        return [parse_value(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,]+", inner) if x.strip()]
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str) -> object:
    text = text.strip()
    if not text:
        raise ValueError("empty filter")
    parts = split_outside(text, "OR")
    if len(parts) > 1:
        return Any(tuple(parse(p) for p in parts))
    parts = split_outside(text, "AND")
    if len(parts) > 1:
        return All(tuple(parse(p) for p in parts))
    if text.startswith("NOT "):
        rest = text[4:].strip()
        if rest.startswith("NOT "):
            raise ValueError("NOT NOT is not part of the language")
        return Not(parse(rest))
    if text.startswith("("):
        if not text.endswith(")"):
            raise ValueError(f"text after a closing parenthesis in {text!r}")
        return parse(text[1:-1])
    m = re.fullmatch(r"([^\s:()]+)\s*:\s*(>=|<=|!=|=|>|<|~)?(.*)", text, re.DOTALL)
    if not m or not m[3].strip():
        raise ValueError(f"not a condition: {text!r}")
    value = parse_value(m[3])
    return Leaf(m[1], "ANY" if isinstance(value, list) else m[2] or "=", value)


def _leaf(meta: Column, leaf: Leaf) -> Column:
    value = F.try_variant_get(F.try_parse_json(meta), f"$['{leaf.field}']" if not leaf.field.isidentifier() else f"$.{leaf.field}", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    if leaf.op in ("ANY", "ALL"):
        want = F.array(*(F.lit(str(x).lower() if isinstance(x, bool) else str(x)) for x in leaf.value)).cast("array<string>")
        have = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<string>")).otherwise(F.array(text))
        hit = F.arrays_overlap(have, want) if leaf.op == "ANY" else F.size(F.array_except(want, have)) == 0
        return F.coalesce(hit, F.lit(False))
    if leaf.op == "~":
        return F.coalesce(F.contains(F.lower(text), F.lit(str(leaf.value).lower())), F.lit(False))
    if isinstance(leaf.value, bool):
        same, have, want = kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"), F.lit(leaf.value)
    elif isinstance(leaf.value, int | float):
        same, have, want = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"), F.lit(float(leaf.value))
    else:
        same, have, want = kind == "STRING", text, F.lit(leaf.value)
    if leaf.op == "!=":
        hit = kind.isNotNull() & ~F.coalesce(same & (have == want), F.lit(False))
    else:
        hit = same & {"=": have == want, ">": have > want, ">=": have >= want, "<": have < want, "<=": have <= want}[leaf.op]
    return F.coalesce(hit, F.lit(False))


def compile_filter(meta: Column, tree: object | str) -> Column:
    """The filter as a two-valued Column over a JSON string column."""
    tree = parse(tree) if isinstance(tree, str) else tree
    if isinstance(tree, Leaf):
        return _leaf(meta, tree)
    if isinstance(tree, Not):
        return ~compile_filter(meta, tree.part)
    parts = [compile_filter(meta, p) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(tree, All) else out | p
    return out


def _quoted(x: object) -> str:
    return "'" + (str(x).lower() if isinstance(x, bool) else str(x)).replace("'", "''") + "'"


def to_sql(tree: object | str, meta: str = "metadata", extract: str = "json_extract_string") -> str:
    """The filter as the text of a WHERE clause over JSON, for engines without Columns; the engine here uses compile_filter.

    Looser than that: equality compares texts, order casts to DOUBLE, ~ minds the case, ALL holds for every row, missing fields are null. Quotes in values are doubled. extract names the function that takes the JSON and a path (get_json_object in Spark).
    """
    tree = parse(tree) if isinstance(tree, str) else tree
    if isinstance(tree, Not):
        return f"NOT ({to_sql(tree.part, meta, extract)})"
    if isinstance(tree, All | Any):
        word = " AND " if isinstance(tree, All) else " OR "
        return "(" + word.join(to_sql(p, meta, extract) for p in tree.parts) + ")"
    field = f"{extract}({meta}, {_quoted('$.' + tree.field)})"
    if tree.op in ("=", "!="):
        return f"{field} {tree.op} {_quoted(tree.value)}"
    if tree.op in (">", ">=", "<", "<="):
        return f"CAST({field} AS DOUBLE) {tree.op} {float(tree.value)!r}"
    if tree.op == "~":
        return f"{field} LIKE {_quoted(f'%{tree.value}%')}"
    return "1=1" if tree.op == "ALL" else f"{field} IN ({', '.join(map(_quoted, tree.value))})"


def apply_filter(rows: DataFrame, filter_: object | str, meta: str = "metadata") -> DataFrame:
    return rows.where(compile_filter(F.col(meta), filter_))


#: Field types of a schema and the variant kinds they allow; booleans count as numbers.
FIELD_TYPES = ("TEXT", "DATE", "NUMBER", "ARRAY", "BOOLEAN")


def valid(meta: Column, schema: dict[str, str]) -> Column:
    """Whether every declared field that is present has its type; fields not declared are ignored."""
    v = F.try_parse_json(meta)
    out = F.lit(True)
    for field, kind in schema.items():
        x = F.try_variant_get(v, f"$.{field}", "variant")
        k = F.schema_of_variant(x)
        number = k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL")
        ok = {
            "TEXT": k == "STRING",
            "BOOLEAN": k == "BOOLEAN",
            "NUMBER": number | (k == "BOOLEAN"),
            "ARRAY": k.startswith("ARRAY"),
            "DATE": (k == "STRING") & F.try_to_timestamp(F.regexp_replace(F.try_variant_get(x, "$", "string"), "Z$", "+00:00")).isNotNull(),
        }[kind]
        out = out & (k.isNull() | F.coalesce(ok, F.lit(False)))
    return out
