"""Total accessors on schemaless JSON rows: nothing here ever fails a job on odd input."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

# scalar texts that count as "nothing there" when picking the first usable of several fields, unless they are strings
_FALSY = ("false", "0", "0.0", "-0")


# columns that hold rows, items and their JSON texts in the format jobs; expressions on them are stated as SQL text,
# which builds a large job's plan many times faster than one call per operator
_NAMED = frozenset(("v", "iv", "rv", "mv", "pv", "m", "ij", "pj", "mj", "raw_json"))


def _named(c: Column) -> str | None:
    name = c._jc.toString()
    return name if name in _NAMED else None


def _is_set_sql(x: str, path: str) -> str:
    s = f"try_variant_get({x}, '{path}', 'string')"
    falsy = ", ".join(f"'{f}'" for f in _FALSY)
    return (f"coalesce({s} <> '' AND ({s} NOT IN ({falsy}) OR schema_of_variant(try_variant_get({x}, '{path}', 'variant')) = 'STRING'), "
            f"false)")


def sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text(v: Column, path: str = "$") -> Column:
    """String form of a value, '' when missing or null (SF01)."""
    n = _named(v)
    if n:
        return F.expr(f"coalesce(try_variant_get({n}, '{path}', 'string'), '')")
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def is_set(v: Column, path: str) -> Column:
    """True for any value but a missing, null, false, zero or empty one."""
    n = _named(v)
    if n:
        return F.expr(_is_set_sql(n, path))
    s = F.try_variant_get(v, path, "string")
    return F.coalesce((s != "") & (~s.isin(*_FALSY) | is_string(sub(v, path))), F.lit(False))


def first_text(v: Column, *paths: str) -> Column:
    """String form of the first set value among the paths, '' if none is set."""
    n = _named(v)
    if n:
        some = ", ".join(f"CASE WHEN {_is_set_sql(n, p)} THEN try_variant_get({n}, '{p}', 'string') END" for p in paths)
        return F.expr(f"coalesce({some}, '')")
    return F.coalesce(*[F.when(is_set(v, p), text(v, p)) for p in paths], F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-empty string among the columns, else ''."""
    empty = F.lit("")
    return F.coalesce(*[F.nullif(c, empty) for c in cols], empty)


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant (SF02)."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def has_keys(v: Column, path: str) -> Column:
    """The value is an object with at least one key."""
    return F.coalesce(F.size(F.try_variant_get(v, path, "map<string,variant>")) > 0, F.lit(False))


def number(v: Column, path: str) -> Column:
    """JSON number at the path, 0 for anything else (strings are not numbers)."""
    x = sub(v, path)
    numeric = F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(v, path, "double")).otherwise(F.lit(0.0))


def long_number(v: Column, path: str) -> Column:
    return number(v, path).cast("bigint")


def items(v: Column, path: str) -> Column:
    """Array of variants, empty when the value is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def item_texts(raw_json: Column, path: str) -> Column:
    """JSON text of each array item, key order as written in the log."""
    return F.from_json(F.get_json_object(raw_json, path), "array<string>")


def first_json_text(raw_json: Column, v: Column, *paths: str) -> Column:
    """Like ``first_text`` but objects and arrays keep the key order of the log."""
    n, j = _named(v), _named(raw_json)
    if n and j:
        get = lambda p: f"try_variant_get({n}, '{p}', 'string')"
        some = ", ".join(f"CASE WHEN {_is_set_sql(n, p)} THEN CASE WHEN {get(p)} RLIKE r'^[\\[{{]' THEN get_json_object({j}, '{p}') "
                         f"ELSE {get(p)} END END" for p in paths)
        return F.expr(f"coalesce({some}, '')")

    def one(p: str) -> Column:
        s = text(v, p)
        return F.when(is_set(v, p), F.when(s.rlike(r"^[\[{]"), F.get_json_object(raw_json, p)).otherwise(s))
    return F.coalesce(*[one(p) for p in paths], F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


# Generated SQL from here on: nested lambdas over variants are far shorter to state as text. ``x`` is an SQL expression.

def _get(x: str, path: str, typ: str = "string") -> str:
    return f"try_variant_get({x}, '{path}', '{typ}')"


def _item_blocks_sql(x: str, depth: int) -> str:
    typ, plain = _get(x, "$.type"), _get(x, "$.text")
    usable = ", ".join(f"CASE WHEN {_get(x, '$.' + f)} NOT IN ('', '{{}}', '[]') THEN {_get(x, '$.' + f, 'variant')} END"
                       for f in ("text", "content", "result", "output", "input"))
    inner = f"CASE WHEN {typ} = 'tool_result' THEN {_get(x, '$.content', 'variant')} ELSE coalesce({usable}) END"
    n, r = f"n{depth}", f"r{depth}"
    pair = f"transform(array({inner}), {n} -> struct({_blocks_sql(n, depth - 1)} AS b, coalesce({_get(n, '$')}, '') AS t))[0]"
    pick = (f"transform(array({pair}), {r} -> CASE WHEN size({r}.b) > 0 THEN {r}.b WHEN {r}.t IN ('', '[]') THEN "
            f"CAST(array() AS array<string>) ELSE array({r}.t) END)[0]")
    return (f"CASE WHEN {typ} IN ('text', 'input_text', 'output_text') THEN "
            f"CASE WHEN {plain} <> '' THEN array({plain}) ELSE CAST(array() AS array<string>) END ELSE {pick} END")


def _blocks_sql(x: str, depth: int) -> str:
    if depth == 0:
        return "CAST(array() AS array<string>)"
    i = f"i{depth}"
    return (f"coalesce(flatten(transform({_get(x, '$', 'array<variant>')}, {i} -> {_item_blocks_sql(i, depth)})), "
            f"CASE WHEN schema_of_variant({x}) = 'STRING' AND {_get(x, '$')} <> '' THEN array({_get(x, '$')}) END, "
            f"CAST(array() AS array<string>))")


_LEVELS = 4   # nesting that SQL unrolls; content nested deeper is finished by ``nested_blocks``


def _plain(x) -> str:
    """The string form of a JSON value as a variant gives it, objects in the order of the log."""
    if isinstance(x, str):
        return x
    return "" if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def nested_blocks(x) -> list[str]:
    """Text blocks of content of any depth: a string, or a list of items."""
    if isinstance(x, str):
        return [x] if x else []
    return [b for i in x for b in _blocks_of_item(i)] if isinstance(x, list) else []


def _blocks_of_item(item) -> list[str]:
    """A text item's text; for others the blocks of their content, or its string form if it has none."""
    if not isinstance(item, dict):
        return []
    kind = item.get("type")
    if kind in ("text", "input_text", "output_text"):
        return [t] if (t := _plain(item.get("text"))) else []
    inner = item.get("content") if kind == "tool_result" else next(
        (item[f] for f in ("text", "content", "result", "output", "input") if _plain(item.get(f)) not in ("", "{}", "[]")), None)
    return nested_blocks(inner) or ([t] if (t := _plain(inner)) not in ("", "[]") else [])


def _deep(value: Column, arrays: int, item: bool) -> tuple[Column, Column]:
    """Whether JSON text may nest more arrays than SQL unrolls, and the blocks of those rows alone, in batches."""
    @pandas_udf("array<string>")
    def blocks(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else nested_blocks([json.loads(r)] if item else json.loads(r)))
    deep = F.coalesce(value.rlike(r"(?s)^[\[{](?:[^\[]*\[){%d}" % arrays), F.lit(False))
    return deep, blocks(F.when(deep, value))


def item_blocks(column: str) -> Column:
    """Text blocks of one content item held by a variant column."""
    deep, blocks = _deep(F.expr(_get(column, "$")), _LEVELS, True)
    return F.when(deep, blocks).otherwise(F.expr(_item_blocks_sql(column, _LEVELS)))


def text_blocks(column: str, path: str = "$") -> Column:
    """Text blocks of nested message content below a path of a variant column (SF10).

    The usual levels are unrolled in SQL. Only content with more arrays than these levels take goes to a batched function,
    which has no limit.
    """
    deep, blocks = _deep(F.expr(_get(column, path)), _LEVELS, False)
    flat = F.expr(f"transform(array({_get(column, path, 'variant')}), z -> {_blocks_sql('z', _LEVELS)})[0]")
    return F.when(deep, blocks).otherwise(flat)
