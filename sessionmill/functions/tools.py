"""Tool type dialects, reasoning text, error flags and roles (SF09, SF11, SF12, SF13, SF17)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as X

# Tool names (lower case, separators removed) and their types, per dialect.
_SHELL = {"execcommand": "bash", "shellcommand": "bash"}
_SHELL_IO = {**_SHELL, "writestdin": "bash", "commandexecution": "bash"}
_WEB = {"websearch": "websearch", "webfetch": "webfetch"}
_WEB_ALIASES = {**_WEB, "googlewebsearch": "websearch", "fetchurl": "webfetch", "openurl": "webfetch"}
DIALECTS: dict[str, dict[str, str]] = {
    "claude": {**_WEB, **_SHELL_IO, "applypatch": "patch", "requestuserinput": "input", "updateplan": "plan",
               "viewimage": "image", "multiedit": "edit", "todoread": "todo", "todowrite": "todo"},
    "opencode": {**_SHELL_IO, "bash": "bash", "applypatch": "patch", "patch": "patch", "askuserquestion": "input",
                 "requestuserinput": "input", "updateplan": "plan", "todoread": "todo", "todowrite": "todo",
                 "read": "read", "edit": "edit", "multiedit": "edit", "write": "write",
                 "webfetch": "web:open", "websearch": "web:search"},
    "gemini": {**_WEB_ALIASES, **_SHELL_IO, "bash": "bash", "applypatch": "patch", "patch": "patch"},
    "pi": {**_WEB_ALIASES, **_SHELL, "bash": "bash", "applypatch": "patch", "patch": "patch", "read": "read",
           "write": "write", "edit": "edit", "multiedit": "edit"},
}
# Exact names of the dialect that keeps its separators.
EXACT = {"exec_command": "bash", "shell_command": "bash", "write_stdin": "bash", "command_execution": "bash",
         "apply_patch": "patch", "request_user_input": "input", "update_plan": "plan", "view_image": "image"}
# Substrings of the dialect with free tool names, first hit wins.
SUBSTRINGS = (("read", "read"), ("write", "write"), ("replace|edit|patch", "edit"), ("search", "search"),
              ("bash|command|terminal", "bash"))
WEB_ACTIONS = {"search": "web:search", "open_page": "web:open", "find_in_page": "web:find"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def tool_type(name: Column, dialect: str) -> Column:
    low = F.lower(X.strip(name))
    if dialect == "codex":
        return F.coalesce(_lookup(EXACT, low), low)
    if dialect == "cursor":
        key = F.regexp_replace(low, r"\s+", "_")
        out = F.when(key == "", F.lit(""))
        for pattern, typ in SUBSTRINGS:
            out = out.when(key.rlike(pattern), F.lit(typ))
        return out.otherwise(key)
    squeezed = F.regexp_replace(low, r"[\s_-]+", "")
    return F.when(low == "", F.lit("")).otherwise(
        F.coalesce(_lookup(DIALECTS[dialect], squeezed), F.regexp_replace(low, r"\s+", "_")))


def web_tool_type(action: Column) -> Column:
    return F.coalesce(_lookup(WEB_ACTIONS, F.lower(F.trim(action))), F.lit("web"))


def kind_of_role(role: Column) -> Column:
    r = F.lower(F.trim(role))
    return (F.when(r.isin("system", "developer"), F.lit("system")).when(r == "user", F.lit("user"))
            .otherwise(F.lit("assistant")))


def status_is_error(status: Column) -> Column:
    return F.lower(status).rlike("error|fail")


def _summary_sql(x: str) -> str:
    """Texts of the summary items of a value: of the array, of the object itself, or of its content array."""
    get = lambda y, p, t="string": f"try_variant_get({y}, '{p}', '{t}')"
    none = "CAST(array() AS array<variant>)"
    every = (f"concat(coalesce({get(x, '$', 'array<variant>')}, {none}), CASE WHEN {get(x, '$', 'map<string,variant>')} IS NOT NULL "
             f"THEN array({x}) ELSE {none} END, coalesce({get(x, '$.content', 'array<variant>')}, {none}))")
    return (f"filter(transform(filter({every}, a -> lower({get('a', '$.type')}) = 'summary_text'), "
            f"a -> coalesce(trim({get('a', '$.text')}), '')), t -> t <> '')")


def reasoning_text(column: str, raw_json: Column, *paths: str) -> Column:
    """Summary of a reasoning item of a variant column; a summary may be given as JSON inside a string.

    Falls back to compact text, then to the next path.
    """
    def candidate(path: str) -> Column:
        value = f"try_variant_get({column}, '{path}', 'variant')"
        inner = f"try_parse_json(CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get({column}, '{path}', 'string') END)"
        found = (f"get(filter(transform(array({value}, {inner}), x -> {_summary_sql('x')}), e -> size(e) > 0), 0)")
        summary = F.expr(f"transform(array({found}), h -> CASE WHEN h IS NOT NULL THEN concat('Summary: ', array_join(h, ' ')) END)[0]")
        return F.coalesce(summary, F.nullif(X.compact(F.get_json_object(raw_json, path)), F.lit("")))
    return F.coalesce(*[candidate(p) for p in paths], F.lit(""))
