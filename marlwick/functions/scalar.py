"""The dialect's scalar functions as Spark SQL templates.

A template takes argument expressions with their static types and gives an
expression with its type. Types are int, real, text, blob, bool, ts (a native
timestamp, accepted where the dialect has text), json (text whose class is only
known at run time) and null. Everything here stays in the JVM except what is
registered by ``register`` at the bottom.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Typed = tuple[str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: SQL types of the dialect's classes.
SQL_TYPE = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "bool": "BIGINT", "ts": "TIMESTAMP", "json": "STRING", "null": "STRING"}
NUMBER = "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"


class DialectError(ValueError):
    """A statement that the dialect refuses."""


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold(sql: str) -> str:
    """ASCII letters in lower case; other letters as they are."""
    return f"translate({sql}, '{UPPER}', '{LOWER}')"


def as_text(e: Typed) -> str:
    sql, ty = e
    if ty in ("text", "json"):
        return sql
    if ty == "bool":
        return f"CAST(CAST({sql} AS BIGINT) AS STRING)"
    if ty == "ts":
        return f"date_format({sql}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({sql} AS STRING)"


def as_number(e: Typed) -> Typed:
    sql, ty = e
    if ty == "json":
        return f"try_cast({sql} AS DOUBLE)", "real"
    if ty == "bool":
        return f"CAST({sql} AS BIGINT)", "int"
    if ty == "null":
        return f"CAST({sql} AS BIGINT)", "int"
    return e


def as_real(e: Typed) -> str:
    sql, ty = as_number(e)
    if ty == "real":
        return sql
    return f"CAST({sql} AS DOUBLE)" if ty == "int" else "CAST(NULL AS DOUBLE)"


def cast(e: Typed, to: str) -> Typed:
    """CAST with numeric prefixes: text without one gives 0; reals lose their fraction."""
    sql, ty = e
    if to == "text":
        return (f"decode({sql}, 'UTF-8')" if ty == "blob" else as_text(e)), "text"
    if to == "blob":
        return (sql if ty == "blob" else f"encode({as_text(e)}, 'UTF-8')"), "blob"
    if ty in ("text", "json", "blob"):
        text = f"decode({sql}, 'UTF-8')" if ty == "blob" else sql
        prefix = f"regexp_extract({text}, {quote(f'^[ \\t\\n\\r]*({NUMBER})')}, 1)"
        value = f"coalesce(try_cast(nullif({prefix}, '') AS DOUBLE), 0D)"
        if to == "real":
            return f"CASE WHEN {text} IS NOT NULL THEN {value} END", "real"
        whole = f"try_cast(nullif(regexp_extract({text}, {quote('^[ \\t\\n\\r]*([+-]?[0-9]+)')}, 1), '') AS BIGINT)"
        return f"CASE WHEN {text} IS NOT NULL THEN coalesce({whole}, 0L) END", "int"
    if ty == "ts":
        return f"CAST(date_format({sql}, 'yyyy') AS {'BIGINT' if to == 'int' else 'DOUBLE'})", to
    return f"CAST({sql} AS {SQL_TYPE[to]})", to


def glob_regex(pattern: str) -> str:
    """A regex for a GLOB pattern: * and ? are wild, all else (also brackets) stands for itself."""
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", c) for c in pattern) + ")$"


# ---- dates -------------------------------------------------------------------------------------

def timestamp(e: Typed) -> str:
    """A timestamp from the accepted forms of text, or null."""
    sql, ty = e
    if ty == "ts":
        return f"CAST({sql} AS TIMESTAMP)"
    if ty in ("int", "real"):
        sql = f"CAST({sql} AS STRING)"
    elif ty not in ("text", "json"):
        return "CAST(NULL AS TIMESTAMP)"
    day = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    clock = "[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
    number = f"try_cast({sql} AS DOUBLE)"
    return (
        f"CASE WHEN lower({sql}) = 'now' THEN current_timestamp() "
        f"WHEN {sql} RLIKE '^{day}([ T]{clock})?$' THEN try_to_timestamp({sql}) "
        f"WHEN {sql} RLIKE '^{clock}$' THEN try_to_timestamp(concat('2000-01-01 ', {sql})) "
        f"WHEN {sql} RLIKE '^[0-9]+[.][0-9]+$' AND {number} > 1000 THEN timestamp_micros(CAST(round(({number} - 2440587.5D) * 86400D) AS BIGINT) * 1000000L) "
        f"WHEN {number} IS NOT NULL THEN timestamp_seconds(CAST({number} AS BIGINT)) END"
    )


DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def strftime(args: list[Typed]) -> Typed:
    (form, _), *rest = args
    if len(rest) != 1 or not re.fullmatch(r"'(?:[^'\\]|\\.)*'", form):
        return "CAST(NULL AS STRING)", "text"
    at, parts = timestamp(rest[0]), []
    for x in re.findall(r"%.|[^%]+|%", form[1:-1]):
        if x in DATE_PARTS:
            parts.append(f"date_format({at}, '{DATE_PARTS[x]}')")
        elif x == "%f":
            parts.append(f"date_format({at}, 'ss.SSS')")
        elif x == "%j":
            parts.append(f"lpad(CAST(dayofyear({at}) AS STRING), 3, '0')")
        elif x == "%s":
            parts.append(f"CAST(unix_seconds({at}) AS STRING)")
        else:
            parts.append("'%'" if x == "%%" else f"'{x}'")
    return f"CASE WHEN {at} IS NOT NULL THEN concat({', '.join(parts) or chr(39) * 2}) END", "text"


def _date(form: str) -> Callable[[list[Typed]], Typed]:
    # Any modifier makes the result null; that is the dialect's own rule.
    return lambda a: (f"date_format({timestamp(a[0])}, '{form}')" if len(a) == 1 else "CAST(NULL AS STRING)", "text")


# ---- JSON --------------------------------------------------------------------------------------

def _variant(args: list[Typed]) -> str:
    value = f"try_parse_json({as_text(args[0])})"
    return f"try_variant_get({value}, {args[1][0]}, 'variant')" if len(args) > 1 else value


def json_extract(args: list[Typed]) -> Typed:
    path = args[1][0]
    if not path.startswith("'") or "-" in path:
        return f"dialect_json_extract({as_text(args[0])}, {path})", "json"
    at = _variant(args)
    return (
        f"CASE WHEN schema_of_variant({at}) = 'BOOLEAN' THEN IF(try_variant_get({at}, '$', 'boolean'), '1', '0') "
        f"WHEN schema_of_variant({at}) = 'VOID' THEN NULL ELSE CAST({at} AS STRING) END"
    ), "json"


def json_type(args: list[Typed]) -> Typed:
    if len(args) > 1 and (not args[1][0].startswith("'") or "-" in args[1][0]):
        return f"dialect_json_type({as_text(args[0])}, {args[1][0]})", "text"
    at = _variant(args)
    kind = f"schema_of_variant({at})"
    return (
        f"CASE WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} = 'BOOLEAN' THEN IF(CAST({at} AS BOOLEAN), 'true', 'false') "
        f"WHEN {kind} = 'BIGINT' THEN 'integer' WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} LIKE 'OBJECT%' THEN 'object' "
        f"WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} IS NOT NULL THEN 'real' END"
    ), "text"


def _json_value(e: Typed) -> str:
    sql, ty = e
    if ty in ("text", "ts"):
        return f"coalesce(to_json(named_struct('v', {as_text(e)}), map('ignoreNullFields', 'false')), '{{\"v\":null}}')"
    return f"to_json(named_struct('v', {as_number(e)[0] if ty != 'json' else sql}), map('ignoreNullFields', 'false'))"


def _json_part(e: Typed) -> str:
    # {"v":x} without its frame is the JSON form of x.
    return f"regexp_extract({_json_value(e)}, {quote('^(?s)[{]\"v\":(.*)[}]$')}, 1)"


def json_array(args: list[Typed]) -> Typed:
    return f"concat('[', concat_ws(',', array({', '.join(map(_json_part, args))})), ']')" if args else "'[]'", "text"


def json_object(args: list[Typed]) -> Typed:
    if len(args) % 2:
        raise DialectError("json_object() takes pairs")
    pairs = [f"concat({_json_part((as_text(k), 'text'))}, ':', {_json_part(v)})" for k, v in zip(args[::2], args[1::2], strict=True)]
    return (f"concat('{{', concat_ws(',', array({', '.join(pairs)})), '}}')" if pairs else "'{}'"), "text"


def _json_edit(name: str) -> Callable[[list[Typed]], Typed]:
    def made(args: list[Typed]) -> Typed:
        rest = [as_text(a) if i % 2 == 0 or name == "remove" else _json_part(a) for i, a in enumerate(args[1:])]
        return f"dialect_json_edit('{name}', {as_text(args[0])}, array({', '.join(rest)}))", "text"

    return made


# ---- numbers and strings -----------------------------------------------------------------------

def _real(form: str) -> Callable[[list[Typed]], Typed]:
    return lambda a: (form.format(*map(as_real, a)), "real")


def _text(form: str, ty: str = "text") -> Callable[[list[Typed]], Typed]:
    def made(a: list[Typed]) -> Typed:
        if a[0][1] not in ("text", "json", "ts", "null"):
            return f"CAST(NULL AS {SQL_TYPE[ty]})", ty
        return form.format(*(as_text(x) if x[1] in ("text", "json", "ts", "null") else x[0] for x in a)), ty

    return made


def _length(a: list[Typed]) -> Typed:
    sql, ty = a[0]
    if ty == "blob":
        return f"CAST(octet_length({sql}) AS BIGINT)", "int"
    return (f"CAST(char_length({as_text(a[0])}) AS BIGINT)" if ty in ("text", "json", "ts") else "CAST(NULL AS BIGINT)"), "int"


def _abs(a: list[Typed]) -> Typed:
    sql, ty = as_number(a[0])
    return (f"abs({sql})", ty) if ty in ("int", "real") else ("CAST(NULL AS BIGINT)", "int")


def _typeof(a: list[Typed]) -> Typed:
    sql, ty = a[0]
    name = {"int": "integer", "bool": "integer", "real": "real", "blob": "blob", "null": "null"}.get(ty, "text")
    return f"CASE WHEN {sql} IS NULL THEN 'null' ELSE '{name}' END", "text"


def _hex(a: list[Typed]) -> Typed:
    sql, ty = a[0]
    return f"coalesce(hex({sql if ty == 'blob' else as_text(a[0])}), '')", "text"


def _char(a: list[Typed]) -> Typed:
    # A code point in UTF-32 is four bytes, so decoding them gives the letter for all planes.
    parts = [f"decode(unhex(lpad(hex({as_number(x)[0]}), 8, '0')), 'UTF-32')" for x in a]
    return f"concat({', '.join(parts)})" if parts else "''", "text"


def _printf(a: list[Typed]) -> Typed:
    form = a[0][0]
    if not form.startswith("'"):
        raise DialectError("printf() wants a literal format")
    out, rest = [], list(a[1:])
    for x in re.findall(r"%%|%[-0+ ]*[0-9]*(?:[.][0-9]+)?[a-zA-Z]|[^%]+|%", form[1:-1]):
        kind = x[-1]
        if x[0] != "%" or len(x) == 1 or x == "%%":
            out.append("'%'" if x in ("%%", "%") else f"'{x}'")
            continue
        value = rest.pop(0) if rest else ("NULL", "null")
        if kind in "di":
            out.append(f"format_string('{x[:-1]}d', coalesce({cast(value, 'int')[0]}, 0L))")
        elif kind in "fgeE":
            out.append(f"format_string('{x}', coalesce({cast(value, 'real')[0]}, 0D))")
        elif kind in "xX":
            out.append(f"format_string('{x}', coalesce({cast(value, 'int')[0]}, 0L))")
        elif kind == "q":
            out.append(f"replace(coalesce({as_text(value)}, ''), '\\'', '\\'\\'')")
        else:
            out.append(f"format_string('{x[:-1]}s', coalesce({as_text(value)}, ''))")
    return f"concat({', '.join(out)})" if out else "''", "text"


def _trim(side: str) -> Callable[[list[Typed]], Typed]:
    return lambda a: _text("trim(" + side + " {1} FROM {0})" if len(a) > 1 else "trim(" + side + " ' ' FROM {0})")(a)


def _round(a: list[Typed]) -> Typed:
    digits = as_number(a[1])[0] if len(a) > 1 else "0"
    return f"CAST(round({as_real(a[0])}, CAST({digits} AS INT)) AS DOUBLE)", "real"


def _trunc(a: list[Typed]) -> Typed:
    x = as_real(a[0])
    scale = f"pow(10D, {as_real(a[1])})" if len(a) > 1 else "1D"
    return f"(signum({x}) * floor(abs({x}) * {scale}) / {scale})", "real"


def _common(a: list[Typed]) -> Typed:
    kinds = {ty for _, ty in a if ty != "null"}
    if not kinds:
        return f"coalesce({', '.join(s for s, _ in a)})", "null"
    if kinds <= {"int", "bool"}:
        return f"coalesce({', '.join(as_number(x)[0] for x in a)})", "int"
    if kinds <= {"int", "bool", "real"}:
        return f"coalesce({', '.join(map(as_real, a))})", "real"
    if len(kinds) == 1:
        return f"coalesce({', '.join(s for s, _ in a)})", kinds.pop()
    return f"coalesce({', '.join(map(as_text, a))})", "text"


#: name: (least and most arguments, template)
FUNCTIONS: dict[str, tuple[int, int, Callable[[list[Typed]], Typed]]] = {
    "LENGTH": (1, 1, _length),
    "LOWER": (1, 1, _text("lower({0})")),
    "UPPER": (1, 1, _text("upper({0})")),
    "SUBSTR": (2, 3, lambda a: _text("substring({0}, CAST({1} AS INT), CAST({2} AS INT))" if len(a) > 2 else "substring({0}, CAST({1} AS INT))")(a)),
    "TRIM": (1, 2, _trim("BOTH")),
    "LTRIM": (1, 2, _trim("LEADING")),
    "RTRIM": (1, 2, _trim("TRAILING")),
    "REPLACE": (3, 3, lambda a: _text("CASE WHEN {1} = '' THEN {0} ELSE replace({0}, {1}, {2}) END")(a)),
    "INSTR": (2, 2, lambda a: (f"CAST(instr({as_text(a[0])}, {as_text(a[1])}) AS BIGINT)", "int")),
    "COALESCE": (1, 99, _common),
    "IFNULL": (2, 2, _common),
    "TYPEOF": (1, 1, _typeof),
    "HEX": (1, 1, _hex),
    "CHAR": (0, 99, _char),
    "UNICODE": (1, 1, _text("CAST(ascii(nullif({0}, '')) AS BIGINT)", "int")),
    "PRINTF": (1, 99, _printf),
    "FORMAT": (1, 99, _printf),
    "ZEROBLOB": (1, 1, lambda a: (f"unhex(repeat('00', CAST({as_number(a[0])[0]} AS INT)))", "blob")),
    "RANDOMBLOB": (1, 1, lambda a: (f"unhex(substring(repeat(replace(uuid(), '-', ''), CAST({as_number(a[0])[0]} AS INT) div 16 + 1), 1, 2 * CAST({as_number(a[0])[0]} AS INT)))", "blob")),
    "ABS": (1, 1, _abs),
    "ROUND": (1, 2, _round),
    "CEIL": (1, 1, _real("CAST(ceil({0}) AS DOUBLE)")),
    "CEILING": (1, 1, _real("CAST(ceil({0}) AS DOUBLE)")),
    "FLOOR": (1, 1, _real("CAST(floor({0}) AS DOUBLE)")),
    "SQRT": (1, 1, _real("sqrt({0})")),
    "POW": (2, 2, _real("pow({0}, {1})")),
    "POWER": (2, 2, _real("pow({0}, {1})")),
    "EXP": (1, 1, _real("exp({0})")),
    "LN": (1, 1, _real("ln({0})")),
    "LOG": (1, 2, lambda a: (f"log({as_real(a[0])}, {as_real(a[1])})" if len(a) > 1 else f"ln({as_real(a[0])})", "real")),
    "LOG2": (1, 1, _real("log2({0})")),
    "LOG10": (1, 1, _real("log10({0})")),
    "SIGN": (1, 1, lambda a: (f"CAST(signum({as_real(a[0])}) AS BIGINT)", "int")),
    "TRUNC": (1, 2, _trunc),
    "TRUNCATE": (1, 2, _trunc),
    "PI": (0, 0, lambda a: ("pi()", "real")),
    **{n: (1, 1, _real(n.lower() + "({0})")) for n in ("SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "DEGREES", "RADIANS")},
    "ATAN2": (2, 2, _real("atan2({0}, {1})")),
    "RANDOM": (0, 0, lambda a: ("xxhash64(rand())", "int")),
    "DATE": (1, 99, _date("yyyy-MM-dd")),
    "TIME": (1, 99, _date("HH:mm:ss")),
    "DATETIME": (1, 99, _date("yyyy-MM-dd HH:mm:ss")),
    "JULIANDAY": (1, 99, lambda a: (f"(unix_micros({timestamp(a[0])}) / 86400000000D + 2440587.5D)" if len(a) == 1 else "CAST(NULL AS DOUBLE)", "real")),
    "UNIXEPOCH": (1, 99, lambda a: (f"unix_seconds({timestamp(a[0])})" if len(a) == 1 else "CAST(NULL AS BIGINT)", "int")),
    "STRFTIME": (1, 99, strftime),
    "JSON_EXTRACT": (2, 2, json_extract),
    "JSON_TYPE": (1, 2, json_type),
    "JSON_VALID": (1, 1, lambda a: (f"CASE WHEN {as_text(a[0])} IS NOT NULL THEN CAST(try_parse_json({as_text(a[0])}) IS NOT NULL AS BIGINT) END", "int")),
    "JSON_ARRAY": (0, 99, json_array),
    "JSON_OBJECT": (0, 98, json_object),
    "JSON_SET": (3, 99, _json_edit("set")),
    "JSON_INSERT": (3, 99, _json_edit("insert")),
    "JSON_REPLACE": (3, 99, _json_edit("replace")),
    "JSON_REMOVE": (2, 99, _json_edit("remove")),
    "SQLITE_VERSION": (0, 0, lambda a: ("version()", "text")),
}


def call(name: str, args: list[Typed]) -> Typed:
    least, most, template = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise DialectError(f"{name}() takes {least} to {most} arguments")
    return template(args)


def fn(name: str, *args: tuple[str, str]) -> Column:
    """The function for DataFrame code: ``fn("SUBSTR", ("name", "text"), ("2", "int"))``."""
    return F.expr(call(name.upper(), list(args))[0])


def register(spark: SparkSession) -> None:
    """Vectorised functions for what has no JVM form: JSON edits and paths with negative indexes."""
    if getattr(spark, "_marlwick_functions", False):
        return
    from pyspark.sql.functions import pandas_udf

    from . import json_paths

    @pandas_udf("string")
    def extract(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([json_paths.extract(t, p) for t, p in zip(text, path, strict=True)], dtype=object)

    @pandas_udf("string")
    def kind(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([json_paths.kind(t, p) for t, p in zip(text, path, strict=True)], dtype=object)

    @pandas_udf("string")
    def edit(name: pd.Series, text: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([json_paths.edit(n, t, None if c is None else list(c)) for n, t, c in zip(name, text, changes, strict=True)], dtype=object)

    for name, f in (("dialect_json_extract", extract), ("dialect_json_type", kind), ("dialect_json_edit", edit)):
        spark.udf.register(name, f)
    spark._marlwick_functions = True
