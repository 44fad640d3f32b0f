"""The dialect's scalar functions as Spark SQL text: name -> function of typed operands."""

from __future__ import annotations

from collections.abc import Callable

from tessera.functions.shims import LOWER, UPPER, Typed, glob_regex, integer, like, number, quote, text, value
from tessera.plans.lexer import SqlError

VERSION = "3.7.6.3"


def _common(args: list[Typed]) -> str:
    kinds = {k for _, k in args if k != "null"}
    if not kinds:
        return "null"
    if kinds <= {"int", "bool"}:
        return "int"
    if kinds <= {"int", "bool", "real"}:
        return "real"
    return kinds.pop() if len(kinds) == 1 else "text"


def unify(args: list[Typed]) -> tuple[list[str], str]:
    """Operands brought to one Spark type."""
    kind = _common(args)
    if kind == "text":
        return [text(a) for a in args], kind
    if kind == "real":
        return [f"CAST({number(a)[0]} AS DOUBLE)" for a in args], kind
    if kind == "int":
        return [f"CAST({number(a)[0]} AS BIGINT)" for a in args], kind
    return [a[0] for a in args], kind


def _length(x: Typed) -> Typed:
    return (f"CAST(octet_length({x[0]}) AS BIGINT)" if x[1] == "blob" else f"CAST(char_length({text(x)}) AS BIGINT)"), "int"


def _substr(x: Typed, start: Typed, n: Typed | None = None) -> Typed:
    """Positions count from 1, negative ones from the end; a negative length takes what lies before."""
    s, kind = (x[0], "blob") if x[1] == "blob" else (text(x), "text")
    size = f"CAST({'octet_length' if kind == 'blob' else 'char_length'}({s}) AS BIGINT)"
    at = integer(start)
    first = f"(CASE WHEN {at} < 0 THEN {size} + {at} WHEN {at} > 0 THEN {at} - 1 ELSE -1L END)"
    if n is None:
        low, high = f"if({at} = 0, 0L, {first})", size
    else:
        k = integer(n)
        low, high = f"if({k} < 0, {first} + {k}, {first})", f"if({k} < 0, {first}, {first} + {k})"
    begin, end = f"greatest({low}, 0L)", f"least({high}, {size})"
    return f"substring({s}, CAST({begin} + 1 AS INT), CAST(greatest({end} - {begin}, 0L) AS INT))", kind


def _trim(side: str) -> Callable[..., Typed]:
    def run(x: Typed, chars: Typed | None = None) -> Typed:
        return f"trim({side} {text(chars) if chars else quote(' ')} FROM {text(x)})", "text"

    return run


def _replace(x: Typed, a: Typed, b: Typed) -> Typed:
    return f"CASE WHEN {text(a)} = '' THEN {text(x)} ELSE replace({text(x)}, {text(a)}, {text(b)}) END", "text"


def _quote(x: Typed) -> Typed:
    if x[1] in ("text", "time"):
        return f"coalesce(concat('\\'', replace({text(x)}, '\\'', '\\'\\''), '\\''), 'NULL')", "text"
    if x[1] == "blob":
        return f"coalesce(concat('X\\'', hex({x[0]}), '\\''), 'NULL')", "text"
    return f"coalesce({text(x)}, 'NULL')", "text"


def _typeof(x: Typed) -> Typed:
    name = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "blob": "blob", "time": "text", "null": "null"}[x[1]]
    return f"if({x[0]} IS NULL, 'null', '{name}')", "text"


def _extreme(name: str) -> Callable[..., Typed]:
    def run(*args: Typed) -> Typed:
        sqls, kind = unify(list(args))
        nulls = " OR ".join(f"{s} IS NULL" for s in sqls)
        return f"CASE WHEN {nulls} THEN NULL ELSE {name}({', '.join(sqls)}) END", kind

    return run


def _coalesce(*args: Typed) -> Typed:
    sqls, kind = unify(list(args))
    return f"coalesce({', '.join(sqls)})", kind


def _nullif(a: Typed, b: Typed) -> Typed:
    sqls, kind = unify([a, b])
    return f"nullif({sqls[0]}, {sqls[1]})", kind


def _round(x: Typed, n: Typed | None = None) -> Typed:
    digits = f"CAST({integer(n)} AS INT)" if n else "0"
    return f"round(CAST({number(x)[0]} AS DOUBLE), {digits})", "real"


def _abs(x: Typed) -> Typed:
    sql, kind = number(x)
    return f"abs({sql})", kind


def _glob(pattern: Typed, x: Typed) -> Typed:
    raise SqlError("glob() needs a literal pattern")


def _hex(x: Typed) -> Typed:
    return f"hex({x[0] if x[1] == 'blob' else f'CAST({text(x)} AS BINARY)'})", "text"


FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "abs": _abs,
    "coalesce": _coalesce,
    "hex": _hex,
    "ifnull": _coalesce,
    "length": _length,
    "like": lambda p, x, e=None: (like(text(x), text(p), e[0] if e else None), "bool"),
    "lower": lambda x: (f"translate({text(x)}, '{UPPER}', '{LOWER}')", "text"),
    "ltrim": _trim("LEADING"),
    "max": _extreme("greatest"),
    "min": _extreme("least"),
    "nullif": _nullif,
    "quote": _quote,
    "random": lambda: ("CAST((rand() - 0.5D) * 1.8446744073709550e19D AS BIGINT)", "int"),
    "randomblob": lambda n: (f"unhex(substring(concat_ws('', transform(sequence(1, CAST(greatest({integer(n)}, 1L) AS INT) div 16 + 1), i -> replace(uuid(), '-', ''))), 1, CAST(2 * greatest({integer(n)}, 1L) AS INT)))", "blob"),
    "replace": _replace,
    "regexp": lambda p, x: (f"rlike({text(x)}, {text(p)})", "bool"),
    "round": _round,
    "rtrim": _trim("TRAILING"),
    "soundex": lambda x: (f"coalesce(nullif(soundex({text(x)}), ''), '?000')", "text"),
    "substr": _substr,
    "trim": _trim("BOTH"),
    "typeof": _typeof,
    "upper": lambda x: (f"translate({text(x)}, '{LOWER}', '{UPPER}')", "text"),
    "zeroblob": lambda n: (f"unhex(repeat('00', CAST(greatest({integer(n)}, 0L) AS INT)))", "blob"),
    "sqlite_version": lambda: (quote(VERSION), "text"),
    "sqlite_source_id": lambda: (quote("tessera on Spark"), "text"),
    "sqlite_compileoption_used": lambda x: ("0L", "int"),
    "sqlite_compileoption_get": lambda n: ("CAST(NULL AS STRING)", "text"),
}

__all__ = ["FUNCTIONS", "VERSION", "glob_regex", "unify", "value"]
