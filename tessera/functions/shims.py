"""Dialect semantics that Spark SQL does not have, as Spark SQL text over typed operands.

An operand is (sql, type) with type one of int, real, text, blob, bool, time, null.  All
shims are built-in functions only, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tessera.plans.lexer import SqlError

Typed = tuple[str, str]

_NUMBER = r"^[ \\t\\n\\r\\f]*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"
_FULL_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quote(value: object) -> str:
    """A Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1L" if value else "0L"
    if isinstance(value, int):
        return f"{value}L" if -(1 << 63) < value < 1 << 63 else "(-9223372036854775807L - 1L)" if value == -(1 << 63) else f"{float(value)!r}D"
    if isinstance(value, float):
        if value != value:
            return "NULL"
        return f"double('{'-' if value < 0 else ''}Infinity')" if value in (float("inf"), float("-inf")) else f"{value!r}D"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def type_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, int):
        return "int" if -(1 << 63) <= value < 1 << 63 else "real"
    return "real" if isinstance(value, float) else "blob" if isinstance(value, (bytes, bytearray)) else "text"


def number(x: Typed) -> Typed:
    """Numeric affinity forced: text gives its numeric prefix, else 0; NULL stays."""
    sql, kind = x
    if kind in ("int", "real"):
        return x
    if kind == "bool":
        return f"CAST({sql} AS BIGINT)", "int"
    if kind == "null":
        return "CAST(NULL AS BIGINT)", "int"
    if kind == "time":
        return number((f"CAST({sql} AS STRING)", "text"))
    text = f"CAST({sql} AS STRING)" if kind == "blob" else sql
    return f"if({text} IS NULL, NULL, coalesce(try_cast(regexp_extract({text}, '{_NUMBER}', 1) AS DOUBLE), 0D))", "real"


def integer(x: Typed) -> str:
    sql, kind = number(x)
    if kind == "int":
        return f"CAST({sql} AS BIGINT)"
    return f"CAST(greatest(least(trunc_(x), 9223372036854774784D), -9223372036854775808D) AS BIGINT)".replace("trunc_(x)", sql)


def text(x: Typed) -> str:
    sql, kind = x
    if kind == "text":
        return sql
    if kind == "bool":
        return f"CAST(CAST({sql} AS BIGINT) AS STRING)"
    return f"CAST({sql} AS STRING)"


def value(x: Typed) -> Typed:
    """As a result column: truth values are 0 and 1."""
    return number(x) if x[1] == "bool" else x


def truth(x: Typed) -> str:
    if x[1] == "bool":
        return x[0]
    if x[1] == "null":
        return "CAST(NULL AS BOOLEAN)"
    return f"({number(x)[0]} <> 0)"


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = number(a), number(b)
    whole = a[1] == b[1] == "int"
    if op in "+-*":
        if whole:
            return f"(CAST({a[0]} AS BIGINT) {op} CAST({b[0]} AS BIGINT))", "int"
        return f"nanvl(CAST({a[0]} AS DOUBLE) {op} CAST({b[0]} AS DOUBLE), NULL)", "real"
    if op == "/":
        if whole:
            return f"(CAST({a[0]} AS BIGINT) div nullif(CAST({b[0]} AS BIGINT), 0L))", "int"
        return f"(CAST({a[0]} AS DOUBLE) / nullif(CAST({b[0]} AS DOUBLE), 0D))", "real"
    rest = f"({integer(a)} % nullif({integer(b)}, 0L))"
    return (rest, "int") if whole else (f"CAST({rest} AS DOUBLE)", "real")


def widened(op: str, a: Typed, b: Typed) -> Typed:
    """+ - * of integers that fall to real on overflow; the column is real throughout."""
    name = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}[op]
    x, y = integer(a), integer(b)
    return f"coalesce(CAST({name}({x}, {y}) AS DOUBLE), CAST({x} AS DOUBLE) {op} CAST({y} AS DOUBLE))", "real"


def bitwise(op: str, a: Typed, b: Typed) -> Typed:
    x, y = integer(a), integer(b)
    if op in "&|":
        return f"({x} {op} {y})", "int"
    left, right = f"shiftleft({x}, CAST(%s AS INT))", f"shiftright({x}, CAST(%s AS INT))"
    away = f"if({x} < 0, -1L, 0L)"
    up = f"CASE WHEN {y} >= 64 THEN 0L ELSE {left % y} END"
    down = f"CASE WHEN {y} >= 64 THEN {away} ELSE {right % y} END"
    up_back = f"CASE WHEN {y} <= -64 THEN 0L ELSE {left % f'-({y})'} END"
    down_back = f"CASE WHEN {y} <= -64 THEN {away} ELSE {right % f'-({y})'} END"
    forth, back = (up, down_back) if op == "<<" else (down, up_back)
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {y} >= 0 THEN {forth} ELSE {back} END", "int"


def fold(sql: str) -> str:
    """NOCASE: only ASCII letters are folded."""
    return f"translate({sql}, '{UPPER}', '{LOWER}')"


#: Collations that every engine has: the sort key, as Spark SQL text, of a value.
COLLATIONS: dict[str, Callable[[str], str]] = {"BINARY": lambda sql: sql, "NOCASE": fold, "RTRIM": lambda sql: f"rtrim({sql})"}


def collate(sql: str, name: str | None, known: dict[str, Callable[[str], str]] = COLLATIONS) -> str:
    if name is None:
        return sql
    if name not in known:
        raise SqlError(f"no such collation sequence: {name}")
    return known[name](sql)


def compare(op: str, a: Typed, b: Typed, collation: str | None = None, columns: tuple[bool, bool] = (True, True), known: dict = COLLATIONS) -> Typed:
    """Comparison with affinity; between classes NULL < numbers < text < blob."""
    ranks = {"int": 1, "real": 1, "bool": 1, "text": 2, "blob": 3}
    if "null" in (a[1], b[1]):
        return "CAST(NULL AS BOOLEAN)", "bool"
    a, b = value(a), value(b)
    if "time" in (a[1], b[1]):
        return f"({a[0]} {op} {b[0]})", "bool"
    ra, rb = ranks[a[1]], ranks[b[1]]
    if ra == rb:
        x, y = (collate(a[0], collation, known), collate(b[0], collation, known)) if ra == 2 else (a[0], b[0])
        return f"({x} {op} {y})", "bool"
    if {ra, rb} == {1, 2}:
        flip = ra == 2
        (n, t), n_column, t_column = ((b, a), columns[1], columns[0]) if flip else ((a, b), columns[0], columns[1])
        if t_column and not n_column:  # text affinity
            x, y = collate(text(n), collation, known), collate(t[0], collation, known)
            return (f"({y} {op} {x})" if flip else f"({x} {op} {y})"), "bool"
        if n_column:  # numeric affinity: text that is a number counts as one
            parsed = f"try_cast({t[0]} AS DOUBLE)"
            sides = f"{parsed} {op} {n[0]}" if flip else f"{n[0]} {op} {parsed}"
            other = _constant(op, 2, 1) if flip else _constant(op, 1, 2)
            return f"CASE WHEN {n[0]} IS NULL OR {t[0]} IS NULL THEN NULL WHEN {parsed} IS NULL THEN {other} ELSE {sides} END", "bool"
    return f"CASE WHEN {a[0]} IS NULL OR {b[0]} IS NULL THEN NULL ELSE {_constant(op, ra, rb)} END", "bool"


def _constant(op: str, a: int, b: int) -> str:
    return str({"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]).lower()


def cast(x: Typed, declared: str) -> Typed:
    """CAST by the affinity of the type's name; text gives its numeric prefix, else 0."""
    kind = affinity(declared)
    if kind == "text":
        return text(x), "text"
    if kind == "blob":
        return (x[0], "blob") if x[1] == "blob" else (f"CAST({text(x)} AS BINARY)", "blob")
    if kind == "int":
        if x[1] in ("text", "blob", "time"):
            t = text(x)
            return f"if({t} IS NULL, NULL, coalesce(try_cast(regexp_extract({t}, '^[ \\\\t\\\\n\\\\r\\\\f]*([+-]?[0-9]+)', 1) AS BIGINT), 0L))", "int"
        return integer(x), "int"
    sql, now = number(x)
    if kind == "real":
        return f"CAST({sql} AS DOUBLE)", "real"
    return sql, now


def affinity(declared: str) -> str:
    """Of a declared type: int, text, blob, real or numeric."""
    name = declared.upper()
    if "INT" in name:
        return "int"
    if any(k in name for k in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if "BLOB" in name or not name:
        return "blob"
    if any(k in name for k in ("REAL", "FLOA", "DOUB")):
        return "real"
    return "numeric"


def like(x: str, pattern: str, escape: str | None) -> str:
    """LIKE folds ASCII case only and has no escape character of its own."""
    if escape is None:
        pattern = f"replace({pattern}, '\\\\', '\\\\\\\\')"
        return f"({fold(x)} LIKE {fold(pattern)} ESCAPE '\\\\')"
    return f"({fold(x)} LIKE {fold(pattern)} ESCAPE {escape})"


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB pattern: * ? [...] and [^...], case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            if j < len(pattern) and pattern[j] == "^":
                j += 1
            if j < len(pattern) and pattern[j] == "]":
                j += 1
            while j < len(pattern) and pattern[j] != "]":
                j += 1
            if j >= len(pattern):
                return "(?!)"  # an open class matches nothing
            inside = pattern[i + 1 : j]
            negated = inside.startswith("^")
            inside = inside[1:] if negated else inside
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\[\\]^&~])', r'\\\1', inside.replace(chr(92), chr(92) * 2))}]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)\\A{''.join(out)}\\z"


def glob_column(pattern: str) -> str:
    """The same expression for a pattern that differs from row to row, as Spark SQL text."""
    part = quote(r"(\[\^?\]?[^\]]*\]|(?s:.))")
    escaped = f"regexp_replace(regexp_replace(substr(t, 2, length(t) - 2), '^\\\\^', ''), {quote(r'([\[\]\^&~\\])')}, {quote(r'\\$1')})"
    regex = (
        f"CASE WHEN t = '*' THEN '.*' WHEN t = '?' THEN '.' WHEN length(t) > 1 THEN concat(if(substr(t, 2, 1) = '^', '[^', '['), {escaped}, ']') "
        f"WHEN t = '[' THEN '(?!)' ELSE concat({quote(chr(92) + 'Q')}, t, {quote(chr(92) + 'E')}) END"
    )
    return f"concat({quote('(?s)' + chr(92) + 'A')}, array_join(transform(regexp_extract_all({pattern}, {part}, 1), t -> {regex}), ''), {quote(chr(92) + 'z')})"


def is_number(s: str) -> bool:
    return bool(_FULL_NUMBER.match(s))
