"""Dates and times: text in, text out, with modifiers; built-in Spark functions only."""

from __future__ import annotations

import re

from tessera.functions.shims import Typed, number, quote, text
from tessera.plans.lexer import SqlError

_UNITS = {"day": "DAY", "hour": "HOUR", "minute": "MINUTE", "month": "MONTH", "year": "YEAR"}


def instant(args: list[Typed], modifiers: list[str]) -> str:
    """A Spark timestamp (session zone UTC) of a time value and its modifiers."""
    x = args[0] if args else (quote("now"), "text")
    sql, kind = x
    first = modifiers[0].lower() if modifiers else ""
    if kind in ("int", "real"):
        if first == "unixepoch":
            ts, modifiers = f"timestamp_micros(CAST({sql} * 1000000 AS BIGINT))", modifiers[1:]
        else:
            ts = f"timestamp_micros(CAST(round((CAST({sql} AS DOUBLE) - 2440587.5D) * 86400000D) AS BIGINT) * 1000L)"
    elif kind == "time":
        ts = f"CAST({sql} AS TIMESTAMP)"
    elif sql == quote("now"):
        ts = "current_timestamp()"
    else:
        # a time alone is on 2000-01-01
        t = text(x)
        ts = f"try_to_timestamp(if({t} RLIKE '^[0-9]{{2}}:', concat('2000-01-01 ', {t}), {t}))"
    for raw in modifiers:
        m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second|month|year)s?\s*", raw, re.I)
        word = raw.strip().lower()
        if m:
            n, unit = float(m[1]), m[2].lower()
            if unit in ("month", "year"):
                # days that a month lacks run on into the next
                months = int(n) * (12 if unit == "year" else 1)
                ts = f"(timestampadd(MONTH, {months}, date_trunc('MONTH', {ts})) + ({ts} - date_trunc('MONTH', {ts})))"
            else:
                seconds = n * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
                ts = f"timestampadd(MICROSECOND, {round(seconds * 1e6)}L, {ts})"
        elif word in ("start of day", "start of month", "start of year"):
            ts = f"date_trunc('{word.split()[-1].upper()}', {ts})"
        elif re.fullmatch(r"weekday [0-6]", word):
            ts = f"timestampadd(DAY, CAST(pmod({word[-1]} - (dayofweek({ts}) - 1), 7) AS INT), {ts})"
        elif word in ("localtime", "utc", "julianday"):
            continue  # the session runs in UTC
        else:
            raise SqlError(f"unknown modifier: {raw}")
    return ts


_FORMATS = {
    "d": "dd", "H": "HH", "j": "DDD", "m": "MM", "M": "mm", "S": "ss", "Y": "yyyy",
}


def strftime(pattern: str, ts: str) -> Typed:
    parts, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c != "%":
            j = pattern.find("%", i)
            j = len(pattern) if j < 0 else j
            parts.append(quote(pattern[i:j]))
            i = j
            continue
        f = pattern[i + 1 : i + 2]
        i += 2
        if f in _FORMATS and f:
            parts.append(f"date_format({ts}, '{_FORMATS[f]}')")
        elif f == "f":
            parts.append(f"date_format({ts}, 'ss.SSS')")
        elif f == "s":
            parts.append(f"CAST(unix_seconds({ts}) AS STRING)")
        elif f == "J":
            parts.append(f"CAST({julianday(ts)[0]} AS STRING)")
        elif f == "w":
            parts.append(f"CAST(dayofweek({ts}) - 1 AS STRING)")
        elif f == "W":
            parts.append(f"lpad(CAST((dayofyear({ts}) + 6 - pmod(dayofweek({ts}) + 5, 7)) div 7 AS STRING), 2, '0')")
        elif f == "%":
            parts.append(quote("%"))
        else:
            return "CAST(NULL AS STRING)", "text"
    return (f"concat({', '.join(parts)})" if parts else quote("")), "text"


def julianday(ts: str) -> Typed:
    return f"(unix_micros({ts}) / 86400000000D + 2440587.5D)", "real"


def call(name: str, args: list[Typed], literals: list[object]) -> Typed:
    """date, time, datetime, julianday or strftime; ``literals`` has the values of constant arguments."""
    at = 1 if name == "strftime" else 0
    modifiers = literals[at + 1 :]
    if any(not isinstance(m, str) for m in modifiers):
        raise SqlError(f"{name}() needs literal modifiers")
    ts = instant(args[at : at + 1], list(modifiers))
    if name == "strftime":
        if not isinstance(literals[0], str):
            raise SqlError("strftime() needs a literal format")
        return strftime(literals[0], ts)
    if name == "julianday":
        return julianday(ts)
    return strftime({"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S"}[name], ts)


NAMES = ("date", "time", "datetime", "julianday", "strftime")
__all__ = ["NAMES", "call", "instant", "julianday", "number", "strftime"]
