"""A thin shell: statements end with a semicolon, lines that begin with a dot are commands."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable, Iterator

from tessera.engine import Engine
from tessera.plans.lexer import SqlError, split_statements
from tessera.sources import delimited, formats, storage

HELP = {
    ".backup": "?DB? FILE  copy all tables to folder FILE", ".bail": "ON|OFF  stop after an error", ".databases": "list attached databases",
    ".dump": "?TABLE? ...  the database as SQL", ".echo": "ON|OFF  show statements", ".exit": "leave", ".explain": "ON|OFF  plan instead of rows",
    ".header": "ON|OFF  show column names", ".headers": "ON|OFF  show column names", ".help": "this message", ".import": "FILE TABLE  lines of FILE into TABLE",
    ".indices": "?TABLE?  names of indexes", ".mode": "MODE ?TABLE?  output mode", ".nullvalue": "STRING  text for NULL", ".output": "FILENAME  where results go",
    ".prompt": "MAIN CONTINUE  prompts", ".quit": "leave", ".read": "FILENAME  run a script", ".restore": "?DB? FILE  tables from folder FILE",
    ".schema": "?TABLE?  CREATE statements", ".separator": "STRING  between columns", ".show": "settings", ".stats": "ON|OFF  rows changed", ".tables": "?PATTERN?  names of tables",
    ".timeout": "MS  accepted, without effect", ".timer": "ON|OFF  seconds by statement", ".width": "NUM ...  column widths",
}


class Shell:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.mode, self.table, self.header, self.separator, self.null = "list", "table", False, "|", ""
        self.widths: list[int] = []
        self.echo = self.bail = self.explain = self.timer = self.stats = False
        self.out = sys.stdout
        self.done = False

    def run(self, lines: Iterable[str]) -> None:
        held = ""
        for line in lines:
            if self.done:
                return
            if not held.strip() and line.strip().startswith("."):
                for x in self._guard(lambda: self.command(line.strip())):
                    print(x, file=self.out)
                continue
            held += line if line.endswith("\n") else line + "\n"
            if held.rstrip().endswith(";"):
                for x in self._guard(lambda: self.statements(held)):
                    print(x, file=self.out)
                held = ""
        if held.strip():
            for x in self._guard(lambda: self.statements(held)):
                print(x, file=self.out)

    def _guard(self, make) -> Iterator[str]:
        try:
            yield from make()
        except SqlError as e:
            yield f"Error: {e}"
            self.done = self.done or self.bail

    def statements(self, text: str) -> Iterator[str]:
        for s in split_statements(text):
            if self.echo:
                yield s + ";"
            begin = time.perf_counter()
            rows = self.engine.sql(f"EXPLAIN QUERY PLAN {s}" if self.explain else s)
            if rows.columns != ["changes"]:
                yield from formats.render(rows, self.mode, self.header, self.separator, self.null, self.widths, self.table)
            elif self.stats:
                yield f"{self.engine.changes} rows changed"
            if self.timer:
                yield f"CPU Time: {time.perf_counter() - begin:.6f}"

    def command(self, line: str) -> Iterator[str]:
        import shlex

        name, *args = shlex.split(line)
        on = bool(args) and args[0].lower() in ("on", "yes", "1", "true")
        e = self.engine
        if name in (".exit", ".quit"):
            self.done = True
        elif name == ".help":
            yield from (f"{k} {v}" for k, v in HELP.items())
        elif name in (".bail", ".echo", ".explain", ".timer", ".stats"):
            setattr(self, name[1:], on)
        elif name in (".header", ".headers"):
            self.header = on
        elif name == ".mode":
            if not args or args[0] not in formats.MODES:
                raise SqlError(f"mode should be one of: {' '.join(formats.MODES)}")
            self.mode, self.table = args[0], args[1] if len(args) > 1 else self.table
        elif name == ".separator":
            self.separator = args[0].encode().decode("unicode_escape")
        elif name == ".nullvalue":
            self.null = args[0] if args else ""
        elif name == ".width":
            self.widths = [int(a) for a in args]
        elif name == ".output":
            self.out = sys.stdout if not args or args[0] == "stdout" else open(args[0], "w")  # noqa: SIM115
        elif name == ".import":
            delimited.import_delimited(e, args[0], args[1], self.separator)
        elif name == ".read":
            yield from self.statements("".join(r[0] + "\n" for r in e.spark.read.text(args[0], wholetext=True).toLocalIterator()))
        elif name == ".dump":
            yield from formats.dump(e, args or None)
        elif name in (".backup", ".restore"):
            for t in list(e.tables.values()):
                if name == ".backup":
                    storage.backup(t.df, f"{args[-1]}/{t.name}")
                else:
                    e.restore(t.name, storage.restore(e.spark, f"{args[-1]}/{t.name}"))
        elif name == ".tables":
            yield from sorted(n for n in [*(t.name for t in e.tables.values()), *e.views] if not args or args[0].strip("%") in n)
        elif name == ".schema":
            yield from (t.sql.rstrip(";") + ";" for t in e.tables.values() if t.sql and (not args or t.name == args[0]))
        elif name == ".indices":
            yield from (n for n, i in e.indexes.items() if not args or i["table"] == args[0])
        elif name == ".databases":
            yield from formats.render(e.sql("PRAGMA database_list"), "list", separator=self.separator)
        elif name == ".show":
            yield from (f"{k:>9}: {v}" for k, v in (("echo", self.echo), ("explain", self.explain), ("headers", self.header), ("mode", self.mode), ("nullvalue", self.null), ("separator", self.separator), ("stats", self.stats), ("width", self.widths)))
        elif name not in (".timeout", ".prompt"):
            raise SqlError(f'unknown command or invalid arguments: "{name[1:]}". Enter ".help" for help')


def main() -> None:
    from tessera.session import session

    Shell(Engine(session())).run(sys.stdin)


if __name__ == "__main__":
    main()
