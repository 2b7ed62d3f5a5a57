"""The shell: LOAD <csv> AS <name>, SELECT ..., EXPLAIN <query>, BENCH <query>, TABLES, DEVICES, EXIT."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .session import Engine

SHOWN = 20


def render(df: DataFrame, shown: int = SHOWN) -> str:
    """The first rows as a text table; columns are at least 12 wide."""
    rows = df.limit(shown + 1).collect()
    if not rows:
        return "(empty result)"
    cells = [["NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r] for r in rows[:shown]]
    wide = [max([12, len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip()
    out = [line(df.columns), "-+-".join("-" * w for w in wide), *map(line, cells)]
    if len(rows) > shown:
        out.append(f"... and {df.count() - shown} more rows")
    return "\n".join(out)


class Shell:
    def __init__(self, engine: Engine, say: Callable[[str], None] = print):
        self.engine, self.say = engine, say

    def run(self, line: str) -> bool:
        """Runs one command; False ends the shell."""
        line = line.strip()
        word, _, rest = line.partition(" ")
        command = word.rstrip(";").upper()
        if not line:
            return True
        if command in ("EXIT", "QUIT"):
            return False
        try:
            match command:
                case "LOAD":
                    self.load(rest)
                case "SELECT":
                    began = time.perf_counter()
                    self.say(render(self.engine.sql(line)))
                    self.say(f"{1e3 * (time.perf_counter() - began):.1f} ms")
                case "EXPLAIN":
                    self.say(self.engine.explain(rest))
                case "BENCH":
                    m = self.engine.bench(rest)
                    self.say(f"mean {1e3 * m.mean:.2f} ms, median {1e3 * m.median:.2f} ms, p95 {1e3 * m.p95:.2f} ms")
                case "TABLES":
                    for name, rows, columns in self.engine.tables():
                        self.say(f"{name}: {rows} rows, columns {', '.join(columns)}")
                case "DEVICES":
                    for k, v in self.engine.devices().items():
                        self.say(f"{k}: {v}")
                case _:
                    self.say(f"unknown command {word}; {__doc__}")
        except (ValueError, TypeError, OSError, PySparkException) as e:
            self.say(f"error: {e}")
        return True

    def load(self, rest: str) -> None:
        m = re.fullmatch(r"(.+?)\s+AS\s+([A-Za-z_]\w*)\s*;?", rest.strip(), re.IGNORECASE)
        if not m:
            raise ValueError("LOAD <csv> AS <name>")
        began = time.perf_counter()
        result = self.engine.load_csv(m[1].strip("'\""), m[2])
        n, faults = result.rows.count(), result.errors.count()
        self.say(f"{m[2]}: {n} rows, {len(result.rows.columns)} columns, {1e3 * (time.perf_counter() - began):.0f} ms, {faults} errors")


def main() -> None:
    shell = Shell(Engine())
    while True:
        try:
            line = input("quillon> ")
        except EOFError:
            break
        if not shell.run(line):
            break


if __name__ == "__main__":
    sys.exit(main())
