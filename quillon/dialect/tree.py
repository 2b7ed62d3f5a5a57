"""The syntax tree. str() of a node gives it back as text of the dialect."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


class Node:
    def parts(self) -> Iterator[Node]:
        """The expressions directly below this one."""
        return iter(())

    def walk(self) -> Iterator[Node]:
        yield self
        for p in self.parts():
            yield from p.walk()


@dataclass(frozen=True)
class Column(Node):
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Literal(Node):
    value: int | float | str

    def __str__(self) -> str:
        return "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Star(Node):
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Unary(Node):
    op: str
    of: Node

    def parts(self):
        return iter((self.of,))

    def __str__(self) -> str:
        return f"(NOT {self.of})" if self.op == "NOT" else f"(-{self.of})"


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def parts(self):
        return iter((self.left, self.right))

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Aggregate(Node):
    func: str
    of: Node

    def parts(self):
        return iter((self.of,))

    def __str__(self) -> str:
        return f"{self.func}({self.of})"


@dataclass(frozen=True)
class Window(Node):
    """size: of the frame, which ends at the current row."""

    func: str
    of: Node
    size: int
    order: Column
    rows: int
    partition: tuple[Column, ...] = ()

    def parts(self):
        return iter((self.of,))

    def __str__(self) -> str:
        by = f"PARTITION BY {', '.join(map(str, self.partition))} " if self.partition else ""
        return f"{self.func}({self.of}, {self.size}) OVER ({by}ORDER BY {self.order} ROWS {self.rows} PRECEDING)"


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.expr.name if isinstance(self.expr, Column) else str(self.expr))

    def __str__(self) -> str:
        return f"{self.expr} AS {self.alias}" if self.alias else str(self.expr)


@dataclass(frozen=True)
class Select:
    items: list[Item]
    table: str
    where: Node | None = None
    group_by: list[Column] = field(default_factory=list)
    order_by: Column | None = None
    ascending: bool = True
    limit: int | None = None

    def __str__(self) -> str:
        lines = [f"SELECT {', '.join(map(str, self.items))}", f"FROM {self.table}"]
        if self.where:
            lines.append(f"WHERE {self.where}")
        if self.group_by:
            lines.append(f"GROUP BY {', '.join(map(str, self.group_by))}")
        if self.order_by:
            lines.append(f"ORDER BY {self.order_by} {'ASC' if self.ascending else 'DESC'}")
        if self.limit is not None:
            lines.append(f"LIMIT {self.limit}")
        return "\n".join(lines)


@dataclass(frozen=True)
class AsofSelect:
    """columns: what is selected, in order, as (side, column) with side left or right; empty: all."""

    left: str
    right: str
    left_alias: str
    right_alias: str
    left_key: str
    right_key: str
    left_ts: str
    right_ts: str
    tolerance: int = 0
    columns: list[tuple[str, str]] = field(default_factory=list)

    def side(self, side: str) -> list[str]:
        return [c for s, c in self.columns if s == side]

    def __str__(self) -> str:
        a, b = self.left_alias, self.right_alias
        what = ", ".join(f"{a if s == 'left' else b}.{c}" for s, c in self.columns) or "*"
        end = f" TOLERANCE {self.tolerance}" if self.tolerance else ""
        return f"SELECT {what}\nFROM {self.left} AS {a} ASOF JOIN {self.right} AS {b}\nON {a}.{self.left_key} = {b}.{self.right_key} AS OF {a}.{self.left_ts} >= {b}.{self.right_ts}{end}"
