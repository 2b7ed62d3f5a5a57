"""From syntax tree to DataFrame.

Arithmetic is in double precision, numbers don't compare with strings, and a WHERE, AND, OR or NOT
over something that isn't boolean asks whether it is non-zero or non-empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import tree as t
from ..dialect.tokens import DialectError
from ..functions import rolling_std, sma, with_ema
from ..operators.joins import asof_join
from ..operators.windows import rolling

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
}
_WINDOW = {"SMA": sma, "ROLLING_STD": rolling_std}
NUMBER, TEXT, TRUTH, OTHER = "number", "string", "boolean", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMBER
    return TEXT if isinstance(data_type, T.StringType) else TRUTH if isinstance(data_type, T.BooleanType) else OTHER


class Scope:
    """The columns of one table. special: what stands for a node that was computed before."""

    def __init__(self, df: DataFrame, table: str):
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema}
        self.table, self.special = table, {}

    def column(self, c: t.Column) -> str:
        if c.table not in (None, self.table):
            raise DialectError(f"{c} doesn't belong to table {self.table}")
        if c.name not in self.kinds:
            raise DialectError(f"no column {c.name} in table {self.table}")
        return c.name

    def of(self, node: t.Node) -> tuple[Column, str]:
        """The Column of an expression, and its kind."""
        if node in self.special:
            return self.special[node]
        match node:
            case t.Column():
                name = self.column(node)
                return F.col(f"`{name}`"), self.kinds[name]
            case t.Literal(value=str() as v):
                return F.lit(v), TEXT
            case t.Literal(value=v):
                return F.lit(v), NUMBER
            case t.Unary(op="NOT"):
                return ~self.truth(node.of), TRUTH
            case t.Unary():
                return -self.double(node.of), NUMBER
            case t.Binary(op="AND"):
                return self.truth(node.left) & self.truth(node.right), TRUTH
            case t.Binary(op="OR"):
                return self.truth(node.left) | self.truth(node.right), TRUTH
            case t.Binary() if node.op in _COMPARE:
                (a, x), (b, y) = self.of(node.left), self.of(node.right)
                if {x, y} in ({NUMBER, TEXT}, {NUMBER, TRUTH}, {TEXT, TRUTH}):
                    raise DialectError(f"{node} compares a {x} with a {y}")
                return _COMPARE[node.op](a, b), TRUTH
            case t.Binary():
                return _ARITHMETIC[node.op](self.double(node.left), self.double(node.right)), NUMBER
            case t.Star():
                raise DialectError("* stands alone")
        raise DialectError(f"{node} can't stand here")

    def double(self, node: t.Node) -> Column:
        c, kind = self.of(node)
        if kind != NUMBER:
            raise DialectError(f"{node} is no number")
        return c.cast("double")

    def truth(self, node: t.Node) -> Column:
        c, kind = self.of(node)
        return c if kind == TRUTH else c != 0 if kind == NUMBER else c != "" if kind == TEXT else c.isNotNull()

    def aggregate(self, node: t.Aggregate) -> tuple[Column, str]:
        if any(isinstance(x, (t.Aggregate, t.Window)) for p in node.parts() for x in p.walk()):
            raise DialectError(f"{node} holds another aggregate or window")
        if isinstance(node.of, t.Star):
            return F.count(F.lit(1)), NUMBER
        c, kind = self.of(node.of)
        match node.func:
            case "COUNT":
                return F.count(c), NUMBER
            case "SUM" | "AVG":
                return (F.sum if node.func == "SUM" else F.avg)(self.double(node.of)), NUMBER
            case _:
                return (F.min if node.func == "MIN" else F.max)(c), kind


def _find(items: list[t.Item], kind: type) -> list[t.Node]:
    return list(dict.fromkeys(x for i in items for x in i.expr.walk() if isinstance(x, kind)))


def select(q: t.Select, tables: Callable[[str], DataFrame]) -> DataFrame:
    df = tables(q.table)
    scope = Scope(df, q.table)
    if q.where:
        if any(isinstance(x, (t.Aggregate, t.Window)) for x in q.where.walk()):
            raise DialectError("WHERE can't hold an aggregate or a window")
        df = df.filter(scope.truth(q.where))
    aggregates, windows = _find(q.items, t.Aggregate), _find(q.items, t.Window)
    if aggregates and windows:
        raise DialectError("aggregates and windows don't mix")
    items = q.items
    if q.group_by or aggregates:
        keys = [scope.column(c) for c in q.group_by]
        for i in items:
            plain = _outside(i.expr)
            if any(isinstance(x, t.Star) for x in plain):
                raise DialectError("* can't be grouped")
            for c in (x for x in plain if isinstance(x, t.Column)):
                if scope.column(c) not in keys:
                    raise DialectError(f"{c} is neither grouped nor aggregated")
        made = {a: (f"_agg{n}", *scope.aggregate(a)) for n, a in enumerate(aggregates)}
        grouped = df.groupBy(*[F.col(f"`{k}`") for k in dict.fromkeys(keys)])
        df = grouped.agg(*[c.alias(name) for name, c, _ in made.values()]) if made else df.select(*[f"`{k}`" for k in dict.fromkeys(keys)]).distinct()
        scope.special = {a: (F.col(name), kind) for a, (name, _, kind) in made.items()}
    elif windows:
        spread: dict[str, list[tuple[str, str, int, str]]] = {}
        for n, w in enumerate(windows):
            by = [F.col(f"`{scope.column(c)}`") for c in w.partition]
            name, order = scope.column(w.order), F.col(f"`{scope.column(w.order)}`")
            if not by and scope.kinds[name] == NUMBER:  # over the whole table: spread over tasks
                df = df.withColumn(f"_of{n}", scope.double(w.of))
                spread.setdefault(name, []).append((w.func, f"_of{n}", w.size, f"_win{n}"))
            elif w.func == "EMA":
                df = with_ema(df, f"_win{n}", scope.double(w.of), w.size, order, *by)
            else:
                df = df.withColumn(f"_win{n}", _WINDOW[w.func](scope.double(w.of), w.size, order, *by))
            scope.special[w] = (F.col(f"_win{n}"), NUMBER)
        for name, specs in spread.items():
            df = rolling(df, name, specs)
    out: list[tuple[str, Column]] = []
    for i in items:
        if isinstance(i.expr, t.Star):
            out += [(name, F.col(f"`{name}`")) for name in scope.kinds]
        else:
            out.append((i.name, scope.of(i.expr)[0]))
    if q.order_by:
        # An output name comes before a column of the table, as in SQL.
        named = {name: c for name, c in reversed(out)}
        grouped_names = {scope.column(c) for c in q.group_by} if q.group_by or aggregates else scope.kinds.keys()
        key = named.get(q.order_by.name) if q.order_by.table is None else None
        if key is None:
            if scope.column(q.order_by) not in grouped_names:
                raise DialectError(f"{q.order_by} is neither grouped nor selected")
            key = F.col(f"`{q.order_by.name}`")
        df = df.orderBy(key.asc() if q.ascending else key.desc())
    df = df.select(*[c.alias(name) for name, c in out])
    return df if q.limit is None else df.limit(q.limit)


def _outside(node: t.Node) -> list[t.Node]:
    """The nodes that aren't inside an aggregate."""
    if isinstance(node, t.Aggregate):
        return []
    return [node, *(x for p in node.parts() for x in _outside(p))]


def asof(q: t.AsofSelect, tables: Callable[[str], DataFrame]) -> DataFrame:
    left, right = tables(q.left), tables(q.right)
    for side, df, cols in (("left", left, (q.left_key, q.left_ts)), ("right", right, (q.right_key, q.right_ts))):
        for c in (*cols, *q.side(side)):
            if c not in df.columns:
                raise DialectError(f"no column {c} in table {q.left if side == 'left' else q.right}")
    joined = asof_join(left, right, q.left_ts, q.right_ts, q.left_key, q.right_key, q.tolerance, prefixes=(q.left_alias, q.right_alias))
    if not q.columns:
        return joined
    return joined.select(*[F.col(f"`{q.left_alias if s == 'left' else q.right_alias}.{c}`") for s, c in q.columns])


def lower(q: t.Select | t.AsofSelect, tables: Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame of a statement; tables gives a table by name."""
    return asof(q, tables) if isinstance(q, t.AsofSelect) else select(q, tables)
