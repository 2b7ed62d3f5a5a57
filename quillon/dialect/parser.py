"""Recursive-descent parser of the dialect. Text behind a statement is an error."""

from __future__ import annotations

from . import tree as t
from .tokens import DialectError, Token, tokenize

AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
WINDOWS = ("SMA", "EMA", "ROLLING_STD")
COMPARISONS = ("=", "<>", "<", ">", "<=", ">=")


class _Reader:
    def __init__(self, sql: str | list[Token]):
        self.tokens = tokenize(sql) if isinstance(sql, str) else sql
        self.at = 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, *kinds: str) -> Token | None:
        """The next token if it is of one of the kinds."""
        if self.now.kind not in kinds:
            return None
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, *kinds: str) -> Token:
        if found := self.take(*kinds):
            return found
        raise DialectError(f"expected {' or '.join(kinds)}, found {self.now}")

    def name(self) -> str:
        return self.need("name").value

    def end(self) -> None:
        self.take(";")
        self.need("end")

    # --- expressions, loosest first

    def expr(self) -> t.Node:
        left = self.conjunction()
        while self.take("OR"):
            left = t.Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> t.Node:
        left = self.negation()
        while self.take("AND"):
            left = t.Binary("AND", left, self.negation())
        return left

    def negation(self) -> t.Node:
        return t.Unary("NOT", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> t.Node:
        left = self.sum()
        op = self.take(*COMPARISONS)
        return t.Binary(op.kind, left, self.sum()) if op else left

    def sum(self) -> t.Node:
        left = self.product()
        while op := self.take("+", "-"):
            left = t.Binary(op.kind, left, self.product())
        return left

    def product(self) -> t.Node:
        left = self.signed()
        while op := self.take("*", "/"):
            left = t.Binary(op.kind, left, self.signed())
        return left

    def signed(self) -> t.Node:
        return t.Unary("-", self.signed()) if self.take("-") else self.primary()

    def primary(self) -> t.Node:
        if found := self.take("int"):
            return t.Literal(int(found.value))
        if found := self.take("float"):
            return t.Literal(float(found.value))
        if found := self.take("text"):
            return t.Literal(found.value)
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if found := self.take(*AGGREGATES):
            return self.aggregate(found.kind)
        if found := self.take(*WINDOWS):
            return self.window(found.kind)
        return self.column()

    def column(self) -> t.Column:
        first = self.name()
        return t.Column(self.name(), first) if self.take(".") else t.Column(first)

    def aggregate(self, func: str) -> t.Node:
        self.need("(")
        if self.take("*"):
            if func != "COUNT":
                raise DialectError(f"{func}(*) has no meaning")
            of: t.Node = t.Star()
        else:
            of = self.expr()
        self.need(")")
        return t.Aggregate(func, of)

    def window(self, func: str) -> t.Node:
        self.need("(")
        of = self.expr()
        size = int(self.need("int").value) if self.take(",") else None
        self.need(")")
        self.need("OVER")
        self.need("(")
        by: list[t.Column] = []
        if self.take("PARTITION"):
            self.need("BY")
            by.append(self.column())
            while self.take(","):
                by.append(self.column())
        self.need("ORDER")
        self.need("BY")
        order = self.column()
        self.need("ROWS")
        rows = int(self.need("int").value)
        self.need("PRECEDING")
        self.need(")")
        size = rows if size is None else size
        if size < 1:
            raise DialectError(f"{func} needs a window of at least one row")
        return t.Window(func, of, size, order, rows, tuple(by))

    # --- statements

    def item(self) -> t.Item:
        expr = t.Star() if self.take("*") else self.expr()
        return t.Item(expr, self.name() if self.take("AS") else None)

    def select(self) -> t.Select:
        self.need("SELECT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("FROM")
        table = self.name()
        where = self.expr() if self.take("WHERE") else None
        group: list[t.Column] = []
        if self.take("GROUP"):
            self.need("BY")
            group.append(self.column())
            while self.take(","):
                group.append(self.column())
        order, ascending = None, True
        if self.take("ORDER"):
            self.need("BY")
            order = self.column()
            ascending = not (self.take("ASC", "DESC") or self.now).kind == "DESC"
        limit = int(self.need("int").value) if self.take("LIMIT") else None
        self.end()
        return t.Select(items, table, where, group, order, ascending, limit)

    def pair(self, op: str) -> tuple[t.Column, t.Column]:
        left = self.column()
        self.need(op)
        return left, self.column()

    def asof(self) -> t.AsofSelect:
        self.need("SELECT")
        chosen: list[t.Column] = []
        if not self.take("*"):
            chosen.append(self.column())
            while self.take(","):
                chosen.append(self.column())
        self.need("FROM")
        left = self.name()
        a = self.name() if self.take("AS") else left
        self.need("ASOF")
        self.need("JOIN")
        right = self.name()
        b = self.name() if self.take("AS") else right
        sides = {a: "left", b: "right"}
        if len(sides) < 2:
            raise DialectError("the two sides of an as-of join need different names")

        def side(c: t.Column) -> str:
            if c.table not in sides:
                raise DialectError(f"{c} names neither {a} nor {b}")
            return sides[c.table]

        def sorted_pair(op: str) -> tuple[str, str]:
            x, y = self.pair(op)
            if side(x) == side(y):
                raise DialectError(f"{x} and {y} are of the same side")
            return (x.name, y.name) if side(x) == "left" else (y.name, x.name)

        self.need("ON")
        keys = sorted_pair("=")
        self.need("AS")
        if self.name().upper() != "OF":
            raise DialectError("expected AS OF")
        at = self.now
        x, y = self.pair(">=")
        if side(x) != "left" or side(y) != "right":
            raise DialectError(f"AS OF compares the left side's time with the right side's, at {at.line}:{at.column}")
        tolerance = int(self.need("int").value) if self.take("TOLERANCE") else 0
        self.end()
        return t.AsofSelect(left, right, a, b, *keys, x.name, y.name, tolerance, [(side(c), c.name) for c in chosen])


def parse_select(sql: str | list[Token]) -> t.Select:
    return _Reader(sql).select()


def parse_asof(sql: str | list[Token]) -> t.AsofSelect:
    return _Reader(sql).asof()


def parse(sql: str) -> t.Select | t.AsofSelect:
    """Either statement; ASOF tells them apart."""
    tokens = tokenize(sql)
    return parse_asof(tokens) if any(x.kind == "ASOF" for x in tokens) else parse_select(tokens)
