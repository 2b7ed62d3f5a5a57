"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """A statement that the dialect doesn't accept."""


# The dialect's reserved words.
KEYWORDS = frozenset(
    "SELECT FROM WHERE GROUP BY ORDER ASC DESC LIMIT AS AND OR NOT JOIN INNER ON ASOF TOLERANCE "
    "SUM COUNT AVG MIN MAX SMA EMA ROLLING_STD OVER PARTITION ROWS PRECEDING UNBOUNDED FOLLOWING CURRENT".split()
)

_LEXEME = re.compile(
    r"(?P<blank>\s+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<float>\d+\.\d+)|(?P<int>\d+)"
    r"|'(?P<text>(?:[^']|'')*)'|(?P<sign><>|!=|<=|>=|[=<>+\-*/(),.;])"
)


@dataclass(frozen=True)
class Token:
    """kind: a keyword, a sign, or one of name, int, float, text, end."""

    kind: str
    value: str
    line: int
    column: int

    def __str__(self) -> str:
        return f"{self.kind}({self.value!r}) at {self.line}:{self.column}"


def tokenize(sql: str) -> list[Token]:
    """The tokens of a statement, the last of kind end. Keywords come in upper case."""
    out, at, line, begin = [], 0, 1, 0
    while at < len(sql):
        m = _LEXEME.match(sql, at)
        column = at - begin + 1
        if not m:
            raise DialectError(f"unexpected {sql[at]!r} at {line}:{column}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "word":
            upper = value.upper()
            out.append(Token(upper, upper, line, column) if upper in KEYWORDS else Token("name", value, line, column))
        elif kind == "text":
            out.append(Token("text", value.replace("''", "'"), line, column))
        elif kind == "sign":
            value = "<>" if value == "!=" else value
            out.append(Token(value, value, line, column))
        elif kind != "blank":
            out.append(Token(kind, value, line, column))
        if (breaks := m[0].count("\n")) > 0:
            line, begin = line + breaks, at + m[0].rindex("\n") + 1
        at = m.end()
    return [*out, Token("end", "", line, at - begin + 1)]
