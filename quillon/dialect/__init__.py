"""The SQL dialect: tokens, syntax tree and parser."""

from .parser import parse, parse_asof, parse_select
from .tokens import DialectError, tokenize

__all__ = ["DialectError", "parse", "parse_asof", "parse_select", "tokenize"]
