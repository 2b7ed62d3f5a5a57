"""Statements of the dialect become DataFrames; Catalyst plans them."""

from .lower import lower

__all__ = ["lower"]
