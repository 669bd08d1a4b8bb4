"""Functions of the language that Spark has no direct form of."""

from .timeparse import format_micros, parse_moment

__all__ = ["format_micros", "parse_moment"]
