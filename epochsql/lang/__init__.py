"""The dialect: keywords, lexer, syntax tree and parser."""

from .parser import ParseError, parse

__all__ = ["ParseError", "parse"]
