"""Words, numbers, strings and operators. A run of word characters with a letter in it is a word, digits first or not."""

from __future__ import annotations

import re
from typing import NamedTuple


class LexError(ValueError):
    pass


class Token(NamedTuple):
    kind: str  # word, number, string, op or end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper()


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)
      | (?P<string>'[^']*'|"[^"]*")
      | (?P<word>[0-9]*[^\W0-9]\w*)
      | (?P<number>-?[0-9]+(?:\.[0-9]+)?)
      | (?P<op><=|>=|<>|!=|[*,();=<>.+/-])""",
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise LexError(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup or ""
        if kind == "string":
            out.append(Token(kind, m.group()[1:-1], at))
        elif kind != "skip":
            out.append(Token(kind, m.group(), at))
        at = m.end()
    return [*out, Token("end", "", at)]
