"""Runs a script of statements: python -m epochsql.cli STORE FILE"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from .engine import Session
from .lang.lexer import tokens


def statements(text: str) -> Iterator[str]:
    """The statements of a script, cut at semicolons outside of strings and comments."""
    start = None
    for t in tokens(text):
        if t.kind == "op" and t.text == ";":
            if start is not None:
                yield text[start : t.at + 1]
            start = None
        elif t.kind == "end":
            if start is not None:
                yield text[start:]
        elif start is None:
            start = t.at


def run_script(session: Session, text: str, stop_on_error: bool = False) -> list[str]:
    """The printed result of each statement; errors are results too unless asked otherwise."""
    out = []
    for s in statements(text):
        try:
            out.append(session.execute(s).text())
        except Exception as e:
            if stop_on_error:
                raise
            out.append(f"ERROR: {e}\n")
    return out


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("epochsql").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with open(args[1]) as f:
        for x in run_script(Session(spark, args[0]), f.read()):
            print(x)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
