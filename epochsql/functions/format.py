"""Results as text tables, JSON and the binary wire form."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame

MESSAGE, TABLE, ERROR = 0x01, 0x02, 0xFF
STRING = 2


def cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def _rows(df: DataFrame) -> list[list[str]]:
    return [[cell(v) for v in r] for r in df.toLocalIterator()]


def as_text(x: DataFrame | str) -> str:
    if isinstance(x, str):
        return x + "\n"
    names, rows = list(x.columns), _rows(x)
    if not names:
        return "(No Data)\n"
    wide = [max(len(n), *(len(r[i]) for r in rows)) if rows else len(n) for i, n in enumerate(names)]
    line = lambda cells: " " + " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)) + "\n"
    rule = "-" + "-+-".join("-" * w for w in wide) + "-\n"
    return line(names) + rule + "".join(map(line, rows)) + f"({len(rows)} row{'' if len(rows) == 1 else 's'})\n"


def as_json(x: DataFrame | str) -> str:
    if isinstance(x, str):
        return json.dumps({"success": True, "message": x})
    rows = _rows(x)
    return json.dumps({"success": True, "data": {"columns": x.columns, "rows": rows}, "row_count": len(rows)}, ensure_ascii=False)


def _string(s: str) -> bytes:
    b = s.encode()
    return struct.pack(">I", len(b)) + b


def as_binary(x: DataFrame | str) -> bytes:
    if isinstance(x, str):
        return bytes([MESSAGE]) + _string(x)
    rows = _rows(x)
    head = bytes([TABLE]) + struct.pack(">II", len(x.columns), len(rows)) + b"".join(bytes([STRING]) + _string(n) for n in x.columns)
    return head + b"".join(_string(c) for r in rows for c in r)


def error_text(message: str) -> str:
    return f"ERROR: {message}\n"


def error_json(message: str) -> str:
    return json.dumps({"success": False, "error": message})


def error_binary(message: str) -> bytes:
    return bytes([ERROR]) + _string(message)
