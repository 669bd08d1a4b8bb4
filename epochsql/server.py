"""A thin TCP server. A request is a mode byte (Q text, J JSON, B binary, L login), a big-endian length and the
statement; a response is a big-endian length and the result."""

from __future__ import annotations

import argparse
import socketserver
import struct

from .engine import Session
from .functions import format as fmt

PORT = 2501
MAX_REQUEST = 16 << 20
ERRORS = {"Q": lambda m: fmt.error_text(m).encode(), "J": lambda m: fmt.error_json(m).encode(), "B": fmt.error_binary}


def answer(session: Session, mode: str, statement: str) -> bytes:
    if mode == "L":
        statement, mode = f"LOGIN {statement}" if not statement.upper().startswith("LOGIN") else statement, "Q"
    try:
        r = session.execute(statement)
        return r.binary() if mode == "B" else (r.json() if mode == "J" else r.text()).encode()
    except Exception as e:
        return ERRORS.get(mode, ERRORS["Q"])(str(e))


def serve(make_session, host: str = "127.0.0.1", port: int = PORT) -> socketserver.ThreadingTCPServer:
    """A server with a session of its own for each connection; call serve_forever() on it."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            session = make_session()
            while len(head := self.rfile.read(5)) == 5 and not session.closed:
                mode, size = struct.unpack(">cI", head)
                if size > MAX_REQUEST:
                    return
                body = self.rfile.read(size)
                if len(body) < size:
                    return
                out = answer(session, mode.decode("latin-1"), body.decode("utf-8", "replace"))
                self.wfile.write(struct.pack(">I", len(out)) + out)

    socketserver.ThreadingTCPServer.allow_reuse_address = True
    return socketserver.ThreadingTCPServer((host, port), Handler)


def main() -> None:
    """python -m epochsql.server STORE [--host H] [--port P]: one Spark session; each connection must log in first."""
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("store")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=PORT)
    args = p.parse_args()
    spark = SparkSession.builder.appName("epochsql").getOrCreate()
    with serve(lambda: Session(spark, args.store, user="", authenticated=False), args.host, args.port) as server:
        server.serve_forever()


if __name__ == "__main__":
    main()
