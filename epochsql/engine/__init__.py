"""Sessions, users and the statement dispatcher."""

from .session import Result, Session, connect

__all__ = ["Result", "Session", "connect"]
