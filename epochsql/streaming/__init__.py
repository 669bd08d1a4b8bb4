"""Change data capture with Structured Streaming."""

from .cdc import change_stream

__all__ = ["change_stream"]
