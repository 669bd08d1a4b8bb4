"""Operators that Spark has no form of: time travel over change logs, and constraints."""
