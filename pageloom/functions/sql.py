"""Small helpers for expressions written as SQL text, which cost the driver one round trip each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Iterable[str]) -> str:
    return ", ".join(map(literal, values))


def choose(*parts: str) -> str:
    """The value behind the first true condition of `condition, value, condition, value, ...`; a last part alone holds otherwise, else null.

    A CASE says the same, but inside of array functions it costs a walk along all its branches for every element.
    """
    text = parts[-1] if len(parts) % 2 else "NULL"
    for at in range(len(parts) // 2 * 2 - 2, -1, -2):
        text = f"if({parts[at]}, {parts[at + 1]}, {text})"
    return text


def add(frame: DataFrame, **columns: str) -> DataFrame:
    """Add or replace columns, all computed from the columns of `frame`."""
    old = [name for name in columns if name in frame.columns]
    star = f"* EXCEPT ({', '.join(old)})" if old else "*"
    return frame.selectExpr(star, *(f"{text} AS {name}" for name, text in columns.items()))


def drop(frame: DataFrame, *names: str) -> DataFrame:
    """Drop the columns that exist among `names`."""
    return frame.drop(*(name for name in names if name in frame.columns))
