"""Subtree tests as windows over one page in document order, as SQL text.

A node covers [pos, last] and intervals nest, so "below a matching node" is a comparison
with the furthest end seen so far.
"""

from __future__ import annotations

from pageloom.functions.sql import literal

# What tells pages apart: ids may repeat or be null, and then the content and a number decide.
KEYS = ("page_id", "page_hash", "page_copy")
BY_PAGE = f"PARTITION BY {', '.join(KEYS)}"

_PAGE = f"{BY_PAGE} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND"
UP_TO_HERE = f"OVER ({_PAGE} CURRENT ROW)"
BEFORE_HERE = f"OVER ({_PAGE} 1 PRECEDING)"
WHOLE_PAGE = f"OVER ({_PAGE} UNBOUNDED FOLLOWING)"


def within(condition: str, *, strictly: bool = False) -> str:
    """True for everything below matching nodes, and unless `strictly` for those nodes themselves."""
    frame = BEFORE_HERE if strictly else UP_TO_HERE
    return f"coalesce(pos <= max(CASE WHEN {condition} THEN last END) {frame}, false)"


def first_match(condition: str, rank: str = "0") -> str:
    """(rank, pos, last) of the page's first matching node of the lowest rank; a null rank is no match."""
    return (
        f"min(CASE WHEN {condition} AND {rank} IS NOT NULL THEN named_struct('rank', {rank}, 'pos', pos, 'last', last) END) "
        f"{WHOLE_PAGE}"
    )


def latest(condition: str, *extra: str) -> str:
    """(pos, last, ...) of the nearest earlier-or-same matching node; sound where matches do not nest."""
    fields = "".join(f", {literal(name)}, {name}" for name in extra)
    return f"max(CASE WHEN {condition} THEN named_struct('pos', pos, 'last', last{fields}) END) {UP_TO_HERE}"


def inside(span: str) -> str:
    """True for the node a span starts at and everything below it."""
    return f"coalesce(pos BETWEEN {span}.pos AND {span}.last, false)"


def ordered_text(texts: str, separator: str) -> str:
    """Strings of collected (pos, ..., s) structs in document order."""
    return f"array_join(transform(sort_array({texts}), t -> t.s), {literal(separator)})"


def collect(condition: str, *fields: str) -> str:
    """Collected structs of the rows that meet the condition; `fields` are 'expression AS name'."""
    pairs = ", ".join(f"{literal(name)}, {text}" for text, name in (f.rsplit(" AS ", 1) for f in fields))
    return f"collect_list(CASE WHEN {condition} THEN named_struct({pairs}) END)"
