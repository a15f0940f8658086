"""What the rules say about a node, packed into one integer.

A page carries one such integer per token and a row of a window one in place of a dozen flags. Above the flags
stand the place of the node's rule among the rules for content areas, infoboxes and image containers, counted from 1.
"""

from __future__ import annotations

_NAMES = (
    "title", "noise", "boilerplate", "picture", "headline", "hidden", "skipped", "quiet", "note",
    "in_title", "in_quiet", "in_picture", "caption_0", "caption_1", "frame",
)
BIT = {name: 1 << place for place, name in enumerate(_NAMES)}
# Rules that name a parent take one more flag for each side, from here on.
FREE_BIT = len(_NAMES)
AREA_SHIFT, BOX_SHIFT, FRAME_SHIFT, RANK_MASK = 31, 41, 51, (1 << 10) - 1
# An owner is the place of its rule, counted from 0, above its position.
OWNER_SHIFT = 32


def has(name: str, marks: str = "marks") -> str:
    return f"({marks} & {BIT[name]}) <> 0"


def pack(conditions: dict[str, str]) -> str:
    """Marks of a node from one condition per name."""
    parts = [f"if({condition}, {BIT[name]}, 0)" for name, condition in conditions.items()]
    return " | ".join(parts)
