"""Images of a page: containers in rule order, each taking its subtree, then loose images."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions.sql import add
from pageloom.functions.text import normalize_sql, strip_sql
from pageloom.operators.intervals import collect, ordered_text
from pageloom.operators.marks import OWNER_SHIFT, has
from pageloom.profiles import Profile

UNIT = "coalesce(owner.pos, pos)"


def mark_images(live: DataFrame) -> DataFrame:
    """Move nodes taken by an image container, and loose images, to zone `image`.

    The owner of a node is the container around it with the earliest rule, the outermost
    one among those of the same rule; the scan has found it.
    """
    taken = f"named_struct('pos', CAST(owner & {(1 << OWNER_SHIFT) - 1}L AS INT), 'rank', CAST(shiftright(owner, {OWNER_SHIFT}) AS INT))"
    owned = add(live, owner=f"CASE WHEN zone = 'live' AND owner >= 0 THEN {taken} END")
    return add(
        owned, zone="CASE WHEN zone = 'live' AND (owner IS NOT NULL OR tag = 'img') THEN 'image' ELSE zone END"
    )


def unit_aggregates(profile: Profile) -> dict[str, str]:
    """First image, caption candidates and strings of one container (or loose image)."""
    loose = len(profile.image_containers)
    below = "zone = 'image' AND coalesce(owner.pos < pos, true)"
    return {
        "img": f"min(CASE WHEN {below} AND tag = 'img' THEN named_struct('pos', pos, 'src', src, 'alt', alt) END)",
        "img_rank": f"max(CASE WHEN zone = 'image' THEN coalesce(owner.rank, {loose}) END)",
        "img_caption": f"min(CASE WHEN {below} AND owner IS NOT NULL AND ({has('caption_0')} OR {has('caption_1')}) "
        f"THEN named_struct('rank', CASE WHEN {has('caption_0')} THEN 0 ELSE 1 END, 'pos', pos, 'last', last) END)",
        "img_texts": collect(
            f"zone = 'image' AND text IS NOT NULL AND NOT {has('in_quiet')}", "pos AS pos", f"{strip_sql('text')} AS s"
        ),
    }


def unit_image() -> str:
    """The image a container yields; null when its first image has no source."""
    strings = "filter(img_texts, t -> t.pos BETWEEN img_caption.pos AND img_caption.last)"
    caption = f"CASE WHEN img_caption IS NULL THEN '' ELSE {normalize_sql(ordered_text(strings, ' '))} END"
    src = "CASE WHEN startswith(img.src, '//') THEN concat('https:', img.src) ELSE img.src END"
    return (
        "CASE WHEN zone = 'image' AND img.src IS NOT NULL THEN named_struct('rank', img_rank, 'pos', unit, "
        f"'src', {src}, 'alt', {normalize_sql('img.alt')}, 'caption', {caption}) END"
    )


def page_images(collected: str) -> str:
    return f"transform(sort_array({collected}), i -> named_struct('src', i.src, 'alt', i.alt, 'caption', i.caption))"
