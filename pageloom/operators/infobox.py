"""Infobox pairs: rows that are direct children of the box, first header and first data cell of each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions.sql import add
from pageloom.functions.text import normalize_sql, strip_sql
from pageloom.operators.intervals import BEFORE_HERE, collect, first_match, inside, latest, ordered_text, within
from pageloom.operators.marks import has

UNIT = "coalesce(tr_pos, box_pos)"
# A noncharacter; it separates list items while they are joined.
_ITEM_BREAK = r"'￿'"


def mark_box(zoned: DataFrame) -> DataFrame:
    """Row (`tr_pos`), cell (`cell`) and caption of every box node."""
    rows = add(
        zoned,
        row=latest("zone = 'box' AND tag = 'tr' AND parent = box_pos"),
        caption=first_match("zone = 'box' AND tag = 'caption'"),
        in_note_mark=within(f"zone = 'box' AND {has('note')}"),
    )
    rows = add(
        rows,
        tr_pos=f"CASE WHEN zone = 'box' AND {inside('row')} THEN row.pos END",
        in_caption=f"zone = 'box' AND {inside('caption')}",
    ).drop("row", "caption")
    rows = add(rows, is_cell="coalesce(tag IN ('th', 'td') AND parent = tr_pos, false)")

    def first_of_row(tag: str) -> str:
        earlier = f"max(CASE WHEN is_cell AND tag = '{tag}' THEN tr_pos END) {BEFORE_HERE}"
        return f"is_cell AND tag = '{tag}' AND coalesce({earlier} < tr_pos, true)"

    firsts = add(rows, first_th=first_of_row("th"), first_td=first_of_row("td"))
    cells = add(firsts, cell=latest("first_th OR first_td", "tag")).drop("first_th", "first_td")
    return add(cells, cell=f"CASE WHEN tr_pos IS NOT NULL AND {inside('cell')} THEN cell END")


def unit_aggregates() -> dict[str, str]:
    """Strings and list items of one infobox row."""
    string = f"zone = 'box' AND text IS NOT NULL AND NOT {has('in_quiet')}"
    kept = "cell.tag = 'td' AND NOT in_note_mark"
    role = "CASE WHEN cell.tag = 'th' THEN 'key' WHEN in_note_mark THEN 'mark' ELSE 'value' END"
    s = strip_sql("text")
    below = (
        "transform(filter(items, i -> i > cell.pos), "
        f"i -> named_struct('item', i, 'pos', pos, 's', concat(' ', {s})))"
    )
    opening = f"array(named_struct('item', pos, 'pos', pos, 's', {_ITEM_BREAK}))"
    return {
        "box_texts": collect(f"{string} AND cell IS NOT NULL", "pos AS pos", f"{role} AS role", f"{s} AS s"),
        "box_items": f"collect_list(CASE WHEN {string} AND {kept} THEN {below} "
        f"WHEN zone = 'box' AND {kept} AND tag = 'li' THEN {opening} END)",
        "box_cells": "count_if(zone = 'box' AND is_cell)",
        "box_headers": "count_if(zone = 'box' AND is_cell AND tag = 'th')",
        "box_images": "count_if(zone = 'box' AND cell.tag = 'td' AND tag = 'img')",
        "box_captions": "count_if(zone = 'box' AND in_caption AND tag = 'caption')",
        "caption_texts": collect(f"{string} AND in_caption", "pos AS pos", f"{s} AS s"),
    }


def _joined(roles: str) -> str:
    return normalize_sql(ordered_text(f"filter(box_texts, t -> t.role IN ({roles}))", " "))


def mark_entries(units: DataFrame) -> DataFrame:
    """`box_pair` and `box_note` of one infobox row, null where the row has none."""
    read = add(units, key=_joined("'key'"), value=_joined("'value'"), note=_joined("'value', 'mark'"), listed="flatten(box_items)")
    items = f"filter(transform(split({ordered_text('listed', '')}, {_ITEM_BREAK}), i -> {normalize_sql('i')}), i -> i <> '')"
    has_value = "box_cells > box_headers"
    return add(
        read,
        box_pair=f"CASE WHEN zone = 'box' AND box_headers > 0 AND {has_value} AND key <> '' THEN named_struct("
        "'ord', unit, 'key', key, 'is_list', size(listed) > 0, "
        f"'vals', CASE WHEN size(listed) > 0 THEN {items} ELSE array(value) END) END",
        box_note=f"CASE WHEN zone = 'box' AND box_cells = 1 AND {has_value} AND box_images = 0 AND note <> '' "
        "THEN named_struct('pos', unit, 's', note) END",
    )


def page_aggregates() -> dict[str, str]:
    return {
        "box_pairs": "collect_list(box_pair)",
        "box_notes": "collect_list(box_note)",
        "caption_texts": "flatten(collect_list(caption_texts))",
        "box_captions": "sum(box_captions)",
    }


def mark_page_entries(page: DataFrame) -> DataFrame:
    """Add `entries`: one per key, first position, last value.

    Repeated keys meet by sorting on (key, position), so the work stays n log n in the
    number of rows of one infobox.
    """
    caption = (
        "array(named_struct('ord', -1, 'key', '_caption_', 'is_list', false, "
        f"'vals', array({normalize_sql(ordered_text('caption_texts', ' '))})))"
    )
    notes = (
        "array(named_struct('ord', array_min(box_notes.pos), 'key', '_infobox_notes_', 'is_list', true, "
        "'vals', transform(sort_array(box_notes), n -> n.s)))"
    )
    everything = (
        f"concat(CASE WHEN box_captions > 0 THEN {caption} ELSE filter({caption}, e -> false) END, box_pairs, "
        f"CASE WHEN size(box_notes) > 0 THEN {notes} ELSE filter({notes}, e -> false) END)"
    )
    by_key = f"sort_array(transform({everything}, e -> named_struct('key', e.key, 'ord', e.ord, 'is_list', e.is_list, 'vals', e.vals)))"
    runs = add(
        add(page, by_key=by_key),
        firsts="filter(by_key, (e, i) -> i = 0 OR get(by_key, i - 1).key <> e.key)",
        lasts="filter(by_key, (e, i) -> i = size(by_key) - 1 OR get(by_key, i + 1).key <> e.key)",
    )
    merged = "zip_with(firsts, lasts, (a, b) -> named_struct('ord', a.ord, 'key', b.key, 'is_list', b.is_list, 'vals', b.vals))"
    return add(runs, entries=f"sort_array({merged})").drop(
        "by_key", "firsts", "lasts", "box_pairs", "box_notes", "caption_texts", "box_captions"
    )
