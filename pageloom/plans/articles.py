"""From pages to articles, infobox rows, image rows and section rows.

One plan, one shuffle: pages are pruned while they are one row each, placed by `page_id`, and what is left
unfolds into nodes, folds into units (a heading, a paragraph, an infobox row, an image
container) and then into one row per page.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.jsontext import entries_json
from pageloom.functions.sql import add
from pageloom.functions.text import page_url
from pageloom.operators import images, infobox, render
from pageloom.operators.intervals import KEYS
from pageloom.operators.outcome import FETCH_FAILED
from pageloom.operators.prune import live_nodes
from pageloom.profiles import WIKI, Profile


_COLLECTED = re.compile(r"(flatten\()?collect_list\((.*?)\)(\))?", re.S)


def _aggregate(frame: DataFrame, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    """What is collected is a column of its own before: there it is compiled, in the aggregate it would be interpreted for every row."""
    each, parts = {}, []
    for name, text in aggregates.items():
        found = _COLLECTED.fullmatch(text)
        if found and not found[2].isidentifier():
            each[f"{name}_each"] = found[2]
            text = f"{found[1] or ''}collect_list({name}_each){found[3] or ''}"
        parts.append(F.expr(f"{text} AS {name}"))
    return (add(frame, **each) if each else frame).groupBy(*keys).agg(*parts)


def _pages(
    pages: DataFrame,
    profile: Profile,
    *,
    text: bool,
    keep_images: bool,
    keep_infobox: bool,
    count_trailing: bool = False,
) -> DataFrame:
    """One row per page with the collected parts that were asked for."""
    marked = live_nodes(
        pages, profile, text=text, keep_images=keep_images, keep_infobox=keep_infobox, count_trailing=count_trailing
    )
    unit = ["WHEN zone = 'title' THEN -1"]
    per_unit = {"page": "max(page)"}
    per_page = dict(per_unit)
    if count_trailing:
        per_unit["n_trailing"] = per_page["n_trailing"] = "max(n_trailing)"
    if keep_images:
        marked = images.mark_images(marked)
        unit.append(f"WHEN zone = 'image' THEN {images.UNIT}")
        per_unit |= images.unit_aggregates(profile)
        per_page["images"] = "collect_list(image)"
    if keep_infobox:
        marked = infobox.mark_box(marked)
        unit.append(f"WHEN zone = 'box' THEN {infobox.UNIT}")
        per_unit |= infobox.unit_aggregates()
        per_page |= infobox.page_aggregates()
    if text:
        unit.append(f"WHEN zone = 'text' THEN {render.UNIT}")
        per_unit |= render.unit_aggregates() | {"has_area": "bool_or(has_area)"}
        per_page |= render.page_aggregates() | {"has_area": "bool_or(has_area)"}
    # A row of its own carries the page's columns.
    unit.append("WHEN zone = 'page' THEN -2")
    placed = add(marked, unit=f"CASE {' '.join(unit)} END")
    placed = placed.filter("unit IS NOT NULL")
    if keep_images or keep_infobox:
        units = _aggregate(placed, [*KEYS, "zone", "unit"], per_unit)
    else:
        # Units of text are one row each already.
        columns = render.unit_columns() | {"page": "page", "has_area": "has_area"}
        units = placed.selectExpr(*KEYS, "zone", "unit", *(f"{value} AS {name}" for name, value in columns.items()))
    if keep_images:
        units = add(units, image=images.unit_image())
    if keep_infobox:
        units = infobox.mark_entries(units)
    if text:
        units = render.mark_strings(units, profile)
    folded = _aggregate(units, list(KEYS), per_page)
    if keep_images:
        folded = add(folded, images=images.page_images("images"))
    if keep_infobox:
        folded = infobox.mark_page_entries(folded)
    return folded


def articles(
    pages: DataFrame, profile: Profile = WIKI, *, keep_images: bool = False, keep_infobox: bool = False
) -> DataFrame:
    """One article per page: `page_id, input_title, title, url, content, sections, images, infobox_data, error_message`.

    `pages` has `page_id`, `title` and `html`; every row gives one article, also where ids repeat or are null. A page without HTML keeps its row,
    with `error_message` set and no content. A column `address` of `pages` comes along. `infobox_data` is JSON text with the keys in
    page order.
    """
    page = _pages(pages, profile, text=True, keep_images=keep_images, keep_infobox=keep_infobox)
    page = add(
        page,
        ok="coalesce(page.fetched, false)",
        has_area="coalesce(has_area, false)",
        input_title="page.title",
        title="coalesce(nullif(found_title, ''), page.title)",
        content=f"CASE WHEN has_area THEN {render.content_sql()} ELSE '' END",
    )
    # Without images a page with a content area has none at all, a page without one an empty list.
    empty = "CAST(array() AS ARRAY<STRUCT<src: STRING, alt: STRING, caption: STRING>>)"
    ok = F.col("ok")
    return page.select(
        "page_id",
        *([F.col("page.address").alias("address")] if "address" in pages.columns else []),
        "input_title",
        "title",
        F.when(ok, page_url(F.col("title"))).alias("url"),
        F.expr("CASE WHEN ok THEN content END AS content"),
        F.expr(f"CASE WHEN ok THEN {render.sections_sql('content')} END AS sections"),
        F.expr(f"CASE WHEN ok THEN {'images' if keep_images else f'CASE WHEN NOT has_area THEN {empty} END'} END AS images"),
        (F.when(ok, entries_json(F.col("entries"))) if keep_infobox else F.lit(None).cast("string")).alias("infobox_data"),
        F.expr(f"CASE WHEN NOT ok THEN '{FETCH_FAILED}' END AS error_message"),
    )


def _listed(page: DataFrame, values: str, item: str) -> DataFrame:
    """`page_id, ord` and one value per row; pages without any give none.

    Inner generators make the planner filter on the size of the list first, which works the whole list out twice.
    """
    return page.select("page_id", F.posexplode_outer(values).alias("ord", item)).filter("ord IS NOT NULL")


def infobox_rows(pages: DataFrame, profile: Profile = WIKI) -> DataFrame:
    """`page_id, ord, key, is_list, vals`: infobox pairs in page order."""
    page = _pages(pages, profile, text=False, keep_images=False, keep_infobox=True)
    return _listed(page, "entries", "e").select(
        "page_id", "ord", F.col("e.key"), F.col("e.is_list"), F.col("e.vals")
    )


def image_rows(pages: DataFrame, profile: Profile = WIKI) -> DataFrame:
    """`page_id, ord, src, alt, caption`: images in extraction order."""
    page = _pages(pages, profile, text=False, keep_images=True, keep_infobox=False)
    return _listed(page, "images", "i").select("page_id", "ord", "i.*")


def section_rows(pages: DataFrame, profile: Profile = WIKI) -> DataFrame:
    """`page_id, ord, section`: section names in page order."""
    return _listed(articles(pages, profile), "sections", "section")


def page_counters(pages: DataFrame, profile: Profile = WIKI) -> DataFrame:
    """`page_id, n_images, n_infobox, n_trailing`: images found, infobox keys found, trailing sections removed."""
    page = _pages(pages, profile, text=False, keep_images=True, keep_infobox=True, count_trailing=True)
    return page.select(
        "page_id",
        F.size("images").alias("n_images"),
        F.size("entries").alias("n_infobox"),
        F.coalesce("n_trailing", F.lit(0)).cast("int").alias("n_trailing"),
    )
