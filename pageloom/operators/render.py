"""Text of the content area with light Markdown markers.

The rows that arrive know the unit they belong to: a heading, a paragraph, a definition item or their own
position. Units become strings, and the strings of a page are joined in document order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions.sql import add, literals
from pageloom.functions.text import normalize_sql, strip_sql
from pageloom.operators.intervals import BY_PAGE, collect, ordered_text
from pageloom.operators.prune import heading_sql
from pageloom.profiles import Profile

HEADINGS = "'h1', 'h2', 'h3', 'h4', 'h5', 'h6'"
UNIT = "text_unit"


def unit_columns() -> dict[str, str]:
    """What a unit says by its own row."""
    return {
        "tag": "CASE WHEN zone = 'text' THEN coalesce(tag, '#text') END",
        "last": "CASE WHEN zone = 'text' THEN last END",
        "parent": "CASE WHEN zone = 'text' THEN parent END",
        "list": "CASE WHEN zone = 'text' THEN list END",
        "is_root": "coalesce(is_root, false)",
        "headline": "headline",
        "texts": "texts",
    }


def unit_aggregates() -> dict[str, str]:
    """The same where rows of other zones are gathered too; a unit of text is one row."""
    columns = unit_columns()
    found = {name: f"max({columns[name]})" for name in ("tag", "last", "parent", "list", "headline")}
    return found | {"is_root": "bool_or(coalesce(is_root, false))", "texts": "flatten(collect_list(texts))"}


def mark_strings(units: DataFrame, profile: Profile) -> DataFrame:
    """`opening` and `closing` strings of each unit, and `section` for top-level second-rank headings.

    Whitespace inside paragraphs is left to the final pass over the whole content.
    """
    stripped = f"transform(texts, t -> named_struct('pos', t.pos, 's', {strip_sql('t.s')}))"
    shown = add(
        units,
        words="CASE WHEN tag = '#text' THEN get(texts, 0).s "
        f"WHEN tag IN ({HEADINGS}) THEN {heading_sql(stripped, 'headline', '')} "
        f"WHEN zone = 'title' THEN {normalize_sql(ordered_text(stripped, ' '))} "
        f"WHEN size(texts) > 0 THEN {ordered_text(stripped, ' ')} END",
    )
    excluded = f"AND lower(words) NOT IN ({literals(profile.excluded_headings)})" if profile.excluded_headings else ""
    content = add(
        shown,
        is_content="zone = 'text' AND coalesce(CASE WHEN tag = '#text' THEN size(texts) > 0 "
        f"WHEN tag IN ({HEADINGS}) THEN words <> '' {excluded} "
        "WHEN tag IN ('p', 'dt', 'dd') THEN words <> '' END, false)",
    )
    siblings = f"OVER ({BY_PAGE}, parent ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counted = add(content, number=f"sum(CASE WHEN tag = 'li' AND list = 2 THEN 1 END) {siblings}")
    counted = add(
        counted,
        next_content=f"lead(CASE WHEN is_content THEN unit END) IGNORE NULLS OVER ({BY_PAGE} ORDER BY unit)",
    )
    holds = "zone = 'text' AND next_content <= last"
    # A break inside a list item without content goes with the item.
    bare = f"zone = 'text' AND tag = 'li' AND list IS NOT NULL AND NOT coalesce({holds}, false)"
    upto = f"OVER ({BY_PAGE} ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counted = add(counted, in_bare=f"coalesce(unit <= max(CASE WHEN {bare} THEN last END) {upto}, false)")
    return add(
        counted,
        opening="CASE WHEN is_content THEN CASE tag WHEN '#text' THEN words WHEN 'p' THEN concat(words, '\\n') "
        "WHEN 'dt' THEN concat('**', words, '**:\\n') WHEN 'dd' THEN concat('  ', words, '\\n') "
        "ELSE concat('\\n\\n', repeat('#', CAST(substring(tag, 2, 1) AS INT)), ' ', words, '\\n') END "
        "WHEN zone = 'text' AND tag = 'br' AND NOT in_bare THEN '\\n' "
        f"WHEN {holds} AND tag IN ('ul', 'ol', 'dl') THEN '\\n' "
        f"WHEN {holds} AND tag = 'li' THEN CASE list WHEN 2 THEN concat(CAST(number AS STRING), '. ') ELSE '* ' END END",
        closing=f"CASE WHEN {holds} AND tag IN ('ul', 'ol', 'dl', 'li') THEN '\\n' END",
        section="CASE WHEN is_content AND is_root AND tag = 'h2' THEN words END",
    )


def page_aggregates() -> dict[str, str]:
    opening = "CASE WHEN opening IS NOT NULL THEN named_struct('pos', unit, 'seq', 0, 's', opening) END"
    closing = "CASE WHEN closing IS NOT NULL THEN named_struct('pos', last, 'seq', 1, 's', closing) END"
    return {
        "pieces": f"flatten(collect_list(array_compact(array({opening}, {closing}))))",
        "heads": collect("section IS NOT NULL", "unit AS pos", "section AS s"),
        "found_title": "max(CASE WHEN zone = 'title' THEN words END)",
    }


def content_sql() -> str:
    return normalize_sql(ordered_text("pieces", ""))


def sections_sql(content: str) -> str:
    """Section names, with a made-up first one where the text starts before any heading."""
    names = "transform(sort_array(heads), h -> h.s)"
    return (
        f"CASE WHEN {content} = '' THEN {names} WHEN size(heads) = 0 THEN array('Content') "
        f"WHEN startswith(lower({content}), lower(concat('## ', {names}[0]))) THEN {names} "
        f"ELSE concat(array('Introduction'), {names}) END"
    )
