"""Whitespace, URL, file-name and entity functions, all JVM-side expressions.

Functions ending in `_sql` take and give SQL text; the others take and give Columns.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.sql import choose, literal

PAGE_BASE = "https://en.wikipedia.org/"

# The code points that count as whitespace (Unicode White_Space plus the
# four ASCII separators), as a trim set and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same class behind one coarse test, because most characters of a text fail it.
WS_FAST = rf"[[\x00-\x20\x80-\u3000]&&[{WS_CLASS}]]"

# Listed first because a map lookup scans keys in order.
FREQUENT_ENTITIES = ("amp", "nbsp", "quot", "lt", "gt", "ndash", "mdash", "copy", "middot", "apos")


_TRIM_SET = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"
_WS_RUN = literal(f"{WS_FAST}+")


def strip_sql(text: str) -> str:
    return f"btrim({text}, {_TRIM_SET})"


def normalize_sql(text: str) -> str:
    return f"btrim(regexp_replace(coalesce({text}, ''), {_WS_RUN}, ' '), ' ')"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends, in linear time."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_whitespace(text: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed, null becomes ''."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS_FAST}+", " "), F.lit(" "))


def squeeze_blank_lines(text: Column) -> Column:
    """Drop whitespace before a newline; three or more newlines become one blank line."""
    tight = F.regexp_replace(text, f"{WS_FAST}+\n", "\n")
    return strip(F.regexp_replace(tight, f"(?:\n{WS_FAST}*){{3,}}", "\n\n"))


def page_url(title: Column) -> Column:
    """Address of the page with this title, every reserved character percent-encoded."""
    quoted = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    # "." and ".." resolve as path segments.
    path = (
        F.when(title == ".", "wiki/").when(title == "..", "").otherwise(F.concat(F.lit("wiki/"), quoted))
    )
    return F.concat(F.lit(PAGE_BASE), path)


def sanitize_filename(name: Column) -> Column:
    """Keep letters, digits, underscore, space and hyphen; hyphen and space runs become one hyphen."""
    kept = strip(F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}_{WS_CLASS}-]", ""))
    return F.regexp_replace(kept, f"[{WS_CLASS}-]+", "-")


@cache
def _named_entities() -> tuple[tuple[str, str], ...]:
    names = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
    front = {name: names[name] for name in FREQUENT_ENTITIES}
    return tuple({**front, **names}.items())


@cache
def _low_code_points() -> tuple[tuple[str, str], ...]:
    """Numeric references 128-159 mean Windows-1252 characters where it defines one."""
    pairs = {}
    for code in range(128, 160):
        try:
            pairs[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return tuple(pairs.items())


_REFERENCE = literal(r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][-.a-zA-Z0-9]*+);?|[^&]++|&")


@cache
def _map_sql(pairs: tuple[tuple[str, str], ...]) -> str:
    """A constant string map; the parser call is folded at planning time."""
    return f"from_json({literal(json.dumps(dict(pairs)))}, 'map<string,string>')"


def decode_sql(text: str) -> str:
    """Replace character references by characters; texts without '&' pass untouched.

    Two passes over the pieces: name and code of each reference, then its character. A code
    is -1 when too large for any character; an unknown name stays, without its semicolon.
    """
    hexadecimal = f"regexp_extract(p, {literal('^&#[xX]0*+([0-9a-fA-F]++)')}, 1)"
    decimal = f"regexp_extract(p, {literal('^&#0*+([0-9]++)')}, 1)"
    code = (
        f"CASE WHEN NOT startswith(p, '&#') THEN NULL WHEN p RLIKE '^&#[xX]?0++;?$' THEN 0 "
        f"WHEN length({decimal}) > 9 OR length({hexadecimal}) > 8 THEN -1 "
        f"WHEN {decimal} <> '' THEN conv({decimal}, 10, 10) ELSE conv({hexadecimal}, 16, 10) END"
    )
    split = f"named_struct('piece', p, 'name', regexp_extract(p, '^&([^;]*+)', 1), 'code', CAST({code} AS BIGINT))"
    valid = "r.code BETWEEN 0 AND 1114111 AND r.code NOT BETWEEN 55296 AND 57343"
    char = f"decode(unhex(lpad(hex(CASE WHEN {valid} THEN r.code END), 8, '0')), 'UTF-32')"
    low = f"try_element_at({_map_sql(_low_code_points())}, CAST(r.code AS STRING))"
    named = f"try_element_at({_map_sql(_named_entities())}, r.name)"
    character = (
        f"CASE WHEN NOT startswith(r.piece, '&') THEN r.piece "
        f"WHEN r.code IS NOT NULL THEN coalesce({low}, {char}, '\\ufffd') "
        f"ELSE coalesce({named}, concat('&', r.name)) END"
    )
    pieces = f"regexp_extract_all({text}, {_REFERENCE}, 0)"
    decoded = f"array_join(transform(transform({pieces}, p -> {split}), r -> {character}), '')"
    return choose(f"contains({text}, '&')", decoded, text)


def decode_entities(column: str) -> Column:
    """`decode_sql` of a column, by name."""
    return F.expr(decode_sql(column))
