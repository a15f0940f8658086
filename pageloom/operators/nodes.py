"""Pages to nodes: tokens by one regular expression, nesting by a stack scan, one row per node.

A node covers the positions [pos, last]; an element's descendants are exactly the nodes
whose `pos` lies inside, so "below" is a range test and never needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.selectors import keys_sql, rule_sql
from pageloom.functions.sql import add, choose, literal
from pageloom.functions.text import decode_sql, strip_sql
from pageloom.operators.intervals import KEYS, collect, first_match, inside, ordered_text
from pageloom.operators.nesting import nesting
from pageloom.session import deal_pages, spread

# Inside of a tag: quotes bind only after '='. Possessive, so long tags cost no stack.
_INNER = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""

# Lossless: the tokens of a page concatenate back to its HTML.
TOKEN = (
    r"(?si)<!--.*?-->"
    r"|<!\[CDATA\[.*?\]\]>"
    rf"|<(script|style)(?=[\s/>]){_INNER}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
    r"|<(?:[!?]|/(?![a-z]))[^>]*+>"
    rf"|</?[a-z]{_INNER}>"
    r"|(?:[^<]++|<(?![a-z/!?]))++"
    r"|<"
)

# Attributes in order; consuming quoted values whole keeps their content from matching.
_ATTRIBUTE = r"""(?s)[^\s/=>"'<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""

_RAW_START = literal(r"(?i)^<(?:script|style)[\s/>]")
_TAG_NAME = literal(r"^<([a-zA-Z][^\s/>\x00]*+)")
_OP_NAME = literal(r"^</?[a-zA-Z][^\s/>\x00]*+")
_QUOTED = literal(r""""[^"]*+"|'[^']*+'""")
_EMPTY_QUOTES = literal('""')
_UNQUOTED_END = literal(r"""=\s*[^\s"'>][^\s>]*/>$""")
_UP_TO_VALUE = literal(r"(?s)^[^=]*+(?:=\s*+)?+")
_IN_QUOTES = literal(r"""(?s)^(["'])(.*)\1$""")
_HAS_ATTRIBUTES = literal(r"^<[^\s/>]++[\s/]++[^>]")
_ANCHOR = literal(r"(?i)^<a\s")
BLANKS = literal(r"\s+")
NEST = nesting()
NO_MARKS = "CAST(array() AS ARRAY<BIGINT>)"


def tokenize(html: Column) -> Column:
    """All tokens of a page, in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def kind_sql(token: str) -> str:
    """element, end, raw (script and style with their text), comment, cdata, decl or text; null for no token.

    Character tests only: the optimizer repeats this wherever it moves a filter on the kind.
    """
    letter = "upper(substring({}, {}, 1)) BETWEEN 'A' AND 'Z'"
    raw = f"lower(substring({token}, 2, 5)) IN ('scrip', 'style') AND {token} RLIKE {_RAW_START}"
    return choose(
        f"{token} IS NULL", "NULL",
        f"NOT startswith({token}, '<') OR length({token}) = 1", "'text'",
        letter.format(token, 2), choose(raw, "'raw'", "'element'"),
        f"startswith({token}, '</')", choose(letter.format(token, 3), "'end'", "'decl'"),
        f"startswith({token}, '<!--')", "'comment'",
        f"startswith({token}, '<![CDATA[')", "'cdata'",
        f"substring({token}, 2, 1) IN ('!', '?')", "'decl'",
        "'text'",
    )


def tag_sql(token: str) -> str:
    return choose(f"startswith({token}, '<')", f"nullif(lower(regexp_extract({token}, {_TAG_NAME}, 1)), '')")


def op_sql(token: str, tag: str | None = None) -> str:
    """What a token does to the stack: '<name' or '</name', then '/' when self-closed and '!' for infobox starts.

    `tag` is the name of a start tag where it has been read already.
    """
    name = f"lower(regexp_extract({token}, {_OP_NAME}, 0))"
    name = choose(f"{tag} IS NOT NULL", f"concat('<', {tag})", name) if tag else name
    bare = f"regexp_replace({token}, {_QUOTED}, {_EMPTY_QUOTES})"
    # In <a href=x/> the slash belongs to the value.
    valued = f"{bare} RLIKE {_UNQUOTED_END}"
    closed = choose(f"endswith({token}, '/>')", choose(valued, "''", "'/'"), "''")
    box = choose(f"contains({token}, 'infobox')", "'!'", "''")
    return choose(f"startswith({token}, '<')", f"concat({name}, {closed}, {box})", "''")


def attributes_sql(token: str) -> str:
    """The attributes of a start tag as written, null where it has none."""
    return choose(f"{token} RLIKE {_HAS_ATTRIBUTES}", f"regexp_extract_all({token}, {literal(_ATTRIBUTE)}, 0)")


def attr_sql(name: str, attrs: str = "attrs", token: str | None = None) -> str:
    """Value of an attribute, the last one if repeated, '' if it has none, null if absent.

    With the start tag at hand, those without the name in them are not looked at further.
    """
    this_name = literal(rf"(?i)^{name}(?:[\s=]|$)")
    if token:
        return choose(f"contains(lower({token}), '{name}')", attr_sql(name, attrs))
    found = f"try_element_at(filter({attrs}, a -> startswith(lower(a), '{name}') AND a RLIKE {this_name}), -1)"
    return f"regexp_replace(regexp_replace({found}, {_UP_TO_VALUE}, ''), {_IN_QUOTES}, '$2')"


def page_tokens(pages: DataFrame) -> DataFrame:
    """Every row as a page of its own: the keys that tell pages apart, what a page carries along, and its tokens.

    `pages` has `page_id`, `title` (may be null) and `html`. Where an id repeats or is null, `page_hash` and `page_copy` tell rows apart;
    the copy's number only has to differ among equal pages, which meet in one place from one attempt of each task.
    """
    return spread(pages).selectExpr(
        "page_id",
        "xxhash64(title, html) AS page_hash",
        "monotonically_increasing_id() AS page_copy",
        "title",
        f"{'address' if 'address' in pages.columns else 'CAST(NULL AS STRING)'} AS address",
        "coalesce(html <> '', false) AS fetched",
        f"regexp_extract_all(nullif(html, ''), {literal(TOKEN)}, 0) AS tokens",
    )


def string_sql(token: str, kind: str) -> tuple[str, str]:
    """The string of a text token, still encoded, and the one of an instruction or doctype."""
    string = choose(f"{kind} = 'text'", token, f"{kind} = 'cdata'", f"substring({token}, 10, length({token}) - 12)")
    written = choose(
        f"startswith({token}, '<?')", f"substring({token}, 3, length({token}) - 3)",
        f"startswith(lower({token}), '<!doctype')", f"substring({token}, 11, length({token}) - 11)",
    )
    aside = choose(f"{kind} = 'decl'", written)
    return string, aside


def end_sql(token: str) -> str:
    """True for end tags."""
    return f"startswith({token}, '</') AND upper(substring({token}, 3, 1)) BETWEEN 'A' AND 'Z'"


def blank_sql(token: str) -> str:
    """True for comments and blank strings, which no element's place depends on."""
    # Most strings begin with a visible ASCII character, which is cheap to see.
    return choose(f"startswith({token}, '<')", f"startswith({token}, '<!--')", f"ascii({token}) BETWEEN 33 AND 126", "false", f"{strip_sql(token)} = ''")


def nodes(pages: DataFrame) -> DataFrame:
    """One row per node of every page, blank strings left out; a page without tokens keeps one row of null kind.

    Tokens and nesting are found where the page is read. The pages are then shuffled once, still folded, because
    Spark forgets the partitioning across a Python function; whatever later works page by
    page reuses this partitioning.
    """
    scanned = (
        page_tokens(pages)
        .withColumn("nest", NEST(F.expr(f"transform(tokens, t -> {op_sql('t')})"), F.expr(NO_MARKS)))
        .selectExpr(
            *KEYS, "title", "address", "fetched", "tokens",
            "nest.parent AS parent", "nest.last AS last", f"transform(tokens, t -> {tag_sql('t')}) AS tags",
        )
    )
    up = (
        f"transform(tokens, (t, i) -> CASE WHEN t RLIKE {_ANCHOR} AND contains(t, 'image') "
        "THEN get(tokens, get(parent, i)) END)"
    )
    ptag = "transform(parent, p -> get(tags, p))"
    # What is no node goes before the shuffle: end tags, comments, blank strings and the inside of scripts.
    numbered = f"arrays_zip(sequence(0, size(tokens) - 1), tokens, tags, parent, last, {ptag}, {up})"
    bare = f"CASE WHEN x.tags IN ('script', 'style') AND {kind_sql('x.tokens')} = 'raw' THEN concat('<', x.tags, '>') ELSE x.tokens END"
    struct = ", ".join(f"'{name}', x.{name}" for name in ("tags", "parent", "last"))
    live = (
        f"transform(filter({numbered}, x -> x.`0` = 0 OR NOT ({end_sql('x.tokens')} OR {blank_sql('x.tokens')})), x -> named_struct('place', x.`0`, 'token', {bare}, "
        f"{struct}, 'ptag', x.`5`, 'up', x.`6`))"
    )
    folded = scanned.selectExpr(
        *KEYS, "title", "address", "fetched", f"CASE WHEN size(tokens) > 0 THEN {live} END AS live"
    )
    unfolded = deal_pages(folded, pages).selectExpr(*KEYS, "title", "address", "fetched", "explode_outer(live) AS node")
    first = "coalesce(node.place, 0) = 0"
    named = unfolded.selectExpr(
        *KEYS,
        "coalesce(node.place, 0) AS pos",
        f"CASE WHEN {first} THEN title END AS title",
        f"CASE WHEN {first} THEN address END AS address",
        f"CASE WHEN {first} THEN fetched END AS fetched",
        "node.token", "node.parent", "node.last",
        "node.tags AS tag", "node.ptag", "node.up",
        f"{kind_sql('node.token')} AS kind",
    ).filter("pos = 0 OR kind <> 'end'")
    string, aside = string_sql("token", "kind")
    tagged = add(named, attrs=f"CASE WHEN kind = 'element' THEN {attributes_sql('token')} END", string=string, aside=aside)
    valued = add(tagged, raw_src=attr_sql("src"), raw_alt=attr_sql("alt"))
    named = valued.selectExpr(
        *KEYS, "pos", "last", "parent", "ptag", "kind", "tag",
        f"nullif({attr_sql('id')}, '') AS id",
        f"filter(split({attr_sql('class')}, {BLANKS}), c -> c <> '') AS cls",
        f"{attr_sql('style')} AS style",
        f"{decode_sql('raw_src')} AS src",
        f"{decode_sql('raw_alt')} AS alt",
        f"{attr_sql('rel')} AS rel",
        "up",
        f"CASE WHEN kind = 'text' THEN {decode_sql('string')} ELSE string END AS text",
        "aside", "title", "address", "fetched",
    )
    return add(named, keys=keys_sql())


def subtree_text(nodes: DataFrame, selector: str, separator: str) -> DataFrame:
    """`page_id, text`: strings below the page's first match, stripped, blanks dropped, joined; null without a match."""
    spans = add(nodes, span=first_match(rule_sql([selector])))
    strings = collect(f"{inside('span')} AND {strip_sql('text')} <> ''", "pos AS pos", f"{strip_sql('text')} AS s")
    text = F.expr(f"CASE WHEN bool_or(span IS NOT NULL) THEN {ordered_text(strings, separator)} END")
    return spans.groupBy(*KEYS).agg(text.alias("text")).select("page_id", "text")
