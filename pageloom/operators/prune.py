"""What of a page has a part in the result, decided while the page is still one row.

Rules are evaluated as expressions, once for each different tag of a page, and packed into one integer. The stack scan hands every token the marks of all
around it, so what lies below a removed element is known without a window or a join. Trailing sections, the content
area and the infobox are found on the folded page as well. Only what is left is shuffled and becomes rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.selectors import has_class_sql, keys_sql, rank_sql, rule_sql, split_parents
from pageloom.functions.sql import add, choose, drop, literal, literals
from pageloom.functions.text import decode_sql, normalize_sql, strip_sql
from pageloom.operators.intervals import KEYS, ordered_text
from pageloom.operators.marks import AREA_SHIFT, BIT, BOX_SHIFT, FRAME_SHIFT, FREE_BIT, RANK_MASK, has, pack
from pageloom.operators.nesting import ENTRIES, GATHERED, live_nesting
from pageloom.operators.nodes import (
    BLANKS, attr_sql, attributes_sql, blank_sql, end_sql, kind_sql, op_sql, page_tokens, string_sql, tag_sql,
)
from pageloom.profiles import Profile
from pageloom.session import deal_pages

# Elements whose strings are no part of the text of their surroundings, and
# classes that mark a caption.
QUIET_TAGS = ("rt", "rp", "template")
CAPTION_CLASSES = ("thumbcaption", "gallerytext", "mw-caption-text")

# Elements that shape an infobox or an image; the others there matter only by their marks.
SHAPING_TAGS = ("li", "img", "figure", "sup", "tr", "th", "td", "caption")

# The attributes that rules look at.
_ATTRIBUTES = ("class", "id", "style", "rel")
_LONE = literal(r'^<[a-zA-Z0-9]++ (?:class|id|style|rel)="[^"]*+">$')

_DEAD = BIT["noise"] | BIT["boilerplate"] | BIT["in_title"]
_PARENT_SIDE, _CHILD_SIDE = 0, 1
_STRING = re.compile(r"'(?:[^'\\]|\\.)*'")


class Marks:
    """The marks of a profile: what a token says by itself, and the rules that also name its parent."""

    def __init__(self, profile: Profile, *, keep_images: bool, keep_infobox: bool):
        self.profile, self.keep_images, self.keep_infobox = profile, keep_images, keep_infobox
        self.links: list[tuple[int, int, int]] = []
        self.sides: dict[tuple[str, int], int] = {}
        self.frames = profile.image_containers if keep_images else ()
        groups = {
            "title": [profile.title],
            "noise": profile.preprocess,
            "boilerplate": profile.boilerplate + (() if keep_infobox else profile.infobox),
            "picture": () if keep_images else profile.image_drop,
            "frame": self.frames,
        }
        self.rules = {name: self._split(name, rules) for name, rules in groups.items()}

    def _side(self, selector: str, side: int) -> int:
        place = self.sides.setdefault((selector, side), FREE_BIT + len(self.sides))
        if place >= AREA_SHIFT:
            raise ValueError("too many rules that name a parent")
        return 1 << place

    def _split(self, name: str, rules: Iterable[str]) -> list[str]:
        """The rules about a node alone; the others become links."""
        simple, pairs = split_parents(rules)
        for parent, child in pairs:
            rank = list(rules).index(f"{parent} > {child}") + 1 if name == "frame" else 0
            self.links.append((self._side(child, _CHILD_SIDE), self._side(parent, _PARENT_SIDE), BIT[name] | rank << FRAME_SHIFT))
        return simple

    def sql(self, node: str) -> str:
        """Marks of an element or declaration from the fields of `node`, null for other tokens."""
        at = f"{node}."
        tag = f"{at}tag"
        marks = {name: rule_sql(rules, at) for name, rules in self.rules.items() if rules}
        marks |= {
            "headline": f"{tag} = 'span' AND {has_class_sql('mw-headline', at=at)}",
            "hidden": f"{tag} = 'span' AND contains(lower({at}style), 'display:none')",
            "skipped": f"{tag} IN ({literals(self.profile.skip_tags)}) OR {has_class_sql(*self.profile.skip_classes, at=at)}",
            "quiet": f"{tag} IN ({literals(QUIET_TAGS)}) OR {at}decl",
        }
        if self.keep_infobox:
            marks["note"] = f"{tag} = 'sup' AND {has_class_sql('reference', at=at)}"
        if self.keep_images:
            marks["caption_0"] = f"{tag} IN ('figcaption', 'div') AND {has_class_sql(*CAPTION_CLASSES, at=at)}"
            marks["caption_1"] = f"contains(array_join({at}cls, ' '), 'caption')"
        sides = " | ".join(
            f"if({rule_sql([selector], at)}, {1 << place}L, 0L)" for (selector, _), place in self.sides.items()
        )
        area = f"shiftleft(CAST(coalesce({rank_sql(self.profile.areas, at)} + 1, 0) AS BIGINT), {AREA_SHIFT})"
        box = rank_sql(self.profile.infobox if self.keep_infobox else (), at)
        box = f"shiftleft(CAST(coalesce({box} + 1, 0) AS BIGINT), {BOX_SHIFT})"
        cases = [f"WHEN {rule_sql([rule], at)} THEN {i + 1}" for i, rule in enumerate(self.frames) if " > " not in rule]
        frame = f"shiftleft(CAST(CASE {' '.join(cases)} ELSE 0 END AS BIGINT), {FRAME_SHIFT})" if cases else ""
        own = " | ".join(filter(None, [f"CAST({pack(marks)} AS BIGINT)", sides, area, box, frame]))
        return f"if({node} IS NULL, 0L, {own})"

    def bare_tags(self) -> list[str]:
        """Names of elements that rules pick without looking at attributes."""
        rules = [r for group in self.rules.values() for r in group] + [selector for selector, _ in self.sides]
        rules += [*self.profile.areas, *self.profile.infobox]
        return sorted({*QUIET_TAGS, *self.profile.skip_tags, *(r for r in rules if r.isalnum())})


def _parsed(token: str, tag: str, telling: str) -> str:
    """Tag, classes, id, style and rel of a start tag; null for strings, end tags, comments and tags that no rule can pick.

    `tag` is the name of a start tag, `telling` what is true for the names that say something without any attribute.
    """
    letter = f"upper(substring({token}, 2, 1)) BETWEEN 'A' AND 'Z'"
    decl = f"substring({token}, 2, 1) IN ('!', '?', '/') AND {kind_sql(token)} = 'decl'"
    # Other attributes are no part of any rule. A name in its brackets alone, as most, has none.
    named = " OR ".join(f"contains(lower({token}), '{name}')" for name in _ATTRIBUTES)
    asked = f"(contains({token}, '=') OR length({token}) <> length({tag}) + 2) AND ({named})"
    # One of them alone in plain quotes, the usual case, is cut out; a tag named like an attribute is none of these.
    at = f"instr({token}, '=')"
    lone = f"endswith({token}, '\">') AND {token} RLIKE {_LONE} AND {tag} NOT IN ({literals(_ATTRIBUTES)})"
    cut = (
        f"'name', substring({token}, length({tag}) + 3, {at} - length({tag}) - 3), "
        f"'value', substring({token}, {at} + 2, length({token}) - {at} - 3)"
    )
    none, no_list = "CAST(NULL AS STRING)", "CAST(NULL AS ARRAY<STRING>)"
    uncut = f"'name', {none}, 'value', {none}"
    single = f"named_struct('tag', {tag}, 'token', {none}, 'attrs', {no_list}, 'decl', false, {cut})"
    attrs = choose(asked, attributes_sql(token))
    read = f"named_struct('tag', {tag}, 'token', {token}, 'attrs', {attrs}, 'decl', false, {uncut})"
    blank = f"named_struct('tag', {none}, 'token', {none}, 'attrs', {no_list}, 'decl', true, {uncut})"
    return choose(f"NOT startswith({token}, '<')", "NULL", letter, choose(lone, single, f"{telling} OR {asked}", read), decl, blank)


def _named(node: str) -> str:
    def value(name: str) -> str:
        return attr_sql(name, f"{node}.attrs", f"{node}.token")

    def alone(name: str) -> str:
        return choose(f"{node}.name = '{name}'", f"{node}.value")

    classes = f"filter(split({value('class')}, {BLANKS}), c -> c <> '')"
    several = f"filter(split({node}.value, {BLANKS}), c -> c <> '')"
    one_class = choose(f"{node}.name <> 'class'", "NULL", f"{node}.value = '' OR {node}.value RLIKE {BLANKS}", several, f"array({node}.value)")
    none = "CAST(NULL AS STRING)"
    with_keys = (
        f"named_struct('tag', {node}.tag, 'decl', {node}.decl, 'cls', {classes}, 'id', nullif({value('id')}, ''), "
        f"'style', {value('style')}, 'rel', {value('rel')})"
    )
    bare = (
        f"named_struct('tag', {node}.tag, 'decl', {node}.decl, 'cls', CAST(NULL AS ARRAY<STRING>), 'id', {none}, 'style', {none}, 'rel', {none})"
    )
    single = (
        f"named_struct('tag', {node}.tag, 'decl', false, 'cls', {one_class}, 'id', nullif({alone('id')}, ''), "
        f"'style', {alone('style')}, 'rel', {alone('rel')})"
    )
    return choose(f"{node} IS NULL", "NULL", f"{node}.name IS NOT NULL", single, f"{node}.attrs IS NULL", bare, with_keys)


def heading_sql(texts: str, headline: str, separator: str) -> str:
    """Text of a heading, or of its headline span where it has one."""
    own = f"filter({texts}, t -> {headline} IS NULL OR t.pos BETWEEN {headline}.pos AND {headline}.last)"
    return normalize_sql(ordered_text(own, separator))


def _shown(marks: Marks, *, text: bool) -> tuple[str, str]:
    """Which tokens `x` of a folded page become rows, and the zone of each."""
    titled, quiet = has("in_title", "x.mask"), has("quiet", "x.mask")
    boxed = f"{_IN_BOX} AND NOT {has('noise', 'x.mask')}" if marks.keep_infobox else "false"
    telling = "x.tags IS NULL OR x.ptag IN ('ul', 'ol') OR x.tags IN ({}) OR (x.own & {}) <> 0".format(
        literals(SHAPING_TAGS), sum(BIT[n] for n in ("note", "caption_0", "caption_1", "quiet"))
    )
    live = [f"({titled} AND x.tags IS NULL AND NOT {quiet})"] if text else []
    if marks.keep_infobox:
        live.append(f"({boxed} AND NOT {titled} AND ({telling}))")
    framed = f"({has('frame', 'x.mask')} OR x.tags <=> 'img')" if marks.keep_images else "false"
    if marks.keep_images:
        live.append(f"({_live('x')} AND {framed} AND ({telling}))")
    if text:
        speaks = f"x.tags IS NULL OR x.place = x.unit OR {has('headline', 'x.own')}"
        below = "x.place > area.pos AND x.place <= area.last"
        live.append(f"({_live('x')} AND {below} AND x.unit >= 0 AND NOT {framed} AND NOT {has('picture', 'x.mask')} AND ({speaks}))")
    zone = choose(titled, "'title'", boxed, "'box'", framed, "'live'", "'text'")
    alive = f"NOT coalesce(x.tags IN ('script', 'style'), false) AND NOT ({end_sql('x.tokens')})"
    return f"({' OR '.join(live) or 'false'}) AND {alive}", zone


_IN_BOX = "x.place BETWEEN box_pos AND box_last"


def _live(node: str) -> str:
    """True outside of the title, the infobox and everything removed by rule."""
    return f"({node}.mask & {_DEAD}) = 0 AND NOT ({node}.place BETWEEN box_pos AND box_last)"


def _with_trailing(folded: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """`trail`, the headings that name a trailing section, and `tokens_left`, the page without what those sections take.

    A section takes the following siblings, elements only, up to a heading of its rank or above; the scan has found
    where that is. Outermost sections don't overlap, so the page is cut at their ends.
    """
    around = "slice(every, h.head + 1, h.inner - h.head + 1)"
    live = add(
        folded,
        heading=f"transform(filter(arrays_zip(head, until, inner), h -> NOT (get(place, h.head) BETWEEN box_pos AND box_last)), h -> named_struct("
        f"'pos', h.head, 'until', h.until, 'parent', get(parent, h.head), 'inner', filter({around}, x -> {_live('x')})))",
    )
    kind = kind_sql("x.tokens")
    string, _ = string_sql("x.tokens", kind)
    string = choose(f"{kind} = 'text'", decode_sql("x.tokens"), string)
    strings = f"filter(h.inner, x -> x.tags IS NULL AND NOT {has('quiet', 'x.mask')} AND NOT ({end_sql('x.tokens')}))"
    texts = f"transform({strings}, x -> named_struct('pos', x.place, 's', {strip_sql(string)}))"
    spans = f"transform(filter(h.inner, x -> {has('headline', 'x.own')}), x -> named_struct('pos', x.place, 'last', x.last))"
    read = add(
        live,
        heading=f"transform(heading, h -> named_struct('pos', h.pos, 'until', h.until, 'parent', h.parent, "
        f"'texts', {texts}, 'headline', array_min({spans})))",
    )
    name = f"lower({heading_sql('h.texts', 'h.headline', ' ')})"
    named = add(read, heading=f"transform(heading, h -> named_struct('pos', h.pos, 'until', h.until, 'parent', h.parent, 'name', {name}))")
    found = add(named, trail=f"filter(heading, h -> exists(array({literals(keywords)}), k -> contains(h.name, k)))").drop("heading")
    outer = add(found, outer="filter(trail, (h, i) -> NOT exists(slice(trail, 1, i), g -> g.until >= h.pos))")
    stays = f"x.tags IS NULL AND x.parent = h.parent OR {has('in_title', 'x.mask')} OR {_IN_BOX}"
    cut = (
        "flatten(concat(array(slice(every, 1, outer[0].pos)), "
        f"transform(outer, h -> filter(slice(every, h.pos + 1, h.until - h.pos + 1), x -> {stays})), "
        "transform(outer, (h, i) -> slice(every, h.until + 2, coalesce(get(outer, i + 1).pos, size(every)) - h.until - 1))))"
    )
    return add(outer, tokens_left=f"CASE WHEN size(outer) > 0 THEN {cut} ELSE every END").drop("outer", "every")


def live_nodes(
    pages: DataFrame, profile: Profile, *, text: bool, keep_images: bool, keep_infobox: bool, count_trailing: bool = False
) -> DataFrame:
    """One row per node that has a part in the result, and one of zone `page` per page with the page's own columns.

    Zones: `title`, `box` (the infobox), `live` (images and their containers), `text` (what the content area puts out). A text row is
    a unit, a heading, a paragraph, a definition item or a node on its own, with its strings in `texts` and the headline span of a
    heading; the title is one row. With `count_trailing` rows also carry `n_trailing`, the number of headings that started a removed section.
    """
    marks = Marks(profile, keep_images=keep_images, keep_infobox=keep_infobox)
    telling = f"coalesce(g IN ({literals(marks.bare_tags())}), false)"
    parsed = f"transform(zip_with(vocabulary, names, (t, g) -> {_parsed('t', 'g', telling)}), p -> {_named('p')})"
    own = marks.sql("n")
    # Keys that no rule names are no match for any; all that rules name are among the strings of their tests.
    known = ", ".join(sorted(set(_STRING.findall(own))))
    with_keys = (
        "transform(parsed, n -> if(n IS NULL, NULL, named_struct('tag', n.tag, 'decl', n.decl, 'cls', n.cls, 'id', n.id, "
        f"'style', n.style, 'rel', n.rel, 'keys', filter({keys_sql('n.')}, k -> k IN ({known})))))"
    )
    read = add(page_tokens(pages), tokens=f"filter(tokens, t -> NOT ({blank_sql('t')}))")
    # A page says the same few tags again and again.
    read = add(read, vocabulary="array_distinct(filter(tokens, t -> startswith(t, '<')))")
    read = add(read, names=f"transform(vocabulary, t -> if(upper(substring(t, 2, 1)) BETWEEN 'A' AND 'Z', {tag_sql('t')}, NULL))")
    read = add(read, parsed=parsed)
    read = add(read, parsed=with_keys)
    read = add(read, own=f"transform(parsed, n -> {own})")
    words = F.expr("transform(tokens, t -> if(startswith(t, '<'), t, ''))")
    ops = F.expr(f"zip_with(vocabulary, names, (t, g) -> {op_sql('t', 'g')})")
    nest = live_nesting(marks.links)(words, F.col("vocabulary"), ops, F.col("own"))
    scanned = read.drop("parsed").withColumn("nest", nest).drop("vocabulary")
    found = ("place", "parent", "last", "mask", "unit", "head", "until", "inner", "owner", "items")
    scanned = add(
        scanned,
        tokens="transform(nest.place, p -> get(tokens, p))",
        tags="transform(nest.word, w -> get(names, w))",
        ptag="transform(nest.around, w -> get(names, w))",
        own="transform(nest.word, w -> coalesce(get(own, w), 0L))",
        box_pos="nest.box",
        box_last="nest.box_last",
        **{name: f"nest.{name}" for name in found},
    ).drop("nest", "names")
    fields = ["place", "tokens", "tags", "own", "mask", "parent", "last", "unit", "ptag"]
    fields += ["owner"] * keep_images + ["items"] * keep_infobox
    folded = add(scanned, every=f"arrays_zip({', '.join(fields)})")
    if profile.trailing_keywords:
        folded = _with_trailing(folded, profile.trailing_keywords)
    else:
        folded = folded.withColumnRenamed("every", "tokens_left")
    if text:
        rank = f"shiftright(x.own, {AREA_SHIFT}) & {RANK_MASK}"
        gone = f"(x.mask & {BIT['picture'] | BIT['frame']}) <> 0"
        areas = f"filter(tokens_left, x -> ({rank}) > 0 AND {_live('x')} AND NOT {gone})"
        folded = add(folded, area=f"array_min(transform({areas}, x -> named_struct('rank', {rank}, 'pos', x.place, 'last', x.last)))")
    shown, zone = _shown(marks, text=text)
    quiet = f"if({has('quiet', 'x.mask')}, {BIT['in_quiet']}, 0)"
    columns = {
        "pos": ("INT", "x.place"),
        "last": ("INT", "x.last"),
        "parent": ("INT", "x.parent"),
        "tag": ("STRING", "x.tags"),
        "list": ("INT", "if(x.ptag = 'ul', 1, if(x.ptag = 'ol', 2, NULL))"),
        "marks": ("INT", f"CAST(x.own & {(1 << AREA_SHIFT) - 1} AS INT) | {quiet}"),
        "token": ("STRING", "if(x.tags IS NULL OR x.tags = 'img', x.tokens, NULL)"),
        "text_unit": ("INT", "x.unit"),
        "zone": ("STRING", zone),
    }
    if text:
        # The strings of a unit lie below it; a unit with a wall around it ends before the next of its kind, so each is looked at twice at most.
        below = "slice(shown, i + 2, x.last - x.place)"
        zone_below, string = zone.replace("x.", "y."), "named_struct('pos', y.place, 'token', y.tokens)"
        strings = f"transform(filter({below}, y -> y.unit = x.place AND y.tags IS NULL AND {zone_below} = 'text'), y -> {string})"
        spans = f"filter({below}, y -> y.unit = x.place AND {has('headline', 'y.own')} AND {zone_below} = 'text')"
        texts = choose("x.tags IS NULL", f"array({string.replace('y.', 'x.')})", f"x.tags IN ({literals(sorted(GATHERED | ENTRIES))})", strings)
        headline = f"array_min(transform({spans}, y -> named_struct('pos', y.place, 'last', y.last)))"
        columns["texts"] = ("ARRAY<STRUCT<pos: INT, token: STRING>>", choose(f"{zone} = 'text'", texts))
        columns["headline"] = ("STRUCT<pos: INT, last: INT>", choose(f"{zone} = 'text' AND x.tags IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')", headline))
        if keep_images or keep_infobox:
            columns["token"] = ("STRING", f"if({zone} <> 'text' AND (x.tags IS NULL OR x.tags = 'img'), x.tokens, NULL)")
        else:
            del columns["token"], columns["marks"]
    of_title = {"pos": "-1", "zone": "'title'", "texts": f"transform(filter(shown, y -> {zone.replace('x.', 'y.')} = 'title'), y -> named_struct('pos', y.place, 'token', y.tokens))"}
    if keep_images:
        columns["owner"] = ("BIGINT", "x.owner")
    if keep_infobox:
        columns["items"] = ("ARRAY<INT>", "x.items")
    own = {"pos": "-1", "zone": "'page'"}
    page = ", ".join(f"'{name}', {own.get(name, f'CAST(NULL AS {kind})')}" for name, (kind, _) in columns.items())
    node = ", ".join(f"'{name}', {value}" for name, (_, value) in columns.items())
    if text:
        folded = add(folded, shown=f"coalesce(filter(tokens_left, x -> {shown}), array())")
        title = ", ".join(f"'{name}', {of_title.get(name, f'CAST(NULL AS {kind})')}" for name, (kind, _) in columns.items())
        kept = choose(f"{zone} = 'title' OR {zone} = 'text' AND x.place <> x.unit", "NULL", f"named_struct({node})")
        rows = (
            f"concat(array(named_struct({page})), filter(array(named_struct({title})), n -> size(n.texts) > 0), "
            f"filter(transform(shown, (x, i) -> {kept}), n -> n IS NOT NULL))"
        )
    else:
        rows = f"concat(array(named_struct({page})), coalesce(transform(filter(tokens_left, x -> {shown}), x -> named_struct({node})), array()))"
    carried = {"box_pos": "box_pos"} if keep_infobox else {}
    if text:
        carried["area_pos"] = "area.pos"
    if count_trailing:
        carried["n_trailing"] = "size(trail)" if profile.trailing_keywords else "0"
    pruned = folded.selectExpr(
        *KEYS, "title", "address", "fetched", *(f"{value} AS {name}" for name, value in carried.items()), f"{rows} AS live"
    )
    unfolded = deal_pages(pruned, pages).selectExpr(*KEYS, "title", "address", "fetched", *carried, "explode_outer(live) AS n").selectExpr(
        *KEYS,
        "CASE WHEN n.zone = 'page' THEN named_struct('title', title, 'address', address, 'fetched', fetched) END AS page",
        *carried,
        "n.*",
    )
    return _decoded(unfolded, keep_images=keep_images, keep_infobox=keep_infobox, text=text)


def _not_blank(string: str) -> str:
    return f"{strip_sql(string)} <> ''"


def _decoded(rows: DataFrame, *, keep_images: bool, keep_infobox: bool, text: bool) -> DataFrame:
    """Strings and image attributes of the rows; a string that is blank once decoded is null, and left out of `texts`."""
    read = rows
    if text:
        string, aside = string_sql("t.token", "t.kind")
        decoded = choose("t.kind = 'text'", decode_sql("t.token"), string)
        for each in (
            f"named_struct('pos', t.pos, 'token', t.token, 'kind', {kind_sql('t.token')})",
            f"named_struct('pos', t.pos, 'string', {decoded}, 'aside', {aside})",
            f"named_struct('pos', t.pos, 's', {choose(_not_blank('t.string'), 't.string', _not_blank('t.aside'), 't.aside')})",
        ):
            read = add(read, texts=f"transform(texts, t -> {each})")
        read = add(read, texts="coalesce(filter(texts, t -> t.s IS NOT NULL), array())")
    if not text or keep_images or keep_infobox:
        kind = kind_sql("token")
        read = add(read, kind=f"CASE WHEN tag IS NULL THEN {kind} END")
        string, aside = string_sql("token", "kind")
        read = add(read, string=string, aside=aside)
        read = add(read, string=f"CASE WHEN kind = 'text' THEN {decode_sql('string')} ELSE string END")
        # Instructions and doctypes are strings of the text around them, but of no title, heading or paragraph.
        shown = f"CASE WHEN {_not_blank('string')} THEN string WHEN {_not_blank('aside')} THEN aside END"
        # No filter here: it would move below the decoding and repeat it.
        read = add(read, text=shown).drop("string", "aside", "kind")
    if keep_images:
        read = add(read, attrs=f"CASE WHEN tag = 'img' THEN {attributes_sql('token')} END")
        read = add(read, src=attr_sql("src"), alt=attr_sql("alt")).drop("attrs")
        read = add(read, src=decode_sql("src"), alt=decode_sql("alt"))
    if keep_infobox:
        read = add(read, box_pos="CASE WHEN zone = 'box' THEN box_pos END")
    if text:
        read = add(read, is_root="zone = 'text' AND parent = area_pos", has_area="area_pos IS NOT NULL").drop("area_pos")
    return drop(read, "token")
