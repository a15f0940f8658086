"""Removal rules written as short selectors, turned into predicates over node columns.

Supported: ``tag``, ``.class``, ``#id``, ``[attr='v']``, ``[attr*='v']``, their
concatenation, and one ``parent > child`` step where the parent is named by a tag and an
attribute test. A rule in any other form is skipped with a warning.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from pageloom.functions.sql import choose, literal, literals

_SIMPLE = re.compile(
    r"(?P<tag>[a-z][a-z0-9]*)?(?P<names>(?:[.#][\w-]+)*)"
    r"(?:\[(?P<attr>[a-z]+)(?P<op>\*?=)(?P<q>['\"])(?P<value>.*)(?P=q)\])?"
)


def keys_sql(at: str = "") -> str:
    """What short selectors can name about a node: tag, .class, tag.class, #id, tag#id. Null for non-elements.

    `at` stands before the columns read, here and below: '' for columns, 'n.' for the fields of `n`.
    """
    tag, cls, own = f"{at}tag", f"{at}cls", f"{at}id"
    classes = f"concat(transform({cls}, c -> concat('.', c)), transform({cls}, c -> concat({tag}, '.', c)))"
    classes = choose(f"{cls} IS NULL", "array()", classes)
    ids = choose(f"{own} IS NULL", "array()", f"array(concat('#', {own}), concat({tag}, '#', {own}))")
    named = choose(f"{cls} IS NULL AND {own} IS NULL", f"array({tag})", f"concat(array({tag}), {classes}, {ids})")
    return choose(f"{tag} IS NULL", "NULL", named)


def has_class_sql(*names: str, at: str = "") -> str:
    """True when the node carries one of the classes; false, never null, without any class."""
    return _any_key((f".{name}" for name in names), at)


def _any_key(keys: Iterable[str], at: str = "") -> str:
    """One set lookup per key, for any number of names."""
    names = list(keys)
    if len(names) == 1:
        return f"coalesce(array_contains({at}keys, {literal(names[0])}), false)"
    return f"coalesce(exists({at}keys, k -> k IN ({literals(names)})), false)"


def _attribute_test(name: str, op: str, value: str, at: str) -> str:
    column = f"array_join({at}cls, ' ')" if name == "class" else f"{at}{name}"
    return f"contains({column}, {literal(value)})" if op == "*=" else f"{column} = {literal(value)}"


def _parent_test(parent: re.Match) -> str:
    # `up` holds the parent's start tag for the nodes such rules may select.
    opening = literal(rf"^<{parent['tag']}[\s/>]")
    value = literal(rf"(?si)[\s\"'/]{parent['attr']}\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>]*+)")
    return f"lower(up) RLIKE {opening} AND contains(regexp_extract(up, {value}, 1), {literal(parent['value'])})"


def split_parents(selectors: Iterable[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Selectors of one step, and (parent, child) of those of two; the order stays."""
    steps = [(selector, selector.split(" > ")) for selector in selectors]
    return [s for s, parts in steps if len(parts) != 2], [(parts[0], parts[1]) for _, parts in steps if len(parts) == 2]


def rule_sql(selectors: Iterable[str], at: str = "") -> str:
    """SQL predicate over `keys, tag, cls, style, rel, up` that is true for the nodes any of the selectors picks."""
    keys: list[str] = []
    other: list[str] = []
    for selector in selectors:
        steps = [_SIMPLE.fullmatch(step) for step in selector.split(" > ")]
        if not selector or not all(steps) or len(steps) > 2:
            warnings.warn(f"rule {selector!r} is not supported and is skipped", stacklevel=2)
            continue
        rule = steps[-1]
        names = re.findall(r"[.#][\w-]+", rule["names"])
        tag = rule["tag"] or ""
        named = [tag + name for name in names] or [tag]
        if len(steps) == 1 and not rule["attr"] and len(named) == 1:
            keys.append(named[0])
            continue
        tests = [_any_key([name], at) for name in named if name]
        if rule["attr"]:
            tests.append(_attribute_test(rule["attr"], rule["op"], rule["value"], at))
        if len(steps) == 2:
            tests.append(_parent_test(steps[0]))
        other.append(f"coalesce({' AND '.join(tests)}, false)")
    options = ([_any_key(sorted(set(keys)), at)] if keys else []) + other
    return f"({' OR '.join(options)})" if options else "false"


def rank_sql(selectors: Iterable[str], at: str = "") -> str:
    """Index of the first selector that picks the node, else null."""
    cases = [part for i, s in enumerate(selectors) for part in (rule_sql([s], at), str(i))]
    return choose(*cases) if cases else "CAST(NULL AS INT)"


def matching_sql(selectors: Iterable[str], at: str = "") -> str:
    """Indexes of all selectors that pick the node."""
    hits = [f"CASE WHEN {rule_sql([s], at)} THEN {i} END" for i, s in enumerate(selectors)]
    return f"array_compact(array({', '.join(hits)}))"
