"""Output shape of an article: which fields, under which names, beside which constants."""

from __future__ import annotations

import json
import warnings
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.jsontext import json_object, json_string

# The placeholders, in the order of the default template.
BASE_FIELDS = ("title", "url", "content", "sections")
FIELDS = (*BASE_FIELDS, "images", "infobox_data")
_LISTS = {"sections": "array<string>", "images": "array<struct<src:string,alt:string,caption:string>>"}


def default_template(*, keep_images: bool = False, keep_infobox: bool = False) -> dict[str, Any]:
    """The four base fields, and the optional ones that are kept."""
    optional = [name for name, kept in (("images", keep_images), ("infobox_data", keep_infobox)) if kept]
    return {name: "{" + name + "}" for name in (*BASE_FIELDS, *optional)}


def check_template(template: dict[str, Any], *, keep_images: bool = False, keep_infobox: bool = False) -> list[str]:
    """Warnings for parts that are extracted but that no value of the template mentions."""
    mentioned = str(list(template.values()))
    notes = [
        f"{name} is extracted but the template has no {{{name}}}"
        for name, kept in (("images", keep_images), ("infobox_data", keep_infobox))
        if kept and "{" + name + "}" not in mentioned
    ]
    for note in notes:
        warnings.warn(note, stacklevel=2)
    return notes


def placeholder(value: Any) -> str | None:
    """Field name of a value that is exactly one placeholder; placeholders inside other values stay text."""
    if isinstance(value, str) and value.startswith("{") and value.endswith("}"):
        return value[1:-1]
    return None


def _field(articles: DataFrame, name: str) -> Column:
    """A field of the article; null where the table lacks it or nobody knows it."""
    if name not in FIELDS:
        warnings.warn(f"placeholder {{{name}}} is unknown, its value is null", stacklevel=3)
        return F.lit(None).cast("string")
    if name not in articles.columns:
        return F.lit(None).cast(_LISTS.get(name, "string"))
    return F.col(name)


def _constant(value: Any) -> Column:
    if isinstance(value, dict):
        return F.struct(*(_constant(v).alias(str(k)) for k, v in value.items())) if value else F.parse_json(F.lit("{}"))
    if isinstance(value, list):
        kinds = {type(v) for v in value}
        if len(kinds) == 1 and kinds <= {str, int, float, bool}:
            return F.array(*map(F.lit, value))
        return F.parse_json(F.lit(json.dumps(value)))
    return F.lit(value)


def shape(articles: DataFrame, template: dict[str, Any], *, objects: bool = False) -> DataFrame:
    """One column per template key, in template order.

    `infobox_data` is JSON text with its keys in page order; with `objects` it is a VARIANT, which writers
    put out as an object, keys sorted.
    """
    columns = []
    for key, value in template.items():
        name = placeholder(value)
        column = _constant(value) if name is None else _field(articles, name)
        if objects and name == "infobox_data":
            column = F.parse_json(column)
        columns.append(column.alias(key))
    return articles.select(*columns)


def article_json(articles: DataFrame, template: dict[str, Any]) -> Column:
    """The article as JSON text: template order, explicit nulls, characters unescaped."""
    pairs = []
    for key, value in template.items():
        name = placeholder(value)
        if name is None:
            text = F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str))
        else:
            field = _field(articles, name)
            if name in _LISTS:
                text = F.coalesce(F.to_json(field, {"ignoreNullFields": "false"}), F.lit("null"))
            elif name == "infobox_data":
                text = F.coalesce(field, F.lit("null"))
            else:
                text = json_string(field)
        pairs.append((key, text))
    return json_object(pairs)
