"""JSON text where the order of keys matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A JSON string literal, or null."""
    packed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), packed.substr(F.lit(2), F.length(packed) - 2)).otherwise("null")


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """An object from (key, JSON text) pairs, in their order."""
    fields = [F.concat(json_string(F.lit(key)), F.lit(":"), value) for key, value in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def entries_json(entries: Column) -> Column:
    """Infobox entries as one object; a list entry stays a list; no entry at all is null."""
    fields = F.transform(
        entries,
        lambda e: F.concat(
            json_string(e["key"]), F.lit(":"), F.when(e["is_list"], F.to_json(e["vals"])).otherwise(json_string(e["vals"][0]))
        ),
    )
    return F.when(F.size(entries) > 0, F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))
