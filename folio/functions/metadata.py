"""Typed edits of the JSON metadata document.

Metadata stays JSON text at rest. An edit parses it to map<string, variant>,
overlays keys with map_concat (LAST_WIN, set by ``folio.session``) and writes
it back with to_json — untouched keys keep their JSON types, nested objects
stay objects. Only rows that change are re-serialised (the edit sits in the
matched branch of a CASE).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col

MAP_TYPE = "map<string,variant>"


def empty_meta() -> Column:
    return F.create_map().cast(MAP_TYPE)


def meta_map(metadata="metadata") -> Column:
    """The document's metadata keys. Null and blank text count as ``{}``; text
    that is not a JSON object fails the job, since an edit would erase it."""
    text = col(metadata)
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    parsed = F.from_json(text, MAP_TYPE, {"mode": "PERMISSIVE"})
    whole = F.when(is_object(F.try_parse_json(text)), parsed)
    broken = F.raise_error(F.concat(F.lit("metadata is not a JSON object: "), F.substring(text, 1, 200))).cast(MAP_TYPE)
    return F.when(blank, empty_meta()).otherwise(F.coalesce(whole, broken))


def entry(key: str, value: Column) -> Column:
    """One-key map; ``value`` must already be a VARIANT."""
    return F.create_map(F.lit(key), value)


def maybe_entry(cond: Column, key: str, value: Column) -> Column:
    return F.when(cond, entry(key, value)).otherwise(empty_meta())


def vtext(c) -> Column:
    return col(c).cast("string").cast("variant")


def vjson(c) -> Column:
    """VARIANT from JSON text (objects, arrays, numbers keep their types)."""
    return F.parse_json(col(c))


def overlay(metadata, *maps: Column) -> Column:
    return F.map_concat(meta_map(metadata), *maps)


def drop_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != F.lit(key))


def to_text(m: Column) -> Column:
    return F.to_json(m)


def variant_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_string(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))


def is_object(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))


def is_array(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith("ARRAY"), F.lit(False))


def is_number(x: Column) -> Column:
    return F.coalesce(
        F.schema_of_variant(x).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), F.lit(False)
    )
