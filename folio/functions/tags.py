"""Tag rules (R44, R46, R47, R48), all native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col
from folio.functions.urls import domain_tag

def empty_tags() -> Column:
    return F.array().cast("array<string>")


def normalize_tag(tag) -> Column:
    """Keep at most the first two '-'-separated parts."""
    return F.substring_index(col(tag), "-", 2)


def assemble_tags(categories, url) -> Column:
    """Normalised categories, then the domain if any, then 'scrape'.
    Order kept, duplicates kept."""
    cats = F.coalesce(col(categories), empty_tags())
    domain = domain_tag(url)
    return F.concat(
        F.transform(cats, normalize_tag),
        F.when(domain != "", F.array(domain)).otherwise(empty_tags()),
        F.array(F.lit("scrape")),
    )


def merge_tags(existing, ai) -> Column:
    """Append AI tags not yet present case-insensitively (also among
    themselves), keeping each new tag's own spelling and order."""
    base = F.coalesce(col(existing), empty_tags())
    return F.aggregate(
        F.coalesce(col(ai), empty_tags()),
        base,
        lambda acc, t: F.when(
            t.isNull() | F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc
        ).otherwise(F.concat(acc, F.array(t))),
    )


def variant_strings(v: Column, path: str) -> Column:
    """String elements of the JSON array at ``path`` of a VARIANT (others skipped);
    null when the value is not an array."""
    arr = F.try_variant_get(v, path, "array<variant>")
    kept = F.filter(arr, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(kept, lambda x: F.variant_get(x, "$", "string"))


def analyzer_tags(metadata) -> Column:
    """String elements of the ``tags`` array of analysis metadata (JSON
    text), normalised; empty when absent or not an array."""
    v = F.try_parse_json(col(metadata))
    return F.coalesce(F.transform(variant_strings(v, "$.tags"), normalize_tag), empty_tags())
