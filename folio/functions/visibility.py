"""Liveness, tag predicates and trigger tags."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col, ts_lit


def tombstone_at(metadata="metadata") -> Column:
    """Instant held in ``metadata.tombstone_datetime``.

    Cast strictly (ANSI): malformed text fails the query, as the reference's
    SQL cast does, instead of silently counting a document as live.
    """
    return F.get_json_object(col(metadata), "$.tombstone_datetime").cast("timestamp")


def is_live(tombstone="tombstone_at", as_of=None) -> Column:
    """No tombstone, or one strictly after ``as_of``."""
    t = col(tombstone)
    return t.isNull() | (t > ts_lit(as_of))


def is_due(tombstone="tombstone_at", as_of=None) -> Column:
    """A tombstone at or before ``as_of`` (exact complement of R09)."""
    t = col(tombstone)
    return t.isNotNull() & (t <= ts_lit(as_of))


def tag_predicate(tag, tags, fuzzy: bool = False) -> Column:
    """Exact equality, or case-sensitive ``LIKE '%x%'`` with the user's
    ``%``/``_`` left as wildcards; ORed over the list. Empty list is false."""
    tags = list(tags or [])
    t = col(tag)
    if not tags:
        return F.lit(False)
    if not fuzzy:
        return t.isin(tags)
    return reduce(or_, [t.like(f"%{x}%") for x in tags])


def has_any_tag(tags_col, tags, fuzzy: bool = False) -> Column:
    """Array form of R14: some element of the document's tags matches."""
    tags = list(tags or [])
    if not tags:
        return F.lit(False)
    return F.exists(col(tags_col), lambda t: tag_predicate(t, tags, fuzzy))


def first_trigger_tag(tags_col, trigger_tags) -> Column:
    """First tag in document order that is a trigger tag (exact case)."""
    trig = F.array(*[F.lit(t) for t in trigger_tags]) if trigger_tags else F.array().cast("array<string>")
    hits = F.filter(col(tags_col), lambda t: F.array_contains(trig, t))
    return F.try_element_at(hits, F.lit(1))
