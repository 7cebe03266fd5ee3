"""Row-local business rules as native Column expressions."""

from folio.functions.dates import bucket_width, effective_date, effective_date_strict, parse_date_text, timeline_plan
from folio.functions.scores import best_image, meets_threshold, popularity, score_gate, size_factor
from folio.functions.tags import analyzer_tags, assemble_tags, merge_tags, normalize_tag
from folio.functions.text import (
    clean_author,
    insert_image,
    paragraph_html,
    slug_source,
    slugify,
    slugify_or,
    utf8_prefix,
)
from folio.functions.urls import (
    domain_tag,
    is_image_url,
    is_scrapable_url,
    normalize_url,
    resolve_link,
    url_key,
)
from folio.functions.visibility import first_trigger_tag, has_any_tag, is_due, is_live, tag_predicate, tombstone_at

__all__ = [
    "analyzer_tags", "assemble_tags", "best_image", "bucket_width", "clean_author", "domain_tag",
    "effective_date", "effective_date_strict", "first_trigger_tag", "has_any_tag", "insert_image",
    "is_due", "is_image_url", "is_live", "is_scrapable_url", "meets_threshold", "merge_tags",
    "normalize_tag", "normalize_url", "paragraph_html", "parse_date_text", "popularity",
    "resolve_link", "score_gate", "size_factor", "slug_source", "slugify", "slugify_or",
    "tag_predicate", "timeline_plan", "tombstone_at", "url_key", "utf8_prefix",
]
