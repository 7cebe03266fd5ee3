"""DuckDB oracles: for each registered query, the same result written as plain
SQL over the driver's tables. The fixture rules (FIXTURES.md §3) are
re-derived here independently — directly from the source columns — so an
oracle does not go through the JSON metadata the Spark side builds and parses.
"""

from __future__ import annotations

from folio.functions.text import FIGURE_HTML
from folio.functions.urls import IMAGE_EXTENSIONS, TRACKING_PARAMS
from folio.plans.common import AS_OF, CORPUS_END, CORPUS_START, TIMELINE_END, TIMELINE_START, sql_ts

AS_OF_SQL = sql_ts(AS_OF)


def fixture_time_sql(x: str) -> str:
    return f"make_timestamp(CAST((1704067200 + 60 * (({x} * 7919) % 43200)) * 1000000 AS BIGINT))"


def fmt_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def normalize_tag_sql(x: str) -> str:
    return f"(CASE WHEN len(string_split({x}, '-')) <= 2 THEN {x} ELSE array_to_string(string_split({x}, '-')[1:2], '-') END)"


def slugify_sql(x: str) -> str:
    s = f"strip_accents(lower({x}))"
    s = f"regexp_replace({s}, '[ _]', '-', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9-]+', '', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    return f"coalesce(rtrim(left(trim({s}, '-'), 100), '-'), '')"


def prefix_bytes_sql(x: str, n: int = 100) -> str:
    """Longest character prefix of x whose UTF-8 length is at most n bytes."""
    return (
        f"left({x}, CAST(list_max(list_filter(range(0, {n + 1}), "
        f"lambda i: strlen(left({x}, CAST(i AS INTEGER))) <= {n})) AS INTEGER))"
    )


def domain_sql(url: str) -> str:
    host = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    return f"(CASE WHEN starts_with({host}, 'www.') THEN substr({host}, 5) ELSE {host} END)"


def live_sql(tomb: str = "tombstone_at") -> str:
    return f"({tomb} IS NULL OR {tomb} > {AS_OF_SQL})"


# D1 — the document corpus, both branches.
CORPUS_CTE = f"""
d1_pages AS (
  SELECT page_id AS k, url, html, {fixture_time_sql('page_id')} AS created_at,
         CASE page_id % 5 WHEN 0 THEN ['technical', 'education'] WHEN 1 THEN ['social_media']
              WHEN 2 THEN ['machine-learning-model'] WHEN 3 THEN ['image', 'media'] ELSE ['news'] END AS categories
  FROM pages
),
d1_url AS (
  SELECT 'p' || CAST(k AS VARCHAR) AS id, created_at,
         CASE WHEN k % 3 = 0 THEN created_at - INTERVAL 10 DAY ELSE created_at END AS effective_date,
         'url' AS source_type, url AS source_url, 's' || CAST(k AS VARCHAR) AS scraper_uuid,
         list_transform(categories, lambda c: {normalize_tag_sql('c')})
           || (CASE WHEN {domain_sql('url')} <> '' THEN [{domain_sql('url')}] ELSE []::VARCHAR[] END)
           || ['scrape'] AS tags,
         'page-' || CAST(k AS VARCHAR) AS slug,
         k % 10 <> 0 AS seo_enabled,
         CASE WHEN k % 7 = 0 THEN created_at + to_hours(CAST(k % 72 AS BIGINT)) END AS tombstone_at,
         CAST((k * 37) % 100 AS DOUBLE) / 100.0 AS score, categories, k, html
  FROM d1_pages
),
d1_texts AS (
  SELECT d.doc_id AS k, d.text, d.lang, d.source, l.quality, l.toxic,
         {fixture_time_sql('d.doc_id')} AS created_at,
         CASE WHEN d.doc_id % 50 = 1 THEN (SELECT text FROM documents WHERE doc_id = 1) ELSE d.text END AS slug_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
d1_text AS (
  SELECT 'd' || CAST(k AS VARCHAR) AS id, created_at, created_at AS effective_date,
         'text' AS source_type, CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS VARCHAR) AS scraper_uuid,
         [lang, source] || (CASE WHEN quality = 0 THEN ['low-quality'] ELSE []::VARCHAR[] END) AS tags,
         CASE WHEN {slugify_sql(prefix_bytes_sql('slug_text'))} = '' THEN {slugify_sql("'d' || CAST(k AS VARCHAR)")}
              ELSE {slugify_sql(prefix_bytes_sql('slug_text'))} END AS slug,
         k % 10 <> 0 AS seo_enabled,
         CASE WHEN k % 7 = 0 THEN created_at + to_hours(CAST(k % 72 AS BIGINT)) END AS tombstone_at,
         CAST(CASE WHEN toxic = 1 THEN 0.2 WHEN quality = 0 THEN 0.3 WHEN quality = 1 THEN 0.8 END AS DOUBLE) AS score,
         k, text, lang, source, quality, toxic
  FROM d1_texts
),
corpus AS (
  SELECT id, created_at, effective_date, source_type, source_url, scraper_uuid, tags, slug, seo_enabled, tombstone_at
  FROM d1_url
  UNION ALL
  SELECT id, created_at, effective_date, source_type, source_url, scraper_uuid, tags, slug, seo_enabled, tombstone_at
  FROM d1_text
)"""


def with_corpus(body: str) -> str:
    return f"WITH {CORPUS_CTE}\n{body}"


def _timeline_sql(docs_cte: str, start, end, width_s: int, n: int, k: int, visible_pred: str) -> str:
    start_sql = sql_ts(start)
    end_sql = sql_ts(end)
    width_us = width_s * 1_000_000
    return f"""
tl_docs AS ({docs_cte}),
tl_b AS (
  SELECT id, (epoch_us(effective_date) - epoch_us({start_sql})) // {width_us} AS bucket, tags
  FROM tl_docs
  WHERE effective_date >= {start_sql} AND effective_date <= {end_sql} AND {visible_pred}
),
tl_c AS (
  SELECT bucket, tag, count(DISTINCT id) AS doc_count
  FROM (SELECT bucket, id, unnest(tags) AS tag FROM tl_b) WHERE tag IS NOT NULL
  GROUP BY bucket, tag
),
tl_r AS (
  SELECT bucket, tag, doc_count,
         row_number() OVER (PARTITION BY bucket ORDER BY doc_count DESC, tag ASC) AS rank,
         max(doc_count) OVER (PARTITION BY bucket) AS mx
  FROM tl_c
),
tl_top AS (
  SELECT *, CASE WHEN mx > 0 THEN doc_count / mx ELSE 0 END AS pop FROM tl_r WHERE rank <= {k}
),
tl_spine AS (SELECT range AS bucket FROM range(0, {n}))
"""


def _timeline_select(start, width_s: int) -> str:
    return f"""
SELECT s.bucket,
       {fmt_sql(f"({sql_ts(start)} + to_microseconds(s.bucket * {width_s * 1_000_000}))")} AS bucket_start,
       CAST({width_s} AS BIGINT) AS duration_seconds,
       t.tag, t.doc_count, CAST(t.rank AS INTEGER) AS rank,
       round(t.pop, 6) AS popularity_score,
       round(0.5 + 1.5 * t.pop, 6) AS size_factor
FROM tl_spine s LEFT JOIN tl_top t ON t.bucket = s.bucket
"""


def _timeline_stats_select(n: int, start, end, visible_pred: str) -> str:
    return f"""
SELECT (SELECT count(*) FROM tl_docs WHERE effective_date >= {sql_ts(start)} AND effective_date <= {sql_ts(end)} AND {visible_pred}) AS total_documents,
       (SELECT count(DISTINCT tag) FROM tl_top) AS total_unique_tags,
       CAST({n} AS BIGINT) AS bucket_count
"""


EVENTS_DOCS = (
    "SELECT CAST(event_id AS VARCHAR) AS id, ts AS effective_date, "
    "[event_type, 'u' || CAST(user_id % 20 AS VARCHAR)] AS tags, true AS seo_enabled, "
    "CAST(NULL AS TIMESTAMP) AS tombstone_at FROM events"
)

# 1-day buckets over January 2024 (30 buckets)
_TL = dict(start=TIMELINE_START, end=TIMELINE_END, width_s=86400, n=30, k=20)
# automatic width over the corpus range: 47 days -> 1-day buckets (47 buckets)
_CTL = dict(start=CORPUS_START, end=CORPUS_END, width_s=86400, n=47, k=5)
_VIS = f"seo_enabled AND {live_sql()}"

ORACLES: dict[str, str] = {}
#: number in a corpus document's id
_KEY = "CAST(substr(id, 2) AS BIGINT)"

ORACLES["tag_timeline"] = (
    "WITH " + _timeline_sql(EVENTS_DOCS, _TL["start"], _TL["end"], _TL["width_s"], _TL["n"], _TL["k"], _VIS)
    + _timeline_select(_TL["start"], _TL["width_s"])
)
ORACLES["tag_timeline_stats"] = (
    "WITH " + _timeline_sql(EVENTS_DOCS, _TL["start"], _TL["end"], _TL["width_s"], _TL["n"], _TL["k"], _VIS)
    + _timeline_stats_select(_TL["n"], _TL["start"], _TL["end"], _VIS)
)
ORACLES["corpus_tag_timeline"] = with_corpus(
    "," + _timeline_sql("SELECT * FROM corpus", _CTL["start"], _CTL["end"], _CTL["width_s"], _CTL["n"], _CTL["k"], _VIS)
    + _timeline_select(_CTL["start"], _CTL["width_s"])
)
ORACLES["corpus_tag_timeline_stats"] = with_corpus(
    "," + _timeline_sql("SELECT * FROM corpus", _CTL["start"], _CTL["end"], _CTL["width_s"], _CTL["n"], _CTL["k"], _VIS)
    + _timeline_stats_select(_CTL["n"], _CTL["start"], _CTL["end"], _VIS)
)


# =====================================================================
# Building blocks for the remaining oracles
# =====================================================================

FMT = "'%Y-%m-%d %H:%M:%S'"
RFC = "'%Y-%m-%dT%H:%M:%SZ'"
NL2 = "'\n\n'"
BASE = "https://corpus.example.com"
IMG_BASE = "https://scraper.example.com"
DAY = "INTERVAL 1 DAY"


def q(sql_text: str) -> str:
    return sql_text.strip()


def ts_plus_days(days: int) -> str:
    return f"({AS_OF_SQL} + INTERVAL {days} DAY)"


def sha_id(*parts: str) -> str:
    return "substr(sha256(" + " || chr(1) || ".join(parts) + "), 1, 32)"


def blocks(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


JOBS = """
jobs0 AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id,
         'http://h' || CAST(o_orderkey % 97 AS VARCHAR) || '.example.com/' || CAST(o_orderkey AS VARCHAR) AS url,
         o_orderkey % 2 = 0 AS extract_links,
         CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing'
              WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey >= 10 THEN CAST(o_orderkey // 10 AS VARCHAR) END AS parent_job_id,
         CAST(length(CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) AS depth
  FROM orders
),
jobs AS (
  SELECT *, CASE WHEN status = 'completed' THEN 'd' || CAST(k % 1000 AS VARCHAR) END AS result_request_id,
         CASE WHEN status = 'failed' THEN 'fixture failure' END AS error_message,
         CASE WHEN status IN ('completed', 'failed') THEN created_at END AS completed_at
  FROM jobs0
)"""

IMAGES = """
images AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, p_name AS alt_text, p_type AS summary,
         string_split(p_name, ' ') AS tags, 's' || CAST(p_partkey % 250 AS VARCHAR) AS scraper_uuid,
         CASE WHEN p_partkey % 9 <> 0 THEN 'img-' || CAST(p_partkey AS VARCHAR) END AS slug,
         CAST(p_size AS DOUBLE) / 50.0 AS relevance_score, p_brand
  FROM part
)"""

LINKS = """
links0 AS (
  SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages
),
links AS (
  SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS href,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) AS origin
  FROM links0
),
links1 AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href, origin || href AS link FROM links)"""

RESULTS = """
d7 AS (
  SELECT k, 'a' || CAST(k AS VARCHAR) AS job_id, 'd' || CAST(k AS VARCHAR) AS id,
         CASE WHEN k % 4 <> 0 THEN 'completed' ELSE 'processing' END AS status,
         created_at + to_minutes(CAST(k % 120 AS BIGINT)) AS arrived_at,
         [upper(lang), 'topic-' || CAST(k % 13 AS VARCHAR)] AS ai_tags, score
  FROM d1_text
)"""

_URL_RE = "^([A-Za-z][A-Za-z0-9+.\\-]*):(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#.*)?$"
_VALID_PATH = "^[A-Za-z0-9\\-_.~!$&'()*+,;=:@\\[\\]%/]*$"
_BAD_ESCAPE = "%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)"


def _sq(s: str) -> str:
    return s.replace("'", "''")


def url_parts_cte(name: str, src: str, cols: str, url: str) -> str:
    """CTE ``name`` with the URL split into parts and the derived rules."""
    tracking = ", ".join(f"'{t}'" for t in TRACKING_PARAMS)
    exts = "|".join(IMAGE_EXTENSIONS)
    path_keep = [("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%2F", "/"), ("%3A", ":"),
                 ("%3B", ";"), ("%3D", "="), ("%40", "@")]
    esc = "url_encode(dpath)"
    for a, b in path_keep:
        esc = f"replace({esc}, '{a}', '{b}')"
    return f"""
{name}_a AS (
  SELECT {cols}, {url} AS u,
         regexp_extract({url}, '{_sq(_URL_RE)}', ['scheme', 'slashes', 'auth', 'path', 'qm', 'query', 'frag']) AS p,
         regexp_full_match({url}, '{_sq(_URL_RE)}') AS has_scheme
  FROM {src}
),
{name}_b AS (
  SELECT *, regexp_extract(p.auth, '^(?:.*@)?(.*)$', 1) AS hostport, regexp_extract(p.auth, '^(.*@)?', 1) AS userinfo,
         (length(p.path) > 1 AND ends_with(p.path, '/')) AS trim_slash
  FROM {name}_a
),
{name}_c AS (
  SELECT *,
         (NOT regexp_matches(u, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(p.path, '{_BAD_ESCAPE}')
          AND NOT regexp_matches(hostport, '{_BAD_ESCAPE}') AND NOT regexp_matches(hostport, '[ {{}}|\\\\^`"<>]')) AS parses,
         CASE WHEN trim_slash THEN regexp_replace(url_decode(p.path), '/$', '') ELSE url_decode(p.path) END AS dpath,
         list_filter(string_split(p.query, '&'), lambda x: x <> '' AND NOT contains(x, ';')) AS pieces
  FROM {name}_b
),
{name}_d AS (
  SELECT *,
         CASE WHEN NOT trim_slash AND regexp_full_match(p.path, '{_sq(_VALID_PATH)}') THEN p.path ELSE {esc} END AS npath,
         array_to_string(list_transform(list_sort(list_filter(list_transform(pieces, lambda x: {{
              'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')),
              'v': url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' '))}}),
              lambda e: NOT list_contains([{tracking}], lower(e.k)))),
           lambda e: replace(url_encode(e.k), '%20', '+') || '=' || replace(url_encode(e.v), '%20', '+')), '&') AS nquery
  FROM {name}_c
),
{name} AS (
  SELECT *,
    CASE WHEN has_scheme AND p.slashes <> '' AND hostport <> '' AND parses
         THEN lower(p.scheme) || '://' || userinfo || lower(hostport) || npath
              || CASE WHEN nquery <> '' OR (p.qm <> '' AND p.query = '') THEN '?' || nquery ELSE '' END END AS normalized_url,
    coalesce(parses AND regexp_matches(lower(CASE WHEN p.slashes <> '' OR starts_with(p.path, '/') THEN p.path ELSE '' END), '\\.({exts})$'), false) AS is_image,
    CASE WHEN parses THEN
      CASE WHEN starts_with(regexp_extract(hostport, '^(.*?)(:[0-9]*)?$', 1), 'www.')
           THEN substr(regexp_extract(hostport, '^(.*?)(:[0-9]*)?$', 1), 5)
           ELSE regexp_extract(hostport, '^(.*?)(:[0-9]*)?$', 1) END
    ELSE '' END AS domain
  FROM {name}_d
)"""


def url_rule_cols(prefix: str = "") -> str:
    return (
        f"{prefix}is_image, coalesce(has_scheme AND lower(p.scheme) IN ('http', 'https') AND parses AND NOT is_image, false) AS is_scrapable, "
        f"{prefix}normalized_url, CASE WHEN normalized_url IS NOT NULL THEN 'urlcache:' || sha256(normalized_url) END AS url_key"
    )


def merge_tags_sql(existing: str, ai: list[str]) -> str:
    acc = existing
    for a in ai:
        acc = (f"(CASE WHEN {a} IS NULL OR list_contains(list_transform({acc}, lambda x: lower(x)), lower({a})) "
               f"THEN {acc} ELSE list_append({acc}, {a}) END)")
    return acc


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def paragraph_sql(content: str) -> str:
    parts = f"list_filter(list_transform(string_split({content}, {NL2}), lambda p: {trim_ws('p')}), lambda p: p <> '')"
    return (f"(CASE WHEN coalesce({content}, '') = '' THEN '' ELSE array_to_string(list_transform({parts}, "
            f"lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>' || chr(10)), '') END)")


def insert_image_sql(html: str, slug: str) -> str:
    head, tail = FIGURE_HTML.split("{base}")
    mid_text, end_text = tail.split("{slug}")
    figure = f"'{_sq(head)}' || '{IMG_BASE}' || '{_sq(mid_text)}' || {slug} || '{_sq(end_text)}'"
    parts = f"string_split({html}, '</p>')"
    joined = (f"array_to_string(list_transform({parts}, lambda p, i: (CASE WHEN p <> '' THEN p || '</p>' ELSE '' END) || "
              f"(CASE WHEN i - 1 = len({parts}) // 2 THEN {figure} ELSE '' END)), '')")
    nonblank = f"len(list_filter({parts}, lambda p: {trim_ws('p')} <> ''))"
    return (f"(CASE WHEN {html} = '' OR {slug} IS NULL OR {slug} = '' OR {nonblank} < 3 THEN {html} ELSE {joined} END)")


def page_content_sql(html: str) -> str:
    s = f"regexp_replace({html}, '(?s)<script[^>]*>.*?</script>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<style[^>]*>.*?</style>', '', 'g')"
    return f"regexp_replace({s}, '<[^>]*>', {NL2}, 'g')"


def tags_sql(c: str = "tags") -> str:
    return f"array_to_string({c}, '|')"


VIS = f"seo_enabled AND {live_sql()}"


def doc_out(src: str) -> str:
    return f"SELECT id, strftime(effective_date, {FMT}) AS effective_date, source_type, {tags_sql()} AS tags FROM ({src})"


# =====================================================================
# Oracles
# =====================================================================
ORACLES["timeline_extent"] = with_corpus(f"SELECT strftime(min(effective_date), {FMT}) AS earliest FROM corpus")

ORACLES["document_stats"] = with_corpus(f"""
SELECT 'documents_with_tags' AS metric, '' AS key, count(*) FILTER (WHERE len(tags) > 0) AS value FROM corpus
UNION ALL SELECT 'live_seo_enabled', '', count(*) FILTER (WHERE {VIS}) FROM corpus
UNION ALL SELECT 'tombstones_due', '', count(*) FILTER (WHERE tombstone_at IS NOT NULL AND tombstone_at <= {AS_OF_SQL}) FROM corpus
UNION ALL SELECT 'live_by_source_type', source_type, count(*) FROM corpus WHERE {live_sql()} GROUP BY source_type
UNION ALL SELECT 'unique_tags', '', count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM corpus)
""")

ORACLES["jobs_by_status"] = blocks(JOBS) + """
SELECT s.status, coalesce(c.n, 0) AS job_count
FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('queued')) s(status)
LEFT JOIN (SELECT status, count(*) AS n FROM jobs GROUP BY status) c ON c.status = s.status
"""

ORACLES["explode_tags"] = with_corpus("SELECT id AS request_id, unnest(tags) AS tag FROM corpus")

ORACLES["filter_documents"] = with_corpus(doc_out(f"""
  SELECT * FROM corpus
  WHERE {VIS} AND effective_date >= TIMESTAMP '2024-01-05 00:00:00' AND effective_date <= TIMESTAMP '2024-01-25 00:00:00'
    AND list_has_any(tags, ['news', 'en', 'social_media'])
  ORDER BY effective_date DESC, id ASC LIMIT 100 OFFSET 10"""))

ORACLES["filter_documents_fuzzy"] = with_corpus(doc_out(f"""
  SELECT * FROM corpus
  WHERE {VIS} AND source_type = 'url'
    AND len(list_filter(tags, lambda t: t LIKE '%learn%' OR t LIKE '%%ia_%')) > 0"""))

ORACLES["list_documents"] = with_corpus(doc_out(f"""
  SELECT * FROM corpus WHERE {VIS} ORDER BY effective_date DESC, id ASC LIMIT 50"""))

ORACLES["search_by_tags"] = with_corpus("SELECT id FROM corpus WHERE list_has_any(tags, ['fr', 'social_media'])")

ORACLES["search_by_tags_fuzzy"] = with_corpus(
    "SELECT id FROM corpus WHERE len(list_filter(tags, lambda t: t LIKE '%edu%' OR t LIKE '%mach%')) > 0"
)

ORACLES["documents_with_any_tag"] = with_corpus("SELECT id, source_type FROM corpus WHERE list_has_any(tags, ['de', 'es'])")

ORACLES["tag_index_search"] = with_corpus("""
, t AS (
  SELECT id, CASE WHEN source_type = 'text' THEN CAST(substr(id, 2) AS BIGINT) ELSE 1 END AS k, tags FROM corpus
), c AS (
  SELECT id, CASE WHEN k % 11 = 0 THEN list_append(tags, 'education') WHEN k % 13 = 0 THEN ['moved']
                  WHEN k % 17 = 0 THEN NULL ELSE tags END AS tags
  FROM t
)
SELECT 'exact' AS mode, id FROM c WHERE list_has_any(tags, ['fr', 'social_media', 'moved'])
UNION ALL
SELECT 'fuzzy' AS mode, id FROM c WHERE len(list_filter(tags, lambda t: t LIKE '%edu%' OR t LIKE '%mach%')) > 0
""")

ORACLES["tag_index_counts"] = with_corpus("""
SELECT tag, count(DISTINCT id) AS n_docs FROM (SELECT id, unnest(tags) AS tag FROM corpus) WHERE tag IS NOT NULL GROUP BY tag
""")

ORACLES["get_documents"] = blocks(CORPUS_CTE, JOBS) + """
SELECT r.requested_id, c.id IS NOT NULL AS found, c.source_type
FROM (SELECT DISTINCT result_request_id AS requested_id FROM jobs WHERE status = 'completed') r
LEFT JOIN corpus c ON c.id = r.requested_id
"""

ORACLES["get_by_slug"] = with_corpus("""
SELECT s.requested_slug, c.id IS NOT NULL AS found, c.id
FROM (SELECT DISTINCT 'page-' || CAST(p_partkey % 300 AS VARCHAR) AS requested_slug FROM part) s
LEFT JOIN (SELECT * FROM corpus WHERE slug IS NOT NULL AND seo_enabled) c ON c.slug = s.requested_slug
""")

# the same lookups, on the table laid out for them
ORACLES["lookup_documents"] = ORACLES["get_documents"]
ORACLES["lookup_slugs"] = ORACLES["get_by_slug"]

ORACLES["slug_conflicts"] = with_corpus(f"""
, s AS (SELECT id, slug, created_at FROM corpus WHERE slug IS NOT NULL),
kk AS (SELECT slug, first(id ORDER BY created_at, id) AS kept_id FROM s GROUP BY slug)
SELECT s.id, s.slug, strftime(s.created_at, {FMT}) AS created_at, kk.kept_id
FROM s JOIN kk ON kk.slug = s.slug WHERE s.id <> kk.kept_id
""")

ORACLES["url_rules"] = blocks(url_parts_cte("pu", "pages", "page_id, url", "url")) + f"""
SELECT page_id, url, {url_rule_cols()}, domain FROM pu
"""

ORACLES["link_rules"] = blocks(LINKS, url_parts_cte("lu", "links1", "page_id, pos, link", "link")) + f"""
SELECT page_id, pos, link AS url, {url_rule_cols()} FROM lu
"""

ORACLES["page_links"] = blocks(LINKS) + "SELECT page_id, pos, href, link FROM links1"

ORACLES["row_functions"] = f"""
WITH t AS (
  SELECT d.doc_id AS k, d.lang, d.source, l.quality, {fixture_time_sql('d.doc_id')} AS created_at,
         [d.lang, d.source] || (CASE WHEN l.quality = 0 THEN ['low-quality'] ELSE []::VARCHAR[] END) AS tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
a AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'https://authors.example.com/' || CAST(k AS VARCHAR)
                        WHEN 1 THEN '  www.author' || CAST(k AS VARCHAR)
                        WHEN 2 THEN 'Writer ' || lang ELSE source END AS author
  FROM t
)
SELECT k AS doc_id,
       {normalize_tag_sql("(source || '-' || lang || '-x')")} AS normalized_tag,
       array_to_string({merge_tags_sql('tags', ["upper(lang)", "'Topic-' || CAST(k % 7 AS VARCHAR)", "'topic-' || CAST(k % 7 AS VARCHAR)"])}, '|') AS merged_tags,
       list_filter(tags, lambda x: x IN ('low-quality', 'en'))[1] AS trigger_tag,
       CASE WHEN author IS NULL THEN ''
            WHEN starts_with(trim(author), 'http://') OR starts_with(trim(author), 'https://')
              OR starts_with(trim(author), 'www.') OR contains(trim(author), '://') THEN '' ELSE author END AS author,
       strftime(CASE k % 6 WHEN 0 THEN created_at - INTERVAL 1 DAY
                           WHEN 1 THEN date_trunc('day', created_at - INTERVAL 3 DAY)
                           WHEN 2 THEN created_at - INTERVAL 2 DAY
                           WHEN 3 THEN date_trunc('day', created_at - INTERVAL 3 DAY)
                           ELSE created_at END, {FMT}) AS effective_date
FROM a
"""

ORACLES["text_slugs"] = f"SELECT doc_id, {slugify_sql(prefix_bytes_sql('text'))} AS slug FROM documents"

_GATE = ("CASE WHEN list_contains(categories, 'image') THEN 'image' "
         "WHEN score < 0.5 THEN 'rejected' ELSE 'accepted' END")

ORACLES["score_gate"] = with_corpus(f"""
SELECT source_url AS url, score, {_GATE} AS decision, score >= 0.5 AS meets_threshold, CAST(0.5 AS DOUBLE) AS threshold FROM d1_url
""")

ORACLES["low_score_documents"] = with_corpus(f"""
SELECT {sha_id("'low-score'", 'source_url')} AS id, source_url, {tags_sql()} AS tags, false AS seo_enabled,
       strftime({ts_plus_days(30)}, {FMT}) AS tombstone_at, score AS link_score, CAST(0.5 AS DOUBLE) AS threshold
FROM d1_url WHERE {_GATE} = 'rejected'
""")

ORACLES["scraped_documents"] = with_corpus(f"""
, s AS (
  SELECT *, {sha_id('source_url', "'s' || CAST(k AS VARCHAR)").replace("sha256(", "sha256('scrape' || chr(1) || ", 1)} AS new_id,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         {_GATE} AS decision
  FROM d1_url
)
SELECT new_id AS id,
       CASE WHEN {slugify_sql("CASE WHEN title <> '' THEN title ELSE source_url END")} = '' THEN {slugify_sql('new_id')}
            ELSE {slugify_sql("CASE WHEN title <> '' THEN title ELSE source_url END")} END AS slug,
       {tags_sql()} AS tags,
       CASE WHEN decision = 'image' THEN '' ELSE 'a' || substr(sha256(source_url), 1, 16) END AS textanalyzer_uuid,
       strftime(CASE WHEN k % 3 = 0 THEN created_at - INTERVAL 10 DAY ELSE {AS_OF_SQL} END, {FMT}) AS effective_date
FROM s WHERE decision <> 'rejected'
""")

ORACLES["text_documents"] = f"""
WITH t AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS text_id, turn, text,
         CASE WHEN turn % 2 = 0 THEN regexp_extract(text, '^[^\\n]*', 0) END AS cleaned
  FROM conversations
),
u AS (
  SELECT *, {sha_id("'text'", 'text_id')} AS id,
         CASE WHEN cleaned IS NOT NULL AND cleaned <> '' THEN {prefix_bytes_sql('cleaned')}
              ELSE {prefix_bytes_sql("coalesce(text, '')")} END AS src
  FROM t
)
SELECT id,
       CASE WHEN src <> '' THEN (CASE WHEN {slugify_sql('src')} = '' THEN {slugify_sql('id')} ELSE {slugify_sql('src')} END) END AS slug,
       'Conversation-Turn|user' AS tags
FROM u
"""

ORACLES["expand_frontier"] = blocks(JOBS, LINKS, url_parts_cte("fl", "links1", "page_id, pos, link", "link")) + f"""
, par AS (
  SELECT j.id, j.depth, j.k FROM jobs j JOIN pages p ON p.page_id = j.k
  WHERE j.extract_links AND j.depth < 2
)
SELECT {sha_id("'job'", 'par.id', 'CAST(fl.pos AS VARCHAR)', 'fl.link')} AS id, fl.link AS url,
       par.depth + 1 < 2 AS extract_links, CAST(par.depth + 1 AS INTEGER) AS depth, par.id AS parent_job_id, 'queued' AS status
FROM par JOIN fl ON fl.page_id = par.k
WHERE coalesce(fl.has_scheme AND lower(fl.p.scheme) IN ('http', 'https') AND fl.parses AND NOT fl.is_image, false)
"""

_NEW_URLS = """
nu0 AS (
  SELECT regexp_replace(url, '#.*$', '') AS base FROM pages
),
nu AS (
  SELECT base || CASE WHEN contains(base, '?') THEN '&utm_medium=mail' ELSE '?utm_medium=mail' END AS url FROM nu0
),
seen AS (
  SELECT url, 's' || CAST(page_id AS VARCHAR) AS scraper_uuid, {seen_at} AS seen_at FROM pages
)""".replace("{seen_at}", fixture_time_sql("page_id"))

_SEEN_SPLIT = blocks(
    _NEW_URLS,
    url_parts_cte("nuk", "nu", "url AS src_url", "url"),
    url_parts_cte("snk", f"(SELECT * FROM seen WHERE seen_at > {AS_OF_SQL} - INTERVAL 30 DAY AND seen_at <= {AS_OF_SQL})",
                  "scraper_uuid, seen_at", "url"),
) + """
, recent AS (
  SELECT 'urlcache:' || sha256(normalized_url) AS k, max({'seen_at': seen_at, 'scraper_uuid': scraper_uuid}).scraper_uuid AS cached_scraper_uuid
  FROM snk WHERE normalized_url IS NOT NULL GROUP BY 1
),
split AS (
  SELECT n.src_url AS url, CASE WHEN n.normalized_url IS NOT NULL THEN 'urlcache:' || sha256(n.normalized_url) END AS url_key,
         r.cached_scraper_uuid, coalesce(n.has_scheme AND lower(n.p.scheme) IN ('http', 'https') AND n.parses AND NOT n.is_image, false) AS scrapable
  FROM nuk n LEFT JOIN recent r ON r.k = CASE WHEN n.normalized_url IS NOT NULL THEN 'urlcache:' || sha256(n.normalized_url) END
)
"""

ORACLES["seen_url_split"] = _SEEN_SPLIT + (
    "SELECT url, url_key, cached_scraper_uuid IS NOT NULL AS cached, cached_scraper_uuid FROM split"
)

ORACLES["request_outcomes"] = _SEEN_SPLIT + """
, o AS (SELECT CASE WHEN cached_scraper_uuid IS NOT NULL THEN 'cached' WHEN scrapable THEN 'accepted' ELSE 'error' END AS outcome FROM split)
SELECT outcome, count(*) AS requests FROM (
  SELECT outcome FROM o UNION ALL SELECT 'accepted' FROM o WHERE outcome IN ('cached', 'error')
) GROUP BY outcome
"""

# --- merges -------------------------------------------------------------
_TIER = f"""
  CASE WHEN s > 0 AND s < 0.25 THEN 'severe' WHEN s >= 0.25 AND s < 0.35 THEN 'standard' END AS tier"""


def _applied_cols(applied: str) -> str:
    """Columns of a text document after its analysis is applied (when
    ``applied``) else unchanged; expects d1_text joined to d7 as r."""
    merged = merge_tags_sql("t.tags", ["r.ai_tags[1]", "r.ai_tags[2]"])
    return f"""
    CASE WHEN {applied} THEN {merged} ELSE t.tags END AS tags,
    CASE WHEN {applied} AND tier = 'severe' THEN false WHEN {applied} AND tier = 'standard' THEN true ELSE t.seo_enabled END AS seo_enabled,
    CASE WHEN {applied} AND tier = 'severe' THEN {ts_plus_days(7)} WHEN {applied} AND tier = 'standard' THEN {ts_plus_days(30)} ELSE t.tombstone_at END AS tombstone_at,
    CASE WHEN {applied} AND tier IS NOT NULL THEN 'Low quality score: ' || printf('%.2f', s) END AS tombstone_reason"""


ORACLES["apply_analysis"] = blocks(CORPUS_CTE, RESULTS) + f"""
, j AS (
  SELECT t.*, r.status AS rstatus, r.ai_tags, coalesce(r.score, 0.0) AS s, r.score AS rscore, {_TIER.strip()}
  FROM d1_text t LEFT JOIN d7 r ON r.k = t.k
),
a AS (
  SELECT t.id, {_applied_cols("t.rstatus = 'completed'").replace("r.ai_tags", "t.ai_tags")},
         CASE WHEN t.rstatus = 'completed' THEN 'completed' ELSE 'queued' END AS textanalyzer_status,
         CASE WHEN t.rstatus = 'completed' THEN t.rscore END AS quality_score
  FROM j t
)
SELECT id, {tags_sql()} AS tags, seo_enabled, strftime(tombstone_at, {FMT}) AS tombstone_at, tombstone_reason,
       textanalyzer_status, quality_score FROM a
UNION ALL
SELECT id, {tags_sql()}, seo_enabled, strftime(tombstone_at, {FMT}), NULL, NULL, NULL FROM d1_url
"""

ORACLES["enrich"] = blocks(CORPUS_CTE, RESULTS) + f"""
, j AS (
  SELECT t.*, r.ai_tags, coalesce(r.score, 0.0) AS s, {_TIER.strip()},
         CASE WHEN r.status = 'completed' AND r.arrived_at <= {AS_OF_SQL} THEN r.arrived_at END AS arrival
  FROM d1_text t LEFT JOIN d7 r ON r.k = t.k
),
o AS (
  SELECT *,
    CASE WHEN arrival IS NOT NULL AND epoch_us(arrival) - epoch_us(created_at) <= 3600000000 THEN 'applied'
         WHEN epoch_us(coalesce(arrival, {AS_OF_SQL})) - epoch_us(created_at) > 3600000000 THEN 'timeout'
         ELSE 'waiting' END AS enrich_outcome,
    CAST(floor((epoch_us(coalesce(arrival, {AS_OF_SQL})) - epoch_us(created_at)) / 60000000) AS BIGINT) AS el
  FROM j
),
a AS (
  SELECT t.id, t.enrich_outcome, {_applied_cols("t.enrich_outcome = 'applied'").replace("r.ai_tags", "t.ai_tags")},
         CASE t.enrich_outcome WHEN 'applied' THEN 'completed' WHEN 'timeout' THEN 'failed' ELSE 'queued' END AS textanalyzer_status,
         CASE WHEN t.enrich_outcome = 'timeout' THEN t.el END AS elapsed_minutes
  FROM o t
)
SELECT id, {tags_sql()} AS tags, seo_enabled, strftime(tombstone_at, {FMT}) AS tombstone_at, tombstone_reason,
       textanalyzer_status, enrich_outcome, elapsed_minutes FROM a
UNION ALL
SELECT id, {tags_sql()}, seo_enabled, strftime(tombstone_at, {FMT}), NULL, NULL, NULL, NULL FROM d1_url
"""

ORACLES["analysis_timeout"] = with_corpus(f"""
SELECT id,
       CASE WHEN source_type = 'text' AND epoch_us({AS_OF_SQL}) - epoch_us(created_at) > 3600000000 THEN 'failed'
            WHEN source_type = 'text' THEN 'queued' END AS textanalyzer_status,
       CASE WHEN source_type = 'text' AND epoch_us({AS_OF_SQL}) - epoch_us(created_at) > 3600000000
            THEN CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 60000000) AS BIGINT) END AS elapsed_minutes
FROM corpus
""")

ORACLES["replace_tags"] = with_corpus(f"""
, c AS (
  SELECT *, CASE WHEN source_type = 'text' AND CAST(substr(id, 2) AS BIGINT) % 11 = 0 THEN list_append(tags, 'spam') END AS new_tags
  FROM corpus
),
f AS (
  SELECT *, list_filter(new_tags, lambda x: x IN ('spam', 'low-quality'))[1] AS trig FROM c
)
SELECT id, {tags_sql('coalesce(new_tags, tags)')} AS tags, seo_enabled,
       strftime(CASE WHEN trig IS NOT NULL THEN {ts_plus_days(90)} ELSE tombstone_at END, {FMT}) AS tombstone_at,
       CASE WHEN trig IS NOT NULL THEN 'auto-tombstone: ' || trig || ' tag' END AS tombstone_reason
FROM f
""")

ORACLES["set_seo"] = with_corpus("""
SELECT id, CASE WHEN source_type = 'url' AND CAST(substr(id, 2) AS BIGINT) % 4 = 0 THEN NOT seo_enabled ELSE seo_enabled END AS seo_enabled
FROM corpus
""")

ORACLES["set_metadata"] = with_corpus(f"""
SELECT id,
       CASE WHEN source_type = 'text' AND CAST(substr(id, 2) AS BIGINT) % 13 = 0 THEN '2024-01-25 00:00:00'
            ELSE strftime(tombstone_at, {FMT}) END AS tombstone_at,
       CASE WHEN source_type = 'text' AND CAST(substr(id, 2) AS BIGINT) % 13 = 0 THEN 'replaced ' || id END AS note
FROM corpus
""")

ORACLES["tombstone_manual"] = with_corpus(f"""
, c AS (
  SELECT id, CASE WHEN source_type = 'url' AND CAST(substr(id, 2) AS BIGINT) % 12 = 0 THEN NULL
                  WHEN source_type = 'url' AND CAST(substr(id, 2) AS BIGINT) % 6 = 0 THEN {ts_plus_days(90)}
                  ELSE tombstone_at END AS t
  FROM corpus
)
SELECT id, strftime(t, {FMT}) AS tombstone_at, strftime(t, {RFC}) AS tombstone_datetime FROM c
""")

ORACLES["merge_on_read"] = with_corpus(f"""
, c AS (
  SELECT *, CAST(substr(id, 2) AS BIGINT) AS n, source_type = 'text' AS is_text FROM corpus
), m AS (
  SELECT id, is_text, n, CASE WHEN is_text AND n % 11 = 0 THEN list_append(tags, 'spam') ELSE tags END AS tags,
         list_filter(CASE WHEN is_text AND n % 11 = 0 THEN list_append(tags, 'spam') END, lambda x: x IN ('spam', 'low-quality'))[1] AS trig,
         is_text AND n % 13 = 0 AS renewed,
         CASE WHEN NOT is_text AND n % 4 = 0 THEN NOT seo_enabled ELSE seo_enabled END AS seo_enabled, tombstone_at
  FROM c WHERE NOT (is_text AND n % 9 = 0)
), f AS (
  SELECT *, CASE WHEN renewed THEN TIMESTAMP '2024-01-25 00:00:00'
                 WHEN NOT is_text AND n % 12 = 0 THEN NULL
                 WHEN trig IS NOT NULL OR (NOT is_text AND n % 6 = 0) THEN {ts_plus_days(90)}
                 ELSE tombstone_at END AS t
  FROM m
)
SELECT id, {tags_sql('tags')} AS tags, seo_enabled, strftime(t, {FMT}) AS tombstone_at, t IS NOT NULL AS has_datetime,
       CASE WHEN trig IS NOT NULL AND NOT renewed THEN 'auto-tombstone: ' || trig || ' tag' END AS tombstone_reason,
       CASE WHEN renewed THEN 'replaced ' || id END AS note
FROM f
""")

ORACLES["delete_documents"] = blocks(CORPUS_CTE, JOBS) + """
, gone AS (SELECT id FROM corpus WHERE source_type = 'text' AND CAST(substr(id, 2) AS BIGINT) % 9 = 0)
SELECT j.id, CASE WHEN g.id IS NOT NULL THEN NULL ELSE j.result_request_id END AS result_request_id
FROM jobs j LEFT JOIN gone g ON g.id = j.result_request_id
"""

ORACLES["tombstone_report"] = with_corpus(f"""
, logs AS (
  SELECT 'low-score' AS reason, 'none' AS tag, 30 AS period_days FROM d1_url WHERE {_GATE} = 'rejected'
  UNION ALL
  SELECT 'tag-based', list_filter(list_append(tags, 'spam'), lambda x: x IN ('spam', 'low-quality'))[1], 90
  FROM corpus WHERE source_type = 'text' AND CAST(substr(id, 2) AS BIGINT) % 11 = 0
  UNION ALL
  SELECT 'manual', 'none', 90 FROM corpus WHERE source_type = 'url' AND CAST(substr(id, 2) AS BIGINT) % 6 = 0
)
SELECT reason, tag, count(*) AS tombstones, min(period_days) AS min_days, round(avg(period_days), 6) AS avg_days,
       max(period_days) AS max_days, round(quantile_cont(period_days, 0.5), 6) AS p50_days,
       round(quantile_cont(period_days, 0.9), 6) AS p90_days, round(quantile_cont(period_days, 0.99), 6) AS p99_days
FROM logs GROUP BY reason, tag
""")

# --- jobs -------------------------------------------------------------------
ORACLES["jobs_with_children"] = blocks(JOBS) + f"""
, par AS (
  SELECT id, created_at FROM jobs WHERE parent_job_id IS NULL ORDER BY created_at DESC, id ASC LIMIT 50
)
SELECT par.id AS parent_id, strftime(par.created_at, {FMT}) AS parent_created_at, c.id AS child_id,
       strftime(c.created_at, {FMT}) AS child_created_at, c.status AS child_status
FROM par LEFT JOIN jobs c ON c.parent_job_id = par.id
"""

ORACLES["child_jobs"] = blocks(JOBS) + f"""
SELECT c.id, c.parent_job_id, strftime(c.created_at, {FMT}) AS created_at
FROM jobs c WHERE c.parent_job_id IN (SELECT id FROM jobs WHERE depth = 1 AND status = 'failed')
"""

_DESC = """
, RECURSIVE_PLACEHOLDER AS (SELECT 1)
"""

ORACLES["job_descendants"] = "WITH RECURSIVE " + JOBS.strip() + """,
d(id, level) AS (
  SELECT id, 0 FROM jobs WHERE parent_job_id IS NULL AND k % 2 = 1
  UNION ALL
  SELECT j.id, d.level + 1 FROM jobs j JOIN d ON j.parent_job_id = d.id
)
SELECT id, CAST(level AS INTEGER) AS level FROM d
"""

ORACLES["delete_jobs"] = "WITH RECURSIVE " + JOBS.strip() + """,
d(id) AS (
  SELECT id FROM jobs WHERE depth = 1 AND k % 7 = 0
  UNION ALL
  SELECT j.id FROM jobs j JOIN d ON j.parent_job_id = d.id
)
SELECT id FROM jobs WHERE id NOT IN (SELECT id FROM d)
"""

ORACLES["jobs_with_results"] = blocks(CORPUS_CTE, JOBS) + """
SELECT j.id, j.result_request_id, c.id IS NOT NULL AS result_found, c.source_type AS result_source_type
FROM jobs j LEFT JOIN corpus c ON c.id = j.result_request_id
"""

ORACLES["apply_job_events"] = blocks(JOBS) + f"""
, ev AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' WHEN 'click' THEN 'retry' END AS event,
         'd' || CAST(event_id % 1000 AS VARCHAR) AS rr, 'event ' || CAST(event_id AS VARCHAR) AS message
  FROM events
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, event = 'retry' ORDER BY ts DESC, seq DESC) AS rn FROM ev
),
lst AS (SELECT * FROM ranked WHERE rn = 1 AND event <> 'retry'),
rty AS (SELECT * FROM ranked WHERE rn = 1 AND event = 'retry'),
agg AS (
  SELECT job_id, count(*) FILTER (WHERE event = 'failed') AS failures, max(ts) AS last_ts FROM ev GROUP BY job_id
),
st AS (
  SELECT a.job_id, a.failures, a.last_ts, l.event AS l_event, l.ts AS l_ts, l.rr AS l_rr, l.message AS l_msg,
         (r.job_id IS NOT NULL AND (l.job_id IS NULL OR (r.ts, r.seq) > (l.ts, l.seq))) AS retry_after
  FROM agg a LEFT JOIN lst l ON l.job_id = a.job_id LEFT JOIN rty r ON r.job_id = a.job_id
),
res AS (
  SELECT j.id,
    CASE WHEN st.job_id IS NULL THEN j.status
         WHEN st.retry_after AND coalesce(st.l_event, j.status) = 'failed' THEN 'queued'
         ELSE coalesce(st.l_event, j.status) END AS status,
    CAST(coalesce(st.failures, 0) AS INTEGER) AS retries,
    CASE WHEN st.job_id IS NULL THEN j.completed_at
         WHEN st.retry_after AND coalesce(st.l_event, j.status) = 'failed' THEN NULL
         WHEN st.l_event IS NOT NULL THEN CASE WHEN st.l_event IN ('completed', 'failed') THEN st.l_ts END
         ELSE j.completed_at END AS completed_at,
    CASE WHEN st.job_id IS NULL THEN j.error_message
         WHEN st.retry_after AND coalesce(st.l_event, j.status) = 'failed' THEN ''
         WHEN st.l_event IS NOT NULL THEN CASE WHEN st.l_event = 'failed' THEN st.l_msg ELSE '' END
         ELSE j.error_message END AS error_message,
    CASE WHEN st.l_event = 'completed' THEN st.l_rr ELSE j.result_request_id END AS result_request_id,
    CASE WHEN st.job_id IS NULL THEN j.created_at ELSE st.last_ts END AS updated_at
  FROM jobs j LEFT JOIN st ON st.job_id = j.id
)
SELECT id, status, retries, strftime(completed_at, {FMT}) AS completed_at, error_message, result_request_id,
       strftime(updated_at, {FMT}) AS updated_at FROM res
"""

ORACLES["retryable_jobs"] = blocks(JOBS) + "SELECT id, 0 AS retries FROM jobs WHERE status = 'failed'"

ORACLES["get_jobs"] = blocks(JOBS) + """
SELECT c.requested_id, j.id IS NOT NULL AS found, j.status
FROM (SELECT CAST(c_custkey AS VARCHAR) AS requested_id FROM customer) c LEFT JOIN jobs j ON j.id = c.requested_id
"""

_TRACKED = f"""
tracked AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
         {fixture_time_sql('conv_id')} + INTERVAL 1 DAY AS expires_at
  FROM conversations
)"""

ORACLES["unexpired"] = blocks(_TRACKED) + f"""
SELECT id, strftime(expires_at, {FMT}) AS expires_at FROM tracked WHERE NOT ({AS_OF_SQL} > expires_at)
"""

ORACLES["lookup_requests"] = blocks(_TRACKED, JOBS) + """
, ids AS (
  SELECT DISTINCT id FROM (
    SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id FROM conversations
    UNION ALL SELECT CAST(conv_id AS VARCHAR) FROM conversations)
)
SELECT t.id, 'text' AS kind FROM tracked t WHERE t.id IN (SELECT id FROM ids)
UNION ALL
SELECT j.id, 'job' FROM jobs j WHERE j.id IN (SELECT id FROM ids) AND j.id NOT IN (SELECT id FROM tracked)
"""

# --- images / publish ------------------------------------------------------
ORACLES["document_images"] = blocks(CORPUS_CTE, IMAGES) + """
SELECT c.id AS document_id, i.id AS image_id, i.slug FROM corpus c JOIN images i ON i.scraper_uuid = c.scraper_uuid
"""

_BEST = """
best AS (
  SELECT c.id AS document_id,
         first(i.slug ORDER BY -coalesce(i.relevance_score, 0.5), i.id) AS best_image_slug
  FROM corpus c JOIN images i ON i.scraper_uuid = c.scraper_uuid
  WHERE i.slug IS NOT NULL AND i.slug <> '' AND coalesce(i.relevance_score, 0.5) > -1
  GROUP BY c.id
)"""

ORACLES["best_images"] = blocks(CORPUS_CTE, IMAGES, _BEST) + "SELECT document_id, best_image_slug FROM best"

ORACLES["image_sitemap_entries"] = blocks(IMAGES) + f"""
, e AS (
  SELECT slug, '{BASE}/images/' || slug AS iloc, CASE WHEN summary <> '' THEN summary END AS caption,
         CASE WHEN alt_text <> '' THEN alt_text END AS title
  FROM images WHERE slug IS NOT NULL AND slug <> ''
)
SELECT slug, '{BASE}/content/' || slug AS loc, CAST(count(*) AS INTEGER) AS n_images,
       string_agg(iloc, '|' ORDER BY iloc, caption, title) AS image_locs,
       string_agg(coalesce(title, ''), '|' ORDER BY iloc, caption, title) AS titles
FROM e GROUP BY slug
"""

ORACLES["search_images"] = blocks(IMAGES) + f"""
SELECT id, {tags_sql()} AS tags FROM images
WHERE len(list_filter(tags, lambda t: contains(lower(t), 'red') OR contains(lower(t), 'wid'))) > 0
"""

ORACLES["image_updates"] = blocks(IMAGES) + f"""
, a AS (
  SELECT *, CASE WHEN k % 10 = 0 THEN ['replace_tags', 'tombstone', 'untombstone', 'delete'][(k // 10) % 4 + 1] END AS action
  FROM images
)
SELECT id, {tags_sql("CASE WHEN action = 'replace_tags' THEN [p_brand] ELSE tags END")} AS tags,
       strftime(CASE WHEN action = 'tombstone' THEN {ts_plus_days(30)} END, {FMT}) AS tombstone_datetime
FROM a WHERE action IS NULL OR action <> 'delete'
"""

ORACLES["sitemap_entries"] = with_corpus(f"""
, top AS (SELECT * FROM corpus WHERE {VIS} ORDER BY effective_date DESC, id ASC LIMIT 1000)
SELECT '{BASE}/content/' || slug AS loc, strftime(created_at, '%Y-%m-%d') AS lastmod, 'weekly' AS changefreq, CAST(0.5 AS DOUBLE) AS priority
FROM top WHERE slug IS NOT NULL AND slug <> '' AND seo_enabled
""")

ORACLES["article_export"] = blocks(CORPUS_CTE, IMAGES, _BEST) + f"""
, pub AS (
  SELECT c.id, c.slug, c.tags, c.created_at, b.best_image_slug AS img,
         CASE WHEN c.source_type = 'url' THEN regexp_extract(u.html, '<title>([^<]*)</title>', 1) ELSE 'Untitled' END AS title,
         CASE WHEN c.source_type = 'url' THEN {page_content_sql('u.html')} ELSE '' END AS content
  FROM corpus c LEFT JOIN d1_url u ON u.id = c.id LEFT JOIN best b ON b.document_id = c.id
  WHERE c.slug IS NOT NULL AND c.slug <> '' AND c.seo_enabled
),
h AS (SELECT *, {paragraph_sql('content')} AS html FROM pub)
SELECT id, title, '{BASE}/content/' || slug AS canonical_url,
       CASE WHEN img IS NOT NULL AND img <> '' THEN '{IMG_BASE}/images/' || img END AS image_url,
       md5(CASE WHEN img IS NOT NULL AND img <> '' THEN {insert_image_sql('html', 'img')} ELSE html END) AS body_md5,
       title AS ld_headline, strftime(created_at, {RFC}) AS ld_published,
       CASE WHEN img IS NOT NULL AND img <> '' THEN '{IMG_BASE}/images/' || img END AS ld_image,
       tags[1] AS ld_first_keyword
FROM h
"""

# --- streaming (the deterministic ones) -----------------------------------
ORACLES["dedupe_url_stream"] = blocks(LINKS, url_parts_cte("du", "links1", "page_id", "link")) + """
SELECT DISTINCT 'urlcache:' || sha256(normalized_url) AS url_key FROM du WHERE normalized_url IS NOT NULL
"""

ORACLES["status_feed"] = f"""
WITH ev AS (
  SELECT 'd' || CAST(user_id AS VARCHAR) AS request_id,
         ['scraping', 'scraped', 'scrape_failed', 'extracting_links', 'links_extracted', 'link_extraction_failed',
          'enriching', 'enriched', 'enrichment_failed'][event_id % 9 + 1] AS status, ts, event_id AS seq
  FROM events
),
w AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS request_id FROM documents WHERE doc_id % 2 = 0)
SELECT request_id, arg_max(status, (ts, seq)) AS status, strftime(max(ts), {FMT}) AS last_event_at, count(*) AS events
FROM ev WHERE request_id IN (SELECT request_id FROM w) GROUP BY request_id
"""

ORACLES["live_metrics"] = f"""
WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, ts,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' WHEN 'click' THEN 'retry' END AS event
  FROM events
),
a AS (
  SELECT job_id, min(ts) FILTER (WHERE event = 'queued') AS queued_at, min(ts) FILTER (WHERE event = 'processing') AS processing_at
  FROM ev GROUP BY job_id
)
SELECT job_id, strftime(queued_at, {FMT}) AS queued_at, strftime(processing_at, {FMT}) AS processing_at,
       round((epoch_us(processing_at) - epoch_us(queued_at)) / 1e6, 6) AS wait_seconds
FROM a
"""

# reached(key, depth) grows by the links of scraped pages; the least depth counts
ORACLES["crawl"] = "WITH RECURSIVE " + blocks(
    CORPUS_CTE, LINKS, url_parts_cte("pk", "pages", "page_id, url", "url"), url_parts_cte("lk", "links1", "page_id, pos, link", "link")
).strip().removeprefix("WITH") + f"""
, site AS (
  SELECT 'urlcache:' || sha256(pk.normalized_url) AS key, min(pk.page_id) AS page_id, arg_min({_GATE}, pk.page_id) AS decision
  FROM pk JOIN d1_url ON d1_url.k = pk.page_id GROUP BY 1
),
page_key AS (SELECT page_id, 'urlcache:' || sha256(normalized_url) AS key FROM pk),
graph AS (
  SELECT page_id, 'urlcache:' || sha256(normalized_url) AS key FROM lk
  WHERE normalized_url IS NOT NULL AND has_scheme AND lower(p.scheme) IN ('http', 'https') AND parses AND NOT is_image
  UNION
  SELECT a.page_id, b.key FROM page_key a JOIN page_key b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2, a.page_id - 1)
),
seeds AS (SELECT DISTINCT key FROM page_key WHERE page_id % 25 = 0),
cached AS (SELECT key FROM seeds WHERE key IN (SELECT key FROM page_key WHERE page_id % 75 = 0)),
reached(key, depth) AS (
  SELECT key, 0 FROM seeds
  UNION
  SELECT g.key, r.depth + 1 FROM reached r JOIN site s ON s.key = r.key JOIN graph g ON g.page_id = s.page_id
  WHERE r.depth < 3 AND s.decision <> 'rejected' AND r.key NOT IN (SELECT key FROM cached)
)
SELECT r.key AS url_key, min(r.depth)::INTEGER AS depth,
       CASE WHEN r.key IN (SELECT key FROM cached) THEN 'cached' ELSE coalesce(any_value(s.decision), 'failed') END AS outcome,
       CASE WHEN r.key NOT IN (SELECT key FROM cached) THEN any_value(s.page_id) END AS page_id
FROM reached r LEFT JOIN site s ON s.key = r.key GROUP BY r.key
"""

_CHANGED = f"""
SELECT id, effective_date,
       CASE WHEN id[1] = 'd' AND {_KEY} % 11 = 0 THEN list_append(tags, 'spam') ELSE tags END AS tags,
       CASE WHEN id[1] = 'p' AND {_KEY} % 4 = 0 THEN NOT seo_enabled ELSE seo_enabled END AS seo_enabled,
       CASE WHEN id[1] = 'p' AND {_KEY} % 6 = 0 THEN {AS_OF_SQL} + INTERVAL 90 DAY
            WHEN id[1] = 'd' AND {_KEY} % 11 = 0 THEN {AS_OF_SQL} - INTERVAL 10 DAY ELSE tombstone_at END AS tombstone_at
FROM corpus"""
_RTL = dict(_CTL, width_s=21_600, n=188)
_ROLLED = "," + _timeline_sql(_CHANGED, _RTL["start"], _RTL["end"], _RTL["width_s"], _RTL["n"], _RTL["k"], _VIS)
ORACLES["rollup_timeline"] = with_corpus(_ROLLED + _timeline_select(_RTL["start"], _RTL["width_s"]))
ORACLES["rollup_timeline_stats"] = with_corpus(_ROLLED + _timeline_stats_select(_RTL["n"], _RTL["start"], _RTL["end"], _VIS))

ORACLES["status_feed_bounded"] = ORACLES["status_feed"]
ORACLES["queue_waits_bounded"] = ORACLES["live_metrics"]

# a submission is cached if its key was scraped within five days before; scrapes
# are all child links, and from the other submissions the first, then the first
# five days or more after it, and so on
ORACLES["scrape_stream"] = "WITH RECURSIVE " + blocks(LINKS, url_parts_cte("sc", "links1", "page_id, pos, link", "link")).strip().removeprefix("WITH") + f"""
, k AS (
  SELECT CASE WHEN normalized_url IS NOT NULL THEN 'urlcache:' || sha256(normalized_url) END AS url_key,
         page_id % 4 = 0 AS child, {fixture_time_sql('page_id')} AS seen_at FROM sc
),
open AS (
  SELECT DISTINCT url_key, seen_at FROM k s WHERE NOT child AND url_key IS NOT NULL
     AND NOT EXISTS (SELECT 1 FROM k c WHERE c.child AND c.url_key = s.url_key AND c.seen_at <= s.seen_at AND c.seen_at > s.seen_at - INTERVAL 5 DAY)
),
following AS (
  SELECT a.url_key, a.seen_at, min(b.seen_at) AS then_at FROM open a LEFT JOIN open b ON b.url_key = a.url_key AND b.seen_at >= a.seen_at + INTERVAL 5 DAY
  GROUP BY a.url_key, a.seen_at
),
passed AS (
  SELECT url_key, min(seen_at) AS seen_at FROM open GROUP BY url_key
  UNION ALL
  SELECT f.url_key, f.then_at FROM passed p JOIN following f ON f.url_key = p.url_key AND f.seen_at = p.seen_at WHERE f.then_at IS NOT NULL
)
SELECT url_key, child, strftime(seen_at, {FMT}) AS seen_at FROM k WHERE child OR url_key IS NULL
UNION ALL
SELECT url_key, false, strftime(seen_at, {FMT}) FROM passed
"""

ORACLES["ingest_read_documents"] = with_corpus(f"""
SELECT id, strftime(effective_date, {FMT}) AS effective_date, strftime(tombstone_at, {FMT}) AS tombstone_at,
       {tags_sql()} AS tags, seo_enabled, slug FROM corpus
""")

ORACLES["ingest_second_batch"] = with_corpus(f"""
, one AS (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY created_at, id) AS nth FROM corpus WHERE {_KEY} % 3 <> 0
),
held AS (SELECT id, slug FROM one WHERE slug IS NULL OR nth = 1),
two AS (SELECT CASE WHEN {_KEY} % 10 <> 0 THEN id END AS id, slug, created_at FROM corpus WHERE {_KEY} % 2 = 0),
tried AS (
  SELECT two.*, held.id IS NOT NULL AS again, taken.id AS taken_by FROM two
  LEFT JOIN held ON held.id = two.id LEFT JOIN held taken ON taken.slug = two.slug
),
led AS (
  SELECT *, CASE WHEN id IS NOT NULL AND NOT again AND slug IS NOT NULL THEN
           coalesce(taken_by, first_value(id) OVER (PARTITION BY slug, id IS NOT NULL AND NOT again ORDER BY created_at, id)) END AS owner
  FROM tried
)
SELECT id, slug, strftime(created_at, {FMT}) AS created_at,
       CASE WHEN id IS NULL THEN 'rejected' WHEN again THEN 'duplicate' WHEN owner <> id THEN 'conflict' ELSE 'stored' END AS outcome,
       CASE WHEN again THEN 'first' END AS kept_in, CASE WHEN owner <> id THEN owner END AS kept_id
FROM led
""")

ORACLES["backfill_effective_date"] = with_corpus(f"SELECT id, strftime(effective_date, {FMT}) AS effective_date FROM corpus")

ORACLES["image_jsonld"] = blocks(IMAGES) + f"""
SELECT id,
       '{{"@context":"https://schema.org","@type":"ImageObject","contentUrl":' || to_json('http://img.example.com/' || id || '.png')
         || CASE WHEN summary <> '' THEN ',"description":' || to_json(summary) ELSE '' END
         || CASE WHEN alt_text <> '' THEN ',"name":' || to_json(alt_text) ELSE '' END
         || CASE WHEN CAST(relevance_score * 50 AS INTEGER) <> 0 THEN ',"width":' || CAST(CAST(relevance_score * 50 AS INTEGER) AS VARCHAR) ELSE '' END
         || '}}' AS image_ld,
       '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":['
         || '{{"@type":"ListItem","position":1,"name":"Images","item":"{BASE}/images"}},'
         || '{{"@type":"ListItem","position":2,"name":' || to_json(alt_text) || '}}]}}' AS breadcrumb_ld
FROM images
"""

# enrich_stream: the rule itself - the first completed result within the wait,
# else a timeout, for every document once
ORACLES["enrich_stream"] = f"""
WITH d AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, 'a' || CAST(doc_id AS VARCHAR) AS job_id,
         {fixture_time_sql('doc_id')} AS created_at
  FROM documents
),
r AS (
  SELECT 'a' || CAST(doc_id AS VARCHAR) AS job_id, {fixture_time_sql('doc_id')} + to_minutes(CAST(doc_id % 120 AS BIGINT)) AS arrived_at
  FROM documents WHERE doc_id % 4 <> 0
),
j AS (
  SELECT d.id, d.job_id, d.created_at, min(r.arrived_at) AS arrived_at FROM d LEFT JOIN r
    ON r.job_id = d.job_id AND r.arrived_at >= d.created_at AND r.arrived_at <= d.created_at + INTERVAL 60 MINUTE
  GROUP BY d.id, d.job_id, d.created_at
)
SELECT id, job_id, strftime(created_at, {FMT}) AS created_at,
       CASE WHEN arrived_at IS NOT NULL THEN 'applied' ELSE 'timeout' END AS outcome,
       CASE WHEN arrived_at IS NOT NULL THEN CAST(floor((epoch_us(arrived_at) - epoch_us(created_at)) / 60000000) AS BIGINT) END
         AS elapsed_minutes
FROM j
"""

ORACLES["status_feed_events"] = f"""
SELECT 'd' || CAST(user_id AS VARCHAR) AS request_id,
       ['scraping', 'scraped', 'scrape_failed', 'extracting_links', 'links_extracted', 'link_extraction_failed',
        'enriching', 'enriched', 'enrichment_failed'][event_id % 9 + 1] AS status,
       event_type AS stage, 'event ' || CAST(event_id AS VARCHAR) AS message, strftime(ts, {FMT}) AS ts, event_id AS seq
FROM events
WHERE 'd' || CAST(user_id AS VARCHAR) IN (SELECT 'd' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 0)
"""

ORACLES["live_metrics_figures"] = with_corpus(f"""
, {JOBS.strip()}
SELECT 'documents_with_tags' AS metric, '' AS key, count(*) FILTER (WHERE len(tags) > 0) AS value FROM corpus
UNION ALL SELECT 'live_seo_enabled', '', count(*) FILTER (WHERE {VIS}) FROM corpus
UNION ALL SELECT 'tombstones_due', '', count(*) FILTER (WHERE tombstone_at IS NOT NULL AND tombstone_at <= {AS_OF_SQL}) FROM corpus
UNION ALL SELECT 'live_by_source_type', source_type, count(*) FROM corpus WHERE {live_sql()} GROUP BY source_type
UNION ALL SELECT 'unique_tags', '', count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM corpus)
UNION ALL SELECT 'jobs_by_status', s.status, coalesce(c.n, 0)
FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('queued')) s(status)
LEFT JOIN (SELECT status, count(*) AS n FROM jobs GROUP BY status) c ON c.status = s.status
""")
