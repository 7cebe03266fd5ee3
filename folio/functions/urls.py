"""URL rules as native column expressions.

A URL is split once by one RFC 3986 regex into a parts struct
(``url_parts``); every rule reads those parts. Used on a single column, a
rule splits the URL itself; to apply several rules to the same URLs, add the
parts as a column first (``with_url_parts``) and pass it as ``parts=`` — the
split then runs once per row and every rule reads the materialised struct.
No Python UDF: everything runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.common import col

# [scheme ':'] ['//' authority] path ['?' query] ['#' fragment]
_URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"
_GROUPS = (("scheme", 1), ("slashes", 2), ("authority", 3), ("path", 4), ("qmark", 5), ("query", 6))

# Image extensions skipped by the crawler.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "tiff", "tif")

# Query keys dropped by URL normalisation (compared lower-cased).
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "gclsrc",
    "ref", "source", "referrer", "campaign", "_ga", "mc_cid", "mc_eid", "msclkid",
    "yclid", "_openstat", "fb_action_ids", "fb_action_types", "fb_ref", "fb_source",
    "action_object_map", "action_type_map", "action_ref_map",
)

_CONTROL = r"[\x00-\x1f\x7f]"
_BAD_ESCAPE = r"%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)"
_BAD_HOST_CHAR = r"[ {}|\\^`\"<>]"


def url_parts(url) -> Column:
    """Struct of the URL's parts: scheme, slashes ('//' when an authority is
    present), authority, path, qmark ('?' when a query is present), query,
    hostport (authority without userinfo) and the URL itself."""
    u = col(url)
    fields = [F.regexp_extract(u, _URL_RE, g).alias(n) for n, g in _GROUPS]
    hostport = F.regexp_extract(F.regexp_extract(u, _URL_RE, 3), r"^(?:.*@)?(.*)$", 1)
    return F.struct(*fields, hostport.alias("hostport"), u.alias("url"))


def with_url_parts(df: DataFrame, url_col: str, name: str = "_url") -> DataFrame:
    """Add the parts struct of ``url_col`` as column ``name``."""
    return df.withColumn(name, url_parts(url_col))


def _p(url, parts) -> Column:
    return parts if parts is not None else url_parts(url)


def _has_scheme(p: Column) -> Column:
    return p["scheme"] != ""


def url_path(url=None, *, parts: Column | None = None) -> Column:
    """Path as written; empty for opaque URLs such as ``mailto:x``."""
    p = _p(url, parts)
    opaque = _has_scheme(p) & (p["slashes"] == "") & ~p["path"].startswith("/")
    return F.when(opaque, F.lit("")).otherwise(p["path"])


def _port_ok(hp: Column) -> Column:
    # after an IPv6 literal only ':digits' may follow; else the text after the last ':'
    return F.when(hp.startswith("["), hp.rlike(r"^\[[^\]]*\](:[0-9]*)?$")).otherwise(
        ~hp.contains(":") | ~hp.rlike(r":[^:]*[^0-9:][^:]*$")
    )


def url_parses(url=None, *, parts: Column | None = None) -> Column:
    """Whether the URL parses at all: no control characters, well-formed
    percent escapes in host and path, a legal host and port."""
    p = _p(url, parts)
    hp = p["hostport"]
    return (
        p["url"].isNotNull()
        & ~p["url"].rlike(_CONTROL)
        & ~p["path"].rlike(_BAD_ESCAPE)
        & ~hp.rlike(_BAD_ESCAPE)
        & ~hp.rlike(_BAD_HOST_CHAR)
        & _port_ok(hp)
    )


def is_image_url(url=None, *, parts: Column | None = None) -> Column:
    """Lower-cased path (no query, no fragment) ends in an image extension."""
    p = _p(url, parts)
    ext = "|".join(IMAGE_EXTENSIONS)
    return F.coalesce(url_parses(parts=p) & F.lower(url_path(parts=p)).rlike(rf"\.({ext})$"), F.lit(False))


def is_scrapable_url(url=None, *, parts: Column | None = None) -> Column:
    """Parses, scheme http/https in any case, and not an image."""
    p = _p(url, parts)
    scheme_ok = F.lower(p["scheme"]).isin("http", "https")
    return F.coalesce(url_parses(parts=p) & scheme_ok & ~is_image_url(parts=p), F.lit(False))


def url_hostname(url=None, *, parts: Column | None = None) -> Column:
    """Host without userinfo, port or IPv6 brackets; '' when absent."""
    hp = _p(url, parts)["hostport"]
    return F.when(hp.startswith("["), F.regexp_extract(hp, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(hp, r"^(.*?)(:[0-9]*)?$", 1)
    )


def domain_tag(url=None, *, parts: Column | None = None) -> Column:
    """Host without port, one leading 'www.' removed (case kept); '' if unparseable."""
    p = _p(url, parts)
    host = url_hostname(parts=p)
    stripped = F.when(host.startswith("www."), F.regexp_replace(host, r"^www\.", "")).otherwise(host)
    return F.when(url_parses(parts=p), stripped).otherwise(F.lit(""))


def _query_escape(s: Column) -> Column:
    # Java's form encoding differs from the target encoding on two characters:
    # '~' must stay literal and '*' must be escaped.
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


# Characters a path may hold unescaped; anything else means the written path
# is not a valid encoding and is re-escaped from its decoded form.
_VALID_PATH = r"^[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/]*$"
# (escaped form, literal) pairs the path escaping leaves literal, beyond what
# Java's form encoding already leaves alone.
_PATH_KEEP = (
    ("%7E", "~"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%24", "$"),
    ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%3D", "="),
)


def _path_escape(decoded: Column) -> Column:
    e = F.url_encode(decoded)
    e = F.replace(e, F.lit("+"), F.lit("%20"))  # '+' here only comes from a space
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    for enc, ch in _PATH_KEEP:
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e


def _normal_path(raw: Column) -> Column:
    """Path with one trailing '/' dropped (unless it is '/'): kept as written
    when untouched and validly encoded, otherwise re-escaped canonically."""
    trim = (F.length(raw) > 1) & raw.endswith("/")
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    decoded = F.when(trim, F.regexp_replace(decoded, "/$", "")).otherwise(decoded)
    keep = ~trim & raw.rlike(_VALID_PATH)
    return F.when(keep, raw).otherwise(_path_escape(decoded))


def _normal_query(p: Column) -> Column:
    pieces = F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~x.contains(";"))
    kv = F.transform(
        pieces,
        lambda x: F.struct(
            F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    tracking = F.array(*[F.lit(t) for t in TRACKING_PARAMS])
    kept = F.filter(kv, lambda e: e["k"].isNotNull() & e["v"].isNotNull() & ~F.array_contains(tracking, F.lower(e["k"])))
    encoded = F.array_join(
        F.transform(F.array_sort(kept), lambda e: F.concat(_query_escape(e["k"]), F.lit("="), _query_escape(e["v"]))),
        "&",
    )
    force = (p["qmark"] != "") & (p["query"] == "")
    return F.when((encoded != "") | force, F.concat(F.lit("?"), encoded)).otherwise(F.lit(""))


def normalize_url(url=None, *, parts: Column | None = None) -> Column:
    """Canonical form of a URL for de-duplication, null when invalid.

    Lower-cases scheme and host, drops the fragment and tracking parameters,
    sorts the remaining parameters by key then value, re-encodes them, and
    drops one trailing '/' from a path longer than '/'.
    """
    p = _p(url, parts)
    userinfo = F.regexp_extract(p["authority"], r"^(.*@)?", 1)
    valid = _has_scheme(p) & (p["slashes"] != "") & (p["hostport"] != "") & url_parses(parts=p)
    return F.when(
        valid,
        F.concat(
            F.lower(p["scheme"]), F.lit("://"), userinfo, F.lower(p["hostport"]), _normal_path(p["path"]), _normal_query(p)
        ),
    )


def url_key(url=None, *, parts: Column | None = None, normalized: Column | None = None) -> Column:
    """Cache key of a URL: 'urlcache:' + sha256 hex of its normal form."""
    n = normalized if normalized is not None else normalize_url(url, parts=parts)
    return F.when(n.isNotNull(), F.concat(F.lit("urlcache:"), F.sha2(n, 256)))


def link_base(base_url) -> Column:
    """What resolving an href against a page needs from the page URL,
    computed once per page: scheme, origin (scheme://authority), directory
    of the path, and the URL without fragment / without query."""
    b = col(base_url)
    directory = F.regexp_replace(F.regexp_extract(b, _URL_RE, 4), r"[^/]*$", "")
    return F.struct(
        F.regexp_extract(b, _URL_RE, 1).alias("scheme"),
        F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1).alias("origin"),
        F.when(directory == "", F.lit("/")).otherwise(directory).alias("directory"),
        F.regexp_replace(b, "#.*$", "").alias("no_fragment"),
        F.regexp_replace(b, r"[?#].*$", "").alias("no_query"),
    )


def with_url_key(df: DataFrame, url_col: str = "url", name: str = "url_key") -> DataFrame:
    """Add the cache key (R52) of ``url_col`` as column ``name``, splitting
    each URL once. The key is emitted by a generator so later filters or
    groupings on it test the column instead of being pushed below and
    re-deriving the key."""
    split = with_url_parts(df, url_col, "_url")
    key = url_key(parts=F.col("_url")).alias(name)
    return split.select(*df.columns, F.inline(F.array(F.struct(key))))


def resolve_link(base_url=None, href=None, *, base: Column | None = None) -> Column:
    """Absolute form of an href found on a page: absolute hrefs stay, '//x'
    takes the page's scheme, '/x' takes scheme and host, anything else is
    taken relative to the page's directory. ``base`` is a ``link_base``
    struct when the page parts are already computed."""
    b = base if base is not None else link_base(base_url)
    h = col(href)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
        .when(h.startswith("/"), F.concat(b["origin"], h))
        .when(h.startswith("#") | (h == ""), b["no_fragment"])
        .when(h.startswith("?"), F.concat(b["no_query"], h))
        .otherwise(F.concat(b["origin"], b["directory"], h))
    )


_DOTS = r"(^|/)\.\.?(/|$|\?|#)"


def without_dots(url: Column) -> Column:
    """An absolute address with the ``.`` and ``..`` segments of its path
    removed (only http-like addresses that have such segments are rebuilt)."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    folder = F.element_at(segments, -1).isin(".", "..")
    rebuilt = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    return F.when((origin != "") & path.rlike(_DOTS), F.concat(origin, rebuilt, tail)).otherwise(url)
