"""Slugs, authors and article HTML."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col


def _transliteration_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every BMP character whose canonical
    decomposition, with nonspacing marks removed, leaves one ASCII letter or
    digit maps to it; those leaving an upper-case letter are deleted (the text
    is lower-cased first, so they could not survive). Derived by rule from the
    Unicode database, so it covers exactly what NFD-strip-NFC would keep."""
    src, dst, delete = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        stripped = unicodedata.normalize(
            "NFC", "".join(c for c in nfd if unicodedata.category(c) != "Mn")
        )
        if stripped == ch:
            continue
        ascii_part = [c for c in stripped if c.isascii() and (c.isalnum() or c in " _-")]
        if len(ascii_part) != 1:
            continue
        c = ascii_part[0]
        if c.isupper():
            delete.append(ch)
        else:
            src.append(ch)
            dst.append(c)
    return "".join(src) + "".join(delete), "".join(dst)


_FROM, _TO = _transliteration_table()


def slugify(text) -> Column:
    """URL slug: lower, strip diacritics, space/underscore to '-', keep
    [a-z0-9-], collapse and trim '-', cut at 100, trim trailing '-'."""
    s = F.lower(col(text))
    s = F.translate(s, _FROM, _TO)
    s = F.regexp_replace(s, "[ _]", "-")
    s = F.regexp_replace(s, "[^a-z0-9-]+", "")
    s = F.regexp_replace(s, "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    s = F.regexp_replace(F.substring(s, 1, 100), "-+$", "")
    return F.coalesce(s, F.lit(""))


def slugify_or(text, fallback) -> Column:
    """R49 with fallback: slug of ``fallback`` when ``text`` gives an empty slug."""
    s = slugify(text)
    return F.when(s == "", slugify(fallback)).otherwise(s)


def utf8_prefix(text, n_bytes: int = 100) -> Column:
    """First ``n_bytes`` bytes of the UTF-8 text; a character cut in half is
    turned into U+FFFD, which slugify drops like the reference does."""
    return F.make_valid_utf8(F.substring(col(text).cast("binary"), 1, n_bytes).cast("string"))


def slug_source(cleaned_text, text) -> Column:
    """First 100 bytes of the cleaned text if non-empty, else of the text."""
    c = col(cleaned_text)
    return F.when(c.isNotNull() & (c != ""), utf8_prefix(c)).otherwise(utf8_prefix(F.coalesce(col(text), F.lit(""))))


_TRIM = r"(?U)^\s+|\s+$"


def trim_space(s) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col(s), _TRIM, "")


def clean_author(author) -> Column:
    """R53: '' when the author looks like a URL."""
    a = col(author)
    t = trim_space(a)
    looks = t.startswith("http://") | t.startswith("https://") | t.startswith("www.") | t.contains("://")
    return F.when(a.isNull(), F.lit("")).when(looks, F.lit("")).otherwise(a)


def paragraph_html(content) -> Column:
    """Blank-line separated paragraphs, trimmed, empties dropped, inner
    newlines as <br>, each wrapped as '<p>…</p>\\n'."""
    c = F.coalesce(col(content), F.lit(""))
    parts = F.transform(F.split(c, "\n\n"), trim_space)
    parts = F.filter(parts, lambda p: p != "")
    html = F.array_join(
        F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>\n"))),
        "",
    )
    return F.when(c == "", F.lit("")).otherwise(html)


# Fixed value: markup of the figure placed in the middle of an article.
FIGURE_HTML = (
    '\n<figure class="article-image" style="margin: 2rem 0; text-align: center;">\n'
    '\t<img src="{base}/images/{slug}"\n'
    '\t     alt="Article illustration"\n'
    '\t     style="max-width: 100%; height: auto; display: block; margin: 0 auto; '
    'image-rendering: -webkit-optimize-contrast; image-rendering: crisp-edges;"\n'
    '\t     loading="lazy">\n'
    "</figure>"
)


def insert_image(html, base_url, image_slug) -> Column:
    """Put the figure after the middle '</p>' piece when the HTML has at
    least three non-blank pieces.

    The HTML is split once; the pieces are bound to a lambda variable (a
    one-element ``transform``) so the midpoint and the two halves read the
    same array instead of re-splitting per piece."""
    h = F.coalesce(col(html), F.lit(""))
    slug = col(image_slug)
    head, tail = FIGURE_HTML.split("{base}")
    mid_text, end_text = tail.split("{slug}")
    figure = F.concat(F.lit(head), col(base_url), F.lit(mid_text), slug, F.lit(end_text))

    def closed(p):
        return F.when(p != "", F.concat(p, F.lit("</p>"))).otherwise(F.lit(""))

    def with_figure(pieces):
        n = F.size(pieces)
        mid = F.floor(n / 2).cast("int")
        before = F.array_join(F.transform(F.slice(pieces, F.lit(1), mid + 1), closed), "")
        after = F.array_join(F.transform(F.slice(pieces, mid + 2, n - mid - 1), closed), "")
        nonblank = F.size(F.filter(pieces, lambda p: trim_space(p) != ""))
        return F.when(nonblank < 3, h).otherwise(F.concat(before, figure, after))

    placed = F.element_at(F.transform(F.array(F.split(h, "</p>", -1)), with_figure), 1)
    skip = (h == "") | slug.isNull() | (slug == "")
    return F.when(skip, h).otherwise(placed)
