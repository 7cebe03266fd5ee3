"""URL rules, one case per rule."""

from conftest import evaluate

from folio.functions.urls import domain_tag, is_image_url, is_scrapable_url, normalize_url, url_key

# each rule of the normal form once alone, then rules together
NORMALIZE_CASES = [
    ("http://Shop.Test", "http://shop.test"),  # host case
    ("http://shop.test/Cart/Item", "http://shop.test/Cart/Item"),  # path case stays
    ("http://shop.test/cart/", "http://shop.test/cart"),  # trailing slash
    ("http://shop.test/cart#total", "http://shop.test/cart"),  # fragment
    ("http://shop.test/?utm_medium=mail", "http://shop.test/"),  # tracking key, only one
    ("http://shop.test/l?size=9&colour=red", "http://shop.test/l?colour=red&size=9"),  # key order
    ("http://shop.test/l?c=2&c=1", "http://shop.test/l?c=1&c=2"),  # value order
    ("http://shop.test/l?gclid=7&b=1&fbclid=8&a=2#x", "http://shop.test/l?a=2&b=1"),  # several at once
    ("http://shop.test/l?on", "http://shop.test/l?on="),  # key without a value
    ("http://shop.test/l?q=two%20words", "http://shop.test/l?q=two+words"),  # space in a value
    ("http://shop.test/größe/", "http://shop.test/gr%C3%B6%C3%9Fe"),  # letters outside ASCII
    ("http://shop.test:81/a", "http://shop.test:81/a"),  # port
    ("two words", None),
]

SAME_HASH = [
    ("http://a.test/p/?x=1#y", "http://A.test/p?x=1", True),
    ("http://a.test/p?x=1", "http://a.test/p?x=2", False),
    ("http://a.test/p?x=1&y=2", "http://a.test/p?y=2&x=1&utm_term=z", True),
    ("http://a.test/P", "http://a.test/p", False),
]

IMAGE_CASES = [(f"http://pics.test/dir/file.{ext}", True) for ext in "jpg jpeg png gif webp svg bmp ico tiff".split()] + [
    ("http://pics.test/FILE.PNG", True), ("http://pics.test/a.gif?w=9#top", True), ("http://pics.test/a.gif/b", False),
    ("http://pics.test/gif", False), ("http://pics.test/a.gif.html", False), ("", False),
]

# (address, skipped)
SKIP_CASES = [(f"{scheme}:rest", True) for scheme in "mailto tel data javascript file about blob ftp".split()] + [
    ("http://pics.test/a.png", True), ("http://site.test/", False), ("https://site.test/a?b=c#d", False), ("HTTPS://SITE.TEST", False),
    ("words only", True), ("", True), ("http://si te.test/", True), ("http://site.test/%4", True),
]


def test_normalize_url(spark):
    got = evaluate(spark, normalize_url, [c[0] for c in NORMALIZE_CASES])
    assert got == [c[1] for c in NORMALIZE_CASES]


def test_normalize_idempotent(spark):
    once = [v for v in evaluate(spark, normalize_url, [c[0] for c in NORMALIZE_CASES]) if v is not None]
    assert evaluate(spark, normalize_url, once) == once


def test_url_key_equalities(spark):
    a = evaluate(spark, url_key, [c[0] for c in SAME_HASH])
    b = evaluate(spark, url_key, [c[1] for c in SAME_HASH])
    for (u1, u2, same), k1, k2 in zip(SAME_HASH, a, b):
        assert k1.startswith("urlcache:") and len(k1) == 9 + 64
        assert (k1 == k2) == same, (u1, u2)


def test_url_key_invalid_is_null(spark):
    assert evaluate(spark, url_key, ["not a valid url", "/relative/only"]) == [None, None]


def test_is_image_url(spark):
    assert evaluate(spark, is_image_url, [c[0] for c in IMAGE_CASES]) == [c[1] for c in IMAGE_CASES]


def test_should_skip(spark):
    got = evaluate(spark, is_scrapable_url, [c[0] for c in SKIP_CASES])
    assert [not g for g in got] == [c[1] for c in SKIP_CASES]


def test_domain_tag(spark):
    cases = [
        ("https://www.example.com/a", "example.com"),
        ("https://WWW.Example.com:8443/a", "WWW.Example.com"),
        ("http://user:pw@www.www.site.org", "www.site.org"),
        ("http://[::1]:80/x", "::1"),
        ("http://under_score.example.com/", "under_score.example.com"),
        ("no scheme", ""),
        ("http://bad host/", ""),
    ]
    assert evaluate(spark, domain_tag, [c[0] for c in cases]) == [c[1] for c in cases]


def test_normalize_url_properties_fuzz(spark):
    """Random URLs: no tracking key survives, parameters come out sorted by
    (key, value), hosts are lower case, and a second pass changes nothing
    (unless the path ends in '//', where one '/' is trimmed per pass)."""
    import random
    from urllib.parse import unquote_plus

    from folio.functions.urls import TRACKING_PARAMS

    rng = random.Random(11)
    hosts = ["Example.COM", "www.x.org:8080", "user:pw@h.io", "[::1]:80", "a_b.example"]
    segs = ["p", "für", "a b", "x%20y", "~t", "a*b", "q+r", "é"]
    keys = ["q", "Page", "utm_source", "UTM_Medium", "ref", "a b", "t~", "k*", "fbclid"]
    vals = ["1", "x y", "a+b", "%41", "é", "", "v=w", "~", "*"]

    def rnd():
        u = rng.choice(["http", "HTTPS", "https"]) + "://" + rng.choice(hosts)
        u += "".join("/" + rng.choice(segs) for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.3:
            u += "/"
        if rng.random() < 0.7:
            u += "?" + "&".join(rng.choice(keys) + ("=" + rng.choice(vals) if rng.random() < 0.8 else "")
                                for _ in range(rng.randint(0, 4)))
        return u + ("#frag" if rng.random() < 0.3 else "")

    urls = [rnd() for _ in range(400)]
    once = evaluate(spark, normalize_url, urls)
    twice = evaluate(spark, normalize_url, once)
    tracking = set(TRACKING_PARAMS)
    for u, n, n2 in zip(urls, once, twice):
        assert n is not None, u
        path_part = n.split("?", 1)[0]
        if not path_part.endswith("//"):
            assert n2 == n, (u, n, n2)
        q = n.split("?", 1)[1] if "?" in n else ""
        pairs = [p.split("=", 1) for p in q.split("&") if p]
        decoded = [(unquote_plus(p[0]), unquote_plus(p[1])) for p in pairs]
        assert not any(k.lower() in tracking for k, _ in decoded), (u, n)
        assert decoded == sorted(decoded, key=lambda kv: (kv[0].encode(), kv[1].encode())), (u, n)
        host = n.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0]
        assert host == host.lower(), (u, n)
