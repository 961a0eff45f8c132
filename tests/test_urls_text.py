"""Native URL and whitespace functions against Python's standard library (seeded generators)."""

import random
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from trawl.functions import text as TX
from trawl.functions import urls as U

EXTS = U.BLACKLISTED_EXTENSIONS


def py_blacklisted(u):
    return urlparse(u).path.lower().endswith(tuple(EXTS))


def test_blacklist_table(spark):
    cases = {
        "http://h/a.pdf": True, "http://h/a.PDF?x": True, "http://h/a.pdf;x=1": True, "http://h/a.pdf#z": True,
        "http://h/d;v/a.docx;z": True, "http://h/a b.pdf": True, "http://h/a.php/": False,
        "http://h/x?f=a.pdf": False, "http://h/%2Epdf": False, "http://h": False, "a.jpeg": True,
        "mailto:x.png": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.b for r in df.select("u", U.is_blacklisted_extension("u").alias("b")).collect()}
    assert got == cases
    assert all(py_blacklisted(k) == v for k, v in cases.items())


def test_blacklist_differential(spark):
    rnd = random.Random(7)
    parts = ["a", "b.c", "x.pdf", "y.PhP", "z.docx", ";p=1", " s", "%2E", ".jpeg", ".png;", "d.aspx"]
    urls = []
    for _ in range(400):
        path = "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 3)))
        tail = rnd.choice(["", "?q=x.pdf", "#f.png", "?a=1#b", ";x"])
        head = rnd.choice(["http://h/", "https://u:p@h:8/", "//h/", "/", "", "ftp://h/"])
        urls.append(head + path + tail)
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: r.b for r in df.select("u", U.is_blacklisted_extension("u").alias("b")).collect()}
    assert got == {u: py_blacklisted(u) for u in urls}


# Literal table (input → expected output); expectations were produced with Python's own
# urllib/base64 behaviour: padded, unpadded and URL-safe payloads, length ≡ 1 (mod 4),
# no ``aHR0c``, repeated and blank ``u``, other host, other path, stray characters (padding
# counted on the raw length), whitespace ending the payload, invalid UTF-8.
REDIRECT_CASES = [
    ("https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9leC5leGFtcGxlL8O8P3g9MSZ5PTI=&ntb=1",
     "https://ex.example/ü?x=1&y=2"),
    ("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leC5leGFtcGxlL8O8P3g9MSZ5PTI", "https://ex.example/ü?x=1&y=2"),
    ("https://www.bing.com/ck/a?u=&u=a1aHR0cDovL2EvYg", "http://a/b"),
    ("https://www.bing.com/ck/a?u=a1aHR0cDovL2EvYg&u=a1aHR0cDovL3o", "http://a/b"),
    ("https://www.bing.com/ck/a?u=a1aHR0cDovL", "https://www.bing.com/ck/a?u=a1aHR0cDovL"),
    ("https://www.bing.com/ck/a?u=a1nothing", "https://www.bing.com/ck/a?u=a1nothing"),
    ("https://www.bing.com/ck/b?u=a1aHR0cDovL2EvYg==", "https://www.bing.com/ck/b?u=a1aHR0cDovL2EvYg=="),
    ("https://x.example/ck/a?u=a1aHR0cDovL2EvYg==", "https://x.example/ck/a?u=a1aHR0cDovL2EvYg=="),
    ("https://www.bing.com/ck/a?u=a1aHR0cDovL2EvYg!!", "https://www.bing.com/ck/a?u=a1aHR0cDovL2EvYg!!"),
    ("https://www.bing.com/ck/a?u=a1aHR0cDovL2EvYg tail", "http://a/b"),
    ("https://www.bing.com/ck/a?u=a1aHR0cP_-", "https://www.bing.com/ck/a?u=a1aHR0cP_-"),
    ("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly90LmV4YW1wbGUvxZ8vxJ8", "https://t.example/ş/ğ"),
]


def test_redirect_table(spark):
    df = spark.createDataFrame(REDIRECT_CASES, "u string, want string")
    rows = df.select("u", "want", U.decode_redirect("u").alias("got")).collect()
    assert [(r.u, r.got) for r in rows] == [(r.u, r.want) for r in rows]


def test_spam_and_status(spark):
    df = spark.createDataFrame([("http://x.XVIDEOS.example/",), ("http://ok.example/zhihu.co",),
                                ("http://a/?q=onlyfans",)], "u string")
    assert [r.s for r in df.select(U.is_spam("u").alias("s")).collect()] == [True, False, True]
    st = spark.createDataFrame([(200,), (299,), (301,), (404,), (500,), (None,), (199,)], "s int")
    assert [r.k for r in st.select(U.status_allowed("s").alias("k")).collect()] == [True, True, True, True, False,
                                                                                     True, False]


def test_whitespace_differential(spark):
    rnd = random.Random(3)
    alphabet = ["a", "b", " ", "\t", "\n", "\xa0", "\x1c", " ", "　", "\x85", "é", "​"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", TX.word_count("t").alias("n"), TX.collapse_ws("t").alias("c"),
                     TX.more_words_than("t", 3).alias("m")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.n == len(t.split())
        assert r.c == re.sub(r"\s+", " ", t).strip()
        assert r.m == (len(t.split()) > 3)


def test_search_url(spark):
    df = spark.createDataFrame([("elma armut",)], "k string")
    r = df.select(U.search_url("k").alias("a"), U.search_url("k", encode=True).alias("b")).first()
    assert r.a.startswith("https://www.bing.com/search?q=elma armut&search=Submit+Query")
    assert r.b.startswith("https://www.bing.com/search?q=elma+armut&")
    assert F is not None


def test_params_only_for_schemes_that_have_them(spark):
    from trawl.functions import urls as U

    rows = [("http://h/a.pdf;v=1", True), ("javascript:x;y.png", True), ("mailto:a;b", False), ("x;y.png", False), ("http://h/x;y.png", False)]
    df = spark.createDataFrame([(u,) for u, _ in rows], "url string").withColumn("b", U.is_blacklisted_extension("url"))
    assert {r.url: r.b for r in df.collect()} == dict(rows)


def test_redirect_with_mixed_escapes(spark):
    import base64
    from urllib.parse import parse_qs, urlsplit

    from trawl.functions import urls as U

    pay = base64.urlsafe_b64encode(b"http://a/b").decode().rstrip("=")
    url = f"https://www.bing.com/ck/a?u=%zz%61{pay}"
    assert parse_qs(urlsplit(url).query)["u"][0] == f"%zza{pay}"
    got = spark.createDataFrame([(url,)], "url string").select(U.decode_redirect("url").alias("d")).first().d
    assert got == "http://a/b"
