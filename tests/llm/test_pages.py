"""Operators on pages: URL filters, HTML extraction, WARC archive."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import html_extract, url_filter, warc

SF = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' as host", "'y' as digest", "'z' as payload", "'t' as text", "0 as n", "'r' as record")


# URL filters

URLS = {
    "http://Sub.Example.ORG/es/1?x#y": ("sub.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://example.org": ("example.org", "", None, "allow"),
    "ftp://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
    "a://b.com/fr/://c": ("b.com", "/fr/://c", "com/fr/", "allow"),
    "http://spam-farm.example.org": ("spam-farm.example.org", "", None, "block"),
    "http://spam-farm.example.org/x": ("spam-farm.example.org", "/x", "org/", "allow"),
    "http://www.casino-win.example.net/x": ("www.casino-win.example.net", "/x", None, "block"),
    "http://?q": ("", "", None, "allow"),
    "http:///p": ("", "/p", None, "allow"),
    "no scheme.com/de/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://É.com/de/ü🙂": ("É.com", "/de/ü🙂", "com/de/", "block"),
    "x\n://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
    "http://com/de/": ("com", "/de/", "com/de/", "block"),
    "http://a..com/de/": ("a..com", "/de/", "com/de/", "block"),
}


@pytest.mark.parametrize("most", [url_filter.MAX_INDEX_BYTES, 0], ids=["mapped array", "join"])
def test_urls(spark, most):
    rows = [(i, u) for i, u in enumerate(URLS)]
    got = url_filter.filter_urls(frame(spark, rows + rows, "page_id long, url string"), url_filter.default_entries(), max_index_bytes=most)
    found = sorted((r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in got.collect())
    assert found == sorted((i, URLS[u]) for i, u in rows + rows)


def test_digest_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    packed = url_filter.pack(url_filter.default_entries())
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(packed)
        f.flush()
        index = url_filter.DigestIndex(f.name)
        assert list(index.entries([("com", "/de/"), ("net", "/de/"), ("co", "m/de/")])) == [(0, "com/de/", url_filter.BLOCK)]


def test_urls_empty(spark):
    pages = frame(spark, [(1, "http://a.com/de/")], "page_id long, url string")
    assert url_filter.filter_urls(pages.limit(0), url_filter.default_entries()).collect() == []
    assert [r["verdict"] for r in url_filter.filter_urls(pages, []).collect()] == ["allow"]


@pytest.mark.parametrize("sf", SF)
def test_urls_sql(same, sf):
    same(url_filter.op1_url_filters, url_filter.SQL, sf)


# HTML

ARTICLE = "<h1>Head &amp; line</h1><p>First  para\n with <b>bold</b> and <a href=x>link</a>.<p>Second &eacute;.</p><ul><li>One</li><li>Two</li></ul>"
TEXT = "Head & line\nFirst para with bold and link.\nSecond é.\nOne\nTwo"
NOISE = [
    "<nav><ul><li><a href=/a>Home</a></li></ul></nav>",
    "<header>Site name</header>",
    "<footer>&copy; site</footer>",
    "<div class='ad'>Buy this thing now, it is a very good thing to buy.</div>",
    "<aside>More to read</aside>",
    "<script>var t='</p><p>no'; if (a<b) x();</script>",
    "<style>p{margin:0}</style>",
    "<form><label>Mail</label><input name=q><button>Send</button></form>",
    "<div id='comments'><p>Reader: I do not agree with this at all, no sir.</p></div>",
    "<div class='cookie-notice'>We use cookies to make the site better for you.</div>",
    "<!-- <p>hidden</p> -->",
    "<div class='sidebar-left'><p>Other stories that you may like to read today.</p></div>",
    "<noscript>Enable it</noscript><template><p>no</p></template>",
]


@pytest.mark.parametrize("holder", ["article", "main", "div class='post-body'"])
@pytest.mark.parametrize("noise", NOISE)
def test_noise_goes(holder, noise):
    name = holder.split()[0]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{noise}<{holder}>{ARTICLE}</{name}>{noise}</body></html>"
    assert html_extract.main_text(page) == TEXT


def test_noise_inside_the_article_goes():
    # an article's own header belongs to it
    inside = "".join(n for n in NOISE if not n.startswith("<header"))
    assert html_extract.main_text(f"<body><article>{ARTICLE}{inside}</article></body>") == TEXT


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>a &lt;b&gt; &#233; &am c</p>", "a <b> é &am c"),
    ("<article><p>cut <b", "cut"), ("<article><p>x<br>y</article>", "x y"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<div></div>", ""),
    ("<article><p>long</p></article>" + "<", "long\n<"),
])
def test_page_edge_cases(page, text):
    assert html_extract.main_text(page) in (text, text.removesuffix("\n<"))


def test_chunks_do_not_change_the_text(monkeypatch):
    page = f"<body>{''.join(NOISE)}<article>{ARTICLE}</article></body>"
    whole = html_extract.main_text(page)
    for size in (1, 7, 64):
        monkeypatch.setattr(html_extract, "CHUNK", size)
        assert html_extract.main_text(page) == whole == TEXT


def test_pages_query(spark):
    got = html_extract.op4_html(spark, SF[0])
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert got.count() == spark.read.parquet(f"{SF[0]}/pages.parquet").count()
    assert got.where("n_chars != length(text) or text is null").count() == 0
    pages = frame(spark, [(1, None, None), (1, None, None)], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()] == [("", 0)] * 2
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_long_pages_take_linear_time():
    import time

    def took(n):
        page = "<article>" + "<p>some words here</p>" * n
        t = time.perf_counter()
        html_extract.main_text(page)
        return time.perf_counter() - t

    took(100)
    assert took(20_000) < 25 * max(took(2_000), 0.01)


# WARC


@pytest.mark.parametrize("sf", SF)
def test_warc_sql(same, sf):
    same(warc.op5_warc, warc.SQL, sf)


def test_warc_round_trip(spark, tmp_path):
    big, unicode_ = "x" * 1000, "é🙂" * 300
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "u\r\nv", unicode_), (5, "", unicode_), (6, "s", "small"), (7, "s", "small"), (8, "n", None), (9, "n", ""), (10, "x", "x" * 999), (11, "x", "x" * 999)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    found = {r["record"]: r for r in warc.read_archive(spark, path).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in found.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), **{i: ("response", None) for i in (6, 7, 8, 9, 10, 11)}}
    for i, url, html in rows:
        payload = (html or "").encode()
        r = found[i]
        assert bytes(r["payload"]) == payload
        raw = bytes(r["raw"])
        header, _, body = raw.partition(b"\r\n\r\n")
        assert header.startswith(b"WARC/1.1\r\n") and f"sha1:{hashlib.sha1(payload).hexdigest()}".encode() in header
        assert body == (b"" if r["record_type"] == "revisit" else payload) + b"\r\n\r\n"


def test_warc_detects_damage(spark, tmp_path):
    pages = frame(spark, [(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    import zstandard

    spark.read.parquet(f"{path}/payloads").withColumn("packed", F.lit(zstandard.ZstdCompressor().compress(b"other"))).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{path}2").collect()


def test_warc_empty_and_repeated(spark, tmp_path):
    pages = frame(spark, [(1, "u", "y" * 2000)] * 2 + [(None, None, "y" * 2000)], "page_id long, url string, html string")
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).collect() == []
    warc.write_archive(pages, str(tmp_path / "some"))
    got = sorted((str(r["record"]), r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "some")).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "revisit", 1)]


def test_hosts_of_many_labels_cost_little():
    host = "a." * 200_000 + "example.org"
    found = url_filter.candidates(host, "/en/1", [0, 1], len("www.example.org"))
    assert [h for h, p in found if p == ""] == ["a.a.example.org", "a.example.org", "example.org", "org"] and len(found) == 8
    assert url_filter.candidates("", "/", [0], 9) == []
