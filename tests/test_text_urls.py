import pytest
from pyspark.sql import functions as F

from larkspur.functions import robots, sql, text, urls
from larkspur.plans.catalogue import ROBOTS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    s = F.lit("The C++17 Ünïcode_x İstanbul K(elvin) a-b " + "z" * 200)
    assert one(spark, text.ascii_tokens(s)) == ["the", "c", "17", "n", "code", "x", "stanbul", "k", "elvin", "a", "b", "z" * 127]
    assert one(spark, text.unicode_tokens(s)) == ["the", "c", "17", "Ünïcode_x", "İstanbul", "k", "elvin", "a-b", "z" * 200]
    assert one(spark, text.ascii_tokens(F.lit("a\0b"))) == ["a"]
    assert len(one(spark, text.unicode_tokens(F.lit("w " * 3000)))) == 1024


def test_html(spark):
    page = '<html><title a="1"> A&amp;B\n c</title><script>var x="<p>";</script>x &amp;lt; <b>y</b>&#39;<a HREF = "/docs">d</a><a href=\'#top\'>t</a> > z <i'
    assert one(spark, text.html_title(F.lit(page))) == "A&amp;B c"
    assert one(spark, text.html_text(F.lit(page))) == "A&B c x < y ' d t z"
    assert one(spark, text.html_links(F.lit(page))) == ["/docs"]
    assert one(spark, text.html_title(F.lit("no title"))) == ""


def test_content_type_and_cut(spark):
    assert one(spark, text.content_type(F.lit("HTTP/1.1 200\r\ncontent-type: a/b\r\nContent-Type:\t text/html \r\n"))) == "text/html"
    assert one(spark, text.content_type(F.lit("X: y"))) is None
    assert one(spark, text.cut_bytes(F.lit("abcdef"), 3)) == "abc"


@pytest.mark.parametrize(
    "url,expected",
    [
        ("HTTPS://User@Example.COM:443/A?b=C#frag", "https://user@example.com/A?b=C"),
        ("http://Example.com", "http://example.com/"),
        ("http://h?x", "http://h?x"),
        ("http://h:80", "http://h/"),
        ("http://h:8080/", "http://h:8080/"),
        ("http://[::1]:80/x", "http://[::1]:80/x"),
        ("ftp://h/", None),
        ("http://", None),
        (" http://h/", None),
        ("http://h/" + "a" * 2040, None),
    ],
)
def test_canonical(spark, url, expected):
    assert one(spark, urls.canonical(F.lit(url))) == expected


BASE = "https://example.com/docs/page.html"


@pytest.mark.parametrize(
    "base,ref,expected",
    [
        (BASE, "../api?q=1#top", "https://example.com/api?q=1"),
        (BASE, "/docs/", "https://example.com/docs"),
        (BASE, "a/b/..", "https://example.com/docs/a/"),
        (BASE, "?q=a/../b", "https://example.com/docs/b"),
        (BASE, "x?u=http://z//y", "https://example.com/docs/x?u=http:/z/y"),
        (BASE, "mailto:a@b", "https://example.com/docs/mailto:a@b"),
        (BASE, "//Other.org/x", "https://other.org/x"),
        (BASE, "#x", "https://example.com/docs/page.html"),
        (BASE, "", None),
        (BASE, "HTTP://A/b", "http://a/b"),
        ("http://h", "y", "http://hy/"),
        ("http://h?x", "y", "http://hy/"),
        ("ftp://h/", "y", None),
    ],
)
def test_resolved(spark, base, ref, expected):
    assert one(spark, urls.resolved(F.lit(base), F.lit(ref))) == expected


@pytest.mark.parametrize(
    "url,allowed",
    [
        ("http://example.com/", True),
        ("HTTP://example.com/", False),
        ("http://u@h/", False),
        ("http:///x", False),
        ("http://localhost:8080/", False),
        ("http://localhost.example/", True),
        ("http://127.0.0.1", False),
        ("http://[::1]/", False),
        ("https://169.254.169.254/latest", False),
        (None, False),
    ],
)
def test_may_fetch(spark, url, allowed):
    assert one(spark, urls.may_fetch(F.lit(url).cast("string"))) is allowed


@pytest.mark.parametrize("path,body,agent,allowed", ROBOTS)
def test_robots(spark, path, body, agent, allowed):
    assert one(spark, robots.robots_allowed(F.lit(path), F.lit(body), F.lit(agent))) is allowed


def test_robots_null(spark):
    none = F.lit(None).cast("string")
    assert one(spark, robots.robots_allowed(none, F.lit("x"), none)) is True
    assert one(spark, robots.robots_allowed(F.lit("/"), none, none)) is True


def test_segments(spark):
    s = one(spark, text.segments(F.lit("hello ```c\nint x = 1;\n``` world $$x^2$$ done")))
    assert [x["kind"] for x in s] == ["text", "code", "text", "latex", "text"]
    assert [x["length"] for x in s] == [6, 19, 7, 7, 5]
    assert [x["start"] for x in s] == [0, 6, 25, 32, 39]
    assert [x["kind"] for x in one(spark, text.segments(F.lit("a \\[ x \\] b \\( open")))] == ["text", "latex", "text", "latex"]
    assert one(spark, text.segments(F.lit(""))) == []
    long = "é" * 50_000 + "$$" + "y" * 50_000
    assert [(x["start"], x["length"]) for x in one(spark, text.segments(F.lit(long)))] == [(0, 100_000), (100_000, 50_002)]


def test_robots_buffers_hold_bytes(spark):
    """A value counts for 767 bytes and a line for 1023, whatever characters they hold; in SQL too."""
    sql.register(spark)
    two = "é"
    cases = [
        ("/" + two * 400, "User-agent: *\nDisallow: /" + two * 500, "bot", False),  # the rule's 767 bytes end the path's 383rd letter
        ("/" + two * 382, "User-agent: *\nDisallow: /" + two * 500, "bot", True),
        ("/" + two * 383, "User-agent: *\nDisallow: /" + two * 500, "bot", False),
        ("/x", "User-agent: *\n" + two * 130 + ": /\nDisallow: /x", "bot", False),
        ("/a", "User-agent: " + two * 3 + "\nDisallow: /a", two * 3, False),
        ("/a", "User-agent: *\nDisallow:" + " " * 1020 + "/a", "bot", True),
        ("/" + two + "b", "User-agent: *\nDisallow: /" + two + "\nAllow: /" + two + "b", "bot", True),
    ]
    df = spark.createDataFrame(cases, "p string, b string, a string, allowed boolean")
    got = df.select("allowed", robots.robots_allowed(F.col("p"), F.col("b"), F.col("a")), F.expr("robots_allows(p, b, a)")).collect()
    assert all(r[0] == r[1] == r[2] for r in got), [tuple(r) for r in got]


def test_offsets_of_many_segments(spark):
    """Offsets are sums, whatever the number of segments; a text without any has none."""
    for n in (0, 1, 63, 64, 65, 1000):
        t = "é```c```" * n
        got = one(spark, text.segments(F.lit(t)))
        at, want = 0, []
        for k, (kind, size) in enumerate([("text", 2), ("code", 7)] * n):
            want.append((k, kind, at, size))
            at += size
        assert [tuple(x) for x in got] == want
    assert one(spark, text.segments(F.lit(None).cast("string"))) is None
