"""Operators over pages."""

import io
import struct
from hashlib import sha1

import pytest
import zstandard

from strandline.llm import html_text, url_filter, warc

EDGE = "page_id long, url string, html string, host string, size int"
BIG = "<p>" + "y" * 2000 + "</p>"
ROWS = [
    (1, "http://A.Example.NET/en/x?q#f", BIG, "h", 1),
    (2, "http://example.net/EN/", BIG, "h", 1),
    (3, "https://fr.org/fr/1", "<p>small</p>", None, None),
    (4, "https://fr.org/fr", "<p>small</p>", "h", 1),
    (5, None, None, None, None),
    (6, "no scheme", "", "h", 1),
    (7, "http://", "é" * 600, "h", 1),
    (None, "http://x.net/", BIG, "h", 1),
    (8, "http://user@x.example.com:80/de/\n?a://b", "plain\x00 text", "h", 1),
    (8, "http://user@x.example.com:80/de/\n?a://b", "plain\x00 text", "h", 1),
    (9, "x://日本.org/fr/~", "<html><body>" + "<div>" * 3000 + "deep", "h", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EDGE)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a><li><a href='/b'>b</a></ul></nav><div class="ad">Buy &amp; win</div>
<div id="cookie-notice">We use cookies on this site to make it nicer for all of you</div>
<main><div><h2>Title &lt;1&gt;</h2><p>First   paragraph<br>goes <b>on and<p>Second<!-- no --> one, with a <a href="/l">link</a> inside.</p>
<ul><li>item one<li>item two</ul><table><tr><td>c1<td>c2</table></div></main>
<aside>More</aside><section class="comments"><p>I like this article a lot, and I read all of it twice</p></section><form>Name <input> <button>Go</button></form><footer>&copy; 2020</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title <1>\nFirst paragraph goes on and\nSecond one, with a link inside.\nitem one\nitem two\nc1\nc2"


def test_density_finds_text_without_semantic_elements():
    links = "".join(f'<a href="/{i}">link {i}</a> ' for i in range(40))
    text = "<p>" + "A sentence of the article that goes on for a while. " * 4 + "</p>"
    page = f"<body><div>{links}</div><div><div>{text * 3}<p>Short.</p></div></div><div>{links}</div></body>"
    got = html_text.main_text(page)
    assert got.count("\n") == 3 and got.endswith("Short.") and "link" not in got


@pytest.mark.parametrize("page", ["", "<", "<p", "</p>", "<!--", "<script>x", "&", "<p>&#0;&bogus;</p>", "<a <b>c", "<table><td>x", "</div></div>text", "<![CDATA[x]]>"])
def test_any_string_is_a_page(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract_edges(edge, nothing):
    got = html_text.extract(edge).collect()
    assert len(got) == len(ROWS) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[5] == texts[6] == "" and texts[9] == "deep" and texts[3] == "small"
    assert html_text.extract(nothing).count() == 0


def brute_text(html):
    """The article of a synthetic page, cut out by position."""
    import html as entities
    import re

    own = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", own)
    return "\n".join(x for x in (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)


def test_extract_equals_the_planted_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        assert r.text == brute_text(html[r.page_id])


def test_density_decides_without_names_and_semantic_elements(spark, sf, monkeypatch):
    """Planted articles in plain divs, with no word of class or id known: density finds most, and without it none is found."""
    monkeypatch.setattr(html_text, "WORDS", frozenset())
    pages = [r.html.replace("<article>", "<div>").replace("</article>", "</div>") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [brute_text(p.replace('<div class="ad">', '<ad>').replace("<div>", "<article>").replace("</div>", "</article>")) for p in [q.replace('</div>', '</ad>', 1) for q in pages]]
    assert sum(html_text.main_text(p) == w for p, w in zip(pages, want, strict=True)) >= 0.9 * len(pages)
    monkeypatch.setattr(html_text, "select", lambda root: root)
    assert sum(html_text.main_text(p) == w for p, w in zip(pages, want, strict=True)) == 0


def plain_densities(tree, path=()):
    """(tag, items) -> {path: (characters, tags, characters and tags of links)}, counted from the leaves up by recursion."""
    tag, items = tree
    found, c, t, lc, lt = {}, 0, 0, 0, 0
    c += sum(len("".join(x.split())) for x in items if isinstance(x, str))
    for i, x in enumerate(x for x in items if not isinstance(x, str)):
        below = plain_densities(x, (*path, i))
        found |= below
        kc, kt, klc, klt = below[(*path, i)]
        c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt
    if tag == "a":
        lc, lt = c, t + 1
    return found | {path: (c, t, lc, lt)}


def test_densities_equal_plain_recursion():
    import random
    from math import e, log

    rng = random.Random(3)

    def tree(depth):
        items = [rng.choice(["some text here", "x", " more  words of it "]) if depth == 0 or rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randint(0, 4))]
        return (rng.choice(["div", "section", "a", "b", "ul"]), items)

    def markup(node):
        return f"<{node[0]}>" + "".join(x if isinstance(x, str) else markup(x) for x in node[1]) + f"</{node[0]}>"

    for _ in range(60):
        root = ("div", [tree(3) for _ in range(3)])
        counts = plain_densities(root)
        share = counts[()][2] / counts[()][0] if counts[()][0] else 0.0
        top = html_text.parse(markup(root))
        html_text.measure(top)

        def check(node, path, counts=counts, share=share):
            c, t, lc, lt = counts[path]
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == (c, t, lc, lt)
            if c:
                inner = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0001)
                want = c / max(t, 1) * max(log(inner) / log(max(log(c / max(c - lc, 1) * lc + share * c + e), 1.0001)), 0)
                assert abs(node.density - want) < 1e-9 * max(1, want)
            for i, x in enumerate(x for x in node.items if isinstance(x, html_text.Node)):
                check(x, (*path, i))

        check(top.items[0].items[0], ())


def test_widening_takes_sections_and_drops_sparse_siblings():
    long = "A sentence of the article that goes on for a while. " * 5
    sections = "".join(f"<section><h2>Part {i}</h2><p>{long}</p><p>{long}</p></section>" for i in range(3))
    links = "<div>" + "".join(f'<span><a href="/{i}">go {i}</a></span> ' for i in range(9)) + "</div>"
    got = html_text.main_text(f"<body><div><h1>Title</h1>{links}{sections}</div></body>")
    assert got.count("sentence") == 30 and got.startswith("Title\nPart 0") and "go 1" not in got


def test_a_heading_above_the_text_comes_in_alone():
    long = "A sentence of the article that goes on for a while. " * 5
    page = f'<body><div><a href="/">home</a></div><div><h2>Post title</h2><div>By <a href="/a">Ann</a></div><div>{f"<p>{long}</p>" * 3}</div><div><a href="/t">tag</a></div></div></body>'
    assert html_text.main_text(page).split("\n") == ["Post title", *[long.strip()] * 3]


def test_an_article_keeps_its_title_and_lead():
    long = "A sentence of the article that goes on for a while. " * 5
    share = "<div>" + "".join(f'<span><a href="/{i}">to {i}</a></span> ' for i in range(5)) + "</div>"
    page = f'<body><div>{share}</div><article><h1>Title</h1><div>A lead.</div>{share}<div>{f"<p>{long}</p>" * 4}</div><div>The end.</div></article><div>Other matter, short.</div></body>'
    got = html_text.main_text(page)
    assert got.split("\n") == ["Title", "A lead.", *[long.strip()] * 4, "The end."]


@pytest.mark.parametrize("name", ["page no-sidebar", "header-fixed-wrap", "social-policy", "has-comments"])
def test_names_that_only_mention_a_word_cut_nothing(name):
    body = "<p>" + "A sentence of the article that goes on. " * 4 + "</p>"
    want = "\n".join([" ".join(("A sentence of the article that goes on. " * 4).split())] * 3)
    assert html_text.main_text(f'<body><div class="{name}">{body * 3}</div></body>') == want
    assert html_text.main_text(f'<body><div class="content widget"><article>{body * 3}</article></div></body>') == want
    assert html_text.main_text(f"<body><form><div>{body * 3}</div><input></form></body>") == want


def test_broken_tags_leave_no_markup():
    assert html_text.main_text('<p>Hello there <a title="x>link</a> end of it</p>') == "Hello there link end of it"
    assert html_text.main_text("<p>One <a href=/x/>link</a> two <b/>three<p/>four</p>") == "One link two three\nfour"
    assert html_text.main_text('<p class="a > b">text</p x="y"> after <') == "text\nafter <"


@pytest.mark.parametrize("page", ["<a " * 330_000 + '"', '<a b="' * 160_000, "<a b='c\" " * 100_000, "<h1>" * 200_000, "<b>" * 100_000 + "<li>x" * 100_000, "<!--" * 200_000, "<p><b>" * 100_000])
def test_a_broken_page_takes_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 6


# WARC


def test_round_trip_edges(edge, nothing):
    got = sorted(warc.round_trip(edge).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), key=str)
    want = []
    for page_id, _, html, *_ in ROWS:
        raw = (html or "").encode()
        last = max((i for i, _, h, *_ in ROWS if i is not None and h == html), default=None)
        again = len(raw) >= 1000 and page_id is not None and page_id < last
        want.append((page_id, len(raw), sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(nothing).count() == 0


def _archive(records, trained=b""):
    out = io.BytesIO()
    archive = warc.Archive(out, trained)
    for r in records:
        archive.add(r)
    return out.getvalue()


def _record(i=1, payload=b"<p>x</p>", **k):
    return warc.build(i, "http://x/", payload, sha1(payload).hexdigest(), len(payload), k.get("refers_to"), "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("trained", [b"", warc.dictionary([_record(i, b"<html>%d body</html>" % i * 30) for i in range(200)], 4096)])
@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_frames_are_read_whole(trained, chunk):
    records = [_record(i, b"z" * i) for i in range(20)] + [_record(30, b"z" * 50, refers_to=31)]
    raw = _archive(records, trained)
    if trained:
        assert struct.unpack("<II", raw[:8]) == (warc.SKIPPABLE, len(trained))
    assert list(warc.frames(io.BytesIO(raw), chunk)) == records
    packed = zstandard.ZstdCompressor().compress(trained)
    if trained:  # a compressed dictionary
        again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + raw[8 + len(trained) :]
        assert list(warc.frames(io.BytesIO(again), chunk)) == records


def test_damage_is_refused():
    raw = _archive([_record()])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError, match="no Zstandard frame"):
        list(warc.frames(io.BytesIO(raw + b"junkjunk")))
    record = _record()
    http = b"Content-Type: text/html; charset=utf-8\r\nContent-Length: 8"
    short = record.replace(http, b"Content-Type: text/html; charset=utf-8")
    block = short.split(b"\r\n\r\n", 1)[1][:-4]
    old = record.split(b"\r\n\r\n", 1)[1][:-4]
    short = short.replace(sha1(old).hexdigest().encode(), sha1(block).hexdigest().encode()).replace(b"Content-Length: %d\r\n\r\nHTTP" % len(old), b"Content-Length: %d\r\n\r\nHTTP" % len(block))
    with pytest.raises(ValueError, match="0 Content-Length lines"):
        warc.parse(short)
    for old, new, why in ((b"WARC/1.1", b"WARC/9", "not a"), (b"<p>x", b"<p>y", "digest"), (b"WARC-Date", b"WARC-Type", "header line"), (b"\r\n\r\n<p>", b"\r\n\r\n<p><b>", "block of"), (b"WARC-Record-ID: <urn:x-page:1>\r\n", b"", "no warc-record-id")):
        with pytest.raises(ValueError, match=why):
            warc.parse(record.replace(old, new))


# URLs


def test_hosts_paths_and_rules(edge):
    got = [r.asDict() for r in url_filter.judge(edge).collect()]
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], r)
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[2]["host"], by[2]["path"], by[2]["rule"], by[2]["verdict"]) == ("example.net", "/EN/", "net/", "block")
    assert (by[3]["rule"], by[3]["verdict"], by[4]["rule"]) == ("org/fr/", "allow", None)
    assert [(by[i]["host"], by[i]["path"], by[i]["verdict"]) for i in (5, 6, 7)] == [("", "", "block")] * 3
    assert (by[8]["host"], by[8]["path"], by[8]["rule"]) == ("user@x.example.com:80", "/de/\n", None)
    assert (by[9]["host"], by[9]["rule"]) == ("日本.org", "org/fr/")
    assert sum(r["page_id"] == 8 for r in got) == 2


def test_models_tell_urls_apart(spark, nothing):
    rows = [(i, f"http://good{i}.example.net/en/garden-flowers-{i}") for i in range(40)] + [(100 + i, f"http://bad{i}.example.com/de/xxqqzz{i}") for i in range(40)]
    rows += [(200 + i, f"http://garden-flowers{i}.example.info/") for i in range(10)] + [(300 + i, f"http://xxqqzz{i}.example.info/") for i in range(10)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[i] == ("allow" if i < 100 or 200 <= i < 300 else "block") for i in got)
    assert url_filter.judge(nothing).count() == 0


def test_url_models_run_without_python(spark, sf):
    out = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
