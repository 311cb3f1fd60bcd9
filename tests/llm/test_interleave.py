import base64
import hashlib
import re
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from gridloom.llm.interleave import interleave, parse

PAGE = """<html><head><title>t</title></head><body><nav>menu</nav><h1>Head &amp; one</h1><p>a<b>b</b> c<img src="/i.png" alt="al"> d
<figure><img src='x.jpg' alt=z><figcaption>Cap <i>one</i></figcaption></figure><p>after
<figure><figcaption>Before</figcaption><img src="data:image/png;base64,AAAA"></figure>
<video><source src="v.mp4"><source src="v.webm"></video><picture><source srcset="a.webp 1x"><img src="a.png"></picture>
<figure>just text<figcaption>only</figcaption></figure>tail <img> <script>var t="</p><img src=no.png>"</script><!-- <img src=no2.png> --></body>"""


def test_order_captions_and_positions():
    got = [(i["kind"], i["text"], i["url"]) for i in parse(PAGE, "http://e.com/a/b")]
    assert got == [
        ("text", "Head & one", None),
        ("text", "ab c", None),
        ("image", "al", "http://e.com/i.png"),
        ("text", "d", None),
        ("image", "Cap one", "http://e.com/a/x.jpg"),
        ("text", "after", None),
        ("image", "Before", None),
        ("video", None, "http://e.com/a/v.mp4"),
        ("image", None, "http://e.com/a/a.png"),
        ("text", "just text", None),
        ("text", "only", None),
        ("text", "tail", None),
    ]


def test_broken_pages_do_not_raise():
    for page in (None, "", "<", "<p", "<img src=\"", "</figure></figcaption>", "<figcaption>x", "<figure><figcaption>a<figure><img src=b>", "<script>never closed", "<!-- open", "<a b='c\"d'>" * 2000, "<div>" * 5000 + "deep"):
        parse(page, None)


def test_payloads_meet_their_references(spark):
    logo = "http://e.com/logo.png"
    raw = b"\x01\x02\x03"
    pages = spark.createDataFrame(
        [
            (1, "http://e.com/p", f'<p>one<img src="{logo}" alt="L"><p>two<img src="/gone.png" alt="G">'),
            (2, "http://e.com/q", f'<img src="/logo.png"><p>x<img src="data:image/gif;base64,{base64.b64encode(raw).decode()}">'),
            (2, "http://e.com/q", f'<img src="/logo.png"><p>x<img src="data:image/gif;base64,{base64.b64encode(raw).decode()}">'),
            (3, None, "<p>no media"),
            (None, None, None),
        ],
        "page_id long, url string, html string",
    )
    digest = hashlib.sha256(logo.encode()).hexdigest()
    media = spark.createDataFrame([(digest, "image/png", b"zz"), (digest, "image/png", b"aa"), (None, "x", b"q"), ("other", None, None)], "digest string, mime string, payload binary")
    rows = interleave(pages, media).collect()
    assert len(rows) == 5
    for r in rows:
        assert r.n_items == len(r.texts) == len(r.media) == len(r.captions)
        assert all((t is None) != (m is None) for t, m in zip(r.texts, r.media, strict=True))
    one = next(r for r in rows if r.page_id == 1)
    assert one.texts == ["one", None, "two", None]
    assert [m and (m.resolved, m.payload and bytes(m.payload)) for m in one.media] == [None, (True, b"aa"), None, (False, None)]
    assert one.captions == [None, "L", None, "G"]
    twos = [r for r in rows if r.page_id == 2]
    assert len(twos) == 2
    assert all(bytes(r.media[2].payload) == raw and r.media[2].mime == "image/gif" and r.media[0].resolved for r in twos)


def test_awkward(spark):
    long = "<p>" + "w " * 200_000
    df = spark.createDataFrame([(1, None, long, "x"), (1, "u", "", "x"), (1, "u", "", "x")], "page_id long, url string, html string, items string")
    assert sorted(r.n_items for r in interleave(df).collect()) == [0, 0, 1]
    assert interleave(df.limit(0)).count() == 0


def test_whole_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.texts for r in interleave(pages).collect()}
    for r in pages.limit(20).collect():
        assert got[r.page_id] == [i["text"] for i in parse(r.html, r.url)]
        assert not any("track(" in t for t in got[r.page_id])


class Plain(HTMLParser):
    """The same sequence by the standard library's parser, for pages whose tags are well nested: (text,) and (kind, url, caption)."""

    BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td textarea tfoot th thead title tr ul".split())
    LEFT_OUT = {"script", "style", "template", "noscript", "head", "nav", "footer", "iframe", "svg"}

    def __init__(self, url):
        super().__init__(convert_charrefs=True)
        self.url, self.out, self.text, self.skip = url, [], "", []

    def end_text(self):
        if t := " ".join(self.text.split()):
            self.out.append((t,))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.LEFT_OUT:
            self.skip.append(tag)
            self.text += " "
        if self.skip:
            return
        if tag in ("img", "video", "audio", "embed"):
            self.end_text()
            a = {}
            for k, v in attrs:
                a.setdefault(k, v or "")
            if src := (a.get("src") or a.get("data-src") or a.get("srcset", "").strip().split(" ")[0]).strip():
                self.out.append(({"img": "image"}.get(tag, tag), None if src.startswith("data:") else urljoin(self.url or "", src), (a.get("alt") or a.get("title") or "").strip() or None))
        elif tag in self.BLOCK:
            self.end_text()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag in self.BLOCK:
            self.end_text()

    def handle_comment(self, data):
        self.text += " "

    def handle_data(self, data):
        if not self.skip:
            self.text += data


def test_whole_query_against_the_parser_of_the_standard_library(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in interleave(pages).collect()}
    rows = [r for r in pages.collect() if not re.search("<fig|<picture|<source", r.html)]
    assert len(got) == pages.count()
    assert len(rows) > 20
    for r in rows:
        plain = Plain(r.url)
        plain.feed(r.html)
        plain.close()
        plain.end_text()
        own = got[r.page_id]
        assert own.n_items == len(own.texts) == len(own.media) == len(own.captions)
        assert [(t,) if m is None else (m.kind, m.url, c) for t, m, c in zip(own.texts, own.media, own.captions, strict=True)] == plain.out


@pytest.mark.parametrize("unit", ["<svg>x ", "<nav a=b>", "<a b=\"", "<a 'x", "<!x ", "<", "<p>x<figure><figcaption>c", "<figure><img src=a><figcaption>x</figcaption>", "<!-- ", "<script>", "&amp", "<img src=a>"])
def test_time_grows_with_the_page(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    parse(page, "http://e.com/")
    assert time.process_time() - began < 8


def test_row_named_columns(spark):
    df = spark.createDataFrame([(1, "http://e.com", "<img src=a.png alt=x>", 5, "q", "z")], "page_id int, url string, html string, row int, digest string, found string")
    (r,) = interleave(df).collect()
    assert (r.page_id, r.captions, r.media[0].url) == (1, ["x"], "http://e.com/a.png")
