"""The token stream against a plain parser; nested, void, unclosed and quoted cases; entities."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

from tessitura.sources import html as H

CASES = [
    "<p>one<br>two</p>",
    "<nav>a<nav>b</nav>c</nav>d<nav>e</nav>",
    "<div data-lyrics-container=\"true\"><div>Head</div>one<br>two</div><div>no</div><span Data-Lyrics-Container='true'>x <b>y</b></span>",
    "</nav>kept</nav><nav>gone</nav> also &amp; &#1078;&#x1F600;&eacute;&unknown; &#0;&#1114112; 3 < 4 &",
    '<a title="x > y">t</a><!-- <nav> --><footer>f<p>g</footer>h<img src="a"/>i<aside>never closed',
    "<script>var a = '<nav>';</script><style>p{}</style>text\n  more <header>x</header> ",
    '<div data-lyrics-container="true">3 Contributors<br>Song Lyrics<br>about Read More first</div><div data-lyrics-container="true">second Lyrics\nline</div>',
    '<div data-lyrics-container="true">Contributors Lyrics\n</div><div data-lyrics-container="true">Lyrics\n Read More </div><div data-lyrics-container="true">kept</div>',
    "", "plain", "<div><div><div>deep</div></div>", "<p/>a<br/>b", "1 < 2 " * 4000, "<a " + "b" * 20_000,
]


class Texts(HTMLParser):
    """Texts outside dropped elements: a counter for each tag."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.out, self.node = dict.fromkeys(H.DROPPED, 0), [], ""

    def end_node(self):
        if self.node:
            self.out.append(self.node)
        self.node = ""

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag in self.open:
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if self.open.get(tag):
            self.open[tag] -= 1

    def handle_comment(self, data):
        self.end_node()

    def handle_data(self, data):
        if not any(self.open.values()):
            self.node += data

    def known(self, name, whole):
        self.handle_data(unescape(whole) if name.startswith("#") or name in H.ENTITIES else whole)

    def handle_entityref(self, name):
        self.known(name, f"&{name};")

    def handle_charref(self, name):
        n = int(name[1:], 16) if name[0] in "xX" else int(name)
        self.handle_data(chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else f"&#{name};")


def plain(page):
    p = Texts()
    p.feed(page)
    p.close()
    p.end_node()
    return "\n".join(x for x in (t.strip() for t in p.out) if x)


def frame(spark, pages, type_="text/html; charset=utf-8"):
    return spark.createDataFrame([(k, p, type_) for k, p in enumerate(pages)], "id long, html string, content_type string")


def test_texts_equal_a_plain_parser(spark):
    pages = CASES + [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = {r["id"]: r["text"] for r in H.page_texts(frame(spark, pages), limit=10**6).collect()}
    for k, page in enumerate(pages):
        assert got[k] == plain(page), page
    assert got[3] == "kept\nalso & ж😀é&unknown; &#0;&#1114112; 3 < 4 &"


def test_content_types_and_limit(spark):
    rows = [(1, "<p>abcdef", "text/html"), (2, "<p>x", "application/pdf"), (3, "<p>x", None), (4, None, "application/xhtml+xml")]
    got = {r["id"]: (r["text"], r["error"]) for r in H.page_texts(spark.createDataFrame(rows, "id long, html string, content_type string"), limit=3, marker="!").collect()}
    assert got == {1: ("abc!", None), 2: (None, "Unsupported content-type: application/pdf"), 3: (None, "Unsupported content-type: unknown"), 4: ("", None)}


def test_lyrics_containers(spark):
    got = {r["id"]: r["text"] for r in H.lyrics_containers(frame(spark, CASES).drop("content_type")).collect()}
    assert got[2] == "Head\none\n\n\ntwo\nx \ny"
    assert got[6] == "first\nsecond Lyrics\nline"
    assert got[7] == "kept"
    assert got[0] == got[8] == ""


def test_ranges_of_nested_elements(spark):
    rows = H.tokens(frame(spark, ["<b><i><b>x</b></i></b></b><b>y"]))
    assert sorted((r["tag"], r["start"], r["end"]) for r in H.elements(rows).collect()) == [("b", 0, 6), ("b", 2, 4), ("b", 8, None), ("i", 1, 5)]


def test_a_long_page_of_many_elements(spark):
    page = "<div>" * 3000 + "deep" + "</div>" * 3000 + "<nav>" * 2000 + "gone" + "</nav>" * 2000 + "end"
    assert H.page_texts(frame(spark, [page])).first()["text"] == "deep\nend"
