import base64
import hashlib
import time

from varloom.llm import warc

PAGE = "<!DOCTYPE html><html lang='de'><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><h1>Hello</h1><p>one&nbsp;two<br>three <a href='/x'>link</a></p><!-- gone --></body></html>"


def derived(spark, rows):
    return warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, block string")))


def test_text_and_links(spark):
    rows = {r.warc_type: r for r in derived(spark, [(1, "http://a.org/x", PAGE, "clash")]).collect()}
    conv, meta = rows["conversion"], rows["metadata"]
    assert conv.block == "Hello\none two\nthree link"
    assert "title: A & B" in meta.block and "language: de" in meta.block and "outlinks: 1" in meta.block
    r = warc.responses(spark.createDataFrame([(1, "http://a.org/x", PAGE)], "page_id long, url string, html string")).first()
    body = PAGE.encode()
    assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == conv.source_payload_digest == meta.source_payload_digest
    assert {conv.refers_to, meta.refers_to} == {r.record_id} and conv.record_id != meta.record_id and conv.refers_to_uri == "http://a.org/x" and conv.refers_to_date == r.warc_date
    assert conv.source_head.endswith(f"Content-Length: {len(body)}\r\n\r\n")


def test_edges(spark):
    rows = [(1, None, None, "")] * 2 + [(None, "u", "", ""), (2, "u", "<p>" + "x " * 300_000, ""), (3, "u", "a < b <unclosed", "")]
    got = derived(spark, rows).collect()
    assert len(got) == 10 and len({r.record_id for r in got if r.page_id == 1}) == 2
    conv = {(r.page_id, r.content_length): r.block for r in got if r.warc_type == "conversion"}
    assert conv[1, 0] == "" and conv[None, 0] == "" and len(conv[2, 599_999]) == 599_999
    assert any(k == 3 and b == "a < b" for (k, _), b in conv.items())
    assert derived(spark, []).count() == 0


def test_round_trip(spark):
    d = derived(spark, [(1, "http://a.org/x", PAGE, ""), (2, "http://b.org/ü", "", "")])
    data = b"".join(bytes(r.data) for r in warc.serialise(d).collect())
    got = {h["WARC-Record-ID"]: (h, b) for h, b in warc.parse(data)}
    for r in d.collect():
        h, b = got[r.record_id]
        assert b == r.block.encode() and h["WARC-Type"] == r.warc_type and h["WARC-Refers-To"] == r.refers_to and h["WARC-Block-Digest"] == warc.digest(b)


def test_open_marks_take_linear_time():
    for mark in ("<a ", "<title>", "<head ", "<p ", "<html ", "<a href", "<script>", "<!--", "</head ", "<title", "&#", "href ", "<"):
        start = time.monotonic()
        warc.plain_text(mark * 100_000), warc.facts(mark * 100_000)
        assert time.monotonic() - start < 5, mark


def test_marks_of_all_kinds():
    page = "<HTML Lang=PT-br><HEAD ><title\nid=x> T&#x41; </TITLE ></HEAD\n><header>top</header><A class=y\nhref = z>l</a><!-- <a href=q> --><b>bold</b><p\n>x<br/>y &#0000000065; &#" + "9" * 6000 + ";<a name=n>"
    assert warc.facts(page) == [("title", "TA"), ("language", "pt-br"), ("outlinks", "1"), ("charset", "utf-8")]
    assert warc.plain_text(page) == "top\nl bold\nx\ny A \ufffd"
    assert warc.plain_text("<head>open <p>text") == "open\ntext" and warc.facts("") == [("outlinks", "0"), ("charset", "utf-8")]


def test_quoted_values_and_their_marks():
    assert warc.plain_text('x<img alt="a > b" src=q>y') == "xy"
    assert warc.plain_text("<p title='</p><!-- '>one</p><a title=\"<script>\">two</a>") == "one\ntwo"
    assert warc.plain_text('a <b c="1>2> open') == "a" and warc.plain_text("i < 3 > j <3") == "i < 3 > j <3"
    assert warc.plain_text("<script data-x='</div>'>if (a > b) {}</script >text<script-x>own</script-x>") == "textown"
    page = "<html data-lang=xx lang = 'De'><a title='href = >'>no</a><a data-href=x>no</a><a HREF>yes</a><a\nhref='x>y'>yes</a><!-- <a href=q> --><title>a <b> c</title>"
    assert warc.facts(page) == [("title", "a <b> c"), ("language", "de"), ("outlinks", "2"), ("charset", "utf-8")]


def test_text_of_built_pages_is_that_of_the_standard_parser():
    """The standard library's event parser reads the same text and links of well-formed pages of random parts."""
    import random
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.text, self.links, self.deep = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.deep += tag in ("script", "style", "head")
            self.links += tag == "a" and any(k == "href" for k, _ in attrs)
            self.text.append("\n" if tag in ("p", "br", "div", "li") else " " if tag in ("script", "style", "head") else "")

        def handle_endtag(self, tag):
            self.deep -= tag in ("script", "style", "head")
            self.text.append("\n" if tag in ("p", "div", "li") else "")

        def handle_data(self, data):
            if not self.deep:
                self.text.append(data)

        def handle_comment(self, data):
            self.text.append(" ")

    rng = random.Random(7)
    parts = ["<p class='a > b'>", "</p>", "<br>", '<a href="x?y=1&amp;z">', "</a>", "<a name=k>", "word ", "two &amp; three", "&lt;b&gt;", "<!-- <p> -->", "<script>var a = '<p>';</script>", "<style>p > a {}</style>", "<div\n id = \"q'\">", "</div>", "<img alt='\"' src=u>", " \n "]
    for _ in range(400):
        page = "<html><head><title>t</title></head><body>" + "".join(rng.choices(parts, k=rng.randrange(1, 40))) + "</body></html>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = (" ".join(x.split(" ")).strip() for x in "".join(reader.text).split("\n"))
        want = "\n".join(y for x in lines if (y := " ".join(x.split())))
        assert warc.plain_text(page) == want, page
        assert ("outlinks", str(reader.links)) in warc.facts(page), page


def test_urls_cannot_add_headers_and_source_heads_return(spark):
    rows = [(1, "http://a/\r\nWARC-Type: x", "<p>1", ""), (2, "http://a/\r\n\r\nb c\x00", "<p>2", ""), (2**53 + 1, "http://a/", "", ""), (None, "u", "", "")]
    d = derived(spark, rows)
    got = d.collect()
    assert {r.page_id for r in got} == {1, 2, 2**53 + 1, None}
    data = b"".join(bytes(r.data) for r in warc.serialise(d).collect())
    read = {h["WARC-Record-ID"]: (h, b) for h, b in warc.parse(data)}
    assert len(read) == 8
    for r in got:
        h, block = read[r.record_id]
        assert h["WARC-Type"] == r.warc_type and h["WARC-Target-URI"] == r.target_uri and block == r.block.encode()
        assert warc.source_head_of(h) == r.source_head and h["WARC-Source-Block-Digest"] == r.source_block_digest
    assert {r.target_uri for r in got} == {"http://a/%0D%0AWARC-Type:%20x", "http://a/%0D%0A%0D%0Ab%20c%00", "http://a/", "u"}
    alone = derived(spark, rows[:1]).collect()
    assert {r.record_id for r in alone} == {r.record_id for r in got if r.page_id == 1}, "ids don't depend on the rows beside"


def test_open_quotes_take_linear_time():
    for mark in ('<a x="', "<a x='", "<a x= ", "<a \" ", "<a x", '="', "<a x='\"", "<!--<a x=\"", "<script x='", "<head x=\"></head x='>"):
        start = time.monotonic()
        warc.plain_text(mark * 100_000), warc.facts(mark * 100_000)
        assert time.monotonic() - start < 5, mark
