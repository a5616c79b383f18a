"""Archives and extraction."""

import base64
import gzip
import hashlib
import time

import pytest

from cohortry.llm import extraction, warc
from cohortry.llm.warc import Reader, file_system


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "long text " * 60_000 + "</p>"
    html = ["same", "same", None, "", "été ▁ \r\n\r\n", "same", big, big, "WARC/1.1\r\n\r\n"]
    schema = "page_id long, url string, html string, path string, sha1 string, size string"
    return spark.createDataFrame([(i, None if i == 3 else f"http://h/{i} x\n", h, "p", "s", "z") for i, h in enumerate(html)], schema).repartition(3)


def expected(pages, least):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    out = {}
    for i, body in rows:
        top = max(j for j, b in rows if b == body)
        whole = len(body) < least or top == i
        out[i] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if whole else "revisit", None if whole else top)
    return out


@pytest.mark.parametrize("least", [0, 3, 100])
def test_round_trip(pages, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    manifest = warc.write(pages, least=least)
    back = warc.read(manifest, with_payload=True).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back} == expected(pages, least)
    bodies = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == bodies[r.page_id] and r.verified for r in back if r.record_type == "response")
    assert all(r.payload is None for r in back if r.record_type == "revisit")
    assert manifest.selectExpr("sum(records)").first()[0] == len(back)


def test_members_and_framing(pages):
    path = warc.write(pages).first().path
    files, name = file_system(path)
    raw = files.open_input_stream(name, compression=None).read()
    whole = gzip.decompress(raw)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.endswith(b"\r\n\r\n")
    for piece in (1, 7, 1 << 16):  # however the bytes come
        class Stream:
            at = 0

            def read(self, n):
                got, self.at = raw[self.at: self.at + piece], self.at + piece
                return got
        assert len(list(Reader(Stream()))) == len(list(Reader(files.open_input_stream(name, compression=None))))


def test_damage_shows(pages):
    path = warc.write(pages.where("page_id = 6")).where("records > 0").first().path
    files, name = file_system(path)
    raw = files.open_input_stream(name, compression=None).read()

    def stream(data):
        import io

        return io.BytesIO(data)

    with pytest.raises(ValueError, match="within"):
        list(Reader(stream(raw[:-20])))
    records = list(Reader(stream(raw)))
    member = warc.page_record(1, None, b"other", 5, hashlib.sha1(b"told").hexdigest(), None, "2000-01-01T00:00:00Z")
    wrong = list(Reader(stream(raw + member)))[-1]
    assert len(records) == 2 and wrong.sha1 != wrong.fields["warc-payload-digest"].removeprefix("sha1:")


def test_archives_lie_where_spark_reads(spark, pages):
    from cohortry import session

    assert warc.qualified(spark, "/shared/x") == "file:///shared/x" and warc.qualified(spark, "file:/shared/x") == "file:///shared/x"
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.defaultFS", "viewfs://store/")
    try:
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./shared", "file:///tmp")
        assert warc.qualified(spark, "/shared/x") == "viewfs://store/shared/x"
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.defaultFS", "file:///")
    with session.scratch(spark):
        path = warc.write(pages).first().path
        files, name = file_system(path)
        assert path.startswith("file:///") and files.get_file_info(name).is_file
    assert not files.get_file_info(name).is_file


def test_no_pages(pages):
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    assert extraction.extract(pages.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.read(warc.write(table)).count() == 4
    assert extraction.extract(table).count() == 4


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy &amp; win.</div><div id="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p><b>First   bold<br>line.<p>Second&nbsp;para <a href=x>link</a></p>
<ul><li>one<li>two</ul><form>Sign up<input></form><aside>Side</aside><blockquote>quoted</blockquote>loose text</article>
<section class="comments"><p>A reader writes a very long comment, longer than the article itself, again and again and again.</p></section>
<footer>&copy; foot</footer></body></html>"""


def test_page():
    want = "Title & more\nFirst bold line.\nSecond para link\none\ntwo\nquoted\nloose text"
    assert extraction.extract_page(PAGE) == want
    assert extraction.extract_page(PAGE, "html/body/article") == want
    assert extraction.extract_page(PAGE, "html/body/div.elsewhere") == want


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>a</p><div cla", "a"), ("x < y &lt; z &#233;&eacute; &unknown;", "x < y < z éé &unknown;"),
    ("<div><p>a <b>b</b>c</p>d</div>", "a bc\nd"), ("<p>kept</p><!-- open <p>not</p>", "kept"), ("<P CLASS='x'>up</P>", "up"), ("</p></div>end", "end"),
    ("<div hidden><p>no</p></div><div><p>yes</p></div>", "yes"), ("<script>if (a<b) {}</script>", ""), ("<textarea>no", ""),
    ("<table><tr><td>a<td>b</table>", "a\nb"), ("<div>" * 3000 + "deep", "deep")])
def test_odd_pages(html, text):
    assert extraction.extract_page(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<article><h1>T</h1><div class=lead><p>lead</p></div><div class=body><p>the longest part</p></div></article>", "T\nlead\nthe longest part"),
    ("<body><section id=intro><p>first</p></section><section id=methods><p>the second</p></section></body>", "first\nthe second"),
    ("<main><h1>T</h1><section class=a><p>one</p><section class=b><p>two and more</p></section></section><p>end</p></main>", "T\none\ntwo and more\nend"),
    ("<article><h1>T</h1><p>in</p><ul><li>a long item</li><li>another long item</li></ul><p>out</p></article>", "T\nin\na long item\nanother long item\nout"),
    ("<article><p>in</p><table><tr><td>a long cell</td><td>another cell</td></tr></table></article>", "in\na long cell\nanother cell"),
    ("<body><h1>T</h1><ul><li>a long item</li><li>another</li></ul></body>", "T\na long item\nanother"),
    ("<div class=page><div class=lead><p>lead</p></div><div class=text><p>the longest part</p></div><div class=sidebar>no</div></div>", "lead\nthe longest part"),
    ("<div><p>wrapper text</p><main><div class=x><p>one</p></div><div class=y><p>two and more</p></div></main></div>", "one\ntwo and more"),
    ("<body><h1>T</h1><table><tr><td><div class=x>one</div><td><div class=y>two and more</div></table></body>", "T\none\ntwo and more"),
    ("<article><div class=x><p>one</p></div><nav>no</nav><aside>no</aside><div class=y><p>two</p></div></article>", "one\ntwo")])
def test_whole_article(html, text):
    assert extraction.extract_page(html) == text
    assert extraction.extract_page(html, extraction.best(extraction.parse(html))[0]) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<body><h1>Title</h1><p>lead</p><div class=content><p>the text of it</p></div></body>", "Title\nlead\nthe text of it"),
    ("<body><div class=lead><p>lead</p></div><div class=rest><p>the rest of it</p></div></body>", "lead\nthe rest of it"),
    ("<body><section class=a><p>one</p></section><section class=b><p>two and more</p></section></body>", "one\ntwo and more"),
    ("<body><article class=a><p>one</p></article><div><p>between</p></div><article class=b><p>two and more</p></article></body>", "one\ntwo and more"),
    ("<body><div><div class=hero><h1>T</h1></div><article><p>the text</p></article></div></body>", "T\nthe text"),
    ("<body><div class=hero><h1>Site</h1></div><article><h1>T</h1><p>the text</p></article></body>", "T\nthe text"),
    ("<body><div><a href=x>only a link</a></div><div class=rest><p>the text</p></div></body>", "the text")])
def test_all_parts_of_the_article(html, text):
    assert extraction.extract_page(html) == text


@pytest.mark.parametrize("attributes", ['title="the hidden gem"', 'data-note="a hidden b"', "hidden-x=1", 'aria-label="id hidden"', 'data-k="x class=ad"', "title='class=\"ad\"'",
                                        'alt="a > b" lang=en', "data-hidden", 'x = "1" y', "/", '="hidden"'])
def test_values_are_no_attributes(attributes):
    assert extraction.extract_page(f"<body><article><p>before</p><p {attributes}>in</p><p>after</p></article></body>") == "before\nin\nafter"


@pytest.mark.parametrize("attributes", ["hidden", "class=ad", "id='sidebar'", 'title="x" class="box ad"', "role=navigation", 'x="1"hidden', "HIDDEN=''", 'class = "ad"'])
def test_attributes_that_leave_out(attributes):
    assert extraction.extract_page(f"<body><article><p>before</p><div {attributes}>in</div><p>after</p></article></body>") == "before\nafter"


@pytest.mark.parametrize("html", ["<a " * 300_000, '<a "' * 250_000, "<a title='" * 100_000, '<p x="">' * 100_000, "<div class=sidebar>" * 50_000 + "<h1>T</h1>text", "<div>" * 200_000 + "deep",
                                  "<div class='a b'>" * 60_000 + "deep", "<!--" * 200_000, "<!-- -->" * 100_000, "</p>" * 250_000, "<p>x" * 200_000, "&amp" * 200_000, "<script>" * 100_000,
                                  "<ul><li>" * 100_000, "<svg>" * 200_000, "<table><tr><td>" * 60_000])
def test_a_million_hostile_characters(html):
    begin = time.process_time()
    extraction.extract_page(html)
    assert time.process_time() - begin < 10


def test_strips_around_articles_are_voted_out(spark):
    """What most pages of a host repeat isn't the article; copies of one page vote once."""
    def page(k, lead):
        return f"<body><div class=strip><p>The daily paper of the town</p></div><div class=lead><p>{lead}</p></div><div class=rest><p>{f'story {k} goes on ' * 9}</p></div></body>"

    rows = [(i, "http://h/", page(i, f"lead {i}")) for i in range(8)] + [(i, "http://copies/", page(0, "the lead")) for i in range(20, 30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extraction.extract(table).collect()}
    assert all(got[i] == f"lead {i}\n" + (f"story {i} goes on " * 9).strip() for i in range(8))
    assert all(got[i].split("\n")[1] == "the lead" for i in range(20, 30))


@pytest.mark.parametrize("open_tag", ["<svg class=i />", "<svg/>", "<math/>", "<object data=x />", "<button>", "<select>", "<canvas id=c>", "<iframe src=x />", "<video>",
                                      "<div><button></div>", "<div><select><option></div>", "<!-- </svg> --><svg>"])
@pytest.mark.parametrize("later", ["", "<svg><text>no</text></svg>", "<button><b>no</b></button>", "<select><option>no</select><canvas>no</canvas>"])
def test_no_end_tag(open_tag, later):
    page = f"<body><article><p>before</p>{open_tag}<p>after</p>{later}<p>end</p></article></body>"
    assert extraction.extract_page(page) == "before\nafter\nend"


def test_skipped_elements():
    html = "<article>a<svg><title>no</title><svg/><g><svg>no</svg></g>no</svg><noscript><div>no</div></noscript><object><object>no</object>no</object>b</article>"
    assert extraction.extract_page(html) == "ab"
    assert extraction.extract_page("<button>" * 20_000 + "<svg>" * 20_000 + "end") == "end"


@pytest.mark.parametrize("names", ["class='content with-sidebar'", "class='post has-comments'", "class='entry-content no-share'", "class='layout sidebar-right'",
                                   "id=header-page", "class='page-widgets x'"])
def test_names_of_what_holds_the_article(names):
    page = f"<body><div {names}><h1>T</h1><p>the text of the article</p><div class=sidebar>no</div></div><div class=cookie-notice>we use cookies</div></body>"
    assert extraction.extract_page(page) == "T\nthe text of the article"


def test_names_of_what_does_not():
    comments = "<section class=comments><h1>Comments</h1><p>" + "longer than the article " * 9 + "</p></section>"
    page = f"<body><div class=text><p>the text</p></div><div class='box cookie-notice'>{'cookies ' * 30}</div><div class=site-header><h1>S</h1></div>{comments}</body>"
    assert extraction.extract_page(page) == "the text"


def test_host_decides(spark):
    """A page on which a sidebar is larger than the article gets the container of its host."""
    def page(article, side):
        return f"<body><div class='text-{len(article)}'><p>{article}</p></div><div class='extra'><p>{side}</p></div></body>"

    rows = [(i, "http://h.example/a", page(f"the article goes on {i} " * 20, "short")) for i in range(6)]
    rows += [(6, "http://H.example:80/b", page("brief", "a long sidebar " * 30)), (7, "http://other.example/", page("brief", "a long sidebar " * 30)), (8, None, None)]
    table = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    got = {r.page_id: r.text for r in extraction.extract(table).collect()}
    assert got[6] == "brief" and got[7].startswith("brief\na long sidebar") and got[8] == "" and got[0].startswith("the article")
    won = {r.host: (r.path, r.pages) for r in extraction.host_paths(table).collect()}
    assert won["h.example"] == ("body/div.text", 7)
    assert {r.host: r.out for r in extraction.host_paths(table).collect()} == {"h.example": ["body/div.extra"], "other.example": [], "": []}
