import glob
import gzip
import json
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from clausefold.llm import warc

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B
c</title><meta name="d" content="x > y"><script>var t="</p>"; if (a<b) {}</script><style>p{}</style></head>
<body><nav><a href="/rel?q=1&amp;r">Link</a></nav><!-- <p>no</p> --><p>One&nbsp;two <b>bold</b>text</p>line<br/>next
<img alt='a>b' src=pic.png><noscript>hidden</noscript><p>a < b, 3 &lt; 4 <unclosed "x</body></html>"""


def rows(spark, data, schema="page_id bigint, url string, html string"):
    return warc.derivative_digest(spark.createDataFrame(data, schema)).collect()


def test_page_text_and_metadata():
    text, about = warc.read_page(PAGE, "http://h.org/dir/p")
    assert text == 'Link\nOne two boldtext\nline\nnext\na < b, 3 < 4 <unclosed "x'
    assert about["title"] == "A & B c" and about["language"] == "fr"
    assert about["links"] == [{"path": "a@/href", "url": "http://h.org/rel?q=1&r"}, {"path": "img@/src", "url": "http://h.org/dir/pic.png"}]
    assert about["metas"] == [{"name": "d", "content": "x > y"}]


def test_records_link_to_the_response_and_digests_hold(spark):
    got = rows(spark, [(1, "http://h.org/p", PAGE), (1, "http://h.org/p", PAGE)])
    assert [r["warc_type"] for r in got] == ["metadata", "conversion"] * 2 and got[:2] == got[2:]
    source, payload = warc.parse(warc.response_record("1", "http://h.org/p", PAGE))
    named = dict(source)
    assert payload.partition(b"\r\n\r\n")[2].decode() == PAGE
    for r in got[:2]:
        headers, block = warc.parse(r["record"])
        own = dict(headers)
        assert own["WARC-Refers-To"] == r["refers_to"] == named["WARC-Record-ID"]
        assert own["WARC-Record-ID"] == r["record_id"] != named["WARC-Record-ID"]
        assert own["WARC-Target-URI"] == r["target_uri"] == "http://h.org/p"
        assert own["WARC-Block-Digest"] == r["block_digest"] == warc.digest(block)
        assert r["source_digest"] == named["WARC-Payload-Digest"] == warc.digest(PAGE.encode())
        assert int(own["Content-Length"]) == r["block_length"] == len(block)
    meta = json.loads(warc.parse(got[0]["record"])[1])
    assert meta["source_headers"] == [list(h) for h in source] and meta["payload"]["digest_matches"]
    assert meta["http"]["status"] == "HTTP/1.1 200 OK"


def test_nulls_empty_long_broken_and_other_types(spark):
    got = rows(spark, [(None, None, None), (2, "u\r\nX: y", ""), (3, "u", "<p>" * 50000 + "end"), (4, "u", "<" * 20000), (5, "u", "<script>x")])
    assert len(got) == 10
    text = {r["page_id"]: warc.parse(r["record"])[1].decode() for r in got if r["warc_type"] == "conversion"}
    assert text[None] == "" and text[2] == "" and text[3] == "end" and text[4] == "<" * 20000 and text[5] == ""
    assert "\nX: y" not in next(r["record"] for r in got if r["page_id"] == 2)
    assert rows(spark, []) == []
    others = spark.createDataFrame([(1, warc.build([("WARC-Type", "request")], b"x"), 5), (2, None, 6), (3, "junk", 7)], "page_id int, record string, record_id int")
    assert warc.derive(others).count() == 0


def test_wrong_digest_is_told(spark):
    broken = warc.response_record("1", "u", "<p>x</p>").replace("<p>x", "<p>y")
    got = warc.derive(spark.createDataFrame([(1, broken)], "page_id bigint, record string")).collect()
    assert json.loads(warc.parse(got[0]["record"])[1])["payload"]["digest_matches"] is False


def test_files_hold_the_records(spark, tmp_dir):
    made = warc.derivative_digest(spark.createDataFrame([(i, f"u{i}", PAGE) for i in range(5)], "page_id bigint, url string, html string"))
    warc.write_files(made, f"{tmp_dir}/w")
    text = "".join(gzip.open(f, "rt", newline="").read() for f in glob.glob(f"{tmp_dir}/w/*.gz"))
    assert text.count("WARC/1.1") == 10
    assert all(r["record"] + warc.RECORD_END in text for r in made.collect())


def test_repeated_headers_and_their_order_stay():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nLink: <x>\r\nSet-Cookie: b=2\r\n\r\n<p>x"
    record = warc.build([("WARC-Type", "response"), ("WARC-Concurrent-To", "<1>"), ("WARC-Record-ID", "<r>"), ("WARC-Concurrent-To", "<2>")], http)
    meta = json.loads(warc.parse(warc.derivatives(record)[0]["record"])[1])
    assert meta["source_headers"][1:4] == [["WARC-Concurrent-To", "<1>"], ["WARC-Record-ID", "<r>"], ["WARC-Concurrent-To", "<2>"]]
    assert meta["http"]["headers"] == [["Set-Cookie", "a=1"], ["Link", "<x>"], ["Set-Cookie", "b=2"]]


def test_silent_elements_give_links_and_swallow_nothing():
    page = "<p>a</p><script src='/s.js'></script><iframe src=f.html>in</iframe><object>gone<p>b</p><select><option>c<svg><noscript>d</noscript>e<textarea>f"
    text, about = warc.read_page(page, "http://h/")
    assert text == "a\ngone\nb\nce"
    assert about["links"] == [{"path": "script@/src", "url": "http://h/s.js"}, {"path": "iframe@/src", "url": "http://h/f.html"}]
    # many unclosed elements don't make many searches to the end
    assert warc.read_page("<svg>x" * 100_000, "")[0] == "x" * 100_000


class Reader(HTMLParser):
    """A page's text and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.silent = [], [], []

    def handle_starttag(self, tag, attrs):
        if not self.silent:
            self.links += [(f"{tag}@/{k}", v) for k in ("href", "src") for a, v in attrs if a == k and v]
            if tag in warc._BREAKING:
                self.text.append("\n")
        if tag in warc._SILENT:
            self.silent.append(tag)

    def handle_endtag(self, tag):
        if self.silent and self.silent[-1] == tag:
            self.silent.pop()
        elif not self.silent and tag in warc._BREAKING:
            self.text.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def test_text_and_links_against_the_standard_parser():
    rnd = random.Random(3)

    def node(depth):
        kind = rnd.randrange(8)
        if kind < 3 or depth == 0:
            return rnd.choice(["word ", "a &amp; b", "&eacute;t&eacute;", "x\n y", "1 &lt; 2", " "])
        if kind == 3:
            return rnd.choice(["<br>", "<hr/>", f"<img src='/i{rnd.randrange(9)}.png' alt='>'>", "<!-- no <b> -->"])
        tag = rnd.choice(["p", "div", "b", "span", "ul", "li", "table", "script", "style", "noscript", "iframe", "a"])
        own = f' href="http://h/{rnd.randrange(99)}"' if tag == "a" else ' src="s.js"' if tag in ("script", "iframe") else ""
        inner = "var x = 1;" if tag in ("script", "style") else "hidden" if tag in ("noscript", "iframe") else "".join(node(depth - 1) for _ in range(rnd.randrange(4)))
        return f"<{tag}{own}>{inner}</{tag}>"

    for _ in range(300):
        page = "".join(node(4) for _ in range(6))
        text, about = warc.read_page(page, "http://h/d/")
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = [" ".join(x.split()) for x in "".join(reader.text).split("\n")]
        assert text == "\n".join(x for x in lines if x), page
        assert [(x["path"], x["url"]) for x in about["links"]] == [(k, urljoin("http://h/d/", v)) for k, v in reader.links], page
