import base64
import gzip
import hashlib
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm.warc import derivative_digest, derivatives, read_html, responses, write_warc

PAGES = [
    (1, "http://x/a", "<title>T &amp; u</title><p>one <b>two</b></p><script>var t='</p>';</script><p>three&nbsp;4"),
    (2, None, None),
    (3, "http://x/\r\nb", ""),
    (4, "http://x/c", "<!-- no <p>end"),
    (4, "http://x/c", "<!-- no <p>end"),
    (None, "http://x/d", "<a href='/l?a=1&amp;b=2'>link</a> <A HREF=/m>m</A>\r\n\r\nWARC/1.1\r\n\r\nend"),
    (5, "http://x/e", "é\U0001f600<br>" * 20_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return frame.selectExpr("*", "'x' AS type", "'x' AS block", "'x' AS record_id", "'x' AS payload")


def parse(data):
    """Records of a WARC file by their own lengths."""
    records, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        header = dict(line.split(": ", 1) for line in lines)
        length = int(header["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        assert data[end + 4 + length : end + 8 + length] == b"\r\n\r\n"
        records.append((header, block))
        at = end + 8 + length
    return records


def test_files_hold_linked_records(pages, tmp_path):
    sources = responses(pages, "2024-01-01T00:00:00Z")
    write_warc(derivatives(sources), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.gz"))
    records = [r for f in files for r in parse(gzip.decompress(f.read_bytes()))]
    assert len(records) == 2 * len(PAGES)
    known = {f"<{r.record_id}>": r for r in sources.collect()}
    for header, block in records:
        source = known[header["WARC-Refers-To"]]
        sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert header["WARC-Block-Digest"] == f"sha1:{sha1}"
        sha1 = base64.b32encode(hashlib.sha1(source.payload.encode()).digest()).decode()
        assert header["WARC-Source-Payload-Digest"] == f"sha1:{sha1}"
        if source.target_uri:
            assert header["WARC-Refers-To-Target-URI"] == " ".join(source.target_uri.split())
        if header["WARC-Type"] == "metadata":
            lines = block.decode().split("\r\n")
            kept = [x.removeprefix("http-header: ") for x in lines if x.startswith("http-header")]
            assert "\r\n".join(kept) == source.http.strip()


def test_text_title_links():
    assert read_html(PAGES[0][2]) == ("one two\nthree 4", "T & u", [])
    assert read_html(PAGES[5][2])[2] == ["/l?a=1&b=2", "/m"]
    assert read_html("x<title>t</title>İ<SCRIPT>a</sCript>b&lt;")[:2] == ("x\nİ\nb<", "t")
    assert read_html("a<script>never ends <p>b")[0] == "a"


def test_text_equals_a_parser(spark):
    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    for page in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        parser = Text()
        parser.feed(page.html)
        assert "".join("".join(parser.out).split()) == "".join(read_html(page.html)[0].split())


@pytest.mark.parametrize("page", ["<a" * 100_000, "<!--" * 100_000, "<script>" * 50_000, "&" * 300_000, "<" * 300_000])
def test_no_page_takes_long(page):
    start = time.process_time()
    read_html(page)
    assert time.process_time() - start < 5


def test_digest_and_empty_table(pages):
    rows = derivative_digest(pages).collect()
    assert len(rows) == 2 * len(PAGES)
    assert len({r.record_id for r in rows}) == 2 * (len(PAGES) - 1)  # page 4 is there twice
    assert derivative_digest(pages.limit(0)).count() == 0
