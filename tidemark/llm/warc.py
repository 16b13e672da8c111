"""Derived WARC records: for every response a metadata record and a plain-text conversion.

Both point back to the response by ``WARC-Refers-To`` and carry its target, date and payload
digest; the metadata record also keeps every header line of the HTTP response, the title and
the links. Record ids follow from the response's id, so a repeated task writes the same records.

* A null payload counts as empty: its conversion is an empty text. A null target or header
  leaves out the line. An empty table gives no records.
* Very long pages are read in one pass; an element that never ends takes the rest of the page,
  and no tag is looked for from each place in it.
* Repeated responses give the same records again. Other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import SPACE

RECORD = (
    "type string, record_id string, refers_to string, target_uri string, "
    "payload_digest string, block_digest string, header string, block string"
)

_TAG = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|<[!?][^<>]*>")
_HREF = re.compile(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_INLINE = re.compile("[{0} ]{{2,}}|[{0}]".format(SPACE.replace("\n", "").replace(" ", "") + "\xa0"))
_BREAKS = re.compile(r" ?\n[ \n]*")

# Elements whose content is not shown, and inline elements, which end no line.
_HIDDEN = frozenset("script style noscript template title".split())
_CLOSED = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in _HIDDEN}
_FLOWING = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup tt u var wbr".split())


def read_html(page: str) -> tuple[str, str, list[str]]:
    """Shown text, title and links of a page, by one pass over its tags."""
    text, links, title, at = [], [], "", 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            text.append(page[at:])
            break
        text.append(page[at : tag.start()])
        at = tag.end()
        if tag.group() == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        name = (tag.group(2) or "").lower()
        if name in _HIDDEN and not tag.group(1):
            closing = _CLOSED[name].search(page, at)
            end = closing.start() if closing else len(page)
            if name == "title" and not title:
                title = page[at:end]
            at = end
            continue
        if name == "a" and not tag.group(1):
            href = _HREF.search(tag.group(3))
            if href:
                links.append(html.unescape(next(g for g in href.groups() if g is not None)))
        if name not in _FLOWING:
            text.append("\n")
    return _tidy("".join(text)), _tidy(title).replace("\n", " "), links


def _tidy(text: str) -> str:
    marks = text.count("&")
    # The one entity that is common is replaced without a look at each.
    only = marks and marks == text.count("&amp;")
    shown = text.replace("&amp;", "&") if only else html.unescape(text) if marks else text
    return _BREAKS.sub("\n", _INLINE.sub(" ", shown)).strip(" \n")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()


def _record(kind: str, lines: list[tuple[str, str | None]], block: str) -> tuple[str, str]:
    """Header and block digest."""
    body = block.encode()
    checked = digest(body)
    lines = [("WARC-Type", kind), *lines, ("WARC-Block-Digest", checked), ("Content-Length", str(len(body)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None), checked


def _line(value: str | None) -> str | None:
    """A value as one header line."""
    return None if value is None else " ".join(value.split())


def derive(record_id: str, target: str | None, date: str | None, http: str | None, payload: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    payload, target = payload or "", _line(target)
    source = digest(payload.encode())
    text, title, links = read_html(payload)
    space = uuid.uuid5(uuid.NAMESPACE_URL, record_id)
    fields = [f"http-header: {_line(h)}" for h in (http or "").split("\r\n") if h.strip()]
    fields += [f"title: {title}"] if title else []
    fields += [f"payload-digest: {source}", f"text-chars: {len(text)}"]
    fields += [f"outlink: {_line(link)}" for link in links]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{f}\r\n" for f in fields)),
        "conversion": ("text/plain; charset=utf-8", text),
    }
    out = []
    for kind, (content, block) in blocks.items():
        own = f"urn:uuid:{uuid.uuid5(space, kind)}"
        lines = [
            ("WARC-Record-ID", f"<{own}>"),
            ("WARC-Refers-To", f"<{record_id}>"),
            ("WARC-Refers-To-Target-URI", target),
            ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", target),
            ("WARC-Date", date),
            ("WARC-Source-Payload-Digest", source),
            ("Content-Type", content),
        ]
        header, checked = _record(kind, lines, block)
        out.append((kind, own, record_id, target, source, checked, header, block))
    return out


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Pages as responses: ``page_id, record_id, target_uri, date, http, payload``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url").cast("string"), payload))
    parts = [F.substr(name, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    length = F.octet_length(payload).cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n")
    )
    return pages.select(
        "page_id",
        F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts)).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        http.alias("http"),
        payload.alias("payload"),
    )


def derivatives(sources: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of ``keep`` and two records for every response. One pass, no shuffle."""
    rows = sources.select(*keep, "record_id", "target_uri", "date", "http", "payload")
    schema = T.StructType([*rows.schema.fields[: len(keep)], *T._parse_datatype_string(RECORD).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, place = [], []
            columns = batch.columns[len(keep) :]
            for i in range(batch.num_rows):
                records = derive(*(c[i].as_py() for c in columns))
                made += records
                place += [i] * len(records)
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(pa.array(place, pa.int64())) for c in batch.columns[: len(keep)]],
                    *[pa.array([r[c] for r in made], pa.string()) for c in range(8)],
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files: header, empty line, block, and two line ends after each record."""
    whole = F.concat("header", F.lit("\r\n"), "block")
    records.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def derivative_digest(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """All derived records: their links and digests, and hashes of header and block."""
    records = derivatives(responses(pages, date))
    return records.select(
        "page_id",
        "type",
        "record_id",
        "refers_to",
        "target_uri",
        "payload_digest",
        "block_digest",
        F.octet_length("block").cast("bigint").alias("content_length"),
        F.sha2("header", 256).alias("header_sha256"),
        F.sha2("block", 256).alias("block_sha256"),
    )
