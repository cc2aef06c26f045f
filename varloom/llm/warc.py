"""WARC derivatives: linked metadata and plain-text conversion records for responses.

``responses`` makes response records of a page table, ``derivatives`` turns
every response into two records: ``metadata`` (what is known of the payload, as
``application/warc-fields``) and ``conversion`` (its plain text). Both refer to
the response by ``WARC-Refers-To``, its URI and date, and repeat its digests, so
that a derivative can be traced without the response at hand. ``serialise`` and
``parse`` write and read the records in the WARC 1.1 format, each a gzip member.

Everything works on one record at a time, so plans have no shuffle, and a lost
executor's tasks are simply run again. Record ids are name-based: the same page
gives the same ids in every run.

Defined results: a null url is the empty target, null html an empty payload
with the digest of no bytes and an empty conversion. Repeated rows give
repeated records with equal ids. Columns beyond page_id, url and html are not
read. Bytes that are no UTF-8 become U+FFFD in conversions. Blanks and control characters
in a url are percent-encoded, so that no url adds a header. Tags are what browsers
read as tags: ``<`` and a letter up to the next ``>`` outside of quoted values, or to the end of the page
(``a <b and c> d`` holds a tag, ``a < b`` none). Time grows with a page's
length, whatever is left open in it; tags in comments and scripts don't count as links.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._common import small_batches

#: Namespace of the name-based record ids.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:varloom:warc")
CRAWLED = "2024-01-01T00:00:00Z"

RESPONSE = StructType(
    [StructField("page_id", LongType())]
    + [StructField(c, StringType()) for c in ("record_id", "target_uri", "warc_date", "http_head", "payload_digest", "block_digest")]
    + [StructField("payload", StringType())]
)
DERIVED = StructType(
    [StructField("page_id", LongType())]
    + [StructField(c, StringType()) for c in ("warc_type", "record_id", "refers_to", "refers_to_uri", "refers_to_date", "target_uri", "warc_date", "content_type", "source_head", "source_payload_digest", "source_block_digest", "block_digest")]
    + [StructField("content_length", LongType()), StructField("block", StringType())]
)
#: A tag as the HTML standard reads it: a ``>`` within a quoted value doesn't end it. Every alternative can end with the page, so no character is read twice.
_TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*+(?:>|\Z)"""
_TOKEN = re.compile(
    r"(?is)<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|(?P<element>script|style|noscript|template)(?=[\s/>])" + _TAG_REST + r".*?(?:</(?P=element)\s*>|\Z)"
    r"|(?P<name>/?[a-z][^\s/>]*+|[!?/])" + _TAG_REST + ")"
)
_ATTRIBUTE = re.compile(r"""(?s)([^\s/>=][^\s/>=]*+)\s*+(?:=\s*+(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
_CONTROL = re.compile("[\x00-\x20\x7f]")
#: Elements that break a line.
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_TITLE_END, _LANGUAGE = re.compile(r"(?i)</title(?=[\s/>]|\Z)"), re.compile(r"[A-Za-z-]*")
_NUMBER = re.compile(r"&#([0-9]{8,});?")
_BLANKS = re.compile(r" *+[\t\r\f\v\xa0][ \t\r\f\v\xa0]*+|  +")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    """The labelled digest of the format: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, name)))}>"


def _unescape(text: str) -> str:
    """Entities read once; numbers beyond all characters, of any length, become U+FFFD."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0") or "0"
        return f"&#{digits};" if len(digits) < 8 else "\ufffd"

    return entities.unescape(_NUMBER.sub(short, text))


def _tokens(page: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, name, whole) of every tag, its name in lower case, and of every hidden part, whose name is empty; ``whole``: it ends before the page does."""
    return [(m.start(), m.end(), (m["name"] or "").lower(), m[0][-1] == ">") for m in _TOKEN.finditer(page)]


def plain_text(page: str, tokens: list | None = None) -> str:
    """The visible text: hidden elements and heads that end go, block elements break lines, entities are read once. One pass over tags."""
    tokens = _tokens(page) if tokens is None else tokens
    ends = [i for i, t in enumerate(tokens) if t[2] == "/head" and t[3]]
    out, at, i, next_end = [], 0, 0, 0
    while i < len(tokens):
        start, end, name, whole = tokens[i]
        out.append(page[at:start])
        gap = " " if not name else "\n" if whole and name.removeprefix("/") in _BLOCKS else ""
        if name == "head":
            while next_end < len(ends) and ends[next_end] < i:
                next_end += 1
            if next_end < len(ends):
                i, gap = ends[next_end], " "
                end = tokens[i][1]
        out.append(gap)
        at, i = end, i + 1
    text = "".join(out) + page[at:]
    return _LINES.sub("\n", _BLANKS.sub(" ", _unescape(text))).strip()


def _attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case, the first of equal names."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag.removesuffix(">"), re.match(r"<[^\s/>]*", tag).end()):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def facts(page: str, tokens: list | None = None) -> list[tuple[str, str]]:
    """Title, language, number of links and charset, of the tags outside of hidden elements."""
    title, lang, links = None, "", 0
    for start, end, name, whole in _tokens(page) if tokens is None else tokens:
        if name == "a":
            links += "href" in _attributes(page[start:end])
        elif name == "html" and not lang:
            lang = _LANGUAGE.match(_attributes(page[start:end]).get("lang", ""))[0].lower()
        elif name == "title" and title is None and whole:
            close = _TITLE_END.search(page, end)
            title = " ".join(_unescape(page[end : close.start()]).split()) if close else ""
    return [(k, v) for k, v in [("title", title), ("language", lang), ("outlinks", str(links)), ("charset", "utf-8")] if v]


def one_line(text: str) -> str:
    """A URI with blanks and control characters as their %XX, so that none ends its header's line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def http_head(payload: bytes) -> str:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"


#: Ids pass through pandas as text, which turns whole numbers beside nulls into fractions.
_ID = "cast(cast(page_id as long) as string) as page_id"


def _with_text_id(schema: StructType) -> StructType:
    return StructType([StructField("page_id", StringType()), *schema.fields[1:]])


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("page_id", F.col("page_id").cast("long"))


def _response(frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for page_id, url, page in zip(frame.page_id, frame.url, frame.html, strict=True):
        url, page = one_line(url or ""), page or ""
        body = page.encode("utf-8", "replace")
        head, of_body = http_head(body), digest(body)
        rows.append((page_id, urn("response", page_id, url, of_body), url, CRAWLED, head, of_body, digest(head.encode() + body), page))
    return pd.DataFrame(rows, columns=RESPONSE.names)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html)."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.expr(_ID), F.col("url").cast("string"), F.col("html").cast("string"))
    return _whole(pages.mapInPandas(lambda frames: map(_response, _parts(frames)), _with_text_id(RESPONSE)))


def _parts(frames, most: int = 500):
    for f in frames:
        for i in range(0, len(f), most):
            yield f.iloc[i : i + most]


def _derive(frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in frame.itertuples(index=False):
        page, page_id = r.payload or "", r.page_id
        tokens = _tokens(page)
        fields = "".join(f"{k}: {v}\r\n" for k, v in [("via", one_line(r.target_uri or "")), ("source-payload-digest", r.payload_digest or ""), *facts(page, tokens)])
        for kind, content_type, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", plain_text(page, tokens))):
            data = block.encode("utf-8", "replace")
            rows.append((page_id, kind, urn(kind, r.record_id), r.record_id, r.target_uri, r.warc_date, r.target_uri, r.warc_date, content_type, r.http_head, r.payload_digest, r.block_digest, digest(data), len(data), block))
    return pd.DataFrame(rows, columns=DERIVED.names)


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record."""
    small_batches(records.sparkSession)
    return _whole(records.select(F.expr(_ID), *RESPONSE.names[1:]).mapInPandas(lambda frames: map(_derive, _parts(frames)), _with_text_id(DERIVED)))


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member of its own; headers without a value are left out, and a control character in one raises ValueError."""
    headers = [(k, v) for k, v in headers if v]
    if bad := next((k for k, v in headers if re.search("[\x00-\x1f\x7f]", v)), None):
        raise ValueError(f"{bad} holds a control character")
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def serialise(derived: DataFrame) -> DataFrame:
    """(record_id, data): each derivative in the WARC format, to be written one after another.

    The source's own header lines stand in ``WARC-Source-Head``, percent-encoded to one line; ``source_head_of`` reads them.
    """

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in frame.itertuples(index=False):
            headers = [("WARC-Type", r.warc_type), ("WARC-Record-ID", r.record_id), ("WARC-Refers-To", r.refers_to), ("WARC-Refers-To-Target-URI", one_line(r.refers_to_uri or "")), ("WARC-Refers-To-Date", r.refers_to_date), ("WARC-Target-URI", one_line(r.target_uri or "")), ("WARC-Date", r.warc_date), ("WARC-Block-Digest", r.block_digest), ("WARC-Source-Payload-Digest", r.source_payload_digest), ("WARC-Source-Block-Digest", r.source_block_digest), ("WARC-Source-Head", quote(r.source_head or "", safe=" :;/=,()\"")), ("Content-Type", r.content_type)]
            rows.append((r.record_id, record_bytes(headers, (r.block or "").encode("utf-8", "replace"))))
        return pd.DataFrame(rows, columns=["record_id", "data"])

    return derived.mapInPandas(lambda frames: map(of, _parts(frames)), StructType([StructField("record_id", StringType()), StructField("data", BinaryType())]))


def source_head_of(headers: dict[str, str]) -> str:
    """The source's header lines, of the headers that ``parse`` gives."""
    return unquote(headers.get("WARC-Source-Head", ""))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a file's bytes: headers and block. A damaged record raises ValueError."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        if not z.eof:
            raise ValueError("the last record is cut off")
        data = z.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(headers["Content-Length"])]
        if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        out.append((headers, block))
    return out
