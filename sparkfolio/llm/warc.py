"""WARC derivatives: metadata and plain-text conversion records of responses.

A record is a row: record_id, type, target_uri, date, refers_to, content_type,
http headers (of responses), payload and digests. Deriving is a projection over
responses; a reader and a writer of .warc and .warc.gz files stand beside it.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_COLUMNS = ("record_id", "type", "target_uri", "date", "refers_to", "content_type", "http_headers", "payload", "payload_digest", "block_digest")
RECORD_SCHEMA = ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in RECORD_COLUMNS)

# Elements that part lines of text.
BLOCK_ELEMENTS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
#: Elements whose content is not text.
HIDDEN_ELEMENTS = ("script", "style", "noscript", "template")
# Character references, the ampersand's last.
REFERENCES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"),
)
CRLF = "\r\n"


def plain_text(html: Column) -> Column:
    """Text of an HTML page: comments and hidden elements go, block elements part
    lines, other tags vanish, the commonest character references are resolved,
    and white space is squeezed."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", " ")
    for e in HIDDEN_ELEMENTS:
        x = F.regexp_replace(x, rf"(?is)<{e}\b[^>]*>.*?</{e}\s*>", " ")
    x = F.regexp_replace(x, rf"(?i)</?({BLOCK_ELEMENTS})(\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, "<[a-zA-Z/!?][^>]*>", "")
    x = F.regexp_replace(_resolved(x), r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _resolved(text: Column) -> Column:
    """Known character references resolved, each once: what stands between an ampersand and a semicolon is looked up."""
    known = F.create_map(*[F.lit(x) for k, v in REFERENCES for x in (k[1:], v)])

    def part(p: Column) -> Column:
        end = F.instr(p, ";")
        return F.coalesce(F.concat(F.try_element_at(known, F.substr(p, F.lit(1), end)), F.substr(p, end + 1)), F.concat(F.lit("&"), p))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), part)
        return F.concat(parts[0], F.array_join(rest, ""))

    once = F.transform(F.array(F.split(text, "&")), joined)[0]  # the text is spelled once
    return once


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the digest of what identifies the record."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records (id, then ``RECORD_COLUMNS``); a null page has an empty payload."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    return pages.select(
        F.col(id_col),
        record_id(F.lit("response"), F.col(id_col), F.col(url_col), F.sha2(body, 256)).alias("record_id"),
        F.lit("response").alias("type"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        headers.alias("http_headers"),
        body.alias("payload"),
        digest(body).alias("payload_digest"),
        digest(F.concat(headers.cast("binary"), body)).alias("block_digest"),
    )


def derive(records: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """A metadata and a conversion record for every response.

    Returns two rows per response: the columns named in ``carry``, then
    ``RECORD_COLUMNS``. Both refer to the response's record_id and keep its
    target_uri and date. The metadata record is a list of warc-fields: source
    type and content type, HTTP status, the response's payload and block digests,
    its payload's bytes, and the conversion record's id. The conversion record is
    the payload's plain text. Digests are SHA-256 of what the record holds.

    Records of other types give nothing. Null payloads, headers and addresses
    count as empty fields; a null target_uri or date stays null. Repeated
    responses give repeated derivatives with the same ids. An empty table gives an
    empty result. Other columns are not read, so their names cannot clash;
    ``carry`` may not name a record column. Payloads count as UTF-8.
    """
    given = records.where("type = 'response'").select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        *[F.col(c) for c in ("target_uri", "date", "payload_digest", "block_digest", "http_headers")],
        F.coalesce("record_id", F.lit("")).alias("source"),
        F.coalesce("payload", F.lit(b"")).alias("body"),
    )
    text = plain_text(F.col("body").cast("string")).cast("binary")
    made = given.withColumn("text", text).withColumn("metadata_id", record_id(F.lit("metadata"), F.col("source"))).withColumn("conversion_id", record_id(F.lit("conversion"), F.col("source")))
    fields = (
        ("source-type", F.lit("response")),
        ("source-content-type", F.regexp_extract("http_headers", r"(?i)\ncontent-type:[ \t]*([^\r\n]*)", 1)),
        ("source-http-status", F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)),
        ("source-payload-digest", F.col("payload_digest")),
        ("source-block-digest", F.col("block_digest")),
        ("source-payload-bytes", F.octet_length("body").cast("string")),
        ("conversion", F.col("conversion_id")),
    )
    listed = F.concat(*[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("")), F.lit(CRLF)) for k, v in fields]).cast("binary")

    def record(kind: str, rid: str, content_type: str, payload: Column) -> Column:
        return F.struct(F.col(rid).alias("record_id"), F.lit(kind).alias("type"), F.lit(content_type).alias("content_type"), payload.alias("payload"))

    both = F.array(record("metadata", "metadata_id", "application/warc-fields", listed), record("conversion", "conversion_id", "text/plain; charset=utf-8", F.col("text")))
    rows = made.select(*[f"_c{i}" for i in range(len(carry))], "target_uri", "date", "source", F.explode(both).alias("r"))
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        "r.record_id",
        "r.type",
        "target_uri",
        "date",
        F.col("source").alias("refers_to"),
        "r.content_type",
        F.lit(None).cast("string").alias("http_headers"),
        "r.payload",
        digest(F.col("r.payload")).alias("payload_digest"),
        digest(F.col("r.payload")).alias("block_digest"),
    )


def record_bytes(r: dict) -> bytes:
    """One WARC/1.1 record."""
    block = (r["http_headers"] or "").encode() + (r["payload"] or b"")
    named = (
        ("WARC-Type", r["type"]),
        ("WARC-Record-ID", r["record_id"]),
        ("WARC-Target-URI", r["target_uri"]),
        ("WARC-Date", r["date"]),
        ("WARC-Refers-To", r["refers_to"]),
        ("WARC-Payload-Digest", r["payload_digest"]),
        ("WARC-Block-Digest", r["block_digest"]),
        ("Content-Type", r["content_type"]),
        ("Content-Length", str(len(block))),
    )
    head = "".join(f"{k}: {v}{CRLF}" for k, v in named if v is not None)
    return f"WARC/1.1{CRLF}{head}{CRLF}".encode() + block + (CRLF * 2).encode()


def members(records: DataFrame) -> DataFrame:
    """(member): each record as a gzip member; members joined in any order are a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [gzip.compress(record_bytes(r), mtime=0) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return records.select(*RECORD_COLUMNS).mapInArrow(run, "member binary")


#: Bytes looked at together, and how a gzip member starts.
PART, GZIP = 1 << 22, b"\x1f\x8b\x08"
_head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def inflated(data: bytes, lost: list[int]) -> Iterator[bytes | None]:
    """What a file holds, in parts of at most ``PART`` bytes: gzip members one by one, other
    data as it stands. After a member that cannot be read comes None, then the next one that can;
    the bytes passed over are added to ``lost``."""
    if not data.startswith(GZIP):
        yield from (data[i : i + PART] for i in range(0, len(data), PART))
        return
    at = 0
    while at < len(data):
        inflate, took = zlib.decompressobj(31), at
        try:
            while not inflate.eof and took < len(data):
                given = data[took : took + PART]
                took += len(given)
                yield inflate.decompress(given, PART)
                while inflate.unconsumed_tail and not inflate.eof:
                    yield inflate.decompress(inflate.unconsumed_tail, PART)
            took -= len(inflate.unused_data)
            if inflate.eof:
                at = took
                continue
        except zlib.error:
            pass
        after = data.find(GZIP, at + 1)
        lost.append((after if after > 0 else len(data)) - at)
        at = after if after > 0 else len(data)
        yield None


def parse(data: bytes, lost: list[int] | None = None) -> Iterator[dict]:
    """Records of a .warc or .warc.gz file. What cannot be read is passed over up to the
    next gzip member or record head; the numbers of bytes passed over are added to ``lost``."""
    lost = [] if lost is None else lost
    held = bytearray()
    for part, last in chain(((x, False) for x in inflated(data, lost)), [(b"", True)]):
        held += part or b""
        at = 0
        while at < len(held):
            m = _head.match(held, at)
            if not m:
                after = held.find(b"WARC/1.", at + 1)
                if after < 0 and part is not None and not last and (held.startswith(b"WARC/1.", at) or len(held) - at < 8):
                    break  # the head may go on in the next part
                if held[at : max(after, len(held) if after < 0 else 0)].strip():
                    lost.append((after if after > 0 else len(held)) - at)
                at = after if after > 0 else len(held)
                continue
            size = _fields(m[1]).get("content-length", "")
            if not size.isdigit():
                lost.append(m.end() - at)
                at = m.end()
                continue
            if m.end() + int(size) > len(held):
                if part is not None and not last:
                    break  # the block goes on in the next part
                after = held.find(b"WARC/1.", m.end())
                lost.append((after if after > 0 else len(held)) - at)
                at = after if after > 0 else len(held)
                continue
            yield _record(_fields(m[1]), bytes(held[m.end() : m.end() + int(size)]))
            at = m.end() + int(size) + 4
        del held[: min(at, len(held))]


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in bytes(head).decode("utf-8", "replace").split(CRLF))}


def _record(fields: dict[str, str], block: bytes) -> dict:
    headers, kind = None, fields.get("content-type")
    if kind and kind.startswith("application/http") and b"\r\n\r\n" in block:
        cut = block.index(b"\r\n\r\n") + 4
        headers, block = block[:cut].decode("utf-8", "replace"), block[cut:]
    named = ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to")
    return dict(zip(RECORD_COLUMNS, (*map(fields.get, named), kind, headers, block, fields.get("warc-payload-digest"), fields.get("warc-block-digest"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all .warc and .warc.gz files under ``path``, one task a file, which is inflated in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in RECORD_COLUMNS])
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                for r in parse(content.as_py()):
                    rows.append(r)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _files(spark, path).select("content").mapInArrow(run, RECORD_SCHEMA)


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(path, gaps, bytes): for each file, how often and how much ``read`` passes over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                lost: list[int] = []
                for _ in parse(content.as_py(), lost):
                    pass
                yield pa.RecordBatch.from_pydict({"path": [name.as_py()], "gaps": [len(lost)], "bytes": [sum(lost)]})

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, gaps bigint, bytes bigint")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)


def _sql_uuid(kind: str, *parts: str) -> str:
    joined = " || chr(10) || ".join([f"'{kind}'", *parts])
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({joined}) AS h))"


def _sql_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for e in HIDDEN_ELEMENTS:
        x = rf"regexp_replace({x}, '(?is)<{e}\b[^>]*>.*?</{e}\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?({BLOCK_ELEMENTS})(\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    for k, v in REFERENCES:
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    x = rf"regexp_replace({x}, '[ \t\r\f]+', ' ', 'g')"
    return rf"trim(regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


_HEADERS = "'HTTP/1.1 200 OK' || E'\\r\\n' || 'Content-Type: text/html; charset=utf-8' || E'\\r\\n' || 'Content-Length: ' || strlen(body) || E'\\r\\n\\r\\n'"
_SOURCE_ID = _sql_uuid("response", "page_id", "coalesce(url, '')", "sha256(body)")
SQL = f"""
WITH given AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
source AS (SELECT page_id, url, body, {_SOURCE_ID} AS source, 'sha256:' || sha256(body) AS payload_digest, 'sha256:' || sha256({_HEADERS} || body) AS block_digest FROM given),
made AS (SELECT *, {_sql_uuid("metadata", "source")} AS metadata_id, {_sql_uuid("conversion", "source")} AS conversion_id, {_sql_text("body")} AS text FROM source),
records AS (
  SELECT page_id, metadata_id AS record_id, 'metadata' AS type, url, source, 'application/warc-fields' AS content_type,
    'source-type: response' || E'\\r\\n' || 'source-content-type: text/html; charset=utf-8' || E'\\r\\n' || 'source-http-status: 200' || E'\\r\\n'
    || 'source-payload-digest: ' || payload_digest || E'\\r\\n' || 'source-block-digest: ' || block_digest || E'\\r\\n'
    || 'source-payload-bytes: ' || strlen(body) || E'\\r\\n' || 'conversion: ' || conversion_id || E'\\r\\n' AS block FROM made
  UNION ALL
  SELECT page_id, conversion_id, 'conversion', url, source, 'text/plain; charset=utf-8', text FROM made
)
SELECT page_id, record_id, type, url AS target_uri, '2024-01-01T00:00:00Z' AS date, source AS refers_to, content_type, block, 'sha256:' || sha256(block) AS payload_digest, 'sha256:' || sha256(block) AS block_digest FROM records
"""
