"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is a row: record_id, target_uri, date, headers (WARC header fields by name) and block
(HTTP response).  Each response gives two linked rows: a ``metadata`` record (JSON: the source's WARC and
HTTP headers, title, links) and a ``conversion`` record (the page's text).  Both keep the source's target
and date, refer to its identifier, name each other as concurrent, and carry digests of their own block
and of the source's block and payload.  Rows never leave their task; nothing is shuffled.

Record identifiers are name-based: the same response always gives the same identifiers.

The payload digest is that of the payload as transferred, before its content coding is undone.

Defined results: a null or empty block is a response without header fields and with an empty payload; its
records have an empty text and no links.  Bytes that aren't valid in the declared character set (UTF-8
without one) become replacement characters.  A body that is labelled chunked but isn't, or whose chunks are damaged,
is kept from there on as it came; a truncated file gives the records before the damage.  Kept columns named like
a record's field give way to it.  Repeated responses give repeated records.  An empty table
gives an empty result.  ``url`` null: the target is the empty string.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .main_text import BLOCK, RAW, RAW_END, TAG

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"        # of responses that are made from a table without fetch times
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")        # the URL name space
RECORD = ("record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
          "content_type string, content_length long, block_digest string, payload_digest string, source_block_digest string, "
          "source_headers map<string,string>, block string")
HREF = re.compile(r"""(?:^|\s)(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, ' '.join([kind, *map(str, parts)]))}>"


HEAD_END = re.compile(rb"\r?\n\r?\n")


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, header fields and payload (decoded from its transfer coding) of a response.

    Lines may end in a bare line feed.  A block that doesn't begin like a response is all payload.
    """
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    end = HEAD_END.search(block)
    head, body = (block[:end.start()], block[end.end():]) if end else (block, b"")
    lines = re.split(r"\r?\n", head.decode("latin-1"))
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value
    if "chunked" in _field(fields, "transfer-encoding"):
        body = unchunked(body)
    return lines[0], fields, body


def _field(fields: dict[str, str], name: str) -> str:
    return next((v.lower() for k, v in fields.items() if k.lower() == name), "")


def decoded_content(payload: bytes, fields: dict[str, str]) -> bytes:
    """The payload decoded from its content coding; a damaged coding is read up to the damage, or kept as it came."""
    coding = _field(fields, "content-encoding")
    if "gzip" in coding:
        return inflated(payload) or payload
    if "deflate" in coding:
        try:
            return zlib.decompress(payload)
        except zlib.error:
            return payload
    return payload


def unchunked(body: bytes) -> bytes:
    """The chunks' data; from where no chunk begins as it should, the bytes as they came."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(;.*)?", body[at:end].rstrip(b"\r")) if end >= 0 else None
        if size is None:
            return b"".join(out) + body[at:]
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 1:end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at:at + 2] == b"\r\n" else 1 if body[at:at + 1] == b"\n" else 0


def inflated(data: bytes, step: int = 1 << 16) -> bytes:
    """All gzip members; of a damaged or truncated one what comes before the damage, and nothing after it."""
    out, reader = [], zlib.decompressobj(31)
    for at in range(0, len(data), step):
        piece = data[at:at + step]
        while piece:
            try:
                out.append(reader.decompress(piece))
            except zlib.error:
                return b"".join(out)
            piece = reader.unused_data.lstrip(b"\0") if reader.eof else b""
            if reader.eof:
                reader = zlib.decompressobj(31)
    return b"".join(out)


def page_parts(page: str) -> tuple[str, list[str], list[dict[str, str]]]:
    """Title, lines of text and links of a page, in one pass over its markup."""
    title, lines, links, words, at = "", [], [], [], 0

    def end() -> None:
        if words:
            line = " ".join("".join(words).split())
            if line:
                lines.append(line)
            words.clear()

    while True:
        tag = TAG.search(page, at)
        piece = page[at:tag.start()] if tag else page[at:]
        if piece:
            words.append(entities.unescape(piece) if "&" in piece else piece)
        if not tag:
            end()
            return title, lines, links
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if not tag[1]:
            if tag[3] and (" href" in tag[3] or " src" in tag[3] or HREF.search(tag[3])):
                for kind, url in HREF.findall(tag[3]):
                    links.append({"path": f"{name.upper()}@/{kind.lower()}", "url": entities.unescape(url.strip("\"'"))})
            if name in RAW and not (tag[3] or "").endswith("/"):
                found = RAW_END[name].search(page, at)
                if name == "title" and not title:
                    title = " ".join(entities.unescape(page[at:found.start() if found else len(page)]).split())
                at = found.end() if found else len(page)
                words.append(" ")
                continue
        if name in BLOCK:
            end()
        elif name in ("td", "th"):
            words.append(" ")


def derivatives(source_id: str, target: str, date: str, headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of a response, as rows of ``RECORD``."""
    status, fields, payload = http_parts(block)
    kind = next((v for k, v in fields.items() if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        page = decoded_content(payload, fields).decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = decoded_content(payload, fields).decode("utf-8", "replace")
    title, lines, links = page_parts(page)
    payload_digest = headers.get("WARC-Payload-Digest") or digest(payload)
    block_digest = headers.get("WARC-Block-Digest") or digest(block)
    metadata_id, conversion_id = record_id("metadata", source_id), record_id("conversion", source_id)
    envelope = json.dumps({
        "WARC-Header-Metadata": headers, "Payload-Digest": payload_digest, "Block-Digest": block_digest,
        "HTTP-Response-Metadata": {"Response-Message": status, "Headers": fields,
                                   "HTML-Metadata": {"Title": title, "Links": links}},
    }, ensure_ascii=False, sort_keys=True)
    out = []
    for name, own, other, content, body in (
            ("metadata", metadata_id, conversion_id, "application/json", envelope),
            ("conversion", conversion_id, metadata_id, "text/plain; charset=utf-8", "\n".join(lines))):
        raw = body.encode("utf-8", "replace")
        out.append((name, own, source_id, other, target, date, content, len(raw), digest(raw), payload_digest, block_digest, headers, body))
    return out


def derived(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of the responses with the records derived from them, two rows per response."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    keep = [c for c in keep or [] if c not in names]                     # the records' own fields win

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                headers = dict(r.headers) if r.headers is not None else {}
                for d in derivatives(r.record_id or "", r.target_uri or "", r.date or "", headers, bytes(r.block or b"")):
                    rows.append((*[getattr(r, f"k{i}") for i in range(len(keep))], *d))
            yield pd.DataFrame(rows, columns=[*(f"k{i}" for i in range(len(keep))), *names])

    kept = responses.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "record_id", "target_uri", "date", "headers", "block")
    types = dict(responses.select(*keep).dtypes) if keep else {}
    schema = ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keep)), RECORD])
    return kept.mapInPandas(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of fetched pages (page_id, url, html): identifiers, header fields and HTTP block."""
    target = F.coalesce("url", F.lit(""))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "UTF-8"), body)
    name = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), target))
    identifier = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    headers = F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), identifier, F.lit("WARC-Target-URI"), target,
        F.lit("WARC-Date"), F.lit(DATE), F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
        F.lit("Content-Length"), F.octet_length(block).cast("string"))
    return pages.select("page_id", identifier.alias("record_id"), target.alias("target_uri"), F.lit(DATE).alias("date"),
                        headers.alias("headers"), block.alias("block"))


# --- records as bytes -----------------------------------------------------------------------------

def record_bytes(r: dict) -> bytes:
    """A derived record in the WARC format, as a gzip member of its own."""
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]),
              ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["date"]),
              ("WARC-Concurrent-To", r["concurrent_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]),
              ("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["payload_digest"]),
              ("Content-Type", r["content_type"]), ("Content-Length", str(r["content_length"]))]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode()
    return gzip.compress(head + b"\r\n\r\n" + r["block"].encode("utf-8", "replace") + b"\r\n\r\n", 6, mtime=0)


def parsed_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file, compressed or not.

    A damaged file ends at the damage: earlier records are whole, and one that breaks off is given as far as
    it goes with the field ``WARC-Truncated``.
    """
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = HEAD_END.search(data, start)
        if end is None:
            return
        fields = {}
        for line in re.split(r"\r?\n", data[start:end.start()].decode("utf-8", "replace"))[1:]:
            name, _, value = line.partition(":")
            fields[name.strip()] = value.strip()
        told = fields.get("Content-Length", "")
        size = int(told) if re.fullmatch(r"[0-9]{1,18}", told) else 0
        block = data[end.end():end.end() + size]
        if len(block) < size:
            fields.setdefault("WARC-Truncated", "unspecified")
        yield fields, block
        at = end.end() + size


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files under a path, one file per task at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [(h.get("WARC-Record-ID", ""), h.get("WARC-Target-URI", ""), h.get("WARC-Date", ""), h, b)
                        for h, b in parsed_records(bytes(content)) if h.get("WARC-Type") == "response"]
                yield pd.DataFrame(rows, columns=["record_id", "target_uri", "date", "headers", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record_id string, target_uri string, date string, headers map<string,string>, block binary")


def warc_members(records: DataFrame) -> DataFrame:
    """record_id and the record's gzip member; members of a file may be joined in any order."""
    @F.pandas_udf("binary")
    def member(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([record_bytes(r) for r in rows.to_dict("records")], dtype=object)

    names = [x.split()[0] for x in RECORD.split(", ") if x.split()[0] != "source_headers"]
    return records.select("record_id", member(F.struct(*names)).alias("member"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(responses_of(table(spark, sf_dir, "pages", "page_id", "url", "html")), ["page_id"])
