"""Legacy web archives (ARC) converted to WARC records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.llm.common import staged

SALTS = 32
SEGMENT_BYTES = 4 << 20
#: fixed values: field names of the two versions of the legacy format
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length".split(),
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_arc(data: bytes):
    """Yields (fields, body) of every record: the first line is the version block, whose second line names the
    version; every header line is split by its version's fields and the body has the declared length."""
    source, version, first = io.BytesIO(data), "1", True
    while line := source.readline():
        if not line.strip():
            continue
        names = FIELDS[version]
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if first and parts[0].startswith("filedesc:"):
            parts = line.decode("utf-8", "replace").split()
            body = source.read(int(parts[-1]))
            version, first = body.split(b" ", 1)[0].decode(), False
            continue
        if len(parts) != len(names):
            raise ValueError(f"header line has {len(parts)} fields, version {version} has {len(names)}")
        body = source.read(int(parts[-1]))
        if len(body) != int(parts[-1]):
            raise ValueError("body is shorter than declared")
        yield dict(zip(names, parts)), body


def arc_file(records, version: str = "1", name: str = "pages.arc") -> bytes:
    """A legacy archive of (url, date, body) records. White space in a URL is percent-encoded."""
    head = f"{version} 0 converter\n{' '.join(FIELDS[version])}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(head)}\n".encode(), head, b"\n"]
    for url, date, body in records:
        safe = "".join(f"%{ord(c):02X}" if c.isspace() else c for c in url or "") or "unknown:"
        values = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Archive-length": str(len(body))}
        out += [" ".join(values.get(f, "-") for f in FIELDS[version]).encode(), b"\n", body, b"\n"]
    return b"".join(out)


def split_http(body: bytes) -> tuple[dict, bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), payload


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def warc_record(fields: dict, body: bytes, refers_to: str | None = None) -> bytes:
    """The equivalent WARC record. Identifiers follow from URL, date and page, so a task that runs again
    writes the same bytes. A revisit keeps the HTTP header only and names the record it refers to."""
    http, payload = split_http(body)
    when = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    kind = "response" if refers_to is None else "revisit"
    block = body if refers_to is None else body[: len(body) - len(payload)]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(http['X-Page-Id'])}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {fields['URL']}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Bytes: {len(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes):
    """Yields (headers, block) of every record by its declared length."""
    source = io.BytesIO(data)
    while line := source.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := source.readline()) and line.strip():
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k] = v
        yield headers, source.read(int(headers["Content-Length"]))


def archives(pages: DataFrame, id_col: str = "page_id", version: str = "1") -> DataFrame:
    """WARC archives of pages: one row per archive file of about SEGMENT_BYTES, gzip member per record.

    Every page becomes a legacy record first and is converted from it. Of equal payloads the record with the
    largest id is the response, the others revisit it. Payloads shared by many pages meet their largest id
    through partial aggregates and a salted join. A null html is an empty payload; a row with a null id is a
    response of its own; repeated rows stay repeated.
    """
    whole = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    marks = whole.where(F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha1("html")).alias("_d"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("_salt"))
    marks = staged(marks, "payload-digests")
    last = marks.groupBy("_d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    salted = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    refs = marks.join(salted, ["_d", "_salt"]).where(F.col("page_id") != F.col("refers_to")).groupBy("page_id", "_d").agg(F.max("refers_to").alias("refers_to"))
    tagged = whole.withColumn("_d", F.unhex(F.sha1("html"))).join(refs, ["page_id", "_d"], "left")

    def write(frames):
        parts, size = [], 0
        for f in frames:
            for page, url, html, ref in zip(f["page_id"], f["url"], f["html"], f["ref"]):
                body = f"HTTP/1.1 200 OK\r\nX-Page-Id: {page}\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode() + html.encode()
                for fields, content in read_arc(arc_file([(url, "19960101000000", body)], version)):
                    parts.append(gzip.compress(warc_record(fields, content, ref if isinstance(ref, str) else None), 5, mtime=0))
                size += len(parts[-1])
                if size >= SEGMENT_BYTES:
                    yield pd.DataFrame({"content": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"content": [b"".join(parts)]})

    text = tagged.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "html", F.col("refers_to").cast("string").alias("ref"))
    return staged(text.mapInPandas(write, "content binary"), "warc")


def read_archives(archive: DataFrame) -> DataFrame:
    """Records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id."""

    def read(frames):
        for f in frames:
            for content in f["content"]:
                rows = []
                source = gzip.GzipFile(fileobj=io.BytesIO(content))
                for h, block in read_warc(source.read()):
                    http, payload = split_http(block)
                    own = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and digest(payload) != own:
                        raise ValueError("payload digest differs")
                    page, ref = http["X-Page-Id"], h.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, int(h["X-Payload-Bytes"]), own, h["WARC-Type"], int(ref) if ref else None, h["WARC-Target-URI"], h["WARC-Record-ID"]))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archive.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string")
