r"""WARC archives: writing pages in segments, and reassembling them.

Writing: a page is an HTTP response whose body has chunked transfer framing.  A block over SEGMENT bytes is
cut into a first record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, the last
one with WARC-Segment-Total-Length).  Of records with equal payloads of at least REVISIT bytes, that with the
largest page_id is a response and the others revisits that refer to its record identifier.  Equal payloads meet by
digest: (digest, page_id) is summed in each task first, and only digests of two or more pages are joined back.
A record's identifier is a hash of all that is in it, so that it is the same whichever task writes it.

Files: Spark's text sink writes the records in parallel, each a gzip member of its own that ends with the two empty
lines which end a WARC record; the sink's line end is a gzip member of nothing.  A lost executor's files are
written anew.  Payloads are UTF-8, and segments are cut between code points.

Reading: each file is parsed by Content-Length.  A record in one segment is decoded at once; the
segments of others are grouped by origin identifier, ordered by number, checked against the total length
and decoded.  A group is one page, however many pages are alike.  A revisit is joined with the record that it
refers to, whose payload's length and digest it has; one that refers to no record is damage.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integer_id, keep, work_dir

REVISIT, SEGMENT, CHUNK, FILE_ROWS = 1000, 32 << 10, 8 << 10, 4000
EOL = "\r\n"
#: A gzip member of nothing, which ends a record's member in the files; its bytes as characters of ISO-8859-1.
NOTHING = (b"\x1f\x8b\x08" + bytes(5) + b"\x02\xff\x03" + bytes(9)).decode("latin-1")


def cut(data: bytes, size: int) -> list[bytes]:
    """data in pieces of at most size bytes that each are whole UTF-8 code points; one empty piece if there is nothing."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def framed(body: bytes, size: int) -> bytes:
    """Chunked transfer framing of a body."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in cut(body, size) if p) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """The body without its chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(piece)
        at = end + 4 + size


def record(kind: str, name: str, block: bytes, extra: dict) -> bytes:
    """A record, whole."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Length": len(block)} | extra
    return ("WARC/1.1" + EOL + "".join(f"{k}: {v}{EOL}" for k, v in head.items()) + EOL).encode() + block + b"\r\n\r\n"


def uri(url: str | None) -> str:
    return "".join((url or "about:blank").split())


def records(page_id: int | None, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int, chunk: int) -> list[bytes]:
    """The records of one page."""
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ({} if page_id is None else {"X-Page-ID": page_id}) | {"WARC-Target-URI": uri(url), "WARC-Payload-Digest": f"sha1:{coded}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        return [record("revisit", name, b"HTTP/1.1 200 OK\r\n\r\n", head | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"})]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload, chunk)
    pieces = cut(block, segment)
    if len(pieces) == 1:
        return [record("response", name, block, head)]
    out = [record("response", name, pieces[0], head | {"WARC-Segment-Number": 1})]
    for n, piece in enumerate(pieces[1:], 2):
        more = {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": n} | ({"WARC-Segment-Total-Length": len(block)} if n == len(pieces) else {})
        out.append(record("continuation", f"{name}:{n}", piece, more))
    return out


def written(batches, segment: int, chunk: int):
    for x in batches:
        page, name, url, html, digest, of = (x.column(i).to_pylist() for i in range(6))
        rows = [r for p, n, u, h, d, o in zip(page, name, url, html, digest, of, strict=True) for r in records(p, n, u, h or b"", d, o, segment, chunk)]
        yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r, 5, mtime=0) for r in rows], pa.binary()).view(pa.string())], ["value"])


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit: int = REVISIT, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write a record for each page, more for one that needs more segments, to gzip files in a folder."""
    integer_id(pages, page_id)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html")).withColumn("digest", F.sha1("html"))
    inside = F.to_json(F.struct("page_id", "url", "digest"))
    own = own.withColumn("name", F.concat(F.lit("urn:md5:"), F.md5(inside.cast("binary"))))
    long = own.where(F.octet_length("html") >= revisit)
    alike = long.groupBy("digest").agg(F.max(F.struct("page_id", "name")).alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    of = F.when((F.octet_length("html") >= revisit) & F.coalesce(F.col("page_id") != F.col("top.page_id"), F.col("top.page_id").isNotNull()), F.col("top.name"))
    told = own.join(alike, "digest", "left").select("page_id", "name", "url", "html", "digest", of.alias("of"))
    lines = told.mapInArrow(partial(written, segment=segment, chunk=chunk), "value string")
    lines.write.option("lineSep", NOTHING).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_ROWS).option("compression", "none").text(folder)


def unzipped(content: bytes, step: int = 1 << 14) -> bytes:
    """All members of a gzip file; a member is read a step at a time, since what follows it would be copied each time."""
    out, at = [], 0
    while at < len(content):
        one = zlib.decompressobj(31)
        while not one.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut short")
            out.append(one.decompress(content[at : at + step]))
            at = min(at + step, len(content))
        at -= len(one.unused_data)
    return b"".join(out)


def parsed(content: bytes):
    """(headers, block) of the records in a file, gzip or plain."""
    data = unzipped(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield head, block
        at = end + 4 + size + 4


SEGMENTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("whole", pa.bool_())])
SEGMENTS_ROW = "origin string, number int, total long, kind string, page_id long, refers_to string, digest string, block binary, whole boolean"


def number(head: dict, name: str) -> int | None:
    return int(head[name]) if name in head else None


def segments(batches):
    """Rows of SEGMENTS for each record of each file."""
    for x in batches:
        for content in x.column(0).to_pylist():
            rows, size = [], 0
            for head, block in parsed(content):
                name = head.get("warc-segment-origin-id", head["warc-record-id"]).strip("<>")
                digest = head.get("warc-payload-digest", "")
                rows.append({"origin": name, "number": number(head, "warc-segment-number") or 1, "total": number(head, "warc-segment-total-length"), "kind": head["warc-type"], "page_id": number(head, "x-page-id"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None, "block": block, "whole": "warc-segment-number" not in head})
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=SEGMENTS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=SEGMENTS)


def body_of(block: bytes) -> bytes:
    """Payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return unframed(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def decoded(origin: str, parts: list[dict], whole: bool) -> list[dict]:
    """The pages of a record's segments, with their payloads: one, but for a record that is in the archive repeatedly.

    A revisit has neither payload nor length; its digest is what its header says.
    """
    copies = sum(p["number"] == 1 for p in parts)
    parts = sorted(parts, key=lambda p: (p["number"], p["block"]))
    if [p["number"] for p in parts] != [n for n in range(1, len(parts) // max(1, copies) + 1) for _ in range(copies)]:
        raise ValueError(f"{origin}: segments are missing")
    parts = parts[::copies]
    first, last = parts[0], parts[-1]
    if not whole and last["total"] is None:
        raise ValueError(f"{origin}: segments are missing")
    block = b"".join(p["block"] for p in parts)
    if last["total"] is not None and len(block) != last["total"]:
        raise ValueError(f"{origin}: {len(block)} bytes instead of {last['total']}")
    out = {"record": origin, "page_id": first["page_id"], "record_type": first["kind"], "target": first["refers_to"], "payload": None, "payload_bytes": None, "payload_digest": first["digest"]}
    if first["kind"] != "revisit":
        body = body_of(block)
        digest = hashlib.sha1(body).hexdigest()
        if first["digest"] not in (None, digest):
            raise ValueError(f"{origin}: the payload doesn't have its digest")
        out |= {"payload": body, "payload_bytes": len(body), "payload_digest": digest}
    return [out] * copies


PAGES = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("payload", pa.binary())])
ROW = "record string, page_id long, payload_bytes long, payload_digest string, record_type string, target string, payload binary"


def pages_of(batches, payloads: bool):
    """Over rows (origin, parts, whole)."""
    for x in batches:
        rows = [p for r in x.to_pylist() for p in decoded(r["origin"], r.get("parts") or [r], "parts" not in r)]
        yield pa.RecordBatch.from_pylist(rows if payloads else [p | {"payload": None} for p in rows], schema=PAGES)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page of the record referred to) and payload of
    the pages in a folder of archives; without payloads, payload is null and the archives are decoded once, not twice."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(folder).select("content").mapInArrow(segments, SEGMENTS_ROW)
    inside = ("number", "total", "kind", "page_id", "refers_to", "digest", "block")
    many = rows.where("not whole").groupBy("origin").agg(F.collect_list(F.struct(*inside)).alias("parts"))

    def pages(whole_rows: DataFrame, with_payloads: bool) -> DataFrame:
        decode = partial(pages_of, payloads=with_payloads)
        return whole_rows.mapInArrow(decode, ROW).unionByName(many.mapInArrow(decode, ROW))

    own = rows.where("whole").drop("whole")
    known = keep(pages(own, False))
    answers = known.where("record_type <> 'revisit'")
    revisits = known.where("record_type = 'revisit'").select("page_id", "target", F.col("payload_digest").alias("said"))
    of = answers.select(F.col("record").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest")).dropDuplicates(["target"])
    joined = revisits.join(of, "target", "left")
    wrong = F.raise_error(F.concat(F.lit("a revisit refers to no record of its payload: "), F.coalesce("target", F.lit(""))))
    told = joined.select("page_id", F.when(F.col("bytes").isNull() | (F.col("said") != F.col("digest")), wrong.cast("long")).otherwise(F.col("bytes")).alias("payload_bytes"), F.col("said").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.lit(None).cast("binary").alias("payload"))
    responses = pages(own.where("kind <> 'revisit'"), True) if payloads else answers
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload").unionByName(told)


def archive(pages: DataFrame, payloads: bool = True, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read them back.

    Returns what read_archives() returns, a row per page.  page_id is of an integer type; others raise TypeError.  A null
    html is an empty payload, a null url about:blank.  A null page_id never is a response that others refer to, unless
    all pages with its payload have none, and then all are responses.  Rows with the same largest page_id are all
    responses.  Other columns are ignored.  An empty table gives no rows.  A damaged archive raises ValueError, in Spark
    as the cause of the failed job; so does a revisit of a record that is not there.
    """
    folder = work_dir(pages.sparkSession)
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder, payloads)
