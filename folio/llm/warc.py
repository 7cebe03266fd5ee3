"""Legacy archive converter: ARC files in, WARC files out.

ARC (versions 1 and 2) starts with a version block that names the fields of the
record header lines; each record is one such line, a body of the declared
length and a newline. The converter parses the lines by the fields their own
file declares, reads bodies by declared length and synthesises the WARC record:
identifier (a name-based UUID of file, position, address and date), ISO date,
type, payload and block digests. Bodies of at least ``MIN_REVISIT`` payload
bytes that occur more than once become one response (largest page id) and
revisits that refer to it. Every record is its own gzip member.

Files are made by one task each in the shared folder and moved into place when
whole. Tables carry only headers and digests; which records are revisits is
sent to the task that converts their file.

Edge cases: a null page reads as empty; null urls become ``urn:page:<id>``,
spaces and control characters in urls are percent-encoded; rows repeating a
page_id are separate records (of equal payloads with the same largest id the
last by file and position is the response); a null page_id is smaller than any
other and read back as null; other columns are ignored; an empty table gives no
files and no rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.storage import Publication, by_file, open_folder, shared_folder, stored

# Header fields that the two ARC versions declare, media types
# and the revisit profile of the WARC standard.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RESPONSE_TYPE = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)

MIN_REVISIT = 1000
#: Uncompressed bytes after which a task would start its next file.
ROLL_BYTES = 64 << 20


class _Compressed:
    """A published file of gzip members, one per record."""

    def __init__(self, folder: str, name: str):
        self.name, self.size, self.records = name, 0, 0
        self.publication = Publication(folder, name)

    def add(self, raw: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.publication.write(packer.compress(raw) + packer.flush())
        self.size += len(raw)
        self.records += 1


def arc_record(version: int, url: str, date: str, content_type: str, body: bytes, name: str, offset: int, status: int = 200) -> bytes:
    checksum = base64.b32encode(hashlib.sha1(body).digest()).decode()
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": content_type, "Result-code": status,
              "Checksum": checksum, "Location": "-", "Offset": offset, "Filename": name, "Archive-length": len(body)}
    return " ".join(str(values[f]) for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 folio\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", EPOCH.strftime("%Y%m%d%H%M%S"), "text/plain", body, name, 0)


def arc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of every record after the version block, whose
    second line declares the fields. An address may hold spaces: fields are
    taken from the right."""
    first = stream.readline()
    if not first:
        return
    declared = stream.read(int(first.rsplit(b" ", 1)[1]))
    if not first.startswith(b"filedesc:"):
        raise ValueError("an ARC file begins with a filedesc record")
    fields = declared.split(b"\n")[1].decode().split(" ")
    stream.readline()
    while line := stream.readline():
        if line == b"\n":
            continue
        values = line[:-1].decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"malformed ARC header line: {line[:200]!r}")
        header = dict(zip(fields, values, strict=True))
        length = int(header["Archive-length"])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError("truncated ARC record")
        yield header, body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload of a record body."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def warc_date(arc_date: str) -> str:
    """14 (or 12) digit ARC date as an ISO instant."""
    return dt.datetime.strptime(arc_date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(name: str, position: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{position} {date} {url}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of every record, by declared length."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("truncated WARC record")
        yield fields, block


def convert(header: dict[str, str], body: bytes, name: str, position: int, refers: dict | None) -> bytes:
    """The WARC record of one ARC record; ``refers`` makes it a revisit."""
    url, date = header["URL"], warc_date(header["Archive-date"])
    head, payload = split_http(body)
    fields = [("WARC-Type", "revisit" if refers else "response" if head else "resource"), ("WARC-Record-ID", record_id(name, position, url, date)),
              ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", header["IP-address"]), ("WARC-Payload-Digest", _digest(payload))]
    if refers:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", refers["date"])]
    fields.append(("Content-Type", RESPONSE_TYPE if head else header["Content-type"]))
    return warc_record(fields, head if refers else body)


def _http(page_id: int | None, payload: bytes) -> bytes:
    mark = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _http_fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}


def _page_id(fields: dict[str, str]) -> int | None:
    return int(fields["x-page-id"]) if "x-page-id" in fields else None


def _open(folder: str, name: str):
    fs, base = open_folder(folder)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(f"{base}/{name}", compression=None)), 1 << 20)


def write_arc(pages: DataFrame, folder: str, *, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Pages as ARC files, the versions taking turns; returns (file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId(), [], None

        def close() -> None:
            if out is not None:
                out.publication.publish()
                made.append(out.name)

        for batch in batches:
            for piece in A.chunks(batch, "html"):
                data, offsets = A.flat(piece.column("html"))
                for i, (page_id, url) in enumerate(zip(piece.column("page_id").to_pylist(), piece.column("url").to_pylist(), strict=True)):
                    if out is None or out.size > ROLL_BYTES:
                        close()
                        version = versions[(part + len(made)) % len(versions)]
                        out = _Compressed(folder, f"pages-{part:06d}-{len(made):04d}.arc.gz")
                        out.add(arc_version_block(version, out.name))
                    address = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}"
                    date = (EPOCH + dt.timedelta(seconds=(page_id or 0) % 600_000_000)).strftime("%Y%m%d%H%M%S")
                    out.add(arc_record(version, address, date, "text/html", _http(page_id, data[offsets[i] : offsets[i + 1]].tobytes()), out.name, out.size))
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made)], names=["file"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(rows.mapInArrow(A.tidy(run), "file string"), "arc-manifest")


def arc_index(files: DataFrame, folder: str) -> DataFrame:
    """(file, position, page_id, payload_bytes, digest, id, url, date) per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "position", "page_id", "payload_bytes", "digest", "id", "url", "date"]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with _open(folder, name) as stream:
                    for position, (header, body) in enumerate(arc_records(stream)):
                        head, payload = split_http(body)
                        date = warc_date(header["Archive-date"])
                        rows.append((name, position, _page_id(_http_fields(head)), len(payload), hashlib.sha1(payload).hexdigest(), record_id(name, position, header["URL"], date), header["URL"], date))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return by_file(files.select("file")).mapInArrow(A.tidy(run), "file string, position long, page_id long, payload_bytes long, digest string, id string, url string, date string")


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(file, position, refers) of the records that repeat a payload."""
    large = index.filter(F.col("payload_bytes") >= min_bytes)
    kept = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "file", "position", "id", "url", "date")).alias("kept")).filter("n > 1")
    return large.select("digest", "file", "position").join(kept, "digest").filter("file <> kept.file OR position <> kept.position").select("file", "position", F.struct("kept.id", "kept.url", "kept.date").alias("refers"))


def write_warc(files: DataFrame, arc_folder: str, folder: str, again: DataFrame) -> DataFrame:
    """Convert every ARC file to a WARC file; returns (file)."""
    lists = again.groupBy("file").agg(F.collect_list(F.struct("position", "refers")).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, listed in zip(batch.column("file").to_pylist(), batch.column("again").to_pylist(), strict=True):
                refers = {x["position"]: x["refers"] for x in listed or []}
                out = _Compressed(folder, name.replace(".arc.gz", ".warc.gz"))
                info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(out.name, -1, "", "")), ("WARC-Date", warc_date("20000101000000")),
                        ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")]
                out.add(warc_record(info, b"software: folio\r\nformat: WARC File Format 1.1\r\n"))
                with _open(arc_folder, name) as stream:
                    for position, (header, body) in enumerate(arc_records(stream)):
                        out.add(convert(header, body, name, position, refers.get(position)))
                out.publication.publish()
                yield pa.RecordBatch.from_arrays([pa.array([out.name])], names=["file"])

    return stored(by_file(stored(files.join(lists, "file", "left"), "warc-plan")).mapInArrow(A.tidy(run), "file string"), "warc-manifest")


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, id, refers_id) of
    all response and revisit records. A revisit's payload figures are those of
    the full payload, from its headers; a response's digest is checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "id", "refers_id"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with _open(folder, name) as stream:
                    for fields, block in warc_records(stream):
                        if (kind := fields["warc-type"]) not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        http = _http_fields(head)
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        size = int(http["content-length"])
                        if kind == "response" and (size != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
                            raise ValueError(f"damaged payload in {name}")
                        rows.append((_page_id(http), size, digest, kind, fields["warc-record-id"], fields.get("warc-refers-to")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return by_file(files).mapInArrow(A.tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, id string, refers_id string")


def archive_digest(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    files = write_arc(pages, arc)
    again = revisits(stored(arc_index(files, arc), "arc-index"))
    made = write_warc(files, arc, warc, again)
    records = stored(read_warc(made, warc), "warc-records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    sources = records.filter("record_type = 'response'").select(F.col("id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    repeated = records.filter("record_type = 'revisit'").join(sources, "refers_id", "left").select(*columns, "refers_to")
    return records.filter("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(repeated)


def oracle_sql(min_bytes: int = MIN_REVISIT) -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
         max(page_id) OVER (PARTITION BY sha1(html), strlen(html)) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {min_bytes} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {min_bytes} AND page_id <> top THEN top END AS refers_to
FROM d
"""
