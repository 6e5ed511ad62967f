"""Legacy web archives (ARC) to WARC.

ARC files begin with a version block that names the fields of the header lines
after it: version 1 has URL, IP address, date, type and length, version 2 adds
result code, checksum, location, offset and file name. A record is such a line and
as many bytes as it declares. Each becomes a WARC record with an identifier, time
stamp, type and digest made from its own content, so conversion can be repeated.
Copies of a payload become ``revisit`` records that refer to the first one.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.joins import split_join
from rookery.session import scratch_path

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Bytes after which the writer starts another archive, so no row grows with the data.
ARCHIVE_BYTES = 4 << 20
#: Records of one WARC file at most.
FILE_RECORDS = 2000
# Field names of the two ARC versions, as the version block lists them.
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
    "Filename Archive-length",
}
_DATE = "20240101000000"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- ARC ----------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 converter\n{_FIELDS[version]}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Content-type": "text/plain"}
    return _arc_record(version, head, body)


def _arc_record(version: int, head: dict[str, str], content: bytes) -> bytes:
    values = head | {"Archive-date": _DATE, "Archive-length": str(len(content))}
    line = " ".join(values.get(f, "-") for f in _FIELDS[version].split())
    return line.encode() + b"\n" + content + b"\n"


def arc_response(version: int, url: str | None, page_id, payload: bytes) -> bytes:
    """ARC record of an HTTP response. White space in the URL is percent-encoded, as the
    header line is cut at blanks."""
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}\r\n"
    shown = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-")
    head = {"URL": shown, "IP-address": "0.0.0.0", "Content-type": "text/html"}
    return _arc_record(version, head | {"Result-code": "200"}, http.encode() + payload)


def read_arc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, by declared lengths. The field names
    come from the version block of the file."""
    fields, at = None, 0
    while at < len(archive):
        if archive[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = archive.index(b"\n", at)
        values = archive[at:end].decode().split(" ")
        size = int(values[-1])
        content = archive[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError("the archive ends inside a record")
        at = end + 1 + size
        if fields is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("no version block")
            fields = _FIELDS[int(content.split(b" ", 1)[0])].split()
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in a header line, {len(fields)} declared")
        yield dict(zip(fields, values, strict=True)), content


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", content)


# --- WARC ---------------------------------------------------------------------


def warc_record(fields: dict[str, str], content: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def read_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, by ``Content-Length``."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        content = archive[end + 4 : end + 4 + size]
        if len(content) != size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not have its declared length")
        yield fields, content
        at = end + 8 + size


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


# --- DataFrames ---------------------------------------------------------------


def to_arc(pages: DataFrame) -> DataFrame:
    """Pages as ARC archives of bounded size: one row ``archive`` (binary) for each.

    Archives take turns between the two versions. A null url is ``-``, a null html
    an empty payload."""

    def write(batches):
        out: list[bytes] = []
        size, number, version = 0, 0, 1
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not out:
                    version = 1 + number % 2
                    out, size = [arc_version_block(version, f"pages-{number}.arc")], 0
                out.append(arc_response(version, url, page_id, (html or "").encode()))
                size += len(out[-1])
                if size > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)])], ["archive"])
                    out, number = [], number + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)])], ["archive"])

    return pages.select("page_id", "url", "html").mapInArrow(write, "archive binary")


def convert(archives: DataFrame) -> DataFrame:
    """Records of ARC archives (column ``archive``) as rows of what a WARC record needs:
    ``page_id, url, date, record_id, digest, payload_bytes, http, payload``."""

    def rows(batches):
        for batch in batches:
            for value in batch.column(0):
                found: list[tuple] = []
                size = 0
                for fields, content in read_arc(value.as_buffer().to_pybytes()):
                    http, payload = split_http(content)
                    page = re.search(rb"X-Page-Id: (-?\d+)\r\n", http)
                    page_id = int(page[1]) if page else None
                    digest = hashlib.sha256(payload).hexdigest()
                    date = _warc_date(fields["Archive-date"])
                    where = fields["URL"], date, _record_id(page_id, digest), digest
                    found.append((page_id, *where, len(payload), http.decode(), payload.decode()))
                    size += len(content)
                    if size > ARCHIVE_BYTES // 4:
                        yield _batch(found)
                        found, size = [], 0
                yield _batch(found)

    return archives.mapInArrow(
        rows,
        "page_id long, url string, date string, record_id string, digest string, "
        "payload_bytes long, http string, payload string",
    )


_KINDS = dict(
    page_id=pa.int64(), url=pa.string(), date=pa.string(), record_id=pa.string(),
    digest=pa.string(), payload_bytes=pa.int64(), http=pa.string(), payload=pa.string(),
)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType] = _KINDS) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def first_copies(pages: DataFrame) -> DataFrame:
    """``digest, first_id`` of payloads of ``REVISIT_BYTES`` and more that several pages
    share. Only digests are shuffled, summed before: a payload may be in any share of pages."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return (
        pages.filter(F.octet_length("html") >= REVISIT_BYTES)
        .select("page_id", F.sha2(html, 256).alias("digest"))
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )


def write_warc(records: DataFrame, first: DataFrame, path: str) -> None:
    """WARC files of converted records under ``path``; later copies become revisits.

    The content of a record is UTF-8, so that the text source can write the files:
    one row is one record, whose last line feed is the row's end."""
    joined = split_join(records, first, ["digest"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def record_text(batches):
        names = ["page_id", "url", "date", "record_id", "digest", "http", "payload", "first_id"]
        for batch in batches:
            out = []
            for page_id, url, date, name, digest, http, payload, first_id in zip(
                *(batch.column(n).to_pylist() for n in names), strict=True
            ):
                fields = {"WARC-Type": "response" if first_id is None else "revisit"}
                fields |= {"WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": url}
                fields |= {"WARC-Payload-Digest": f"sha256:{digest}"}
                if page_id is not None:
                    fields["X-Page-Id"] = str(page_id)
                fields["X-Payload-Length"] = str(len(payload.encode()))
                if first_id is not None:
                    fields["WARC-Profile"] = _REVISIT_PROFILE
                    fields["WARC-Refers-To"] = _record_id(first_id, digest)
                    fields["X-Refers-To-Page-Id"] = str(first_id)
                    payload = ""
                fields["Content-Type"] = "application/http; msgtype=response"
                out.append(warc_record(fields, (http + payload).encode())[:-1].decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (
        joined.withColumn("first_id", F.when(again, F.col("first_id")))
        .mapInArrow(record_text, "value string")
        .write.option("compression", "gzip")
        .option("lineSep", "\n")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def read_files(spark, path: str) -> DataFrame:
    """Records of all WARC files under ``path``: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``. The length and digest of a payload that is there are
    taken from its bytes and held against the header."""

    def rows(batches):
        kinds = dict(
            page_id=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string(),
            record_type=pa.string(), refers_to=pa.int64(),
        )
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for value in batch.column(0):
                found = []
                for fields, content in read_warc(gzip.decompress(value.as_buffer())):
                    size = int(fields["X-Payload-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response":
                        payload = split_http(content)[1]
                        if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']}")
                    refers = number(fields.get("X-Refers-To-Page-Id"))
                    page = number(fields.get("X-Page-Id"))
                    found.append((page, size, digest, fields["WARC-Type"], refers))
                yield _batch(found, kinds)

    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.gz")
        .load(path)
        .select("content")
        .mapInArrow(
            rows,
            "page_id long, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long",
        )
    )


def archived(pages: DataFrame) -> DataFrame:
    """Every page through an ARC archive into WARC files and read back from these.

    Columns as in ``read_files``, one row per page. A null html is an empty payload, a
    null url ``-``, a null page_id stays null and is never the first copy unless all
    are null; of rows with equal page_id and payload all are responses. Other columns
    are not looked at. No pages give no rows. The files lie in the shared scratch folder.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    path = scratch_path(spark, "warc")
    write_warc(convert(to_arc(pages)), first_copies(pages), path)
    return read_files(spark, path)
