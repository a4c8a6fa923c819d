"""Legacy archive converter: ARC records to WARC records, and readers of both.

An ARC file starts with a version block whose second line names the fields of
its record headers: five in version 1, ten in version 2.  A record is such a
line and as many bytes as it declares.  The converter synthesises what WARC has
beside that: identifiers (from archive and offset), dates, types, digests.  Of
records with equal payloads one is a response and the others revisit it.

Archives are read a record at a time from compressed bytes; files hold a bounded
number of records.  Which digests repeat is found by an aggregation of digests
alone; payloads are joined with the repeating digests only, whose table is
broadcast when it is counted to be small and joined by shuffle, which can be
split, when it is not.

Defined results: a null or empty page has an empty payload; a null url is
``unknown:``; white space in urls is percent-encoded; of repeated page ids with
equal payloads the first in the archives is the response; null ids come last; an
empty table gives no records; other columns of the pages, whatever their names, are
left out.  Archives may be plain or compressed.  In an ARC file a line that is no
record header is skipped; where the compressed bytes are damaged or end early the
archive ends, and its last record is marked truncated.  A version block without
field names leaves the fields as they were.  A block that does not start as an HTTP
response is all payload, and a resource.  Parts missing in a date are the first
ones.  A WARC file that is damaged fails the read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm.common import new_path, ship, stage

#: Field names of record headers by version: fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS_PER_FILE = 1000
#: Payloads of fewer bytes are responses even if they repeat.
LEAST_REVISIT_BYTES = 0
#: Repeating digests whose table is broadcast: about 100 bytes each.
BROADCAST_DIGESTS = 200_000
#: Bytes of records handed over at a time.
BATCH_BYTES = 8 << 20

PAGE_HEADER = "X-Page-Id"
NUMBER = re.compile(r"-?[0-9]{1,19}")
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
#: What a date in an archive is completed with.
FIRST_DATE = "19700101000000"
WRITE = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": str(RECORDS_PER_FILE)}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def version_block(version: int, name: str, date: str) -> str:
    body = f"{version} 0 spanledger\n{FIELDS[version]}\n"
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n{body}"


def arc_record(version: int, name: str, url: str | None, date: str, page: int | None, payload: str) -> str:
    length = len(payload.encode())
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:")
    own = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n{own}\r\n"
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"{url} 0.0.0.0 {date} text/html {more}{len(http) + length}\n{http}{payload}"


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000") -> None:
    """ARC files of (page_id, url, html), versions 1 and 2 in turn, each with its version block."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            lines, held = [], 0
            for page, url, html in zip(*batch.columns):
                # The writer begins a file every RECORDS_PER_FILE rows; a version block is its first.
                if rows % RECORDS_PER_FILE == 0:
                    file = rows // RECORDS_PER_FILE
                    version, name = 1 + (part + file) % 2, f"pages-{part:05d}-{file:05d}.arc.gz"
                    lines.append(version_block(version, name, date))
                    rows += 1
                lines.append(arc_record(version, name, url.as_py(), date, page.as_py(), html.as_py() or ""))
                rows += 1
                held += len(lines[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                    lines, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    own = pages.select(F.col("page_id").cast("long"), "url", "html")
    own.mapInArrow(run, "value string").write.options(**WRITE).option("lineSep", "\n").text(path)


class Inflated(io.RawIOBase):
    """The content of gzip members one after the other, as far as it is sound."""

    PIECE = 1 << 16

    def __init__(self, raw: memoryview, strict: bool):
        self._raw = raw
        self._strict = strict
        self._at = 0
        self._member = zlib.decompressobj(31)
        self._out = b""
        self._given = 0
        self._ended = False

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._given

    def readinto(self, into: memoryview) -> int:
        while not self._out and not self._ended:
            self._more()
        n = min(len(into), len(self._out))
        into[:n] = self._out[:n]
        self._out = self._out[n:]
        self._given += n
        return n

    def _more(self) -> None:
        if self._member.eof:
            # Members follow each other; zeros may fill up the end.
            while self._at < len(self._raw) and self._raw[self._at] == 0:
                self._at += 1
            if self._at == len(self._raw):
                self._ended = True
                return
            self._member = zlib.decompressobj(31)
        piece = bytes(self._raw[self._at : self._at + self.PIECE])
        if not piece:
            self._damaged()
            return
        before = self._member.copy()
        try:
            self._out = self._member.decompress(piece, 16 * self.PIECE)
            self._at += len(piece) - len(self._member.unused_data) - len(self._member.unconsumed_tail)
        except zlib.error:
            self._out = b"".join(self._sound(before, piece))
            self._damaged()

    @staticmethod
    def _sound(member: object, piece: bytes) -> Iterator[bytes]:
        """What a piece holds before its damage."""
        try:
            for k in range(len(piece)):
                yield member.decompress(piece[k : k + 1])
        except zlib.error:
            return

    def _damaged(self) -> None:
        if self._strict:
            raise ValueError("the compressed bytes are damaged or end early")
        self._ended = True


def opened(content: pa.Scalar, strict: bool = False) -> BinaryIO:
    """An archive's bytes, inflated where they are compressed; if ``strict``, damage is an error."""
    raw = content.as_buffer()
    if raw.size >= 2 and raw[:2].to_pybytes() == b"\x1f\x8b":
        return io.BufferedReader(Inflated(memoryview(raw), strict), 1 << 16)
    return io.BytesIO(raw)


def lines_of(file: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each line that is not empty; the caller may read on between lines."""
    at = file.tell()
    while line := file.readline():
        if line.strip():
            yield at, line.rstrip(b"\r\n")
        at = file.tell()


def read_arc(file: BinaryIO) -> Iterator[dict]:
    """Records of one ARC file: offset, url, ip, date, type, block, truncated."""
    fields = len(FIELDS[1].split())
    for offset, line in lines_of(file):
        if line.startswith(b"filedesc://"):
            size = line.rpartition(b" ")[2]
            # The second line of the block names the fields of the headers that follow.
            names = (file.read(int(size)) if size.isdigit() else b"").split(b"\n")[1:2]
            if names and len(names[0].split()) >= len(FIELDS[1].split()):
                fields = len(names[0].split())
            continue
        parts = line.rsplit(b" ", fields - 1)
        if len(parts) < fields or not parts[-1].isdigit():
            continue
        size = int(parts[-1])
        block = file.read(size)
        text = [p.decode("utf-8", "replace") for p in parts]
        yield {
            "offset": offset,
            "url": text[0],
            "ip": text[1],
            "date": text[2],
            "type": text[3],
            "block": block,
            "truncated": len(block) < size,
        }


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head (with its empty line), body and header fields of an HTTP response; a block of another kind is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    empty = EMPTY_LINE.search(block)
    head = block[: empty.end()] if empty else block
    fields = {}
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return head, block[len(head) :], fields


def page_of(fields: dict[str, str]) -> int | None:
    value = fields.get(PAGE_HEADER.lower(), "")
    if not NUMBER.fullmatch(value) or not -(1 << 63) <= int(value) < 1 << 63:
        return None
    return int(value)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,arc,warc}").load(path).select("path", "content")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns):
            rows = []
            for record in read_arc(opened(content)):
                _, body, fields = http_parts(record["block"])
                rows.append((base32_sha1(body), page_of(fields), len(body), path.as_py(), record["offset"]))
            yield pa.RecordBatch.from_pydict(
                dict(zip(DIGESTS.names, zip(*rows))) if rows else {n: [] for n in DIGESTS.names}, schema=DIGESTS
            )


DIGESTS = pa.schema(
    [("digest", pa.string()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("path", pa.string()), ("offset", pa.int64())]
)
RECORDS = pa.schema(
    [
        ("digest", pa.string()),
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("head", pa.string()),
        ("http", pa.binary()),
        ("body", pa.binary()),
    ]
)


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def warc_date(date: str) -> str:
    d = "".join(re.findall("[0-9]", date))[:14]
    d += FIRST_DATE[len(d) :]
    # No month or day is 00, though archives have them.
    month, day = (part if part != "00" else "01" for part in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a WARC record: header fields of any type, HTTP head, body."""
    for batch in batches:
        for path, content in zip(*batch.columns):
            name, rows, held = path.as_py(), [], 0
            for record in read_arc(opened(content)):
                http, body, _ = http_parts(record["block"])
                digest = base32_sha1(body)
                head = [
                    f"WARC-Record-ID: {record_id(name, record['offset'])}",
                    f"WARC-Date: {warc_date(record['date'])}",
                    f"WARC-Target-URI: {record['url']}",
                    f"WARC-IP-Address: {record['ip']}",
                    f"WARC-Payload-Digest: sha1:{digest}",
                    f"Content-Type: {'application/http; msgtype=response' if http else record['type']}",
                    *(["WARC-Truncated: length"] if record["truncated"] else []),
                ]
                rows.append((digest, name, record["offset"], "\r\n".join(head), http, body))
                held += len(body)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict(dict(zip(RECORDS.names, zip(*rows))), schema=RECORDS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(RECORDS.names, zip(*rows))), schema=RECORDS)


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_REVISIT_BYTES) -> None:
    """Write the records of the ARC files under ``arc`` as WARC files under ``warc``."""
    ship(spark)
    files = archives(spark, arc)
    # The response has the largest page id, and of those the first place in the archives.
    last = F.struct(F.col("page_id").isNotNull(), "page_id")
    every = files.mapInArrow(_digests, "digest string, page_id long, bytes long, path string, offset long")
    places = every.where(F.col("bytes") >= least).groupBy("digest", "page_id").agg(
        F.count("*").alias("n"), F.min(F.struct("path", "offset")).alias("place")
    )
    repeated = stage(
        places.groupBy("digest")
        .agg(F.sum("n").alias("n"), F.max_by("place", last).alias("place"))
        .where("n > 1")
        .select(F.col("digest").alias("of"), F.col("place.path").alias("to_path"), F.col("place.offset").alias("to_offset")),
        "repeated",
    )
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    records = files.mapInArrow(
        _records, "digest string, path string, offset long, head string, http binary, body binary"
    ).join(repeated, F.col("digest") == F.col("of"), "left")
    first = (F.col("path") == F.col("to_path")) & (F.col("offset") == F.col("to_offset"))
    revisit = F.col("of").isNotNull() & ~first
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "body"))
    refers = F.concat(
        F.lit("WARC-Refers-To: "),
        _record_id(F.col("to_path"), F.col("to_offset")),
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
    )
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).when(F.length("http") == 0, F.lit("resource")).otherwise(F.lit("response")),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.col("head"),
        F.lit("\r\nContent-Length: "),
        F.length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    value = F.concat(F.encode(head, "utf-8"), F.col("block")).cast("string")
    records.withColumn("block", block).select(value.alias("value")).write.options(**WRITE).option(
        "lineSep", "\r\n\r\n"
    ).text(warc)


def _record_id(path: Column, offset: Column) -> Column:
    """``record_id`` in SQL: a name-based UUID is a SHA-1 with the version and variant bits set."""
    name = F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(F.concat_ws("#", path, offset.cast("string")), "utf-8"))
    h = F.sha1(name)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-5"),
        F.substring(h, 14, 3),
        F.lit("-"),
        variant,
        F.substring(h, 18, 3),
        F.lit("-"),
        F.substring(h, 21, 12),
        F.lit(">"),
    )


def read_warc(file: BinaryIO) -> Iterator[dict]:
    """Records of one WARC file: header fields by lower-case name, and the block."""
    for _, line in lines_of(file):
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields | {"block": file.read(int(fields["content-length"]))}


READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("refers", pa.string()),
        ("url", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns):
            rows = []
            for record in read_warc(opened(content, strict=True)):
                _, body, http = http_parts(record["block"])
                declared = record["warc-payload-digest"].removeprefix("sha1:")
                size = None
                if record["warc-type"] != "revisit":
                    size = len(body)
                    if base32_sha1(body) != declared:
                        raise ValueError(f"{path.as_py()}: the payload of {record['warc-record-id']} is damaged")
                rows.append(
                    (
                        record["warc-record-id"],
                        record["warc-type"],
                        record.get("warc-refers-to"),
                        record["warc-target-uri"],
                        page_of(http),
                        size,
                        declared,
                    )
                )
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(READ.names, zip(*rows))), schema=READ)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``; payloads are checked against their digests.

    A revisit has no payload of its own, so its length is null here; see ``resolved``.
    """
    ship(spark)
    return archives(spark, path).mapInArrow(
        _read,
        "record_id string, record_type string, refers string, url string, page_id long, "
        "payload_bytes long, payload_digest string",
    )


def resolved(records: DataFrame) -> DataFrame:
    """Staged ``records``, where revisits have the payload's length and page from their response."""
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = records.where("record_type <> 'revisit'")
    found = responses.select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes")
    )
    revisits = records.where("record_type = 'revisit'").join(found, "refers").withColumn("payload_bytes", F.col("bytes"))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(revisits.select(*columns))


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read from its WARC record."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return resolved(stage(warc_records(spark, warc), "records"))
