"""Web archives: legacy ARC files of versions 1 and 2, and their conversion to WARC.

An archive is one file of bounded size, in which each record is a gzip member of its own. Spark's text writer writes it as
one row whose bytes it does not look into, so payloads may be in any encoding, and driver and tasks
never open a path themselves; a zero byte ends the file, which gzip readers take as padding. It is read whole by the binary reader.

The converter reads each ARC file's version block, takes the fields of record headers by that
version, and cuts records by their declared lengths alone. A record becomes a WARC record with
an identifier made from its place in the archive, a date, a type, and SHA-1 digests of its block and
payload. Of records with equal payloads the one with the smallest page becomes the response and the others
refer to it; they are matched by digest and length, never by payload.

Archives are read twice: once for these facts, which are written, and once to convert them, when each file meets the list of
its own revisits. Payloads never leave the task that has read them. What cannot be read is reported with its place, and the rest goes on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.session import pin, scratch

ARCHIVE = 16 << 20  # bytes after which an archive is closed
#: The field names of the two versions' record headers.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL, PIECE = 1, 1 << 14  # of compression; bytes that are decompressed at a time
FACTS = "file string, at long, page_id long, payload_bytes long, payload_digest string, error string"
RECORD = "file string, at long, record_id string, page_id long, uri string, ip string, date string, mime string, version int, http binary, payload binary, payload_bytes long, payload_digest string, error string"


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _packed(pieces: Iterable[tuple[bytes, bytes]], joint: bytes) -> Iterator[pa.RecordBatch]:
    """Archives from (opening, record), one open archive for each opening; ``joint`` stands behind each record."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}

    def close(opening: bytes) -> pa.RecordBatch:
        del sizes[opening]
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held.pop(opening))], pa.binary())], ["value"])

    for opening, record in pieces:
        if opening not in held:
            held[opening] = [zlib.compress(opening + joint, LEVEL, 31)] if opening else []
        held[opening].append(zlib.compress(record + joint, LEVEL, 31))
        sizes[opening] = sizes.get(opening, 0) + len(record)
        if sizes[opening] >= ARCHIVE:
            yield close(opening)
    for opening in list(held):
        yield close(opening)


def _write(archives: DataFrame, path: str) -> None:
    """``value binary``, one archive a row. The cast keeps bytes as they are."""
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """What a file holds, whether it is compressed or not, and what is wrong with it if it cannot be read to its end."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        engine = zlib.decompressobj(31)
        try:
            while not engine.eof and at < len(data):
                piece = view[at : at + PIECE]
                out.append(engine.decompress(piece))
                at += len(piece) - len(engine.unused_data)
        except zlib.error as wrong:
            return b"".join(out), f"compressed data is broken: {wrong}"
        if not engine.eof:
            return b"".join(out), "compressed data ends early"
    return b"".join(out), None


def arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int, status: str = "-", name: str = "-") -> bytes:
    """One record header. Blanks in addresses are escaped, since fields are parted by one blank."""
    fields = [re.sub(r"[\s]", "%20", url) or "-", ip, date, mime]
    if version == 2:
        fields += [status, "-", "-", "0", name]
    return (" ".join([*fields, str(length)]) + "\n").encode()


def _opening(version: int) -> bytes:
    """The version block that an ARC file begins with."""
    block = f"{version} 0 waymeter\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(version, "filedesc://pages.arc", "0.0.0.0", "20240101000000", "text/plain", len(block), "200", "pages.arc") + block


def _arc_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    openings = {version: _opening(version) for version in FIELDS}

    def pieces():
        for batch in batches:
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                payload, page = (html.as_py() or "").encode(), page.as_py()
                version = 1 if page is not None and page % 2 else 2
                mark = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                yield openings[version], arc_line(version, url.as_py() or "-", "0.0.0.0", "20240101000000", "text/html", len(body), "200") + body

    yield from _packed(pieces(), b"\n")


def write_arc(pages: DataFrame, path: str) -> None:
    """Writes ``page_id, url, html`` as ARC files with HTTP headers; odd pages as version 1, the others as version 2."""
    _write(pages.select("page_id", "url", "html").mapInArrow(_arc_pieces, "value binary"), path)


def arc_records(data: bytes) -> Iterator[tuple]:
    """``place, uri, ip, date, mime, version, content, error`` of each record behind the version block.

    A header with other fields than its version has is reported, and skipped by its length. Where there is no
    length to go by, or less left than it says, the rest of the file is reported as one record.
    """

    def wrong(what: str) -> tuple:
        return at, None, None, None, None, version or None, b"", what

    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\0"):  # what parts two records, or ends the file
            at += 1
            continue
        end = data.find(b"\n", at)
        fields = data[at : max(end, at)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if end < 0 or not re.fullmatch("[0-9]{1,18}", fields[-1], re.ASCII):
            yield wrong("no record header")
            return
        length, content_at = int(fields[-1]), end + 1
        content = data[content_at : content_at + length]
        if len(content) < length:
            yield wrong(f"{length - len(content)} bytes of the record are missing")
            return
        if not version:
            number = content.split(b" ", 1)[0]
            if not fields[0].startswith("filedesc:") or number not in (b"1", b"2"):
                yield wrong("no version block of ARC 1 or 2")
                return
            version = int(number)
        elif len(fields) != len(FIELDS[version]):
            yield wrong(f"{len(fields)} header fields, not the {len(FIELDS[version])} of version {version}")
        else:
            named = dict(zip(FIELDS[version], fields))
            yield at, named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], version, content, None
        at = content_at + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP header block with its empty line (empty if there is none) and the payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def _page(http: bytes) -> int | None:
    found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", http)
    return int(found[1]) if found else None


def _rows(records: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about a block of payload."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += sum(len(x) for x in record if isinstance(x, bytes))
        if size > 1 << 21:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in text.split(", "))])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, str | None, list]]:
    """Path, content, what is wrong with it, and the list of marks if there is one."""
    for batch in batches:
        marks = batch.column(2) if batch.num_columns > 2 else None
        for i, (name, content) in enumerate(zip(batch.column(0), batch.column(1))):
            data, error = inflate(content.as_py())
            yield name.as_py(), data, error, (marks[i].as_py() or []) if marks is not None else []


def _arc(name: str, data: bytes, error: str | None) -> Iterator[tuple]:
    """The records of one file; a broken end of the compressed data is one more, which may hide records."""
    yield from arc_records(data)
    if error:
        yield len(data), None, None, None, None, None, b"", error


def _record_id(file: str, at: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{at}"))


def _read_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def facts():
        for name, data, error, _ in _files(batches):
            for at, *_, content, wrong in _arc(name, data, error):
                http, payload = split_http(content)
                yield name, at, _page(http), len(payload), digest(payload), wrong

    yield from _rows(facts(), _schema(FACTS))


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for name, data, error, _ in _files(batches):
            for at, uri, ip, date, mime, version, content, wrong in _arc(name, data, error):
                http, payload = split_http(content)
                yield name, at, _record_id(name, at), _page(http), uri, ip, date, mime, version, http, payload, len(payload), digest(payload), wrong

    yield from _rows(records(), _schema(RECORD))


def _open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below a folder, plain or compressed; one task reads a file whole.

    A record that cannot be read has its place and an ``error``, and no more.
    """
    return _open(spark, path).mapInArrow(_read_arc, RECORD)


def warc_record(kind: str, key: str, uri: str, ip: str, date: str, mime: str, http: bytes, payload: bytes, payload_digest: str, refers: str | None) -> bytes:
    """One record without the two line ends behind it."""
    block = http if kind == "revisit" else http + payload
    stamp = f"{date[0:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{key}>", f"WARC-Date: {stamp}", f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:uuid:{refers}>", f"WARC-Profile: {REVISIT}"]
    typed = "application/http; msgtype=response" if http else mime
    return "\r\n".join([*lines, f"Content-Type: {typed}", f"Content-Length: {len(block)}", "", ""]).encode() + block


def _warc_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for name, data, error, marks in _files(batches):
            refers = {m["at"]: _record_id(m["file"], m["first"]) for m in marks}
            for at, uri, ip, date, mime, _, content, wrong in _arc(name, data, error):
                if wrong is None:
                    http, payload = split_http(content)
                    kind = "revisit" if at in refers else "response" if http else "resource"
                    yield b"", warc_record(kind, _record_id(name, at), uri, ip, date, mime, http, payload, digest(payload), refers.get(at))

    yield from _packed(pieces(), b"\r\n\r\n")


def revisits(facts: DataFrame, least: int = 0) -> DataFrame:
    """``path, marks``: for each file the places of its revisits and of the records they refer to.

    Only (digest, length, place) are grouped. Records without a page come last, and of equal pages the first place.
    """
    good = facts.where(F.col("error").isNull() & (F.col("payload_bytes") >= least))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "at")
    firsts = good.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = good.join(firsts, ["payload_digest", "payload_bytes"]).where("file <> first.file or at <> first.at")
    mark = F.struct("at", F.col("first.file").alias("file"), F.col("first.at").alias("first"))
    return again.groupBy(F.col("file").alias("path")).agg(F.collect_list(mark).alias("marks"))  # at most one file's records


def with_marks(files: DataFrame, marks: DataFrame) -> DataFrame:
    """``path, content, marks`` for the conversion."""
    return files.join(marks, "path", "left").select("path", "content", "marks")


def convert(spark: SparkSession, source: str, path: str, least: int = 0) -> DataFrame:
    """Writes the records of all ARC files below a folder as WARC files; returns what could not be read: ``file, at, error``.

    Payloads below ``least`` bytes never become revisits.
    """
    files = _open(spark, source)
    facts = pin(files.mapInArrow(_read_facts, FACTS), "facts")
    marks = pin(revisits(facts, least), "marks")
    _write(with_marks(files, marks).mapInArrow(_warc_pieces, "value binary"), path)
    return facts.where("error is not null").select("file", "at", "error")


WARC = "record_id string, record_type string, uri string, date string, page_id long, refers string, declared string, payload binary"
WARC_FACTS = "record_id string, record_type string, page_id long, refers string, declared string, bytes long"


def warc_records(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, cut by the declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n" or data[at] == 0:
            at += 1 + (data[at] != 0)
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"{name}: the record at byte {at} is cut off")
        yield fields, block
        at = end + 4 + length


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``record_id, record_type, uri, date, page_id, refers, declared, payload``; a payload without its declared digest ends the job."""

    def bare(value: str | None) -> str | None:
        return value.removeprefix("<urn:uuid:").removesuffix(">") if value else None

    for name, data, error, _ in _files(batches):
        if error:
            raise ValueError(f"{name}: {error}")
        for f, block in warc_records(data, name):
            http, payload = split_http(block)
            declared = f["warc-payload-digest"].removeprefix("sha1:")
            if f["warc-type"] != "revisit" and digest(payload) != declared:
                raise ValueError(f"{name}: {f['warc-record-id']} does not have its declared digest")
            yield bare(f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri"), f["warc-date"], _page(http), bare(f.get("warc-refers-to")), declared, payload


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(_checked(batches), _schema(WARC))


def _read_warc_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    facts = ((key, kind, page, refers, declared, len(payload)) for key, kind, _, _, page, refers, declared, payload in _checked(batches))
    yield from _rows(facts, _schema(WARC_FACTS))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below a folder that this module wrote. Declared payload digests are checked against the payloads."""
    return _open(spark, path).mapInArrow(_read_warc, WARC)


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records that :func:`read_warc` reads.

    Revisits get the length and page of what they refer to. The files are read once, for facts without payloads.
    """
    facts = pin(_open(spark, path).mapInArrow(_read_warc_facts, WARC_FACTS), "read-back")
    target = facts.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full"))
    known = facts.where("record_type <> 'revisit'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = facts.where("record_type = 'revisit'").join(target, "refers", "left").select(
        "page_id", F.col("full").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to"
    )
    return known.union(again)


def convert_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages to ARC files, those to WARC files, and :func:`resolve` of what is read back from them.

    Null addresses are written as ``-``, null texts as empty payloads, and a null page as a record without a page. Every
    row gives one record, also repeated ones. Runs jobs when called; the files stay in ``folder`` (by default a new one in the shared folder).
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "archives")
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return resolve(spark, f"{folder}/warc")
