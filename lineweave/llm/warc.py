"""Operator 5, WARC: a converter of legacy ARC archives, archives written and read back, revisits of equal payloads.

An ARC file begins with a `filedesc:` record whose body says which fields the header lines of its version have. Each
record is a header line, the declared number of bytes, a line feed. A converted record gets an identifier derived from
its place, an ISO timestamp, a type (by scheme and content) and SHA-1 digests.

Archives are written by Spark's text writer, one record a row and CRLF CRLF between rows, so each gzipped part is a WARC
file; they are read as a stream of pieces and cut into records by declared lengths, whatever the payloads hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, prepare, shared_dir, table

#: Fields of a header line by the version that a file's first record states.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
END = b"\r\n\r\n"
NO_DATE = "19700101000000"
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lineweave:warc")


@dataclass
class ArcRecord:
    """A record of an ARC file: its header fields (absent ones are not there), its place, the declared bytes, what is wrong."""

    version: int
    fields: dict[str, str]
    offset: int
    body: bytes
    error: str | None = None


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def __bytes__(self) -> bytes:
        """The record without the CRLF CRLF that ends it."""
        return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in self.headers.items())]).encode() + b"\r\n" + self.block


def sha1(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(version: int, url: str, body: bytes, date: str = NO_DATE, ip: str = "0.0.0.0", kind: str = "text/html", status: str = "200", location: str = "-", offset: int = 0, filename: str = "-") -> bytes:
    """The header line of an ARC record; what would break a field (blanks, control and non-ASCII characters) is percent-encoded."""
    safe = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-"
    own = {"url": safe, "ip": ip, "date": date, "type": kind, "status": status, "checksum": sha1(body), "location": location, "offset": str(offset), "filename": filename, "length": str(len(body))}
    return " ".join(own[f] for f in FIELDS[version]).encode() + b"\n"


def arc_head(version: int, name: str, date: str = NO_DATE) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 lineweave\n{NAMES[version]}\n".encode()
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body + b"\n"


class ArcReader:
    """Cuts the pieces of one ARC file into records by its version's header lines and declared lengths.

    Holds one record and one line. `version` is that of pieces which do not begin with a file's first record. What is no
    record is told in a record with `error` and without fields, and reading goes on at the next line that has a URL, a date
    and a length; a record that the file ends within has its fields, the bytes that are there, and `error`.
    """

    def __init__(self, version: int | None = None) -> None:
        self.version, self.at = version, 0  # at: bytes of the file before what is read next
        self.line = b""  # the beginning of a header line whose end is in a later piece
        self.record: ArcRecord | None = None
        self.parts: list[bytes] = []
        self.need = 0
        self.lost: ArcRecord | None = None
        self.first = False

    def header(self, line: bytes) -> tuple[dict[str, str], int]:
        """(fields, declared length) of a header line; ValueError for what is none."""
        parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        self.first = parts[0].startswith("filedesc:")
        # version blocks of either form occur in both versions
        names = next((n for n in FIELDS.values() if self.first and len(n) == len(parts)), FIELDS.get(self.version or 1 if self.first else self.version or 0))
        if names is None:
            raise ValueError(f"unknown ARC version {self.version}")
        if len(parts) < len(names):
            raise ValueError(f"{len(parts)} fields in a header line, where version {self.version} has {len(names)}")
        if not re.fullmatch("[0-9]{1,18}", parts[-1]):
            raise ValueError("no length in a header line")
        extra = len(parts) - len(names)  # unescaped blanks can only be in the URL
        values = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
        if not SCHEME.match(values["url"]) and (self.lost or values["url"] != "-") or self.lost and not re.fullmatch("[0-9]{4,14}", values["date"]):
            raise ValueError("no URL or date in a header line")
        return {k: v for k, v in values.items() if v != "-"}, int(parts[-1])

    def begin(self, line: bytes) -> Iterator[ArcRecord]:
        """Take a line between records: blank, a header line, or lost."""
        start = self.at
        self.at += len(line) + 1
        if not line.strip(b"\r"):  # what ends a record, or padding
            return
        try:
            fields, self.need = self.header(line)
        except ValueError as error:
            if self.lost is None:
                self.lost = ArcRecord(self.version or 0, {}, start, b"", str(error))
            return
        if self.lost:
            yield self.lost
        self.lost, self.parts = None, []
        self.record = ArcRecord(self.version or 0, fields, start, b"")

    def end(self) -> Iterator[ArcRecord]:
        """Give the record that is complete, or has what there is of it."""
        record, self.record = self.record, None
        if record is None:
            return
        record.body, self.parts = b"".join(self.parts), []
        if self.first:
            stated = re.match(rb"\s*(\d{1,9})", record.body)
            record.version = self.version = int(stated[1]) if stated else self.version or 0
            if self.version not in FIELDS:
                record.error = f"unknown ARC version {self.version}"
        if self.need:
            record.error = f"it declares {len(record.body) + self.need} bytes and has {len(record.body)}"
        self.need = 0
        yield record

    def feed(self, piece: bytes) -> Iterator[ArcRecord]:
        at = 0
        while at < len(piece) or (self.record and not self.need):
            if self.record is None:
                stop = piece.find(b"\n", at)
                if stop < 0:
                    self.line += piece[at:]
                    return
                line, self.line = self.line + piece[at:stop], b""
                at = stop + 1
                yield from self.begin(line)
                continue
            taken = piece[at : at + self.need]
            self.parts.append(taken)
            at, self.at, self.need = at + len(taken), self.at + len(taken), self.need - len(taken)
            if not self.need:
                yield from self.end()

    def close(self) -> Iterator[ArcRecord]:
        """What the end of the file leaves: a line without an end, a record within which it ends, lost lines."""
        if self.line:
            line, self.line = self.line, b""
            yield from self.begin(line)
        yield from self.end()
        if self.lost:
            yield self.lost
        self.lost = None


def parse_arc(data: bytes, version: int | None = None) -> Iterator[ArcRecord]:
    """The records of an ARC file, or of a piece of one whose version is given.

    ValueError for a header line with too few fields, a length that is no number, or fewer bytes than declared.
    """
    reader = ArcReader(version)
    for record in chain(reader.feed(data), reader.close()):
        if record.error:
            raise ValueError(f"the record at byte {record.offset}: {record.error}")
        yield record


def iso(date: str) -> str:
    """A 14-digit date (or a part of one) as WARC writes it."""
    digits = (re.sub(r"\D", "", date)[:14] or "1970").ljust(4, "0")
    digits += "0000"[: max(0, 4 - len(digits))] + "0101000000"[len(digits) - 4 :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def identifier(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, key)}>"


def payload_of(block: bytes, kind: str) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload) of an HTTP message; nothing and the block for others."""
    if "application/http" in kind:
        head, blank, payload = block.partition(END)
        if blank:
            return head + blank, payload
        head, blank, payload = block.partition(b"\n\n")
        if blank:
            return head + blank, payload
    return b"", block


def convert(record: ArcRecord, key: str) -> WarcRecord:
    """The WARC record that an ARC record amounts to; key: what names its place, from which the identifier is derived."""
    f, url = record.fields, record.fields.get("url", "")
    http = url.startswith(("http:", "https:")) and record.body.startswith(b"HTTP/")
    if url.startswith("filedesc:"):
        kind, content = "warcinfo", "application/warc-fields"
    elif http:
        kind, content = "response", "application/http; msgtype=response"
    else:
        kind, content = "resource", "text/dns" if url.startswith("dns:") else f.get("type", "application/octet-stream")
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier(key), "WARC-Date": iso(f.get("date", ""))}
    if kind == "warcinfo":
        head["WARC-Filename"] = url.removeprefix("filedesc://")
    else:
        head |= {"WARC-Target-URI": url or "-"}
        if f.get("ip", "0.0.0.0") != "0.0.0.0":
            head["WARC-IP-Address"] = f["ip"]
        head["WARC-Payload-Digest"] = f"sha1:{sha1(payload_of(record.body, content)[1])}"
    if record.error:
        head["WARC-Truncated"] = "unspecified"
    return WarcRecord(head | {"WARC-Block-Digest": f"sha1:{sha1(record.body)}", "Content-Type": content, "Content-Length": str(len(record.body))}, record.body)


def revisit(record: WarcRecord, key: str, page_id: int) -> WarcRecord:
    """A response without its payload, referring to the record that key names and, in a field of our own, to its page."""
    block = payload_of(record.block, record.headers["Content-Type"])[0]
    head = record.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": identifier(key), "X-Refers-To-Page": str(page_id), "WARC-Block-Digest": f"sha1:{sha1(block)}"}
    return WarcRecord(head | {"Content-Length": str(len(block))}, block)


def parse_warc(pieces: Iterable[bytes]) -> Iterator[WarcRecord]:
    """Records of a stream of pieces, by their declared lengths; holds no more than one record and one piece.

    ValueError for what is no record and for a stream that ends within one.
    """
    held, size, need, head = [], 0, 0, None

    def headers(raw: bytes) -> dict[str, str]:
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:60]!r}")
        return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < need:
            continue
        data, at = b"".join(held), 0
        while True:
            if head is None:
                while data[at : at + 2] == b"\r\n":  # a line reader may leave some of a blank line, no header begins so
                    at += 2
                stop = data.find(END, at)
                if stop < 0:
                    need = 0
                    break
                head, at = headers(data[at:stop]), stop + 4
            length = int(head["Content-Length"])
            if len(data) - at < length + 4:
                need = length + 4
                break
            if data[at + length : at + length + 4] != END:
                raise ValueError(f"record {head.get('WARC-Record-ID')} is longer than it declares")
            yield WarcRecord(head, data[at : at + length])
            head, at = None, at + length + 4
        held, size = [data[at:]], len(data) - at
    if head is not None or b"".join(held).strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .arc and .arc.gz files below a folder: (file, offset, version, fields map, body binary, error string).

    Gzipped files, of one gzip member or of one a record, are read from their start, each by one task. Others are split into
    blocks of lines, which an exchange on the file brings together in their order; a task streams through a file and holds
    a record. offset counts unzipped bytes. A row without fields tells with `error` of lines that are no record; one with
    fields and `error` is a record that the file ends within. Empty files have no rows. The line feed after the last
    record may be missing, unless that record ends with one itself: it is then told as one byte short.
    """
    prepare(spark)
    schema = "file string, offset long, version int, fields map<string,string>, body binary, error string"
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    names = ["file", "offset", "version", "fields", "body", "error"]

    def batch(file: str | None, found: list[ArcRecord]) -> pa.RecordBatch:
        columns = [[file] * len(found), [r.offset for r in found], [r.version for r in found], [list(r.fields.items()) for r in found], [r.body for r in found], [r.error for r in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file, found, size, feed = None, None, [], 0, b""
        for b in batches:
            data, offsets = bytes_of(b.column("line"))
            raw, files = memoryview(data), b.column("file").to_pylist()
            for k in range(b.num_rows):
                if reader is None or files[k] != file:
                    if reader is not None:
                        yield batch(file, found + list(reader.close()))
                    reader, file, found, size, feed = ArcReader(), files[k], [], 0, b""
                # a line's end goes before the next line, as the last line may have none
                for record in reader.feed(feed + bytes(raw[offsets[k] : offsets[k + 1]])):
                    found.append(record)
                    size += len(record.body) + 100
                feed = b"\n"
                if size > 8 << 20:
                    yield batch(file, found)
                    found, size = [], 0
        if reader is not None:
            yield batch(file, found + list(reader.close()))

    def lines(suffix: str) -> DataFrame:
        read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
        return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))

    zipped = lines(".arc.gz").select("file", "line").mapInArrow(records, schema)
    plain = lines(".arc").repartition("file").sortWithinPartitions("file", "block", "at").select("file", "line")
    return zipped.unionByName(plain.mapInArrow(records, schema))


def convert_arcs(arcs: DataFrame, path: str) -> DataFrame:
    """Write the records of read_arcs to gzipped WARC files in the folder `path`; the rows that tell of faults are returned.

    Identifiers come from a record's file and offset. Records that their file ends within are written with what there is
    of them and WARC-Truncated.
    """
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, offsets, versions, fields, errors = (b.column(c).to_pylist() for c in ("file", "offset", "version", "fields", "error"))
            out, size = [], 0
            for k, body in enumerate(b.column("body")):
                out.append(bytes(convert(ArcRecord(versions[k], dict(fields[k]), offsets[k], body.as_py(), errors[k]), f"{files[k]}:{offsets[k]}")))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = arcs.where(F.size("fields") > 0).mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.mode("errorifexists").option("lineSep", END.decode()).option("compression", "gzip").text(path)
    return arcs.where("error IS NOT NULL").select("file", "offset", "version", "error")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(hexed.substr(k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def http_message(page_id: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode() + payload


def page_key(page_id: int | None, place: int, rest: str) -> str:
    """What a page's identifier is derived from: its id, the hash of its URL and the payload's digest or a row."""
    return f"page:{page_id}:{place}:{rest}"


def page_record(page_id: int | None, url: str | None, payload: bytes, key: str, first: int | None, first_key: str) -> WarcRecord:
    """A page as the record of a legacy file (the version by its id), converted; a revisit if another page comes first."""
    version = 1 + (page_id or 0) % 2
    place = url if url and re.match(r"https?:", url) else f"http://invalid/{url or ''}"
    body = http_message(page_id, payload)
    legacy = next(parse_arc(arc_line(version, place, body) + body + b"\n", version))
    record = convert(legacy, key)
    return record if first is None or first == page_id else revisit(record, first_key, first)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """pages(page_id long, url string, html string, ...) -> gzipped WARC files in the folder `path`, a record for every row.

    Of pages with equal payloads of at least min_bytes bytes the smallest page_id is a response, the rest are revisits;
    smaller payloads are all responses. Rows that repeat page_id and payload have the same type; a null page_id is never
    the smallest, and a response if its payload has no other page. Null html: an empty payload. Null or other than http
    URLs are put under http://invalid/. The smallest ids are found on digests, map side first, and only digests that
several pages have are joined back; the join deals a hot digest again at run time. Identifiers of revisits, and of pages
    that no revisit can refer to but that repeat others, are their rows' own. Rows that repeat the id, URL and payload of a
    response that revisits refer to are that record written again, with its identifier; all others are unique.
    """
    spark = pages.sparkSession
    prepare(spark)
    all_pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"), F.xxhash64("url").alias("place"))
    all_pages = all_pages.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    firsts = all_pages.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("place", "page_id").alias("first_place"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("digest").alias("shared"), "first", "first_place")
    joined = all_pages.join(firsts, F.col("digest") == F.col("shared"), "left").select("page_id", "url", "payload", "place", "digest", "shared", "first", "first_place", F.monotonically_increasing_id().alias("row"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bytes_of(b.column("payload"))
            raw, out, size = memoryview(data), [], 0
            ids, urls, places, digests, shared, firsts, first_places, rows = (b.column(c).to_pylist() for c in ("page_id", "url", "place", "digest", "shared", "first", "first_place", "row"))
            for k in range(b.num_rows):
                own = digests[k].hex() if digests[k] else ""
                alone = digests[k] and (not shared[k] or ids[k] is not None and ids[k] == firsts[k])
                key = page_key(ids[k], places[k], own if alone else f"row {rows[k]}")
                out.append(bytes(page_record(ids[k], urls[k], bytes(raw[offsets[k] : offsets[k + 1]]), key, firsts[k], page_key(firsts[k], first_places[k], own))))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # the bytes are written as they are: a string column is bytes to the text writer
    lines = joined.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.mode("errorifexists").option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the gzipped WARC files in a folder, as (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A gzipped file is read by one task from its start, piece by piece; payload_bytes is the length of the payload, that
    of a revisit the one its HTTP head declares; the digest of a payload that is there is computed and must be the
    declared one (ValueError otherwise).
    """
    prepare(spark)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[bytes]:
            for b in batches:
                data, offsets = bytes_of(b.column("piece"))
                raw = memoryview(data)
                for k in range(b.num_rows):
                    yield bytes(raw[offsets[k] : offsets[k + 1]]) + END

        rows: list[tuple] = []
        for r in parse_warc(pieces()):
            head, payload = payload_of(r.block, r.headers["Content-Type"])
            declared = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            digest, kind = r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.headers["WARC-Type"]
            if kind != "revisit" and digest != sha1(payload):
                raise ValueError(f"the payload of {r.headers['WARC-Record-ID']} is not the one that was written")
            own = declared.get("x-page-id")
            refers = r.headers.get("X-Refers-To-Page") if kind == "revisit" else None
            rows.append((int(own) if own else None, int(declared["content-length"]) if kind == "revisit" else len(payload), digest, kind, int(refers) if refers else None))
            if len(rows) == 10000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("piece"))
    return read.mapInArrow(digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives at `path` and read them back."""
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives in the shared folder."""
    pages = table(spark, sf_dir, "pages")
    return archived(pages, f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")


OP5_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * k::INT, 5))::INT >> (15 - 5 * j)::INT) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
    FROM p
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM d JOIN f USING (h)
"""
