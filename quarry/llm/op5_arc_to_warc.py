"""WARC: a converter for legacy ARC archives.

``write_arc`` packs pages as ARC archives (version 1 or 2), ``index_arc`` reads
such archives by their version's header lines and declared lengths, and
``convert`` writes WARC 1.1 archives with identifiers, timestamps, types and
digests made from the ARC records; ``read_warc`` reads them back. Archives that
are written here are files of gzip members, one a record, in the shared folder;
those that are read may be plain or gzip, of one member or many, with any number
of records in each: an archive is one stream of header lines, blocks of the
declared length and line ends between them, and anything else is an error. A
record's position is its place in that stream. The records that share a payload
are found on the narrow index alone: payloads never shuffle.

Each archive holds at most ``records`` records and is rolled at ``roll_bytes``,
so one task's memory is bounded by its largest record. A task that is run again
writes the same file again under the same name.

Defined cases: null html is an empty payload. A null page_id has no header and
is read back as null; it ranks below all others. Rows that repeat a page_id
with an equal payload: the one that stands first in the archives is the
response. A null or blank url is written as ``-``; white space and control
characters in urls are percent-encoded. A record whose date is no number takes the
date of its archive's opening record, and its own goes into X-Archive-Date; where
that one is no number either, conversion fails. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, own_columns, small_batches

#: The crawl's date and host in synthetic ARC records.
ARC_DATE = "20240101000000"
ARC_IP = "192.0.2.1"
ROLL_BYTES = 32 << 20
RECORDS = 20_000
#: Payloads from this size on may be revisits.
LEAST_BYTES = 1000

INDEX = "archive string, position long, length long, page_id long, payload_bytes long, payload_digest string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def clean_url(url: str | None) -> str:
    """A url as one field of a header line."""
    url = (url or "").strip(" \t\r\n")
    return re.sub(r"[\x00-\x20\x7f]|[^\x00-\x7f]", lambda m: quote(m[0], safe="", errors="surrogatepass"), url) or "-"


# --- ARC ---------------------------------------------------------------------

ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def arc_head(version: int, name: str) -> bytes:
    """The record that opens an archive: it names the version and the fields of the header lines."""
    body = f"{version} 0 quarry\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain {len(body)}\n",
            2: f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return line.encode() + body


def arc_record(version: int, name: str, position: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
    common = f"{clean_url(url)} {ARC_IP} {ARC_DATE} text/html "
    line = common + {1: f"{len(block)}\n", 2: f"200 {hashlib.md5(block).hexdigest()} - {position} {name} {len(block)}\n"}[version]
    return line.encode() + block


def parse_arc_line(line: bytes, version: int) -> dict[str, str]:
    """The fields of a header line. Urls of old crawlers may hold blanks, so fields are taken from the end."""
    names = ARC_FIELDS[version]
    parts = line.decode("latin-1").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not a header line of ARC version {version}: {line[:80]!r}")
    return dict(zip(names, parts, strict=True))


def read_arc_version(member: bytes) -> int:
    """The version that the record opening an archive names, whichever fields its own line has."""
    if not member.startswith(b"filedesc://"):
        raise ValueError("an ARC archive opens with a filedesc record")
    line, _, body = member.partition(b"\n")
    version = int(body.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    parse_arc_line(line, version)
    return version


def split_arc(member: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """Fields and the block of the declared length."""
    line, _, rest = member.partition(b"\n")
    fields = parse_arc_line(line, version)
    n = int(fields["Archive-length"])
    if len(rest) < n:
        raise ValueError(f"a record of {n} bytes holds {len(rest)}")
    return fields, rest[:n]


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def members(f) -> Iterator[tuple[int, int, bytes]]:
    """(position, length, bytes) of each gzip member; holds one member at a time."""
    position, z, buf, length = 0, zlib.decompressobj(31), [], 0
    data = f.read(1 << 18)
    while data:
        buf.append(z.decompress(data))
        if not z.eof:
            length += len(data)
            data = f.read(1 << 18)
            continue
        length += len(data) - len(z.unused_data)
        yield position, length, b"".join(buf)
        data = z.unused_data or f.read(1 << 18)
        position, z, buf, length = position + length, zlib.decompressobj(31), [], 0
    if length:
        raise ValueError("an archive ends within a record")


def inflated(f) -> Iterator[bytes]:
    """The bytes of an archive, plain or of gzip members."""
    data = f.read(1 << 18)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = f.read(1 << 18)
        return
    z = zlib.decompressobj(31)
    while data:
        yield z.decompress(data)
        data = z.unused_data or f.read(1 << 18)
        if z.eof and data:
            z = zlib.decompressobj(31)
    if not z.eof:
        raise ValueError("an archive ends within a record")


class Stream:
    """Lines and counted bytes of an archive; holds one record at a time."""

    def __init__(self, f):
        self.more, self.buf, self.at, self.passed = inflated(f), b"", 0, 0

    def position(self) -> int:
        return self.passed + self.at

    def fill(self, n: int) -> bool:
        """Holds n bytes from here on, if there are so many."""
        parts, size = [self.buf[self.at:]], len(self.buf) - self.at
        if size >= n:
            return True
        for data in self.more:
            parts.append(data)
            size += len(data)
            if size >= n:
                break
        self.passed, self.at, self.buf = self.passed + self.at, 0, b"".join(parts)
        return size >= n

    def line(self) -> bytes:
        n = 1 << 10
        while (end := self.buf.find(b"\n", self.at)) < 0:
            if not self.fill(n):
                if (end := self.buf.find(b"\n", self.at)) < 0:
                    raise ValueError(f"an archive ends within a header line: {self.buf[self.at:][:80]!r}")
                break
            n *= 2
        line, self.at = self.buf[self.at:end + 1], end + 1
        return line

    def exactly(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError(f"a record of {n} bytes holds {len(self.buf) - self.at}")
        out, self.at = self.buf[self.at:self.at + n], self.at + n
        return out

    def ended(self) -> bool:
        """Whether nothing but line ends is left; passes those."""
        while self.fill(1):
            if self.buf[self.at] not in b"\r\n":
                return False
            self.at += 1
        return True


class Roller:
    """Writes records to archives of bounded size in a folder of any file system."""

    def __init__(self, folder: str, stem: str, suffix: str, opening, roll_bytes: int, records: int):
        self.fs, self.folder = _fs(folder)
        self.stem, self.suffix, self.opening, self.roll, self.most = stem, suffix, opening, roll_bytes, records
        self.k, self.out = 0, None

    def name(self) -> str:
        return f"{self.stem}-{self.k:05d}{self.suffix}"

    def open(self) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/_{self.name()}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size = self.n = 0
            self._put(self.opening(self.name(), self.k))

    def _put(self, record: bytes) -> int:
        z = gzip.compress(record, 6, mtime=0)
        self.out.write(z)
        self.size += len(z)
        return len(z)

    def write(self, record: bytes) -> None:
        self._put(record)
        self.n += 1
        if self.size >= self.roll or self.n >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name()}")
            self.out = None
            self.k += 1


def write_arc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, records: int = RECORDS) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ARC archives, by turns of version 1 and 2; a lazy DataFrame of their paths."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = lambda k: 1 + (part + k) % 2
        roller = Roller(folder, f"part-{part:06d}", ".arc.gz", lambda name, k: arc_head(version(k), name), roll_bytes, records)
        made = []
        for b in it:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                roller.open()
                name, k = roller.name(), roller.k
                if not made or made[-1] != name:
                    made.append(name)
                roller.write(arc_record(version(k), name, roller.size, page_id, url, (html or "").encode("utf-8", "surrogatepass")))
        roller.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in made], pa.string())], ["archive"])

    own = own_columns(pages, "page_id", "url", "html")
    return own.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "archive string")


def arc_records(path: str) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """position, length, fields, head and payload of each record of an ARC archive."""
    fs, p = _fs(path)
    with fs.open_input_stream(p, compression=None) as f:
        s = Stream(f)
        line = s.line()
        size = line.split()[-1]
        if not line.startswith(b"filedesc://") or not size.isdigit():
            raise ValueError("an ARC archive opens with a filedesc record")
        version = read_arc_version(line + s.exactly(int(size)))
        opened = parse_arc_line(line, version)["Archive-date"]
        while not s.ended():
            position = s.position()
            fields = parse_arc_line(s.line(), version)
            block = s.exactly(int(fields["Archive-length"]))
            if not fields["Archive-date"].isdigit():
                fields |= {"Own-date": fields["Archive-date"], "Archive-date": opened}
            yield position, s.position() - position, fields, *split_http(block)


def index_arc(archives: DataFrame) -> DataFrame:
    """A narrow row for each record of the archives (``archive``: path)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column(0).to_pylist():
                rows = []
                for position, length, _, head, payload in arc_records(path):
                    page = header(head, "X-Page-Id")
                    rows.append((path, position, length, None if page is None else int(page), len(payload), hashlib.sha1(payload).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                                 ["archive", "position", "length", "page_id", "payload_bytes", "payload_digest"])

    return archives.select("archive").mapInArrow(run, INDEX)


# --- WARC --------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    if not arc_date.isdigit():
        raise ValueError(f"no date: {arc_date!r}")
    d = (arc_date + "00000101000000"[len(arc_date):])[:14]  # a year or month alone begins it
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, position: int) -> str:
    """The same for the same ARC record, however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.rsplit("/", 1)[-1]}#{position}')}>"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, headers: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert_record(archive: str, position: int, fields: dict[str, str], head: bytes, payload: bytes, first: tuple[str, int, int | None] | None) -> bytes:
    """first: (archive, position, page_id) of the response that this record revisits."""
    kind = "revisit" if first else "response"
    block = head if first else head + payload
    return warc_record(kind, [
        ("WARC-Record-ID", record_id(archive, position)),
        ("WARC-Date", warc_date(fields["Archive-date"])),
        ("WARC-Target-URI", fields["URL"]),
        ("WARC-IP-Address", fields["IP-address"]),
        ("WARC-Payload-Digest", base32_sha1(payload)),
        ("WARC-Block-Digest", base32_sha1(block)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if first else None),
        ("WARC-Refers-To", record_id(first[0], first[1]) if first else None),
        ("X-Archive-Date", fields.get("Own-date")),
        ("X-Refers-To-Page", None if not first or first[2] is None else str(first[2])),
        ("Content-Type", "application/http; msgtype=response"),
    ], block)


def revisits(index: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The index with ``first``: the response that a record revisits, null if it is a response itself."""
    here = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("rank"), "page_id", "archive", "position")
    large = index.where(F.col("payload_bytes") >= least_bytes)
    # the largest page_id; of equal ones the first in the archives
    best = (large.groupBy("payload_digest")
            .agg(F.max(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("rank"), F.count("*").alias("n"))
            .where("n > 1"))
    first = (large.select("payload_digest", here.alias("h")).join(best, "payload_digest")
             .where("h.rank = rank").groupBy("payload_digest").agg(F.min("h").alias("h")))
    same = (F.col("h.archive") == F.col("archive")) & (F.col("h.position") == F.col("position"))
    return (index.join(first, (index.payload_digest == first.payload_digest) & (F.col("payload_bytes") >= least_bytes), "left")
            .select(index["*"], F.when(F.col("h").isNotNull() & ~same, F.col("h")).alias("first")))


def convert(index: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a WARC archive for each ARC archive of the index; a lazy DataFrame of their paths.
    A group is one archive's records, bounded by ``records`` of ``write_arc``."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        archive = key[0]
        first = {p: (a, int(q), None if pd.isna(g) else int(g)) for p, a, q, g in
                 zip(part.position, part.first_archive, part.first_position, part.first_page, strict=True) if a is not None}
        stem = archive.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".arc")

        def info(name: str, _: int) -> bytes:
            return warc_record("warcinfo", [("WARC-Record-ID", record_id(archive, 0)), ("WARC-Date", warc_date(ARC_DATE)), ("WARC-Filename", name),
                                            ("Content-Type", "application/warc-fields")], f"software: quarry\r\nsource: {stem}\r\n".encode())

        roller = Roller(folder, stem, ".warc.gz", info, 1 << 60, 1 << 60)
        roller.open()
        for position, _, fields, head, payload in arc_records(archive):
            roller.write(convert_record(archive, position, fields, head, payload, first.get(position)))
        name = roller.name()
        roller.close()
        return pd.DataFrame({"archive": [f"{folder}/{name}"]})

    flat = revisits(index, least_bytes).select(
        "archive", "position", F.col("first.archive").alias("first_archive"), F.col("first.position").cast("double").alias("first_position"),
        F.col("first.page_id").cast("string").alias("first_page"))
    return spread(flat, "archive").groupBy("archive").applyInPandas(run, "archive string")


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri and record_id of each response and revisit."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column(0).to_pylist():
                fs, p = _fs(path)
                rows = []
                with fs.open_input_stream(p, compression=None) as f:
                    for _, _, member in members(f):
                        head, rest = split_http(member)
                        kind = header(head, "WARC-Type")
                        if kind not in ("response", "revisit"):
                            continue
                        block = rest[:int(header(head, "Content-Length"))]
                        if base32_sha1(block) != header(head, "WARC-Block-Digest"):
                            raise ValueError(f"a block of {path} doesn't fit its digest")
                        http, payload = split_http(block)
                        digest = base64.b32decode(header(head, "WARC-Payload-Digest").removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a payload of {path} doesn't fit its digest")
                        page, to = header(http, "X-Page-Id"), header(head, "X-Refers-To-Page")
                        rows.append((None if page is None else int(page), int(header(http, "Content-Length")), digest, kind,
                                     None if to is None else int(to), header(head, "WARC-Target-URI"), header(head, "WARC-Record-ID")))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id"])

    return archives.select("archive").mapInArrow(run, READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to ARC archives, those to WARC archives, and these read back."""
    small_batches(spark)
    s = Scratch(spark, "op5")
    folders = {}
    for name in ("arc", "warc"):
        fs, p = _fs(s.path(name))
        fs.create_dir(p, recursive=True)
        folders[name] = s.path(name)
    s.table(write_arc(pages, folders["arc"]), "arcs")
    # one path a task: archives are read side by side, also when the table of paths is one small file
    each = lambda t: spread(s.read(t), "archive")
    index = s.table(index_arc(each("arcs")), "index")
    s.table(convert(index, folders["warc"]), "warcs")
    s.drop("arc", "arcs", "index")
    return read_warc(each("warcs"))


def spread(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism * 4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
