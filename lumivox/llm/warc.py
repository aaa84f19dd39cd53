"""Web archives in ZIP packages: written from pages, read back by byte ranges.

A package is a ZIP file with a stored WARC member, each record a gzip member of
its own, and an index member with a line per record. The reader parses the end
record, the ZIP64 records and the central directory itself, finds the stored
members, takes record offsets from the index and range-reads each record out of
the package; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import conf, filesystem, scratch, small_batches, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed value: the profile of a revisit record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0: stored, 8: deflated
    packed: int
    size: int
    header: int  # offset of the local header


def _zip64(extra: bytes, fields: list[int]) -> list[int]:
    """fields with those at 0xFFFFFFFF replaced, in order, from the ZIP64 extra field."""
    while len(extra) >= 4:
        kind, n = struct.unpack("<HH", extra[:4])
        if kind == 1:
            wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
            return [next(wide) if f == 0xFFFFFFFF else f for f in fields]
        extra = extra[4 + n :]
    return fields


def directory(f, size: int) -> dict[str, Member]:
    """Members of the ZIP file by name, from its central directory, ZIP64 or not. f: seek and read."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail = at(max(0, size - 65_557), min(size, 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[end - 20 : end] if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        wide = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no end record")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    elif 0xFFFF == count or 0xFFFFFFFF in (length, start):
        raise ValueError("a ZIP64 directory without a locator")
    entries, members, k = at(start, length), {}, 0
    for _ in range(count):
        if entries[k : k + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", entries[k + 10 : k + 12])[0]
        packed, size_, n, extra, comment = struct.unpack("<IIHHH", entries[k + 20 : k + 34])
        header = struct.unpack("<I", entries[k + 42 : k + 46])[0]
        name = entries[k + 46 : k + 46 + n].decode()
        size_, packed, header = _zip64(entries[k + 46 + n : k + 46 + n + extra], [size_, packed, header])
        members[name] = Member(name, method, packed, size_, header)
        k += 46 + n + extra + comment
    return members


def data_start(f, m: Member) -> int:
    """Where the member's bytes begin: the local header has lengths of its own for name and extra field."""
    f.seek(m.header)
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{m.name} has no local header")
    return m.header + 30 + sum(struct.unpack("<HH", local[26:30]))


def read_member(f, m: Member) -> bytes:
    f.seek(data_start(f, m))
    raw = f.read(m.packed)
    return raw if m.method == 0 else zlib.decompress(raw, -15)


NO_ID = "none"


def record_id(page: int | None) -> str:
    return f"<urn:page:{NO_ID if page is None else page}>"


def page_of(uri: str) -> int | None:
    return None if (page := uri.removeprefix("<urn:page:").rstrip(">")) == NO_ID else int(page)


def build_record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP header, whose Content-Length is the payload's, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {refers_url}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record's fields by RECORD's names; a response whose payload doesn't have its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int({k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    out = {"page_id": page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload_bytes": length, "payload_digest": digest}
    if out["record_type"] == "revisit":
        return out | {"refers_to": page_of(fields["warc-refers-to"]), "payload": None}
    if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"page {out['page_id']}: the payload doesn't have its digest")
    return out | {"refers_to": None, "payload": payload}


class PackageWriter:
    """One package, written as a stream: the WARC member grows with each record, its index is held and comes last."""

    def __init__(self, path: str):
        fs, root = filesystem(path)
        self.path, self.stream, self.index, self.at = path, fs.open_output_stream(root), [], 0
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, page: int | None, url: str, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": page, "url": url, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        info = zipfile.ZipInfo(INDEX)
        info.compress_type = zipfile.ZIP_DEFLATED
        self.zip.writestr(info, "\n".join(self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()

    def row(self) -> pd.DataFrame:
        return pd.DataFrame({"package": [self.path], "records": [len(self.index)], "bytes": [self.at]})


def with_roles(pages: DataFrame, least: int = 1000, salts: int = 16) -> DataFrame:
    """page_id, url, html, digest, size, refers_to, refers_url: which record of equal payloads carries them.

    Of rows with equal payloads of `least` bytes or more, that with the largest
    page_id (all that share it, all if none has one); refers_to is null for it and for all smaller payloads. Digests are
    counted before the join, only repeated ones are joined, and rows are salted, so
    a payload on a third of all rows goes to many tasks.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html").cast("long")})
    seen = p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n"))
    seen = seen.where("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(seen, ["digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return p.select("page_id", "url", "html", "digest", "size", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def write_packages(pages: DataFrame, out: str, package_bytes: int = 1 << 27) -> DataFrame:
    """Writes every page as a record into packages in the shared folder `out`; returns (package, records, bytes).

    A package is closed at package_bytes. The rows returned name packages of
    finished attempts only; what a lost attempt left is in no row. Null html is
    an empty payload, null url an empty one; a null page_id is written and read back as
    none, its payload a revisit of a page that has an id; repeated rows give repeated records.
    """
    small_batches(pages.sparkSession)
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, group, package = TaskContext.get(), 0, None
        for b in batches:
            columns = (b[c].tolist() for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url"))
            for page, url, html, digest, refers, refers_url in zip(*columns):
                if package is None:
                    package = PackageWriter(f"{out}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{group:05d}.wacz")
                url = " ".join(url.split())
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                package.add(page, url, build_record(page, url, html.encode(), digest, refers, " ".join((refers_url or "").split())))
                if package.at >= package_bytes:
                    package.close()
                    yield package.row()
                    package, group = None, group + 1
        if package is not None:
            package.close()
            yield package.row()

    return written(with_roles(pages).mapInPandas(run, "package string, records long, bytes long"), "warc-packages")


PER_TASK, CHUNK, TASK_BYTES = 4, 1 << 20, 1 << 26  # packages whose index a task reads; archive bytes that stay together, and of a task


def index(packages: DataFrame) -> DataFrame:
    """(package, page, offset, length) of each record; the offset is the byte's in the package itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["package"]:
                fs, root = filesystem(path)
                with fs.open_input_file(root) as f:
                    members = directory(f, f.size())
                    if members[ARCHIVE].method:
                        raise ValueError(f"{path}: {ARCHIVE} isn't stored")
                    start = data_start(f, members[ARCHIVE])
                    lines = [json.loads(x) for x in read_member(f, members[INDEX]).decode().split("\n") if x]
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pd.DataFrame({"package": path, "page": pd.array([x["page"] for x in part], dtype="Int64"), "offset": [start + x["offset"] for x in part], "length": [x["length"] for x in part]})

    spread = packages.select("package").repartition(max(1, -(-packages.count() // PER_TASK)), "package")
    return spread.mapInPandas(run, "package string, page long, offset long, length long")


def read_records(places: DataFrame, payload: bool = True) -> DataFrame:
    """Range-reads the records at `places` (package, offset, length), checks and parses them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            got = []
            for path, rows in b.to_pandas().groupby("package"):
                fs, root = filesystem(path)
                with fs.open_input_file(root) as f:
                    for offset, length in sorted(zip(rows["offset"], rows["length"])):
                        f.seek(offset)
                        r = parse_record(gzip.decompress(f.read(length)))
                        got.append(r if payload else r | {"payload": None})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in got], k) for n, k in zip(names, kinds)], names)

    spark = places.sparkSession
    small_batches(spark)
    return places.mapInArrow(run, RECORD)


def spread_places(places: DataFrame, packages: DataFrame) -> DataFrame:
    """The places dealt into so many tasks that each has TASK_BYTES of archive, but no fewer than the session's shuffle partitions."""
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    n = max(int(conf(places.sparkSession, "spark.sql.shuffle.partitions") or 1), -(-size // TASK_BYTES))
    return places.repartition(n, "package", F.floor(F.col("offset") / CHUNK))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into packages and reads every record back; see write_packages for nulls and repeated rows."""
    packages = write_packages(pages, scratch(pages.sparkSession, "warc"))
    return read_records(spread_places(index(packages), packages), payload=False).drop("payload")


def open_packages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the packages at the given paths in a shared folder."""
    return read_records(index(spark.createDataFrame([(p,) for p in paths], "package string")))
