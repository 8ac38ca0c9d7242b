"""WARC records in ZIP packages: a writer, and a reader that parses the central and ZIP64 directories and range-reads records.

A package holds `archive/data.warc.gz` (stored; one gzip member a record), `indexes/index.cdxj` (stored; where each record
lies) and `datapackage.json`. The reader reads a package's end, its directory and its index, then only the records' ranges;
nothing is extracted. A task reads one part of a package's index, so that neither packages nor tasks need be of one size. Packages lie in a folder that driver and executors share; a task that is run again writes packages of its
own, and only those of finished tasks are in the manifest.

Cases: a null html is the empty payload, and equal payloads, empty ones too, have one response and revisits; a null url gives a
record without target; null page_ids are kept as such; rows that repeat a page_id are responses each; an empty table makes no
package; very long payloads are one record each; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import scratch, stored

PACKAGE_BYTES = 64 << 20
#: What a task reads, about; a package is read in parts of its index.
PART_BYTES = 8 << 20
MOST_PARTITIONS = 100_000
READ_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record, a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    page = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
    }


class Package:
    """A package being written; memory holds its index only."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at = [], 0

    def add(self, page_id, raw: bytes) -> None:
        self.member.write(raw)
        self.index.append(f"{page_id} {self.at} {len(raw)}\n")
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        listed = {"profile": "data-package", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX, "records": len(self.index)}]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(listed))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.index), self.at


def directory(file) -> dict[str, tuple[int, int]]:
    """name -> (place of the local header, size) of a ZIP file's stored members, from its central directory."""
    end = file.size()
    tail_at = max(0, end - 65535 - 22 - 20)
    tail = file.read_at(end - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("not a ZIP file")
    count, size, place = struct.unpack_from("<HII", tail, at + 10)
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", tail, locator + 8)
        count, size, place = struct.unpack_from("<QQQ", file.read_at(56, where), 32)
    entries, at, found = file.read_at(size, place), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", entries, at + 10)[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", entries, at + 20)
        (header,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra, k = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: the fields that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        if method == 0:
            found[name] = (header, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def data_place(file, header: int) -> int:
    head = file.read_at(30, header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header at this place")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return header + 30 + n_name + n_extra


def records(uri: str, lo_byte: int = 0, hi_byte: int | None = None):
    """The records of a package, by its index, that begin from lo_byte to before hi_byte of the archive; neighbouring ranges are read
    together, READ_BYTES at most."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        members = directory(file)
        base = data_place(file, members[DATA][0])
        at, size = members[INDEX]
        lines = [x.split(" ") for x in file.read_at(size, data_place(file, at)).decode().splitlines()]
        ranges = [(int(x[1]), int(x[2])) for x in lines if lo_byte <= int(x[1]) and (hi_byte is None or int(x[1]) < hi_byte)]
        k = 0
        while k < len(ranges):
            lo = ranges[k][0]
            j = k
            while j + 1 < len(ranges) and ranges[j + 1][0] + ranges[j + 1][1] - lo <= READ_BYTES:
                j += 1
            data = file.read_at(ranges[j][0] + ranges[j][1] - lo, base + lo)
            for place, n in ranges[k : j + 1]:
                yield parse(data[place - lo : place - lo + n])
            k = j + 1


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """The manifest, stored: package, records, bytes. Equal payloads: the smallest page_id's is the response, others revisit it."""
    folder = folder or scratch(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    shared = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    typed = rows.join(stored(shared), "sha", "left")
    typed = typed.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        package, done = None, []
        for batch in batches:
            for page_id, url, html, refers in zip(*(c for c in batch.columns)):
                payload, refers = html.as_py().encode(), refers.as_py()
                package = package or Package(folder)
                package.add(page_id.as_py(), record(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), refers, refers is not None))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["package", "records", "bytes"])

    return stored(typed.mapInArrow(write, "package string, records long, bytes long"))


def read_packages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with payload, the payload of every record."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = [k for k in kinds if payload or k != "payload"]

    def read(batches):
        for batch in batches:
            for uri, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                some, size = [], 0
                for r in records(uri, lo, hi):
                    some.append(r)
                    size += len(r["payload"])
                    if size > READ_BYTES or len(some) >= 10_000:
                        yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in some], pa.schema([(k, kinds[k]) for k in names]))
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in some], pa.schema([(k, kinds[k]) for k in names]))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    parts = F.sequence(F.lit(0), F.floor((F.greatest("bytes", F.lit(1)) - 1) / PART_BYTES))
    ranges = manifest.select("package", F.explode(parts).alias("part")).select("package", (F.col("part") * PART_BYTES).alias("lo"), ((F.col("part") + 1) * PART_BYTES).alias("hi"))
    return ranges.repartition(max(1, min(ranges.count(), MOST_PARTITIONS))).mapInArrow(read, schema)


def query(spark, sf_dir):
    manifest = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_packages(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, CAST(CAST(from_hex(h) AS BIT) AS VARCHAR) AS bits FROM h)
SELECT page_id, n AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: CASE WHEN substring(bits, 5 * i + k + 1, 1) = '1' THEN 1 << (4 - k) ELSE 0 END))::BIGINT, 1)), '') AS payload_digest FROM f"""
