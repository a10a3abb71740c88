"""WARC records in ZIP packages: written by tasks, found through the packages' own directories, read by byte range.

A package is a ZIP file with a stored (uncompressed) member archive/data.warc.gz, one gzip member per record, and
indexes/index.cdxj, one line per record: a sort key, a timestamp and JSON with filename, offset and length. A reader looks up
the end record, the ZIP64 records and the central directory, then every index, and fetches single records by offset; nothing
is extracted. Indexes may be deflated or gzipped, filenames count from archive/. Archives must be stored, as a range of a
deflated member can't be read; such a package, one without an index, and an index of unknown form raise errors rather than
give fewer records. Listing and fetching are separate steps: places are dealt out by the bytes they stand for, so large
packages are read by many tasks.

Packages go to a folder that all executors share. A task writes a file named after its attempt and returns its path; only
paths of finished tasks are in the manifest, so a lost executor leaves at most an unlisted file.

Null payloads are empty. Null page_ids are kept. Of equal payloads those rows with the largest page_id are responses. A
payload's digest is worked out from the bytes that were read, and an error where the header states another one; a revisit
has no payload, so its digest and length are those that its header states.
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
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import checkpointed, join_by_key, shared_dir, table

PACKAGE_BYTES = 256_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PLACES = "path string, offset bigint, length bigint"
#: Bytes of records that one task fetches.
FETCH_BYTES = 16_000_000
RECORDS = "page_id bigint, record_type string, refers_to bigint, url string, payload_digest string, payload_bytes bigint, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the response's HTTP header, which states the payload's length, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, type, refers_to, url, digest, payload length, payload or None) of a WARC record; page_ids are null in records of other writers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record: wrong offset?")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind, block = fields["warc-type"], rest[: int(fields["content-length"])]
    payload = block
    stated = None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    name = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") and x != "<urn:page:none>" else None
    url = fields.get("warc-target-uri")
    if url is not None and fields["warc-record-id"].startswith("<urn:page:"):
        url = url.replace("%20", " ").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        return name(fields["warc-record-id"]), kind, name(fields.get("warc-refers-to")), url, digest, stated, None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and len(digest) == len(own) and ":" not in digest and digest != own:
        raise ValueError(f"the payload of {url} has another digest than its header states")
    return name(fields["warc-record-id"]), kind, name(fields.get("warc-refers-to")), url, own, len(payload), payload


def sort_key(url: str) -> str:
    """The url with its host's labels reversed, in lower case and without blanks, by which index lines are sorted."""
    host, slash, rest = url.partition("://")[2].partition("/") if "://" in url else (url, "", "")
    return "".join(quote(x, safe="!$&'()*+,-./:;=?@_~%") for x in (",".join(reversed(host.lower().split("."))), ")", slash or "/", rest.lower()))


def place_line(url: str | None, offset: int, length: int) -> str:
    return f"{sort_key(url or '-')} {DATE.translate(str.maketrans('', '', '-:TZ'))} " + json.dumps({"url": url or "", "filename": DATA.removeprefix("archive/"), "offset": str(offset), "length": str(length)})


def _store(path: str) -> tuple:
    """The filesystem of a URI and the path within it; s3a and s3n mean s3."""
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def _writer(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        rows = (r for b in batches for r in b.to_pylist())
        number, row = 0, next(rows, None)
        while row is not None:
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.zip"
            with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                lines, at = [], 0
                with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes:
                        data = gzip.compress(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["ref"], row["revisit"]), mtime=0)
                        member.write(data)
                        lines.append(place_line(row["url"], at, len(data)))
                        at += len(data)
                        row = next(rows, None)
                with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                    member.write("".join(f"{x}\n" for x in sorted(lines)).encode())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])
            number += 1

    return run


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) plus revisit and ref, the page_id of the response that holds the same payload.

    Payloads meet by their SHA-1 with counts and largest ids only; a payload on a third of all pages is served by join_by_key's broadcast."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.withColumn("digest", F.sha1(body)).withColumn("bytes", F.length(body))
    groups = p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    out = join_by_key(p, groups, "digest", "n")
    older = (F.col("bytes") >= min_bytes) & F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return out.select("page_id", "url", "html", older.alias("revisit"), F.when(older, F.col("last")).alias("ref"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages below `folder`; returns the manifest (path), itself kept in the checkpoint folder."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return checkpointed(with_revisits(p, min_bytes).mapInArrow(_writer(folder, package_bytes), "path string"))


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (offset of the member's data, its size there, crc, method: 0 stored, 8 deflated), from a ZIP file's central directory."""
    at = lambda start, n: file.read_at(n, start)
    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):  # the ZIP64 locator stands before the end record
        mark, _, where, _ = struct.unpack("<4sIQI", at(tail_at + end - 20, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        count, length, start = struct.unpack("<QQQ", at(where, 56)[32:56])
    central, p, members = at(start, length), 0, {}
    for _ in range(count):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, crc, packed, plain = struct.unpack("<H4xIII", central[p + 10 : p + 28])
        n, m, k, offset = struct.unpack("<HHH8xI", central[p + 28 : p + 46])
        name, extra = central[p + 46 : p + 46 + n].decode(), central[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:  # ZIP64 sizes stand in the order plain, packed, offset, each only where the 32-bit field is full
            kind, wide = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{wide // 8}Q", extra[4 : 4 + wide // 8 * 8]))
                plain, packed, offset = (next(values) if x == 0xFFFFFFFF else x for x in (plain, packed, offset))
            extra = extra[4 + wide :]
        p += 46 + n + m + k
        # the local header's name and extra field may differ in length from the central ones
        a, b = struct.unpack("<HH", at(offset + 26, 4))
        members[name] = (offset + 30 + a + b, packed, crc, method)
    return members


def index_lines(path: str, f) -> list[tuple[int, int]]:
    """(offset in the package, length) of every record that the package's indexes name."""
    members = directory(f, f.size())
    found, out = False, []
    for name, (start, size, crc, method) in members.items():
        if not name.startswith("indexes/") or name.endswith(("/", ".idx")):
            continue
        raw = f.read_at(size, start)
        if method not in (0, 8):
            raise ValueError(f"{path}: {name} is packed by method {method}")
        raw = zlib.decompress(raw, -15) if method else raw
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: {name} is damaged")
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        found = True
        for line in raw.decode().split("\n"):
            if not line.strip() or line.startswith("!"):
                continue
            text = line[line.find("{") :]
            try:
                x = json.loads(text)
                archive, at, length = x["filename"], int(x["offset"]), int(x["length"])
            except (ValueError, KeyError) as e:
                raise ValueError(f"{path}: {name} has a line without filename, offset and length: {line[:80]}") from e
            archive = archive if archive in members else f"archive/{archive}"
            if archive not in members:
                raise ValueError(f"{path}: {archive}, which {name} names, isn't there")
            if members[archive][3]:
                raise ValueError(f"{path}: {archive} is compressed by the package, so its records can't be read by range")
            out.append((members[archive][0] + at, length))
    if not found:
        raise ValueError(f"{path} has no index")
    return out


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, p = _store(path)
            with store.open_input_file(p) as f:
                places = index_lines(path, f)
            columns = [pa.array([path] * len(places), pa.string()), pa.array([o for o, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "length"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    path, f = None, None

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        rows, held = [], 0
        for r in batch.to_pylist():
            if r["path"] != path:
                if f:
                    f.close()
                store, p = _store(r["path"])
                path, f = r["path"], store.open_input_file(p)
            rows.append(parse(gzip.decompress(f.read_at(r["length"], r["offset"]))))
            held += len(rows[-1][6] or b"")
            if held > 8_000_000:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)
    if f:
        f.close()


def read_packages(manifest: DataFrame, fetch_bytes: int = FETCH_BYTES) -> DataFrame:
    """Every record of the packages in manifest(path). Places are dealt out by range, so neighbours are read by one task, of which there are as many as their bytes ask for."""
    places = checkpointed(manifest.mapInArrow(_list, PLACES))
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 1) // fetch_bytes)
    return places.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(_fetch, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_packages(table(spark, sf_dir, "pages"), shared_dir(spark))
    return read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The hex digits of a SHA-1 as base 32: 40 bits, 10 hex digits, make 8 characters.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
e AS (SELECT *, list_aggregate(list_transform(range(4), lambda g: list_aggregate(list_transform(range(8), lambda k:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (('0x' || h[1 + 10 * g : 10 + 10 * g])::BIGINT // (1::BIGINT << (35 - 5 * k)::INT)) % 32]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
        max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to FROM e"""
