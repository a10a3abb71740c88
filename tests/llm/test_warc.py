import base64
import gzip
import hashlib
import io
import json
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyarrow import fs

from tiza.llm import warc
from tiza.llm.common import shared_dir

PAGES = [
    (1, "http://a/ b\r\nX: y%0A", "same"),
    (2, "http://a/2", "same"),
    (3, None, None),
    (4, "http://a/4", ""),
    (None, "http://a/5", "same"),
    (5, "http://a/6", "é" * 50_000 + "\r\n\r\nrest"),
    (6, "http://a/7", "alone"),
    (6, "http://a/7", "alone"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, revisit int")


def expected(rows):
    out = Counter()
    for i, url, html in rows:
        b = (html or "").encode()
        last = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        old = last is not None and (i is None or i < last)
        out[i, "revisit" if old else "response", last if old else None, url, base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b), None if old else b] += 1
    return out


def test_round_trip(spark):
    got = warc.read_packages(warc.write_packages(pages(spark), shared_dir(spark), package_bytes=100))
    assert Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.collect()) == expected(PAGES)


def test_empty(spark):
    assert warc.read_packages(warc.write_packages(pages(spark).limit(0), shared_dir(spark))).count() == 0


def test_small_payloads_stay_responses(spark):
    got = warc.read_packages(warc.write_packages(pages(spark), shared_dir(spark), min_bytes=5)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}


def test_packages_are_zip_and_gzip(spark):
    manifest = warc.write_packages(pages(spark), shared_dir(spark))
    for r in manifest.collect():
        store, p = fs.FileSystem.from_uri(r.path)
        with store.open_input_file(p) as f:
            raw = f.read_at(f.size(), 0)
            members = warc.directory(f, f.size())
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert z.testzip() is None and set(z.namelist()) == set(members) == {warc.DATA, warc.INDEX}
            for n, (at, size, _, method) in members.items():
                assert method == 0
                assert z.read(n) == raw[at : at + size]


def test_zip64_directory():
    """More members than 16 bits count and a comment after the end record."""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.comment = b"c" * 300
        for i in range(66_000):
            z.writestr(f"m{i}", str(i))
        z.writestr("packed", "z" * 100, zipfile.ZIP_DEFLATED)
    with pa.BufferReader(b.getvalue()) as f:
        members = warc.directory(f, f.size())
        assert len(members) == 66_001 and members["packed"][3] == 8
        at, size, *_ = members["m65999"]
        assert f.read_at(size, at) == b"65999"


def standard_package(path, index="plain", archive=zipfile.ZIP_STORED):
    """A package as other tools lay it out: several archives, numbers as strings, a warcinfo record, folders, pages and an index of any packing."""
    made, lines = {}, []
    for name in ("a.warc.gz", "b.warc.gz"):
        data = b""
        for k in range(3):
            body = f"<p>{name} {k}</p>".encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
            kind = ["response", "warcinfo", "resource"][k]
            mime = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields", "resource": "text/html"}[kind]
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            own = block if kind == "response" else body
            head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}-{k}>\r\nwarc-target-uri: http://h/{name}/{k}\r\n"
            head += (f"WARC-Payload-Digest: sha1:{digest}\r\n" if kind == "response" else "") + f"Content-Type: {mime}\r\nContent-Length: {len(own)}\r\n\r\n"
            member = gzip.compress(head.encode() + own + b"\r\n\r\n")
            lines.append(f"h)/{name}/{k} 20200101000000 " + json.dumps({"url": f"http://h/{name}/{k}", "filename": name, "offset": str(len(data)), "length": str(len(member)), "digest": digest}))
            data += member
            made[f"http://h/{name}/{k}"] = (kind, digest, len(body), body)
        with zipfile.ZipFile(path, "a") as z:
            z.writestr(f"archive/{name}", data, archive)
    raw = ('!OpenWayback-CDXJ 1.0\n' + "\n".join(sorted(lines)) + "\n").encode()
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("indexes/", "")
        if index == "gzip":
            z.writestr("indexes/index.cdx.gz", gzip.compress(raw))
            z.writestr("indexes/index.idx", "h)/ 20200101000000 {}")
        elif index == "deflated":
            z.writestr("indexes/index.cdxj", raw, zipfile.ZIP_DEFLATED)
        elif index:
            z.writestr("indexes/index.cdxj", raw)
    return made


@pytest.mark.parametrize("index", ["plain", "deflated", "gzip"])
def test_packages_of_others(spark, tmp_path, index):
    path = str(tmp_path / "p.wacz")
    want = standard_package(path, index)
    got = warc.read_packages(spark.createDataFrame([(f"file://{path}",)], "path string"), fetch_bytes=200).collect()
    assert {r.url: (r.record_type, r.payload_digest, r.payload_bytes, bytes(r.payload)) for r in got} == want and len(got) == 6


def test_packages_that_cannot_be_read_raise(tmp_path):
    for name, options, error in (("c", {"archive": zipfile.ZIP_DEFLATED}, "compressed by the package"), ("n", {"index": None}, "no index")):
        standard_package(tmp_path / name, **options)
        with pa.OSFile(str(tmp_path / name)) as f, pytest.raises(ValueError, match=error):
            warc.index_lines(name, f)
    with zipfile.ZipFile(tmp_path / "x", "w") as z:
        z.writestr("indexes/index.cdxj", "h)/ 2020 {}")
    with pa.OSFile(str(tmp_path / "x")) as f, pytest.raises(ValueError, match="without filename"):
        warc.index_lines("x", f)
    whole = warc.record(1, "http://a", b"payload", None, False)
    assert warc.parse(whole)[4:] == (base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), 7, b"payload")
    with pytest.raises(ValueError, match="another digest"):
        warc.parse(whole.replace(b"\r\n\r\npayload", b"\r\n\r\nPayload"))
    with pytest.raises(ValueError, match="not a WARC record"):
        warc.parse(whole[5:])


def test_many_tasks_fetch(spark):
    many = [(i, f"http://a/{i}", f"text {i} " * 50) for i in range(300)]
    out = warc.read_packages(warc.write_packages(pages(spark, many), shared_dir(spark)), fetch_bytes=5000)
    assert out.rdd.getNumPartitions() > 5 and out.count() == 300


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    want = Counter((k[0], k[1], k[2], k[4], k[5]) for k in expected(rows))
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in warc.op10_warc(spark, sf_dir).collect()) == want
