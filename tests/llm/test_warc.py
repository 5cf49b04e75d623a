import base64
import hashlib
import io
import json
import random
import zipfile

import pytest

from riskspark.llm.common import shared_path
from riskspark.llm.warc import (ARCHIVE, DESCRIPTOR, INDEX, PAGE_LIST, Package, open_package, parse_record, plan_records,
                                read_package, read_warc, search_key, spans, warc_round_trip, write_warc)

PAGES = "page_id long, url string, html string, key string, digest int"


def in_memory(data):
    return Package(lambda offset, length: data[offset:offset + length], len(data))


@pytest.mark.parametrize("wide", [False, True])
def test_directory_and_ranges(wide):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, method in (("a.bin", zipfile.ZIP_STORED), ("packed.txt", zipfile.ZIP_DEFLATED), (ARCHIVE, zipfile.ZIP_STORED)):
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            with z.open(info, "w", force_zip64=wide) as f:
                f.write(name.encode() * 50)
        z.comment = b"a comment PK\x05 at the end"
    p = in_memory(buf.getvalue())
    assert set(p.members) == {"a.bin", ARCHIVE}         # compressed members are not range-readable
    assert p.ranged(ARCHIVE, 3, 40) == (ARCHIVE.encode() * 50)[3:43]
    with pytest.raises(ValueError):
        p.ranged("a.bin", 200, 100)


def test_zip64_end_record():
    """More members than 16 bits count: the numbers stand in the ZIP64 record."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k in range(65_600):
            z.writestr(zipfile.ZipInfo(str(k)), b"%d" % k)
    p = in_memory(buf.getvalue())
    assert len(p.members) == 65_600
    assert p.ranged("65599", 0, 5) == b"65599"


def test_saturated_fields_take_the_extra_block():
    extra = (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"".join(x.to_bytes(8, "little") for x in (5, 6, 1 << 33))
    assert Package.wide(extra, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (6, 1 << 33)
    assert Package.wide(extra, 9, 8, 7) == (8, 7)


def test_not_a_package():
    with pytest.raises(ValueError):
        in_memory(b"x" * 100)


ROWS = [(5, "http://a/ b\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "u", "é" * 5000),
        (4, "u", "é" * 5000), (None, "n", "same"), (None, "n", "alone"), (7, "u", "x" * 300_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(a, b, c, "clash", 1) for a, b, c in ROWS], PAGES)
    got = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(df, min_revisit_bytes=least).collect()), key=repr)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        first = min(k for k, _, x in ROWS if (x or "").encode() == b and k is not None) if h != "alone" else None
        ref = first if len(b) >= least and first is not None and i != first else None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    assert got == sorted(want, key=repr)


def test_packages_are_real_files(spark):
    df = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 200) for k in range(300)], "page_id long, url string, html string")
    manifest = write_warc(plan_records(df), shared_path(spark, "warc"), package_bytes=2000)
    files = manifest.collect()
    assert sum(f.records for f in files) == 300 and len(files) > 3
    for headers, block, _, _ in read_package(files[0].path):
        assert block.decode() == f"page {headers['X-Record-Key']} " * 200
    with zipfile.ZipFile(files[0].path.removeprefix("file://").removeprefix("file:")) as z:
        assert z.testzip() is None and z.namelist() == [ARCHIVE, INDEX]
    assert read_warc(manifest).count() == 300


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_records_have_the_mandatory_headers(spark):
    df = spark.createDataFrame([(a, b, c, "clash", 1) for a, b, c in ROWS], PAGES)
    manifest = write_warc(plan_records(df), shared_path(spark, "warc-headers"), date="2020-02-03T04:05:06Z")
    records = []
    for r in manifest.collect():
        package, f = open_package(r.path)
        with f:
            records += [(*parse_record(package.ranged(ARCHIVE, at, n)), payload) for _, payload, at, n in read_package(r.path)]
    by_id = {h["WARC-Record-ID"]: h for h, *_ in records if h["WARC-Type"] == "response"}
    assert len(records) == len(ROWS) and any(h["WARC-Type"] == "revisit" for h, *_ in records)
    for h, block, read in records:
        assert h["WARC-Date"] == "2020-02-03T04:05:06Z" and h["WARC-Record-ID"].startswith("<urn:uuid:")
        if h["WARC-Type"] == "revisit":
            target = by_id[h["WARC-Refers-To"]]
            assert target["X-Record-Key"] == h["X-Refers-To-Key"] and target["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]
            assert target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and block == b""
        else:
            head, _, payload = block.partition(b"\r\n\r\n")
            assert payload == read and h["Content-Type"] == "application/http; msgtype=response" and head.startswith(b"HTTP/1.1 200 OK\r\n")
            assert f"Content-Length: {len(payload)}".encode() in head
            assert "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() == h["WARC-Payload-Digest"]


def test_neighbouring_records_share_a_range():
    rng = random.Random(3)
    for most in (1, 50, 10_000):
        at, places = 0, []
        for _ in range(200):
            n = rng.randint(1, 120)
            places.append((at, n))
            at += n + (7 if rng.random() < 0.1 else 0)      # a gap now and then
        rng.shuffle(places)
        out = list(spans(places, most))
        assert [p for _, _, inside in out for p in inside] == sorted(places)
        for start, length, inside in out:
            assert start == inside[0][0] and start + length == sum(inside[-1]) and length == sum(n for _, n in inside)
            assert length <= most or len(inside) == 1
        # no two neighbouring ranges could have been one
        assert all(a + n != b or n + inside[0][1] > most for (a, n, _), (b, _, inside) in zip(out, out[1:]))
    assert list(spans([])) == []


def test_search_keys():
    assert search_key("https://www.Example.org:8080/A b?q=1") == "org,example,www)/a%20b?q=1"
    assert search_key("http://example.org") == "org,example)/"
    assert search_key("") == "-" and search_key("no url") == "no%20url" and search_key("http://[bad") == "http://[bad"


def test_described_packages(spark):
    rows = [(k, f"http://host{k % 3}.example/p{k}", f"page {k // 2} " * 50) for k in range(40)] + [(40, None, "x" * 9000), (41, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_warc(plan_records(df), shared_path(spark, "warc-described"), package_bytes=2000, date="2020-02-03T04:05:06Z", described=True)
    listed, indexed = [], 0
    for r in manifest.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://").removeprefix("file:")) as z:
            assert z.testzip() is None and set(z.namelist()) == {ARCHIVE, INDEX, PAGE_LIST, DESCRIPTOR}
            told = json.loads(z.read(DESCRIPTOR))
            assert {m["path"] for m in told["resources"]} == {ARCHIVE, INDEX, PAGE_LIST}
            for m in told["resources"]:
                data = z.read(m["path"])
                assert m["bytes"] == len(data) and m["hash"] == "sha256:" + hashlib.sha256(data).hexdigest()
            head, *pages = [json.loads(x) for x in z.read(PAGE_LIST).decode().splitlines()]
            assert head["format"] == "json-pages-1.0" and all(p["ts"] == told["created"] == "2020-02-03T04:05:06Z" for p in pages)
            listed += [p["url"] for p in pages]
            lines = z.read(INDEX).decode().splitlines()
            assert lines == sorted(lines) and len(lines) == r.records
            archive = z.read(ARCHIVE)
            for line in lines:
                key, stamp, entry = line.split(" ", 2)
                e = json.loads(entry)
                h, _ = parse_record(archive[int(e["offset"]):int(e["offset"]) + int(e["length"])])
                assert stamp == "20200203040506" and key == search_key(e["url"]) and e["url"] == h["WARC-Target-URI"]
                assert e["digest"] == h["WARC-Payload-Digest"] and (e["mime"] == "warc/revisit") == (h["WARC-Type"] == "revisit")
                indexed += 1
    assert indexed == 42 and sorted(listed) == sorted([u or "" for k, u, _ in rows if k % 2 == 0 or k == 41])
    assert read_warc(manifest).count() == 42


def test_a_payload_larger_than_a_package(spark):
    big = "".join(random.Random(4).choices("abcdefghij ", k=3_000_000))
    df = spark.createDataFrame([(1, "u1", "a"), (2, "u2", big), (3, "u3", "b"), (4, "u4", big)], "page_id long, url string, html string")
    manifest = write_warc(plan_records(df), shared_path(spark, "warc-large"), package_bytes=1 << 16)
    got = {r.key: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in read_warc(manifest).collect()}
    digest = base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()
    assert got[2] == ("response", 3_000_000, digest, None) and got[4] == ("revisit", 3_000_000, digest, 2) and len(got) == 4
    assert max(r.bytes for r in manifest.collect()) > 1 << 16
