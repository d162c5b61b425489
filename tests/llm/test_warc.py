import base64
import hashlib
import os
import random

import pytest

from millrace.llm.warc import frames, parse_record, read_archives, record_bytes, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, size long, sha1 string, newest long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 7) for r in rows], SCHEMA)


def rows():
    rng = random.Random(3)
    out = [(1, None, None), (2, "http://a b/\r\nX: 1", ""), (3, "u", "<p>é日本\r\n\r\n</p>"), (4, "u", "<p>é日本\r\n\r\n</p>"), (5, "v", "x" * 200_000), (5, "v", "tie"), (5, "w", "tie"), (6, "w", "tie")]
    return out + [(100 + i, f"http://h/{i}", f"<html>{rng.randrange(40)} {'body ' * 30}</html>") for i in range(300)]


def want(pages, least=0):
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    data = [(i, (h or "").encode()) for i, _, h in pages]
    newest = {}
    for i, x in data:
        newest[x] = max(i, newest.get(x, i))
    out = []
    for i, x in data:
        other = newest[x] if len(x) >= least and newest[x] != i else None
        out.append((i, len(x), digest(x), "response" if other is None else "revisit", other or 0))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    got = round_trip(table(spark, rows()), min_bytes=least).collect()
    assert all(r.error is None for r in got)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == want(rows(), least)


def test_small_archives_and_payloads(spark, tmp_path):
    folder = str(tmp_path / "w")
    made = write_archives(table(spark, rows()).repartition(2), folder, archive_bytes=4000, sample_bytes=20_000).collect()
    assert len(made) > 3 and sum(r.records for r in made) == len(rows()) == read_archives(spark, folder).count()
    names = sorted(os.listdir(folder))
    assert [n for n in names if n.endswith(".zst")] == sorted(r.archive for r in made) and not any(n.endswith(".tmp") for n in names)
    for r in read_archives(spark, folder, payloads=True).where("record_type = 'response'").collect():
        assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest


def test_damage_is_told(spark, tmp_path):
    folder = str(tmp_path / "w")
    write_archives(table(spark, rows()).coalesce(1), folder, sample_bytes=10_000).collect()
    name = f"{folder}/{next(n for n in sorted(os.listdir(folder)) if n.endswith('.zst'))}"
    data = open(name, "rb").read()
    at = [a for a, _ in frames(memoryview(data))]
    with open(name, "wb") as f:
        f.write(data[: at[5] + 20])
    got = read_archives(spark, folder).collect()
    assert sum(r.error is not None for r in got) == 1 and sum(r.error is None for r in got) == 5


@pytest.mark.parametrize(("old", "new"), [(b"WARC/1.1", b"WARC/9"), (b"sha1:", b"md5:"), (b"Content-Length: 4\r\n\r\nbody", b"Content-Length: 5\r\n\r\nbody"), (b"WARC-Date", b"WARC-Dat"), (b"body", b"bodx"), (b"WARC-Type: response", b"WARC-Type: odd")])
def test_bad_records(old, new):
    good = record_bytes(1, "u", b"body", 4, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), None, "1970-01-01T00:00:00Z")
    assert parse_record(good).payload == b"body"
    with pytest.raises(ValueError):
        parse_record(good.replace(old, new, 1))


def record(kind, block, *headers, version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "WARC-Date: 2020-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_other_record_types():
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    info = parse_record(record("warcinfo", b"software: x\r\n\r\nmore", "Content-Type: application/warc-fields"))
    assert (info.kind, info.page_id, info.record_id, info.size, info.digest) == ("warcinfo", None, "<urn:uuid:1-2>", 19, sha(b"software: x\r\n\r\nmore"))
    asked = parse_record(record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"))
    assert asked.kind == "request" and asked.size == 18
    # no payload digest and no length in the HTTP header
    got = parse_record(record("response", b"HTTP/1.1 200 OK\r\nX: \xe9\r\n\r\nbody", "Content-Type: application/http"))
    assert (got.payload, got.size, got.digest) == (b"body", 4, sha(b"body"))
    assert parse_record(record("response", b"1.2.3.4", "Content-Type: text/dns")).payload == b"1.2.3.4"
    again = parse_record(record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To-Target-URI: http://a", "WARC-Refers-To: <urn:uuid:9>"))
    assert (again.refers_to, again.refers_to_id, again.digest) == (None, "<urn:uuid:9>", None)
    with pytest.raises(ValueError):
        parse_record(record("revisit", b"HTTP/1.1 200 OK\r\n\r\n"))


def test_archive_of_another_writer(spark, tmp_path):
    """An archive that begins with a warcinfo record and has no dictionary."""
    import zstandard

    made = [record("warcinfo", b"software: x\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", b"fetchTimeMs: 3\r\n"), record("odd", b"")]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in made))
    got = read_archives(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.record_type, r.record_id, r.payload_bytes) for r in got[:3]] == [("warcinfo", "<urn:uuid:1-2>", 13), ("request", "<urn:uuid:1-2>", 18), ("metadata", "<urn:uuid:1-2>", 16)]
    assert [r.error for r in got] == [None, None, None, "unknown type odd"]


def test_empty_table(spark):
    assert round_trip(table(spark, [])).count() == 0
