import gzip
import hashlib
import zlib

import pytest

from tunewright.llm import warc

LONG = "<html>" + "x" * 100


@pytest.fixture(scope="module")
def pages(spark, documents):
    def build(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, path string")
    return build


def brute(rows):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page_id, payload in payloads:
        equal = [i for i, p in payloads if p == payload and i is not None]
        first = min(equal, default=None)
        revisit = len(payload) >= 100 and page_id != first
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None, True))
    return sorted(out, key=str)


def run(spark, df):
    out = warc.archived(df, spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_round_trip(spark, pages):
    rows = [(5, "http://a/é b\r\nX: y", LONG), (3, "u", LONG), (9, None, LONG), (1, "u", "short"), (2, "u", "short"), (4, "u", None),
            (6, "u", ""), (7, "", "é" * 50), (8, "u", "é" * 50), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (-11, "u", "z" * 3_000_000),
            (None, "u", LONG), (12, "u", "x" * 99), (13, "u", "x" * 99), (14, "u", "x" * 100), (15, "u", "x" * 100)]
    assert run(spark, pages([(*r, "d", "p") for r in rows])) == brute(rows)


def test_repeated_rows_and_empty_table(spark, pages):
    assert run(spark, pages([])) == []
    rows = [(1, "u", LONG), (1, "u", LONG), (2, "u", LONG)]
    got = run(spark, pages([(*r, "d", "p") for r in rows]))
    assert [r[3] for r in got] == ["response", "response", "revisit"]


def test_archives_roll_over_and_stay_plain_gzip(spark, pages, tmp_path):
    df = warc.marked_pages(pages([(i, f"http://h/{i}", f"page {i} " * 50, "d", "p") for i in range(40)]).coalesce(1))
    manifest = warc.write_archives(df, str(tmp_path / "out"), archive_bytes=2_000)
    files = manifest.collect()
    assert len(files) > 3 and sum(r.records for r in files) == 40
    for r in files:
        with open(r.path, "rb") as file:
            data = file.read()
        assert len(data) == r.bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    back = warc.read_archives(manifest, with_payload=True).collect()
    assert {r.page_id: r.payload.decode() for r in back} == {i: f"page {i} " * 50 for i in range(40)}


def archive(*blocks, digest=None):
    return b"".join(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x-page:{i}>"), ("Content-Type", "text/html"),
                                 *([("WARC-Payload-Digest", digest)] if digest else [])], b) for i, b in enumerate(blocks))


@pytest.mark.parametrize("size", [1, 2, 7, 100, 10**9])
def test_any_chunking_gives_the_same_records(size):
    blocks = [b"", b"a" * 5_000, b"\r\n\r\n" * 30, bytes(range(256)) * 40]
    data = archive(*blocks)
    chunks = (data[i:i + size] for i in range(0, len(data), size))
    assert [b for _, b in warc.records(chunks)] == blocks


def test_broken_archives_are_noticed():
    data = archive(b"hello", b"world")
    with pytest.raises(ValueError):
        list(warc.records(iter([data[:-5]])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(iter([data[:40] + b"\x00" + data[41:]])))
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.records(iter([short])))


def test_wrong_digests_are_reported():
    good = hashlib.sha1(b"payload")  # noqa: S324
    import base64

    for digest, verified in ((f"sha1:{base64.b32encode(good.digest()).decode()}", True), (f"sha1:{good.hexdigest()}", True),
                             ("sha256:00", False), ("odd:1", False)):
        [(fields, block)] = warc.records(iter([archive(b"payload", digest=digest)]))
        assert warc.page_row(fields, block, False)["verified"] is verified


def test_other_records_are_skipped():
    assert warc.page_row({"warc-type": "metadata"}, b"x", False) is None
