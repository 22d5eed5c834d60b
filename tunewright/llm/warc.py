"""WARC archives: writing pages as records, one gzip member each, and reading archives back record by record.

Equal payloads are stored once: the smallest page_id's record is a response, the others revisit it. Each write task
leaves archives under names of its own in the shared folder and reports them; only reports of tasks that succeeded get
into the manifest, so a repeated task does no harm. The reader streams: it inflates an archive chunk by chunk, frames
records by their content length and checks every digest; it holds one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.llm.common import beside, text_of
from tunewright.session import settle, shared_path

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
#: Compressed bytes after which a task goes on in a new archive.
ARCHIVE_BYTES = 256 * 1024 * 1024
CHUNK = 1024 * 1024
BATCH_ROWS, BATCH_BYTES = 1_000, 8 * 1024 * 1024
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _open(uri: str):
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri)


def _record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    named = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the same HTTP head and none."""
    # A header is one line of text: white space and controls of an address are percent-encoded.
    address = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or f"urn:x-page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_uri(page_id)),
        ("WARC-Date", DATE), ("WARC-Target-URI", address), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_uri(refers_to)), ("WARC-Profile", PROFILE)]
    return record(fields, http + (payload if refers_to is None else b""))


def marked_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for a response) of each page."""
    df = beside(pages, page_id=F.col("page_id").cast("long"), url=F.col("url").cast("string"),
                payload=text_of("html").cast("binary")).drop("_row")
    df = df.withColumn("digest", F.sha2("payload", 256))
    shared = F.octet_length("payload") >= least
    first = df.filter(shared).groupBy(F.col("digest").alias("_digest")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Written first: a join of two plain exchanges is one that adaptive execution can split at a hot digest.
    first = settle(first, "warc-firsts")
    # Small payloads are no key: each gets one of its own, so they are dealt out evenly.
    key = F.when(shared, F.col("digest")).otherwise(F.concat(F.lit("own-"), F.xxhash64("page_id", "digest").cast("string")))
    df = df.withColumn("key", key).join(first, F.col("key") == F.col("_digest"), "left")
    repeats = ~F.coalesce(F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return df.select("page_id", "url", "payload", "digest", F.when(repeats, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write marked pages under ``folder`` (any store that pyarrow opens); the manifest: path, records, bytes."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, report = None, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                   ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                                  b"software: tunewright\r\nformat: WARC File Format 1.1\r\n")
                    out.write(info)
                    report.append([f"{folder}/{name}", 0, len(info)])
                member = page_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                out.write(member)
                report[-1][1] += 1
                report[-1][2] += len(member)
                if report[-1][2] >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if report:
            paths, records, sizes = zip(*report, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
                names=["path", "records", "bytes"])

    return settle(pages.mapInArrow(written, "path string, records long, bytes long"), "warc-manifest")


def inflated_members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """Per gzip member an iterator of its inflated pieces; it must be used up before the next member."""
    chunks = iter(chunks)
    rest = b""
    ended = False

    def pieces(first: bytes) -> Iterator[bytes]:
        nonlocal rest, ended
        inflate = zlib.decompressobj(31)
        data = first
        while True:
            if piece := inflate.decompress(data, CHUNK):
                yield piece
            if inflate.eof:
                rest = inflate.unused_data
                return
            data = inflate.unconsumed_tail
            if not data and (data := next(chunks, None)) is None:
                raise ValueError("archive ends inside a gzip member")

    while True:
        while not rest and not ended:
            rest = next(chunks, None)
            ended, rest = rest is None, rest or b""
        if ended and not rest:
            return
        first, rest = rest, b""
        yield pieces(first)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; field names in lower case. Raises ValueError on broken framing."""
    for member in inflated_members(chunks):
        held = bytearray()
        end = -1
        while end < 0:
            piece = next(member, None)
            if piece is None:
                raise ValueError("record without a complete head")
            seen = max(len(held) - 3, 0)
            held += piece
            end = held.find(b"\r\n\r\n", seen)
        version, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("record does not start with a version")
        fields = {}
        for line in lines:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        del held[:end + 4]
        for piece in member:
            held += piece
            if len(held) > length + 4:
                break
        if bytes(held[length:]) != b"\r\n\r\n":
            raise ValueError("block and content length disagree")
        yield fields, bytes(held[:length])


def _digest_holds(named: str | None, data: bytes) -> bool:
    """Whether a ``algorithm:value`` digest (hex or base 32) fits; a record without one is fine."""
    if not named:
        return True
    algorithm, _, value = named.partition(":")
    try:
        found = hashlib.new(algorithm.replace("-", "").lower(), data)
    except ValueError:
        return False
    import base64

    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def page_row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict | None:
    """The page of a response or revisit record; None for other kinds."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    head, blank, payload = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    stated = fields.get("warc-payload-digest")
    good = _digest_holds(fields.get("warc-block-digest"), block)
    if kind == "response":
        good = good and _digest_holds(stated, payload)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        lengths = [line.split(b":")[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, digest = int(lengths[0]) if lengths else None, (stated or "").partition(":")[2]

    def page_of(uri: str | None) -> int | None:
        value = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(value) if value.lstrip("-").isdigit() else None

    return {"page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")),
            "verified": good} | ({"payload": payload} if with_payload else {})


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Pages of all archives named in ``path``; one archive is read by one task, in order."""
    fields = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
              "record_type": pa.string(), "refers_to": pa.int64(), "verified": pa.bool_()}
    fields |= {"payload": pa.binary()} if with_payload else {}
    schema = pa.schema(list(fields.items()))

    def chunks(uri: str) -> Iterator[bytes]:
        store, path = _open(uri)
        with store.open_input_stream(path, compression=None) as source:
            while data := source.read(CHUNK):
                yield data

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for uri in batch.column(0):
                for head, block in records(chunks(uri.as_py())):
                    row = page_row(head, block, with_payload)
                    if row is not None:
                        rows.append(row)
                        size += len(block) if with_payload else 0
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    sql = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(pages, sql + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame, spark: SparkSession, with_payload: bool = False) -> DataFrame:
    """Pages written to archives in the shared folder and read back.

    Null html: an empty payload. Of rows with equal payloads, every row with the smallest page_id is a response (repeated
    rows too). Null page_id: written like any other, read back as null; it is never revisited unless all are null, and
    then all are responses. Null or blank url: the record names the page instead. Empty table: no archive, no rows.
    Further input columns are not archived.
    """
    manifest = write_archives(marked_pages(pages), shared_path(spark, "warc"))
    return read_archives(manifest, with_payload)
