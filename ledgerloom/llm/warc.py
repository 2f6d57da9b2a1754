"""WARC archives with a Zstandard dictionary.

An archive is a skippable frame that holds a dictionary trained on its own
records, then one compressed frame a record, each of which can be read alone.
Spark decides which records are responses and which revisit them, shuffles the
records by archive, and every task writes its archives to the shared folder;
reading back starts from the list of archives that the write committed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import shared_dir, stored

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"

SAMPLE_BYTES, DICTIONARY_BYTES = 2_000_000, 65_536
#: Parts into which the copies of one payload are dealt: one payload may be that of a third of all pages.
SALTS = 64


def record_bytes(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the headers of the response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    clean = "".join(c for c in (url or "urn:none") if c > " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {length}",
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record, with the payload of a response checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload.decode() if fields["WARC-Type"] == "response" else None,
    }


def archive_bytes(records: list[bytes], level: int) -> bytes:
    """A whole archive. The dictionary learns from the first 32,768 bytes of sampled records; too few leave the archive without one."""
    sample, size = [], 0
    for r in records[:: max(1, sum(map(len, records)) // SAMPLE_BYTES)]:
        sample.append(r[:32_768])  # for the dictionary only; the records stay whole
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    parts = []
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, k=256, d=8, level=level)
        held = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
        parts.append(struct.pack("<II", SKIPPABLE, len(held)) + held)
        pack = zstandard.ZstdCompressor(level=level, dict_data=trained)
    except zstandard.ZstdError:
        pack = zstandard.ZstdCompressor(level=level)
    return b"".join([*parts, *map(pack.compress, records)])


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        (size,) = struct.unpack_from("<I", data, 4)
        held = data[8 : 8 + size]
        held = zstandard.decompress(held) if held[:4] == ZSTD_MAGIC else held
        trained, at = zstandard.ZstdCompressionDict(held), 8 + size
    view = memoryview(data)
    unpack = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(data):
        one = unpack.decompressobj()
        yield one.decompress(view[at:])
        at = len(data) - len(one.unused_data)


def _write(folder: str, level: int, most_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(top, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{top}/{uuid.uuid4().hex}.warc.zst"  # a new name for every attempt: one that fails leaves no half file under a listed name
            data = archive_bytes(records, level)
            with where.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        records: list[bytes] = []
        size = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for page, url, html, kind, digest, refers in zip(*columns, strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                kind = kind.as_py()
                records.append(record_bytes(page.as_py(), url.as_py(), kind, payload, digest.as_py(), len(payload), refers.as_py()))
                size += len(records[-1])
                if size >= most_bytes:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    return write


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string, archive string"


def _read(folder: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with where.open_input_stream(path) as held:
                    data = held.read()
                rows = []
                for record in archive_records(data):
                    rows.append(parse_record(record) | ({} if payloads else {"payload": None}))
                    if len(rows) == 1000:
                        yield _batch(rows, names, kinds, path)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds, path)

    return read


def _batch(rows: list[dict], names: list[str], kinds: list[pa.DataType], path: str) -> pa.RecordBatch:
    columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows), pa.string())], [*names, "archive"])


def records(pages: DataFrame, *, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, record_type, digest, refers_to of each page.

    Of pages with equal payloads (the html in UTF-8, null as empty) of at least
    `least_bytes` bytes that with the largest page_id is the response and the
    others revisit it. Rows that repeat that page_id are responses too; a null
    page_id is below all others, and if all are null each is a response. An empty
    table gives no record; columns other than these three are left out.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    enough = F.length("html") >= least_bytes
    large = own.where(enough).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    again = large.where("n > 1 and newest is not null").select(F.col("digest").alias("of"), "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # copies of one payload are dealt into SALTS parts, and payloads that nothing may refer to go anywhere
    mixed = F.xxhash64("page_id", "url")
    own = own.withColumn("of", F.when(enough, F.col("digest")).otherwise(mixed.cast("string"))).withColumn("salt", F.pmod(mixed, F.lit(SALTS)).cast("int"))
    older = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    kind = F.when(older, "revisit").otherwise("response")
    return own.join(again, ["of", "salt"], "left").select("page_id", "url", "html", kind.alias("record_type"), "digest", F.when(older, F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, least_bytes: int = 1000, level: int = 3, archive_bytes: int = 16_000_000) -> DataFrame:
    """Writes the archives below `folder` and returns path, records and bytes of each.

    `folder` is a local path or a URI that Arrow's file systems know, and shared
    by all executors. The list is what the job committed: files of attempts that
    failed are not in it.
    """
    made = records(pages, least_bytes=least_bytes).mapInArrow(_write(folder, level, archive_bytes), "path string, records bigint, bytes bigint")
    return stored(made, "archives")


def read(archives: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """All records of the listed archives; payloads are checked against their digests.

    payload is null for revisits, and for all if `payloads` is false.
    """
    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(_read(folder, payloads), READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder, payloads=False)
