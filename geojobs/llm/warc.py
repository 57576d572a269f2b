"""WARC bundles in the seekable Zstandard format.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table (a skippable frame with every frame's sizes),
and an index maps record ids to bundle, frame and the offset within the frame. Bundles are written by tasks under names of their own
attempt; the index, written through Spark, names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import at_most, shared_dir, spread_join, stash
from geojobs.operators.storage import open_store, qualified

#: Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
URI_SIGNS, PAGE_URL = "!#$&'()*+,/:;=?@[]~", "Page-URL"

#: Revisits of which every task may hold the names (64 MB); of more, all rows are shuffled to them.
FEW = 500_000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 64 << 20, 3
INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, record_offset long, record_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """Unique for each row, also where page_ids are null or repeated."""
    return f"{RECORD}{'' if page_id is None else page_id}:{row}"


def page_of(identifier: str | None) -> int | None:
    """The page_id in a record's identifier, with or without its angle brackets."""
    name = identifier.strip("<>").removeprefix(RECORD).partition(":")[0] if identifier else ""
    return int(name) if name else None


def target(url: str) -> list[str]:
    """Header lines for a url: a valid URI, what is encoded in it left alone; the url itself beside it where that says something else."""
    uri = urllib.parse.quote(url, safe=URI_SIGNS + "%", errors="surrogatepass")
    own = [] if uri == url else [f"{PAGE_URL}: " + urllib.parse.quote(url, safe=URI_SIGNS, errors="surrogatepass")]
    return [f"WARC-Target-URI: {uri}", *own]


def record(page_id: int | None, row: int, url: str | None, payload: bytes, size: int, sha1: str, first: str | None, date: str) -> bytes:
    """One WARC record: a response or, with ``first``, a revisit of that record, which needs only its payload's size and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, row)}>", f"WARC-Date: {date}"]
    lines += target(url) if url is not None else []
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if first is not None:
        lines += [f"WARC-Refers-To: <{first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes, int]]:
    """Records of uncompressed bytes: WARC headers, HTTP head, payload, offset."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, http, payload, at
        at = end + 4 + len(block) + 4


class Bundle:
    """Bytes of one seekable bundle, made frame by frame."""

    def __init__(self, level: int = LEVEL):
        self.compressor, self.data, self.sizes, self.pending = zstandard.ZstdCompressor(level=level), bytearray(), [], bytearray()

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, its offset in the bundle, the record's offset in the frame)"""
        place = len(self.sizes), len(self.data), len(self.pending)
        self.pending += record
        if len(self.pending) >= FRAME_BYTES:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.pending:
            frame = self.compressor.compress(bytes(self.pending))
            self.sizes.append((len(frame), len(self.pending)))
            self.data += frame
            self.pending = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.data) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(source) -> list[tuple[int, int, int]]:
    """``(offset, compressed, uncompressed)`` of each frame of an open bundle, read from its end."""
    size = source.size()
    frames, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = list(struct.iter_unpack("<II", source.read_at(8 * frames, size - 9 - 8 * frames)))
    offsets = [0]
    for packed, _ in sizes:
        offsets.append(offsets[-1] + packed)
    return [(o, a, b) for o, (a, b) in zip(offsets, sizes)]


def read_record(bundle: str, frame_offset: int, record_offset: int) -> tuple[dict[str, str], bytes, bytes]:
    """One record by its index entry: only its frame is read and unpacked."""
    system, path = open_store(bundle)
    with system.open_input_file(path) as source:
        packed = next(a for o, a, _ in seek_table(source) if o == frame_offset)
        data = zstandard.ZstdDecompressor().decompress(source.read_at(packed, frame_offset))
    head, http, payload, _ = next(parse(data[record_offset:]))
    return head, http, payload


def _writer(folder: str, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = open_store(folder)
        system.create_dir(path, recursive=True)
        bundle, rows, made = Bundle(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal bundle, rows, made
            name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst"
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(bundle.finish())
            frame = pd.DataFrame(rows, columns=["record_id", "page_id", "frame", "frame_offset", "record_offset", "record_bytes"])
            frame.insert(2, "bundle", f"{folder}/{name}")
            bundle, rows, made = Bundle(), [], made + 1
            schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_offset", pa.int64()), ("record_bytes", pa.int64())])
            return pa.RecordBatch.from_pandas(frame.astype({"page_id": "Int64"}), schema, preserve_index=False)

        for batch in batches:
            for page_id, row, url, payload, size, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page_id, row, url, payload, size, sha1, first, date)
                frame, frame_offset, offset = bundle.add(data)
                rows.append((record_id(page_id, row), page_id, frame, frame_offset, offset, len(data)))
                if len(bundle.data) >= BUNDLE_BYTES:
                    yield close()
        if rows:
            yield close()

    return run


def _revisits(rows: DataFrame) -> DataFrame:
    """``rows(row, page_id, sha1)`` -> row, first: rows whose payload another one holds, with that one's record identifier."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.groupBy("sha1").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    name = F.concat(F.lit(RECORD), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("first.row").cast("string"))
    firsts = firsts.select("sha1", F.col("first.row").alias("_row"), name.alias("first"))
    return spread_join(rows.select("row", "sha1"), firsts, "sha1", "row").where("row != _row").select("row", "first")


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages(page_id, url, html)`` as bundles into ``folder``; the index, one row per record.

    A null html is an empty payload. Of rows with equal payloads that with the smallest page_id (null last, then the first row) is the
    response, the others revisit it and go without payload. Digests meet, not payloads; those are shuffled only if more than FEW rows
    are revisits. Repeated rows and null ids are records of their own, with identifiers of their own. Very long pages take a frame
    each. Other columns are left out; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = stash(rows.withColumns({"sha1": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")}))
    revisits = stash(_revisits(rows.select("row", "page_id", "sha1")))
    known = rows.join(at_most(revisits, FEW), "row", "left")
    payload = F.encode(F.when(F.col("first").isNull(), F.col("html")).otherwise(F.lit("")), "UTF-8")
    known = known.select("page_id", "row", "url", payload.alias("payload"), "size", "sha1", "first")
    return stash(known.mapInArrow(_writer(qualified(spark, folder), date), INDEX))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            system, path = open_store(bundle)
            with system.open_input_file(path) as source:
                for offset, packed, unpacked in seek_table(source):
                    rows: list[list] = [[] for _ in names]
                    data = zstandard.ZstdDecompressor().decompress(source.read_at(packed, offset), max_output_size=unpacked)
                    for head, http, payload, _ in parse(data):
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = head["WARC-Type"]
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        if kind == "response" and (digest(payload) != said or len(payload) != size):
                            raise ValueError(f"{head['WARC-Record-ID']} in {bundle} is damaged")
                        url = urllib.parse.unquote(head[PAGE_URL], errors="surrogatepass") if PAGE_URL in head else head.get("WARC-Target-URI")
                        values = page_of(head["WARC-Record-ID"]), url, size, said, kind, page_of(head.get("WARC-Refers-To"))
                        for column, value in zip(rows, values):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)


def read(index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names, parsed and, for responses, held against their digests.

    An empty index gives no row; repeated and null rows of it name no bundle more; a bundle that is missing or cut short fails the
    job: an archive is read whole or not at all. Other columns of ``index`` are left out.
    """
    bundles = index.select("bundle").where("bundle is not null").distinct()
    n = max(1, bundles.count())
    return bundles.repartition(n).mapInArrow(_reader, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back."""
    return read(write(pages, shared_dir(pages.sparkSession)))
