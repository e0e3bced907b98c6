"""WARC archives: write with an index, then read selected records by coalesced byte ranges.

Each task writes one archive of gzip members, a member a record, to a shared folder,
and returns an index row for each record: file, offset, length, url, digest.  Only
indexed records exist, so files of failed attempts do no harm.  Reading sorts the
selected index rows by place, joins neighbouring ones to one read of at most
``RANGE_BYTES`` (a longer record alone), and parses each record.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest id is a response and holds the payload; the others revisit it.  Repeated
rows with the largest id: one is the response.  A null id loses against any other
and stays null; a null payload is empty; a null url is written as urn:page:<id>.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import new_path, small_or_shuffled, written

RANGE_BYTES = 1 << 20
#: Bytes of archives that one reading task takes, about.
TASK_BYTES = 16 << 20
#: Bytes between two records that are rather read than skipped.
GAP_BYTES = 64 << 10
LEVEL = 4
#: Payloads with copies: digests up to this number are broadcast; beyond it the join shuffles.
BROADCAST_COPIES = 200_000
_DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    url = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:page:{page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_name(page_id, digest if not revisit else f"{digest}:revisit"),
        "WARC-Date": _DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_name(refers_to, digest), "X-Refers-To-Page": "" if refers_to is None else str(refers_to)}
    head |= {"X-Page": "" if page_id is None else str(page_id), "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, full payload length and held payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, length, payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes all rows and returns the index, read from its own table."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "pages", "zstd")  # both reads below must see the same row numbers, also if cores are lost between them
    copies = rows.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = written(copies, "copies")
    joined = rows.join(small_or_shuffled(copies, copies.count(), BROADCAST_COPIES), "sha1", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row")) & (F.length("payload") >= min_bytes)
    dealt = joined.select("page_id", "url", "payload", "sha1", F.col("first.page_id").alias("refers_to"), revisit.alias("revisit"))

    def run(batches):
        fs, base = open_filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            index: list[tuple] = []
            if batch.num_rows and out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for page_id, url, html, sha1, refers_to, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html, digest, refers_to, bool(again))) + packer.flush()
                out.write(member)
                index.append((name, offset, len(member), url, digest, page_id, "revisit" if again else "response"))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], [x.split()[0] for x in INDEX.split(", ")]) if index else pa.RecordBatch.from_pylist([], schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return written(dealt.mapInArrow(run, INDEX), "index")


def ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[list[int]]:
    """Groups sorted (offset, length) places into reads: [first byte, last byte + 1, number of records]."""
    reads: list[list[int]] = []
    for offset, length in places:
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            reads[-1][1:] = [max(reads[-1][1], offset + length), reads[-1][2] + 1]
        else:
            reads.append([offset, offset + length, 1])
    return reads


def read_records(index: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records of some index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + keep_payload]

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def run(batches):
        fs, base = open_filesystem(folder)
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            low = 0
            while low < len(files):
                high = low
                while high < len(files) and files[high] == files[low]:
                    high += 1
                with fs.open_input_file(f"{base}/{files[low]}") as source:
                    for first, last, n in ranges(list(zip(offsets[low:high], lengths[low:high], strict=True))):
                        data = source.read_at(last - first, first)
                        out = []
                        for k in range(low, low + n):
                            raw = zlib.decompress(data[offsets[k] - first : offsets[k] - first + lengths[k]], 31)
                            fields, length, payload = parse(raw)
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if fields["WARC-Type"] == "response":
                                length, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                                if found != digest:
                                    raise ValueError(f"{files[k]} at {offsets[k]}: payload digest {found}, header {digest}")
                            row = (number(fields["X-Page"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page")))
                            out.append(row + (payload,) * keep_payload)
                        low += n
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    # tasks by the bytes of the archives, of which the index tells nothing to adaptive execution
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    block = F.floor(F.col("offset") / RANGE_BYTES)
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", block).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def query(spark, sf_dir):
    """op5: writes all pages to archives and reads every record back."""
    folder = new_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
