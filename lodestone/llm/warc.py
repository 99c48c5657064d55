"""WARC archives compressed record by record with a Zstandard dictionary that stands in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, scratch, table
from lodestone.sources.scratch import small

#: The skippable frame that holds a dictionary, and the frame of plain Zstandard data.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads from this size on are written once.
LEAST_REVISIT = 1000
#: Bytes of records from which an archive's dictionary is built, its size, and the payload bytes of one archive.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2_000_000, 64_000, 32_000_000
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def roles(pages: DataFrame) -> DataFrame:
    """Each page with its payload, digest and role. Of equal payloads of LEAST_REVISIT bytes or more, the largest page_id is the response.

    Only digests and ids are grouped; rows that repeat that largest id are responses too, and null ids come last. Payloads
    are never shuffled while the digests of repeated ones are few enough for a broadcast.
    """
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    again = (
        pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
        .where(F.length("payload") >= LEAST_REVISIT)
        .groupBy(F.sha1("payload").alias("payload_digest")).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    is_revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return own.join(small(materialise(again, "repeated")), "payload_digest", "left").select(
        "page_id", "url", F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"), F.when(is_revisit, F.col("kept")).alias("refers_to"),
    )


def record(row: dict) -> bytes:
    """One WARC/1.1 record. A page's number is in its record id, which a revisit names."""
    block = row["payload"] or b""
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['page_id'])}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((row['url'] or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: text/html",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {name(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A dictionary in a skippable frame, then a frame for each record.

    The dictionary is trained on records spread over the archive, about SAMPLE_BYTES of them; where they are too few or too
    alike to train on, it is their own bytes, so every archive has one.
    """
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = records[::step]
    try:
        known = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 10)), sample, k=256, d=8)
    except zstandard.ZstdError:
        known = zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = known.as_bytes()
    head = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
    return head + b"".join(map(pack.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    known, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        known = zstandard.ZstdCompressionDict(data[8:at])
    unpack, view = zstandard.ZstdDecompressor(dict_data=known), memoryview(data)
    while at < len(data):
        one = unpack.decompressobj()
        parts = []
        while not one.eof:
            step = view[at : at + (1 << 16)]
            if not step:
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if k in fields else None
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "payload": body if response else None,
        "payload_bytes": len(body) if response else number("X-Payload-Length"),
        "payload_digest": hashlib.sha1(body).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
    }


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    task = TaskContext.get()
    files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    held, size, n, made = [], 0, 0, []

    def put() -> None:
        name = f"part-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.zst"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(archive(held))
        made.append((name, len(held)))

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for row in batch.slice(a, 256).to_pylist():
                held.append(record(row))
                size += len(held[-1])
            if size > ARCHIVE_BYTES:
                put()
                held, size, n = [], 0, n + 1
    if held:
        put()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], names=["file", "records"])


def write_warc(pages: DataFrame, folder: str) -> int:
    """Write every page's record into archives in a folder of a shared file system; the number of records.

    Null html is an empty payload, of any length it is one record; rows with a null page_id have no id in their records;
    other columns are ignored, whatever their names. An empty table writes no archive. Files are named by attempt, and the
    list that the successful attempts return is written beside them last: only listed archives are read, so a task that ran
    twice leaves no record twice.
    """
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    files.create_dir(root, recursive=True)
    listed = f"{folder}/_manifest"
    roles(bounded(pages)).mapInArrow(partial(_written, folder=folder), "file string, records long").write.mode("overwrite").parquet(listed)
    return pages.sparkSession.read.parquet(listed).agg(F.sum("records")).first()[0] or 0


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = [("page_id", pa.int64()), ("url", pa.string()), *[("payload", pa.binary())] * payload, ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    for batch in batches:
        for data in batch.column(0):
            held = []
            for raw in frames(pc.cast(data, pa.binary()).as_py()):
                held.append(parse(raw))
                if len(held) == 500:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in names} for r in held], schema=pa.schema(names))
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in names} for r in held], schema=pa.schema(names))


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of the listed archives in a folder; digests and sizes of responses are computed from what is read."""
    kinds = f"page_id long, url string{', payload binary' * payload}, payload_bytes long, payload_digest string, record_type string, refers_to long"
    listed = spark.read.parquet(f"{folder}/_manifest").select("file")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    found = found.join(small(listed), "file", "left_semi").select("content")
    return found.mapInArrow(partial(_read, payload=payload), kinds)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""
