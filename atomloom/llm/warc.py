"""Dictionary-compressed WARC archives.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the archive's own
records; each record follows as a frame of its own, so one record can be read without the others. Pages whose payload
equals that of a page with a smaller id are written as revisits of it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import join_on_key, shared_dir, table
from atomloom.llm.files import put, read_files

SKIPPABLE = 0x184D2A5D
#: Records are written to a new archive once the present one holds so many bytes of records.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes that a dictionary is trained on, spread evenly over the archive's records, and how many times its own size they are.
SAMPLE_BYTES, SAMPLE_SHARE = 2 << 20, 20
#: Bytes of a piece of the sample, and the pieces that a small archive is cut into, none shorter than LEAST_PIECE.
PIECE_BYTES, PIECES, LEAST_PIECE = 4096, 400, 64
LEAST_DICTIONARY = 256
LEVEL = 6
#: Payloads smaller than this are always responses. Every equal payload is a revisit at 0.
MIN_REVISIT_BYTES = 0
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC/1.1 record; a revisit names the page it repeats and the length of the payload it leaves out."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    head.append(f"Content-Length: {len(body)}")
    return CRLF.join(h.encode("utf-8", "surrogatepass") for h in head) + CRLF * 2 + body + CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of a record."""
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def sample_pieces(records: list[bytes]) -> list[bytes]:
    """Pieces of an archive's records, spread evenly over all their bytes, of SAMPLE_BYTES at most in all.

    Few records give shorter pieces, so that there are enough of them to train on.
    """
    total = sum(map(len, records))
    size = max(LEAST_PIECE, min(PIECE_BYTES, total // PIECES))
    pieces = [r[at : at + size] for r in records for at in range(0, len(r), size)]
    wanted = max(1, SAMPLE_BYTES // size)
    if len(pieces) <= wanted:
        return pieces
    return [pieces[k * len(pieces) // wanted] for k in range(wanted)]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on an archive's records, of a twentieth of the sample but DICTIONARY_BYTES at most.

    Only where Zstandard can train nothing (records of a few hundred bytes in all, or of noise), the end of the records stands in.
    """
    sample = sample_pieces(records)
    size = min(DICTIONARY_BYTES, max(LEAST_DICTIONARY, sum(map(len, sample)) // SAMPLE_SHARE))
    while size >= LEAST_DICTIONARY:
        try:
            return zstandard.train_dictionary(size, sample, level=LEVEL, d=8, k=min(256, size // 4)).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(records)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> bytes:
    dictionary = build_dictionary(records)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary, *map(compressor.compress, records)])


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive in order, each decompressed by itself with the embedded dictionary."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    view = memoryview(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
    at = 8 + size
    while at < len(view):
        one = decompressor.decompressobj()
        out, fed = [], at
        while not one.eof:
            if fed >= len(view):
                raise ValueError("the archive ends within a record")
            out.append(one.decompress(view[fed : fed + 65536]))
            fed += 65536
        at = min(fed, len(view)) - len(one.unused_data)
        yield b"".join(out)


def classify(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``payload`` bytes (null: empty), its digest and the page it revisits.

    Of equal payloads the smallest page_id is the response (``refers_to`` null) and so is any repeat of that very id.
    Pages with a null id are responses and are never referred to.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.when(F.col("page_id").isNotNull() & (F.length("payload") >= MIN_REVISIT_BYTES), F.sha1("payload")))
    firsts = keyed.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter(F.col("sha1").isNotNull() & (F.col("rows") > 1))
    placed = join_on_key(keyed, firsts, "sha1", "rows", pages.count())
    return placed.select("page_id", "url", "payload", "sha1", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """Write archives to ``folder``, one or more a partition, and return (archive, records, bytes) of each.

    A task holds one archive of about ARCHIVE_BYTES in memory, or one longer record. Rows are sorted in each partition,
    so a repeated task writes the same archives under the same names (rows that tie are alike).
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task:06d}-{part:05d}.warc.zst"
            content = archive(held)
            put(folder, name, content)
            return pa.record_batch([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(content)], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                body = payload.as_py()
                held.append(record(page_id.as_py(), url.as_py(), body, payload_digest(body), refers_to.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    part, held, size = part + 1, [], 0
        if held:
            yield flush()

    return classified.sortWithinPartitions("page_id", "sha1", "url", "payload").mapInArrow(written, "archive string, records long, bytes long")


def read_pages(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of (path, content) archives."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda text: int(text[len("<urn:page:") : -1]) if text and text != "<urn:page:>" else None
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for raw in read_archive(content.as_py()):
                    head, body = parse(raw)
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and payload_digest(body) != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    rows.append((number(head["warc-record-id"]), int(head["x-payload-length"]), digest, head["warc-type"], number(head.get("warc-refers-to"))))
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.mapInArrow(parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page of ``pages`` and read the archives back; a page stands in the result as its record says."""
    folder = shared_dir(spark, "warc")
    manifest = write_archives(classify(table(spark, sf_dir, "pages")), folder)
    if not manifest.agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_pages(read_files(spark, folder, ".warc.zst"))
