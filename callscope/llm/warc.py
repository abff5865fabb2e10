"""
Archives of WARC records, each in a Zstandard frame of its own.

A file starts with a skippable frame that holds the dictionary of all following frames (itself packed or plain), then one frame follows per record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.batches import to_arrow
from callscope.sources.storage import file_system, qualified, scratch_table

DICTIONARY_FRAME = 0x184D2A5D
PACKED_FRAME = 0xFD2FB528
DICTIONARY_BYTES = 64 << 10
#: Rows the dictionary is trained from, and the characters looked at of each: a bound on what comes to the driver. It alters the size of the files only.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 8192
#: A task starts another file when one has this many packed bytes.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Tasks that read archives, at most; each takes several files if there are more.
READ_TASKS = 20_000
LEVEL = 3
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date of written records, so that reruns give the same bytes.
DATE = "2000-01-01T00:00:00Z"


class BadArchive(ValueError):
    """The bytes are not a whole archive: a broken frame, header or length."""


def record_bytes(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record: version, headers, block, and the two empty lines after it."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers.items()]
    lines += [f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; BadArchive if it isn't whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise BadArchive("a record does not start with a version and headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadArchive(f"bad header line {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in headers:
            raise BadArchive(f"a record lacks {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise BadArchive(f"bad length {headers['content-length'][:80]!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"a block of {length} bytes stands in a frame with {len(rest)} bytes after the headers")
    return headers, rest[:length]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; nothing if there is no dictionary."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample payloads; empty if there are too few of them to train from."""
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 10), samples).as_bytes()
    except zstandard.ZstdError:  # samples that have too little in common
        return b""


def _start(file: BinaryIO) -> tuple[zstandard.ZstdDecompressor, bytes]:
    """A decoder that knows the file's dictionary, and the bytes read beyond that."""
    head = file.read(8)
    if len(head) < 4 or int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
        return zstandard.ZstdDecompressor(), head
    size = int.from_bytes(head[4:8], "little")
    packed = file.read(size)
    if len(head) < 8 or len(packed) != size:
        raise BadArchive("the dictionary is cut off")
    if int.from_bytes(packed[:4], "little") == PACKED_FRAME:
        packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed)), b""


def read_frames(file: BinaryIO) -> Iterator[bytes]:
    """The content of each frame after the dictionary, in order; holds one frame and one read at a time. Other skippable frames are passed over."""
    decoder, data = _start(file)
    while True:
        while len(data) < 8 and (more := file.read(READ_BYTES)):
            data += more
        if not data:
            return
        magic = int.from_bytes(data[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50 and len(data) >= 8:
            size = 8 + int.from_bytes(data[4:8], "little")
            while len(data) < size:
                more = file.read(READ_BYTES)
                if not more:
                    raise BadArchive("a skippable frame is cut off")
                data += more
            data = data[size:]
            continue
        if magic != PACKED_FRAME:
            raise BadArchive("no frame where one should start")
        frame, parts = decoder.decompressobj(), []
        try:
            parts.append(frame.decompress(data))
            while not frame.eof:
                data = file.read(READ_BYTES)
                if not data:
                    raise BadArchive("a frame is cut off")
                parts.append(frame.decompress(data))
        except zstandard.ZstdError as error:
            raise BadArchive(str(error)) from error
        data = frame.unused_data
        yield b"".join(parts)


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    for frame in read_frames(file):
        yield parse_record(frame)


# --- tables of archives ---------------------------------------------------------------------------------------------

WRITTEN = "path string, file_bytes bigint, records bigint"
READ = "path string, number bigint, record_id string, record_type string, target_uri string, payload_digest string, refers_to string, headers map<string,string>, block binary"


def write_archives(records: DataFrame, folder: str, dictionary: bytes = b"", level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """
    Write records (record_type, headers map, block binary) below `folder`; returns the table of files that count (path, file_bytes, records).

    Each task writes files under names of its own, and Spark's committed table of names says which attempt counts: files of lost
    or repeated tasks are in no table, and readers go by the table.
    """
    folder = qualified(records.sparkSession, folder)
    schema = to_arrow(WRITTEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(f"{root}/archives", recursive=True)
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        leading, done, out, name, size, count = dictionary_frame(dictionary), [], None, "", 0, 0
        try:
            for batch in batches:
                kinds, headers, blocks = (batch.column(c) for c in ("record_type", "headers", "block"))
                for i in range(batch.num_rows):
                    if out is None:
                        name, count, size = f"{root}/archives/{uuid.uuid4().hex}.warc.zst", 0, len(leading)
                        out = system.open_output_stream(name)
                        out.write(leading)
                    packed = packer.compress(record_bytes(kinds[i].as_py(), dict(headers[i].as_py()), blocks[i].as_py() or b""))
                    out.write(packed)
                    size, count = size + len(packed), count + 1
                    if size >= file_bytes:
                        out.close()
                        done.append((name, size, count))
                        out = None
            if out is not None:
                out.close()
                done.append((name, size, count))
                out = None
        finally:
            if out is not None:
                out.close()
        full = [(folder + n.removeprefix(root), s, c) for n, s, c in done]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], f.type) for k, f in enumerate(schema)], schema=schema)

    records.select("record_type", "headers", "block").mapInArrow(run, WRITTEN).write.parquet(f"{folder}/files")
    return records.sparkSession.read.schema(WRITTEN).parquet(f"{folder}/files")


def read_archives(files: DataFrame) -> DataFrame:
    """
    All records of the archives named in column `path`, each file read by one task and one record at a time; see READ for the columns.

    A file that isn't whole fails the job with BadArchive and its name. No files give no rows.
    """
    schema = to_arrow(READ)

    def rows(path: str) -> Iterator[tuple]:
        system, place = file_system(path)
        with system.open_input_stream(place) as file:
            number = 0
            try:
                for headers, block in read_records(file):
                    yield (
                        path, number, headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), headers.get("warc-payload-digest"),
                        headers.get("warc-refers-to"), list(headers.items()), block,
                    )
                    number += 1
            except BadArchive as error:
                raise BadArchive(f"{path}, record {number}: {error}") from error

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path in batch.column("path").to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1]) + 500
                    if size >= 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
            yield batch_of(held)

    # Names are small, what they name is not: dealt out by number, as Spark would put all names into one task by their size.
    tasks = min(max(1, files.count()), READ_TASKS)
    return files.select("path").repartition(tasks).mapInArrow(run, READ)


def page_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """
    Records (record_type, headers, block) of pages (page_id, url, html): equal payloads are stored once.

    Of the pages with equal payloads of `least_bytes` or more, those with the smallest page_id are responses and the others revisits that refer to it
    and have no block; smaller payloads are all responses. A null html is an empty payload, a null url has no target; a page without an id is a
    response and is never referred to. Repeated rows are records of their own.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    # Digests only: a copied page is counted where it is read, before the shuffle.
    first = (
        pages.select("page_id", payload.alias("payload"))
        .where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.sha2("payload", 256).alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first_id")
    )
    revisit = F.col("page_id") > F.col("first_id")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return own.join(first, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.map_filter(
            F.create_map(
                F.lit("WARC-Record-ID"), F.coalesce(name("page_id"), F.lit("<urn:page:none>")),
                F.lit("WARC-Date"), F.lit(DATE),
                F.lit("WARC-Target-URI"), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"),
                F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), "digest"),
                F.lit("WARC-Payload-Length"), F.col("size").cast("string"),
                F.lit("WARC-Refers-To"), F.when(revisit, name("first_id")),
                F.lit("WARC-Profile"), F.when(revisit, PROFILE),
                F.lit("Content-Type"), F.lit("text/html; charset=utf-8"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("block"),
    )


def page_dictionary(pages: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from the start of the first pages read: at most `rows` times `chars` characters come to the driver."""
    sample = pages.where("html IS NOT NULL").select(F.substring("html", 1, chars).alias("html")).limit(rows)
    return train_dictionary([r["html"].encode("utf-8", "surrogatepass") for r in sample.collect() if r["html"]])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives into `folder` (by default a new one in the shared folder); returns the table of the files."""
    spark: SparkSession = pages.sparkSession
    return write_archives(page_records(pages), folder or scratch_table(spark, "warc"), page_dictionary(pages))


def archived_pages(files: DataFrame) -> DataFrame:
    """
    What the archives of `archive_pages` say of each page: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, verified.

    Length and digest of a response are taken from the block that was read, those of a revisit from its headers; `verified` says whether a response's block agrees with its headers.
    """
    id_of = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(id_of(c) != "", id_of(c).cast("long"))
    said_digest, said_bytes = F.regexp_replace("payload_digest", "^sha256:", ""), F.element_at("headers", "warc-payload-length").cast("long")
    whole = F.col("record_type") == "response"
    return read_archives(files).select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("block").cast("long")).otherwise(said_bytes).alias("payload_bytes"),
        F.when(whole, F.sha2("block", 256)).otherwise(said_digest).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
        F.when(whole, (F.octet_length("block") == said_bytes) & (F.sha2("block", 256) == said_digest)).alias("verified"),
    )
