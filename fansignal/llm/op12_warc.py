"""Dictionary-compressed WARC archives: one record per page, written and read back.

Every page becomes a WARC/1.1 record of type response, or of type revisit where an equal
payload (at least ``min_bytes`` long) belongs to a page with a smaller id; a revisit names
the response it refers to and holds the HTTP header only. Equal payloads meet by their
SHA-256: rows are dealt by it, sorted by (payload, id) inside a task, and the first of a
run is the response. Payloads of more than a thousandth of all rows (so at most 1,000 of
them) are found beforehand by a count; their first page is broadcast and their rows are
dealt by page instead, so no group of copies ends in one task.

A task cuts its records into archives of about ``ARCHIVE_BYTES``. From the records of an
archive (evenly spread ones up to ``SAMPLE_BYTES``) a Zstandard dictionary is built; it is
written first, in a skippable frame (magic 0x184D2A5D, itself Zstandard-compressed), then
a warcinfo record and every record as a frame of its own, so that any record can be read
from its offset with the dictionary alone. Too few records for a dictionary: none is
embedded and the frames are plain. Archives are written under a hidden name and renamed,
and their names follow from the partition, so a repeated task replaces its own files.

Null payload: as an empty one. Null id: the record has no page id; of equal payloads it is
the last candidate. Null or empty address: no target address. Rows that repeat an id: a
record each; of entirely equal rows one is the response. A very long payload gets an
archive of its own and is held whole by one task. An empty table gives an empty folder and
no rows. Further columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.llm.shared_files import file_system
from fansignal.sources.tables import staged

ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES = 65_536
SAMPLE_BYTES = 4_000_000
LEVEL = 3
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
ZSTD_FRAME = (0xFD2FB528).to_bytes(4, "little")
ZSTD_DICTIONARY = (0xEC30A437).to_bytes(4, "little")
INDEX = "warc_page string, warc_type string, warc_file string, warc_offset long, warc_length long"
READ = ("warc_page string, url string, payload_bytes long, payload_digest string, record_type string, "
        "warc_refers string, payload binary, warc_file string, warc_offset long")


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hex, 5 bytes at a time."""
    blocks = [F.lpad(F.conv(F.substring(hex_digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*blocks)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def dealt_pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Pages with payload, digest and, for payloads of very many pages, the first page; a
    payload's rows are in one partition, next to each other, smallest id first."""
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    d = pages.select(F.col(id_col).alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    d = d.select("*", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))).alias("same"))
    counts = staged(d.groupBy("same").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col("page").isNull().alias("no_page"), "page", "url")).alias("head")), "warc-payloads")
    total = counts.agg(F.sum("c")).first()[0] or 0
    # more than a thousandth each: at most 1,000 rows
    hot = counts.filter((F.col("c") * 1000 > total) & (F.col("c") > 1) & F.col("same").isNotNull()).select(F.col("same").alias("hot_same"), "head")
    d = d.join(F.broadcast(hot), F.col("same") == F.col("hot_same"), "left").drop("hot_same")
    spread = F.xxhash64("page", "url")
    d = d.withColumn("deal", F.when(F.col("same").isNull() | F.col("head").isNotNull(), spread).otherwise(F.xxhash64("same")))
    return (d.repartition("deal").sortWithinPartitions("same", F.col("page").asc_nulls_last(), "url")
            .select(F.col("page").cast("string").alias("page"), "url", "payload", "same", base32(F.sha1("payload")).alias("digest"),
                    F.col("head").isNotNull().alias("hot"), F.col("head.page").cast("string").alias("head_page"), F.col("head.url").alias("head_url")))


def record_id(page: str | None, url: str, digest: str, revisit: bool) -> str:
    name = "\n".join(("-" if page is None else "+" + page, url, digest, "revisit" if revisit else "response"))
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _header(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def address(url: str) -> str | None:
    """The address without characters that would end a header line; None if empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) or None


def page_record(page, url: str, payload: bytes, digest: str, date: str, refers: tuple | None) -> bytes:
    """A response record, or a revisit one that refers to (page, url)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page, url, digest, refers is not None)), ("WARC-Date", date), ("WARC-Target-URI", address(url)),
              ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        return _header("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               ("WARC-Refers-To", record_id(*refers, digest, False)), ("WARC-Refers-To-Target-URI", address(refers[1])),
               ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", refers[0])]
    return _header("revisit", fields, http)


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spread records up to SAMPLE_BYTES; None if they are too few."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[:SAMPLE_BYTES // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8, f=18, accel=2, level=LEVEL)
    except (zstandard.ZstdError, ValueError):   # too few or too short samples
        return None


def write_archive(folder: str, name: str, records: list[bytes], date: str) -> list[tuple[int, int]]:
    """One archive file; returns offset and length of each record's frame."""
    dictionary = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    hidden, places, at = f"{path}/.{name}-{uuid.uuid4().hex}", [], 0
    info = b"software: fansignal\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Record-ID", record_id(None, name, "", False)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    with store.open_output_stream(hidden, compression=None) as out:
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            at += out.write(DICTIONARY_FRAME + len(packed).to_bytes(4, "little") + packed)
        at += out.write(packer.compress(_header("warcinfo", fields, info)))
        for r in records:
            places.append((at, out.write(packer.compress(r))))
            at += places[-1][1]
    store.move(hidden, f"{path}/{name}")
    return places


def _writer(folder: str, date: str):
    def run(batches):
        from pyspark import TaskContext
        part, archives, size = TaskContext.get().partitionId(), 0, 0
        records, known = [], []
        last, head, used = None, None, False     # payload, its first page, whether it has a response here

        def flush():
            nonlocal archives, size
            name = f"pages-{part:06d}-{archives:05d}.warc.zst"
            places = write_archive(folder, name, records, date)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in known], pa.string()), pa.array([k[1] for k in known], pa.string()), pa.array([name] * len(known), pa.string()),
                 pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                names=["warc_page", "warc_type", "warc_file", "warc_offset", "warc_length"])
            records.clear()
            known.clear()
            archives, size = archives + 1, 0
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, same, digest, hot, head_page, head_url = (c[i].as_py() for c in batch.columns)
                refers = None
                if same is not None:
                    if same != last:
                        last, head, used = same, ((head_page, head_url) if hot else (page, url)), False
                    if used or (page, url) != head:
                        refers = head
                    else:
                        used = True
                r = page_record(page, url, payload, digest, date, refers)
                if records and size + len(r) > ARCHIVE_BYTES:
                    yield flush()
                records.append(r)
                known.append((page, "response" if refers is None else "revisit"))
                size += len(r)
        if records:
            yield flush()
    return run


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives of ``pages`` to a fresh ``folder`` of the shared store and return
    their index, stored: page id (as text), record type, file, offset and length."""
    d = dealt_pages(pages, id_col, url_col, payload_col, min_bytes)
    return staged(d.mapInArrow(_writer(folder, date), INDEX), "warc-index")


def frames(stream, chunk: int = 1 << 20):
    """(offset, bytes) of every record of an archive, read piece by piece."""
    dictionary, at, buffer = None, 0, b""

    def more(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n:
            piece = stream.read(max(chunk, n - len(buffer)))
            if not piece:
                return False
            buffer += piece
        return True

    while more(1):
        if not more(8):
            raise ValueError("archive ends inside a frame")
        if 0x184D2A50 <= int.from_bytes(buffer[:4], "little") <= 0x184D2A5F:
            size = 8 + int.from_bytes(buffer[4:8], "little")
            if not more(size):
                raise ValueError("archive ends inside a skippable frame")
            if at == 0 and buffer[:4] == DICTIONARY_FRAME:
                raw = buffer[8:size]
                if raw[:4] == ZSTD_FRAME:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                if raw[:4] != ZSTD_DICTIONARY:
                    raise ValueError("the leading frame holds no dictionary")
                dictionary = zstandard.ZstdCompressionDict(raw)
            buffer, at = buffer[size:], at + size
            continue
        opener = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out, start, left = [], at, buffer
        while True:
            out.append(opener.decompress(left))
            at += len(left)
            if opener.eof:
                break
            left = stream.read(chunk)
            if not left:
                raise ValueError("archive ends inside a record")
        buffer = opener.unused_data
        at -= len(buffer)
        yield start, b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (with the type) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not first.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("malformed record")
    return fields, rest[:size]


def page_of(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Payload length, digest and payload (None for a revisit); the digest is checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"^Content-Length: (\d+)", http, re.M)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] != "response":
        return size, digest, None
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return size, digest, payload


def _reader(payloads: bool, names: list[str]):
    def run(tables):
        for t in tables:
            for path in t["path"]:
                store, at = file_system(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for offset, record in frames(stream):
                        fields, block = parse_record(record)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        n, digest, payload = page_of(fields, block)
                        rows.append((fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), n, digest, fields["WARC-Type"],
                                     fields.get("X-Refers-To-Page-ID"), payload if payloads else None, path.rsplit("/", 1)[1], offset))
                        size += 500 + (len(payload) if payloads and payload else 0)
                        if size > ARCHIVE_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)
    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The page records of all archives of a folder, file by file; a record that is cut off,
    malformed or whose payload differs from its digest stops the query."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.zst").load(folder).select("path", "length")
    names = [c.split()[0] for c in READ.split(", ")]
    return files.mapInPandas(_reader(payloads, names), READ)


def archived_pages(pages: DataFrame, folder: str, id_col: str = "page_id", **options) -> DataFrame:
    """Write the archives of ``pages`` and read them back: page_id (in its own type),
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    if write_pages(pages, folder, id_col, **options).isEmpty():
        return spark.createDataFrame([], READ).select(
            F.col("warc_page").cast(pages.schema[id_col].dataType).alias(id_col), "payload_bytes", "payload_digest", "record_type",
            F.col("warc_refers").cast(pages.schema[id_col].dataType).alias("refers_to"))
    kind = pages.schema[id_col].dataType
    return read_archives(spark, folder).select(
        F.col("warc_page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("warc_refers").cast(kind).alias("refers_to"))
