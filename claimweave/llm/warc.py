"""WARC archives with dictionary-compressed records, and their reader.

Every task writes the records it holds, in id order, to one archive. The archive's Zstandard dictionary
is built from its own first records (whole ones, up to `SAMPLE_BYTES` of them), and stands at its
start in a skippable frame. Each record is a frame of its own. Reading needs the archive alone:
frame by frame, memory holds one record.

Payloads are a page's html in UTF-8. Of records with equal payloads (SHA-1 digest) of at least
`least_bytes`, the one of the smallest id is a response, others are revisits without a payload that
refer to it. Only payloads that occur more than once are joined, as a narrow table.

Archives go to a folder that executors share. A task's file has a name of its own per attempt; only
files in the written manifest count, so a task that runs again does no harm.

Defined results: a null html is an empty payload, a null url leaves out the target. A null id counts as
greater than others; rows of one smallest id and equal payload are all responses. Too few or too
small records for a dictionary make an archive without one. An empty table makes an empty manifest.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import small, written
from claimweave.sources.storage import shared_folder

DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEAST_SAMPLES = 16
LEVEL = 3
READ_BYTES = 1 << 18
# Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT, RESPONSE = "revisit", "response"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    digits = name[len("<urn:page:") : -1] if name else ""
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str, date: str = DATE) -> bytes:
    """One WARC record. The record's id names the page."""
    block = HTTP if kind == REVISIT else HTTP + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date)]
    if url is not None:
        # A line break would end the field.
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == REVISIT:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; checks the lengths and, if there is a payload, its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    payload = rest[:length].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == RESPONSE and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return fields, payload


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < LEAST_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        # The records are too small or too alike.
        return None


def write_archive(out: BinaryIO, records: Iterator[bytes]) -> tuple[int, int]:
    """Write an archive; (records, bytes). Holds the sample and one record."""
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    trained = _trained(sample)
    done = 0
    if trained:
        body = trained.as_bytes()
        done += out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
    n = 0
    for part in (sample, records):
        for r in part:
            done += out.write(packer.compress(r))
            n += 1
    return n, done


def read_archive(source: BinaryIO) -> Iterator[bytes]:
    """Records of an archive, one after the other."""
    rest = source.read(8)
    unpacker = zstandard.ZstdDecompressor()
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == DICTIONARY_FRAME:
        body = source.read(struct.unpack("<I", rest[4:])[0])
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        rest = b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(READ_BYTES)
        yield b"".join(parts)


def write(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write archives below folder (in the shared folder by default); the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}-warc"
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(small(written(again, "again"), 64), "digest", "left")
    # Equal payloads shorter than the least never meet in `again`, as equal digests have equal lengths.
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "payload", F.when(revisits, F.col("first")).alias("refers_to"),
                           revisits.alias("revisits"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for pdf in batches:
                for i, u, p, to, again in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], pdf["revisits"]):
                    yield record(None if pd.isna(i) else int(i), u, bytes(p), None if pd.isna(to) else int(to),
                                 REVISIT if again else RESPONSE, date)

        store, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            pyarrow.fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.zst"
        with store.open_output_stream(f"{path}/{name}") as out:
            n, size = write_archive(out, records())
        yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    # Ids are numbers that doubles would round; nullable integers keep them.
    manifest = marked.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return written(manifest.mapInPandas(archive, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                store, path = pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
                    pyarrow.fs.LocalFileSystem(), uri)
                with store.open_input_stream(path) as source:
                    rows, size = [], 0
                    for data in read_archive(source):
                        f, payload = parsed(data)
                        kind = f["WARC-Type"]
                        rows.append((_text(_number(f["WARC-Record-ID"])), f.get("WARC-Target-URI"), payload if kind == RESPONSE else None,
                                     int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), kind,
                                     _text(_number(f.get("WARC-Refers-To")))))
                        size += len(data)
                        if size >= SAMPLE_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    archives = manifest.select("path").repartition(max(1, manifest.count()), "path")
    out = archives.mapInPandas(unpack, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, "
                                       "record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _text(number: int | None) -> str | None:
    return None if number is None else str(number)
