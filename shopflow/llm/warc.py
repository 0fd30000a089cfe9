"""Operator 6: WARC archives in Zstandard form, written and read back.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds its dictionary; then each
record is one Zstandard frame, so a reader can begin at any frame and a damaged record hurts only itself.
Tasks write archives of bounded size to the shared folder under names of their own; only
archives named in the tasks' committed result are read, so files of a lost or repeated task don't count.
The reader loads the dictionary, decodes one frame per record and checks headers, lengths, digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import materialise, shared_path

SKIPPABLE = 0x184D2A5D  # fixed value: magic number of the dictionary frame
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20  # payload bytes after which a task begins another archive
SAMPLE = 64               # first records of an archive, from which its dictionary is made
SAMPLE_BYTES = 4096       # looked at in each of them
DICTIONARY_BYTES = 16 << 10


def make_dictionary(payloads: list[bytes]) -> zstandard.ZstdCompressionDict:
    samples = [p[:SAMPLE_BYTES] for p in payloads if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except (zstandard.ZstdError, ValueError):  # too few or too small samples: their text itself
        raw = b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _header_text(value: str) -> str:
    """A header's value on one line: control characters and % as %XX (reversible)."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def record_bytes(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC record. A revisit (``refers_to`` given) has no block; the digest and length of the
    payload it stands for are in its headers."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}",
             "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Dictionary frame first, then a frame per record."""

    def __init__(self, sink, dictionary: zstandard.ZstdCompressionDict):
        self.sink, self.records = sink, 0
        raw = dictionary.as_bytes()
        sink.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        self.sink.write(self.compressor.compress(record))
        self.records += 1


def parse_record(raw: bytes) -> dict:
    """Headers and block of a record; raises ValueError where it breaks the format."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon:
            raise ValueError(f"bad header {line[:80]!r}")
        headers[name.lower()] = value
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    block, kind = rest[:length], headers["warc-type"]
    if kind == "response" and hashlib.sha1(block).hexdigest() != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError("the payload's digest differs")
    if kind == "response" and int(headers["x-payload-length"]) != length:
        raise ValueError("the payload's length differs")
    return {"headers": headers, "block": block}


def read_archive(data: bytes):
    """Records of an archive, one frame at a time."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8:8 + size])
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        trained = raw[:4] == b"\x37\xa4\x30\xec"  # fixed value: magic number of a trained dictionary
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        at = 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        one = decoder.decompressobj()
        parts, step = [], 1 << 16
        while not one.eof and at < len(data):
            piece = view[at:at + step]
            parts.append(one.decompress(piece))
            at += len(piece)
        if not one.eof:
            raise ValueError("a frame is cut short")
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def _page(urn: str | None):
    value = urn[len("<urn:page:"):-1] if urn else ""
    return int(value) if value else None


def _write_archives(folder: str):
    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        done, sink, writer, name, held, size = [], None, None, None, [], 0

        def begin():
            nonlocal sink, writer, name
            name = f"{uuid.uuid4().hex}.warc.zst"
            sink = where.open_output_stream(f"{base}/{name}")
            writer = ArchiveWriter(sink, make_dictionary([p for _, _, p, _ in held]))
            for r in held:
                writer.add(record_bytes(*r))
            held.clear()

        def end():
            nonlocal writer, size
            sink.close()
            done.append((name, writer.records))
            writer, size = None, 0

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                payload = (html.as_py() or "").encode()
                row = (page_id.as_py(), url.as_py(), payload, refers.as_py())
                size += len(payload)
                if writer is None:
                    held.append(row)
                    if len(held) >= SAMPLE or size >= ARCHIVE_BYTES:
                        begin()
                else:
                    writer.add(record_bytes(*row))
                if writer is not None and size >= ARCHIVE_BYTES:
                    end()
        if held:
            begin()
        if writer is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
                                         names=["archive", "records"])
    return run


def _read_archives(folder: str):
    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with where.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                rows = []
                for r in read_archive(data):
                    h = r["headers"]
                    rows.append((_page(h["warc-record-id"]), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"),
                                 h["warc-type"], _page(h.get("warc-refers-to")), h.get("warc-target-uri"), name))
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} records, {records} were written")
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive"])
    return run


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def with_references(pages: DataFrame) -> DataFrame:
    """``refers_to``: for payloads of at least 1000 bytes that several rows share, the largest page_id
    among them, on all rows but the one that has it."""
    p = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
                     F.octet_length("html").alias("n"), F.sha2("html", 256).alias("sha"))
    p = materialise(p.where(F.col("n") >= LEAST_REVISIT).drop("n"), "payloads")
    top = p.groupBy("sha").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return p.join(top, "sha").where("top.row <> row and top.page_id is not null").select(
        F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), F.col("top.page_id").alias("refers_to")).distinct()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html, ...)`` to archives below ``folder``;
    returns the committed ``(archive, records)``.

    A null html is an empty payload, a null url leaves out the target, a null page_id an empty id.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    refs = with_references(p)
    rows = p.join(refs, p["page_id"].eqNullSafe(F.col("r_page")) & (F.sha2("html", 256) == F.col("r_sha")), "left")
    # of rows that repeat a page_id and its payload each is written; none refers to itself
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"))
    return materialise(rows.mapInArrow(_write_archives(_uri(folder)), "archive string, records long"), "manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that ``manifest(archive, records)`` names: ``page_id``,
    ``payload_bytes``, ``payload_digest`` (bare hex SHA-1), ``record_type``, ``refers_to``, ``target_uri``, ``archive``."""
    # one task an archive: by bytes of these few rows they would all meet in one
    return manifest.repartition(max(1, manifest.count())).mapInArrow(
        _read_archives(_uri(folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                      "refers_to long, target_uri string, archive string")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back, one row for each row."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
