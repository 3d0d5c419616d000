"""Operator 3: WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of WARC records, and a
footer: a skippable frame with the seek table of the Zstandard seekable format. An index maps every
record's identifier to its bundle, frame and offset within the frame's content, so one record
is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, ship, small, stage

ship(__name__)

#: Bytes of records in a frame and, about, of payloads in a bundle.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 24 << 20
#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 1000

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

INDEX = "record_id string, page_id bigint, bundle string, frame int, frame_offset int, record_bytes int"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


# ---------------------------------------------------------------- the format, a record or frame at a time
def record_name(page_id: str | None, bundle: str = "", copy: int = 0) -> str:
    """The identifier of a page's record; rows that repeat a page_id or have none are told apart by bundle and number."""
    name = f"page:{page_id}" if page_id is not None and not copy else f"page:{page_id}:{bundle}:{copy}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def encode(row, name: str) -> bytes:
    """One WARC/1.1 record; a revisit has no block, but its payload's length and digest.

    A page without an id has no X-Page-Id.
    """
    revisit = row.record_type == "revisit"
    payload = b"" if revisit else (row.html or "").encode("utf-8")
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((row.url or '').split())}", f"WARC-Payload-Digest: sha1:{row.payload_digest}", f"X-Payload-Length: {row.payload_bytes}",
    ]
    if row.page_id is not None:
        head.append(f"X-Page-Id: {row.page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(row.refers_to)}", f"X-Refers-To-Page: {row.refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode(content: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record that starts at a byte: its headers, its block, and the byte behind it."""
    end = content.index(b"\r\n\r\n", at)
    lines = content[at:end].decode("utf-8").split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(head["Content-Length"])
    return head, content[end + 4 : end + 4 + size], end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) bytes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + FOOTER_BYTES) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)


def read_seek_table(file, size: int) -> list[tuple[int, int]]:
    """(offset, compressed bytes) of a bundle's frames, from its last bytes."""
    file.seek(size - FOOTER_BYTES)
    n, _, magic = struct.unpack("<IBI", file.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    file.seek(size - FOOTER_BYTES - 8 * n)
    sizes = [x for x, _ in struct.iter_unpack("<II", file.read(8 * n))]
    at, out = 0, []
    for x in sizes:
        out.append((at, x))
        at += x
    return out


def read_record(folder: str, bundle: str, frame: int, frame_offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the footer and one frame."""
    system, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{bundle}"
    with system.open_input_file(path) as f:
        at, size = read_seek_table(f, f.size())[frame]
        f.seek(at)
        head, block, _ = decode(zstandard.ZstdDecompressor().decompress(f.read(size)), frame_offset)
    return head, block


# ---------------------------------------------------------------- Spark jobs
def described(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of the pages with equal payloads of REVISIT_BYTES or more, the greatest page_id is the
    response. A null html is an empty payload. Rows that share the response's page_id are responses.
    A page without an id revisits the response if there is one with an id; among themselves
    such pages are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    payload = pages.select("page_id", F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    large = payload.where(F.col("payload_bytes") >= REVISIT_BYTES)
    copies = large.groupBy(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).agg(F.max("page_id").alias("__keeper"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    copies = stage(copies, "copies")
    full = pages.select("page_id", "url", html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    met = full.join(small(copies, copies.count()), (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")), "left")
    revisit = F.col("__keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("__keeper")))
    return met.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__keeper")).alias("refers_to"))


def _bundle_writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Write the bundles of a partition, whose rows come sorted by bundle and page."""
        system, root = fs.FileSystem.from_uri(folder)
        press = zstandard.ZstdCompressor(level=3)
        name, out, frames, buffer, index, last, copy = None, None, [], bytearray(), [], None, 0

        def flush() -> None:
            if buffer:
                packed = press.compress(bytes(buffer))
                out.write(packed)
                frames.append((len(packed), len(buffer)))
                buffer.clear()

        def close() -> None:
            flush()
            out.write(seek_table(frames))
            out.close()
            system.move(f"{root}/{name}.{token}", f"{root}/{name}")  # a second attempt writes the same bytes
            frames.clear()

        token = uuid.uuid4().hex
        for batch in batches:
            for row in batch.itertuples(index=False):
                bundle = f"bundle-{row.bundle:06d}.warc.zst"
                if bundle != name:
                    if out is not None:
                        close()
                    name, out = bundle, system.open_output_stream(f"{root}/{bundle}.{token}", compression=None)
                    last = None
                # rows of one page_id, or without one, stand one after another
                copy = copy + 1 if last == (row.page_id,) else 0
                last = (row.page_id,)
                record_id = record_name(row.page_id, bundle, copy)
                record = encode(row, record_id)
                index.append((record_id, row.page_id, name, len(frames), len(buffer), len(record)))
                buffer += record
                if len(buffer) >= FRAME_BYTES:
                    flush()
            if index:
                made = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                made["page_id"] = pd.array([None if x is None else int(x) for x in made["page_id"]], dtype="Int64")
                yield made
                index = []
        if out is not None:
            close()

    return write


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives of pages(page_id, url, html) into a shared folder; returns the index (INDEX).

    Each bundle is written by one task under a temporary name and then renamed, so that a task which
    runs again replaces its bundle by the same bytes. Rows without a page_id are archived too, dealt
    to the bundles by their content. Columns besides the three are not archived.
    """
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    described_pages = described(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))
    row = pages.agg(F.sum(F.octet_length("html")).alias("b"), F.count("*").alias("n")).first()
    n = max(1, -(-(row.b or 0) // BUNDLE_BYTES), -(-row.n // 20_000))
    place = F.when(F.col("page_id").isNull(), F.xxhash64("url", "payload_digest")).otherwise(F.xxhash64("page_id"))
    dealt = described_pages.withColumn("bundle", F.pmod(place, F.lit(n)).cast("int")).repartitionById(n, "bundle").sortWithinPartitions("bundle", "page_id", "url", "payload_digest")
    # ids go to Python as text, where a null wouldn't turn a column of numbers into floats
    dealt = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stage(dealt.mapInPandas(_bundle_writer(folder), INDEX), "index")


def _bundle_reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, part in batch.groupby("bundle"):
                with system.open_input_file(f"{root}/{bundle}") as f:
                    table = read_seek_table(f, f.size())
                    for frame in sorted(part.frame):
                        at, size = table[frame]
                        f.seek(at)
                        content, at, rows = unpress.decompress(f.read(size)), 0, []
                        while at < len(content):
                            head, block, at = decode(content, at)
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            revisit = head["WARC-Type"] == "revisit"
                            intact = revisit or (hashlib.sha1(block).hexdigest() == digest and len(block) == int(head["X-Payload-Length"]))
                            rows.append((int(head["X-Page-Id"]) if "X-Page-Id" in head else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(head["X-Refers-To-Page"]) if revisit else None, intact))
                        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                        for c, at_row in (("page_id", 0), ("refers_to", 4)):
                            out[c] = pd.array([r[at_row] for r in rows], dtype="Int64")
                        yield out

    return read


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records (RECORDS) of the archives in a folder, frame by frame.

    intact: whether a response's payload has the digest and length that its header states. There are as
    many tasks as bundles: by the size of the frames' numbers alone, they would all be read in one.
    """
    frames = index.select("bundle", "frame").distinct()
    bundles = index.agg(F.count_distinct("bundle")).first()[0]
    return frames.repartition(max(1, bundles), "bundle", "frame").mapInPandas(_bundle_reader(folder), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages and read the archives back: one row per page."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
