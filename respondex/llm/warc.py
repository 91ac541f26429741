"""WARC archives: write records, turn whole-file gzip streams into one member per record, read back by offset.

``write_archives`` packs records into archives that are one gzip stream each,
as many crawlers deliver them. ``normalise_archives`` inflates such a stream
once from start to end, writes every record again as a gzip member of its own
and lays a sidecar index of offsets beside it. ``read_records`` opens the
members by their offsets. Files go through pyarrow's file systems, so the
folder may be any URI those know. An attempt of a task writes files under names
of its own and reports them in its rows; files of lost attempts are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from respondex.functions.ranking import with_group_stats
from respondex.llm.base import new_folder, slices, stored

LEAST_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
#: What a task takes at most, on average, however many there are.
ARCHIVES_PER_TASK = 16
READ_BYTES_PER_TASK = 32 << 20
INDEX_SCHEMA = "archive string, page_id string, record_type string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, refers_to string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, refers_to``.

    ``refers_to`` is the smallest page_id with the same payload where the
    payload has at least 100 bytes and that page is another one, else null.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    known = with_group_stats(rows, ["payload_digest"], "page_id", first_page=F.min("page_id"))
    again = (F.col("payload_bytes") >= LEAST_REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return known.withColumn("refers_to", F.when(again, F.col("first_page"))).drop("first_page")


def _uri(page_id) -> str:
    """Ids may hold any character: all but letters, digits and ``_.-~`` are percent-encoded. A null id has no colon."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _record(row: dict) -> bytes:
    """One record. A revisit has no payload; its header still tells size and digest of the full one."""
    revisit = row["refers_to"] is not None
    body = b"" if revisit else (row["html"] or "").encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(row['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((row['url'] or 'urn:none').split())}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_uri(row['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write the rows of ``with_revisits`` as archives of about ``archive_bytes`` before compression; one row (archive) per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, stream, name, size = None, None, "", 0
        for part in slices(batches, "html"):
            for row in part.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    stream = zlib.compressobj(3, zlib.DEFLATED, 31)
                record = _record(row)
                size += len(record)
                out.write(stream.compress(record))
                if size >= archive_bytes:
                    out.write(stream.flush())
                    out.close()
                    out = None
                    yield _names([name])
        if out is not None:
            out.write(stream.flush())
            out.close()
            yield _names([name])

    return records.mapInArrow(run, "archive string")


def _parts(spark: SparkSession, units: int, needed: int) -> int:
    """A number of partitions for ``units`` pieces of work: four for each core, or ``needed`` if that is more.

    The rows hold names only, so Spark, which merges partitions by their bytes,
    would give them all to one task; it leaves explicit numbers alone.
    """
    return max(1, min(units, max(4 * spark.sparkContext.defaultParallelism, needed)))


def _names(names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])


def inflated(source) -> Iterator[bytes]:
    """Content of a gzip stream of one or more members, read once."""
    inflate = zlib.decompressobj(31)
    while chunk := source.read(CHUNK):
        while chunk:
            yield inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, payload and raw bytes of each record of an inflated stream."""
    held = bytearray()
    need = 0
    headers: dict[str, str] | None = None
    head_end = 0
    for chunk in chunks:
        held += chunk
        while True:
            if headers is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                head_end = at + 4
                headers = dict(line.split(": ", 1) for line in held[:at].decode().split("\r\n")[1:])
                need = head_end + int(headers["Content-Length"]) + 4
            if len(held) < need:
                break
            raw = bytes(held[:need])
            del held[:need]
            yield headers, raw[head_end:-4], raw
            headers = None
    if held:
        raise ValueError("the archive ends inside a record")


def normalise_archives(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record; the index rows (``INDEX_SCHEMA``) are also kept as ``<archive>.idx``, one JSON per line."""
    columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), (_, goal) = fs.FileSystem.from_uri(folder), fs.FileSystem.from_uri(target)
        store.create_dir(goal, recursive=True)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            new, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
            with store.open_input_stream(f"{root}/{name}", compression=None) as source, store.open_output_stream(f"{goal}/{new}", compression=None) as out, store.open_output_stream(f"{goal}/{new}.idx", compression=None) as index:
                for headers, _, raw in split_records(inflated(source)):
                    member = gzip.compress(raw, 6, mtime=0)
                    out.write(member)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    row = [new, _page(headers["WARC-Record-ID"]), headers["WARC-Type"], at, len(member), int(headers["X-Payload-Length"]), digest, _page(headers.get("WARC-Refers-To"))]
                    index.write(json.dumps(dict(zip(columns, row))).encode() + b"\n")
                    rows.append(row)
                    at += len(member)
                    if len(rows) == 4096:
                        yield _index(rows)
                        rows = []
            if rows:
                yield _index(rows)

    many = archives.count()
    return archives.repartition(_parts(archives.sparkSession, many, -(-many // ARCHIVES_PER_TASK)), "archive").mapInArrow(run, INDEX_SCHEMA)


def _page(uri: str | None) -> str | None:
    return None if uri is None or uri == "<urn:page>" else unquote(uri.removeprefix("<urn:page:").removesuffix(">"))


def _index(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Open every member by its offset: ``page_id, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Size and digest are counted again from the payload of a response and taken
    from the header of a revisit, which has no payload (null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for archive, offset, length in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns]):
                    if archive != name:
                        name, source = archive, store.open_input_file(f"{root}/{archive}")
                    source.seek(offset)
                    headers, payload, _ = next(split_records(iter([gzip.decompress(source.read(length))])))
                    revisit = headers["WARC-Type"] == "revisit"
                    size = int(headers["X-Payload-Length"]) if revisit else len(payload)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    out.append([_page(headers["WARC-Record-ID"]), headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), size, digest, None if revisit else payload])
                kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    records, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    near = index.repartitionByRange(_parts(index.sparkSession, records, -(-size // READ_BYTES_PER_TASK)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return near.select("archive", "offset", "length").mapInArrow(run, "page_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, archive_bytes: int = 32 << 20) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) and read the records back, one row per page.

    Null html is an empty payload, a null url is written as ``urn:none``. A
    null page_id is kept, and ids of any characters (empty, line breaks); with a payload that another page has it is a revisit
    of that page. Repeated rows of the smallest page_id are responses each. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    whole, split = new_folder(spark, "warc-whole"), new_folder(spark, "warc-members")
    archives = stored(write_archives(with_revisits(pages), whole, archive_bytes), "warc-names")
    index = stored(normalise_archives(archives, whole, split), "warc-index")
    kind = pages.schema["page_id"].dataType
    return read_records(index, split).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
