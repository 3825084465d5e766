"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record; ``build_index`` sorts the
captures by reversed-host URL key, cuts them into compressed blocks and keeps a
sparse directory with the first key of every block; ``lookup`` binary-searches
the directory, opens the one block that can hold a key, binary-searches it, and
reads just the record's byte range from its archive.

Files go to the session's shared folder through ``pyarrow.fs``, which opens the
same URIs as Spark.  A task writes to names of its own attempt, and only rows of
the attempt that ended well are kept, so a lost executor leaves no half record.

Nulls and edge cases: null html is an empty payload; a null URL has the key
``-``; of equal payloads every row with the smallest page_id is a response
(repeated rows included) and a null page_id comes after all others; an empty
table gives empty archives, index and result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import new_path, stored
from voxspark.functions.workers import ship

BROADCAST_DIGESTS = 1_000_000  # most repeated payloads whose first page is sent to every task
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1000
MOST_SHARDS = 20_000  # of an index: their first keys and file names are sent to every task of a look-up
CAPTURED = "2024-01-01T00:00:00Z"
STAMP = re.sub(r"\D", "", CAPTURED)
CDX = "key string, file string, offset long, length long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def url_key(url: Column) -> Column:
    """Reversed-host key, e.g. ``com,example,blog)/en?x=1``; a null URL gives ``-``.

    White space and control characters are percent-encoded wherever they stand:
    the index is lines of fields.
    """
    odd = r"[\s\p{Z}\p{Cc}]"
    escaped = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(c), "(..)", "%$1")).otherwise(c))
    rest = F.regexp_replace(F.when(url.rlike(odd), F.array_join(escaped, "")).otherwise(url), "^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.when(url.isNull(), "-").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path))


def capture_key(url: Column, page: Column) -> Column:
    """Sort key of a capture: URL key, time stamp, record number."""
    return F.concat_ws(" ", url_key(url), F.lit(STAMP), F.coalesce(F.lpad(page.cast("string"), 20, "0"), F.lit("~")))


def _record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def _parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add ``sha1`` and ``refers_to``: the smallest page_id with the same payload, null for itself.

    Digests that occur more than once are counted first.  Few are sent to the
    pages; many meet the page_ids and digests alone, and the pages that repeat
    another get their answer by page_id, so no payload is shuffled by its digest.
    """
    body = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    slim = hashed.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    twice = stored(slim.where("n > 1 and first_id is not null").select("sha1", "first_id"), "twice")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to")
    if twice.count() <= BROADCAST_DIGESTS:
        return hashed.join(F.broadcast(twice), "sha1", "left").select("page_id", "url", "html", "sha1", refers)
    known = hashed.select("page_id", "sha1").join(twice, "sha1").select(F.col("page_id").alias("id"), F.col("sha1").alias("same"), refers).where("refers_to is not null").distinct()
    return hashed.join(known, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("same")), "left").select("page_id", "url", "html", "sha1", "refers_to")


def write_archives(records: DataFrame) -> DataFrame:
    """Write page_id, url, html, sha1, refers_to as WARC files; return the capture rows (CDX)."""
    spark = records.sparkSession
    ship(spark)
    base = new_path(spark, "warc")
    rows = records.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), F.col("page_id").cast("string").alias("page"), "url", F.col("html").cast("binary").alias("html"), "sha1", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(base)
        store.create_dir(root, recursive=True)
        out, name, at, turn = None, "", 0, 0
        for batch in (whole.slice(first, 200) for whole in batches for first in range(0, whole.num_rows, 200)):
            places = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "sha1", "refers_to")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, turn = f"{task.partitionId():06d}-{task.taskAttemptId()}-{turn:04d}.warc.gz", 0, turn + 1
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = _record(row[0] or "", row[1], row[2], base64.b32encode(bytes.fromhex(row[3])).decode(), row[4])
                out.write(member)
                places.append((f"{base}/{name}", at, len(member)))
                at += len(member)
            if places:
                files, offsets, lengths = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, CDX), "captures")


def build_index(captures: DataFrame, shard_rows: int = 200_000) -> DataFrame:
    """Sort captures into index shards; return one row per shard: first key, blocks file, directory file.

    A shard is a file of gzip blocks of BLOCK_LINES lines each, plus a directory
    with a line per block.  Record numbers are part of the key, so a URL with a
    third of all captures still spreads over many shards.  There are never more
    than ``MOST_SHARDS``; beyond ``shard_rows`` times that they grow instead.
    """
    spark = captures.sparkSession
    base = new_path(spark, "index")
    parts = min(MOST_SHARDS, max(1, math.ceil(captures.count() / shard_rows), spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(base)
        lines: list[str] = []
        directory: list[str] = []
        blocks, at = None, 0
        stem = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}"

        def flush() -> None:
            nonlocal blocks, at
            if blocks is None:
                store.create_dir(root, recursive=True)
                blocks = store.open_output_stream(f"{stem}.cdx.gz", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = packer.compress("\n".join(lines).encode()) + packer.flush()
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(block)}")
            blocks.write(block)
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if blocks is not None:
            blocks.close()
            with store.open_output_stream(f"{stem}.idx", compression=None) as f:
                f.write("\n".join(directory).encode())
            stem = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}"
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t", 1)[0]]), pa.array([f"{stem}.cdx.gz"]), pa.array([f"{stem}.idx"])], names=["first_key", "blocks", "directory"])

    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")
    return stored(ordered.mapInArrow(run, "first_key string, blocks string, directory string"), "shards")


class _Files:
    """A few open files, least recently used first."""

    def __init__(self, most: int = 16) -> None:
        self.most, self.files = most, OrderedDict()

    def read(self, uri: str, offset: int | None = None, length: int | None = None) -> bytes:
        if uri not in self.files:
            store, path = _open(uri)
            self.files[uri] = store.open_input_file(path)
            if len(self.files) > self.most:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(uri)
        f = self.files[uri]
        return f.read_at(f.size() if length is None else length, offset or 0)


def lookup(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Read the records of capture keys: one row per record found.

    Keys are sent to the index shard that can hold them (the list of shards has
    at most ``MOST_SHARDS`` rows), and each task reads its keys in order.
    """
    spark = keys.sparkSession
    table = sorted((r.first_key, r.blocks, r.directory) for r in shards.collect())
    schema = "key string, page string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, intact boolean"
    if not table:
        return spark.createDataFrame([], schema)
    firsts = [r[0] for r in table]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect.bisect_right(firsts, k) - 1 for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("key")], names=["shard", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        shard, block_at, heads, spots, lines, names = -2, -1, [], [], [], []
        for batch in batches:
            found = []
            for s, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if s < 0:
                    continue
                if s != shard:
                    shard, block_at = s, -1
                    entries = [x.split("\t") for x in files.read(table[s][2]).decode().split("\n")]
                    heads, spots = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]
                # equal keys (repeated rows) may run over the end of a block
                for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
                    if b != block_at:
                        lines, block_at = zlib.decompress(files.read(table[s][1], *spots[b]), 31).decode().split("\n"), b
                        names = [x.split("\t", 1)[0] for x in lines]
                    for i in range(bisect.bisect_left(names, key), bisect.bisect_right(names, key)):
                        _, file, offset, length = lines[i].split("\t")
                        found.append((key, *_summary(files.read(file, int(offset), int(length)))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(map(list, zip(*found, strict=True)), columns, strict=True)], names=[x.split()[0] for x in columns])

    columns, kinds = schema.split(", "), {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    placed = keys.select("key").distinct().mapInArrow(place, "shard int, key string")
    # a shard's keys may be dealt to several tasks: each task finds its own way
    return placed.repartitionByRange(max(len(table), spark.sparkContext.defaultParallelism), "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(run, schema)


def _summary(member: bytes) -> tuple:
    fields, http, payload = _parse(member)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = fields["WARC-Refers-To"][len("<urn:page:") : -1] if kind == "revisit" else None
    intact = kind == "revisit" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    size = len(payload) if kind == "response" else int(http["Content-Length"])
    return page, fields.get("WARC-Target-URI"), kind, refers, digest, size, intact


def read_back(captures: DataFrame, shards: DataFrame) -> DataFrame:
    """Every record through the index.

    It is an error if there are not as many as captures, or if a revisit refers to
    a page that has no response with the digest and size that the revisit tells.
    """
    found = stored(lookup(captures.select("key"), shards), "records")
    if (n := found.count()) != (wanted := captures.count()):
        raise ValueError(f"{n} records read back of {wanted} captures")
    told = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page"), "payload_digest", "payload_bytes").distinct()
    lost = told.join(found.where("record_type = 'response'").select("page", "payload_digest", "payload_bytes"), ["page", "payload_digest", "payload_bytes"], "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"revisits refer to page {lost.first().page}, which has no such response")
    return found


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, index them, and read every record back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = write_archives(with_revisits(pages))
    found = read_back(captures, build_index(captures))
    return found.select(
        F.expr("try_cast(page as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("cast(refers_to as bigint)").alias("refers_to"), F.assert_true("intact", F.lit("a payload read back differs from its digest")).isNull().alias("intact")
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i::INT + 1, 5))::INT >> s::INT) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS intact
FROM f
"""
