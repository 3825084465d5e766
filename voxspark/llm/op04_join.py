"""N-gram Jaccard join with PartEnum signatures.

Steps: (1) every text becomes its set of shingles, and documents with equal sets
a class; (2) the sets are signed (``partenum``) and the signatures dealt out, 32
bits each, packed into one binary per chunk of documents and partition; a
partition sorts them and lists the classes that share one; (3) the classes of
each list are compared with the list's center, by sketches that bound the
difference of two sets from below, then on the sets themselves; (4) around a
center, classes that are still in different components are compared in blocks,
inside the task, by sketches, and what is left on the sets.  Texts are read again
only for the classes that a step asks for.

All links between different texts are found; pairs are never listed within a
group of copies, and classes that are connected already are not compared again.
Classes that share signatures but stay apart are compared block by block, so a
crowd of such texts around one center costs its square in byte comparisons.

Nulls and edge cases: a null or wordless text has no shingles and its own
component; texts of fewer than five words are one shingle; repeated rows and
equal texts share a class; where one key has several texts they count as one
document; null keys get a null component; keys are of any type that can be
ordered; an empty table gives an empty result.  Extra columns are ignored by
``similarity_components`` and kept by ``drop_near_copies``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import drop, stored
from voxspark.functions.workers import hold, ship
from voxspark.llm import partenum
from voxspark.operators.graph import connected_components

CHUNK_FEATURES = 1_000_000
PART_FEATURES = 300_000
TASK_FEATURES = 10_000_000
HOLD_SIGNATURES = 5_000_000
SEEN_LISTS = 1_000_000
BROADCAST_KEYS = 500_000
BLOCK = 300


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _class(features: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(features.tobytes())


def document_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, cls, id) of every row: set size, 128-bit digest of the set and its first half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("op4", partenum.forget)
        for batch in batches:
            sets = [partenum.shingles(x.as_py()) for x in batch.column("text")]
            cls = [_class(s) for s in sets]
            half = np.frombuffer(b"".join(c[:8] for c in cls), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(half)], names=["key", "n", "cls", "id"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {_kind(docs, key)}, n long, cls binary, id long")


def _pack(sets: dict[bytes, np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """Signatures of a chunk as (part, count, low halves in order of their sets, steps from set to set)."""
    signature, owner = partenum.signatures(list(sets.values()))
    part = ((signature >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((owner, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    low, owner = signature.astype(np.uint32)[order], owner[order].astype(np.uint16)
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[p], cuts[p + 1]
        steps = np.diff(owner[a:b], prepend=np.uint16(0))
        yield p, int(b - a).to_bytes(4, "little") + low[a:b].tobytes() + (steps.astype(np.uint8) if steps.max() < 256 else steps).tobytes()


def _unpack(part: int, chunk: int, blob: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and tickets (chunk and place in it)."""
    m = int.from_bytes(blob[:4], "little")
    low = np.frombuffer(blob, dtype=np.uint32, count=m, offset=4)
    steps = np.frombuffer(blob, dtype=np.uint8 if len(blob) == 4 + 5 * m else np.uint16, count=m, offset=4 + 4 * m)
    return low.astype(np.uint64) | np.uint64(part << 32), chunk + np.cumsum(steps, dtype=np.int64)


def _lists(signature: np.ndarray, ids: np.ndarray, by_bucket: bool, seen: set[int]) -> Iterator[tuple[int, list[int]]]:
    """(list key, ids) of the signatures with several ids; lists keyed by content that were ``seen`` are left out."""
    order = np.argsort(signature, kind="stable")
    same = np.diff(signature[order]) == 0
    shared = np.zeros(len(order), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    signature, ids = signature[order], ids[order]
    if not len(signature):
        return
    order = np.lexsort((ids, signature))
    signature, ids = signature[order], ids[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (signature[1:] != signature[:-1]) | (ids[1:] != ids[:-1])
    signature, ids = signature[fresh], ids[fresh]
    first = np.flatnonzero(np.diff(signature, prepend=~signature[0]) != 0)
    size = np.diff(np.append(first, len(ids)))
    for start, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = ids[start : start + n]
        key = xxhash.xxh3_64_intdigest(signature[start].tobytes() if by_bucket else members.tobytes())
        if by_bucket or key not in seen:
            if not by_bucket:
                seen.add(key)
            yield key - (1 << 63), members.tolist()


def candidate_lists(docs: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """(list, key) of the classes that share a signature, each class by its smallest key; a stored table.

    Signatures carry a ticket, 48 bits of their chunk and the set's place in it;
    the classes of a chunk's places go along as one row.  A chunk is named by the
    classes in it, so a task that runs again gives the same names or others that
    fit as well.
    """
    features = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a task takes its parts one after the other, and lists that several of them have once
    slots = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(features / TASK_FEATURES))
    parts = max(4 * slots, math.ceil(features / PART_FEATURES))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = list(_pack(chunk, parts))
            ids = b"".join(c[:8] for c in chunk)
            name = xxhash.xxh3_64_intdigest(ids) >> 16 << 16
            name -= (name >> 63) << 64
            chunk.clear()
            rows.append((-1 - (name >> 16) % parts, ids))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "chunk", "blob"])

        hold("op4", partenum.forget)
        chunk: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            for x in batch.column(text):
                features = partenum.shingles(x.as_py())
                cls = _class(features)
                if len(features) and cls not in chunk:
                    chunk[cls] = features
                    held += len(features)
                    if held >= CHUNK_FEATURES or len(chunk) >= 60_000:
                        yield flush()
                        held = 0
        if chunk:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(lists: list, chunk: int | None) -> Iterator[pa.RecordBatch]:
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in lists], pa.int64()), pa.array([chunk] * len(lists), pa.int64()), pa.array([r[1] for r in lists], pa.list_(pa.int64()))], names=["list", "chunk", "ids"])

        def flush(by_bucket: bool) -> Iterator[pa.RecordBatch]:
            signature, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            if len(seen) > SEEN_LISTS:
                seen.clear()
            yield from rows_of(list(_lists(signature, ids, by_bucket, seen)), None)
            if by_bucket:  # a hot part goes on with one id of each signature
                keep = np.unique(signature, return_index=True)[1]
                held.append((signature[keep], ids[keep]))

        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        now, size, limit, split = None, 0, HOLD_SIGNATURES, False
        for batch in batches:
            for part, chunk, blob in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                if part < 0:  # the classes of a chunk
                    yield from rows_of([(None, np.frombuffer(blob.as_buffer(), dtype=np.int64).tolist())], chunk)
                    continue
                if part != now:
                    if held:
                        yield from flush(split)
                    held.clear()
                    now, size, limit, split = part, 0, HOLD_SIGNATURES, False
                held.append(_unpack(part, chunk, memoryview(blob.as_buffer())))
                size += len(held[-1][0])
                if size >= limit:
                    split = True
                    yield from flush(True)
                    size = len(held[0][0])
                    limit = max(HOLD_SIGNATURES, 2 * size)
        if held:
            yield from flush(split)

    blobs = docs.select(text).mapInArrow(sign, "part int, chunk long, blob binary")
    found = stored(blobs.repartition(slots, "part").sortWithinPartitions("part").mapInArrow(gather, "list long, chunk long, ids array<long>"), "lists")
    lists = found.where("list is not null").dropDuplicates(["list", "ids"]).select("list", F.explode("ids").alias("ticket"))
    places = found.where("chunk is not null").select("chunk", F.posexplode("ids").alias("place", "id"))
    # the first 64 bits of a digest name a class; two classes of one name are both candidates
    places = places.select((F.col("chunk") + F.col("place")).alias("ticket"), "id").distinct().join(classes.select("id", F.col("rep").alias("key")), "id")
    members = stored(lists.join(places.select("ticket", "key"), "ticket").select("list", "key").distinct(), "members")
    drop(found)
    return members


def read_sets(docs: DataFrame, keys: DataFrame, key: str, text: str, sketches: bool) -> DataFrame:
    """(key, n, band, cut, content) of the rows whose key is asked for: both sketches and the length of the first, or the features."""
    wanted = _small(stored(keys.select("key").distinct(), "wanted"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("op4", partenum.forget)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [partenum.shingles(x.as_py()) for x in part.column("text")]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                contents = [(partenum.sketch(s) if sketches else s.tobytes()) if len(s) else b"" for s in sets]
                arrays = [part.column("key"), pa.array(sizes), pa.array(partenum.band_of(sizes), pa.int32()), pa.array([partenum.cell_counts(n)[0] for n in sizes], pa.int32()), pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "band", "cut", "content"])

    return stored(rows.mapInArrow(run, f"key {_kind(docs, key)}, n long, band int, cut int, content binary"), "sets")


def _small(df: DataFrame) -> DataFrame:
    """A stored table of keys or pairs, broadcast while it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _grouped(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal values of some columns, as slices of the batches."""
    now, held = None, []
    for batch in batches:
        groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        start = 0
        while start < len(groups):
            stop = start
            while stop < len(groups) and groups[stop] == groups[start]:
                stop += 1
            if groups[start] != now and held:
                yield now, held
                held = []
            now = groups[start]
            held.append(batch.slice(start, stop - start))
            start = stop
    if held:
        yield now, held


def beside_hubs(pairs: DataFrame, sets: DataFrame, test: Callable[[int, bytes, int, bytes], bool]) -> DataFrame:
    """The pairs (hub, key), a stored table, whose contents pass a test.

    A hub's pairs are dealt into blocks; the hub is sent once to each block and
    every key once for each of its hubs, so nothing is shipped twice for a pair.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = stored(pairs.join(_small(stored(sizes, "sizes")), "hub", "left").select("hub", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), "key"), "dealt")
    places = dealt.select("hub", "block", "key", F.lit(1).alias("place")).union(dealt.select("hub", "block", F.col("hub").alias("key"), F.lit(0).alias("place")).distinct())
    rows = sets.join(_small(stored(places, "places")), "key").repartition("hub", "block").sortWithinPartitions("hub", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for batch in batches:
            keep = []
            for i, (h, b, place, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "place", "n")), strict=True)):
                content = batch.column("content")[i].as_buffer()
                if place == 0:
                    if now != (h, b):
                        now, hub = (h, b), []
                    hub.append((n, content))  # one, but for keys with several texts
                elif now == (h, b):
                    if any(test(*own, n, content) for own in hub):
                        keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("hub"), part.column("key")], names=["hub", "key"])

    return rows.mapInArrow(run, f"hub {_kind(pairs, 'hub')}, key {_kind(pairs, 'key')}").distinct()


def _linked(n: int, one: bytes, m: int, other: bytes) -> bool:
    return partenum.linked(np.frombuffer(one, dtype=np.uint64), np.frombuffer(other, dtype=np.uint64))


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (hub, key), a stored table, that are links, by their whole sets; a stored table as well."""
    sets = read_sets(docs, pairs.select("key").union(pairs.select("hub")), key, text, sketches=False)
    links = stored(beside_hubs(pairs, sets, _linked), "links")
    drop(sets)
    return links


def star_pairs(members: DataFrame) -> DataFrame:
    """(hub, key): every class of a list beside the list's center; a stored table, ``members`` is dropped.

    The center is the class that is in most lists: the text that others were
    copied from shares more signatures with the copies than they share.
    """
    degree = members.groupBy("key").agg(F.count("*").alias("degree"))
    ranked = stored(members.join(degree, "key"), "ranked")
    most = ranked.groupBy("list").agg(F.max("degree").alias("degree"))
    center = ranked.join(most, ["list", "degree"]).groupBy("list").agg(F.min("key").alias("hub"))
    star = stored(ranked.select("list", "key").join(center, "list").where("key <> hub").select("hub", "key").distinct(), "star")
    drop(members, ranked)
    return star


def open_pairs(star: DataFrame, components: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (hub, key) of different components around one center that their sketches cannot rule out.

    The classes of a list all stand around its center, so every pair of a list
    is compared, and a pair around one center only once.  Only sets of one band,
    or of a band and the one below, can be links, so each band of a center is a
    group of its own.  Most of a large group is in one component: these classes
    are dealt into blocks, and the others, in blocks as well, meet each of them
    and each other.
    """
    kind = _kind(star, "key")
    around = star.select("hub", "key").union(star.select("hub", F.col("hub").alias("key")).distinct())
    around = around.join(components.withColumnRenamed("node", "key"), "key", "left").select("hub", "key", F.coalesce("root", "key").alias("root"))
    around = stored(around.join(sketches.select("key", "band").distinct(), "key").select("hub", "key", "root", "band", F.explode(F.array("band", F.col("band") + 1)).alias("level")), "around")
    roots = around.groupBy("hub", "level", "root").agg(F.count("*").alias("n"), F.max(F.col("level") == F.col("band")).alias("own"))
    groups = roots.groupBy("hub", "level").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("big"), F.sum("n").alias("all"), F.count("*").alias("roots"), F.max("own").alias("own"))
    groups = stored(groups.where("roots > 1 and own").select("hub", "level", "top", F.ceil(F.col("big") / BLOCK).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("big")) / BLOCK).cast("int").alias("rests")), "mixed")
    dealt = around.join(_small(groups), ["hub", "level"]).withColumn("is_top", F.col("root") == F.col("top"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("key"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))

    def upto(n: str, i: str, j: str) -> Column:
        return F.expr(f"transform(sequence(0, {n} - 1), x -> struct({i} as i, {j} as j))")

    # block i of the top component with block j of the rest, or (from tops on) two blocks of the rest
    met = F.when(F.col("is_top"), upto("rests", "side", "x")).otherwise(F.concat(upto("tops", "x", "side"), upto("rests", "tops + least(x, side)", "greatest(x, side)")))
    places = dealt.withColumn("met", F.explode(met)).select("hub", "level", "met.i", "met.j", "tops", F.when(F.col("met.i") < F.col("tops"), F.col("is_top").cast("int")).otherwise(F.col("side")).alias("side"), "root", "key")
    rows = sketches.join(_small(stored(places, "places")), "key")
    own = F.col("band") == F.col("level")
    rows = rows.select("hub", "level", "i", "j", "tops", "side", "root", "key", "n", own.alias("own"), F.when(own, F.expr("substring(content, 1, cut)")).otherwise(F.expr("substring(content, cut + 1)")).alias("sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j, tops), held in _grouped(batches, "hub", "level", "i", "j", "tops"):
            group = pa.Table.from_batches(held)
            columns = {c: group.column(c).to_numpy() for c in ("n", "own", "side")}
            root = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
            grid = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(root), -1)
            u, v = partenum.cross_pairs(root, columns["n"], columns["own"], columns["side"], grid, i - tops == j)
            if len(u):
                key = group.column("key").combine_chunks()
                yield pa.RecordBatch.from_arrays([key.take(pa.array(u)), key.take(pa.array(v))], names=["u", "v"])

    found = rows.repartition("hub", "level", "i", "j").sortWithinPartitions("hub", "level", "i", "j").mapInArrow(run, f"u {kind}, v {kind}")
    return found.select(F.greatest("u", "v").alias("hub"), F.least("u", "v").alias("key")).distinct()


def similarity_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable over links) of every row."""
    ship(docs.sparkSession)
    meta = stored(document_sets(docs, key, text), "meta")
    classes = stored(meta.where("n > 0 and key is not null").groupBy("cls", "id").agg(F.min("key").alias("rep"), F.first("n").alias("n")), "classes")
    star = star_pairs(candidate_lists(docs, text, classes))
    sketches = read_sets(docs, star.select("key").union(star.select("hub")), key, text, sketches=True)
    close = stored(beside_hubs(star, sketches, partenum.may_link), "close")
    links = verified(close, docs, key, text)
    components = stored(connected_components(links.withColumnsRenamed({"hub": "u", "key": "v"})), "components")
    apart = stored(open_pairs(star, components, sketches), "open")
    drop(sketches)
    more = verified(apart, docs, key, text)
    if not more.isEmpty():
        components = connected_components(components.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    found = meta.join(classes.select("cls", "rep"), "cls", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("key", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "key").alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: that with the smallest key; rows with a null key stay.

    The keys to drop are a stored table, broadcast only while they are few.
    """
    found = stored(similarity_components(docs, key, text).select("key", "component_id"), "components")
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    gone = stored(found.where("key > component_id").select(F.col("key").alias(free)).distinct(), "gone")
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, docs[key] == F.col(free), "left_anti")
    again = stored(found.where("key = component_id").groupBy("key").count().where("count > 1").select(F.col("key").alias(free)), "again")
    if again.isEmpty():
        return out
    # rows of one key: only these are shuffled
    small = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    return out.join(small, out[key] == F.col(free), "left_anti").unionByName(out.join(small, out[key] == F.col(free), "left_semi").dropDuplicates([key]))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by 5-word shingles at a similarity of 0.8 or more."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("key", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 80 * (nu.n + nv.n - c)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.u = d.doc_id
"""
