"""Alignment of two tokenizers over the bytes of the same text.

A tokenization is an incidence matrix of tokens and bytes in compressed rows
(CSR).  Row products A·Bᵀ (Gustavson's order: a row of A picks rows of Bᵀ and
adds them up) give the *overlap links*, pairs of tokens with the number of bytes
that they share.  Offsets where tokens of both end cut a text into *groups*; the
products of the incidences of tokens and groups give the *shared-group links*,
here with equal ids of a group merged, so that a row of the product has a column
for each id pair and their number of occurrences as its value.

The count of an id pair is the number of documents that hold it linked.  Pairs
are counted with partial sums in every task; counts go back to the documents in
two ways at any size: pairs with at least a ``FREQUENT``th of all (document, pair)
rows, of which there can be no more than ``FREQUENT``, by broadcast, the rest,
none of which is hot, by a shuffle on the pair.

Nulls and edge cases: a null or empty text, or one whose tokens of either side
do not spell a space and the text, has no tokens, links or groups, and a
groups_sha256 of ``''``; strings of special tokens inside a text are text; very
long texts are encoded whole, products of long groups are made row by row in
slices of ``SLICE`` pairs; repeated rows are documents of their own; an empty
table gives an empty result.  Other columns than key and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.functions.workers import hold, ship

FREQUENT = 100_000  # most pairs that are broadcast
SLICE = 1 << 20  # pairs of a product that are made at a time
SHIFT = 20  # bits of an id of the second tokenizer inside a pair
SPACE = "▁"
PARTS, LONG_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s{200}")
RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
MOST_PARTS = 200_000  # parts whose links a worker keeps
BATCH = 200_000  # characters that are aligned at a time; a longer text comes alone


class Csr(NamedTuple):
    """Compressed rows: the columns and values of row i are at ``starts[i]:starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Csr:
        """Rows and columns exchanged; the rows stay in order inside each column."""
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), rows[order], self.values[order], len(self.starts) - 1)


def summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in order, with the sums of their values."""
    if (places[1:] < places[:-1]).any():
        order = np.argsort(places)
        places, values = places[order], values[order]
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    return places[starts], np.add.reduceat(values, starts) if len(starts) else values


def gustavson(a: Csr, b: Csr, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (rows, columns, values) of the product of two matrices, in the order of the rows.

    Every entry of a row of ``a`` picks a row of ``b``; what falls on the same
    place is added up.  A slice takes whole rows of ``a`` with at most ``most``
    products, or one row if that alone has more.
    """
    reach = np.diff(b.starts)[a.columns]  # products of each entry of a
    made = np.concatenate([[0], np.cumsum(reach)])[a.starts]  # products before each row of a
    first, n = 0, len(a.starts) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(made, made[first] + most, side="right")) - 1)
        entries = slice(a.starts[first], a.starts[end])
        each = reach[entries]
        rows = np.repeat(np.repeat(np.arange(first, end), np.diff(a.starts[first : end + 1])), each)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(b.starts[a.columns[entries]], each)
        values = np.repeat(a.values[entries], each) * b.values[at]
        places, values = summed(rows * b.width + b.columns[at], values)
        yield places // b.width, places % b.width, values
        first = end


def token_bytes(lengths: np.ndarray) -> Csr:
    """The incidence of tokens, one after the other, and bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], dtype=np.int64), int(ends[-1]))


def id_groups(ids: np.ndarray, groups: np.ndarray, n_groups: int) -> tuple[Csr, np.ndarray]:
    """The incidence of the distinct ids of each group and the groups, and the id of each row."""
    places, counts = summed(groups << SHIFT | ids, np.ones(len(ids), dtype=np.int64))
    return Csr(np.arange(len(places) + 1), places >> SHIFT, counts, n_groups), places & ((1 << SHIFT) - 1)


def overlaps(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in A, place in B, shared bytes) of the tokens that overlap, in order."""
    found = list(gustavson(token_bytes(length_a), token_bytes(length_b).transposed()))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (EMPTY, EMPTY, EMPTY)


class Alignment(NamedTuple):
    """What links two tokenizations of some documents, one after the other."""

    group_a: np.ndarray  # of each token; groups are numbered through all documents
    group_b: np.ndarray
    overlap_a: np.ndarray  # the place in A of each pair of tokens that share a byte
    doc: np.ndarray  # of each group
    pairs: np.ndarray  # document << 2 * SHIFT | id of A << SHIFT | id of B, distinct
    links: np.ndarray  # linked occurrences of each pair


EMPTY = np.zeros(0, dtype=np.int64)
NONE = Alignment(*[EMPTY] * 6)


def align(a: np.ndarray, length_a: np.ndarray, b: np.ndarray, length_b: np.ndarray, doc_a: np.ndarray) -> Alignment:
    """Groups, id pairs and links of two tokenizations that spell the same documents.

    From one overlap link to the next either one side goes on, inside a group,
    or both do, where both ended at the same offset.
    """
    if not len(a):
        return NONE
    at_a, at_b, _ = overlaps(length_a, length_b)
    next_a, next_b = np.diff(at_a, prepend=-1) > 0, np.diff(at_b, prepend=-1) > 0
    group = np.cumsum(next_a & next_b) - 1
    group_a, group_b, n_groups = group[next_a], group[next_b], int(group[-1]) + 1
    doc = doc_a[np.flatnonzero(np.diff(group_a, prepend=-1))]
    left, ids_a = id_groups(a, group_a, n_groups)
    right, ids_b = id_groups(b, group_b, n_groups)
    pairs, links = EMPTY, EMPTY
    for rows, columns, values in gustavson(left, right.transposed()):
        codes = doc[left.columns[rows]] << 2 * SHIFT | ids_a[rows] << SHIFT | ids_b[columns]
        pairs, links = summed(np.concatenate([pairs, codes]), np.concatenate([links, values]))
    return Alignment(group_a, group_b, at_a, doc, pairs, links)


class Tokenizers:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, spec_a: str, model_b: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(spec_a)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, token)): number for token, number in spec["model"]["vocab"].items() if token not in special}
        self.slow_a = Tokenizer.from_str(spec_a)
        self.slow_a.encode_special_tokens = True
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.bytes_a[number] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.length_a, self.length_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))

        self.across = any(SPACE in piece.lstrip(SPACE) for piece in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.forget()
        self.words_a, self.words_b = spellings(len(self.bytes_a), "|"), spellings(len(self.bytes_b), ";")

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides for a space and the text; none if a side does not spell it."""
        if not text:
            return EMPTY, EMPTY
        whole = " " + text
        if (any(pair in text for pair in ("  ", "\n\n")) or any(c in text for c in RARE_SPACES)) and LONG_SPACE.search(text):  # too deep for the pattern machine of the fast library
            a = np.array(self.slow_a.encode(whole, add_special_tokens=False).ids, dtype=np.int64)
        else:
            a = self.a.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
        b = self.b.encode(text)
        spelled = whole.encode("utf-8", "surrogatepass")
        if self.a.decode_bytes(a.tolist()) != spelled or b"".join(map(self.bytes_b.__getitem__, b)) != spelled:
            return EMPTY, EMPTY
        return a, np.array(b, dtype=np.int64)

    def parts(self, text: str) -> list[str]:
        """What is between single spaces: no token of either side goes over the space before a part."""
        if self.across:
            return [text]
        odd = text[0] == " " or text[-1] == " " or any(pair in text for pair in ("  ", " \n", "\n ")) or any(c in text for c in RARE_SPACES)
        return PARTS.split(text) if odd else text.split(" ")

    def together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens of A by part, ids of B, tokens of B by part) of parts with spaces between them."""
        a, b = self.encode(" ".join(parts))
        if not len(a) and len(parts) > 1:  # some part is not spelled: look for it in halves
            half = len(parts) // 2
            return tuple(map(np.concatenate, zip(self.together(parts[:half]), self.together(parts[half:]), strict=True)))
        ends = np.cumsum([len(part.encode("utf-8", "surrogatepass")) + 1 for part in parts])
        counts = [np.diff(np.searchsorted(np.cumsum(length[ids]), ends, side="right"), prepend=0) for ids, length in ((a, self.length_a), (b, self.length_b))]
        return a, counts[0], b, counts[1]

    def learn(self, parts: list[str]) -> None:
        """Align parts that were not seen before and keep what came out."""
        odd = [part for part in parts if not part or part[0].isspace() or part[-1].isspace()]  # these come alone
        parts, n = [*(plain := list(set(parts).difference(odd))), *odd], len(parts)
        sizes = np.cumsum(list(map(len, plain)))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH)) + 1).tolist(), len(plain)]
        found = [self.together(plain[i:j]) for i, j in pairwise(cuts) if j > i] + [self.together([part]) for part in odd]
        a, n_a, b, n_b = map(np.concatenate, zip(*found, strict=True))
        doc_a = np.repeat(np.arange(n), n_a)
        found = align(a, self.length_a[a], b, self.length_b[b], doc_a)
        n_groups, n_overlaps = np.bincount(found.doc, minlength=n), np.bincount(doc_a[found.overlap_a], minlength=n)
        starts = np.searchsorted(found.pairs >> 2 * SHIFT, np.arange(n + 1))
        old = self.seen
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_overlaps], axis=1)])
        columns = found.pairs & ((1 << 2 * SHIFT) - 1)
        self.seen = Csr(np.concatenate([old.starts, old.starts[-1] + starts[1:]]), np.concatenate([old.columns, columns]), np.concatenate([old.values, found.links]), 1 << 2 * SHIFT)
        words, ends = self.spelled(a, b, found), np.cumsum(np.add(n_a, n_b)).tolist()
        self.words += ["".join(words[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
        self.places |= {part: k for k, part in enumerate(parts, len(self.places))}

    def forget(self) -> None:
        """Start anew, with bounded memory."""
        self.places: dict[str, int] = {}
        self.words: list[str] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.seen = Csr(np.zeros(1, dtype=np.int64), EMPTY, EMPTY, 1 << 2 * SHIFT)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, pairs, links) of each text.

        The incidence of texts and parts times that of parts and id pairs has the
        links of each text.
        """
        n, lists = len(texts), [self.parts(text) if text else [] for text in texts]
        flat = list(chain.from_iterable(lists))
        if len(self.places) > MOST_PARTS or len(self.seen.columns) > 8 * MOST_PARTS:
            self.forget()
        if new := set(flat).difference(self.places):
            self.learn(list(new))
        every, size = np.fromiter(map(self.places.__getitem__, flat), dtype=np.int64, count=len(flat)), np.array(list(map(len, lists)), dtype=np.int64)
        rows = np.repeat(np.arange(n), size)
        spoiled = np.unique(rows[self.counts[every, 0] == 0])  # a part that is not spelled spoils its text
        if len(spoiled):
            every, size[spoiled] = every[~np.isin(rows, spoiled)], 0
            rows = np.repeat(np.arange(n), size)
        starts = np.concatenate([[0], np.cumsum(size)])
        counts = [np.bincount(rows, weights=column[every], minlength=n).astype(np.int64).tolist() for column in self.counts.T]
        made = list(gustavson(Csr(starts, every, np.ones(len(every), dtype=np.int64), len(self.places)), self.seen))
        docs, pairs, links = map(np.concatenate, zip(*made, strict=True)) if made else (EMPTY, EMPTY, EMPTY)
        ends, n_links, places, out = np.searchsorted(docs, np.arange(n + 1)).tolist(), np.bincount(docs, weights=links, minlength=n).astype(np.int64).tolist(), every.tolist(), []
        for k in range(n):
            text = "".join(map(self.words.__getitem__, places[starts[k] : starts[k + 1]]))[:-1]
            own = slice(ends[k], ends[k + 1])
            out.append((*[column[k] for column in counts], n_links[k], hashlib.sha256(text.encode()).hexdigest() if text else "", pairs[own], links[own]))
        return out

    def spelled(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> list[str]:
        """``a1,a2|b1;a3|b2,b3;``: the ids of each group in order, each with the sign behind it."""
        out = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = (np.diff(group, append=-1) != 0 for group in (found.group_a, found.group_b))
        starts_b = np.searchsorted(found.group_b, found.group_a)  # tokens of B in the groups before
        ends_a = np.searchsorted(found.group_a, found.group_b, side="right")
        out[np.arange(len(a)) + starts_b] = self.words_a[2 * a + last_a]
        out[np.arange(len(b)) + ends_a] = self.words_b[2 * b + last_b]
        return out.tolist()


def spellings(n: int, last: str) -> np.ndarray:
    """Each id with a comma, and with the sign that ends its side of a group."""
    return np.array([f"{i}{sign}" for i in range(n) for sign in (",", last)], dtype=object)


#: fixed value: how byte-level BPE of this vocabulary cuts a text before merging
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_LOADED: dict[str, Tokenizers] = {}


def tokenizers(spec_a: str, model_b: bytes) -> Tokenizers:
    """The tokenizers of two files, loaded once per worker."""
    key = hashlib.md5(spec_a.encode() + model_b).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(spec_a, model_b)
    return _LOADED[key]


FIELDS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_overlaps": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<long>", "links": "array<long>"}
TYPES = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int64())] * 2


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, pairs (array), links (array): one row a document."""
    spark = docs.sparkSession
    ship(spark)
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from voxspark.llm import op12_alignment as own  # the worker's copy keeps its tokenizers between tasks

        hold("op12", own._LOADED.clear)
        both = own.tokenizers(*files.value)
        for batch in batches:
            sizes = np.cumsum([len(body) if body else 0 for body in batch.column("text").to_pylist()])
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes // BATCH)) + 1):
                rows = batch.slice(part[0], len(part)) if len(part) else batch.slice(0, 0)
                found = both.align(rows.column("text").to_pylist())
                columns = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True) if found else [[]] * len(TYPES), TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("key"), *columns], names=["key", *FIELDS])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(map(" ".join, FIELDS.items()))).withColumn("row", F.monotonically_increasing_id())


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (no pair of its first id has a higher count)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    return stored(counts, "alignment-counts")


def weighed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum: the links of each document by the counts of their pairs."""
    first = F.shiftright("pair", SHIFT)
    top = counts.groupBy(first.alias("a")).agg(F.max("count").alias("top"))  # a row for each id of the first vocabulary
    counts = stored(counts.withColumn("a", first).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "alignment-weights")
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = F.broadcast(counts.where(F.col("count") * FREQUENT >= total))  # at most FREQUENT rows
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")]
    common = each.join(frequent, "pair").groupBy("row").agg(*sums)
    rare = each.join(frequent, "pair", "left_anti").join(counts.where(F.col("count") * FREQUENT < total), "pair").groupBy("row").agg(*sums)
    return common.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def default_paths() -> tuple[str, str]:
    """The byte-level and the piece vocabulary of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, weighed by the counts of their id pairs."""
    rows = stored(aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths()), "alignment-rows")
    sums = weighed(rows, pair_counts(rows))
    count = ["n_a", "n_b", "n_groups", "n_overlaps", "n_links"]
    out = rows.select("row", F.col("key").cast("long").alias("doc_id"), *count, "groups_sha256").join(sums, "row", "left")
    return out.select("doc_id", *count, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
