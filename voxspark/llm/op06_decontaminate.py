"""Benchmark decontamination with built-in functions only.

Every run of ``WINDOW`` words of a test item becomes a hashed n-gram (an item of
fewer words is one shorter n-gram).  The n-grams are counted first: up to
``BROADCAST_GRAMS`` they are broadcast as a hash table that the windows of all
training texts probe in one pass, and only one row per document and one per hit
leave the scan.  Beyond that both sides are shuffled by hash, a window as its
document's key and digest, its place and its hash without any words; the few
that meet a gram of the same hash are joined back to the documents.  A hit is
verified on the words themselves either way.

Nulls and edge cases: a null or wordless text has no words; items with a null
text are ignored, one with a null item_id hits words but is not counted or named
among the items; repeated rows (same key, same text) give one row each; equal
windows of several items (ties) count for all of them; without items nothing is
contaminated; an empty table gives an empty result.  ``find_hits`` ignores extra
columns, ``decontaminate`` keeps them, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxspark.functions.storage import stored

WINDOW = 10
BROADCAST_GRAMS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def item_grams(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (item, gram) pairs of all test items, with the hash of each gram."""
    w = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(WINDOW))
    grams = w.select("item", F.explode(F.sequence(F.lit(1), F.size("w") - span + 1)).alias("i"), "w", span.alias("len"))
    grams = grams.select("item", F.slice("w", F.col("i"), F.col("len")).alias("gram"), "len").distinct()
    return grams.withColumn("h", F.xxhash64("gram"))


def window_codes(lengths: list[int]) -> Column:
    """One code for each window of a document of ``n`` words: 16 * position + length."""
    codes = [F.expr("cast(array() as array<bigint>)")]
    for length in sorted(lengths):
        last = (F.col("n") - length) * 16 + length
        codes.append(F.when(F.col("n") >= length, F.sequence(F.lit(length).cast("long"), last, F.lit(16).cast("long"))).otherwise(codes[0]))
    return F.concat(*codes)


def window_words() -> Column:
    """The words of the window ``code`` of the words ``w``."""
    return F.slice("w", F.greatest(F.shiftright("code", 4), F.lit(0)).cast("int") + 1, F.col("code").bitwiseAND(15).cast("int"))


def probe(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """key, digest, n, code, item of every hit, and of every row once with code -1, by broadcast grams."""
    codes = F.concat(F.array(F.lit(-1).cast("long")), window_codes(lengths))
    rows = rows.select("key", "digest", "n", "w", F.explode(codes).alias("code"))
    gram = window_words()
    rows = rows.withColumn("h", F.when(F.col("code") >= 0, F.xxhash64(gram)))
    found = rows.join(F.broadcast(grams.withColumnRenamed("h", "gram_h")), (F.col("h") == F.col("gram_h")) & (gram == F.col("gram")), "left")
    return found.where("code < 0 or gram is not null").select("key", "digest", "n", "code", "item", (F.col("code") < 0).alias("first"))


def candidates(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """key, digest, code, item, gram where the hashes of a window and of a gram are equal, by a shuffle without words of documents."""
    windows = rows.select("key", F.unhex("digest").alias("digest"), "w", F.explode(window_codes(lengths)).alias("code"))
    windows = windows.select("key", "digest", "code", F.xxhash64(window_words()).alias("h"))
    met = windows.join(grams.hint("shuffle_merge"), "h").select("key", "digest", "code", "item", "gram").distinct()
    return met.withColumn("digest", F.lower(F.hex("digest")))


def join_back(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The rows of :func:`probe` for any number of grams: candidates verified on the words of their documents."""
    turn = F.row_number().over(Window.partitionBy("key", "digest").orderBy("code"))
    met = stored(candidates(rows, grams, lengths).withColumn("turn", turn), "candidates")
    few = met.count() <= BROADCAST_GRAMS
    met = met.withColumnsRenamed({"key": "met_key", "digest": "met_digest"})
    same = F.col("key").eqNullSafe(F.col("met_key")) & (F.col("digest") == F.col("met_digest"))
    found = rows.join(F.broadcast(met) if few else met, same, "left")
    real = F.col("gram") == window_words()
    return found.select("key", "digest", "n", F.when(real, F.col("code")).otherwise(-1).alias("code"), F.when(real, F.col("item")).alias("item"), (F.coalesce("turn", F.lit(1)) == 1).alias("first"))


def find_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, spans (position and length in words, in order), items (sorted), copies."""
    grams = item_grams(items)
    shape = grams.agg(F.count("*").alias("n"), F.collect_set("len").alias("lengths")).first()
    rows = docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), words(F.col(text)).alias("w")).withColumn("n", F.size("w").cast("long"))
    found = (probe if shape.n <= BROADCAST_GRAMS else join_back)(rows, grams, shape.lengths)
    hit = F.struct(F.shiftright("code", 4).alias("at"), F.col("code").bitwiseAND(15).alias("len"))
    return found.groupBy("key", "digest").agg(
        F.max("n").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("code") >= 0, hit))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
        F.count(F.when(F.col("first"), 1)).alias("copies"),
    )


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are in order of position."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(s["end"], x["at"]))).alias("n")), lambda s: s["n"])


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans; what stood between words stays."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    whole, between = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word)
    kept = F.transform(whole, lambda w, i: F.when(F.exists(spans, lambda s: (i >= s["at"]) & (i < s["at"] + s["len"])), F.lit("")).otherwise(w))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(between[0], F.array_join(F.transform(kept, lambda w, i: F.concat(w, F.get(between, i + 1))), "")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no window of any item; all columns kept.

    The contaminated ones are a stored table of keys and digests, broadcast
    while it is short, so no text is shuffled then.
    """
    bad = stored(find_hits(docs, items, key, text).where(F.size("spans") > 0).select("key", "digest"), "contaminated")
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    few = bad.count() <= BROADCAST_GRAMS
    bad = bad.withColumnsRenamed({"key": free + "key", "digest": free + "digest"})
    same = F.col(key).eqNullSafe(F.col(free + "key")) & (F.md5(F.coalesce(F.col(text), F.lit(""))) == F.col(free + "digest"))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document hit by benchmark windows, and the items they are from."""
    hits = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = hits.select(
        F.col("key").alias("doc_id"),
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


ORACLE_SQL = """
WITH items AS (
  SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i+9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS gram FROM items
), docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM documents
), lengths AS (SELECT DISTINCT len(gram) AS k FROM grams), windows AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM docs, lengths
), hits AS (
  SELECT doc_id, p, k, item FROM windows JOIN grams ON w[p:p+k-1] = gram
), cover AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
