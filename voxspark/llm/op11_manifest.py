"""Merkle manifest of a dataset by bitmap ranks.

Documents are leaves of a tree for each group (source); the roots of the groups,
in the order of the groups, are leaves of the tree above.  ``ARITY`` consecutive
nodes become one, the last run of a level may be shorter.

The place of a leaf among the keys of its group is found without sorting the
documents.  Keys are bits: 64 keys a word, 64 words a container.  Partial bitmaps
are merged by group and container; a container keeps its words that are not
empty, packed, a bitmap of which ones these are, and a directory of the rows
before each word; running sums of the containers give the rows before each of
them.  A rank query is then two popcounts and two additions.

The places are keys of slot arrays: ``BLOCK`` consecutive leaves are one array
that a task reduces by several levels at once, the nodes left over are placed and
reduced in the same way, until each group has one.  Going down again, every block
learns the siblings above it, so a leaf gets its whole path from one array.

Nulls and edge cases: null groups come first, then groups by their bytes; rows
with a null key are the first leaves of their group; rows of a group with equal
keys are placed one after the other by their digests (equal rows in any order,
so the rows of the result are the same), numbered in ranges however many there
are; a lone leaf is the root of its group, a lone group that of the dataset; very
long texts are hashed whole and read once; an empty table gives an empty result.
Extra columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.operators.sampling import number_rows, running_sum

ARITY, ROUND = 3, 6  # children of a node, levels of a slot array
BLOCK = ARITY**ROUND
NO_KEY = -(1 << 52) - 1  # the container of null keys, before all others
POWERS = ", ".join(f"{ARITY**k}L" for k in range(40))  # all that a long can hold

#: the levels of a slot array ``d``, the array itself first; ``t`` of them are made
LEVELS = f"aggregate(if(t > 0, sequence(1, t), cast(array() as array<int>)), cast(array(d) as array<array<string>>), (made, k) -> concat(made, array(transform(sequence(0, cast((size(element_at(made, -1)) - 1) div {ARITY} as int)), j -> sha2(cast(array_join(slice(element_at(made, -1), j * {ARITY} + 1, {ARITY}), '') as binary), 256)))))"
#: the siblings to the left and right of the node above slot ``s`` in each of these levels
SIBLINGS = f"""transform(if(t > 0, sequence(1, t), cast(array() as array<int>)), k -> transform(array(cast(s div element_at(array({POWERS}), k) as int)), at -> named_struct(
'left', array_join(slice(element_at(lv, k), at - at % {ARITY} + 1, at % {ARITY}), ''), 'right', array_join(slice(element_at(lv, k), at + 2, {ARITY - 1} - at % {ARITY}), '')))[0])"""
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    """The leaf of a document."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def containers(rows: DataFrame) -> DataFrame:
    """rows(g, key) -> g, chunk, top, words, before, again, base, total, gid: the merged bitmaps with their directories.

    ``again`` has, for each word, the keys that several rows have and how many
    rows more than one these are.
    """
    counts = rows.groupBy("g", "chunk", "word", "bit").agg(F.count("*").alias("n")).repartition("g", "chunk")  # one row a key
    words = counts.groupBy("g", "chunk", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.sum("n").alias("n"), F.expr("collect_list(if(n > 1, struct(bit, n - 1 AS more), NULL))").alias("again"))
    packed = words.groupBy("g", "chunk").agg(F.expr("bit_or(shiftleft(1L, word))").alias("top"), F.sum("n").alias("n"), F.expr("array_sort(collect_list(struct(word, bits, n, again)))").alias("w"))
    packed = packed.select("g", "chunk", "top", "n", F.col("w.bits").alias("words"), F.expr("transform(w, (x, i) -> aggregate(slice(w, 1, i), 0L, (s, y) -> s + y.n))").alias("before"), F.col("w.again").alias("again"))
    packed = running_sum(packed, ["chunk"], F.col("n"), "base", ["g"]).withColumn("base", F.col("base") - F.col("n"))
    groups = number_rows(packed.groupBy("g").agg(F.sum("n").alias("total")), ["g"], "gid")
    return stored(packed.drop("n").join(groups, "g"), "manifest-bitmaps")


def placed(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """gid, total, slot and the other columns of rows: rank queries, equal keys numbered apart."""
    at = rows.join(bitmaps, ["g", "chunk"]).withColumn("i", F.expr("bit_count(top & ~shiftleft(-1L, word))"))
    rank = F.expr("base + before[i] + bit_count(words[i] & ~shiftleft(-1L, bit)) + aggregate(filter(again[i], x -> x.bit < bit), 0L, (s, x) -> s + x.more)")
    found = stored(at.select("gid", "total", rank.alias("slot"), "key", "leaf", "more", "salt", F.expr("exists(again[i], x -> x.bit = bit)").alias("repeated")), "manifest-places")
    out, repeated = found.where("not repeated").drop("salt", "repeated"), found.where("repeated").drop("repeated")
    if repeated.isEmpty():
        return out
    numbered = number_rows(repeated, ["leaf", "salt"], "place", ["gid", "slot"])
    return out.unionByName(numbered.withColumn("slot", F.col("slot") + F.col("place")).drop("place", "salt"))


def slot_arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """nodes(gid, left, slot, node) -> gid, left, block, t, items: arrays of ``BLOCK`` slots, ``t`` of the ``left`` levels to be made of each."""
    arrays = nodes.groupBy("gid", "left", F.expr(f"slot div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("slot", "node", *more))).alias("items"))
    return arrays.withColumn("t", F.least("left", F.lit(ROUND)))


def climb(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every round, and (gid, node) of the roots."""
    rounds, roots = [], None
    while True:
        arrays = stored(slot_arrays(nodes, *more), "manifest-arrays")
        rounds.append(arrays)
        made = arrays.withColumn("d", F.col("items.node")).select("gid", (F.col("left") - F.col("t")).alias("left"), F.col("block").alias("slot"), F.expr(f"element_at(element_at({LEVELS}, -1), 1)").alias("node"))
        nodes, more = stored(made, "manifest-nodes"), ()
        done = nodes.where("left = 0").select("gid", "node")
        roots = done if roots is None else roots.unionByName(done)
        nodes = nodes.where("left > 0")
        if nodes.isEmpty():
            return rounds, roots


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(gid, item, root, path) of the items of the first round, from above(gid, root, path) of the roots."""
    paths = None
    for arrays in reversed(rounds):
        last = arrays.where("left = t").select("gid", "block").join(above, "gid")
        known = last if paths is None else last.unionByName(paths)
        both = arrays.withColumn("d", F.col("items.node")).join(known, ["gid", "block"])
        each = f"transform(items, x -> named_struct('item', x, 'path', transform(array(cast(x.slot % {BLOCK} as int)), s -> {SIBLINGS})[0]))"
        found = both.select("gid", "root", "path", F.expr(f"inline(transform(array({LEVELS}), lv -> {each})[0])").alias("item", "own"))
        out = found.select("gid", "item", "root", F.concat("own", "path").alias("path"))
        paths = out.select("gid", F.col("item.slot").alias("block"), "root", "path")
    return out


def levels(total: str) -> Column:
    """Levels above so many leaves."""
    return F.expr(f"size(filter(array({POWERS}), p -> p < {total}))")


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, *more: str) -> tuple[DataFrame, str]:
    """The root, and for each leaf: key, leaf, more..., subroot, path (siblings of every level, from its own to the root's children)."""
    parts = F.col("key")
    keyed = leaves.select(F.coalesce(F.concat(F.lit("s"), F.col(group)), F.lit("")).alias("g"), F.col(key).cast("long").alias("key"), F.unhex(leaf).alias("leaf"), F.struct(*more, F.lit(0).alias("_")).alias("more"))
    keyed = keyed.select("*", F.coalesce(F.shiftright(parts, 12), F.lit(NO_KEY)).alias("chunk"), F.coalesce(F.expr("cast(shiftright(key, 6) & 63 as int)"), F.lit(0)).alias("word"), F.coalesce(F.expr("cast(key & 63 as int)"), F.lit(0)).alias("bit"), F.monotonically_increasing_id().alias("salt"))
    rows = stored(keyed, "manifest-leaves")
    nodes = placed(rows, containers(rows)).select("gid", levels("total").alias("left"), "slot", F.lower(F.hex("leaf")).alias("node"), "key", "more")
    rounds, subroots = climb(nodes, "key", "more")
    n_groups = subroots.count()
    upper, roots = climb(subroots.select(F.lit(0).cast("long").alias("gid"), levels(f"{n_groups}L").alias("left"), F.col("gid").alias("slot"), "node"))
    first = roots.first()
    if first is None:
        return leaves.sparkSession.createDataFrame([], descend_schema(rows, more)), ""
    over = descend(upper, roots.select("gid", F.lit(None).cast("string").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path")))
    above = stored(over.select(F.col("item.slot").alias("gid"), F.col("item.node").alias("root"), "path"), "manifest-above")
    out = descend(rounds, above)
    return out.select(F.col("item.key").alias("key"), F.col("item.node").alias("leaf"), *[F.col(f"item.more.`{m}`").alias(m) for m in more], F.col("root").alias("subroot"), "path"), first.node


def descend_schema(rows: DataFrame, more: tuple[str, ...]) -> str:
    """The columns of an empty manifest."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["more"].dataType.fields}
    return ", ".join(["key long, leaf string", *[f"`{m}` {kinds[m]}" for m in more], f"subroot string, path {PATH}"])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path make."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, digested."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, folded again from a text that lost its line feeds for about half of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", digest(*columns, F.col("text")).alias("leaf"), F.unhex(digest(*columns, text)).alias("told"))
    rows, root = manifest(leaves, "source", "doc_id", "leaf", "told")
    out = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), proof(F.col("path")).alias("proof_sha256"), fold(F.lower(F.hex("told")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
