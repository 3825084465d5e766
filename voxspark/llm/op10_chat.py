"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text </turn>`` and a line feed.  The rendered
text is reparsed by a deterministic grammar (an unescaped ``</turn>`` ends a
turn, an unescaped ``###`` starts a header, and neither may stand bare in a body) and the recovered turns are compared
with the source.  A turn that does not come back as it was has its control
strings escaped with one more backslash, and the comparison is made again over
the whole conversation; a conversation that still differs stops the job.

Only built-in functions are used.  Nulls and edge cases: null text or role is
empty; turns with equal numbers are ordered by role, then text; rows with a null
conv_id form one conversation; repeated rows stay repeated turns; an empty table
gives an empty result.  Extra columns of any name are ignored.  A table that has
a conversation -7 of its own shares it with the one that ``op10_chat`` plants:
its turns are ordered among the planted ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = "###|</turn>"
BARE = r"(?<![\\#])###|(?<!\\)</turn>"  # a control string that no backslash guards
END = " </turn>\n"
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}


def escape(text: Column) -> Column:
    """One more backslash before every control string and the backslashes before it."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*+(?:{CONTROL}))", r"\\$1")


def unescape(text: Column) -> Column:
    """Take one backslash from every control string that has any."""
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+(?:{CONTROL}))", "$1")


def _show(role: Column) -> Column:
    """Well-known roles by their title; any other after ``@``, with colons and backslashes escaped."""
    shown = F.concat(F.lit("@"), F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\c")), F.lit("#"), F.lit("\\h")), F.lit("@"))
    for name, title in SHOWN.items():
        shown = F.when(role == name, title).otherwise(shown)
    return shown


def _role(shown: Column) -> Column:
    """The inverse of :func:`_show`."""
    other = F.regexp_extract(shown, r"(?s)^@(.*)@$", 1)
    other = F.regexp_replace(F.regexp_replace(other, r"(?<!\\)((?:\\\\)*+)\\c", "$1:"), r"(?<!\\)((?:\\\\)*+)\\h", "$1#")
    role = F.replace(other, F.lit("\\\\"), F.lit("\\"))
    for name, title in SHOWN.items():
        role = F.when(shown == title, name).otherwise(role)
    return role


def render(role: Column, body: Column) -> Column:
    """A turn as text; ``body`` is escaped already."""
    return F.concat(F.lit("### "), _show(role), F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, body, text, start>> of a rendered text; start counts code points before the body."""
    pieces = F.split(formatted, r"(?<=(?<!\\)</turn>\n)(?=### |$)")
    turns = F.filter(pieces, lambda p: p != "")

    def turn(piece: Column) -> Column:
        header = F.regexp_extract(piece, r"(?s)^### ([^:]*): ", 0)
        body = F.regexp_extract(piece, r"(?s)^### [^:]*: (.*) </turn>\n$", 1)
        return F.struct(_role(F.regexp_extract(piece, r"(?s)^### ([^:]*): ", 1)).alias("role"), body.alias("body"), F.when(~body.rlike(BARE), unescape(body)).alias("text"), F.length(header).alias("head"), F.length(piece).alias("size"))

    return F.transform(turns, turn)


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"], t["text"])).eqNullSafe(F.transform(turns, lambda t: F.struct(t["role"], t["text"])))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points) and the turns read back."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # first pass: each turn alone, unescaped, must come back as it was
    plain = parse(render(F.col("role"), F.col("text")))
    safe = (F.size(plain) == 1) & F.get(plain, F.lit(0))["role"].eqNullSafe(F.col("role")) & F.get(plain, F.lit(0))["text"].eqNullSafe(F.col("text"))
    body = F.when(F.col("text").rlike(CONTROL) & ~safe, escape(F.col("text"))).otherwise(F.col("text"))
    turns = turns.withColumn("body", body)
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("turns"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("turns", lambda t: render(t["role"], t[field])), "")

    # second pass: the whole conversation; conflicts between turns escape all of them
    talks = talks.withColumn("formatted", joined("body")).withColumn("parsed", parse(F.col("formatted")))
    escaped = F.array_join(F.transform("turns", lambda t: render(t["role"], escape(t["text"]))), "")
    talks = talks.withColumn("again", ~_same(F.col("parsed"), F.col("turns")))
    talks = talks.withColumn("formatted", F.when(F.col("again"), escaped).otherwise(F.col("formatted")))
    talks = talks.withColumn("parsed", F.when(F.col("again"), parse(F.col("formatted"))).otherwise(F.col("parsed")))
    checked = F.when(_same(F.col("parsed"), F.col("turns")), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not survive its grammar")))
    talks = talks.select("conv_id", "formatted", checked.alias("parsed"))
    # positions: running sums over the pieces
    walk = F.aggregate(
        "parsed",
        F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + t["size"]).alias("at"),
            F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.struct((s["at"] + t["head"]).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return talks.withColumn("loss_spans", walk)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one planted with control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    talks = format_conversations(rows.unionByName(planted))
    read = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return talks.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool'
      ELSE '@' || replace(replace(replace(role, '\', '\\'), ':', '\c'), '#', '\h') || '@' END AS shown,
    regexp_replace(text, '(\\*(?:###|</turn>))', '\\\1', 'g') AS body FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('### ' || shown || ': ' || body || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
