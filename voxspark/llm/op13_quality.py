"""Quality rules, lines first.

Every line with a word is judged by itself: *punctuation* (no terminal mark at
its end, more symbols than words, an exclamation mark for every word),
*navigation* (a row of short pieces between separators, or words of menus only)
and *boilerplate* (short lines about cookies, scripts, rights, licences and the
like).  Lines that fail are taken out; a document goes if that takes more than
``MOST_LOST`` percent of its word characters, or if it fails the base rules: at
least ``LEAST_WORDS`` words, and not more than ``MOST_REPEATED`` percent of them
in windows of three words that the text has twice or more.

Words are runs of anything but ASCII white space, lines are cut at line feeds,
characters are code points.  Lines without a word are kept and lose nothing.

Nulls and edge cases: a null or empty text has no words, so it fails; with fewer
than three words there is no window; very long texts are judged whole, in memory
linear in their length; repeated rows are judged each; equal lines fail or pass
together; an empty table gives an empty result.  Columns named like the added
ones are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxspark.functions.workers import ship

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
MOST_LOST = 50  # percent of the word characters
SEPARATORS = 3  # from so many on a line may be a menu
PIECE = 4  # most words of a piece of a menu, on average
MENU_WORDS, NOTICE_WORDS = 8, 30  # longer lines are no menu of words, no notice

SYMBOLS = "#*$%&|<>"
RULES = {
    "terminal": r"""[.!?…:;"'”’»)\]。！？．؟۔।][\x20\x09-\x0D]*$""",
    "separator": "[|»›·•→]",
    "menu": r"(?i)^[\x09-\x0D -/:-@\[-`{-~]*(?:(?:home|about|us|contact|log|in|out|login|logout|sign|up|register|search|menu|next|previous|prev|back|top|news|blog|shop|cart|help|faq|sitemap|archive|archives|categories|tags|share|print|email|privacy|terms|careers|jobs|products|services|support|downloads|gallery)[\x09-\x0D -/:-@\[-`{-~]*)+$",
    "notice": r"(?i)\bcookies?\b.*\b(?:accept|agree|policy|settings|consent|use|uses)\b|\b(?:accept|agree|use|uses|policy|consent to)\b.*\bcookies?\b|\bjavascript\b.*\b(?:disabled|enabled?|required)\b|\b(?:enable|requires?|activate)\b.*\bjavascript\b|\ball rights reserved\b|^[^0-9A-Za-z]*(?:copyright\b|\(c\)|©)|\blorem ipsum\b|\b(?:licensed|released) under\b|\bterms of (?:use|service)\b|\bprivacy policy\b|\bsubscribe to (?:our|the)\b|\bsign up for (?:our|the)\b|\bfollow us on\b|\bclick here\b|\bskip to (?:main )?content\b|\bback to top\b|^[^0-9A-Za-z]*page [0-9]+ of [0-9]+",
}
SPACE = str.maketrans("", "", "\t\n\x0b\x0c\r ")
_PATTERNS = {name: re.compile(pattern, re.ASCII) for name, pattern in RULES.items()}


class Verdict(NamedTuple):
    """What the rules find in a text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lines: int
    n_punctuation: int
    n_navigation: int
    n_boilerplate: int
    lost_chars: int
    cleaned: str


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, lost_chars long, cleaned string"


def failure(line: str, words: int) -> str | None:
    """The first rule that a line with words fails."""
    cuts = len(_PATTERNS["separator"].findall(line))
    if SEPARATORS <= cuts and words <= PIECE * (cuts + 1) or words <= MENU_WORDS and _PATTERNS["menu"].search(line):
        return "navigation"
    if words <= NOTICE_WORDS and _PATTERNS["notice"].search(line):
        return "boilerplate"
    if not _PATTERNS["terminal"].search(line) or sum(map(line.count, SYMBOLS)) > words or line.count("!") >= words > 2:
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def judge(text: str | None) -> Verdict:
    """All rules on one text."""
    text = text or ""
    lines, seen, kept = text.split("\n"), set(), []
    failed = dict.fromkeys(("punctuation", "navigation", "boilerplate"), 0)
    filled = lost = 0
    for line in lines:
        words = len(line.encode("utf-8", "surrogatepass").split())  # bytes are split at ASCII white space only
        if words:
            filled += 1
            seen.add(line)
            rule = failure(line, words)
            if rule:
                failed[rule] += 1
                lost += len(line.translate(SPACE))
                continue
        kept.append(line)
    every = text.encode("utf-8", "surrogatepass").split()
    chars, repeats = len(text.translate(SPACE)), repeated_words(every)
    base = len(every) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(every)
    return Verdict(len(every), chars, sum(map(text.count, SYMBOLS)), filled - len(seen), repeats, base, not base and 100 * lost <= MOST_LOST * chars, filled, *failed.values(), lost, "\n".join(kept))


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the fields of :class:`Verdict`, the cleaned text among them; the text itself is dropped."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, *Verdict._fields)]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [FIELDS])
    names = [f.name for f in kept] + list(Verdict._fields)
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[field.split()[-1]] for field in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in pairwise([*range(0, batch.num_rows, 500), batch.num_rows]):
                part = batch.slice(first, end - first)
                found = [judge(body.as_py()) for body in part.column(text)]
                added = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + added, names=names)

    return docs.mapInArrow(run, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.drop("cleaned")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(pattern: str, text: str) -> str:
    return f"len(regexp_extract_all({text}, {_quoted(pattern)}))"


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(s) AS word, unnest(range(len(s))) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS s FROM d)),
t AS (SELECT rid, pos, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
p AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, line, {_count(r"[^\x20\x09-\x0D]+", "line")} AS words, {_count(RULES["separator"], "line")} AS cuts, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
f AS (SELECT *, CASE WHEN cuts >= {SEPARATORS} AND words <= {PIECE} * (cuts + 1) OR words <= {MENU_WORDS} AND regexp_matches(line, {_quoted(RULES["menu"])}) THEN 'n' WHEN words <= {NOTICE_WORDS} AND regexp_matches(line, {_quoted(RULES["notice"])}) THEN 'b'
  WHEN NOT regexp_matches(line, {_quoted(RULES["terminal"])}) OR {_count("[#*$%&|<>]", "line")} > words OR {_count("!", "line")} >= words AND words > 2 THEN 'p' END AS rule FROM l WHERE words > 0),
s AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (rule = 'p') AS n_punctuation, count(*) FILTER (rule = 'n') AS n_navigation, count(*) FILTER (rule = 'b') AS n_boilerplate, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_chars FROM f GROUP BY rid),
b AS (SELECT doc_id, {_count(r"[^\x20\x09-\x0D]+", "text")} AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_count("[#*$%&|<>]", "text")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(lost_chars, 0) AS lost_chars FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM b
"""
