"""HTML main text by line-block distribution.

The markup is stripped into lines (one per block element; inline tags vanish,
``<br>`` is white space).  Every line has a weight: its code points outside
links, more where the page marks it as part of an article, less where the page
has an article elsewhere, none for navigation, adverts, forms, copyright lines
and other page furniture.  Weights are summed over sliding windows of ``WINDOW``
lines; a sum above the threshold is a surge, the next window without weight is
the dive, and the lines between them, furniture excepted, are the main text.

Class, id and role values are judged by their words: plain ones name furniture
on any element that structures a page; doubtful ones (``side``, ``related``)
only outside an article, or inside one on short or linked lines; neither counts
on elements of running text or on a main element that has another word as well.

A null or empty page has the text ``''``; comments, scripts and tags that are
never closed end with the page; repeated rows are extracted each; an empty table
gives an empty result; columns named ``text`` or ``n_chars`` are replaced, all
others are kept.  Time and memory are linear in a page, however deep its nesting.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxspark.functions.workers import ship

WINDOW = 3
SURGE = 86  # weight of a window; less on pages that have no such window
INSIDE, OUTSIDE = 8, 0.25  # weight of a code point in the marked article, and beside it
SHORT = 80  # a line that is no running text

#: fixed values: HTML element names
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select".split())
FURNITURE = frozenset("nav header footer aside form menu menuitem button dialog fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RUNNING = INLINE | frozenset("p blockquote pre q h1 h2 h3 h4 h5 h6 dd dt figure figcaption td th tr table tbody".split())
MAIN = frozenset(("html", "body", "article", "main"))
#: words of class, id and role values that name page furniture
PLAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promoted|navs?|navbar|navigation|menus?|breadcrumbs?|sidebars?|masthead|footers?|complementary|contentinfo"
    r"|comments|comment-?(?:list|form|area|section|body)|replies|respond|disqus|cookies?|consent|gdpr|notices?|popups?|modals?|newsletters?|subscribe|signup|login|social|pagination|pager|toolbar|skip-?link|sr-only)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: words that may as well stand on a part of the article
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:side|foot|header|related|recommended|recommendations|alerts?|hidden|shar(?:e|ing)|overlay|search|widgets?|comment)(?:$|[\s_-])", re.IGNORECASE)
#: words of elements of readers, or of cards that lead elsewhere
READERS = re.compile(r"comment|repl(?:y|ies)|respond|disqus|related|recommend", re.IGNORECASE)
RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b)|.*\ball rights reserved\b", re.IGNORECASE | re.DOTALL)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
#: one attribute: its whole name and its value, quoted or bare; a quote that is never closed takes the rest and gives no value
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|[\"'].*\Z|([^\s>]+)))?", re.DOTALL)


def _furniture(name: str, attributes: str) -> str:
    """Why an element is page furniture: its name or the attribute value that says so, else ''."""
    if name in FURNITURE or name in RAW:
        return name
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)]
    values = [value for key, value in found if key in ("class", "id", "role")]
    if name in MAIN:  # every word must be a reader's
        words = " ".join(values).split()
        return words[0] if words and all(map(READERS.search, words)) else ""
    for key, value in found:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
    for value in values:
        if PLAIN.search(value) and (name not in RUNNING or len(value.split()) == 1):
            return value
    return next((value for value in values if name not in RUNNING and DOUBTFUL.search(value)), "")


def _doubtful(name: str, why: str) -> bool:
    """Whether a reason of :func:`_furniture` is a word that may as well stand on a part of the article."""
    return name not in MAIN and why not in ("", "hidden", name) and not PLAIN.search(why)


class Line(NamedTuple):
    text: str
    linked: int  # code points in links
    junk: bool  # furniture
    doubtful: bool  # inside an element of a doubtful name
    article: bool  # in an article


def lines(page: str) -> list[Line]:
    """The lines of a page, in order."""
    out: list[Line] = []
    stack: list[tuple[str, str, bool]] = []  # open block elements, why they are furniture, whether that is doubtful
    opened: Counter[str] = Counter()  # their names
    skipped, doubts, readers, articles, links, linked, at = 0, 0, 0, 0, 0, 0, 0
    buffer: list[str] = []

    def cut() -> None:
        nonlocal linked
        if text := " ".join(html.unescape("".join(buffer)).split()):
            out.append(Line(text, min(linked, len(text)), skipped > 0, doubts > 0, articles > 0))
        buffer.clear()
        linked = 0

    def count(element: tuple[str, str, bool], by: int) -> None:
        nonlocal skipped, doubts, readers, articles
        name, why, doubtful = element
        opened[name] += by
        skipped += by * (bool(why) and not doubtful)
        doubts += by * doubtful
        readers += by * (why != "" and READERS.search(why) is not None)
        articles += by * (name in ("article", "main"))

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            buffer.append(piece)
            linked += len(piece) * (links > 0)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in INLINE and not (attributes and not closing and _furniture(name, attributes)):
            if name == "br":
                buffer.append(" ")
            elif name == "a":
                links = 0 if closing else 1
            if not closing or not opened[name]:
                continue
        cut()
        links = 0
        if closing:
            while opened[name]:
                element = stack.pop()
                count(element, -1)
                if element[0] == name:
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                count(stack.pop(), -1)
            why = _furniture(name, attributes)
            if name in ("article", "main") and not why and not readers:
                # an article never stands inside furniture: what is open was not closed
                while skipped or doubts:
                    count(stack.pop(), -1)
            stack.append((name, why, _doubtful(name, why)))
            count(stack[-1], 1)
    cut()
    return out


def weigh(found: list[Line]) -> list[tuple[str, float, bool]]:
    """(text, weight, is furniture) of the lines whose blocks are looked for.

    Furniture inside an article interrupts nothing and goes; where an article
    begins or ends, empty lines keep what is beside it apart.
    """
    junk = [x.junk or x.doubtful and (not x.article or len(x.text) < SHORT or 2 * x.linked > len(x.text)) for x in found]
    marked = any(x.article and not j for x, j in zip(found, junk, strict=True))
    out: list[tuple[str, float, bool]] = []
    inside = False
    for x, j in zip(found, junk, strict=True):
        if x.article and j:
            continue
        if marked and x.article != inside:
            out += [("", 0.0, True)] * WINDOW
            inside = x.article
        length = 0 if j or RIGHTS.match(x.text) and not x.article else len(x.text) if x.article else len(x.text) - x.linked
        out.append((x.text, length * (1 if not marked else INSIDE if x.article else OUTSIDE), j))
    return out


def blocks(weights: list[float]) -> list[tuple[int, int]]:
    """(first line, line after the last) between the surge and dive points; both ends have weight."""
    n = len(weights)
    sums = [sum(weights[max(0, i - WINDOW + 1) : i + 1]) for i in range(n + WINDOW - 1)]  # lines i - WINDOW + 1 .. i
    threshold = min(SURGE, max(sums, default=0) - 1)
    out, i = [], 0
    while i < len(sums):
        if sums[i] > max(threshold, 0):
            start = i
            while start and sums[start - 1] > 0:
                start -= 1
            dive = i
            while dive < len(sums) and sums[dive] > 0:
                dive += 1
            out.append((start, dive - WINDOW + 1))  # the windows before the dive still hold the last line with weight
            i = dive
        i += 1
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by one space."""
    found = weigh(lines(page or ""))
    return " ".join(text for first, end in blocks([w for _, w, _ in found]) for text, _, junk in found[first:end] if not junk)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Replace ``column`` by ``text`` (main text) and ``n_chars`` (its code points)."""
    ship(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    names = [f.name for f in kept] + ["text", "n_chars"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = [main_text(page) for page in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names[:-2]] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=names)

    return pages.mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: for pages of furniture and one <article> of headings, paragraphs and bold runs, with the usual references
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '</?(?:h[1-6]|p|br)>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp', '&'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT page_id, url, replace(t, '&;', '&') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
