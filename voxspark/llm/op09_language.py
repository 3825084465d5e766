"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary.  Each language has a probability for
every piece, and a word's probability in a language is the sum over all its
segmentations into pieces (forward algorithm), whatever its length: words up to
``SHORT`` letters are summed many at a time, longer ones each by itself, in
logarithms and block by block.  A text's score is the product over its words;
the best language wins, and its score is its share of the posterior.

Training: a few steps of expectation-maximisation (forward-backward) over the
word counts of a bounded sample, about ``sample_docs`` labelled rows for each
language, drawn by a hash of the key.  Expected counts are summed by Spark; what
reaches the driver is one row per vocabulary piece and one number per language;
more than ``MAX_LANGUAGES`` labels stop the job, so the table that is broadcast
has at most 50 MB.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with
score 0; without labelled rows everything is ``und``; rows with a null key never
train and are not held out; repeated rows are predicted alike; of languages with
equal scores (ties) the first by name wins; an empty table gives an empty
result; columns named like ``into`` are replaced and all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.functions.workers import hold, ship

SAMPLE_DOCS = 600
MAX_LANGUAGES = 250
STEPS = 3
SMOOTHING = 0.05  # counts added to every piece
UNKNOWN = 1e-8  # a letter outside the vocabulary, in any language
SHORT = 24  # longer words are summed one by one
BLOCK = 1 << 15  # letters of a long word whose pieces are looked up at once
CACHE_WORDS = 250_000
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def held_out(key: Column) -> Column:
    """The fifth of the rows that never trains."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


class Pieces:
    """A vocabulary as hash tables that are looked up for many strings at once."""

    SLOTS = 17  # bits of a table

    def __init__(self, pieces: list[str]) -> None:
        keys = np.zeros(len(pieces), dtype=np.uint64)
        for i, piece in enumerate(pieces):
            key = np.zeros(1, dtype=np.uint64)
            for letter in piece:
                key = self.longer(key, np.array([ord(letter)], dtype=np.uint64))
            keys[i] = key[0]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.none = len(pieces)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(pieces))
        while len(left):  # what meets another key goes to the next table
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 7919 * len(self.tables))
            slot = (keys[left] * factor) >> np.uint64(64 - self.SLOTS)
            _, first = np.unique(slot, return_index=True)
            key, value = np.zeros(1 << self.SLOTS, dtype=np.uint64), np.full(1 << self.SLOTS, self.none, dtype=np.int32)
            key[slot[first]], value[slot[first]] = keys[left[first]], left[first]
            self.tables.append((factor, key, value))
            left = np.delete(left, first)

    @staticmethod
    def longer(key: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The hash of a string with one more letter."""
        key = (key + letter + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(29))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of every hash, or ``none``."""
        out = np.full(keys.shape, self.none, dtype=np.int32)
        for factor, key, value in self.tables:
            slot = (keys * factor) >> np.uint64(64 - self.SLOTS)
            np.copyto(out, value[slot], where=key[slot] == keys)
        return out


class Scorer:
    """log P(word | language) with the sum over all segmentations."""

    def __init__(self, pieces: list[str], table: np.ndarray) -> None:
        self.pieces = Pieces(pieces)
        # two rows more: a piece that isn't there, a letter that isn't there
        n = table.shape[1]
        self.table = np.vstack([table, np.zeros((1, n)), np.full((1, n), UNKNOWN)])
        self.none, self.unknown = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.table)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, n))

    def ids(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Piece of every span (i, j) of words of one length, where any word has one."""
        size = len(words[0])
        letters = np.array(words).view(np.uint32).reshape(len(words), -1)[:, :size].astype(np.uint64).T
        out = {}
        for i in range(size):
            key = np.zeros(len(words), dtype=np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                key = self.pieces.longer(key, letters[j - 1])
                found = self.pieces.find(key)
                if j == i + 1:
                    found[found == self.none] = self.unknown
                if (found != self.none).any():
                    out[i, j] = found
        return dict(sorted(out.items(), key=lambda x: (x[0][1], x[0][0])))

    def forward(self, words: list[str]) -> np.ndarray:
        """log P of words of one length, a row each."""
        size = len(words[0])
        alpha = np.zeros((size + 1, len(words), self.table.shape[1]))
        alpha[0] = 1
        for (i, j), ids in self.ids(words).items():
            alpha[j] += alpha[i] * self.table[ids]
        return np.log(alpha[size])

    def expected(self, words: list[str], counts: np.ndarray, total: np.ndarray) -> None:
        """Add the expected piece counts of words of one length, seen ``counts`` times in each language."""
        size, langs = len(words[0]), self.table.shape[1]
        spans = self.ids(words)
        alpha, beta = np.zeros((size + 1, len(words), langs)), np.zeros((size + 1, len(words), langs))
        alpha[0], beta[size] = 1, 1
        for (i, j), ids in spans.items():
            alpha[j] += alpha[i] * self.table[ids]
        for (i, j), ids in reversed(spans.items()):
            beta[i] += beta[j] * self.table[ids]
        scale = counts / alpha[size]
        for (i, j), ids in spans.items():
            real = np.flatnonzero(ids < self.none)
            np.add.at(total, ids[real], (alpha[i] * self.table[ids] * beta[j] * scale)[real])

    def windows(self, word: str) -> Iterator[np.ndarray]:
        """Block by block: the piece that ends after each letter, a row per letter, a column per length from 1 on."""
        letters = np.array([word]).view(np.uint32).astype(np.uint64)
        for first in range(0, len(word), BLOCK):
            last = min(first + BLOCK, len(word))
            before = max(0, first - self.longest + 1)
            key = np.zeros(last - before, dtype=np.uint64)  # of the strings that start at each letter
            out = np.full((last - first, self.longest), self.none, dtype=np.int32)
            for length in range(1, min(self.longest, last - before) + 1):
                n = last - before - length + 1
                key = self.pieces.longer(key[:n], letters[before + length - 1 : last])
                found = self.pieces.find(key)
                if length == 1:
                    found[found == self.none] = self.unknown
                skip = max(0, first - before - length + 1)  # those that end before the block
                out[before + skip + length - 1 - first :, length - 1] = found[skip:]
            yield out

    def long_forward(self, word: str, keep: bool = False) -> np.ndarray:
        """log P of all segmentations of a prefix of a long word: of the whole word, or (``keep``) a row for every prefix."""
        size = self.longest
        last = np.full((size, self.table.shape[1]), -np.inf)  # of the prefixes that end 1, 2, ... letters ago
        last[0] = 0
        rows = [last[0].copy()]
        for block in self.windows(word):
            for ids in block:
                now = last + self.logs[ids]
                top = now.max(axis=0)
                new = top + np.log(np.exp(now - top).sum(axis=0))
                last = np.vstack([new, last[:-1]])
                if keep:
                    rows.append(new)
        return np.array(rows) if keep else last[0]

    def long_expected(self, word: str, counts: np.ndarray, total: np.ndarray) -> None:
        """:meth:`expected` for one long word."""
        size, n = self.longest, len(word)
        ids = np.concatenate(list(self.windows(word)))  # ids[e, l]: the piece of l + 1 letters that ends with letter e
        alpha = self.long_forward(word, keep=True)
        beta = np.full((n + 1 + size, self.table.shape[1]), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            lengths = np.arange(min(size, n - i))
            now = beta[i + 1 : i + 1 + len(lengths)] + self.logs[ids[i + lengths, lengths]]
            top = now.max(axis=0)
            beta[i] = top + np.log(np.exp(now - top).sum(axis=0))
        for length in range(min(size, n)):
            ends = np.flatnonzero(ids[:, length] < self.none)
            ends = ends[ends >= length]
            got = ids[ends, length]
            np.add.at(total, got, np.exp(alpha[ends - length] + self.logs[got] + beta[ends + 1] - alpha[n]) * counts)

    def learn_words(self, words: list[str]) -> None:
        """Score words that are new into the cache."""
        start = len(self.cache)
        if start + len(words) > len(self.rows):
            self.rows = np.resize(self.rows, (2 * (start + len(words)), self.rows.shape[1]))
        self.rows[start : start + len(words)] = 0
        by_size: dict[int, tuple[list[int], list[str]]] = {}
        for at, word in enumerate(words, start):
            self.cache[word] = at
            if not word.isalpha():  # other numerals than digits count as word characters too
                word = "".join(filter(str.isalpha, word))
                if not word:
                    continue
            word = START + word
            if len(word) > SHORT:
                self.rows[at] = self.long_forward(word)
                continue
            where, same = by_size.setdefault(len(word), ([], []))
            where.append(at)
            same.append(word)
        for where, same in by_size.values():
            for first in range(0, len(same), 2000):
                self.rows[where[first : first + 2000]] = self.forward(same[first : first + 2000])

    def score(self, texts: list[str]) -> list[tuple[int, float] | None]:
        """(best language, its share of the posterior) of each text; None without letters."""
        split = [LETTERS.findall(t.lower()) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        if new:
            self.learn_words(new)
        out: list[tuple[int, float] | None] = []
        for words in split:
            logs = self.rows[np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            if not logs.any():  # no word has a letter
                out.append(None)
                continue
            best = int(logs.argmax())
            out.append((best, float(1 / np.exp(logs - logs[best]).sum())))
        return out


def vocabulary(path: str | None = None) -> list[str]:
    """The ordinary pieces of a public sentencepiece vocabulary, lower-cased, of letters."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if LETTERS.fullmatch(p.removeprefix(START) or "a"))


def train(labelled: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and P(piece | language) from labelled rows."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    share = F.coalesce(*[F.when(F.col("lang") == x, sample_docs / sizes[x]) for x in langs])
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30) < share)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = stored(words.groupBy("word").agg(F.array(*[F.count(F.when(F.col("lang") == x, 1)).cast("double") for x in langs]).alias("counts")), "word-counts")

    vocab = spark.sparkContext.broadcast(pieces)
    table = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(STEPS):
        model = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, total = Scorer(vocab.value, model.value), np.zeros(model.value.shape)
            for batch in batches:
                by_size: dict[int, tuple[list[str], list[list[float]]]] = {}
                for word, n in zip(batch.column("word").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    word = START + word
                    if len(word) > SHORT:
                        scorer.long_expected(word, np.array(n), total)
                        continue
                    words, ns = by_size.setdefault(len(word), ([], []))
                    words.append(word)
                    ns.append(n)
                for words, ns in by_size.values():
                    for first in range(0, len(words), 5000):
                        scorer.expected(words[first : first + 5000], np.array(ns[first : first + 5000]), total)
            seen = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen].tolist(), pa.list_(pa.float64()))], names=["piece", "counts"])

        sums = counts.mapInArrow(expect, "piece int, counts array<double>").groupBy("piece").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(len(langs))])
        table = np.full((len(pieces), len(langs)), SMOOTHING)
        for r in sums.collect():  # at most a row for each piece of the vocabulary
            table[r[0]] += [r[k + 1] for k in range(len(langs))]
        table /= table.sum(axis=0)
        model.unpersist()
    return langs, table


_SCORERS: dict[int, Scorer] = {}


def predict(docs: DataFrame, langs: list[str], pieces: list[str], table: np.ndarray, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score; the text is all that is looked at.

    Columns that have the names of ``into`` already are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*into)
    ship(spark)
    sent = spark.sparkContext.broadcast((pieces, np.round(table, 12)))
    mark = hash((tuple(langs), table.tobytes(), len(pieces)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{into[0]}` string", f"`{into[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from voxspark.llm import op09_language as own  # the worker's copy keeps its cache between tasks

        hold("op9", own._SCORERS.clear)
        if mark not in own._SCORERS:
            own._SCORERS.clear()
            own._SCORERS[mark] = own.Scorer(*sent.value)
        scorer = own._SCORERS[mark]
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = scorer.score([x or "" for x in part.column(text).to_pylist()]) if langs else [None] * part.num_rows
                pred = [langs[f[0]] if f else "und" for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array([f[1] if f else 0.0 for f in found], pa.float64())], names=[*part.schema.names, *into])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, path: str | None = None, key: str = "doc_id", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, predict all of them."""
    pieces = vocabulary(path)
    langs, table = train(docs.where(~held_out(F.col(key))), pieces, key)
    return predict(docs, langs, pieces, table, into=into)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pieces = vocabulary()
    langs, table = train(docs.where(~held_out(F.col("doc_id"))), pieces)
    found = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), langs, pieces, table)
    return found.drop("text")
