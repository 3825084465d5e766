"""BPE encoding and decoding with a compiled tokenization automaton.

``compile_merges`` reads the merges in order and adds one gadget for each: the
merge (u, v) -> w gives the automaton a state for w that starts as a copy of
v's state, lets every state with an arc u take an arc w, and cuts the arc v from
u's state.  A state is the last token read, and states are stored as what sets
them apart from the state they were copied from (copied state, step, cut arcs),
so the tables are as long as the merge list.  The automaton accepts exactly one
token path for every word, the one that merging in rank order would give.

``encode_word`` follows the arcs by table look-ups: the longest label that the
current state allows first, back one token where a path ends.  Texts are split
into words as the tokenizer file says; each distinct word is encoded once per
worker.  ``decode`` emits the labels of the arcs.

Whether a state has an arc is derived from those tables when a word first asks
for it and then kept; the full table of arcs, states times tokens, is never laid
out.

A null text is the empty text and has no tokens; the strings of special tokens
in a text are those tokens; texts of any length are read whole; repeated rows
are encoded each; an empty table gives an empty result; columns named like the
new ones are replaced, the text goes, and all others are kept.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.workers import hold, ship

CACHE_WORDS = 250_000
CACHE_ARCS = 500_000
LONG_WORD = 48  # longer words are not kept
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # White_Space


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    """The tables of the tokenization automaton of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str) -> None:
        self.labels = [""] * (max(vocab.values()) + 1)
        for label, token in vocab.items():
            self.labels[token] = label
        self.word_end = word_end
        n = len(self.labels)
        self.step = [-1] * n  # when a token's state was made
        self.enters_as = list(range(n))  # the arc that a state had when it got this token's arc
        self.copied = list(range(n))  # the token whose state was copied
        self.cut: dict[int, int] = {}  # (state, arc) -> the step that cut it
        self.shift = n.bit_length()
        for k, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            self.step[w], self.enters_as[w], self.copied[w] = k, u, v
            self.cut[u << self.shift | v] = k
        self.next: dict = {}  # labels as a tree of letters; '' holds the token
        for label, token in vocab.items():
            node = self.next
            at_end = bool(word_end) and label.endswith(word_end)
            for letter in label[: len(label) - len(word_end)] if at_end else label:
                node = node.setdefault(letter, {})
            node["$end" if at_end or not word_end else ""] = token
            if not word_end:
                node[""] = token
        self.known: dict[int, bool] = {}

    def allows(self, state: int, arc: int) -> bool:
        """Whether the state of token ``state`` has an arc for token ``arc``."""
        key = state << self.shift | arc
        seen = self.known.get(key)
        if seen is not None:
            return seen
        if len(self.known) > CACHE_ARCS:
            self.known.clear()
        before = len(self.labels) + 1  # only cuts made before this step count
        yes = True
        while True:
            if self.cut.get(state << self.shift | arc, before) < before:
                yes = False
                break
            made, got = self.step[state], self.step[arc]
            if made < 0 and got < 0:
                break
            if made > got:  # the state is younger: look at the one it was copied from
                before, state = made, self.copied[state]
            else:  # the arc is younger: it came where its left part had an arc, its own cut included
                before, arc = got + 1, self.enters_as[arc]
        self.known[key] = yes
        return yes

    def encode_word(self, word: str) -> list[int]:
        """The one path of arcs that spells a word (of byte letters)."""
        n = len(word)
        if not n:
            return []
        path: list[int] = []
        ends: list[int] = [0]
        choices: list[list[tuple[int, int]]] = [self._arcs(word, 0, n)]
        tried = {0}
        while True:
            at = choices[-1]
            while at:
                end, token = at.pop()
                if end not in tried and (not path or self.allows(path[-1], token)):
                    break
            else:
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                choices.pop()
                ends.pop()
                path.pop()
                continue
            path.append(token)
            if end == n:
                return path
            tried.add(end)  # the path to a place is unique, so a place is tried once
            ends.append(end)
            choices.append(self._arcs(word, end, n))

    def _arcs(self, word: str, start: int, n: int) -> list[tuple[int, int]]:
        """(end, token) of the labels found at a place, the longest last."""
        node, out = self.next, []
        for at in range(start, n):
            node = node.get(word[at])
            if node is None:
                break
            token = node.get("$end" if at == n - 1 else "")
            if token is not None:
                out.append((at + 1, token))
        return out


class Encoder:
    """Texts to token ids and back, as a tokenizer file describes it."""

    def __init__(self, spec: str) -> None:
        import regex

        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace("\\s", SPACE)).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.letters = byte_letters()
        self.labels = self.automaton.labels + [""] * (max(self.special.values(), default=-1) + 1 - len(self.automaton.labels))
        for text, token in self.special.items():
            self.labels[token] = text
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = self.automaton.encode_word("".join([self.letters[b] for b in word.encode()]))
        out = np.array(ids, dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.parts(text) if "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-cased letter by letter, without final sigma
            get, word = self.cache.get, self.word
            out += [get(w) or word(w) for w in self.words(part.lower())]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, with spaces between them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The encoder of a tokenizer file, compiled once per worker."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256; with ``ids``, also the ids as an array column.

    The text column is dropped; all others are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids_sha256", "decoded_sha256", ids)]
    added = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ([f"`{ids}` array<int>"] if ids else [])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + added)
    names = [f.name for f in kept] + ["n_tokens", "ids_sha256", "decoded_sha256"] + ([ids] if ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from voxspark.llm import op05_bpe as own  # the worker's copy keeps its cache between tasks

        hold("op5", own._ENCODERS.clear)
        coder = own.encoder(spec.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                counts, digests, decoded, tokens = [], [], [], []
                for body in part.column(text):
                    out = coder.encode(body.as_py() or "")
                    counts.append(len(out) // 4)
                    digests.append(hashlib.sha256(out).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(out).encode()).hexdigest())
                    if ids:
                        tokens.append(np.frombuffer(out, dtype="<i4"))
                columns = [part.column(f.name) for f in kept] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(tokens, pa.list_(pa.int32()))] if ids else []), names=names)

    return docs.mapInArrow(run, schema)


def default_path() -> str:
    """The word-level BPE of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every text encoded and decoded; digests of ids and of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "text")
    return encode_texts(docs, path or default_path())
