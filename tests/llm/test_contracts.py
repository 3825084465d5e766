"""The numbered queries: SQL where there is some, brute force elsewhere, and the awkward rows."""

import base64
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from voxspark.llm import catalog, op01_pii, op02_html, op03_sharding, op04_join, op05_bpe, op06_decontaminate, op07_audio, op08_warc, op09_language, op10_chat, partenum

FOLDER = os.environ.get("VOXSPARK_TEST_TABLES", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, `sketch` string"
AWKWARD = [
    (0, "The quick brown fox jumps over the lazy dog by the river bank", "en", "a", 1, None, "x", "y"),
    (0, "The quick brown fox jumps over the lazy dog by the river bank", "en", "a", 1, None, "x", "y"),
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 0.5, None, None),
    (3, "   \n ", "de", None, 4, None, None, None),
    (4, "wort " * 3000 + "Ende", "de", "b", 15004, None, None, None),
    (5, "$$$ *** 12", "fr", "b", 10, None, None, None),
    (None, "Der Hund läuft über die Straße und der Fluß ist größer", "de", "b", 20, None, None, None),
    (7, "THE QUICK BROWN FOX jumps over the lazy dog by the river bank", "en", "a", 1, None, "x", "y"),
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, FOLDER), con, catalog.oracle_sql()[name])


def write(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def folders(spark, awkward, tmp_path_factory):
    """Awkward tables and empty ones."""
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x", 1), (2, None, None, 2), (1, "http://a.b/c", "<p>x", 1), (None, "u v", "", 3), (3, "http://A.b/c?d#e", "<p>x", 1)], "page_id long, url string, html string, key long")
    bench = spark.createDataFrame([("i1", "quick brown fox jumps over the lazy dog by the"), ("i2", None), ("i3", "ende"), ("i3", "ende"), (None, "")], "item_id string, text string")
    talks = spark.createDataFrame([(1, 0, "user", "a ### b </turn>\n### Assistant: c"), (1, 1, "assistant", "####\\\\###"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "we:ird@\\h#", "\\"), (3, 0, "assistant", " </turn>\n")], "conv_id long, turn long, role string, text string")
    one = write(tmp_path_factory.mktemp("awkward"), documents=awkward, pages=pages, benchmark=bench, conversations=talks)
    none = write(tmp_path_factory.mktemp("empty"), documents=awkward.limit(0), pages=pages.limit(0), benchmark=bench.limit(0), conversations=talks.limit(0))
    return one, none


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, folders, name):
    rows = catalog.queries()[name](spark, folders[1]).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op10") else [])


def test_awkward_sql(spark, folders):
    con = connect(folders[0])
    assert_same(op10_chat.op10_chat(spark, folders[0]), con, op10_chat.ORACLE_SQL)


def test_pii(spark, folders):
    text = "card 4337166598464399, not 4337166598464398; +1 (456) 555-2186 17.252.227.210 hsr.29@mail5.example.com 123-45-6789 GB82WEST12345698765432 1980-02-29 30.02.2001 v2.0."
    rows = spark.createDataFrame([(1, text, "c"), (2, text + " again", "c"), (3, None, "c"), (4, "", "c")], "doc_id long, text string, pii_kinds string")
    out = {r.doc_id: r for r in op01_pii.pseudonymise(rows).collect()}
    assert out[3].text is None and out[4].text == "" and out[4].pii_kinds == []
    assert out[1].pii_kinds == ["card", "phone", "ip", "email", "ssn", "iban", "date"]
    assert out[2].text == out[1].text + " again", "equal values have equal pseudonyms"
    assert "4337166598464398" in out[1].text and "30.02.2001" in out[1].text
    for secret in ("4337166598464399", "456) 555", "17.252.227.210", "hsr.29", "123-45-6789", "GB82WEST12345698765432", "1980-02-29"):
        assert secret not in out[1].text
    card = out[1].text[5:21]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(card)))) % 10 == 0
    assert op01_pii.op1_pii(spark, folders[0]).count() == len(AWKWARD)
    near = spark.createDataFrame([("4337166598464399 12 apples, GB82 WEST 1234 5698 7654 32 WORD, +44 20 7946 0958 17.252.227.210",)], "text string")
    assert op01_pii.pseudonymise(near).first().pii_kinds == ["card", "iban", "phone", "ip"]


def test_feistel_is_a_permutation(spark):
    rows = spark.range(12 * 35).select((F.col("id") % 12).alias("a"), F.floor(F.col("id") / 12).alias("b"))
    out = rows.select(op01_pii.feistel(F.col("a"), F.col("b"), F.lit(12), F.lit(35), "k", F.lit("t")).alias("s")).select("s.a", "s.b").distinct().collect()
    assert {(r.a, r.b) for r in out} == set(itertools.product(range(12), range(35)))
    halves = spark.range(1000).select(op01_pii.digit_halves(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("t")).alias("h"))
    digits = halves.select(op01_pii.join_digits(op01_pii.permuted(F.col("h"), "k"), F.lit(3)).alias("d")).distinct()
    assert digits.count() == 1000


def test_html():
    main = op02_html.main_text
    page = "<html><body><nav><ul><li><a href='x'>Menu</a></ul></nav><div class='ad'>Buy!</div><article><h1>A &amp; B</h1><p>One <b>tw</b>o<br>three<p>four &lt;p&gt;</article><section id='comments'><article class='comment'>Bad</article></section><aside>side</aside><form>f</form><footer>&copy;"
    assert main(page) == "A & B One two three four <p>"
    body = "<div id='menu'><a href=1>aaaa</a></div><div><h2>Head</h2><p>" + "word " * 30 + "</p><p>tail</p></div><div class='cookie-notice'>No</div>"
    assert main(body) == "Head " + "word " * 30 + "tail"
    assert main(None) == main("") == main("<script>x") == main("<!-- x") == "" and main("plain < text") == "plain < text"
    assert main("<article><p>" + "x" * 200_000 + "</p></article>") == "x" * 200_000


def test_html_rows(spark, folders):
    rows = op02_html.op2_html(spark, folders[0]).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0), (3, "x", 1)]


def test_differencing_beats_greedy():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 10_000) for _ in range(400)]
    sums = np.zeros((len(sizes), 8), dtype=np.int64)
    sums[:, 0] = sizes
    slots, total = op03_sharding.differencing(sums)
    loads = [sum(s for s, k in zip(sizes, slots[:, 0], strict=True) if k == j) for j in range(8)]
    assert loads == total.tolist() and max(loads) - min(loads) <= 20
    assert all(sorted(row) == list(range(8)) for row in slots.tolist())


def test_shards(spark, folders, con):
    rows = op03_sharding.op3_sharding(spark, FOLDER).collect()
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    where = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, r.shard) == r.shard
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sorted(r.size for r in op03_sharding.op3_sharding(spark, folders[0]).collect()) == sorted(len((a[1] or "").encode()) + 1 for a in AWKWARD)


def test_shards_in_several_levels(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id as int))").alias("text"))
    out = op03_sharding.shard(rows, 8, cell_rows=20).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert max(r.s for r in out) - min(r.s for r in out) <= 8 and all(r.m == r.n - 1 for r in out)


def test_partenum_finds_every_link():
    rng = np.random.default_rng(5)
    for size in (6, 12, 17, 22, 40, 75, 130, 300, 900):
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            a = len(base)
            gone = int(rng.integers(0, a // 5 + 1))
            extra = int(max(0, (a - gone) * 5 // 4 - a))  # as many as the threshold lets in
            other = np.unique(np.concatenate([base[rng.permutation(a)[: a - gone]], rng.integers(0, 1 << 63, int(rng.integers(0, extra + 1)), dtype=np.uint64)]))
            if partenum.linked(base, other):
                signature, owner = partenum.signatures([base, other])
                assert set(signature[owner == 0]) & set(signature[owner == 1])
                assert partenum.may_link(len(base), partenum.sketch(base), len(other), partenum.sketch(other))


def test_join_with_groups_and_awkward_rows(spark, folders):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in op04_join.op4_jaccard(spark, folders[0]).collect()}
    assert {x for x in found if x[0] in (0, 7)} == {(0, 9, 0), (7, 9, 0)}
    assert (1, 0, 1) in found and (2, 0, 2) in found and (3, 0, 3) in found and (None, 7, None) in found


@pytest.mark.parametrize("limit", [0, 500_000])
def test_join_of_a_large_group(spark, monkeypatch, limit):
    """Copies of one text with a few words changed: a hot group whose members are not all alike; with and without broadcasts and long blocks."""
    monkeypatch.setattr(op04_join, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(op04_join, "BLOCK", limit or 40)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.key: r.component_id for r in op04_join.similarity_components(docs).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


def test_bpe_equals_the_library(spark, folders, con):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op05_bpe.default_path())
    coder = op05_bpe.encoder(open(op05_bpe.default_path(), encoding="utf-8").read())
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(0x250), 0x3A3, 0x130, 0x301, 0x2028, 0x3000, 0x200B, 0xAC00, 0x4E00, 0x1F600, 0xB2, 0x660]]
    texts = ["".join(rng.choices(letters, k=rng.randrange(50))) for _ in range(2000)] + ["".join(rng.choices("aabbeht '", k=40)) for _ in range(2000)]
    texts += ["", " ", "a" * 3000, "<|startoftext|>Hi<|endoftext|>", "ΑΣ don't", *[r[0] for r in con.execute("SELECT text FROM documents").fetchall()]]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids
        assert coder.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in op05_bpe.op5_bpe(spark, folders[0]).collect()}
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and rows[4].n_tokens == 3000 + len(library.encode("Ende", add_special_tokens=False).ids)


def test_decontamination_without_broadcast(spark, con, monkeypatch):
    monkeypatch.setattr(op06_decontaminate, "BROADCAST_GRAMS", 0)
    assert_same(op06_decontaminate.op6_decontaminate(spark, FOLDER), con, op06_decontaminate.ORACLE_SQL)


def test_decontamination(spark, folders):
    rows = {r.doc_id: r for r in op06_decontaminate.op6_decontaminate(spark, folders[0]).collect() if r.doc_id}
    assert (rows[4].n_words, rows[4].n_hit, rows[4].n_items, rows[4].items_sha256) == (3001, 1, 1, hashlib.sha256(b"i3").hexdigest())
    assert (rows[7].n_hit, rows[7].contaminated) == (10, True) and not rows[5].contaminated
    assert sum(r.doc_id == 0 for r in op06_decontaminate.op6_decontaminate(spark, folders[0]).collect()) == 2
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    kept = op06_decontaminate.decontaminate(docs, spark.read.parquet(f"{folders[0]}/benchmark.parquet"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 5] and kept.columns == docs.columns
    spans = F.array(F.struct(F.lit(1).alias("at"), F.lit(2).alias("len")))
    cut = spark.createDataFrame([("a B, c d.",)], "t string").select(op06_decontaminate.cut_spans(F.col("t"), spans).alias("t")).first().t
    assert cut == "a ,  d."


def test_audio(spark, folders, con):
    rows = {r.doc_id: r for r in op07_audio.op7_audio(spark, FOLDER).collect()}
    for key, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload) + 44)
    again = [r.feature for r in op07_audio.op7_audio(spark, folders[0]).collect() if r.doc_id == 0]
    assert len(again) == 2 and again[0] == again[1]
    taps = op07_audio.TAPS * op07_audio.UP
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / op07_audio.DOWN) / op07_audio.DOWN * np.hamming(taps) * op07_audio.UP
    samples = np.random.default_rng(0).integers(0, 256, 50_000, dtype=np.uint8)
    up = np.zeros(len(samples) * op07_audio.UP)
    up[:: op07_audio.UP] = (samples.astype(float) - 128) / 128
    wanted = np.convolve(up, h)[: len(up)][:: op07_audio.DOWN]
    assert np.abs(np.concatenate(list(op07_audio.resample_blocks(samples))) - wanted).max() < 1e-5
    assert op07_audio.hysteresis(np.array([-30, -20, -10, -20, -20, -30, -20, -5.0])) == [(2, 5), (7, 8)]
    grid, _ = op07_audio.features(b"\x80" * 5760)
    assert grid.shape[1:] == (op07_audio.SPAN_FRAMES, op07_audio.N_MELS) and len(op07_audio.tensor_bytes(grid)) > grid.nbytes


def test_warc(spark, folders, con):
    pages = {p: (u, (h or "").encode()) for p, u, h in con.execute("SELECT page_id, url, html FROM pages").fetchall()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p][1], p)
    rows = op08_warc.op8_warc(spark, FOLDER).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        data = pages[r.page_id][1]
        refers = None if first[data] == r.page_id else first[data]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers)
    odd = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in op08_warc.op8_warc(spark, folders[0]).collect())
    assert odd == [(0, "revisit", 2), (1, "response", 0), (1, "response", 0), (2, "response", 0), (3, "revisit", 1)]


def test_index_lookup_of_some_keys(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.site"), F.col("id") % 3, F.lit(".org/p"), F.col("id") % 50).alias("url"), F.col("id").cast("string").alias("html"))
    captures = op08_warc.write_archives(op08_warc.with_revisits(pages))
    shards = op08_warc.build_index(captures)
    wanted = pages.where("page_id % 777 = 5").select(op08_warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    assert {int(r.page) for r in op08_warc.lookup(wanted, shards).collect()} == set(range(5, 5000, 777))
    assert op08_warc.lookup(spark.createDataFrame([("zz",), ("",)], "key string"), shards).count() == 0


def test_language(spark, folders):
    texts = {"en": "the cat and the dog of the house with that", "de": "der hund und die katze ist nicht größer als das haus", "fr": "le chien et la maison est dans les rues avec une"}
    rows = [(i, " ".join(random.Random(i).choices(t.split(), k=30)), lang) for k, (lang, t) in enumerate(texts.items()) for i in range(k * 100, k * 100 + 60)]
    docs = spark.createDataFrame([*rows, (900, "$$ 12 ²", "en"), (901, None, "en"), (902, "the house", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in op09_language.identify(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and all(found[r[0]].lang_pred == r[2] for r in held)
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].score == 0 and found[902].lang_pred == "en"
    out = op09_language.op9_language(spark, folders[0]).collect()
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 5)} == {"und"} and all(0 <= r.score <= 1 for r in out)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab"]
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.2])[:, None]
    got = np.exp(op09_language.Scorer(pieces, p).forward(["▁ab"])[0, 0])
    assert abs(got - (0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.05 * 0.3 + 0.2)) < 1e-12


def test_chat_round_trip(spark):
    odd = ["", "###", "\\###", "</turn>", "\\\\</turn>\n### User: x", "####", "#" * 9, " ", "x\\", "### Assistant: hi </turn>\n", "\n", "é😀 ### "]
    rows = [(c, t, random.Random(c * 7 + t).choice(["user", "assistant", "a:b", "@", "", "#\\c"]), random.Random(c * 31 + t).choice(odd) + random.Random(c + t).choice(odd)) for c in range(60) for t in range(5)]
    talks = op10_chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in talks:
        wanted = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.parsed] == wanted
        cut = "".join(r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans)
        assert cut == "".join(t.body for t in r.parsed if t.role == "assistant")
