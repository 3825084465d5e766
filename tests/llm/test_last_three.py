"""Manifest, alignment and quality rules against plain Python."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxspark.llm import op11_manifest, op12_alignment, op13_quality

FOLDER = os.environ.get("VOXSPARK_TEST_TABLES", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `g` string, slot int, pairs string, kept string, row int"


def written(spark, folder, rows):
    spark.createDataFrame([(*r, "x", 1, "p", "k", 2) for r in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same(found, wanted):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def naive_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def naive_tree(level):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            low = a - a % 3
            paths[i].append(("".join(level[low:a]), "".join(level[a + 1 : low + 3])))
            at[i] = a // 3
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def naive_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, naive_leaf(row, row[1]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
    trees = [naive_tree([m[2] for m in groups[g]]) for g in order]
    root, above = naive_tree([t[0] for t in trees]) if trees else ("", [])
    for g, (subroot, paths), upper in zip(order, trees, above, strict=True):
        for (_, _, leaf, row), path in zip(groups[g], paths, strict=True):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = naive_leaf(row, text)
            for left, right in path + upper:
                folded = sha(left, folded, right)
            yield row[0], leaf, subroot, root, sha(*[a + b for a, b in path + upper]), folded, folded == root


ODD = [(0, "a\nb", "en", "a", 1)] * 3 + [(None, "a\nb", "en", "a", 1)] * 3 + [(None, "q", "en", "a", 1), (0, "z", None, "a", None), (-5, None, None, None, None), (2**63 - 1, "", "é", "é", 3), (-(2**63), "x" * 100_000 + "\n", "ß", "b", 4), (1, "\n", "en", "", 1)]


def test_manifest_by_brute_force(spark, tmp_path):
    draw = random.Random(3)
    many = [(draw.choice([k, k, k, 7, k * 64, k * 4096 + k]), f"t{draw.randint(0, 9)}\n", "en", draw.choice(["a", "a", "a", "s1", None]), k) for k in range(2500)]
    for name, rows in (("odd", ODD + many), ("one", ODD[:1])):
        found = op11_manifest.op11_manifest(spark, written(spark, tmp_path / name, rows)).collect()
        same(found, naive_manifest(rows))


def test_manifest_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    same(op11_manifest.op11_manifest(spark, FOLDER).collect(), naive_manifest([tuple(r) for r in docs.collect()]))


def test_a_swapped_document_is_noticed(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "a") for k in range(30)], "doc_id long, text string, source string")
    leaves = docs.select("doc_id", "source", op11_manifest.digest(docs.doc_id, docs.text).alias("leaf"))
    rows, root = op11_manifest.manifest(leaves, "source", "doc_id", "leaf")
    honest = rows.select(op11_manifest.fold(rows.leaf, rows.path).alias("r")).distinct().collect()
    assert [r.r for r in honest] == [root]
    other = rows.select(op11_manifest.fold(op11_manifest.digest(rows.key + 1, rows.leaf), rows.path).alias("r")).distinct().collect()
    assert root not in {r.r for r in other}


def naive_product(a, b):
    return np.asarray(a) @ np.asarray(b)


def dense(csr):
    out = np.zeros((len(csr.starts) - 1, csr.width), dtype=np.int64)
    for i in range(len(out)):
        for k in range(csr.starts[i], csr.starts[i + 1]):
            out[i, csr.columns[k]] += csr.values[k]
    return out


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_row_products_by_brute_force(most):
    draw = np.random.default_rng(1)
    for _ in range(40):
        shape = draw.integers(1, 9, 3)
        sides = []
        for rows, width in ((shape[0], shape[1]), (shape[1], shape[2])):
            full = draw.integers(0, 4, (rows, width)) * (draw.random((rows, width)) < 0.5)
            at = np.nonzero(full)
            sides.append((full, op12_alignment.Csr(np.concatenate([[0], np.cumsum(np.count_nonzero(full, axis=1))]), at[1], full[at], int(width))))
        (a, sparse_a), (b, sparse_b) = sides
        out = np.zeros((shape[0], shape[2]), dtype=np.int64)
        for rows, columns, values in op12_alignment.gustavson(sparse_a, sparse_b, most):
            out[rows, columns] += values
        assert (out == a @ b).all() and (dense(sparse_a.transposed()) == a.T).all()


@pytest.fixture(scope="module")
def both():
    a, b = op12_alignment.default_paths()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return op12_alignment.Tokenizers(f.read(), g.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(op12_alignment.default_paths()[0])
    found.encode_special_tokens = True
    return found


def naive_alignment(both, library, text):
    """Without parts, batches and matrices, by the libraries themselves."""
    a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, both.b.encode(text or "")
    spelled = (" " + (text or "")).encode()
    if not text or b"".join(both.bytes_b[i] for i in b) != spelled:
        return 0, 0, 0, 0, "", Counter()
    assert b"".join(both.bytes_a[i] for i in a) == spelled
    ends_a, ends_b = np.cumsum([len(both.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(both.bytes_b[i]) for i in b]).tolist()
    pairs, groups, i, j = Counter(), [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        last_i, last_j = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        for x in a[i:last_i]:
            for y in b[j:last_j]:
                pairs[x, y] += 1
        groups.append(",".join(map(str, a[i:last_i])) + "|" + ",".join(map(str, b[j:last_j])))
        i, j = last_i, last_j
    return len(a), len(b), len(groups), sum(pairs.values()), sha(";".join(groups)), pairs


STRANGE = [None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "x▁y z", "  a", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 🙂 naïve", "a" * 3000, "\n" * 500 + "x", " " * 700, "a\x1c b", "é ́ x", "\x00 \x01"]


def check(both, library, texts):
    for text, found in zip(texts, both.align(texts), strict=True):
        *counts, pairs = naive_alignment(both, library, text)
        assert [*found[:3], *found[4:6]] == counts, text
        mask = (1 << op12_alignment.SHIFT) - 1
        assert {(p >> op12_alignment.SHIFT, p & mask): n for p, n in zip(found[6].tolist(), found[7].tolist(), strict=True)} == pairs


def test_alignment_of_strange_texts(both, library):
    check(both, library, STRANGE)
    check(both, library, STRANGE[::-1])  # now from memory


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé日 　▁🙂́\x1c\x85\xa0  \n\t'sdlv.,!19<>") | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_alignment_of_drawn_texts(both, library, texts):
    check(both, library, texts)


def test_parts_are_forgotten(both, library, monkeypatch):
    monkeypatch.setattr(op12_alignment, "MOST_PARTS", 3)
    check(both, library, ["one two three four five", "two six one"])
    check(both, library, ["five four", "seven"])


def test_overlaps_share_bytes(both):
    at_a, at_b, shared = op12_alignment.overlaps(np.array([1, 3, 2]), np.array([2, 2, 1, 1]))
    assert list(zip(at_a.tolist(), at_b.tolist(), shared.tolist(), strict=True)) == [(0, 0, 1), (1, 0, 1), (1, 1, 2), (2, 2, 1), (2, 3, 1)]


@pytest.mark.parametrize("frequent", [op12_alignment.FREQUENT, 5, 1])
def test_alignment_by_brute_force(spark, tmp_path, both, library, monkeypatch, frequent):
    """Whatever the share of pairs that are broadcast."""
    monkeypatch.setattr(op12_alignment, "FREQUENT", frequent)
    rows = [(k, text, "en", "a", 1) for k, text in enumerate(STRANGE)] + [(5, "a  b", None, None, None), (None, "the cat sat on the mat", "en", "a", 1), (7, "the mat", "en", "a", 2)]
    every = [naive_alignment(both, library, r[1]) for r in rows]
    counts, top = Counter(p for x in every for p in x[5]), {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    wanted = [(r[0], *x[:4], sum(n for p, n in x[5].items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in x[5].items()), x[4]) for r, x in zip(rows, every, strict=True)]
    out = op12_alignment.op12_alignment(spark, written(spark, tmp_path, rows))
    same(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect(), wanted)


def test_lines_fail_by_their_rule():
    rule = lambda line: op13_quality.failure(line, len(line.split()))
    assert rule("A plain sentence, as in any book.") is None
    assert rule("«Une phrase.»") is None and rule("Ein Satz ohne Fehler!") is None
    assert rule("A line that just stops") == "punctuation"
    assert rule("a*** b&&& c%%%.") == "punctuation" and rule("BUY!! NOW!! HERE!!") == "punctuation"
    assert rule("Home | About us | Shop | Contact") == "navigation" and rule("Home » News » 2020 » May") == "navigation"
    assert rule("Login / Register") == "navigation" and rule("Search") == "navigation"
    assert rule("We use cookies; by going on you accept them.") == "boilerplate" and rule("Copyright 2020 Acme.") == "boilerplate"
    assert rule("Please enable JavaScript to see this page.") == "boilerplate" and rule("Released under the MIT License.") == "boilerplate"
    assert rule("the word cookies alone is " + "fine " * 40 + "accept.") is None


def test_a_document_goes_if_it_loses_too_much():
    body = "\n".join(f"Line{k} of{k} some{k} text about{k} {k * k} odd{k} things." for k in range(10))
    good = op13_quality.judge(body + "\nHome | About | Shop | News\n")
    assert good.kept and good.cleaned == body + "\n" and good.n_navigation == 1 and good.lost_chars == 20 and good.n_lines == 11
    bad = op13_quality.judge("one short line.\n" + "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(20)))
    assert not bad.kept and not bad.base_failed and bad.cleaned == "one short line."
    assert op13_quality.judge(None) == op13_quality.judge("") and op13_quality.judge(None).base_failed


def naive_repeats(words):
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)})


@given(st.lists(st.sampled_from(["a", "b", "c", "é"]), max_size=30))
def test_repeats_by_brute_force(words):
    assert op13_quality.repeated_words([w.encode() for w in words]) == naive_repeats(words)


def test_quality_of_awkward_rows(spark, tmp_path):
    from tests.compare import assert_same, connect

    long = " ".join(f"w{k}." for k in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (4, "a b c a b c\na b c a b c\n\n \n", "en", "a", 2), (None, " x y z.\x0b\x1c", "en", "a", 3), (5, "a\r\nb\r\na\r\n", "de", "b", 3)]
    folder = written(spark, tmp_path, rows)
    assert_same(op13_quality.op13_quality(spark, folder), connect(folder), op13_quality.ORACLE_SQL)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = op13_quality.assess(docs)
    assert set(docs.columns) - {"text", "kept"} < set(out.columns) and dict(out.dtypes)["kept"] == "boolean" and out.count() == len(rows)
