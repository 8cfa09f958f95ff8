"""Encoding, mixing and splitting against the reference tokenizer library, exact round trips and brute force."""

import random
import sys

import numpy as np
import pytest

from thermaline.llm.mixing import mix, mix_corpus
from thermaline.llm.splitting import SparseTable, split, split_documents
from thermaline.llm.tokens import FOLDER, codec, encode

DATA = "/root/testdata/sf0.01"
HARD = ["", None, " ", "\n\n\n", " " * 2_000_000 + "x", "x" + "\t" * 1_500_000, "a" * 300_000, "<|endoftext|> é̈ \r\n\r\n日本語 ' 'll", "word " * 60_000, ("x\n" + " " * 700) * 300, "\x1c" * 900 + " a"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encoding_of_the_whole_table(spark, reference):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    want = reference.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)
    assert all(got[k] == w.ids for k, w in zip(texts, want))
    c = codec()
    assert all(c.bytes(got[k]).decode() == (t or "") for k, t in texts.items())


def test_hard_texts(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)] * 2, "doc_id long, text string, ids string")
    rows = encode(df, "doc_id", "text").collect()
    assert len(rows) == len(HARD)
    for r in rows:
        t = HARD[r.doc_id] or ""
        assert codec().bytes(r.ids).decode() == t
        if len(t) < 400_000:
            assert r.ids == reference.encode(t, add_special_tokens=False).ids, t[:20]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_random_long_white_space(reference):
    rng, c = random.Random(1), codec()
    for _ in range(60):
        t = "".join(rng.choice(["a", "B9", " ", "\n", "\t", "!", "é", " " * 600, "\n" * 513, "　", "\x1d"]) for _ in range(rng.randrange(1, 400)))
        assert c.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_sparse_table_takes_the_rightmost():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, 300).astype(np.int8)
    t = SparseTable(v, 300)
    for _ in range(2000):
        lo, hi = sorted(rng.integers(0, 300, 2).tolist())
        assert t.argmax(lo, hi) == max(range(lo, hi + 1), key=lambda i: (v[i], i))


def pieces_hold(text, pieces, limit, overlap):
    c, data = codec(), text.encode()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    for s, e, n in pieces:
        assert e > s or not data
        assert n == len(c.ids(data[s:e].decode())) <= limit
    for (s0, e0, _), (s1, e1, _) in zip(pieces, pieces[1:]):
        assert s0 < s1 <= e0 < e1
        own = c.ids(data[s0:e0].decode())
        back = len(c.bytes(own[-overlap:]))
        assert 0 <= (e0 - s1) - back < 4  # a character is never torn


def test_pieces_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by = {}
    for r in split_documents(docs, "doc_id", "text").orderBy("doc_id", "piece_no").collect():
        by.setdefault(r.doc_id, []).append((r.first_byte, r.end_byte, r.n_tokens))
        assert r.text == texts[r.doc_id].encode()[r.first_byte : r.end_byte].decode()
    assert set(by) == {k for k, t in texts.items() if t and len(codec().ids(t)) > 1500}
    for k, p in by.items():
        pieces_hold(texts[k], p, 1500, 100)


@pytest.mark.parametrize("text", [t for t in HARD if t] + ["é" * 9000, "\U0001f642" * 3000, "diff --git a b\n" + "+x = 1\n" * 3000])
def test_pieces_of_hard_texts(text):
    pieces_hold(text, split(text, codec()), 1500, 100)


def test_cuts_prefer_the_start_of_a_diff():
    part = "diff --git a/x b/x\n@@ -1 +1 @@\n" + "+some words here\n" * 220
    text = part * 4
    pieces = split(text, codec())
    assert any(text.encode()[e:].startswith(b"diff --git") for _, e, _ in pieces[:-1])


def test_mix_reaches_the_shares(spark):
    docs, targets = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/mix_targets.parquet")
    m = mix_corpus(docs, targets)
    goal = {r.source: r for r in targets.collect()}
    rows = m.chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    used = {}
    for r in rows:
        assert 1 <= r.copies <= goal[r.source].max_repeats
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
    biggest = max(r.n_tokens for r in rows)
    for s, g in goal.items():
        assert abs(used[s] / sum(used.values()) - g.target_share) <= 2 * biggest / sum(used.values())
    report = {r.source: r for r in m.report.collect()}
    assert {s: r.used_tokens for s, r in report.items()} == used
    # one source is used to its cap, so no larger total was possible
    assert any(abs(r.copies_each - r.max_repeats) < 1e-6 for r in report.values())


def test_mix_edge_cases(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 300 else "b" if i < 330 else None, 10 + i % 7, float(1 + i % 3)) for i in range(400)] + [(999, "a", 0, 1.0)], "doc_id long, source string, n_tokens long, w double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    m = mix(sizes, targets, weight="w", bins=8)
    report = {r.source: r for r in m.report.collect()}
    assert report["none"].used_tokens == 0 and set(report) == {"a", "b", "none"}
    assert abs(report["a"].actual_share / report["b"].actual_share - 0.5 / 0.4) < 0.03
    assert report["b"].most_copies == 3 and report["a"].most_copies == 1
    assert sorted(mix(sizes, targets, weight="w", bins=1024).chosen.collect()) == sorted(m.chosen.collect())  # bins don't matter
    assert mix(sizes.limit(0), targets).chosen.count() == 0
    # heavier documents are drawn more often
    a = {r.doc_id for r in m.chosen.filter("source = 'a'").collect()}
    rate = [len([i for i in range(300) if i % 3 == k and i in a]) for k in range(3)]
    assert rate[0] < rate[2]
