"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docrevise.llm import queries as Q
from docrevise.llm import spelling
from tests.llm import brute

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(docs, min_chars=6, min_count=5):
    c = Counter()
    for d, t in docs:
        for m in RUN.findall(t or ""):
            w = m.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def groups(vocab, near):
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n, len(near[w]), vocab[form[w]] if form[w] else -1) for w, n in vocab.items())


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    vocab = words_of([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    letters = sorted({c for w in vocab for c in w})
    near = {w: [x for x in {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters}
                if x != w and x in vocab] for w in vocab}
    want = groups(vocab, near)
    assert sum(1 for r in want if r[1]) > 5 and got(Q.op11_spelling_variants(spark, sf)) == want


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    base = ["aabbaabb", "colours", "neighbour", "zebrazz", "étéàÿ×x", "x" * 300, "x" * 299 + "y", "Mississippi"]
    docs = []
    for i in range(300):
        t = []
        for _ in range(30):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abzàÿ") + w[k:], w[:k] + r.choice("abz×") + w[k + 1:]])
            t.append(w)
        docs.append((i // 2 if i % 50 else None, r.choice([" ", "-", "1", "\n", "Ā"]).join(t)))
    # a chain of forms, ties, repeated rows, nulls
    docs += [(9_000, " ".join(["chained"] * 3000 + ["chainedx"] * 500 + ["chainedxy"] * 80 + ["chainedxyz"] * 12 + ["tiedword"] * 40 + ["tiedwore"] * 40 + ["tiedwor"] * 6))]
    return docs + [(1, None), (None, None), (2, ""), docs[3], docs[3]]


def test_all_pairs(spark, corpus):
    """Also with filters so small that they are cut into shards and passes."""
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").selectExpr("*", "1 as word", "2 as n", "'z' as form")
    vocab = words_of(corpus)
    near = {w: [x for x in vocab if x != w and one_edit(w, x)] for w in vocab}
    want = groups(vocab, near)
    assert got(spelling.spelling_variants(df)) == want
    assert got(spelling.spelling_variants(df, max_bytes=64, bits_per_word=12)) == want
    roots = {r[0]: r[2] for r in want}
    assert roots["chainedxyz"] == roots["chainedx"] == "chained"
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_filters():
    """Edits' rolling hashes equal those of the edited words; members pass; few others do."""
    r = np.random.default_rng(1)
    codes = r.integers(97, 123, (50, 9)).astype(np.uint32)
    for c, row, at, h in spelling._edits(codes, list(range(97, 123)), True, True):
        edited = [np.concatenate([w[:i], [c] if c >= 0 else [], w[i + 1:]]).astype(np.uint32) for w, i in zip(codes[row], at)]
        assert (spelling.word_hashes(np.array(edited)) == h).all()
    x = spelling.Length(9, 2000, 1, -(-2000 * 24 // 256))
    h = r.integers(0, 1 << 63, 2000).astype(np.uint64)
    table = np.zeros(x.blocks * 8, np.uint32)
    _, block, bits = x.place(h)
    for lane in range(8):
        np.bitwise_or.at(table, block * 8 + lane, np.uint32(1) << spelling._bit(bits, lane))
    assert len(spelling.probe(table, block, bits)) == 2000
    _, block, bits = x.place(r.integers(0, 1 << 63, 100_000).astype(np.uint64))
    assert len(spelling.probe(table, block, bits)) < 300
    passes = spelling.plan_filters({6: 1000, 7: 5, 8: 100_000}, 24, 4096)
    assert all(sum(x.blocks * 32 for x, _ in p) <= 4096 for p in passes)
