"""The registered queries on whole small tables against the brute versions."""

import math

import pytest
from pyspark.sql import functions as F

from docrevise.llm import queries as Q
from docrevise.llm import quality_fm, token_counts
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def pages(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_op1(spark, docs):
    got = Q.op1_license_scan(spark, SF)
    base = rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert base == sorted(((d, *brute.licence_base(t)) for d, t, _ in docs), key=repr)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["n_base"] == 0 or r["score"] == 1)
    assert got.where("labels like '%gpl-3%'").count() == sum("gnu general public license version 3" in " ".join(brute.alnum_words(t)) for _, t, _ in docs)


def test_op2(spark, docs):
    got = Q.op2_quality_fm(spark, SF)
    rs = got.collect()
    assert sorted(r["doc_id"] for r in rs) == sorted(d for d, _, _ in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rs)
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["score"], lab[r["doc_id"]]) for r in rs if r["held_out"] and r["doc_id"] in lab]
    pos, neg = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.9, auc


def test_op3(spark, pages):
    got = rows(Q.op3_warc_transactions(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(brute.warc_rows([(p, h) for p, _, h in pages]), key=repr)


def test_op4(spark, docs):
    got = rows(Q.op4_simhash_dedup(spark, SF), "doc_id", "fingerprint", "component_id")
    fps = [brute.simhash(t) for _, t, _ in docs]
    comp = brute.components([d for d, _, _ in docs], fps)
    assert got == sorted(((d, f"{f:016x}", c) for (d, _, _), f, c in zip(docs, fps, comp)), key=repr)


def test_op5(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {}
    for item, t in items:
        w = brute.alnum_words(t)
        for i in range(len(w) - 9):
            grams.setdefault(tuple(w[i:i + 10]), []).append((item, t))
    got = rows(Q.op5_decontaminate(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = []
    for d, t, _ in docs:
        w = brute.alnum_words(t)
        near = {x for i in range(len(w) - 9) for x in grams.get(tuple(w[i:i + 10]), ())}
        want.append((d, *brute.contamination(t, sorted(near))))
    assert got == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in got) > 5


def test_op6(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER))
    got = rows(Q.op6_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(brute.token_rows([(d, t) for d, t, _ in docs], tok), key=repr)


def test_op7(spark, docs):
    got = Q.op7_quality_rules(spark, SF)
    base = rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert base == sorted(((d, *brute.statistics(t)) for d, t, _ in docs), key=repr)
    assert got.where("base_failed and kept").count() == 0
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    j = got.where("not base_failed").join(lab, "doc_id")
    assert j.where("quality = 1 and not kept").count() <= 0.02 * j.where("quality = 1").count()
    assert j.where("quality = 0 and not kept").count() >= 0.5 * j.where("quality = 0").count()


def test_op8(spark, docs):
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in Q.op8_token_counts(spark, SF).collect()}
    pieces = token_counts.vocabulary(Q.vocabulary_path(Q.PIECES))
    known = {}
    for d, t, _ in docs:
        w = t.split()
        for x in w:
            if x not in known:
                known[x] = brute.segment("▁" + x, pieces, token_counts.UNKNOWN)
        assert got[d] == (len(w), sum(known[x] for x in w))


def test_op9(spark, docs):
    got = Q.op9_mix_sources(spark, SF).collect()
    sizes = {d: len(brute.solid_words(t)) for d, t, _ in docs}
    totals = {}
    for d, _, s in docs:
        totals[s] = totals.get(s, 0) + sizes[d]
    want, taken = brute.targets(totals), {}
    source = {d: s for d, _, s in docs}
    assert len(got) == len(docs)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[s]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 1, (s, taken[s], t)
    again = Q.op9_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_op10(spark, pages):
    got = {r["page_id"]: r for r in Q.op10_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    for p, url, _ in pages:
        host, path = brute.url_parts(url)
        rule, verdict = brute.url_rule(host, path)
        r = got[p]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_held_out_never_learnt(spark):
    """Flipping the labels of held-out rows changes no score."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = lab.withColumn("quality", F.when(quality_fm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    kw = {"epochs": 1, "max_rows": 200}
    assert rows(quality_fm.classify(d, lab, **kw), "doc_id", "score") == rows(quality_fm.classify(d, flipped, **kw), "doc_id", "score")
