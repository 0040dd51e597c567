"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, operator by operator, and the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docrevise.llm import decontaminate, licenses, mixing, quality_fm, quality_rules, simhash, token_counts, token_files, url_filter, warc
from docrevise.llm import queries as Q
from tests.llm import brute

LONG = " ".join(f"w{i % 977}x{i // 7}" for i in range(60_000))
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that operators use inside themselves
EXTRA = ["q_w", "m_size", "fp", "text_hash", "items", "start", "key", "bad", "value", "Row_"]


def clean(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(r.randrange(500)) for _ in range(n)) + "."


TEXTS = [None, "", "   \n\t ", "one", "One TWO three", clean(40, 1), clean(40, 1), LONG, "ÀB  x\u00a0y\r\n z", "a\tb c\n\nd ", clean(60, 2) + "\n" + clean(60, 2),
         "Released under the MIT License.", "Relased under th MIT License", "# $ % | < > & *" * 20, "word " * 50, "\n", "'s it's ١٢ x²", "a<|endoftext|>b <|endoftext|> c  d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", [None, "a", "b", ""][i % 4], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, clean(30, 3), None, None, None), (None, clean(30, 3), None, None, None), (3, "other text, same id", "en", "a", 1)]
    d = spark.createDataFrame(rows, NAMES)
    return d.select("*", *[F.lit("z").alias(x) for x in EXTRA])


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_licenses(docs, empty):
    got = licenses.digest(licenses.scan_licenses(docs))
    want = [(r["doc_id"], *brute.licence_base(r["text"])) for r in docs.collect()]
    assert key(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == key(want)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[11]["labels"] == "mit" and by[11]["score"] == 1.0
    assert by[12]["n_base"] == 0 and by[12]["labels"] == "mit" and 0.8 < by[12]["score"] < 1
    assert licenses.scan_licenses(empty).count() == 0


def test_licence_seeds_lose_nothing():
    """Every match within the budget is found: the seeds against the regex on the whole text."""
    import regex
    r, s = random.Random(5), licenses.Scanner()
    for notice, label, k, pattern in s.notices:
        for _ in range(30):
            t = list(notice)
            for _ in range(r.randrange(k + 1)):
                i = r.randrange(len(t))
                t[i:i + 1] = r.choice([[], [r.choice("abc ")], [t[i], r.choice("xyz")]])
            text = "some words before " + "".join(t) + " and after"
            assert pattern.search(text) and any(h[0] == label for h in s.fuzzy(text)), text
    assert regex


def test_quality_fm(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, 0), (1, None, 0), (0, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = quality_fm.classify(docs, labels, epochs=1).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality_fm.classify(docs, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}
    assert quality_fm.classify(empty, labels).count() == 0


def test_factorisation_identity():
    import numpy as np
    rng = np.random.default_rng(0)
    m = quality_fm.Model(0.1, rng.normal(size=20), rng.normal(size=(20, 3)), np.zeros(0), np.ones(0), 20)
    idx, x = np.arange(0, 20, 3), rng.normal(size=7)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(7) for j in range(i))
    assert abs(m.raw(idx, x)[0] - (0.1 + m.w[idx] @ x + pairs)) < 1e-9


def test_warc(spark):
    big = "x" * 150
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello" * 5
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (7, "u", None), (3, "u", ""), (4, "u", tricky), (9, "é", tricky), (5, "u", "short"), (6, "u", "short"),
            (None, "u", big), (None, "u", "null id only, but it is a payload of one hundred bytes or more, so that it could be revisited by others, twice")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("value", F.lit(1)).withColumn("digest", F.lit(2))
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.digest(warc.archive(pages)).collect()}
    assert len(got) == len(rows)
    for p, n, sha, kind, ref in brute.warc_rows([(p, h) for p, _, h in rows if p is not None]):
        r = got[(p, n)]
        assert (r["payload_digest"], r["record_type"], r["refers_to"]) == (sha, kind, ref)
    assert got[(None, 150)]["record_type"] == "revisit" and got[(None, 150)]["refers_to"] == 1
    assert warc.archive(pages.limit(0)).count() == 0
    twice = warc.archive(pages.where("page_id = 1").union(pages.where("page_id = 1")))
    assert twice.count() == 2 and twice.where("request is null or metadata is null").count() == 0


def test_warc_records_resolve(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "y" * 200) for i in range(5)], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    r = warc.read_records(spark, str(tmp_path / "w"), payloads=True).collect()
    ids = {x["record_id"]: x for x in r}
    assert len(r) == len(ids) == 15
    for x in r:
        if x["record_type"] == "revisit":
            assert ids[x["refers_to"]]["record_type"] == "response" and bytes(ids[x["refers_to"]]["block"]) == b"y" * 200


def test_simhash(docs, empty):
    rows = docs.collect()
    fps = [brute.simhash(r["text"]) for r in rows]
    want = [(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute.components([r["doc_id"] for r in rows], fps))]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")), "component_id")
    assert key(got.collect()) == key(want)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    groups = set(brute.components(list(range(len(rows))), fps))
    assert len(left) == len(groups)
    assert simhash.near_dedup(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    leak = clean(12, 9)
    bench = [(1, leak), (2, "Three words, only"), (2, "three WORDS only"), (3, None), (4, ""), (None, "Zwölf"), (5, " ".join(["same"] * 12))]
    b = spark.createDataFrame(bench, "item_id bigint, text string").withColumn("hash", F.lit(0))
    extra = [(100, "x " + leak + " y"), (101, "three words only three words only"), (102, "zwölf Zwölf"), (103, "same " * 15), (104, leak.replace(" ", "  ").upper()),
             (104, leak.replace(" ", "  ").upper())]
    d = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    rows = d.collect()
    h = decontaminate.document_hits(d, b).withColumn("c", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    got = h.select("doc_id", "n_words", decontaminate.covered_words(F.col("starts")), F.size("items"),
                   F.sha2(F.array_join("items", ",").cast("binary"), 256), F.size("starts") > 0)
    want = [(r["doc_id"], *brute.contamination(r["text"], bench)) for r in rows]
    assert key(got.collect()) == key(want)
    kept = decontaminate.remove_documents(d, b)
    assert kept.columns == d.columns
    assert key(kept.select("doc_id", "text").collect()) == key([(r["doc_id"], r["text"]) for r, w in zip(rows, want) if not w[-1]])
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(d, b).collect()}
    assert spans[100] == "x . y" and spans[7] == LONG
    few = decontaminate.document_hits(d, b, broadcast_ngrams=0)
    assert key(few.select("doc_id", "starts", "items").collect()) == key(h.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "starts", "items").collect())
    assert decontaminate.remove_documents(d, b.limit(0)).count() == d.count()
    assert decontaminate.document_hits(empty, b).count() == 0


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER))
    got = token_files.token_files(docs, Q.vocabulary_path(Q.TOKENIZER), n_shards=3).collect()
    assert key(got) == key(brute.token_rows([(r["doc_id"], r["text"]) for r in docs.collect()], tok))
    assert token_files.token_files(empty, Q.vocabulary_path(Q.TOKENIZER)).count() == 0


def test_encoder_random():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER))
    enc, r = token_files.Encoder(open(Q.vocabulary_path(Q.TOKENIZER), encoding="utf-8").read(), cache=50), random.Random(3)
    for _ in range(30):
        texts = ["".join(r.choice([" ", " ", "\n", "a", "Bc", "'s", "é", "12", "!", "\t", "\u2028", "\x1c", "<|endoftext|>", "  ", "日", "²", "×", "ɐ", "\x00",
                                   "word", "'"]) for _ in range(r.randrange(30))) for _ in range(40)]
        ids, sizes = enc.batch(texts)
        want = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_quality_rules(spark, docs, empty):
    got = quality_rules.text_statistics(docs.select("doc_id", "text")).select(
        "doc_id", "q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", quality_rules.base_failed())
    assert key(got.collect()) == key([(r["doc_id"], *brute.statistics(r["text"])) for r in docs.collect()])
    labels = spark.createDataFrame([(None, 1), (1, None), (5, 1)], "doc_id bigint, quality int").withColumn("bad", F.lit(1))
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert key(kept.select("doc_id", "text").collect()) == key([(r["doc_id"], r["text"]) for r in docs.collect() if not brute.statistics(r["text"])[-1]])
    assert quality_rules.filter_documents(docs, labels.limit(0)).count() == kept.count()
    assert quality_rules.filter_documents(empty, labels).count() == 0


def test_learned_list_rejects(spark):
    """A planted threshold rule is found, and only it."""
    good = [(i, clean(50, i), 1) for i in range(150)]
    junk = [(1000 + i, clean(50, 500 + i).replace(" ", "$$$ "), 0) for i in range(60)]
    d = spark.createDataFrame(good + junk, "doc_id bigint, text string, quality int")
    st = quality_rules.text_statistics(d.select("doc_id", "text"))
    rules = quality_rules.learn_rules(quality_rules.labelled_statistics(st, d.select("doc_id", "quality")))
    assert 1 <= len(rules.rules) <= 2, str(rules)
    kept = {r["doc_id"] for r in st.where(rules.verdict()).collect()}
    assert kept == set(range(150))


def test_token_counts(docs, empty):
    pieces = token_counts.vocabulary(Q.vocabulary_path(Q.PIECES))
    want = []
    for r in docs.collect():
        w = (r["text"] or "").split()
        want.append((r["doc_id"], len(w), sum(brute.segment("▁" + x, pieces, token_counts.UNKNOWN) for x in w[:500]) if len(w) < 500 else None))
    got = [(r["doc_id"], r["n_pretokens"], r["n_tokens"] if r["n_pretokens"] < 500 else None)
           for r in token_counts.count_tokens(docs, Q.vocabulary_path(Q.PIECES)).collect()]
    assert key(got) == key(want)
    assert token_counts.count_tokens(empty, Q.vocabulary_path(Q.PIECES)).count() == 0
    t = token_counts.TrieCounter(pieces)
    t.counts(["▁abc", "▁abd", "▁ab", "▁abcd"])
    assert t.nodes == 6  # one step per trie node: ▁ a b c d, and d after ab


def test_mixing(docs, empty):
    m = mixing.mix(docs)
    rows = m.collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        assert r["m_taken"] == r["m_copies"] * len(brute.solid_words(r["text"])) <= 3 * len(brute.solid_words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.solid_words(r["text"]))
    want = brute.targets(sizes)
    for r in rows:
        assert abs(r["m_target"] - want[r["source"]]) < 1e-6 and r["m_source_size"] == sizes[r["source"]]
    rep = mixing.repeat_documents(docs)
    assert rep.columns == docs.columns and rep.count() == sum(r["m_copies"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert {r["m_taken"] for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_mixing_inclusion(spark):
    """Over many documents the extra copy goes to about the wanted share, and a
    weight of 3 raises the odds."""
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"),
                                 F.lit("w w w w").alias("text"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("wt"))
    t = brute.targets({"a": 16000, "b": 8000})
    m = mixing.mix(d)
    for r in m.groupBy("source").agg(F.sum("m_taken").alias("s")).collect():
        assert abs(r["s"] - t[r["source"]]) <= 4
    w = mixing.mix(d, weight="wt").groupBy("source", "wt").agg(F.sum("m_taken").alias("s"), F.avg("m_copies").alias("c"))
    by = {(r["source"], r["wt"]): r for r in w.collect()}
    assert abs(by["a", 3.0]["s"] + by["a", 1.0]["s"] - t["a"]) <= 4
    if t["a"] % 16000:
        assert by["a", 3.0]["c"] > by["a", 1.0]["c"]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x", "https://example.com/en/2", "http://a.net/es/", "http://net/fr/x#y", "http://x.net?q/es/",
            "http://x.org/a/b/c/d/e/f/g/h", "x://y://z.net/es/1", "http://example.com/en/2", "http://ÀÉ.net/fr/é"]
    d = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[5])], "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    rows = url_filter.judge_urls(d).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path = brute.url_parts(urls[r["page_id"]] if r["page_id"] is not None else urls[5])
        rule, verdict = brute.url_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")
    assert url_filter.judge_urls(d.limit(0)).count() == 0


def test_templates(spark):
    """Variable segments become wildcards, and a template that its labels
    call bad takes its unlabelled urls with it."""
    rows = [("h.org", f"/shop/item{chr(97 + i % 26)}{chr(97 + i // 26)}/buy", True if i % 2 else None) for i in range(80)]
    rows += [("h.org", f"/blog/{i}.html", False) for i in range(20)] + [("other.org", "/shop/x/buy", None)]
    t = url_filter.learn_templates(spark.createDataFrame(rows, "host string, path string, blocked boolean")).collect()
    shop = [r for r in t if r["host"] == "h.org" and r["raw"][0] == "shop"]
    assert len(shop) == 80 and {tuple(r["template"]) for r in shop} == {("shop", "*", "buy")} and all(r["reject"] for r in shop)
    assert not any(r["reject"] for r in t if r not in shop)
    assert {tuple(r["template"]) for r in t if r["raw"][0] == "blog"} == {("blog", "*.html")}


def test_pipeline_stages(spark, docs, empty, tmp_path):
    for name, rows in (("benchmark", [(1, clean(12, 9))]), ("labels", [(5, 1, 0)])):
        ddl = "item_id bigint, text string" if name == "benchmark" else "doc_id bigint, quality int, toxic int"
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    for d in (docs, empty):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == d.columns, name
                d = out
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == d.count()


def test_pipeline_against_brute(spark):
    """run() on a small table: every stage checked from what it was given."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    (_, s1), (_, s2), (_, s3), (_, s4), _ = corpus_pipeline.STAGES
    a = s1(spark, d, sf)
    ra = a.collect()
    assert all(not brute.statistics(r["text"])[-1] for r in ra)
    rb = s2(spark, a, sf).collect()
    fps = [brute.simhash(r["text"]) for r in ra]
    comp = brute.components([r["doc_id"] for r in ra], fps)
    assert sorted(r["doc_id"] for r in rb) == sorted(set(comp))
    rc = s3(spark, spark.createDataFrame(rb, d.schema), sf).collect()
    assert sorted(r["doc_id"] for r in rc) == sorted(r["doc_id"] for r in rb if not brute.contamination(r["text"], items)[-1])
    rd = s4(spark, spark.createDataFrame(rc, d.schema), sf).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER))
    got = corpus_pipeline.run(spark, sf).collect()
    assert key(got) == key(brute.token_rows([(r["doc_id"], r["text"]) for r in rd], tok))
