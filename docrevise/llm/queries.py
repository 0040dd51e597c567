"""The registered queries of the operators, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrevise.llm import (
    decontaminate, licenses, mixing, packing, quality_fm, quality_rules, simhash, spelling, token_counts, token_files, url_filter,
    vector_codes, warc)
from docrevise.llm.common import stored
from docrevise.plans.registry import table

#: Names of the public vocabulary files (their folder is given by the library).
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_license_scan(spark, sf):
    """Exact licence phrases and fuzzy short notices per document."""
    return licenses.digest(licenses.scan_licenses(table(spark, sf, "documents")))


def op2_quality_fm(spark, sf):
    """Factorisation-machine quality score per document."""
    return quality_fm.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_warc_transactions(spark, sf):
    """Every page written as WARC records and read back, one row per capture."""
    return warc.digest(warc.archive(table(spark, sf, "pages")))


def op4_simhash_dedup(spark, sf):
    """SimHash fingerprint and near-duplicate component per document."""
    d = simhash.near_duplicates(table(spark, sf, "documents"))
    return d.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark, sf):
    """Benchmark windows per document."""
    h = decontaminate.document_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    hit = decontaminate.covered_words(F.col("starts")).cast("long")
    return h.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_token_files(spark, sf):
    """Token-id files written and read back."""
    return token_files.token_files(table(spark, sf, "documents"), vocabulary_path(TOKENIZER))


def op7_quality_rules(spark, sf):
    """Text statistics, the fixed rule and the learned decision list."""
    stats = stored(quality_rules.text_statistics(table(spark, sf, "documents").select("doc_id", "text")).drop("text"), "statistics")
    failed = quality_rules.base_failed()
    rules = quality_rules.learn_rules(quality_rules.labelled_statistics(stats.where(~failed), table(spark, sf, "labels")))
    return stats.select(
        "doc_id", *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"))


def op8_token_counts(spark, sf):
    """Unigram token counts per document."""
    return token_counts.count_tokens(table(spark, sf, "documents"), vocabulary_path(PIECES))


def op9_mix_sources(spark, sf):
    """Words that the mix takes of every document."""
    m = mixing.mix(table(spark, sf, "documents"))
    return m.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"),
                    F.col("m_target").alias("target"), F.col("m_taken").alias("taken"))


def op10_url_filter(spark, sf):
    """Rule and template verdict per url."""
    return url_filter.judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling_variants(spark, sf):
    """Words of all documents with their near words, forms and roots."""
    return spelling.spelling_variants(table(spark, sf, "documents"))


def op12_pack_documents(spark, sf):
    """All documents packed into sequences of at most 1,024 tokens."""
    return packing.pack_documents(table(spark, sf, "documents"), vocabulary_path(TOKENIZER))


def op13_vector_codes(spark, sf):
    """Product-quantisation codes of all embeddings."""
    return vector_codes.compress_vectors(table(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_fm, op3_warc_transactions, op4_simhash_dedup, op5_decontaminate, op6_token_files,
    op7_quality_rules, op8_token_counts, op9_mix_sources, op10_url_filter, op11_spelling_variants, op12_pack_documents,
    op13_vector_codes)}

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")



def _vector_sql(rounds: int = 6) -> str:
    """The codebook rounds as a chain of statements: every part with every
    entry of its position, the smallest (distance, entry) wins."""
    chain = ["""k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "e AS (SELECT rid, unnest(generate_series(0, len(v) - 1)) AS i, len(v) // 8 AS w, v FROM k)",
             "x AS MATERIALIZED (SELECT rid, i // w AS part, i % w AS pos, v[i + 1] AS c FROM e)",
             "c0 AS MATERIALIZED (SELECT part, rid AS entry, pos, c FROM x WHERE rid < 16)"]
    for r in range(rounds + 1):
        chain.append(f"""d{r} AS MATERIALIZED (SELECT rid, part, min(d * 16 + entry) AS best FROM (
  SELECT x.rid, x.part, c{r}.entry, CAST(sum((x.c - c{r}.c) * (x.c - c{r}.c)) AS BIGINT) AS d
  FROM x JOIN c{r} ON x.part = c{r}.part AND x.pos = c{r}.pos GROUP BY x.rid, x.part, c{r}.entry) GROUP BY rid, part)""")
        if r < rounds:
            chain.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, o.pos, coalesce((s - ((s % n) + n) % n) // n, o.c) AS c
  FROM c{r} o LEFT JOIN (SELECT x.part, best % 16 AS entry, x.pos, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS n
                         FROM x JOIN d{r} ON x.rid = d{r}.rid AND x.part = d{r}.part GROUP BY ALL) u
  ON o.part = u.part AND o.entry = u.entry AND o.pos = u.pos)""")
    return "WITH " + ",\n".join(chain) + f""",
f AS (SELECT rid, string_agg(format('{{:02x}}', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM d{rounds} GROUP BY rid),
j AS (SELECT k.vec_id, k.label, f.code, f.error FROM k JOIN f ON k.rid = f.rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256 FROM j"""


#: The others need hashes, tokenizers, learning or components that SQL does
#: not have; tests compare them with brute-force versions.
SQL: dict[str, str] = {
    "op3_warc_transactions": """WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS of FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN of = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN of <> page_id THEN of END AS refers_to FROM f""",
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
x AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
y AS (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM x),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM y),
l AS (SELECT DISTINCT n FROM g),
e AS (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN l ON len(w) >= n),
h AS (SELECT e.doc_id, e.i, e.n, g.item_id FROM e JOIN g ON g.n = e.n AND g.gram = array_to_string(e.w[e.i:e.i + e.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op13_vector_codes": _vector_sql(),
}
