"""Registered revision queries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from docrevise.operators import chunks as C
from docrevise.operators import instructions as I
from docrevise.operators import revision as R
from docrevise.plans import fixtures as FX
from docrevise.plans import sqlparts as S
from docrevise.plans.queries import SIZE, OVERLAP, _JOBS, corpus_jobs
from docrevise.plans.registry import register, table

_CALLS = f"WITH calls AS ({FX.sql_call_log()})"


def calls(spark, sf):
    return FX.call_log_from_events(table(spark, sf, "events"))


def _labelled_chunks(spark, sf):
    jobs = corpus_jobs(spark, sf)
    ch = C.label_chunks(C.chunk_fixed(jobs, SIZE, OVERLAP))
    return ch.join(jobs.select("job_id", "instruction"), "job_id")


def _revised_chunks(spark, sf):
    ch = _labelled_chunks(spark, sf).withColumn("pairs", I.replacement_pairs_array(F.col("instruction")))
    return ch.withColumn("response", R.literal_revise("text", "pairs")).withColumn("error", F.lit(None).cast("string"))


_CHUNKS_SQL = f"""{_JOBS}, c0 AS {S.fixed_chunks(SIZE, OVERLAP)},
c AS (SELECT c0.*, CAST(chunk_no + 1 AS VARCHAR) || '/' || CAST(count(*) OVER (PARTITION BY c0.job_id) AS VARCHAR) AS label,
             j.instruction, {S.literal_revise('c0.ctext', S.pairs_list('j.instruction'))} AS response
      FROM c0 JOIN jobs j USING (job_id))"""


def _prompt_sql() -> str:
    p = S.lit(R.DEFAULT_TEMPLATE)
    for name, col in (("{label}", "label"), ("{instruction}", "instruction"), ("{chunk}", "ctext")):
        p = f"replace({p}, {S.lit(name)}, {col})"
    return p


@register("r1_build_prompts", f"""{_CHUNKS_SQL}
SELECT job_id, chunk_no, {_prompt_sql()} AS prompt FROM c""")
def r1_build_prompts(spark, sf):
    """One prompt per chunk (own wording; template is a parameter)."""
    p = R.build_prompts(_labelled_chunks(spark, sf))
    return p.select("job_id", F.col("chunk_no").cast("long"), "prompt")


def _echo_body(prompt: str) -> str:
    return json.dumps({"outputs": [{"text": prompt}]})


@register("r2_revise_chunks", f"""{_CHUNKS_SQL}
SELECT job_id, chunk_no, CAST(1 AS INT) AS calls, CAST(NULL AS VARCHAR) AS error_class,
       length(response) AS response_chars FROM c""")
def r2_revise_chunks(spark, sf):
    """R2: the model stage over every chunk with a deterministic reviser
    (literal replacement) standing in for the model; 5 calls at a time."""
    ch = _revised_chunks(spark, sf).withColumn("prompt", F.col("response"))
    out = R.revise_chunks(ch, _echo_body, concurrency=5)
    return out.select("job_id", "chunk_no", "calls", "error_class",
                      F.length(R.response_text(F.col("body"), "hosted")).cast("long").alias("response_chars"))


def _unsteady(prompt: str) -> str:
    # the prompt alone decides: by the first hex digit of its MD5, always
    # throttled, refused for its credentials, or answered
    digit = hashlib.md5(prompt.encode("utf-8")).hexdigest()[0]
    if digit in "0123":
        raise RuntimeError("ThrottlingException: Rate exceeded")
    if digit in "45":
        raise RuntimeError("UnrecognizedClientException: bad token")
    return json.dumps({"generation": prompt})


@register("r3_call_retries", f"""{_CHUNKS_SQL},
d AS (SELECT job_id, chunk_no, left(md5(job_id || '|' || CAST(chunk_no AS VARCHAR)), 1) AS digit FROM c)
SELECT job_id, chunk_no, CAST(CASE WHEN digit IN ('0', '1', '2', '3') THEN 3 ELSE 1 END AS INT) AS calls,
       CASE WHEN digit IN ('0', '1', '2', '3') THEN 'throttled' WHEN digit IN ('4', '5') THEN 'credentials' END
       AS error_class FROM d""")
def r3_call_retries(spark, sf):
    """Retries with backoff against a reviser that throttles some prompts,
    refuses some for their credentials (no retry) and answers the rest."""
    ch = _revised_chunks(spark, sf).withColumn("prompt", F.concat_ws("|", "job_id", F.col("chunk_no").cast("string")))
    out = R.revise_chunks(ch, _unsteady, concurrency=5, backoff=0.0)
    return out.select("job_id", "chunk_no", "calls", "error_class")


@register("r4_classify_errors", f"""{_CALLS}
SELECT job_id, chunk_no, error, {S.error_class('error')} AS error_class FROM calls""")
def r4_classify_errors(spark, sf):
    """Credentials / throttled / unavailable / other for every call."""
    return R.classify_errors(calls(spark, sf)).select("job_id", "chunk_no", "error", "error_class")


@register("r5_response_text", f"""{_CALLS}
SELECT job_id, chunk_no, {S.response_text('body', 'hosted')} AS hosted_text,
       {S.response_text('body', 'client')} AS client_text FROM calls WHERE body IS NOT NULL""")
def r5_response_text(spark, sf):
    """Generated text under both precedence rules."""
    c = calls(spark, sf).where(F.col("body").isNotNull())
    return c.select("job_id", "chunk_no", R.response_text(F.col("body"), "hosted").alias("hosted_text"),
                    R.response_text(F.col("body"), "client", F.col("family")).alias("client_text"))


def _accepted(spark, sf):
    c = calls(spark, sf).withColumn("response", R.response_text(F.col("body"), "hosted"))
    return R.change_flags(R.accept_responses(c))


_ACC_SQL = f"""{_CALLS}, r AS (SELECT *, {S.response_text('body', 'hosted')} AS response FROM calls),
a AS (SELECT *, coalesce(error IS NULL AND response IS NOT NULL AND length(response) >= 10, false) AS accepted FROM r),
b AS (SELECT *, CASE WHEN accepted THEN response ELSE text END AS revised FROM a)"""


@register("r6_accept_responses", f"""{_ACC_SQL}
SELECT job_id, chunk_no, accepted, revised FROM b""")
def r6_accept_responses(spark, sf):
    """Accept a response of at least 10 characters, else keep the original."""
    return _accepted(spark, sf).select("job_id", "chunk_no", "accepted", "revised")


@register("r7_change_flags", f"""{_ACC_SQL}
SELECT job_id, chunk_no, accepted AS changed, coalesce(lower(revised) <> lower(text), false) AS differs FROM b""")
def r7_change_flags(spark, sf):
    """The reference's change flag and a real text comparison."""
    return _accepted(spark, sf).select("job_id", "chunk_no", "changed", "differs")


@register("r8_change_summary", f"""{_ACC_SQL},
d AS (SELECT *, coalesce(lower(revised) <> lower(text), false) AS differs FROM b)
SELECT job_id, count(*) AS n_chunks, count(*) FILTER (WHERE accepted) AS n_accepted,
       count(*) FILTER (WHERE differs) AS n_differs, bool_or(accepted) AS any_changed,
       NOT bool_or(accepted) AS no_changes_warning FROM d GROUP BY job_id""")
def r8_change_summary(spark, sf):
    """Per-job change summary with the no-change warning."""
    return R.change_summary(_accepted(spark, sf))


@register("r9_reassemble", f"""{_CHUNKS_SQL}
SELECT job_id, string_agg(response, chr(10) || chr(10) ORDER BY chunk_no) AS text FROM c GROUP BY job_id""")
def r9_reassemble(spark, sf):
    """Revised chunks joined with a blank line in document order."""
    ch = _revised_chunks(spark, sf)
    return R.reassemble(ch, order="chunk", text_col="response")


@register("r10_literal_revise", f"""{_JOBS}
SELECT job_id, {S.literal_revise('text', S.pairs_list('instruction'))} AS text FROM jobs""")
def r10_literal_revise(spark, sf):
    """Whole documents revised by the instruction's replacement pairs."""
    jobs = corpus_jobs(spark, sf).withColumn("pairs", I.replacement_pairs_array(F.col("instruction")))
    return jobs.select("job_id", R.literal_revise("text", "pairs").alias("text"))


@register("r11_notice_page", f"""{_CALLS}, r AS (SELECT *, {S.response_text('body', 'client')} AS t FROM calls WHERE body IS NOT NULL)
SELECT job_id, chunk_no, CASE WHEN t IS NULL OR length({S.strip('t')}) < 10 THEN {S.lit(R.NOTICE_PAGE)} ELSE t END AS page FROM r""")
def r11_notice_page(spark, sf):
    """Notice page for empty or too short whole-document responses."""
    c = calls(spark, sf).where(F.col("body").isNotNull())
    t = R.response_text(F.col("body"), "client", F.col("family"))
    return c.select("job_id", "chunk_no", R.notice_page(t).alias("page"))
