"""End-to-end batch plan: requests x documents -> revised documents.

One lazy plan up to the model stage; the model stage (if a Python reviser is
given) is written under the shared checkpoint folder before it is read again,
so its calls happen once even if later stages are recomputed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.operators import chunks as C
from docrevise.operators import html as H
from docrevise.operators import instructions as I
from docrevise.operators import ranking as P
from docrevise.operators import revision as R
from docrevise.operators import targets as T


NO_DOCUMENT = "Processing failed: document not found"
TOO_LARGE = f"Processing failed: {K.REJECT_TOO_LARGE}"


def revise(jobs: DataFrame, fn: Callable[[str], str] | None = None, *, spark: SparkSession | None = None,
           size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, fields=None, verbs=None, markers=None,
           sep: str = "\n\n", chunker=None, use_html: bool = True, rank: bool = True, order: str = "chunk",
           top_k: int | None = None, concurrency: int = K.MAX_CONCURRENT_CALLS, template: str = R.DEFAULT_TEMPLATE,
           persist_name: str | None = None, send_budget: bool = False) -> dict[str, DataFrame]:
    """Revise every job (one instruction applied to one document).

    ``jobs`` comes from ``prepare_jobs`` / ``jobs_from_documents``.  With
    ``fn=None`` the deterministic literal reviser (R10, JVM-only) stands in
    for the model; with ``send_budget`` the model is called as
    ``fn(prompt, max_tokens)`` (C5).  Returns DataFrames: ``chunks`` (scored, ranked, revised),
    ``results`` (job_id, status, message, response, html, accepted_chunks,
    changed_chunks, ranks: (chunk_no, score, rank) per chunk; a credential
    error in any chunk fails the job with status 'error', and so does a missing
    or too large document) and ``summary``.  Jobs with a column ``html`` (the
    document's own layout page, H1-H3) give it to the small-document chunk and
    get their plain responses put into its body, head and markup outside it
    kept.
    """
    chunker = chunker or C.chunk_recursive
    missing = None
    if "found" in jobs.columns:
        large = F.col("too_large") if "too_large" in jobs.columns else F.lit(False)
        missing = jobs.where(~F.col("found") | large).select("job_id", F.when(large, TOO_LARGE).otherwise(NO_DOCUMENT).alias("reason"))
        jobs = jobs.where(F.col("found") & ~large)
    targets = T.target_sections(jobs, fields, verbs, sep)
    chunks = C.label_chunks(C.small_document_chunks(jobs, size, overlap, use_html=use_html, chunker=chunker))
    scored = P.score_chunks(jobs, chunks, targets, markers)
    ranked = P.rank_chunks(scored)
    if rank:
        ranked = P.apply_ranking_gate(ranked, size)
    else:
        ranked = ranked.withColumn("rank", F.col("chunk_no") + 1).withColumn("ranked", F.lit(False))
    # only the k best chunks go to the reviser; the others keep their text
    ranked = ranked.withColumn("chosen", F.col("rank") <= top_k if top_k else F.lit(True))
    work = ranked.join(jobs.select("job_id", "instruction"), "job_id")
    if fn is None:
        work = (work.withColumn("pairs", I.replacement_pairs_array(F.col("instruction")))
                .withColumn("response", F.when(F.col("chosen"), R.literal_revise("text", "pairs")))
                .withColumn("error", F.lit(None).cast("string"))
                .withColumn("error_class", F.lit(None).cast("string")).drop("pairs"))
    else:
        work = C.output_budget(work)
        prompts = R.build_prompts(work.where("chosen"), template)
        name = persist_name or f"calls-{uuid.uuid4().hex}"
        calls = R.revise_chunks(prompts, fn, concurrency, budget_col="max_tokens" if send_budget else None, ledger=f"{name}-ledger")
        # always written before reuse: several outputs read the calls
        calls = R.persist_calls(calls, spark or jobs.sparkSession, name)
        calls = calls.select("job_id", "chunk_no", R.response_text(F.col("body"), "hosted").alias("response"), "error",
                             "error_class")
        work = work.withColumn("chunk_no", F.col("chunk_no").cast("long")).join(calls, ["job_id", "chunk_no"], "left")
    revised = R.change_flags(R.accept_responses(work))
    # one aggregate per job: text, counts, ranks, and credential failures,
    # which fail the whole job (other errors keep the original chunk)
    credentials = F.col("error_class") == "credentials"
    per_job = revised.groupBy("job_id").agg(
        R.joined_text(order, "revised").alias("response"), *R.summary_columns(),
        F.sort_array(F.collect_list(F.struct("chunk_no", "score", "rank"))).alias("ranks"),
        F.max_by("error", credentials.cast("int")).alias("cred_error"),
        F.bool_or(F.coalesce(credentials, F.lit(False))).alias("cred_failed"))
    summary = per_job.drop("response", "ranks", "cred_error", "cred_failed").withColumn("no_changes_warning", ~F.col("any_changed"))
    original = F.coalesce(F.col("html"), C.text_page(F.col("text"))) if "html" in jobs.columns else C.text_page(F.col("text"))
    page = jobs.select("job_id", original.alias("original_html"), "text", *([F.col("html").alias("layout")] if "html" in jobs.columns else []))
    res = per_job.join(page, "job_id").withColumn("cleaned", H.clean_response(F.col("response")))
    html = (F.when(H.is_html_response(F.col("cleaned")), H.wrap_html(F.col("cleaned")))
            .when(H.guard_short(F.col("cleaned"), F.col("text")), F.col("original_html")))
    # a plain response replaces the body of the document's own page, or of our frame
    rebuilt = H.rebuilt_page(F.col("cleaned"), F.col("layout") if "html" in jobs.columns else None)
    res = (res.withColumn("html", F.coalesce(html, rebuilt, F.col("original_html")))
           .select("job_id", F.when(F.col("cred_failed"), "error").otherwise("completed").alias("status"),
                   F.when(F.col("cred_failed"), F.concat(F.lit("Processing failed: "), F.col("cred_error")))
                   .alias("message"),
                   F.when(~F.col("cred_failed"), F.col("response")).alias("response"),
                   F.when(~F.col("cred_failed"), F.col("html")).alias("html"),
                   F.col("n_accepted").alias("accepted_chunks"), F.col("n_differs").alias("changed_chunks"), "ranks"))
    if missing is not None:  # no chunk, no call: these jobs end at once
        nothing = F.lit(None).cast("string")
        res = res.unionByName(missing.select(
            "job_id", F.lit("error").alias("status"), F.col("reason").alias("message"), nothing.alias("response"),
            nothing.alias("html"), F.lit(0).cast("long").alias("accepted_chunks"),
            F.lit(0).cast("long").alias("changed_chunks")), allowMissingColumns=True)
    return {"chunks": revised, "results": res, "summary": summary, "job_log": job_log(res)}


def job_log(results: DataFrame, ts=None) -> DataFrame:
    """Append-only job-log rows for finished jobs: the progress marks of a
    run (queued 0, started 10, extracted 30, revising 40, revised 70,
    rendered 85) then completed 100, or error 100 with the message.  A failed
    job has only the marks it reached: up to revising, or up to started where
    its document is missing."""
    ts = ts if ts is not None else F.current_timestamp()
    marks = [("queued", K.PROGRESS_QUEUED, "Job queued for processing"),
             ("processing", K.PROGRESS_STARTED, "Processing started"),
             ("processing", K.PROGRESS_EXTRACTED, "Text extracted"),
             ("processing", K.PROGRESS_REVISING, "Revising chunks"),
             ("processing", K.PROGRESS_REVISED, "Revision complete"),
             ("processing", K.PROGRESS_RENDERED, "Page rendered")]
    steps = F.array(*[F.struct(F.lit(a).alias("status"), F.lit(b).alias("progress"), F.lit(c).alias("message"))
                      for a, b, c in marks])
    reached = (F.when(F.col("message").isin(NO_DOCUMENT, TOO_LARGE), 2).when(F.col("status") == "error", 4)
               .otherwise(len(marks)))
    steps = F.slice(steps, F.lit(1), reached)
    last = F.struct(F.col("status"), F.lit(K.PROGRESS_DONE).alias("progress"),
                    F.coalesce(F.col("message"), F.lit("Processing complete")).alias("message"))
    x = results.select("job_id", F.posexplode(F.concat(steps, F.array(last))).alias("seq", "e"))
    return x.select("job_id", F.col("seq").cast("long").alias("seq"), ts.alias("ts"), "e.status", "e.progress", "e.message")
