"""Chunk revision: R1-R11.

Everything except the model call itself is built-in expressions.  The model
call (R2) is a Python stage: ``mapInArrow`` over job-partitioned prompts,
at most ``concurrency`` calls per job at a time, retries (R3) inside the task.  Its
output should be written before anything reads it twice
(``persist_calls``), so that recomputation or a lost executor never repeats
model calls; until that write has ended, a ledger of finished calls keeps a
retried task from repeating them.  Results are keyed by (job_id, chunk_no).
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import py_strip

# Our own prompt wording.  Placeholders: {label} {instruction} {chunk}.
DEFAULT_TEMPLATE = (
    "[INST] You edit documents exactly as instructed and change nothing else. "
    "Apply every part of the instruction that concerns this part of the document, keep its "
    "formatting and markup, and return the whole part.\n\n"
    "Part {label} of the document:\n\"{chunk}\"\n\n"
    "Instruction: {instruction}\n"
    "Return the full revised part. [/INST]"
)

NOTICE_PAGE = (
    "<!DOCTYPE html>\n<html>\n<body>\n<h1>No usable revision</h1>\n"
    "<p>The reviser returned no usable text for this document.</p>\n</body>\n</html>"
)


# ---------------------------------------------------------------- R1 prompts
def build_prompts(chunks: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``prompt`` from the template; ``chunks`` needs text, label, instruction."""
    # the template is cut once, so values that look like placeholders stay text
    values = {"{label}": F.col("label"), "{instruction}": F.col("instruction"), "{chunk}": F.col("text")}
    parts = [values.get(x, F.lit(x)) for x in re.split(r"(\{label\}|\{instruction\}|\{chunk\})", template) if x]
    return chunks.withColumn("prompt", F.concat(*parts) if parts else F.lit(""))


# ---------------------------------------------------------------- R4 error classes
def error_class(err: Column) -> Column:
    """Credentials / throttled / unavailable / other (null when no error)."""
    def any_of(words):
        c = F.lit(False)
        for w in words:
            c = c | F.call_function("contains", err, F.lit(w))
        return c
    cred = any_of(K.CREDENTIAL_ERRORS) | F.call_function("contains", F.lower(err), F.lit(K.CREDENTIAL_PHRASE_LOWER))
    return (F.when(err.isNull(), F.lit(None).cast("string"))
            .when(cred, "credentials").when(any_of(K.THROTTLE_ERRORS), "throttled")
            .when(any_of(K.UNAVAILABLE_ERRORS), "unavailable").otherwise("other"))


def classify_errors(call_log: DataFrame) -> DataFrame:
    return call_log.withColumn("error_class", error_class(F.col("error")))


def _py_error_class(err: str | None) -> str | None:
    if err is None:
        return None
    if any(w in err for w in K.CREDENTIAL_ERRORS) or K.CREDENTIAL_PHRASE_LOWER in err.lower():
        return "credentials"
    if any(w in err for w in K.THROTTLE_ERRORS):
        return "throttled"
    if any(w in err for w in K.UNAVAILABLE_ERRORS):
        return "unavailable"
    return "other"


# ---------------------------------------------------------------- R2/R3 model stage
def call_with_retry(fn: Callable[[str], str], prompt: str, attempts: int = K.CALL_ATTEMPTS,
                    backoff: float = K.FIRST_BACKOFF_SEC, sleep=time.sleep) -> tuple[str | None, str | None, int]:
    """Up to ``attempts`` calls, waiting backoff, 2*backoff, ... after each
    failure (also after the last); credential errors stop at once.
    Returns (body, error, calls)."""
    wait, err = backoff, None
    for i in range(attempts):
        try:
            return fn(prompt), None, i + 1
        except Exception as e:  # the error text decides what happens next
            err = f"{type(e).__name__}: {e}"
            if _py_error_class(err) == "credentials":
                return None, err, i + 1
            sleep(wait)
            wait *= 2
    return None, err, attempts


class _Ledger:
    """Finished calls of one bucket of jobs: one JSON line per call, written
    and flushed as the call ends, one file per task attempt.  Lines of earlier
    attempts are read first; a line cut off by a lost executor is ignored."""

    def __init__(self, url: str, bucket: int):
        from docrevise.session import file_store
        store, root = file_store(url)
        folder = f"{root}/bucket={bucket}"
        store.create_dir(folder, recursive=True)
        self.known: dict[tuple, tuple] = {}
        for info in store.get_file_info(fs.FileSelector(folder)):
            with store.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n"):
                    try:
                        job, chunk, *result = json.loads(line)
                    except ValueError:
                        continue
                    self.known[job, chunk] = tuple(result)
        self.path, self.store, self.file, self.lock = f"{folder}/{uuid.uuid4().hex}.jsonl", store, None, threading.Lock()

    def put(self, job, chunk, result: tuple) -> None:
        with self.lock:
            self.file = self.file or self.store.open_output_stream(self.path)
            self.file.write(json.dumps([job, chunk, *result]).encode() + b"\n")
            self.file.flush()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def revise_chunks(prompts: DataFrame, fn: Callable[..., str], concurrency: int = K.MAX_CONCURRENT_CALLS,
                  attempts: int = K.CALL_ATTEMPTS, backoff: float = K.FIRST_BACKOFF_SEC,
                  partitions: int | None = None, jobs_at_once: int = 4, budget_col: str | None = None,
                  ledger: str | None = None, buckets: int = 256, at_once: int = 256) -> DataFrame:
    """R2: call ``fn(prompt) -> body`` once per (job_id, chunk_no); with
    ``budget_col``, ``fn(prompt, max_tokens)`` with that column's value (C5).

    As in the reference, at most ``concurrency`` calls of one job run at the
    same time (a thread pool per job; the calls are I/O bound).  Up to
    ``jobs_at_once`` jobs of a task run side by side, so jobs of one chunk do
    not wait for each other, and different tasks run in parallel.  Only the
    key, the prompt and the budget cross into Python.  Returns job_id,
    chunk_no, body, error, error_class, calls.

    With ``ledger`` (a folder that all executors share) every call that ends
    without an error is recorded there as it ends; a retried task, or a new run
    with the same folder, takes recorded calls from it and makes only the
    missing ones.  Jobs are filed by a hash of their id in ``buckets`` folders,
    so a task reads only those of its own jobs.  Calls that were under way when
    an executor was lost are made again; failed calls are too.
    """
    from concurrent.futures import ThreadPoolExecutor

    budget = F.col(budget_col).cast("int") if budget_col else F.lit(None).cast("int")
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    keyed = prompts.select(bucket.alias("bucket"), "job_id", F.col("chunk_no").cast("long").alias("chunk_no"), "prompt", budget.alias("budget"))
    if ledger:
        from docrevise.session import checkpoint_path, qualified
        spark = prompts.sparkSession
        ledger = qualified(spark, ledger if ledger.startswith("/") or ":/" in ledger else checkpoint_path(spark, ledger))
    keyed = keyed.repartition(partitions, "job_id") if partitions else keyed.repartition("job_id")
    keyed = keyed.sortWithinPartitions("bucket", "job_id", "chunk_no")

    def run(batches):
        books: dict[int, _Ledger] = {}

        def call(job, chunk, prompt, limit, book):
            if book is not None and (job, chunk) in book.known:
                return book.known[job, chunk]
            f = fn if budget_col is None else (lambda p: fn(p, int(limit)))
            out = call_with_retry(f, prompt, attempts, backoff)
            if book is not None and out[1] is None:
                book.put(job, chunk, out)
            return out

        def one_job(rows):
            book = books.get(rows[0][0])
            with ThreadPoolExecutor(max_workers=max(concurrency, 1)) as pool:
                return list(pool.map(lambda r: call(*r[1:], book), rows))

        try:
            with ThreadPoolExecutor(max_workers=max(jobs_at_once, 1)) as outer:
                # as plain values, ``at_once`` rows exist at a time, however many a batch has
                for part in (b.slice(k, at_once) for b in batches for k in range(0, b.num_rows, at_once)):
                    rows = list(zip(*[c.to_pylist() for c in part.columns]))
                    if ledger:
                        now = {r[0] for r in rows}
                        for k in [k for k in books if k not in now]:
                            books.pop(k).close()
                        books.update({k: _Ledger(ledger, k) for k in now if k not in books})
                    # rows are sorted by job: the jobs' results in order are the rows' results
                    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
                    out = [r for res in outer.map(one_job, groups) for r in res]
                    body, error, calls = zip(*out)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array(body, pa.string()),
                        pa.array(error, pa.string()), pa.array(map(_py_error_class, error), pa.string()), pa.array(calls, pa.int32())],
                        ["job_id", "chunk_no", "body", "error", "error_class", "calls"])
        finally:
            for book in books.values():
                book.close()

    schema = "job_id string, chunk_no long, body string, error string, error_class string, calls int"
    return keyed.mapInArrow(run, schema)


def persist_calls(df: DataFrame, spark: SparkSession, name: str, reuse: bool = True) -> DataFrame:
    """Write model-call results below the shared checkpoint folder and read
    them back, so later stages (and retried tasks) never call again.  With
    ``reuse`` a complete earlier write of the same name (a replayed
    micro-batch, a restarted job) is read instead of calling again."""
    from docrevise.session import checkpoint_path, path_complete
    # an absolute path or URI is used as is; a plain name goes below spark.checkpoint.dir
    path = name if (name.startswith("/") or "://" in name) else checkpoint_path(spark, name)
    if not (reuse and path_complete(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- R5 response text
def _has_key(body: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(body), F.lit(key)), F.lit(False))


def response_text(body: Column, rule: str = "hosted", family: Column | None = None) -> Column:
    """The generated text inside a JSON response body.

    ``hosted``: ``outputs[0].text`` when ``outputs`` is a non-empty list,
    else ``generation`` when present, else ''.
    ``client``: ``content[0].text`` for the message family (``family`` true),
    else generation, outputs[0].text, text, else the whole body.
    """
    outputs_n = F.coalesce(F.json_array_length(F.get_json_object(body, "$.outputs")), F.lit(0))
    out0 = F.coalesce(F.get_json_object(body, "$.outputs[0].text"), F.lit(""))
    gen = F.coalesce(F.get_json_object(body, "$.generation"), F.lit(""))
    if rule == "hosted":
        return (F.when(_has_key(body, "outputs") & (outputs_n > 0), out0)
                .when(_has_key(body, "generation"), gen).otherwise(F.lit("")))
    fam = family if family is not None else F.lit(False)
    return (F.when(fam, F.coalesce(F.get_json_object(body, "$.content[0].text"), F.lit("")))
            .when(_has_key(body, "generation"), gen)
            .when(_has_key(body, "outputs"), out0)
            .when(_has_key(body, "text"), F.coalesce(F.get_json_object(body, "$.text"), F.lit("")))
            .otherwise(body))


# ---------------------------------------------------------------- R6/R7 accept and flag
def accept_responses(df: DataFrame, min_chars: int = K.MIN_RESPONSE_CHARS) -> DataFrame:
    """``revised`` = response when there is no error and it has at least
    ``min_chars`` characters, else the original ``text``; ``accepted`` flag."""
    ok = F.col("error").isNull() & F.col("response").isNotNull() & (F.length("response") >= min_chars)
    return (df.withColumn("accepted", F.coalesce(ok, F.lit(False)))
            .withColumn("revised", F.when(F.col("accepted"), F.col("response")).otherwise(F.col("text"))))


def change_flags(df: DataFrame) -> DataFrame:
    """``changed`` (the reference's notion: accepted) and ``differs``
    (case-insensitive comparison with the original)."""
    return (df.withColumn("changed", F.col("accepted"))
            .withColumn("differs", F.coalesce(F.lower("revised") != F.lower("text"), F.lit(False))))


# ---------------------------------------------------------------- R8 summary
def summary_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("accepted")).alias("n_accepted"),
            F.count_if(F.col("differs")).alias("n_differs"), F.bool_or(F.col("accepted")).alias("any_changed")]


def change_summary(results: DataFrame) -> DataFrame:
    """Per job: chunks, accepted, differing, and the no-change warning."""
    return results.groupBy("job_id").agg(*summary_columns()).withColumn("no_changes_warning", ~F.col("any_changed"))


# ---------------------------------------------------------------- R9 reassemble
def joined_text(order: str = "chunk", text_col: str = "revised", sep: str = "\n\n") -> Column:
    """Aggregate: chunk texts joined in document or rank order."""
    key = F.col("rank") if order == "rank" else F.col("chunk_no")
    pieces = F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col(text_col).alias("t"))))
    return F.array_join(F.transform(pieces, lambda x: x["t"]), sep)


def reassemble(results: DataFrame, order: str = "chunk", sep: str = "\n\n", text_col: str = "revised",
               trim_overlap: bool = False) -> DataFrame:
    """One text per job, chunks joined with ``sep`` in document order
    (``order='chunk'``) or in rank order (``order='rank'``, the reference).

    ``trim_overlap`` (document order, unrevised text with offsets) drops the
    part of each chunk already covered by the previous one, giving back the
    original text when chunks cover it."""
    if trim_overlap:
        prev_end = F.lag("end").over(Window.partitionBy("job_id").orderBy("chunk_no"))
        skip = F.greatest(F.coalesce(prev_end, F.col("start")) - F.col("start"), F.lit(0))
        results = results.withColumn("_piece", F.call_function("substring", F.col(text_col), skip + 1))
        text_col, sep = "_piece", ""
    return results.groupBy("job_id").agg(joined_text(order, text_col, sep).alias("text"))


# ---------------------------------------------------------------- R10 literal reviser
def literal_revise(text_col: str = "text", pairs_col: str = "pairs") -> Column:
    """Replace every ``old`` by ``new`` in order (deterministic reviser)."""
    return F.aggregate(F.col(pairs_col), F.col(text_col), lambda t, p: F.replace(t, p["old"], p["new"]))


# ---------------------------------------------------------------- R11 notice page
def notice_page(response: Column, min_chars: int = K.MIN_RESPONSE_CHARS, page: str = NOTICE_PAGE) -> Column:
    """A notice page instead of an empty or too short whole-document response."""
    short = response.isNull() | (F.length(py_strip(response)) < min_chars)
    return F.when(short, F.lit(page)).otherwise(response)
