"""Sources, intake checks and sinks: S1-S9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import html_escape


# ---------------------------------------------------------------- S1 read documents
def read_documents(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, modified, length, text) for every file below ``path``;
    undecodable bytes become U+FFFD (like ``errors='replace'``)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    return decode_documents(df.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
                                      F.col("modificationTime").alias("modified"), "length", "content"))


def decode_documents(df: DataFrame) -> DataFrame:
    """S1 on a table of binary ``content``: adds ``text`` and ``pdf_magic``,
    drops the bytes.  Null content stays null."""
    return (df.withColumn("text", F.call_function("make_valid_utf8", F.col("content").cast("string")))
            .withColumn("pdf_magic", F.startswith(F.col("content"), F.lit(b"%PDF"))).drop("content"))


# ---------------------------------------------------------------- S2 route
def route_documents(df: DataFrame, name_col: str = "name", content_col: str = "text") -> DataFrame:
    """``kind`` = 'pdf' when the name ends with .pdf (any case) or the
    content starts with %PDF, else 'text'."""
    pdf = F.endswith(F.lower(F.col(name_col)), F.lit(".pdf")) | F.startswith(F.col(content_col), F.lit("%PDF"))
    return df.withColumn("kind", F.when(F.coalesce(pdf, F.lit(False)), "pdf").otherwise("text"))


# ---------------------------------------------------------------- S3 join pages
def join_pages(pages: DataFrame, sep: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """S3: one text per document, pages joined with ``sep`` in page order."""
    g = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return g.select(key, F.array_join(F.transform("p", lambda x: x["text"]), sep).alias("text"))


# ---------------------------------------------------------------- S4 text page
def text_to_html(text: Column) -> Column:
    """Plain text as an escaped ``<pre>`` page."""
    return F.concat(F.lit("<!DOCTYPE html><html><body><pre>"), html_escape(text), F.lit("</pre></body></html>"))


# ---------------------------------------------------------------- S5 validate
def validate_requests(req: DataFrame, limit_bytes: int = K.UPLOAD_LIMIT_BYTES) -> DataFrame:
    """``reason`` is null for an accepted request, else the first failed
    check: no file part, no file selected, no instruction, file too large."""
    reason = (F.when(~F.coalesce(F.col("has_file"), F.lit(False)), K.REJECT_NO_PART)
              .when(F.coalesce(F.col("file_name"), F.lit("")) == "", K.REJECT_NO_FILE)
              .when(F.coalesce(F.col("instruction"), F.lit("")) == "", K.REJECT_NO_INSTRUCTION)
              .when(F.col("size_bytes") > limit_bytes, K.REJECT_TOO_LARGE))
    return req.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def validate_inline(req: DataFrame) -> DataFrame:
    """S5 for inline submissions (instruction, document_content): both must
    be given; an empty string counts as given."""
    given = F.col("instruction").isNotNull() & F.col("document_content").isNotNull()
    return (req.withColumn("reason", F.when(~given, K.REJECT_NO_INLINE))
            .withColumn("accepted", given))


def split_valid(req: DataFrame, limit_bytes: int = K.UPLOAD_LIMIT_BYTES) -> tuple[DataFrame, DataFrame]:
    v = validate_requests(req, limit_bytes)
    return v.where("accepted").drop("reason"), v.where(~F.col("accepted"))


# ---------------------------------------------------------------- S6 inline text
def requests_from_text(df: DataFrame) -> DataFrame:
    """Inline documents as requests: extension from the content prefix
    and a temporary file name per job."""
    ext = F.when(F.startswith(F.col("document_content"), F.lit("%PDF")), ".pdf").otherwise(".txt")
    return df.select("job_id", "instruction", "document_content",
                     F.concat(F.lit("temp_doc_"), F.col("job_id"), ext).alias("file_name"),
                     F.when(ext == ".pdf", "pdf").otherwise("text").alias("kind"))


# ---------------------------------------------------------------- S7 enqueue
def job_ids(*cols: Column) -> Column:
    """Deterministic job id (uuid layout) from the request's content."""
    h = F.sha2(F.concat_ws("\u0001", *[c.cast("string") for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def enqueue(req: DataFrame, now: Column) -> DataFrame:
    """The 'queued' job-log row of each request (seq 0, progress 0)."""
    return req.select("job_id", F.lit(0).cast("long").alias("seq"), now.alias("ts"), F.lit("queued").alias("status"),
                      F.lit(K.PROGRESS_QUEUED).alias("progress"),
                      F.lit("Job queued for processing").alias("message"))


# ---------------------------------------------------------------- S8 output names
def output_name(name: Column, ts: Column, job_id: Column) -> Column:
    """``{stem}_{yyyyMMdd_HHmmss}_{8 hex}.pdf``; the hex part comes from
    the job id so names are reproducible."""
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    stem = F.when((stem == "") | F.endswith(stem, F.lit("/")), name).otherwise(stem)
    return F.concat(stem, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"),
                    F.substring(F.sha2(job_id, 256), 1, 8), F.lit(".pdf"))


# ---------------------------------------------------------------- S9 results
def encode_results(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add the base64 rendering (no line breaks)."""
    b = F.regexp_replace(F.base64(F.encode(F.col(html_col), "UTF-8")), r"[\r\n]", "")
    return df.withColumn("html_base64", b)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Write results keyed by job id (a replay overwrites, never appends)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
