"""Registered intake / source / sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.plans import fixtures as FX
from docrevise.plans import sqlparts as S
from docrevise.plans.registry import register, table
from docrevise.sources import intake as IN


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def _names(doc_id):
    d = doc_id.cast("string")
    k = F.pmod(doc_id, F.lit(4))
    return (F.when(k == 0, F.concat(F.lit("doc_"), d, F.lit(".txt")))
            .when(k == 1, F.concat(F.lit("report.v"), d, F.lit(".PDF")))
            .when(k == 2, F.concat(F.lit("notes_"), d))
            .otherwise(F.concat(F.lit(".doc_"), d)))


_NAMES_SQL = ("CASE doc_id % 4 WHEN 0 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' "
              "WHEN 1 THEN 'report.v' || CAST(doc_id AS VARCHAR) || '.PDF' "
              "WHEN 2 THEN 'notes_' || CAST(doc_id AS VARCHAR) ELSE '.doc_' || CAST(doc_id AS VARCHAR) END")
_DOCS_SQL = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@register("s1_read_documents", f"""SELECT doc_id, octet_length(encode(text)) AS length, length(text) AS n_chars,
starts_with(text, '%PDF') AS pdf_magic FROM {_DOCS_SQL}""")
def s1_read_documents(spark, sf):
    """Every document's bytes decoded with replacement characters.
    (``read_documents`` does the same from a folder of files.)"""
    d = _docs(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("length"),
                                F.col("text").cast("binary").alias("content"))
    return IN.decode_documents(d).select("doc_id", "length", F.length("text").cast("long").alias("n_chars"), "pdf_magic")


@register("s2_route_documents", f"""SELECT doc_id, {_NAMES_SQL} AS name,
CASE WHEN ends_with(lower({_NAMES_SQL}), '.pdf') OR starts_with(text, '%PDF') THEN 'pdf' ELSE 'text' END AS kind
FROM {_DOCS_SQL}""")
def s2_route_documents(spark, sf):
    """Route by file name (.pdf, any case) or %PDF content prefix."""
    d = _docs(spark, sf).withColumn("name", _names(F.col("doc_id")))
    return IN.route_documents(d).select("doc_id", "name", "kind")


_PAGES_SQL = f"""(WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {_DOCS_SQL}),
  b AS (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM a)
  SELECT doc_id, (i - 1) // 40 AS page_no, string_agg(l[i], chr(10) ORDER BY i) AS text FROM b GROUP BY ALL)"""


def _pages_text(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("li", "line"))
    d = d.withColumn("page_no", F.floor(F.col("li") / 40).cast("int"))
    g = d.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("li", "line"))).alias("a"))
    return g.select("doc_id", "page_no", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


@register("s3_join_pages", f"""SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text
FROM {_PAGES_SQL} GROUP BY doc_id""")
def s3_join_pages(spark, sf):
    """S3: page texts (40 lines a page) joined with a blank line in page order."""
    return IN.join_pages(_pages_text(spark, sf))


@register("s4_text_to_html", f"SELECT doc_id, {S.text_page('text')} AS html FROM {_DOCS_SQL}")
def s4_text_to_html(spark, sf):
    """Every document as an escaped <pre> page."""
    return _docs(spark, sf).select("doc_id", IN.text_to_html(F.col("text")).alias("html"))


def _raw_requests(spark, sf):
    d = _docs(spark, sf)
    return d.select(F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"),
                    (F.pmod(F.col("doc_id"), F.lit(19)) != 0).alias("has_file"),
                    F.when(F.pmod(F.col("doc_id"), F.lit(13)) == 0, F.lit("")).otherwise(_names(F.col("doc_id"))).alias("file_name"),
                    F.when(F.pmod(F.col("doc_id"), F.lit(17)) == 0, F.lit(""))
                    .otherwise(FX.instruction_col(F.col("doc_id"), F.col("text"))).alias("instruction"),
                    (F.octet_length("text") * 4000).cast("long").alias("size_bytes"))


@register("s5_validate_requests", f"""WITH r AS (
  SELECT 'job-' || CAST(doc_id AS VARCHAR) AS job_id, doc_id % 19 <> 0 AS has_file,
         CASE WHEN doc_id % 13 = 0 THEN '' ELSE {_NAMES_SQL} END AS file_name,
         CASE WHEN doc_id % 17 = 0 THEN '' ELSE {FX.sql_instruction()} END AS instruction,
         CAST(octet_length(encode(text)) * 4000 AS BIGINT) AS size_bytes FROM {_DOCS_SQL})
SELECT job_id, CASE WHEN NOT has_file THEN 'No file part' WHEN file_name = '' THEN 'No file selected'
                    WHEN instruction = '' THEN 'No instruction provided'
                    WHEN size_bytes > {100 * 1024 * 1024} THEN 'File too large' END AS reason FROM r""")
def s5_validate_requests(spark, sf):
    """Request checks in the reference's order, with the reject reason."""
    return IN.validate_requests(_raw_requests(spark, sf)).select("job_id", "reason")


_INLINE_SQL = f"""(SELECT 'job-' || CAST(doc_id AS VARCHAR) AS job_id,
  CASE WHEN doc_id % 17 <> 0 THEN {FX.sql_instruction()} END AS instruction, text AS document_content FROM documents)"""


@register("s5b_validate_inline", f"""SELECT job_id, CASE WHEN instruction IS NULL OR document_content IS NULL
  THEN '{K.REJECT_NO_INLINE}' END AS reason FROM {_INLINE_SQL}""")
def s5b_validate_inline(spark, sf):
    """S5 for inline submissions: instruction and document must be present
    (every 17th request is given no instruction, texts as they are)."""
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"),
        F.when(F.pmod(F.col("doc_id"), F.lit(17)) != 0, FX.instruction_col(F.col("doc_id"), F.col("text")))
        .alias("instruction"), F.col("text").alias("document_content"))
    return IN.validate_inline(d).select("job_id", "reason")


@register("s6_requests_from_text", f"""WITH r AS (
  SELECT 'job-' || CAST(doc_id AS VARCHAR) AS job_id,
         CASE WHEN doc_id % 7 = 0 THEN '%PDF-1.4 ' || text ELSE text END AS c FROM {_DOCS_SQL})
SELECT job_id, 'temp_doc_' || job_id || CASE WHEN starts_with(c, '%PDF') THEN '.pdf' ELSE '.txt' END AS file_name,
       CASE WHEN starts_with(c, '%PDF') THEN 'pdf' ELSE 'text' END AS kind FROM r""")
def s6_requests_from_text(spark, sf):
    """Inline text submissions as requests (kind from the content prefix)."""
    d = _docs(spark, sf).select(
        F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), F.lit("x").alias("instruction"),
        F.when(F.pmod(F.col("doc_id"), F.lit(7)) == 0, F.concat(F.lit("%PDF-1.4 "), F.col("text")))
        .otherwise(F.col("text")).alias("document_content"))
    return IN.requests_from_text(d).select("job_id", "file_name", "kind")


def _sql_job_id() -> str:
    h = f"sha256(CAST(doc_id AS VARCHAR) || chr(1) || ({FX.sql_instruction()}))"
    return (f"substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' || "
            f"substring({h}, 17, 4) || '-' || substring({h}, 21, 12)")


@register("s7_enqueue", f"""SELECT {_sql_job_id()} AS job_id, CAST(0 AS BIGINT) AS seq, TIMESTAMP '{FX.NOW}' AS ts,
'queued' AS status, 0 AS progress, 'Job queued for processing' AS message FROM {_DOCS_SQL}""")
def s7_enqueue(spark, sf):
    """Deterministic job ids and the 'queued' log row of every request."""
    d = _docs(spark, sf)
    req = d.select(IN.job_ids(F.col("doc_id"), FX.instruction_col(F.col("doc_id"), F.col("text"))).alias("job_id"))
    q = IN.enqueue(req, FX.now_col())
    return q.select("job_id", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "progress", "message")


@register("s8_output_names", f"""SELECT 'job-' || CAST(doc_id AS VARCHAR) AS job_id,
  CASE WHEN regexp_replace({_NAMES_SQL}, '\\.[^./]*$', '') = '' THEN {_NAMES_SQL}
       ELSE regexp_replace({_NAMES_SQL}, '\\.[^./]*$', '') END
  || '_' || strftime(TIMESTAMP '{FX.NOW}' + to_seconds(doc_id), '%Y%m%d_%H%M%S') || '_'
  || substring(sha256('job-' || CAST(doc_id AS VARCHAR)), 1, 8) || '.pdf' AS out_name FROM {_DOCS_SQL}""")
def s8_output_names(spark, sf):
    """Unique output names {stem}_{time}_{8 hex}.pdf."""
    d = _docs(spark, sf).select("doc_id", F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"))
    ts = FX.now_col() + F.make_dt_interval(secs=F.col("doc_id").cast("double"))
    return d.select("job_id", IN.output_name(_names(F.col("doc_id")), ts, F.col("job_id")).alias("out_name"))


@register("s9_encode_results", f"SELECT doc_id, to_base64(encode({S.text_page('text')})) AS html_base64 FROM {_DOCS_SQL}")
def s9_encode_results(spark, sf):
    """Results with the base64 rendering, ready to be written."""
    d = _docs(spark, sf).select("doc_id", IN.text_to_html(F.col("text")).alias("html"))
    return IN.encode_results(d).select("doc_id", "html_base64")
