"""Requests used by the registered queries.

The driver tables have no request table, so requests are derived from the
documents themselves: one job per document, ``job_id = 'job-' || doc_id``.
Two kinds:

* ``single_instruction_jobs`` - the same literal instruction for every document;
* ``corpus_requests`` - one of the instruction templates below per document
  (template ``doc_id mod 7``), with ``{a}`` filled by a phrase taken from the
  document (the first two words of its second line) so that quoted spans and
  entities really occur in the text.

Both are plain projections of ``documents`` (no join), so their work grows
with the corpus, and DuckDB can build the same rows for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The flagship instruction (a license line that occurs in the corpus).
FLAGSHIP_INSTRUCTION = "Change 'MIT License' to 'Apache License'"

# Instruction templates for corpus-derived requests.  {a} is the
# phrase from the document.  (No upper-cased slot: Java upper-cases "ß" to
# "SS" like Python, DuckDB to "ẞ", so the oracle could not rebuild it.)
TEMPLATES = [
    "Change 'MIT License' to 'Apache License'",
    "Change '{a}' to 'revised text'",
    '1. Replace "{a}" with "the thing"\n2. Update the state of the license - remove the notice',
    "Change the {a} Inc name from 'Old Name' to 'New Name LLC'",
    "Update Vendor Name to '{a}'",
    "Set the payment terms for the client - modify the agreement and the state",
    "Delete {a}",
]

# Corpus words used as fields and markers (the contract words
# barely occur in the driver corpus).
CORPUS_FIELDS = ["the", "thing", "state"]
CORPUS_MARKERS = ["license", "thtion", "nicht"]

# Chunk size and overlap used by the registered queries.
QUERY_CHUNK_SIZE = 2000
QUERY_CHUNK_OVERLAP = 400
QUERY_SEPARATOR = "\n"


def phrase_col(text: Column) -> Column:
    """First two space-separated words of the second line ('' if none)."""
    line2 = F.coalesce(F.try_element_at(F.split(text, "\n", -1), F.lit(2)), F.lit(""))
    return F.array_join(F.slice(F.split(line2, " ", -1), 1, 2), " ")


def instruction_col(doc_id: Column, text: Column) -> Column:
    return fill_templates(doc_id, phrase_col(text))


def fill_templates(doc_id: Column, a: Column) -> Column:
    slot = F.pmod(doc_id, F.lit(len(TEMPLATES)))
    out = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        filled = F.replace(F.lit(t), F.lit("{a}"), a)
        out = F.when(slot == i, filled).otherwise(out)
    return out


def corpus_requests(docs: DataFrame) -> DataFrame:
    """(job_id, doc_id, instruction) - one templated request per document."""
    withp = docs.select("doc_id", phrase_col(F.col("text")).alias("_phrase"))
    return withp.select(F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"),
                        "doc_id", fill_templates(F.col("doc_id"), F.col("_phrase")).alias("instruction"))


# DuckDB versions of the same derivations, used inside oracle SQL.
def sql_phrase(text: str = "text") -> str:
    line2 = f"coalesce(string_split({text}, chr(10))[2], '')"
    return f"array_to_string(string_split({line2}, ' ')[1:2], ' ')"


def sql_instruction(doc_id: str = "doc_id", text: str = "text") -> str:
    a = sql_phrase(text)
    parts = []
    for i, t in enumerate(TEMPLATES):
        lit = "'" + t.replace("'", "''") + "'"
        lit = lit.replace("\n", "' || chr(10) || '")
        parts.append(f"WHEN {i} THEN replace({lit}, '{{a}}', {a})")
    return f"CASE ({doc_id} % {len(TEMPLATES)}) " + " ".join(parts) + " END"


def sql_jobs(instruction_sql: str | None = None) -> str:
    """A ``jobs`` CTE body matching ``jobs_from_documents`` / ``corpus_requests``."""
    instr = instruction_sql or sql_instruction()
    return (f"SELECT 'job-' || CAST(doc_id AS VARCHAR) AS job_id, doc_id, {instr} AS instruction, "
            f"coalesce(text, '') AS text, lower(coalesce(text, '')) AS lt, length(coalesce(text, '')) AS n "
            f"FROM documents")


def sql_str(s: str) -> str:
    """A DuckDB string literal for ``s`` (newlines via chr(10))."""
    lit = "'" + s.replace("'", "''") + "'"
    return lit.replace("\n", "' || chr(10) || '")


# ---------------------------------------------------------------- call log from events
# Error texts given to failed calls (chosen by user_id mod 4).
CALL_ERRORS = [
    "ThrottlingException: Rate exceeded",
    "ServiceUnavailableException: ServiceUnavailable",
    "ClientError: The security token included in the request is invalid",
    "ValidationException: malformed input",
]


def call_log_from_events(events: DataFrame) -> DataFrame:
    """A model-call log derived from ``events``: one call per event, job =
    user, chunk = event id; 'error' events failed; the body layout depends on
    the event type (outputs / generation / empty outputs + text / content)."""
    eid = F.col("event_id").cast("string")
    err = F.lit(None).cast("string")
    for i, e in enumerate(CALL_ERRORS):
        err = F.when(F.pmod(F.col("user_id"), F.lit(len(CALL_ERRORS))) == i, F.lit(e)).otherwise(err)
    et = F.col("event_type")
    body = (F.when(et == "view", F.concat(F.lit('{"outputs": [{"text": "revised text for event '), eid, F.lit('"}]}')))
            .when(et == "click", F.concat(F.lit('{"generation": "generated text '), eid, F.lit('"}')))
            .when(et == "purchase", F.concat(F.lit('{"outputs": [], "text": "t'), eid, F.lit('"}')))
            .when(et == "signup", F.concat(F.lit('{"content": [{"text": "message text '), eid, F.lit('"}]}'))))
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("chunk_no"), F.col("ts").cast("timestamp").alias("ts"),
        (et != "error").alias("ok"), F.when(et == "error", err).alias("error"), body.alias("body"),
        (et == "signup").alias("family"),
        F.concat(F.lit("original text of chunk "), eid).alias("text"))


def sql_call_log() -> str:
    errs = " ".join(f"WHEN {i} THEN {sql_str(e)}" for i, e in enumerate(CALL_ERRORS))
    return f"""SELECT 'job-' || CAST(user_id AS VARCHAR) AS job_id, event_id AS chunk_no, ts,
       event_type <> 'error' AS ok,
       CASE WHEN event_type = 'error' THEN CASE (user_id % {len(CALL_ERRORS)}) {errs} END END AS error,
       CASE event_type
         WHEN 'view' THEN '{{"outputs": [{{"text": "revised text for event ' || CAST(event_id AS VARCHAR) || '"}}]}}'
         WHEN 'click' THEN '{{"generation": "generated text ' || CAST(event_id AS VARCHAR) || '"}}'
         WHEN 'purchase' THEN '{{"outputs": [], "text": "t' || CAST(event_id AS VARCHAR) || '"}}'
         WHEN 'signup' THEN '{{"content": [{{"text": "message text ' || CAST(event_id AS VARCHAR) || '"}}]}}'
       END AS body,
       event_type = 'signup' AS family,
       'original text of chunk ' || CAST(event_id AS VARCHAR) AS text
FROM events"""


# ---------------------------------------------------------------- spans from documents
# Synthetic page geometry for the spans table derived from documents.
PAGE_WIDTH = 612.0
LINES_PER_PAGE, LINES_PER_BLOCK = 40, 5
LEFT_MARGIN, INDENT_STEP, CHAR_WIDTH, LINE_HEIGHT, TOP = 72.0, 15.0, 5.5, 14.0, 72.0


def spans_from_documents(docs: DataFrame) -> DataFrame:
    """A positioned-spans table (FIXTURES ``spans``) derived from documents:
    each text line is a layout line of two spans (first word, rest)."""
    x = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("li", "line"))
    w0 = F.substring_index(F.col("line"), " ", 1)
    x = x.select("doc_id", "li", "line", w0.alias("w0"),
                 F.call_function("substring", F.col("line"), F.length(w0) + 1).alias("w1"))
    x0 = F.lit(LEFT_MARGIN) + F.pmod(F.col("li"), F.lit(4)) * INDENT_STEP
    x1 = x0 + F.length("w0") * CHAR_WIDTH
    base = [F.col("doc_id"), F.floor(F.col("li") / LINES_PER_PAGE).cast("int").alias("page_no"),
            F.lit(PAGE_WIDTH).alias("page_width"),
            F.floor(F.pmod(F.col("li"), F.lit(LINES_PER_PAGE)) / LINES_PER_BLOCK).cast("int").alias("block_no"),
            F.pmod(F.col("li"), F.lit(LINES_PER_BLOCK)).cast("int").alias("line_no")]
    oy = (F.lit(TOP) + F.pmod(F.col("li"), F.lit(LINES_PER_BLOCK)) * LINE_HEIGHT).alias("origin_y")
    s0 = F.struct(F.lit(0).alias("span_no"), F.col("w0").alias("text"), x0.alias("x0"), x1.alias("x1"),
                  F.when(F.pmod(F.col("li"), F.lit(6)) == 0, "Times-Bold").otherwise("Times-Roman").alias("font"),
                  F.lit(0).alias("flags"))
    s1 = F.struct(F.lit(1).alias("span_no"), F.col("w1").alias("text"), x1.alias("x0"),
                  (x1 + F.length("w1") * CHAR_WIDTH).alias("x1"), F.lit("Times-Roman").alias("font"),
                  F.when(F.pmod(F.col("li"), F.lit(11)) == 0, 16).otherwise(0).alias("flags"))
    # one scan: both spans of a line come out of one explode
    return x.select(*base, oy, F.explode(F.array(s0, s1)).alias("s")).select(
        "doc_id", "page_no", "page_width", "block_no", "line_no", "s.span_no", "s.text", "s.x0", "s.x1",
        "origin_y", "s.font", "s.flags")


def sql_spans() -> str:
    x0 = f"({LEFT_MARGIN}::DOUBLE + (li % 4) * {INDENT_STEP}::DOUBLE)"
    x1 = f"({x0} + length(w0) * {CHAR_WIDTH}::DOUBLE)"
    base = (f"doc_id, CAST(li // {LINES_PER_PAGE} AS INT) AS page_no, {PAGE_WIDTH}::DOUBLE AS page_width, "
            f"CAST((li % {LINES_PER_PAGE}) // {LINES_PER_BLOCK} AS INT) AS block_no, "
            f"CAST(li % {LINES_PER_BLOCK} AS INT) AS line_no")
    oy = f"({TOP}::DOUBLE + (li % {LINES_PER_BLOCK}) * {LINE_HEIGHT}::DOUBLE) AS origin_y"
    return f"""(WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  b AS (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM a),
  c AS (SELECT doc_id, i - 1 AS li, l[i] AS line, split_part(l[i], ' ', 1) AS w0 FROM b),
  d AS (SELECT *, substring(line, length(w0) + 1) AS w1 FROM c)
SELECT {base}, 0 AS span_no, w0 AS text, {x0} AS x0, {x1} AS x1, {oy},
       CASE WHEN li % 6 = 0 THEN 'Times-Bold' ELSE 'Times-Roman' END AS font, 0 AS flags FROM d
UNION ALL
SELECT {base}, 1 AS span_no, w1 AS text, {x1} AS x0, {x1} + length(w1) * {CHAR_WIDTH}::DOUBLE AS x1, {oy},
       'Times-Roman' AS font, CASE WHEN li % 11 = 0 THEN 16 ELSE 0 END AS flags FROM d)"""


# ---------------------------------------------------------------- responses from conversations
def responses_from_conversations(conv: DataFrame) -> DataFrame:
    """Model responses derived from assistant turns: plain, wrapped in double
    quotes, in an html code fence, or quoted fenced HTML (turn mod 4); the
    original is the previous turn's text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conv.withColumn("original", F.coalesce(F.lag("text").over(w), F.lit("")))
    t = F.col("text")
    k = F.pmod(F.col("turn"), F.lit(4))
    raw = (F.when(k == 0, t).when(k == 1, F.concat(F.lit('"'), t, F.lit('"')))
           .when(k == 2, F.concat(F.lit("```html\n"), t, F.lit("\n```")))
           .otherwise(F.concat(F.lit('"```html<div>'), t, F.lit('</div>```"'))))
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", raw.alias("response"), "original")


def sql_responses() -> str:
    return """(WITH c AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS original
                FROM conversations)
SELECT conv_id, turn,
       CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '"' || text || '"'
                     WHEN 2 THEN '```html' || chr(10) || text || chr(10) || '```'
                     ELSE '"```html<div>' || text || '</div>```"' END AS response, original
FROM c WHERE role = 'assistant')"""


# ---------------------------------------------------------------- job log from events
# Event type -> job status, and status -> progress.
STATUS_OF_EVENT = {"signup": "queued", "view": "processing", "click": "processing",
                   "purchase": "completed", "error": "error"}
PROGRESS_OF_STATUS = {"queued": 0, "processing": 40, "completed": 100, "error": 100}
NOW = "2024-02-01 00:00:00"


def job_log_from_events(events: DataFrame) -> DataFrame:
    """Append-only job log (FIXTURES ``job_log``) derived from ``events``:
    job = user, seq = event id, status from the event type."""
    st = F.lit(None).cast("string")
    for k, v in STATUS_OF_EVENT.items():
        st = F.when(F.col("event_type") == k, F.lit(v)).otherwise(st)
    pr = F.lit(None).cast("int")
    for k, v in PROGRESS_OF_STATUS.items():
        pr = F.when(st == k, F.lit(v)).otherwise(pr)
    return events.select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
                         F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                         st.alias("status"), pr.alias("progress"),
                         F.concat(F.lit("event "), F.col("event_type"), F.lit(" "), F.col("props")).alias("message"))


def sql_job_log() -> str:
    st = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF_EVENT.items()) + " END"
    pr = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PROGRESS_OF_STATUS.items()) + " END"
    return f"""(WITH a AS (SELECT 'job-' || CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, {st} AS status,
                        'event ' || event_type || ' ' || props AS message FROM events)
SELECT job_id, seq, ts, status, {pr} AS progress, message FROM a)"""


def now_col():
    return F.lit(NOW).cast("timestamp")
