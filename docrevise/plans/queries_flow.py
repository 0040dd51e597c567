"""Registered end-to-end and streaming-equivalent queries (ST1-ST4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.operators import chunks as C
from docrevise.operators import jobs as J
from docrevise.plans import fixtures as FX
from docrevise.plans import sqlparts as S
from docrevise.plans.queries import FIELDS, MARKERS, OVERLAP, SEP, SIZE, _GATE_SQL, _JOBS, corpus_jobs
from docrevise.plans.queries_jobs import _ntz, job_log
from docrevise.plans.queries_revision import calls as call_log
from docrevise.plans.registry import register, table
from docrevise.plans.revise import revise
from docrevise.session import checkpoint_path
from docrevise.streaming import streams as ST

_GAP = int(K.WARMUP_PERIOD_MIN * 60 * K.IDLE_SHARE)


_REVISE_SQL = f"""{_JOBS},
ch AS (SELECT job_id, CAST(0 AS BIGINT) AS chunk_no, {S.text_page('text')} AS ctext FROM jobs WHERE n < {SIZE}
       UNION ALL SELECT job_id, chunk_no, ctext FROM {S.fixed_chunks(SIZE, OVERLAP, '(SELECT * FROM jobs WHERE n >= ' + str(SIZE) + ')')}),
r AS (SELECT ch.job_id, ch.chunk_no, ch.ctext, {S.literal_revise('ch.ctext', S.pairs_list('j.instruction'))} AS resp
      FROM ch JOIN jobs j USING (job_id)),
a AS (SELECT *, coalesce(length(resp) >= 10, false) AS accepted FROM r),
b AS (SELECT *, CASE WHEN accepted THEN resp ELSE ctext END AS revised FROM a),
k AS (SELECT job_id, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY chunk_no) AS ranks FROM ({_GATE_SQL}) GROUP BY job_id)
SELECT job_id, any_value(k.ranks) AS ranks, string_agg(revised, chr(10) || chr(10) ORDER BY chunk_no) AS response,
       count(*) FILTER (WHERE accepted) AS accepted_chunks,
       count(*) FILTER (WHERE coalesce(lower(revised) <> lower(ctext), false)) AS changed_chunks
FROM b JOIN k USING (job_id) GROUP BY job_id"""


@register("revise_documents", _REVISE_SQL)
def revise_documents(spark, sf):
    """End to end: targets, chunks (short documents bypass as HTML), scores,
    ranks, deterministic revision, acceptance, reassembly in document order."""
    out = revise(corpus_jobs(spark, sf), None, size=SIZE, overlap=OVERLAP, fields=FIELDS, markers=MARKERS,
                 sep=SEP, chunker=C.chunk_fixed)["results"]
    return _revised(out)


def _revised(out):
    ranks = F.array_join(F.transform("ranks", lambda r: r["rank"].cast("string")), ",")
    return out.select("job_id", ranks.alias("ranks"), "response", F.col("accepted_chunks").cast("long"), F.col("changed_chunks").cast("long"))


@register("st1_revise_stream", _REVISE_SQL)
def st1_revise_stream(spark, sf):
    """ST1: the requests as files, read as a stream to its end (AvailableNow):
    intake, lookup of each batch's documents, revision, job log."""
    base = checkpoint_path(spark, f"st1-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents")
    FX.corpus_requests(docs).repartition(2).write.parquet(f"{base}/requests")
    ST.revise_stream(spark, f"{base}/requests", docs, f"{base}/out", f"{base}/checkpoint", size=SIZE, overlap=OVERLAP, fields=FIELDS,
                     markers=MARKERS, sep=SEP, chunker=C.chunk_fixed, log_dir=f"{base}/log").awaitTermination()
    return _revised(spark.read.parquet(f"{base}/out"))


@register("st2_state_updates", f"""WITH log AS {FX.sql_job_log()},
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn,
             min(ts) OVER (PARTITION BY job_id) AS enqueued_at FROM log)
SELECT job_id, status, progress, message, ts AS updated_at, seq, enqueued_at FROM r WHERE rn = 1""")
def st2_state_updates(spark, sf):
    """ST2 (batch form): live job state; ``st2_stream_counts`` runs the stream."""
    s = J.latest_state(job_log(spark, sf))
    return s.select("job_id", "status", "progress", "message", *_ntz("updated_at"), "seq", *_ntz("enqueued_at"))


@register("st2_stream_counts", f"""WITH log AS {FX.sql_job_log()},
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM log),
c AS (SELECT status, count(*) AS n_jobs FROM r WHERE rn = 1 GROUP BY status)
SELECT status, n_jobs, CAST(sum(n_jobs) OVER () AS BIGINT) AS total_jobs,
       CAST(sum(CASE WHEN status = 'queued' THEN n_jobs ELSE 0 END) OVER () AS BIGINT) AS queue_length FROM c""")
def st2_stream_counts(spark, sf):
    """ST2: the streaming job-state code over the whole log, read as a stream
    to its end (AvailableNow); the counts it leaves."""
    base = checkpoint_path(spark, f"st2-{uuid.uuid4().hex}")
    job_log(spark, sf).write.parquet(f"{base}/log")
    ST.state_stream(spark, f"{base}/log", f"{base}/sink", f"{base}/checkpoint", max_files=4).awaitTermination()
    c = ST.latest_counts(spark, f"{base}/sink")
    return c.select("status", F.col("n_jobs").cast("long"), F.col("total_jobs").cast("long"),
                    F.col("queue_length").cast("long"))


_STALL_SQL = f"""WITH log AS {FX.sql_job_log()},
r AS (SELECT *, coalesce(sum(CASE WHEN status IN ('completed', 'error') THEN 1 ELSE 0 END)
                OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM log),
runs AS (SELECT job_id, run, min(ts) AS enqueued_at,
                min(CASE WHEN status IN ('completed', 'error') THEN ts END) AS finished_at FROM r GROUP BY ALL),
wm AS (SELECT max(ts) - INTERVAL 600 SECOND AS wm FROM log)
SELECT job_id, enqueued_at, enqueued_at + INTERVAL {K.CLIENT_WAIT_LIMIT_SEC} SECOND AS stalled_at
FROM runs, wm
WHERE finished_at > enqueued_at + INTERVAL {K.CLIENT_WAIT_LIMIT_SEC} SECOND
   OR (finished_at IS NULL AND enqueued_at + INTERVAL {K.CLIENT_WAIT_LIMIT_SEC} SECOND < wm.wm)"""


@register("st3_stall_stream", _STALL_SQL)
def st3_stall_stream(spark, sf):
    """ST3: the stateful stall alerts over the whole log, read as a stream to
    its end (AvailableNow)."""
    base = checkpoint_path(spark, f"st3-{uuid.uuid4().hex}")
    job_log(spark, sf).write.parquet(f"{base}/log")
    ST.stall_stream(spark, f"{base}/log", f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    a = spark.read.schema(ST.STALL_OUTPUT).parquet(f"{base}/sink")
    return a.select("job_id", *_ntz("enqueued_at", "stalled_at"))


@register("st3_idle_sessions", f"""WITH e AS (SELECT user_id, event_id, ts,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
f AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= {_GAP} * 1000000 THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {_GAP} SECOND AS idle_from, count(*) AS n_events
FROM f GROUP BY user_id, sid""")
def st3_idle_sessions(spark, sf):
    """ST3 (batch form): per-user activity sessions split by 12-minute idle gaps."""
    s = ST.idle_sessions(table(spark, sf, "events"))
    return s.select("user_id", *_ntz("session_start", "idle_from"), F.col("n_events").cast("long"))


@register("st4_health_windows", f"""WITH calls AS ({FX.sql_call_log()})
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS total, count(*) FILTER (WHERE ok) AS ok_calls, count(*) FILTER (WHERE NOT ok) AS failed,
       round(coalesce(100.0 * count(*) FILTER (WHERE ok) / nullif(count(*), 0), 0.0)::DOUBLE, 6) AS success_rate
FROM calls GROUP BY ALL""")
def st4_health_windows(spark, sf):
    """ST4 (batch form): call health per one-hour tumbling window."""
    h = ST.health_windows(call_log(spark, sf))
    return h.select(*_ntz("window_start", "window_end"), F.col("total").cast("long"), F.col("ok_calls").cast("long"),
                    F.col("failed").cast("long"), F.round("success_rate", 6).alias("success_rate"))


@register("st3_stall_alerts", _STALL_SQL)
def st3_stall_alerts(spark, sf):
    """ST3 (batch form of the stateful stream): job runs not finished within
    the client wait limit, by event time."""
    a = ST.stall_alerts_batch(job_log(spark, sf))
    return a.select("job_id", *_ntz("enqueued_at", "stalled_at"))
