"""Registered job-log, health and queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.operators import jobs as J
from docrevise.plans import fixtures as FX
from docrevise.plans.queries_revision import calls as call_log
from docrevise.plans.registry import register, table

_LOG = f"WITH log AS {FX.sql_job_log()}"
_STATE = f"""{_LOG},
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn,
             min(ts) OVER (PARTITION BY job_id) AS enqueued_at FROM log),
state AS (SELECT job_id, status, progress, message, ts AS updated_at, seq, enqueued_at FROM r WHERE rn = 1)"""
NOW_SQL = f"TIMESTAMP '{FX.NOW}'"


def job_log(spark, sf):
    return FX.job_log_from_events(table(spark, sf, "events"))


def _ntz(*cols):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in cols]


@register("j1_latest_state", f"{_STATE} SELECT * FROM state")
def j1_latest_state(spark, sf):
    """Current state of every job (last write wins)."""
    s = J.latest_state(job_log(spark, sf))
    return s.select("job_id", "status", "progress", "message", *_ntz("updated_at"), "seq", *_ntz("enqueued_at"))


@register("j2_status_counts", f"""{_STATE},
c AS (SELECT status, count(*) AS n_jobs FROM state GROUP BY status)
SELECT status, n_jobs, CAST(sum(n_jobs) OVER () AS BIGINT) AS total_jobs,
       CAST(sum(CASE WHEN status = 'queued' THEN n_jobs ELSE 0 END) OVER () AS BIGINT) AS queue_length FROM c""")
def j2_status_counts(spark, sf):
    """Jobs per status, total jobs and queue length."""
    c = J.status_counts(J.latest_state(job_log(spark, sf)))
    return c.select("status", F.col("n_jobs").cast("long"), F.col("total_jobs").cast("long"),
                    F.col("queue_length").cast("long"))


# Fixed value: the moment at which J3 looks at the calls (mid-corpus, so jobs
# are partly done).
J3_AT = "2024-01-16 00:00:00"


@register("j3_job_progress", f"""WITH calls AS ({FX.sql_call_log()}),
g AS (SELECT job_id, count(*) FILTER (WHERE ts <= TIMESTAMP '{J3_AT}') AS done, count(*) AS total
      FROM calls GROUP BY job_id)
SELECT job_id, done, total, 40 + CAST(floor(done / total * 30) AS BIGINT) AS progress FROM g""")
def j3_job_progress(spark, sf):
    """Revision progress 40 + int(done / total * 30) per job, failed calls
    included, at a moment between the first and the last call."""
    p = J.job_progress(call_log(spark, sf), F.coalesce(F.col("ts") <= F.lit(J3_AT).cast("timestamp"), F.lit(False)))
    return p.select("job_id", F.col("done").cast("long"), F.col("total").cast("long"), "progress")


@register("j4_job_results", f"""{_STATE},
ids AS (SELECT 'job-' || CAST(c_custkey AS VARCHAR) AS job_id FROM customer)
SELECT ids.job_id, CASE WHEN s.status IS NULL THEN 'not found' WHEN s.status = 'completed' THEN 'completed'
                        ELSE 'not completed' END AS result, s.status, s.progress,
       CASE WHEN s.status = 'completed' THEN s.message END AS response
FROM ids LEFT JOIN state s USING (job_id)""")
def j4_job_results(spark, sf):
    """Result lookup for a list of ids (customer keys as job ids)."""
    ids = table(spark, sf, "customer").select(F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job_id"))
    return J.job_results(J.latest_state(job_log(spark, sf)), ids)


@register("j5_stalled_jobs", f"""{_STATE}
SELECT job_id, status, (epoch_us({NOW_SQL}) - epoch_us(enqueued_at)) / 1e6 AS age_sec FROM state
WHERE status NOT IN ('completed', 'error') AND (epoch_us({NOW_SQL}) - epoch_us(enqueued_at)) / 1e6 > {K.CLIENT_WAIT_LIMIT_SEC}""")
def j5_stalled_jobs(spark, sf):
    """Unfinished jobs older than the client wait limit."""
    return J.stalled_jobs(J.latest_state(job_log(spark, sf)), FX.now_col())


@register("j6_job_metrics", f"""{_LOG},
d AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq)) - epoch_us(ts)) / 1e6 AS dur FROM log),
p AS (SELECT status, count(*) AS n_rows, count(DISTINCT job_id) AS n_jobs, round(avg(dur), 6) AS mean_sec,
             round(median(dur), 6) AS median_sec FROM d GROUP BY status)
SELECT *, round(n_rows / sum(n_rows) OVER (), 6) AS share,
       round(coalesce(100.0 * sum(CASE WHEN status = 'completed' THEN n_rows ELSE 0 END) OVER ()
                / nullif(sum(CASE WHEN status IN ('completed', 'error') THEN n_rows ELSE 0 END) OVER (), 0), 0.0)::DOUBLE, 6)
       AS success_rate FROM p""")
def j6_job_metrics(spark, sf):
    """Per-status time to next log row (mean, exact median), shares, success rate."""
    m = J.job_metrics(job_log(spark, sf))
    return m.select("status", F.col("n_rows").cast("long"), F.col("n_jobs").cast("long"),
                    *[F.round(c, 6).alias(c) for c in ("mean_sec", "median_sec", "share", "success_rate")])


@register("j7_idle_gaps", f"""WITH e AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY ts, event_id) AS prev_ts FROM events)
SELECT event_id, prev_ts, ts, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS gap_sec FROM e
WHERE (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 > {K.WARMUP_PERIOD_MIN * 60 * K.IDLE_SHARE}""")
def j7_idle_gaps(spark, sf):
    """Gaps between consecutive requests longer than 80% of the warm-up period."""
    g = J.idle_gaps(table(spark, sf, "events"))
    return g.select("event_id", *_ntz("prev_ts", "ts"), "gap_sec")


@register("j8_call_health", f"""WITH calls AS ({FX.sql_call_log()}),
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok_calls, count(*) FILTER (WHERE NOT ok) AS failed,
             max(ts) AS last_call, arg_max(ok, (ts, chunk_no)) AS last_ok FROM calls),
r AS (SELECT max(ts) AS last_request FROM events WHERE event_type = 'signup'),
x AS (SELECT * FROM a, r)
SELECT total, ok_calls, failed, last_call, last_ok,
       round(coalesce(100.0 * ok_calls / nullif(total, 0), 0.0)::DOUBLE, 6) AS success_rate,
       (epoch_us({NOW_SQL}) - epoch_us(last_request)) / 1e6 / 60 AS minutes_since_last_request,
       CASE WHEN (epoch_us({NOW_SQL}) - epoch_us(last_request)) / 1e6 > {K.WARMUP_PERIOD_MIN * 60 * K.IDLE_SHARE}
            THEN 'Soon (model likely cold)'
            ELSE strftime(last_request + INTERVAL {int(K.WARMUP_PERIOD_MIN * 60 * K.IDLE_SHARE)} SECOND, '%H:%M:%S') END
       AS next_warmup FROM x""")
def j8_call_health(spark, sf):
    """Call totals, success rate, last outcome and keep-warm status."""
    ev = table(spark, sf, "events")
    h = J.call_health(call_log(spark, sf), ev.where(F.col("event_type") == "signup"), FX.now_col())
    return h.select(F.col("total").cast("long"), F.col("ok_calls").cast("long"), F.col("failed").cast("long"),
                    *_ntz("last_call"), "last_ok", F.round("success_rate", 6).alias("success_rate"),
                    "minutes_since_last_request", "next_warmup")


@register("j9_next_jobs", f"""{_STATE}
SELECT job_id, enqueued_at FROM state WHERE status = 'queued' ORDER BY enqueued_at, job_id LIMIT {K.QUEUE_DRAIN_LIMIT}""")
def j9_next_jobs(spark, sf):
    """The five oldest queued jobs (FIFO drain order)."""
    return J.next_jobs(J.latest_state(job_log(spark, sf))).select("job_id", *_ntz("enqueued_at"))
