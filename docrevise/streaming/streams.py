"""Structured Streaming: ST1-ST4.

The reference's queue is an in-memory FIFO drained by one thread; here the
queue is a folder of request files read with ``readStream`` and a checkpoint,
so a restart resumes where it stopped and a replayed micro-batch overwrites
its own output (writes are keyed by batch id and job id).

Event-time rules are explicit: timestamps are cast to TIMESTAMP (UTC
session) and ``withWatermark`` bounds how late an event may arrive; later
events are dropped from windowed / session aggregations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docrevise.functions import constants as K
from docrevise.operators import jobs as J
from docrevise.operators import targets as T
from docrevise.session import checkpoint_path
from docrevise.sources import intake as IN

REQUEST_SCHEMA = "job_id string, doc_id bigint, instruction string"
JOB_LOG_SCHEMA = "job_id string, seq bigint, ts timestamp, status string, progress int, message string"
CALL_SCHEMA = "job_id string, chunk_no bigint, ts timestamp, ok boolean"


def _writer(df: DataFrame, checkpoint: str, trigger: dict | None):
    w = df.writeStream.option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True}))


# ---------------------------------------------------------------- ST1 revise stream
def store_documents(docs: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """``docs`` as a Parquet table, bucketed and sorted by ``doc_id``, below
    the shared folder: a micro-batch then reads the buckets and row groups of
    its own documents only."""
    spark = docs.sparkSession
    (docs.repartition(buckets, "doc_id").write.format("parquet").option("path", checkpoint_path(spark, name))
     .bucketBy(buckets, "doc_id").sortBy("doc_id").mode("overwrite").saveAsTable(name))
    return spark.table(name)


def documents_of(batch: DataFrame, docs: DataFrame, max_ids: int = 10_000) -> DataFrame:
    """The documents that ``batch`` names.  Up to ``max_ids`` ids become a
    filter on the scan (bucket pruning, row-group statistics); more of them
    are joined."""
    ids = batch.select("doc_id").where("doc_id is not null").distinct()
    few = [r[0] for r in ids.limit(max_ids + 1).collect()]
    return docs.where(F.col("doc_id").isin(few)) if len(few) <= max_ids else docs.join(ids, "doc_id", "left_semi")


def accepted_requests(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S5 and S7 for a stream's requests: (accepted, rejected with ``reason``);
    a request without a job id gets one made from its content."""
    named = batch.withColumn("job_id", F.coalesce("job_id", IN.job_ids(F.col("doc_id"), F.col("instruction"))))
    v = IN.validate_requests(named.withColumn("has_file", F.col("doc_id").isNotNull())
                             .withColumn("file_name", F.col("doc_id").cast("string")).withColumn("size_bytes", F.lit(None).cast("long")))
    return (v.where("accepted").select("job_id", "doc_id", "instruction"), v.where(~F.col("accepted")).select("job_id", "reason"))


def revise_stream(spark: SparkSession, requests_dir: str, docs: DataFrame, sink_dir: str, checkpoint: str,
                  fn: Callable[[str], str] | None = None, max_files: int = 1, trigger: dict | None = None,
                  log_dir: str | None = None, **revise_opts) -> StreamingQuery:
    """ST1: continuous intake -> targets -> chunks -> revision -> results.

    Each micro-batch validates its requests (S5), reads the documents that
    they name (``documents_of``), stores the joined jobs for as long as the
    batch runs, runs the batch plan (``plans.revise.revise``)
    and writes ``sink_dir/batch_id=<id>`` in overwrite mode, so a replay after
    a failure replaces, never duplicates, its rows; a replay of a batch whose
    output is complete is skipped, and model calls persisted by an interrupted
    run are read back, so no call is made twice.  Rejected requests are rows
    with status 'rejected' and the reason.  With ``log_dir`` the batch's job
    log goes to ``log_dir/batch_id=<id>``, made from the stored results;
    ``state_stream`` and ``stall_stream`` read it.
    """
    from docrevise.plans.revise import job_log, revise

    src = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(requests_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        from docrevise.session import path_complete
        target = f"{sink_dir.rstrip('/')}/batch_id={batch_id}"
        if not path_complete(spark, target):  # else a replay of a finished batch
            accepted, rejected = accepted_requests(batch)
            name = f"jobs_{uuid.uuid4().hex}"
            calls = f"{checkpoint.rstrip('/')}/model_calls/batch_id={batch_id}"  # owned by this stream
            try:
                # the plan reads the jobs in many branches: the texts are joined and moved once
                jobs = T.store_jobs(T.prepare_jobs(accepted, documents_of(accepted, docs)), name)
                out = revise(jobs, fn, spark=spark, persist_name=calls, **revise_opts)["results"]
                out = out.unionByName(rejected.select("job_id", F.lit("rejected").alias("status"), F.col("reason").alias("message")),
                                      allowMissingColumns=True)
                out.write.mode("overwrite").parquet(target)
            finally:
                T.drop_jobs(spark, name)
        if log_dir is not None:
            log = f"{log_dir.rstrip('/')}/batch_id={batch_id}"
            if not path_complete(spark, log):
                job_log(spark.read.parquet(target).where("status <> 'rejected'")).write.mode("overwrite").parquet(log)

    return _writer(src, checkpoint, trigger).foreachBatch(run).start()


# ---------------------------------------------------------------- ST2 state stream
STATE_CHANGE = ("job_id string, old_status string, status string, progress int, message string, "
                "updated_at timestamp, seq bigint")
STATE_STORE = "status string, rank array<bigint>"
_CHANGE_NAMES = [x.split()[0] for x in STATE_CHANGE.split(", ")]


def _state_change_fn(key, pdfs, state):
    """Keep each job's latest status and its rank (us, seq); emit a change row
    whenever the status changes (rows that rank lower than the stored one are
    ignored).  As in J1, a row without a time ranks before all others, and one
    without a seq before those of its time."""
    import pandas as pd

    (job_id,) = key
    old = best = new = None
    if state.exists:
        old, best = state.get[0], list(state.get[1])
    for pdf in pdfs:
        # the rank comes as numbers; columns as plain lists, since a job has few rows in a batch
        ranks = list(zip(*(pdf[c].tolist() for c in ("_timed", "_us", "_numbered", "_seq"))))
        i = max(range(len(ranks)), key=ranks.__getitem__)
        if best is None or list(ranks[i]) > best:
            best, new = list(ranks[i]), [pdf[c].iat[i] for c in ("status", "progress", "message", "ts", "seq")]
    if new is None:
        return
    new = [None if pd.isna(x) else x for x in new]
    status, progress, message, ts, seq = new
    state.update((status, best))
    if old != status or not state.exists:
        yield pd.DataFrame([[job_id, old, status, progress, message, ts, seq]], columns=_CHANGE_NAMES, dtype=object)


def status_changes(job_log: DataFrame) -> DataFrame:
    """ST2: per-job status changes of a streaming job log (custom stateful
    operator, last write wins by (ts, seq); rows without a time rank first, as
    in J1)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    timed, numbered = F.col("ts").isNotNull(), F.col("seq").isNotNull()
    ranked = job_log.select("*", timed.cast("long").alias("_timed"), F.coalesce(F.unix_micros("ts"), F.lit(0)).cast("long").alias("_us"),
                            numbered.cast("long").alias("_numbered"), F.coalesce("seq", F.lit(0)).cast("long").alias("_seq"))
    return ranked.groupBy("job_id").applyInPandasWithState(
        _state_change_fn, STATE_CHANGE, STATE_STORE, "append", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("batch_id=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def state_stream(spark: SparkSession, job_log_dir: str, sink_dir: str, checkpoint: str,
                 trigger: dict | None = None, max_files: int | None = None) -> StreamingQuery:
    """ST2: live job state and status counts.

    The state store keeps each job's latest status; every micro-batch writes
    its status changes to ``sink_dir/changes/batch_id=<id>`` and a new
    version of the counts, ``sink_dir/counts/batch_id=<id>``, computed as the
    previous version plus this batch's changes.  So each batch costs its own
    size plus a table with one row per status, never a re-read of all jobs.
    A replayed batch whose counts version exists is skipped.
    """
    from docrevise.session import path_complete

    reader = spark.readStream.schema(JOB_LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    src = reader.parquet(job_log_dir)
    base = sink_dir.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        target = f"{base}/counts/batch_id={batch_id}"
        if path_complete(spark, target):
            return
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch_id={batch_id}")
        # read back: each use of the batch itself would run the state operator again
        batch = spark.read.schema(STATE_CHANGE).parquet(f"{base}/changes/batch_id={batch_id}")
        delta = (batch.select(F.col("status").alias("s"), F.lit(1).alias("d"))
                 .unionByName(batch.where(F.col("old_status").isNotNull())
                              .select(F.col("old_status").alias("s"), F.lit(-1).alias("d"))))
        # batch ids are consecutive: the version before is normally this one;
        # the folder is listed only where it is not there
        prev = batch_id - 1
        if not path_complete(spark, f"{base}/counts/batch_id={prev}"):
            prev = max((v for v in _versions(spark, f"{base}/counts") if v < batch_id), default=None)
        if prev is not None:
            old = spark.read.parquet(f"{base}/counts/batch_id={prev}").select(
                F.col("status").alias("s"), F.col("n_jobs").alias("d"))
            delta = delta.unionByName(old)
        counts = (delta.groupBy(F.col("s").alias("status")).agg(F.sum("d").cast("long").alias("n_jobs"))
                  .where(F.col("n_jobs") > 0))
        w = Window.partitionBy(F.lit(0))
        counts = (counts.withColumn("total_jobs", F.sum("n_jobs").over(w))
                  .withColumn("queue_length", F.sum(F.when(F.col("status") == "queued", F.col("n_jobs"))
                                                    .otherwise(0)).over(w)))
        counts.coalesce(1).write.mode("overwrite").parquet(target)

    return _writer(status_changes(src), checkpoint, trigger).outputMode("append").foreachBatch(run).start()


def latest_counts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The newest complete counts version written by ``state_stream``."""
    base = sink_dir.rstrip("/") + "/counts"
    return spark.read.parquet(f"{base}/batch_id={_versions(spark, base)[-1]}")


# ---------------------------------------------------------------- ST3 idle sessions
def idle_sessions(events: DataFrame, period_min: float = K.WARMUP_PERIOD_MIN, share: float = K.IDLE_SHARE,
                  key: str | None = "user_id", watermark: str | None = None) -> DataFrame:
    """ST3: activity sessions separated by idle gaps of at least
    share * period; a session's end is when the idle (cold) period starts.

    A streaming DataFrame (give ``watermark``) uses ``session_window`` with
    state; a static one uses ``gap_sessions``, which does not put a whole key
    (a very active user) into one task."""
    gap_sec = int(period_min * 60 * share)
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    keys = [key] if key else []
    if not e.isStreaming:
        tie = "event_id" if "event_id" in e.columns else "ts"
        g = J.gap_sessions(e, keys, "ts", tie, gap_sec)
        return g.select(*keys, "session_start",
                        (F.col("last_ts") + F.make_dt_interval(secs=F.lit(gap_sec))).alias("idle_from"), "n_events")
    if watermark:
        e = e.withWatermark("ts", watermark)
    g = e.groupBy(*keys, F.session_window("ts", f"{gap_sec} seconds").alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("idle_from"), "n_events")


def idle_stream(spark: SparkSession, events_dir: str, schema: str, sink_dir: str, checkpoint: str,
                watermark: str = "30 minutes", key: str | None = "user_id", trigger: dict | None = None) -> StreamingQuery:
    src = spark.readStream.schema(schema).parquet(events_dir)
    out = idle_sessions(src, key=key, watermark=watermark)
    return _writer(out, checkpoint, trigger).outputMode("append").format("parquet").option("path", sink_dir).start()


# ---------------------------------------------------------------- ST4 health windows
def health_windows(calls: DataFrame, window: str = "1 hour", slide: str | None = None,
                   watermark: str | None = None) -> DataFrame:
    """ST4: calls, successes, failures and success % per time window
    (tumbling, or sliding with ``slide``)."""
    c = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        c = c.withWatermark("ts", watermark)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = c.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok")).alias("ok_calls"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "ok_calls",
                    (F.col("total") - F.col("ok_calls")).alias("failed"),
                    F.coalesce(F.try_divide(F.col("ok_calls") * 100.0, F.col("total")), F.lit(0.0)).alias("success_rate"))


def health_stream(spark: SparkSession, calls_dir: str, sink_dir: str, checkpoint: str, window: str = "1 hour",
                  watermark: str = "2 hours", trigger: dict | None = None) -> StreamingQuery:
    src = spark.readStream.schema(CALL_SCHEMA).parquet(calls_dir)
    out = health_windows(src, window, watermark=watermark)
    return _writer(out, checkpoint, trigger).outputMode("append").format("parquet").option("path", sink_dir).start()


# ---------------------------------------------------------------- ST3 stall alerts (stateful)
STALL_OUTPUT = "job_id string, enqueued_at timestamp, stalled_at timestamp, finished_at timestamp, status string"
STALL_STATE = "enqueued_at timestamp, alerted boolean, status string"
FINISHED = ("completed", "error")


def _stall_fn(limit_sec: float, keep_sec: float):
    import pandas as pd

    limit, keep = pd.Timedelta(seconds=limit_sec), pd.Timedelta(seconds=keep_sec)

    def remember(state, enq, alerted, status):
        """Store the run with its next timer: the deadline, then the end of
        what is kept of an alerted run.  A timer behind the watermark is not
        allowed; a run that old is dropped."""
        due = int((enq + limit + (keep if alerted else pd.Timedelta(0))).timestamp() * 1000)
        if due > state.getCurrentWatermarkMs():
            state.update((enq, alerted, status))
            state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()

    def fn(key, pdfs, state):
        (job_id,) = key
        out = []
        if state.hasTimedOut:
            enq, alerted, status = state.get
            if alerted:
                state.remove()
            else:
                out.append((job_id, enq, enq + limit, None, status))
                # kept for a while so a later finish does not alert again
                remember(state, enq, True, status)
        else:
            cur = state.get if state.exists else None
            rows = pd.concat(list(pdfs)).sort_values(["ts", "seq"], na_position="first")  # as in the batch form
            for ts, status in zip(rows["ts"], rows["status"]):
                if cur is None:
                    cur = (ts, False, status)
                enq, alerted, _ = cur
                cur = (enq, alerted, status)
                if status in FINISHED:
                    if not alerted and ts > enq + limit:
                        out.append((job_id, enq, enq + limit, ts, status))  # finished, but late
                    cur = None  # a later row starts a new run of this job
            if cur is None:
                if state.exists:
                    state.remove()
            else:
                enq, alerted, status = cur
                due = int((enq + limit).timestamp() * 1000)
                if not alerted and due <= state.getCurrentWatermarkMs():
                    # already due: a timer behind the watermark is not allowed
                    out.append((job_id, enq, enq + limit, None, status))
                    alerted = True
                remember(state, enq, alerted, status)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "enqueued_at", "stalled_at", "finished_at", "status"])

    return fn


def stall_alerts(job_log: DataFrame, limit_sec: float = K.CLIENT_WAIT_LIMIT_SEC, watermark: str = "10 minutes",
                 keep_sec: float = K.ALERT_KEEP_SEC) -> DataFrame:
    """ST3: one alert per job run that was not finished ``limit_sec`` after it
    was queued (event time).  Per-job state (queued time, alerted flag) lives
    in the state store with an event-time timer at queued + limit: the alert
    fires when the watermark passes it, or when a finishing row arrives later
    than it.  State ends with the finishing row, or ``keep_sec`` after the
    deadline of a run that never finishes (a row later than that starts a new
    run).  Rows without a time say nothing about when; they are left out here
    (``untimed_rows`` gives them), and the batch form gives the same alerts.
    Works on a streaming job log (append mode)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    src = job_log.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", watermark)
    return src.groupBy("job_id").applyInPandasWithState(
        _stall_fn(limit_sec, keep_sec), STALL_OUTPUT, STALL_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def untimed_rows(rows: DataFrame) -> DataFrame:
    """The rows that the event-time operators leave out, for a sink of their own."""
    return rows.where("ts is null")


def stall_alerts_batch(job_log: DataFrame, limit_sec: float = K.CLIENT_WAIT_LIMIT_SEC,
                       watermark_sec: float = 600) -> DataFrame:
    """The alerts ``stall_alerts`` raises, computed over a complete log.

    A job run starts at a job's first row, or at its first row after a
    finishing one, and ends at its next finishing row.  A run is stalled when
    it finished more than ``limit_sec`` after it was queued, or has not
    finished and its deadline lies before the final watermark (latest time
    minus ``watermark_sec``).  Returns job_id, enqueued_at, stalled_at.
    """
    lg = job_log.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_fin", F.col("status").isin(*FINISHED))
    lg = J.count_before(lg, ["job_id"], "ts", "seq", "_fin", "run")
    runs = lg.groupBy("job_id", "run").agg(
        F.min("ts").alias("enqueued_at"),
        F.min(F.when(F.col("status").isin(*FINISHED), F.col("ts"))).alias("finished_at"))
    # the final watermark is one global value: a scalar subquery over the log
    wm = lg.agg(F.max("ts") - F.make_dt_interval(secs=F.lit(float(watermark_sec)))).scalar()
    deadline = F.col("enqueued_at") + F.make_dt_interval(secs=F.lit(float(limit_sec)))
    stalled = (F.col("finished_at") > deadline) | (F.col("finished_at").isNull() & (deadline < wm))
    return runs.where(stalled).select("job_id", "enqueued_at", deadline.alias("stalled_at"))


def stall_stream(spark: SparkSession, job_log_dir: str, sink_dir: str, checkpoint: str,
                 limit_sec: float = K.CLIENT_WAIT_LIMIT_SEC, watermark: str = "10 minutes",
                 trigger: dict | None = None, max_files: int | None = None) -> StreamingQuery:
    """ST3 alerts of the job log files as they arrive."""
    reader = spark.readStream.schema(JOB_LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    src = reader.parquet(job_log_dir)
    out = stall_alerts(src, limit_sec, watermark)
    return _writer(out, checkpoint, trigger).outputMode("append").format("parquet").option("path", sink_dir).start()
