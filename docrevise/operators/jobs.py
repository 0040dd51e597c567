"""Job log, health and queue reports: J1-J9.

The job log is append-only: (job_id, seq, ts, status, progress, message).
A job's state is its last row by (ts, seq); nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrevise.functions import constants as K

FINISHED = ["completed", "error"]


def _secs(a: Column, b: Column) -> Column:
    """b - a in seconds (double), exact to the microsecond."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def _bucket(ts: str, bucket: str) -> Column:
    """Number of the time bucket of a row; null where the time is null (a
    ``window`` would drop such rows)."""
    width = F.expr(f"unix_micros(timestamp_micros(0) + interval {bucket})")
    return F.floor(F.unix_micros(F.col(ts)) / width)


def _join_null_safe(x: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where null keys match each other; ``other`` has one row per
    key, so every row of ``x`` comes out once."""
    y = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return x.join(y, cond).drop(*[f"_k_{k}" for k in keys])


def neighbour_ts(df: DataFrame, keys: list[str], ts: str, tie: str, bucket: str = "1 hour",
                 direction: str = "next", out: str = "other_ts") -> DataFrame:
    """Time of the previous / next row of the same key (ordered by ts, tie)
    without putting a whole key into one window partition.

    Rows are ordered inside (key, time bucket) partitions; the row at a
    bucket's edge takes the nearest non-empty bucket's min / max time from a
    per-(key, bucket) summary, whose size is bounded by keys x time span /
    bucket width - not by the number of rows.  So a key holding a third of
    all rows is still spread over many tasks.

    Every row is kept.  Null keys form a key of their own; a row without a
    time has no neighbour and is nobody's neighbour.
    """
    x = df.withColumn("_b", _bucket(ts, bucket))
    w = Window.partitionBy(*keys, "_b").orderBy(ts, tie)
    wb = Window.partitionBy(*keys).orderBy("_b") if keys else Window.partitionBy(F.lit(0)).orderBy("_b")
    if direction == "next":
        x = x.withColumn(out, F.lead(ts).over(w))
        edge = x.groupBy(*keys, "_b").agg(F.min(ts).alias("_edge")).withColumn("_nb", F.lead("_edge").over(wb))
    else:
        x = x.withColumn(out, F.lag(ts).over(w))
        edge = x.groupBy(*keys, "_b").agg(F.max(ts).alias("_edge")).withColumn("_nb", F.lag("_edge").over(wb))
    x = _join_null_safe(x, edge.select(*keys, "_b", "_nb"), [*keys, "_b"])
    near = F.when(F.col(ts).isNotNull(), F.coalesce(F.col(out), F.col("_nb")))
    return x.withColumn(out, near).drop("_b", "_nb")


def count_before(df: DataFrame, keys: list[str], ts: str, tie: str, flag: str, out: str = "n_before",
                 bucket: str = "1 hour") -> DataFrame:
    """Per key, how many earlier rows (by ts, tie) have ``flag`` set - a
    running count that, like ``neighbour_ts``, never puts a whole key into
    one window partition: counts inside (key, bucket) plus a carry of all
    earlier buckets from a per-bucket summary.  Rows without a time come
    first; null keys form a key of their own."""
    f = F.col(flag).cast("int")
    x = df.withColumn("_b", _bucket(ts, bucket))
    w = Window.partitionBy(*keys, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum(f).over(w), F.lit(0)))
    wb = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = (x.groupBy(*keys, "_b").agg(F.sum(f).alias("_bs"))
             .withColumn("_carry", F.coalesce(F.sum("_bs").over(wb), F.lit(0))))
    x = _join_null_safe(x, carry.select(*keys, "_b", "_carry"), [*keys, "_b"])
    return x.withColumn(out, (F.col("_in") + F.col("_carry")).cast("long")).drop("_b", "_in", "_carry")


def gap_sessions(df: DataFrame, keys: list[str], ts: str, tie: str, gap_sec: float,
                 bucket: str = "1 hour") -> DataFrame:
    """Sessions per key: a new session starts when the previous row of the
    key is ``gap_sec`` or more earlier (the rule of ``session_window``).
    Returns keys, session_start, last_ts, n_events.

    Like ``neighbour_ts`` no window spans a whole key: the session start of a
    row is the latest start at or before it, found inside its (key, bucket)
    partition or carried from earlier buckets through a per-bucket summary.
    Rows without a time are one more group per key, with null start and end.
    """
    x = neighbour_ts(df, keys, ts, tie, bucket, "prev", "_prev")
    x = x.withColumn("_start", F.when(F.col("_prev").isNull() | (_secs(F.col("_prev"), F.col(ts)) >= gap_sec),
                                      F.col(ts)))
    x = x.withColumn("_b", _bucket(ts, bucket))
    w = Window.partitionBy(*keys, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.max("_start").over(w))
    wb = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = x.groupBy(*keys, "_b").agg(F.max("_start").alias("_bs")).withColumn("_carry", F.max("_bs").over(wb))
    x = _join_null_safe(x, carry.select(*keys, "_b", "_carry"), [*keys, "_b"])
    x = x.withColumn("session_start", F.when(F.col(ts).isNotNull(), F.coalesce(F.col("_in"), F.col("_carry"))))
    return x.groupBy(*keys, "session_start").agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


# ---------------------------------------------------------------- J1 latest state
def latest_state(job_log: DataFrame) -> DataFrame:
    """Last write wins per job; adds ``enqueued_at`` (first row's time)."""
    last = F.max_by(F.struct("status", "progress", "message", "ts", "seq"), F.struct("ts", "seq"))
    g = job_log.groupBy("job_id").agg(last.alias("s"), F.min("ts").alias("enqueued_at"))
    return g.select("job_id", "s.status", "s.progress", "s.message", F.col("s.ts").alias("updated_at"),
                    F.col("s.seq").alias("seq"), "enqueued_at")


# ---------------------------------------------------------------- J2 status counts
def status_counts(state: DataFrame) -> DataFrame:
    """Jobs per status, with the total and the queue length on every row.
    (The grand totals are a window over the few per-status rows only.)"""
    c = state.groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"))
    w = Window.partitionBy(F.lit(0))
    return (c.withColumn("total_jobs", F.sum("n_jobs").over(w))
            .withColumn("queue_length", F.sum(F.when(F.col("status") == "queued", F.col("n_jobs")).otherwise(0)).over(w)))


# ---------------------------------------------------------------- J3 progress
def job_progress(results: DataFrame, finished: Column | None = None) -> DataFrame:
    """Progress while revising = 40 + int(done / total * 30).

    A chunk is done when its call has ended, well or not: a failed call
    leaves the original chunk in place, so it counts too.  ``finished`` (by
    default: all rows) says which chunks have ended."""
    finished = finished if finished is not None else F.lit(True)
    g = results.groupBy("job_id").agg(F.count_if(finished).alias("done"), F.count(F.lit(1)).alias("total"))
    pct = F.lit(K.PROGRESS_REVISING) + F.floor(F.col("done") / F.col("total") * K.PROGRESS_REVISION_SPAN)
    return g.withColumn("progress", pct.cast("long"))


# ---------------------------------------------------------------- J4 results view
def job_results(state: DataFrame, ids: DataFrame) -> DataFrame:
    """For every requested id: 'completed' with the payload, 'not
    completed' with the current status, or 'not found'."""
    x = ids.select("job_id").join(state, "job_id", "left")
    result = (F.when(F.col("status").isNull(), "not found")
              .when(F.col("status") == "completed", "completed").otherwise("not completed"))
    return x.select("job_id", result.alias("result"), "status", "progress",
                    F.when(F.col("status") == "completed", F.col("message")).alias("response"))


# ---------------------------------------------------------------- J5 stalled
def stalled_jobs(state: DataFrame, now: Column, limit_sec: int = K.CLIENT_WAIT_LIMIT_SEC) -> DataFrame:
    """Unfinished jobs older than ``limit_sec`` at ``now``."""
    age = _secs(F.col("enqueued_at"), now)
    return (state.where(~F.col("status").isin(FINISHED) & (age > limit_sec))
            .select("job_id", "status", age.alias("age_sec")))


# ---------------------------------------------------------------- J6 metrics
def exact_median(counts: DataFrame, key: str, value: str, n: str = "n", digit_bits: int = 16) -> DataFrame:
    """Exact median per key of (key, value, n) rows: ``n`` copies of a
    non-negative long ``value``.  Returns key, median (double).

    Digit-wise selection: the value is read as four digits of ``digit_bits``
    bits, the top one first.  Each step counts rows per (key, digit) among
    those that share the digits found so far and picks the digit in which the
    wanted rank falls.  So no task ever orders a whole key: a window sees at
    most 2 ** digit_bits rows per key and rank.
    """
    total = counts.groupBy(F.col(key).alias("_key")).agg(F.sum(n).alias("_total"))
    lower, upper = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    wanted = total.select("_key", F.posexplode(F.array(lower, upper)).alias("_which", "_rank"),
                          F.lit(0).cast("long").alias("_found"))
    for step in range(64 // digit_bits):
        shift = 64 - digit_bits * (step + 1)
        # digits above this step's (none at the first one)
        above = F.shiftright(F.col(value), shift + digit_bits) if step else F.lit(0).cast("long")
        digit = F.shiftright(F.col(value), shift).bitwiseAND(F.lit((1 << digit_bits) - 1))
        per = (counts.groupBy(F.col(key).alias("_k"), above.alias("_above"), digit.alias("_digit"))
               .agg(F.sum(n).alias("_n")))
        x = wanted.join(per, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_found") == F.col("_above")))
        w = Window.partitionBy("_key", "_which").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("_upto", F.sum("_n").over(w))
        hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
        wanted = x.where(hit).select("_key", "_which", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"),
                                     F.shiftleft(F.col("_found"), digit_bits).bitwiseOR(F.col("_digit")).alias("_found"))
    return wanted.groupBy(F.col("_key").alias(key)).agg(F.avg("_found").alias("median"))


def job_metrics(job_log: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Per status: rows, jobs, mean and exact median seconds until the
    job's next log row; plus the overall success rate and error share.  Rows
    without a time count as rows and have no duration."""
    d = neighbour_ts(job_log, ["job_id"], "ts", "seq", bucket, "next", "next_ts")
    d = d.withColumn("dur_us", F.unix_micros("next_ts") - F.unix_micros("ts"))
    per = d.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("job_id").alias("n_jobs"),
        F.avg(F.col("dur_us") / 1e6).alias("mean_sec"))
    counts = d.where(F.col("dur_us").isNotNull()).groupBy("status", "dur_us").agg(F.count(F.lit(1)).alias("n"))
    med = exact_median(counts, "status", "dur_us").select(
        F.col("status").alias("_status"), (F.col("median") / 1e6).alias("median_sec"))
    per = per.join(med, F.col("status").eqNullSafe(F.col("_status")), "left").drop("_status")
    tot = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    done = F.sum(F.when(F.col("status").isin(FINISHED), F.col("n_rows")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    ok = F.sum(F.when(F.col("status") == "completed", F.col("n_rows")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    return (per.withColumn("share", F.col("n_rows") / tot)
            .withColumn("success_rate", F.coalesce(F.try_divide(ok * 100.0, done), F.lit(0.0))))


# ---------------------------------------------------------------- J7 idle gaps
def idle_gaps(events: DataFrame, period_min: float = K.WARMUP_PERIOD_MIN, share: float = K.IDLE_SHARE,
              bucket: str = "1 hour") -> DataFrame:
    """Every gap between consecutive requests longer than share * period.

    No global window: ``neighbour_ts`` orders events inside time buckets and
    fixes bucket edges from a one-row-per-bucket summary."""
    limit = period_min * 60 * share
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = neighbour_ts(e, [], "ts", "event_id", bucket, "prev", "prev_ts")
    gap = _secs(F.col("prev_ts"), F.col("ts"))
    return e.where(gap > limit).select("event_id", "prev_ts", "ts", gap.alias("gap_sec"))


# ---------------------------------------------------------------- J8 call health
def call_health(calls: DataFrame, requests: DataFrame, now: Column, period_min: float = K.WARMUP_PERIOD_MIN,
                share: float = K.IDLE_SHARE) -> DataFrame:
    """One row: totals, last call and outcome, success %, minutes since
    the last real request and the next keep-warm time (or 'cold')."""
    u = (calls.select(F.col("ts").cast("timestamp").alias("ts"), F.col("ok"), F.col("chunk_no").cast("long").alias("k"),
                      F.lit(True).alias("is_call"))
         .unionByName(requests.select(F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("boolean").alias("ok"),
                                      F.lit(None).cast("long").alias("k"), F.lit(False).alias("is_call"))))
    call = F.col("is_call")
    x = u.agg(F.count_if(call).alias("total"), F.count_if(call & F.col("ok")).alias("ok_calls"),
              F.count_if(call & ~F.col("ok")).alias("failed"), F.max(F.when(call, F.col("ts"))).alias("last_call"),
              F.max_by(F.when(call, F.col("ok")), F.when(call, F.struct("ts", "k"))).alias("last_ok"),
              F.max(F.when(~call, F.col("ts"))).alias("last_request"))
    mins = _secs(F.col("last_request"), now) / 60
    due = F.col("last_request") + F.make_dt_interval(secs=F.lit(period_min * 60 * share))
    return x.select(
        "total", "ok_calls", "failed", "last_call", "last_ok",
        F.coalesce(F.try_divide(F.col("ok_calls") * 100.0, F.col("total")), F.lit(0.0)).alias("success_rate"),
        mins.alias("minutes_since_last_request"),
        F.when(mins * 60 > period_min * 60 * share, F.lit(K.COLD_NEXT_WARMUP))
        .otherwise(F.date_format(due, "HH:mm:ss")).alias("next_warmup"))


# ---------------------------------------------------------------- J9 next jobs
def next_jobs(state: DataFrame, n: int = K.QUEUE_DRAIN_LIMIT) -> DataFrame:
    """The ``n`` oldest waiting jobs, first in first out (a top-n report)."""
    return (state.where(F.col("status") == "queued").orderBy("enqueued_at", "job_id").limit(n)
            .select("job_id", "enqueued_at"))
