"""Structured Streaming: AvailableNow runs over files equal the batch result
(up to what the watermark has closed), and a restart from the checkpoint
writes nothing twice."""

import os
import tempfile

from pyspark.sql import functions as F

from docrevise.operators import jobs as J
from docrevise.operators import ranking as P
from docrevise.operators import targets as T
from docrevise.plans import fixtures as FX
from docrevise.plans.registry import table
from docrevise.plans.revise import revise
from docrevise.session import checkpoint_path
from docrevise.streaming import streams as ST


def scratch():
    return tempfile.mkdtemp(prefix="docrevise-stream-")


def _split_write(df, path, parts, order_col):
    rows = df.orderBy(order_col).collect()
    n = len(rows)
    for i in range(parts):
        chunk = rows[i * n // parts:(i + 1) * n // parts]
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/part{i}")


def test_health_stream_equals_batch(spark, sf):
    d = scratch()
    calls = FX.call_log_from_events(table(spark, sf, "events")).select("job_id", "chunk_no", "ts", "ok")
    src = f"{d}/calls"
    _split_write(calls, src, 3, "ts")
    q = ST.health_stream(spark, f"{src}/*", f"{d}/out", f"{d}/ck", watermark="2 hours")
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{d}/out").collect()}
    want = {tuple(r) for r in ST.health_windows(calls).collect()}
    max_ts = calls.agg(F.max("ts")).first()[0]
    closed = {w for w in want if (max_ts - w[1]).total_seconds() >= 2 * 3600}
    assert closed <= got <= want and closed


def test_state_stream_counts_equal_batch(spark, sf):
    d = scratch()
    log = FX.job_log_from_events(table(spark, sf, "events"))
    _split_write(log, f"{d}/log", 3, "seq")
    q = ST.state_stream(spark, f"{d}/log/*", f"{d}/sink", f"{d}/ck", max_files=1)
    q.awaitTermination()
    assert len(ST._versions(spark, f"{d}/sink/counts")) == 3  # one counts version per micro-batch
    got = sorted(tuple(r) for r in ST.latest_counts(spark, f"{d}/sink").select("status", "n_jobs", "total_jobs").collect())
    want = sorted(tuple(r) for r in J.status_counts(J.latest_state(log)).select("status", "n_jobs", "total_jobs").collect())
    assert got == want
    # the last change of every job is its current state
    ch = spark.read.parquet(f"{d}/sink/changes")
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("job_id").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    last = {(r.job_id, r.status) for r in ch.withColumn("r", F.row_number().over(w)).where("r = 1").collect()}
    assert last == {(r.job_id, r.status) for r in J.latest_state(log).collect()}


def test_idle_stream_sessions_subset_of_batch(spark, sf):
    d = scratch()
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    _split_write(ev, f"{d}/ev", 2, "ts")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    q = ST.idle_stream(spark, f"{d}/ev/*", schema, f"{d}/out", f"{d}/ck", watermark="1 hour")
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{d}/out").collect()}
    want = {tuple(r) for r in ST.idle_sessions(ev).collect()}
    assert got and got <= want


def test_revise_stream_equals_batch_and_restart_is_idempotent(spark, sf):
    d = scratch()
    docs = table(spark, sf, "documents")
    reqs = FX.corpus_requests(docs)
    _split_write(reqs, f"{d}/req", 2, "job_id")
    opts = dict(size=2000, overlap=400, fields=FX.CORPUS_FIELDS, markers=FX.CORPUS_MARKERS, sep="\n")
    q = ST.revise_stream(spark, f"{d}/req/*", docs, f"{d}/out", f"{d}/ck", max_files=1, **opts)
    q.awaitTermination()
    out = spark.read.parquet(f"{d}/out")
    batches = sorted({r.batch_id for r in out.select("batch_id").distinct().collect()})
    assert len(batches) == 2
    got = sorted((r.job_id, r.response) for r in out.collect())
    want = sorted((r.job_id, r.response) for r in revise(T.prepare_jobs(reqs, docs), None, **opts)["results"].collect())
    assert got == want
    # restart: nothing new to read, nothing rewritten
    q2 = ST.revise_stream(spark, f"{d}/req/*", docs, f"{d}/out", f"{d}/ck", max_files=1, **opts)
    q2.awaitTermination()
    assert spark.read.parquet(f"{d}/out").count() == len(got)
    assert os.path.isdir(f"{d}/ck")


def test_stall_alerts_event_time(spark):
    import datetime as dt
    d = scratch()
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    m = lambda mins: t0 + dt.timedelta(minutes=mins)
    schema = "job_id string, seq bigint, ts timestamp, status string, progress int, message string"
    batches = [
        [("A", 1, m(0), "queued", 0, ""), ("B", 2, m(0), "queued", 0, ""), ("C", 3, m(0), "queued", 0, ""),
         ("A", 4, m(10), "completed", 100, "")],
        [("C", 5, m(120), "completed", 100, "")],
        [("D", 6, m(300), "queued", 0, "")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/log/part{i}")
    q = ST.stall_stream(spark, f"{d}/log/*", f"{d}/out", f"{d}/ck")
    q.awaitTermination()
    got = {(r.job_id, r.finished_at is not None) for r in spark.read.parquet(f"{d}/out").collect()}
    # B never finished (alert when the watermark passes 00:30); C finished late at 02:00; A on time; D too recent
    assert got == {("B", False), ("C", True)}


def test_stall_stream_equals_batch_form(spark, sf):
    d = scratch()
    log = FX.job_log_from_events(table(spark, sf, "events"))
    _split_write(log, f"{d}/log", 4, "ts")
    q = ST.stall_stream(spark, f"{d}/log/*", f"{d}/out", f"{d}/ck", max_files=1)
    q.awaitTermination()
    got = {(r.job_id, r.enqueued_at) for r in spark.read.parquet(f"{d}/out").collect()}
    want = {(r.job_id, r.enqueued_at) for r in ST.stall_alerts_batch(log).collect()}
    assert got == want and got


def test_late_events_beyond_watermark_are_dropped(spark):
    import datetime as dt
    d = scratch()
    h = lambda hh, mm=0: dt.datetime(2024, 1, 1, hh, mm)
    schema = "job_id string, chunk_no bigint, ts timestamp, ok boolean"
    # late rows are filtered with the previous batch's watermark (Spark >= 3.4),
    # so the late row comes after two batches that moved the watermark
    files = [
        [("a", 1, h(10), True), ("a", 2, h(11), False), ("a", 3, h(12), True)],   # watermark -> 10:00
        [("a", 5, h(15), True)],                                                  # watermark -> 13:00
        [("a", 4, h(8, 30), True), ("a", 6, h(20), True)],   # 08:30 is behind the watermark: dropped
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/calls/part{i}")
    src = spark.readStream.schema(ST.CALL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{d}/calls/*")
    q = (ST.health_windows(src, "1 hour", watermark="2 hours").writeStream.option("checkpointLocation", f"{d}/ck")
         .trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{d}/out").start())
    q.awaitTermination()
    got = {(r.window_start.hour, r.total) for r in spark.read.parquet(f"{d}/out").collect()}
    assert (8, 1) not in got and {(10, 1), (11, 1), (12, 1), (15, 1)} <= got


def test_sliding_health_windows(spark, sf):
    calls = FX.call_log_from_events(table(spark, sf, "events")).select("ts", "ok")
    got = {(r.window_start, r.total) for r in ST.health_windows(calls, "1 hour", "30 minutes").collect()}
    rows = calls.collect()
    import datetime as dt
    want = {}
    for r in rows:
        t = r.ts
        base = t.replace(minute=0 if t.minute < 30 else 30, second=0, microsecond=0)
        for start in (base, base - dt.timedelta(minutes=30)):
            want[start] = want.get(start, 0) + 1
    assert got == set(want.items())


def test_stall_rows_behind_the_timer_do_not_fail(spark):
    """A progress row that arrives after the limit has passed, and rows of a
    job already alerted, end neither in an error nor in a second alert."""
    import datetime as dt
    d = scratch()
    t0 = dt.datetime(2024, 1, 1)
    m = lambda mins: t0 + dt.timedelta(minutes=mins)
    schema = "job_id string, seq bigint, ts timestamp, status string, progress int, message string"
    batches = [[("A", 1, m(0), "queued", 0, "")], [("Z", 2, m(300), "queued", 0, "")],
               [("A", 3, m(310), "processing", 10, "")], [("A", 4, m(320), "processing", 20, ""), ("Y", 5, m(330), "queued", 0, "")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/log/part{i}")
    q = ST.stall_stream(spark, f"{d}/log/*", f"{d}/out", f"{d}/ck", max_files=1)
    q.awaitTermination()
    got = [(r.job_id, r.finished_at) for r in spark.read.parquet(f"{d}/out").collect()]
    assert got.count(("A", None)) == 1 and {j for j, _ in got} == {"A"}


def test_rows_without_a_time(spark):
    """Untimed rows end neither stream; state and counts are those of J1 and
    J2, alerts those of the batch form."""
    import datetime as dt
    d = scratch()
    m = lambda mins: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=mins)
    rows = [("A", 1, m(0), "queued", 0, ""), ("A", 9, None, "error", 0, "late"), ("B", 2, None, "queued", 0, None), ("B", 3, None, "processing", None, ""),
            ("C", 4, m(1), "queued", 0, ""), ("C", None, m(1), "completed", 100, ""), (None, 5, m(2), "queued", 0, ""), ("D", 6, m(400), "queued", 0, ""),
            ("E", None, None, "queued", 0, ""), ("A", 7, m(3), "processing", 40, "")]
    schema = "job_id string, seq bigint, ts timestamp, status string, progress int, message string"
    log = spark.createDataFrame(rows, schema)
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/log/part{i}")
    ST.state_stream(spark, f"{d}/log/*", f"{d}/sink", f"{d}/ck", max_files=1).awaitTermination()
    cols = ("status", "n_jobs", "total_jobs", "queue_length")
    state = J.latest_state(log)
    assert sorted(map(tuple, ST.latest_counts(spark, f"{d}/sink").select(*cols).collect())) == sorted(
        map(tuple, J.status_counts(state).select(*cols).collect()))
    ST.stall_stream(spark, f"{d}/log/*", f"{d}/out", f"{d}/ck2").awaitTermination()
    got = {(r.job_id, r.enqueued_at) for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {(r.job_id, r.enqueued_at) for r in ST.stall_alerts_batch(log).collect()} and got
    assert ST.untimed_rows(log).count() == 4


def test_revise_stream_intake_and_log(spark):
    """Requests are checked and get ids; only named documents are read; the
    job log feeds ST2."""
    d = scratch()
    docs = ST.store_documents(spark.createDataFrame([(i, f"Old Name {i} pays every month.") for i in range(50)], "doc_id bigint, text string"),
                              "stream_documents_test", buckets=4)
    reqs = [("a", 1, "change 'Old Name' to 'New Name'"), (None, 2, "change 'Old' to 'New'"), ("c", 3, ""), ("d", None, "x"), ("e", 999, "change 'a' to 'b'")]
    batch = spark.createDataFrame(reqs, ST.REQUEST_SCHEMA)
    batch.coalesce(1).write.parquet(f"{d}/req")
    few = ST.documents_of(batch, docs)
    assert {r.doc_id for r in few.collect()} == {1, 2, 3} and "doc_id" in few._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert {r.doc_id for r in ST.documents_of(batch, docs, max_ids=1).collect()} == {1, 2, 3}
    ST.revise_stream(spark, f"{d}/req", docs, f"{d}/out", f"{d}/ck", log_dir=f"{d}/log").awaitTermination()
    out = spark.read.parquet(f"{d}/out").collect()
    by = {r.job_id: (r.status, r.message, r.response) for r in out}
    assert len(out) == 5 and None not in by and by["a"][0] == "completed" and "New Name 1 pays" in by["a"][2]
    assert by["c"][:2] == ("rejected", "No instruction provided") and by["d"][0] == "rejected" and by["e"][0] == "error"
    ST.state_stream(spark, f"{d}/log", f"{d}/sink", f"{d}/ck2").awaitTermination()
    counts = {r.status: r.n_jobs for r in ST.latest_counts(spark, f"{d}/sink").collect()}
    assert counts == {"completed": 2, "error": 1}
    spark.sql("DROP TABLE stream_documents_test")


def test_state_operator_runs_once_per_batch(spark, tmp_path):
    """ST2: the counts come from the written changes, so no use of the batch
    runs the state operator again."""
    from pyspark.sql import functions as F

    from docrevise.streaming import streams as ST
    spark.range(40).selectExpr("concat('job-', id % 8) as job_id", "id as seq", "timestamp_seconds(id) as ts", "if(id > 30, 'completed', 'queued') as status",
                               "cast(null as int) as progress", "cast(null as string) as message").coalesce(1).write.parquet(f"{tmp_path}/log")
    runs = spark.sparkContext.accumulator(0)
    real = ST._state_change_fn

    def counted(key, pdfs, state):
        runs.add(1)
        yield from real(key, pdfs, state)
    ST._state_change_fn = counted
    try:
        ST.state_stream(spark, f"{tmp_path}/log", f"{tmp_path}/sink", f"{tmp_path}/ckpt").awaitTermination()
    finally:
        ST._state_change_fn = real
    got = {r.status: r.n_jobs for r in ST.latest_counts(spark, f"{tmp_path}/sink").select("status", F.col("n_jobs")).collect()}
    assert got == {"completed": 8}
    assert runs.value == 8


def _requests():
    rows = [(f"job-{i}", i, ["Change 'Old Name' to 'New Name'", "Update Vendor Name to 'Old Name'"][i % 2]) for i in range(12)]
    docs = [(i, "\n".join(f"Old Name {i} pays in month {k} and the state {k % 3} agrees." for k in range(1 + 9 * i))) for i in range(12)]
    return rows, docs


def test_texts_stay_with_their_stored_job(spark):
    """Stored jobs are dealt by job once: nothing but windows, targets and points is dealt again."""
    rows, docs = _requests()
    reqs, docs = spark.createDataFrame(rows, ST.REQUEST_SCHEMA), spark.createDataFrame(docs, "doc_id long, text string")
    joined = T.prepare_jobs(reqs, docs)
    stored = T.store_jobs(joined, "jobs_dealt_once")
    try:
        opts = dict(size=400, overlap=80, fields=["state"], sep="\n")
        out = revise(stored, **opts)["results"]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
        key = lambda d: sorted((r.job_id, r.response, r.html, str(r.ranks)) for r in d.collect())
        assert key(out) == key(revise(joined, **opts)["results"]) and len(key(out)) == 12
    finally:
        T.drop_jobs(spark, "jobs_dealt_once")


def test_stream_stores_a_batch_once_and_drops_it(spark, monkeypatch):
    d, stored, store = scratch(), [], T.store_jobs
    rows, docs = _requests()
    for k in range(2):
        spark.createDataFrame(rows[k::2], ST.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/req")
    monkeypatch.setattr(T, "store_jobs", lambda jobs, name: stored.append(name) or store(jobs, name))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    ST.revise_stream(spark, f"{d}/req", docs, f"{d}/out", f"{d}/ck").awaitTermination()
    assert spark.read.parquet(f"{d}/out").count() == 12 and len(set(stored)) == 2
    assert not any(spark.catalog.tableExists(x) or os.path.exists(checkpoint_path(spark, x).removeprefix("file:")) for x in stored)


def test_points_of_repeated_and_missing_job_ids(spark):
    """Each job row counts its targets, up to its own length; chunks without a job id have no score."""
    jobs = spark.createDataFrame([("a", 30), ("a", 10), ("b", 5), (None, 5)], "job_id string, n_chars long")
    chunks = spark.createDataFrame([("a", 0, 0, "one two"), ("a", 0, 0, "two"), ("a", 1, 20, "six one"), ("b", 0, 0, "no"), (None, 0, 0, "one")],
                                   "job_id string, chunk_no int, start long, text string")
    targets = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), (None, "one", 1)], "job_id string, target string, n long")
    ts = P.score_targets(jobs, chunks, targets, contained=10, first_third=0, middle_third=0, group_chars=20)
    # both rows of "a" reach its first 20 characters, one the next 20; the two chunks 0 add up
    assert sorted((r.job_id, r.chunk_no, r.target_score, r.n_targets) for r in ts.where("job_id is not null").collect()) == [
        ("a", 0, 100, 8), ("a", 1, 10, 2), ("b", 0, 0, 0)]
    scored = P.score_chunks(jobs, chunks, targets, markers=["six"])
    assert scored.columns == ["job_id", "chunk_no", "start", "text", "marker_score", "target_score", "n_targets", "score"]
    assert sorted((r.job_id, r.chunk_no, r.text) for r in scored.collect()) == [("a", 0, "one two"), ("a", 0, "two"), ("a", 1, "six one"), ("b", 0, "no")]
