"""Model stage (R2/R3) with fake revisers: call counts, fallbacks and an
identity round trip."""

import json
import uuid

from pyspark.sql import functions as F

from docrevise.operators import chunks as C
from docrevise.operators import revision as R
from docrevise.operators import targets as T
from docrevise.plans.registry import table


def _prompts(spark, sf, template="{chunk}"):
    jobs = T.jobs_from_documents(table(spark, sf, "documents"), "x")
    ch = C.label_chunks(C.chunk_fixed(jobs, 500, 100)).withColumn("instruction", F.lit("x"))
    return jobs, ch, R.build_prompts(ch, template)


def echo(p):
    return json.dumps({"outputs": [{"text": p}]})


def test_identity_round_trip(spark, sf):
    jobs, ch, pr = _prompts(spark, sf)
    calls = R.revise_chunks(pr, echo, concurrency=3)
    assert calls.where(F.col("calls") != 1).count() == 0
    resp = calls.select("job_id", "chunk_no", R.response_text(F.col("body")).alias("response"), "error")
    work = ch.withColumn("chunk_no", F.col("chunk_no").cast("long")).join(resp, ["job_id", "chunk_no"])
    out = R.reassemble(R.accept_responses(work), order="chunk", text_col="revised", trim_overlap=True)
    bad = out.join(jobs.select("job_id", F.col("text").alias("orig")), "job_id").where(F.col("text") != F.col("orig"))
    assert bad.count() == 0


def test_short_responses_fall_back(spark, sf):
    _, ch, pr = _prompts(spark, sf)
    calls = R.revise_chunks(pr, lambda p: json.dumps({"generation": p[:9]}), concurrency=2)
    resp = calls.select("job_id", "chunk_no", R.response_text(F.col("body")).alias("response"), "error")
    work = ch.withColumn("chunk_no", F.col("chunk_no").cast("long")).join(resp, ["job_id", "chunk_no"])
    acc = R.accept_responses(work)
    assert acc.where("accepted").count() == 0
    assert acc.where(F.col("revised") != F.col("text")).count() == 0


def test_failures_and_credentials(spark, sf):
    _, _, pr = _prompts(spark, sf)
    pr = pr.limit(20)

    def always(p):
        raise RuntimeError("ServiceUnavailable")

    def creds(p):
        raise RuntimeError("The security token included in the request is invalid")

    a = R.revise_chunks(pr, always, concurrency=2, backoff=0.0).collect()
    assert all(r.calls == 3 and r.error_class == "unavailable" and r.body is None for r in a)
    c = R.revise_chunks(pr, creds, concurrency=2, backoff=0.0).collect()
    assert all(r.calls == 1 and r.error_class == "credentials" for r in c)


def test_one_call_per_chunk_after_persist(spark, sf):
    _, _, pr = _prompts(spark, sf)
    stored = R.persist_calls(R.revise_chunks(pr, echo, concurrency=2), spark, f"test_calls_{uuid.uuid4().hex}")
    n = pr.count()
    assert stored.count() == n
    assert stored.select("job_id", "chunk_no").distinct().count() == n


def test_revise_with_python_reviser(spark, sf):
    from docrevise.plans import fixtures as FX
    from docrevise.plans.revise import revise

    docs = table(spark, sf, "documents")
    jobs = T.prepare_jobs(FX.corpus_requests(docs), docs)
    out = revise(jobs, echo, spark=spark, size=2000, overlap=400, fields=FX.CORPUS_FIELDS, markers=FX.CORPUS_MARKERS,
                 sep="\n", chunker=C.chunk_fixed, template="{chunk}", persist_name=f"test_revise_calls_{uuid.uuid4().hex}")
    res = out["results"].collect()
    assert len(res) == docs.count()
    assert all(r.status == "completed" and r.html and r.changed_chunks == 0 for r in res)
    # an echoing reviser changes nothing: short documents come back as their <pre> page
    one = {r.job_id: r for r in res}["job-0"]
    assert one.response.startswith("<!DOCTYPE html>") or len(one.response) > 0


def test_persisted_calls_are_reused(spark, sf):
    _, _, pr = _prompts(spark, sf)
    pr = pr.limit(30)
    name = f"test_reuse_calls_{uuid.uuid4().hex}"
    first = R.persist_calls(R.revise_chunks(pr, echo, concurrency=2), spark, name, reuse=False)
    n = first.count()

    def boom(p):
        raise RuntimeError("must not be called")

    again = R.persist_calls(R.revise_chunks(pr, boom, concurrency=2, backoff=0.0), spark, name)
    assert again.count() == n and again.where(F.col("error").isNotNull()).count() == 0


def test_credential_errors_fail_the_job(spark, sf):
    from docrevise.plans import fixtures as FX
    from docrevise.plans.revise import revise

    docs = table(spark, sf, "documents").limit(5)

    def creds(p):
        raise RuntimeError("UnrecognizedClientException: bad key")

    jobs = T.prepare_jobs(FX.corpus_requests(docs), docs)
    res = revise(jobs, creds, size=2000, overlap=400, chunker=C.chunk_fixed)["results"].collect()
    assert len(res) == 5 and all(r.status == "error" and r.response is None and "Unrecognized" in r.message for r in res)


def test_revise_job_log_feeds_reports(spark, sf):
    from docrevise.operators import jobs as J
    from docrevise.plans import fixtures as FX
    from docrevise.plans.revise import revise

    docs = table(spark, sf, "documents")
    jobs = T.prepare_jobs(FX.corpus_requests(docs), docs)
    log = revise(jobs, None, size=2000, overlap=400, chunker=C.chunk_fixed)["job_log"]
    counts = {r.status: r.n_jobs for r in J.status_counts(J.latest_state(log)).collect()}
    assert counts == {"completed": docs.count()}
    assert sorted({r.progress for r in log.collect()}) == [0, 10, 30, 40, 70, 85, 100]


def test_revise_rank_order_reassembles_by_rank(spark, sf):
    from docrevise.plans import fixtures as FX
    from docrevise.plans.revise import revise

    docs = table(spark, sf, "documents")
    jobs = T.prepare_jobs(FX.corpus_requests(docs), docs)
    out = revise(jobs, None, size=600, overlap=100, fields=FX.CORPUS_FIELDS, markers=FX.CORPUS_MARKERS, sep="\n",
                 chunker=C.chunk_fixed, order="rank")
    chunks = {}
    for r in out["chunks"].collect():
        chunks.setdefault(r.job_id, []).append((r.rank, r.revised, r.ranked))
    res = {r.job_id: r.response for r in out["results"].collect()}
    assert any(any(x[2] for x in v) for v in chunks.values())          # some documents were ranked
    for job, cs in chunks.items():
        assert res[job] == "\n\n".join(t for _, t, _ in sorted(cs))  # text follows the ranks


def test_placeholders_in_values_stay_text(spark):
    d = spark.createDataFrame([("TEXT", "1/1", "keep {chunk} and {label}")], "text string, label string, instruction string")
    assert R.build_prompts(d, "[{label}] {instruction}: {chunk}").first()["prompt"] == "[1/1] keep {chunk} and {label}: TEXT"


def test_top_k_keeps_the_other_chunks(spark):
    from docrevise.operators import targets as T
    from docrevise.plans.revise import revise
    text = "\n\n".join(f"Part {i} says old value here." for i in range(40))
    req = spark.createDataFrame([("j", "d", "change \"old value\" from 'old' to 'new'")], "job_id string, doc_id string, instruction string")
    jobs = T.prepare_jobs(req, spark.createDataFrame([("d", text)], "doc_id string, text string"))
    out = revise(jobs, size=200, overlap=0, top_k=1)["results"].first()["response"]
    assert all(f"Part {i} " in out for i in range(40)) and "new value" in out and "old value" in out


def test_output_budget_reaches_the_call_and_jobs_overlap(spark):
    df = spark.createDataFrame([(f"j{i}", k, f"p{i}-{k}", 100 * i + k) for i in range(6) for k in range(3)],
                               "job_id string, chunk_no long, prompt string, max_tokens int")
    barrier = {}

    def model(prompt, max_tokens):
        import threading
        # the first chunks of two jobs must be in flight together
        if prompt in ("p0-0", "p1-0"):
            barrier.setdefault("b", threading.Barrier(2)).wait(timeout=30)
        return json.dumps({"generation": f"{prompt}:{max_tokens}"})

    out = R.revise_chunks(df, model, concurrency=1, partitions=1, attempts=1, backoff=0.0, budget_col="max_tokens")
    got = {(r.job_id, r.chunk_no): r.body for r in out.collect()}
    assert got == {(f"j{i}", k): json.dumps({"generation": f"p{i}-{k}:{100 * i + k}"}) for i in range(6) for k in range(3)}


def test_ledger_keeps_finished_calls(spark):
    """A task that dies half-way has recorded its finished calls; the next run
    makes only the missing ones, so every chunk is called once."""
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="docrevise-ledger-")
    done = f"{d}/done"
    os.mkdir(done)
    df = spark.createDataFrame([(f"j{i}", k, f"p{i}-{k}") for i in range(6) for k in range(5)] + [(None, 0, "pn-0")],
                               "job_id string, chunk_no long, prompt string")

    def model(prompt, limit=17):
        if limit and len(os.listdir(done)) >= limit:
            os._exit(1)  # the executor's Python process is lost
        with open(f"{done}/{prompt}-{os.urandom(4).hex()}", "w"):
            pass
        return json.dumps({"generation": prompt})

    def run(fn):
        return R.revise_chunks(df, fn, concurrency=1, partitions=1, jobs_at_once=1, backoff=0.0, ledger=f"{d}/ledger", buckets=4).collect()
    try:
        run(model)
        raise AssertionError("the first run must fail")
    except Exception as e:
        assert "first run" not in str(e)
    assert 0 < len(os.listdir(done)) < 31
    out = run(lambda p: model(p, None))
    assert len(out) == 31 and {(r.job_id, r.chunk_no): json.loads(r.body)["generation"] for r in out} == {
        (f"j{i}", k): f"p{i}-{k}" for i in range(6) for k in range(5)} | {(None, 0): "pn-0"}
    assert len(os.listdir(done)) == 31  # one call per chunk over both runs
    assert {r.calls for r in run(lambda p: 1 / 0)} == {1}


def test_layout_page_survives_revision(spark):
    """A document's own page: head and markup outside the body stay; a document
    above the limit ends as an error."""
    from docrevise.operators import targets as T
    from docrevise.plans.revise import TOO_LARGE, revise
    page = '<!DOCTYPE html><html><head><style>.clause { color: red }</style></head><body class="x>y"><p id="elem_0_1">Old Name pays.</p></body></html>'
    docs = spark.createDataFrame([(1, "Old Name pays. " * 30, page), (2, "short Old Name", None), (3, "y" * 5000, None)], "doc_id long, text string, html string")
    reqs = spark.createDataFrame([(f"j{i}", i, "change from 'Old Name' to 'New Name'") for i in (1, 2, 3)], "job_id string, doc_id long, instruction string")
    jobs = T.prepare_jobs(reqs, docs, max_bytes=4000)
    out = {r.job_id: r for r in revise(jobs, size=200, overlap=0)["results"].collect()}
    assert out["j1"].html.startswith(page[:page.index("<p id")]) and out["j1"].html.endswith("</body></html>")
    assert "New Name pays." in out["j1"].html and "Old Name" not in out["j1"].html and len(out["j1"].ranks) == 3
    assert out["j2"].status == "completed" and (out["j3"].status, out["j3"].message) == ("error", TOO_LARGE)
    small = revise(jobs, size=5000, overlap=0)["results"].where("job_id = 'j1'").first()
    assert small.response == "Old Name pays. ".replace("Old", "New") * 30 or small.html.count("New Name") >= 1


def test_stored_jobs_give_the_same_results(spark, sf):
    from docrevise.plans import fixtures as FX
    from docrevise.operators import targets as T
    docs = table(spark, sf, "documents")
    jobs = T.prepare_jobs(FX.corpus_requests(docs), docs)
    stored = T.store_jobs(jobs, "stored_jobs_test", buckets=4)
    key = lambda j: sorted(tuple(r) for r in T.target_candidates(j, FX.CORPUS_FIELDS).select("job_id", "k1", "k3", "target").collect())
    assert key(stored) == key(jobs)
    joined = stored.join(stored.groupBy("job_id").count(), "job_id")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE stored_jobs_test")


def test_rows_of_a_batch_come_in_parts(spark):
    """R2: a batch is worked on ``at_once`` rows at a time; all rows come out, in any split of a job."""
    p = spark.createDataFrame([(f"job-{i % 3}", i, f"text {i}") for i in range(50)], "job_id string, chunk_no long, prompt string")
    out = R.revise_chunks(p, lambda x: x.upper(), partitions=1, at_once=7)
    assert sorted((r.chunk_no, r.job_id, r.body, r.calls) for r in out.collect()) == [(i, f"job-{i % 3}", f"TEXT {i}", 1) for i in range(50)]
    assert "MapInArrow" in out._jdf.queryExecution().simpleString()
