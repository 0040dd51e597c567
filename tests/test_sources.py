"""Sources and sinks: binary intake with replacement characters, routing,
idempotent result writes."""

import os
import tempfile

from pyspark.sql import functions as F

from docrevise.sources import intake as IN


def test_read_documents_replaces_undecodable_bytes(spark):
    d = tempfile.mkdtemp(prefix="docrevise-src-")
    with open(os.path.join(d, "a.txt"), "wb") as f:
        f.write(b"caf\xc3\xa9 ok \xff\xfe end")
    with open(os.path.join(d, "b.PDF"), "wb") as f:
        f.write(b"%PDF-1.4 body")
    raw = b"caf\xc3\xa9 ok \xff\xfe end"
    rows = {r.name: r for r in IN.read_documents(spark, d).collect()}
    assert rows["a.txt"].text == raw.decode("utf-8", errors="replace") and rows["a.txt"].length == len(raw)
    assert rows["b.PDF"].pdf_magic and not rows["a.txt"].pdf_magic
    kinds = {r.name: r.kind for r in IN.route_documents(IN.read_documents(spark, d)).collect()}
    assert kinds == {"a.txt": "text", "b.PDF": "pdf"}


def test_text_page_and_base64(spark):
    import base64
    import html
    df = spark.createDataFrame([("a<b & 'c' \"d\"",)], "t string")
    page = df.select(IN.text_to_html(F.col("t")).alias("html")).first().html
    assert page == f"<!DOCTYPE html><html><body><pre>{html.escape(df.first().t)}</pre></body></html>"
    long = spark.createDataFrame([("x" * 300,)], "html string")
    b = IN.encode_results(long).first().html_base64
    assert b == base64.b64encode(b"x" * 300).decode() and "\n" not in b


def test_write_results_replay_overwrites(spark):
    d = tempfile.mkdtemp(prefix="docrevise-sink-")
    df = spark.createDataFrame([("j1", "r1"), ("j2", "r2")], "job_id string, response string")
    IN.write_results(df, f"{d}/out")
    IN.write_results(df, f"{d}/out")  # a replay replaces, never appends
    assert spark.read.parquet(f"{d}/out").count() == 2


def test_job_ids_are_deterministic(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "doc_id long, instruction string")
    ids = [r[0] for r in df.select(IN.job_ids(F.col("doc_id"), F.col("instruction"))).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 36 and ids[0].count("-") == 4


def test_split_valid_two_outputs(spark):
    rows = [("a", True, "x.txt", "go", 1), ("b", True, "", "go", 1)]
    df = spark.createDataFrame(rows, "job_id string, has_file boolean, file_name string, instruction string, size_bytes long")
    ok, bad = IN.split_valid(df)
    assert [r.job_id for r in ok.collect()] == ["a"] and "reason" not in ok.columns
    assert [(r.job_id, r.reason) for r in bad.collect()] == [("b", "No file selected")]
