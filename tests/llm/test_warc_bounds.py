"""Archives are bounded by bytes and read record by record."""

import gzip
import io
from pathlib import Path

from pyspark.sql import functions as F

from docrevise.llm import warc


def test_archives_are_bounded(spark, tmp_path):
    pages = spark.range(0, 60, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("xy"), 250_000)).alias("html"))
    long = spark.range(100, 101, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("z"), 20_000_000).alias("html"))
    warc.write_archives(pages.union(long), str(tmp_path / "w"))
    sizes = sorted(len(gzip.decompress(p.read_bytes())) for p in Path(tmp_path / "w").rglob("*.gz"))
    assert sizes[-1] < 20_100_000 and all(n <= warc.ARCHIVE_BYTES for n in sizes[:-1]) and sizes[-2] > 15_000_000
    got = warc.digest(warc.assemble(warc.read_records(spark, str(tmp_path / "w")))).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == sorted([(i, 500_000 + len(str(i))) for i in range(60)] + [(100, 20_000_000)])


def test_records_are_streamed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100000\r\n\r\n" + b"\r\n" * 50_000 + b"\r\n\r\n"
    stream = io.BufferedReader(io.BytesIO(record * 50))
    records = warc._parse(stream)
    head, block = next(records)
    assert head["warc-type"] == "response" and len(block) == 100_000 and stream.tell() < len(record)
    assert sum(1 for _ in records) == 49
