"""WARC transactions (operator 3): write captures as archives, read them back,
join the records of a capture through their concurrent-to identifiers.

Writing.  A capture gives three records: request, response (or revisit) and
metadata; request and metadata name the response's record id in
WARC-Concurrent-To.  Of captures with equal payloads of at least
``min_bytes``, the one with the smallest id is the response; the others
revisit it: their record has no payload but its digest and, in
WARC-Refers-To, the response's record id.  Spark's text writer writes the
archives (gzip): a capture is one row, header and payload as they are, and the
line separator is the blank line that ends a record.  Archives go to the
shared folder; a lost executor's files are replaced by Spark's own commit.

A task begins another archive before one passes
``ARCHIVE_BYTES``, so only a single longer capture makes a longer archive.

Reading.  An archive's compressed bytes are one row; it is decompressed record
by record and cut by Content-Length, so payloads may hold anything, blank lines and WARC
headers included.  Responses' digests and lengths are computed from the
payload read; revisits carry both in their header and metadata.

Joining.  ``assemble`` joins requests and metadata to responses by record id,
in whatever archive they stand, and gives one nested row per capture.

Defined cases: null payloads are empty; a null id is written as ``null`` and
reads back as null, never as a revisit's target when another has an id; rows
that agree in id are told apart by a number; a null url is ``urn:none``;
columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrevise.llm.common import col, folder, text_or_empty

MIN_BYTES = 100
#: Bytes of an archive before compression, unless one capture is longer.
ARCHIVE_BYTES = 16 << 20
#: Fixed so that archives do not depend on the clock.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record without the two line breaks after it."""
    parts: list[Column] = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}")]
    for name, value in headers:
        v = F.lit(value) if isinstance(value, str) else value
        parts.append(F.concat(F.lit(f"{name}: "), v, F.lit(CRLF)))
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*parts)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, seq (a row number), bytes, digest and refers_to
    (page_id and seq of the response, or null) per row of ``pages``."""
    p = pages.select(col(id_col).alias("page_id"), col(url).alias("url"), text_or_empty(col(payload)).alias("payload"),
                     F.monotonically_increasing_id().alias("seq"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # only digests that occur more than once are joined back
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "seq"))
    groups = (p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("digest").alias("again"), "first"))
    j = p.join(groups, (F.col("digest") == F.col("again")) & (F.col("bytes") >= min_bytes), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return j.select("page_id", "url", "payload", "seq", "bytes", "digest", F.when(other, F.struct("first.page_id", "first.seq")).alias("refers_to"))


def _archive_number(size: Column, limit: int) -> Column:
    """Number of a row's archive within its task, from a running sum of sizes."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number, total = 0, 0
        for b in batches:
            out = []
            for n in b:
                if total and total + n > limit:
                    number, total = number + 1, 0
                total += n
                out.append(number)
            yield pd.Series(out, dtype="int64")
    return F.pandas_udf(run, "bigint").asNondeterministic()(size)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **kw) -> None:
    """Write ``pages`` as gzipped WARC archives below ``path``, each of at most
    ``archive_bytes`` before compression or of one capture."""
    r = mark_revisits(pages, **kw)
    named = lambda of: F.concat_ws("/", F.coalesce(F.col(f"{of}page_id").cast("string"), F.lit("null")), F.col(f"{of}seq"))
    target = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))
    r = r.withColumn("own", named("")).withColumn("target", target)
    ids = {k: F.concat(F.lit(f"urn:capture:{k}:"), F.col("own")) for k in ("request", "response", "metadata")}
    concurrent = F.concat(F.lit("<"), ids["response"], F.lit(">"))
    uri = ("WARC-Target-URI", F.col("target"))
    sha = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    request = _record("request", ids["request"], [("WARC-Concurrent-To", concurrent), uri, ("Content-Type", "application/http;msgtype=request")],
                      F.concat(F.lit("GET "), F.col("target"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    response = _record("response", ids["response"], [uri, sha, ("Content-Type", "text/html; charset=utf-8")], F.col("payload"))
    refers = F.concat(F.lit("<urn:capture:response:"), named("refers_to."), F.lit(">"))
    revisit = _record("revisit", ids["response"], [uri, sha, ("WARC-Refers-To", refers), (
        "WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], F.lit(""))
    metadata = _record("metadata", ids["metadata"], [("WARC-Concurrent-To", concurrent), uri, ("Content-Type", "application/warc-fields")],
                       F.concat(F.lit("payloadLength: "), F.col("bytes").cast("string"), F.lit(CRLF)))
    capture = F.concat_ws(CRLF + CRLF, request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)
    r = r.select(capture.alias("value")).withColumn("archive", _archive_number(F.octet_length("value") + len(CRLF + CRLF), archive_bytes))
    r.write.partitionBy("archive").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)


def _parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive, one at a time."""
    while stream.readline():  # the version
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("archive ends within a record's headers")
            name, _, value = line.decode().removesuffix(CRLF).partition(": ")
            head[name.lower()] = value
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("archive ends within a record's block")
        yield head, block
        stream.read(4)


_DDL = ("record_id string, record_type string, concurrent_to string, refers_to string, target string, bytes bigint, "
        "digest string, declared_digest string, payload_length bigint")


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``: ids, type, target,
    block length, digest (computed from a response's block; as declared for a
    revisit), and the block itself where ``payloads``."""
    # an archive is one row: its size is bounded by the writer (ARCHIVE_BYTES)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DDL.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for head, block in _parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    strip = lambda k: head[k].strip("<>") if k in head else None  # noqa: B023,E731
                    kind, told = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    length = int(block.split(b":")[1]) if kind == "metadata" else None
                    rows.append((strip("warc-record-id"), kind, strip("warc-concurrent-to"), strip("warc-refers-to"), head.get("warc-target-uri"),
                                 len(block), hashlib.sha256(block).hexdigest() if kind == "response" else told, told, length,
                                 *([block] if payloads else [])))
                    size += len(block) if payloads else 0
                    if len(rows) >= 10_000 or size > 16 << 20:
                        yield _batch(rows, names, payloads)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, payloads)
    return files.mapInArrow(run, _DDL + (", block binary" if payloads else ""))


def _batch(rows: list[tuple], names: list[str], payloads: bool) -> pa.RecordBatch:
    longs = {"bytes", "payload_length"}
    cols = [pa.array(c, pa.int64() if n in longs else pa.string()) for n, c in zip(names, zip(*rows))]
    if payloads:
        cols.append(pa.array([r[-1] for r in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names + ["block"] * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (record id), request, response and
    metadata (structs; request and metadata null where the archives have
    none).  Joined through the concurrent-to identifiers."""
    fields = [c for c in records.columns]
    part = lambda *kinds: records.where(F.col("record_type").isin(*kinds))
    whole = F.struct(*fields)
    response = part("response", "revisit").select(F.col("record_id").alias("capture"), whole.alias("response"))
    request = part("request").select(F.col("concurrent_to").alias("capture"), whole.alias("request"))
    metadata = part("metadata").select(F.col("concurrent_to").alias("capture"), whole.alias("metadata"))
    return response.join(request, "capture", "left").join(metadata, "capture", "left").select("capture", "request", "response", "metadata")


def digest(captures: DataFrame) -> DataFrame:
    """The columns of the contract, from ``assemble``."""
    number = lambda c, i: F.try_element_at(F.split(c, "[:/]"), F.lit(i)).try_cast("bigint")
    revisit = F.col("response.record_type") == "revisit"
    return captures.select(
        number(F.col("capture"), 4).alias("page_id"),
        F.when(revisit, F.col("metadata.payload_length")).otherwise(F.col("response.bytes")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.when(revisit, number(F.col("response.refers_to"), 4)).alias("refers_to"))


def archive(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write ``pages`` and return the captures read back."""
    path = path or folder(pages.sparkSession, "warc")
    write_archives(pages, path, **kw)
    return assemble(read_records(pages.sparkSession, path))
