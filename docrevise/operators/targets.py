"""Document targeting (requests joined to documents): T1-T10.

Layout of the work:

* A job row holds its instruction and its document text, so searching needs
  no join: the terms of the instruction become an array, the text is cut once
  into blocks of ``BLOCK`` characters, and each block is searched on its own
  (with as much of the next blocks as a hit can reach into).  Everything up to
  T5, and T7-T9, is one narrow stage over the documents.
* Rows are exploded per block, so a window is cut from a few blocks, never
  from the whole text, and time is linear in text, hits and windows.
* T6 finds containment from the positions of windows (see ``uncontained``);
  only the windows themselves are shuffled, once.
* Nothing here writes a table, starts a job or sets a session option.
  ``store_jobs`` writes the joined requests for plans that read them often.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import WS, py_split, sql_let, sql_running, sql_str, sql_strip, window_text
from docrevise.operators import instructions as I


# ---------------------------------------------------------------- jobs
def _finish_jobs(jobs: DataFrame) -> DataFrame:
    jobs = jobs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return jobs.withColumn("n_chars", F.length("text")).withColumn("lower_text", F.lower("text"))


def join_requests(requests: DataFrame, docs: DataFrame, hot_share: float = 0.001, salts: int = 32,
                  max_bytes: int = K.UPLOAD_LIMIT_BYTES) -> DataFrame:
    """requests (job_id, doc_id, ...) joined to docs (doc_id, text, and html
    where there is one), safe when one document receives a large share of all
    requests.

    Documents with more than ``hot_share`` of all requests are "hot"; there
    are at most 1 / hot_share of them, so their id list is broadcast with a
    proven size bound.  Requests to hot documents are spread over ``salts``
    tasks by a hash of the job id and meet a copy of the document text in
    each; all other requests use a plain shuffle join whose largest key holds
    at most ``hot_share`` of the rows.  Requests without a document id are
    not joined at all (their nulls would meet in one task).  The number of
    requests is a scalar subquery of the plan: nothing runs here.

    Every request comes out; ``found`` is false, and the text null, where no
    document has its id.  ``too_large`` marks documents above ``max_bytes``;
    their text is left out, so no later step sees a document beyond the bound.
    """
    size = F.octet_length("text") + (F.coalesce(F.octet_length("html"), F.lit(0)) if "html" in docs.columns else F.lit(0))
    fits = F.coalesce(size <= max_bytes, F.lit(True))
    docs = docs.select("doc_id", *[F.when(fits, F.col(c)).alias(c) for c in ("text", "html") if c in docs.columns],
                       F.lit(True).alias("found"), (~fits).alias("too_large"))
    absent = {c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c != "doc_id"}
    total = requests.agg(F.count(F.lit(1)).alias("n")).scalar()
    named = requests.where(F.col("doc_id").isNotNull())
    unnamed = requests.where(F.col("doc_id").isNull()).withColumns(absent)
    hot = (named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > F.greatest(F.floor(total * hot_share), F.lit(1))).select("doc_id"))
    hot = F.broadcast(hot)  # at most 1 / hot_share rows
    cold = named.join(hot, "doc_id", "left_anti").join(docs, "doc_id", "left")
    salt = F.pmod(F.xxhash64("job_id"), F.lit(salts))
    hot_req = named.join(hot, "doc_id", "left_semi").withColumn("_salt", salt)
    hot_docs = docs.join(hot, "doc_id", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    warm = hot_req.join(hot_docs, ["doc_id", "_salt"], "left").drop("_salt")
    out = cold.unionByName(warm).unionByName(unnamed)
    return out.withColumn("found", F.coalesce(F.col("found"), F.lit(False))).withColumn("too_large", F.coalesce(F.col("too_large"), F.lit(False)))


def prepare_jobs(requests: DataFrame, docs: DataFrame, hot_share: float = 0.001, max_bytes: int = K.UPLOAD_LIMIT_BYTES) -> DataFrame:
    """(job_id, doc_id, instruction) joined to (doc_id, text), lazily.

    Adds ``n_chars``, ``lower_text``, ``found`` and ``too_large``.  A request
    that names no existing document, or one above the upload limit, stays, with
    an empty text; ``revise`` ends it as an error.  Hot documents are handled
    by ``join_requests``.  A plan that reads the jobs in many branches stores
    them first (``store_jobs``)."""
    return _finish_jobs(join_requests(requests, docs, hot_share, max_bytes=max_bytes))


def jobs_from_documents(docs: DataFrame, instruction: str | Column, partitions: int | None = None) -> DataFrame:
    """One job per document, with the same instruction for all or one derived
    from the document's columns (no join needed).

    Rows stay where they were read; ``partitions`` deals them out by
    ``job_id`` instead, for tables of fewer files than there are cores."""
    instr = instruction if isinstance(instruction, Column) else F.lit(instruction)
    keep = ["html"] if "html" in docs.columns else []
    jobs = docs.select(F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), "doc_id",
                       instr.alias("instruction"), "text", *keep, F.lit(True).alias("found"))
    return _finish_jobs(jobs.repartition(partitions, "job_id") if partitions else jobs)


def store_jobs(jobs: DataFrame, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """``jobs`` written once as a Parquet table, bucketed and sorted by
    ``job_id``, below the cluster's shared checkpoint folder, and read back:
    the join is not repeated, scans read only their columns, joins on
    ``job_id`` need no exchange, and a lost executor re-reads files."""
    from docrevise.session import checkpoint_path
    spark = jobs.sparkSession
    name = name or f"jobs_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = jobs.drop("lower_text", "n_chars")  # derived, never stored
    # Spark knows a union's parts as dealt alike only where the bucket column was renamed on reading
    narrow = narrow.withColumnRenamed("job_id", "bucket_job_id")
    (narrow.repartition(buckets, "bucket_job_id").write.format("parquet").option("path", checkpoint_path(spark, name))
     .bucketBy(buckets, "bucket_job_id").sortBy("bucket_job_id").mode("overwrite").saveAsTable(name))
    return _finish_jobs(spark.table(name).withColumnRenamed("bucket_job_id", "job_id"))


def drop_jobs(spark: SparkSession, name: str) -> None:
    """Removes what ``store_jobs`` wrote under ``name``, whole or in part."""
    from docrevise.session import checkpoint_path
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_path(spark, name))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- T1 occurrences
# The nested array expressions are SQL text: one call to the JVM each.
#: Characters per text block.
BLOCK = 1024
_NONE = "cast(array() as array<bigint>)"


def blocks_of(text: str, size: int = BLOCK) -> str:
    """SQL text: consecutive pieces of ``size`` characters (the last one shorter)."""
    return f"if(length({text}) <= {size}, array({text}), regexp_extract_all({text}, '(?s).{{1,{size}}}', 0))"


def may_overlap(t: str) -> str:
    """SQL text: whether term ``t`` may overlap itself (a proper prefix that is
    also a suffix).  Exact up to 7 characters; longer ones are seen by a second
    place of the first 8."""
    return (f"(coalesce(length({t}) > 1 and exists(sequence(1, least(length({t}) - 1, 7)), _b -> left({t}, _b) = right({t}, _b)), false)"
            f" or (length({t}) > 8 and locate(left({t}, 8), {t}, 2) > 0))")


def block_starts(blocks: str, t: str, overlaps: str, size: int = BLOCK) -> str:
    """SQL text: array of arrays, per block the 0-based positions in the whole
    text where term ``t`` starts in that block, ascending, overlapping ones
    too.  Terms that cannot overlap themselves use the plain literal split
    (Boyer-Moore), the others one that stops at every start."""
    literal = f"concat({sql_str(chr(92) + 'Q')}, replace({t}, {sql_str(chr(92) + 'E')}, {sql_str(r'\E\\E\Q')}), {sql_str(chr(92) + 'E')})"
    regex = f"if({overlaps}, concat('(?=', {literal}, ')'), {literal})"
    # all parts but the last end before a hit; a block has at most ``size``
    sums = (f"aggregate(slice(_l, 1, size(_l) - 1), named_struct('v', 0L, 'out', {_NONE}), "
            f"(_a, _p) -> named_struct('v', _a.v + _p + if({overlaps}, 0, length({t})), 'out', array_append(_a.out, _a.v + _p)), _a -> _a.out)")
    hits = sql_let(f"transform(split(_x, {regex}, -1), _p -> length(_p))", "_l", sums)
    lead = f"if({overlaps} and startswith(_x, {t}), array(0L), {_NONE})"
    inside = f"if(contains(_x, {t}), concat({lead}, filter({hits}, _p -> not {overlaps} or _p > 0)), {_NONE})"
    more = f"left(array_join(slice({blocks}, _i + 2, cast(ceil((length({t}) - 1) / {size}) as int)), ''), length({t}) - 1)"
    found = sql_let(f"concat(_b, if(length({t}) > 1, {more}, ''))", "_x", inside)
    return f"transform({blocks}, (_b, _i) -> if(length({t}) > 0, transform({found}, _p -> _p + cast(_i as bigint) * {size}), {_NONE}))"


def stepping(starts: str, t: str, overlaps: str) -> str:
    """SQL text: of ``block_starts``, the hits that a left-to-right search
    stepping by the term's length finds."""
    kept = (f"aggregate(_h, named_struct('v', _a.v, 'out', {_NONE}), (_x, _p) -> if(_p < _x.v, _x, "
            f"named_struct('v', _p + length({t}), 'out', array_append(_x.out, _p))))")
    fold = sql_let(kept, "_k", "named_struct('v', _k.v, 'out', array_append(_a.out, _k.out))")
    return (f"if({overlaps}, aggregate({starts}, named_struct('v', 0L, 'out', cast(array() as array<array<bigint>>)), "
            f"(_a, _h) -> {fold}, _a -> _a.out), {starts})")


def _with_hits(x: DataFrame) -> DataFrame:
    """Adds ``_ov``, ``_all`` (all starts) and ``_hits`` (stepping ones) of
    ``_t`` in ``_lb``."""
    x = x.selectExpr("*", f"{may_overlap('_t')} as _ov").selectExpr("*", f"{block_starts('_lb', '_t', '_ov')} as _all")
    return x.selectExpr("*", f"{stepping('_all', '_t', '_ov')} as _hits")


def occurrences(jobs: DataFrame, terms: DataFrame, keys: list[str], overlapping: bool = False) -> DataFrame:
    """Positions of a term in the lower-cased document text.

    ``terms`` has ``job_id``, the ``keys`` columns and ``term``.  Matching is
    case-insensitive.  By default occurrences are the non-overlapping
    left-to-right ones (``str.find`` loop stepping by the term length);
    ``overlapping=True`` returns every start position.

    Returns ``job_id, *keys, term, occ, pos, term_len`` (``pos`` 0-based;
    ``term_len`` is the lower-cased term's length.  Context windows end after
    the length of the term as written, which is shorter where lower-casing
    lengthens it).  Terms of the job's own instruction need no join: see
    ``instruction_occurrences``.
    """
    x = terms.select("job_id", *keys, "term").join(jobs.selectExpr("job_id", f"{blocks_of('lower_text')} as _lb"), "job_id")
    return _positions(x, keys, overlapping)


def _positions(x: DataFrame, keys: list[str], overlapping: bool = False) -> DataFrame:
    x = _with_hits(x.selectExpr("*", "lower(term) as _t"))
    hits = "posexplode_outer(flatten({})) as (occ, pos)".format("_all" if overlapping else "_hits")
    return x.selectExpr("job_id", *keys, "term", "length(_t) as term_len", hits).where("occ is not null")


def instruction_occurrences(jobs: DataFrame, terms: str) -> DataFrame:
    """T1 for the terms of the job's own instruction (``quoted_terms`` etc.),
    without a join: ``job_id, src, k1, k2, term, term_len, occ, pos``."""
    x = jobs.selectExpr("job_id", f"{blocks_of('lower_text')} as _lb", f"{terms} as _terms")
    x = x.selectExpr("job_id", "_lb", "explode_outer(_terms) as _x").where("_x is not null")
    return _positions(x.selectExpr("job_id", "_lb", "_x.src", "_x.k1", "_x.k2", "_x.term"), ["src", "k1", "k2"])


# ---------------------------------------------------------------- terms of an instruction
def _term(src: int, k1: str, k2: str, term: str, before: int, after: int, first: bool) -> str:
    return (f"named_struct('src', {src}, 'k1', {k1}, 'k2', {k2}, 'term', {term}, 'before', {before}, 'after', {after}, "
            f"'only_first', {str(first).lower()})")


def quoted_terms(before: int = K.QUOTED_BEFORE, after: int = K.QUOTED_AFTER, min_len: int = K.MIN_QUOTED_LEN) -> str:
    """SQL text: the quoted spans (I1) of ``instruction`` as search terms, in order."""
    spans = "concat({})".format(", ".join(f"regexp_extract_all(instruction, {sql_str(p)}, 1)" for p in (I.DOUBLE_QUOTED, I.SINGLE_QUOTED)))
    return f"filter(transform({spans}, (_s, _i) -> {_term(1, '_i', '0', '_s', before, after, False)}), _t -> length(_t.term) > {min_len})"


def action_terms(verbs=None, before: int = K.ACTION_BEFORE, after: int = K.ACTION_AFTER) -> str:
    """SQL text: the action phrases (I2, I3) as search terms, first hit only."""
    verbs = "array({})".format(", ".join(map(sql_str, verbs or K.ACTION_VERBS)))
    parts = (f"filter(transform(split(instruction, {sql_str(I.PART_SEPARATOR)}, -1), (_p, _i) -> named_struct('i', _i, 'p', {sql_strip('_p')})), "
             f"_x -> length(_x.p) >= {K.MIN_PART_LEN})")
    words = f"array_join(slice(split(_r, {sql_str(WS + '+')}, -1), 1, 3), ' ')"
    search = sql_let(sql_strip("substring(_x.p, _at + length(_verb) + 1)"), "_r", f"if(length(_r) > 3, {words}, null)")
    found = sql_let("locate(_verb, lower(_x.p)) - 1", "_at", f"if(_at >= 0 and _at + length(_verb) + 1 < length(_x.p), "
                    f"{_term(2, '_x.i', '_v', search, before, after, True)}, null)")
    return (f"filter(flatten(transform({parts}, _x -> transform({verbs}, (_verb, _v) -> {found}))), "
            f"_t -> _t is not null and coalesce(length(_t.term) > 3, false))")


def field_terms(fields=None, before: int = K.FIELD_BEFORE, after: int = K.FIELD_AFTER) -> str:
    """SQL text: the fields that ``instruction`` mentions (I4) as search terms."""
    names = "array({})".format(", ".join(map(sql_str, fields or K.CONTRACT_FIELDS)))
    return f"filter(transform({names}, (_f, _i) -> {_term(3, '_i', '0', '_f', before, after, False)}), _t -> contains(lower(instruction), _t.term))"


def concat_terms(*terms: str) -> str:
    return "concat({})".format(", ".join(terms))


def all_terms(fields=None, verbs=None) -> str:
    return concat_terms(quoted_terms(), action_terms(verbs), field_terms(fields))


# ---------------------------------------------------------------- T2-T5 context windows
def _windows(jobs: DataFrame, terms: str, every: bool = False) -> DataFrame:
    """``job_id, src, k1, k2, k3, target, ws, ord`` per hit: the text from
    ``before`` characters before it to ``after`` behind it, clipped.  ``ord``
    orders a job's rows as (src, k1, k2, k3) do.

    With ``every`` there is also a row (``stepped`` false) for each start that
    the stepping search skips, and ``alone`` marks the windows whose text may
    stand where the term has no window of this shape (see ``uncontained``)."""
    found = f"transform({terms}, _x -> named_struct('src', _x.src, 'k1', _x.k1, 'k2', _x.k2, 'term', _x.term, 't', lower(_x.term), 'before', _x.before, 'after', _x.after, 'only_first', _x.only_first))"
    x = jobs.selectExpr("job_id", "n_chars", f"contains(text, {sql_str(K.LENGTHENING_LETTER)})", "text", "lower_text", f"{found} as terms")
    cols = "job_id string, src int, k1 int, k2 int, k3 int, target string, ws long, ord long"
    return x.mapInArrow(_window_finder(every), cols + (", stepped boolean, alone boolean" if every else ""))


def _repeats(t: str) -> bool:
    """Whether a term may overlap itself: a proper prefix is also a suffix."""
    return any(t.startswith(t[k:]) for k in range(1, len(t)))


def _window_finder(every: bool, rows: int = 4096):
    """The rows of ``_windows``, ``rows`` at a time, by a plain search in each text."""
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()] + [pa.bool_(), pa.bool_()] * every
    names = ["job_id", "src", "k1", "k2", "k3", "target", "ws", "ord"] + ["stepped", "alone"] * every

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def hits(low: str, t: str, only_first: bool) -> Iterator[tuple[int, int | None]]:
        p, k = low.find(t), 0
        while p >= 0:
            yield p, k
            p, k = -1 if only_first else low.find(t, p + len(t)), k + 1
        if every and not only_first and _repeats(t):
            p, free = low.find(t), 0
            while p >= 0:
                if p < free:
                    yield p, None
                else:
                    free = p + len(t)
                p = low.find(t, p + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for job, n, odd, text, low, terms in zip(*b.columns):
                job, n, odd, text, low = job.as_py(), n.as_py(), odd.as_py(), text.as_py(), low.as_py()
                for no, x in enumerate(terms.as_py() or ()):
                    src, k1, k2, before, after, t = x["src"], x["k1"], x["k2"], x["before"], x["after"], x["t"]
                    for p, k3 in hits(low, t, x["only_first"]) if t else ():
                        ws, end = max(p - before, 0), p + len(x["term"]) + after
                        row = (job, src, k1, k2, k3, text[ws:end], ws, None if k3 is None else (no << 32) + k3)
                        out.append((*row, k3 is not None, p < before or end > n or odd or src == 2) if every else row)
                        if len(out) == rows:
                            yield batch(out)
                            out = []
        if out:
            yield batch(out)
    return run


def quoted_windows(jobs: DataFrame, before: int = K.QUOTED_BEFORE, after: int = K.QUOTED_AFTER) -> DataFrame:
    """Every occurrence of every quoted span; ``before``/``after`` context."""
    return _windows(jobs, quoted_terms(before, after))


def action_windows(jobs: DataFrame, verbs=None, before: int = K.ACTION_BEFORE, after: int = K.ACTION_AFTER) -> DataFrame:
    """First occurrence of each action phrase's search words."""
    return _windows(jobs, action_terms(verbs, before, after))


def field_windows(jobs: DataFrame, fields=None, before: int = K.FIELD_BEFORE, after: int = K.FIELD_AFTER) -> DataFrame:
    """T4: every occurrence of every field mentioned in the instruction."""
    return _windows(jobs, field_terms(fields, before, after))


def target_candidates(jobs: DataFrame, fields=None, verbs=None) -> DataFrame:
    """T5: T2, then T3, then T4, ordered by (src, k1, k2, k3), in one pass."""
    return _windows(jobs, all_terms(fields, verbs))


# ---------------------------------------------------------------- T6 drop contained
def _kept(rows: list[tuple]) -> list[tuple[int, str]]:
    """One job's (ord, ws, target, stepped, alone) rows, sorted by ord: the
    kept (ord, target).

    The places of a text are its rows' own places; those of ``alone`` texts
    are not all known, so they are looked for inside the longer texts."""
    classes: dict[str, int] = {}
    first: list[tuple[int, int, int, str]] = []  # ord, ws, length, text
    for o, ws, text, stepped, _ in rows:
        if stepped and text not in classes:
            classes[text] = len(first)
            first.append((o, ws, len(text), text))
    lengths = {f[2] for f in first}
    near: list[set] = [set() for _ in first]
    if len(lengths) > 1:
        longest = max(lengths)
        by_start = sorted(range(len(first)), key=lambda i: first[i][1])
        starts = [first[i][1] for i in by_start]
        alone = set()
        for _, ws, text, _, lone in rows:
            x = classes.get(text)
            if x is None:
                continue
            if lone:
                alone.add(x)
                continue
            n = len(text)
            for k in range(bisect_left(starts, ws + n - longest), bisect_right(starts, ws)):
                y = by_start[k]
                if first[y][2] > n and starts[k] + first[y][2] >= ws + n:
                    near[x].add(y)
                    near[y].add(x)
        for x in alone:
            text, n = first[x][3], first[x][2]
            for y, f in enumerate(first):
                if f[2] > n and text in f[3]:
                    near[x].add(y)
                    near[y].add(x)
    kept, out = [False] * len(first), []
    for i, f in enumerate(first):
        if not any(kept[j] for j in near[i]):
            kept[i] = True
            out.append((f[0], f[3]))
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by job and order, one job held at a time."""
    job, rows = None, []

    def result(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()),
                                           pa.array([x[2] for x in done], pa.string())], ["job_id", "ord", "target"])
    for b in batches:
        done = []
        for j, *row in zip(*[c.to_pylist() for c in b.columns]):
            if j != job:
                done += [(job, *k) for k in _kept(rows)]
                job, rows = j, []
            rows.append(row)
        yield result(done)
    yield result([(job, *k) for k in _kept(rows)])


def _uncontained(rows: DataFrame) -> DataFrame:
    rows = rows.select("job_id", F.col("ord").cast("long"), F.col("ws").cast("long"), "target", "stepped", "alone")
    # skipped starts have no number of their own: they sort first
    rows = rows.repartition("job_id").sortWithinPartitions("job_id", "ord")
    return rows.mapInArrow(_walk, "job_id string, ord bigint, target string")


def drop_contained(cands: DataFrame) -> DataFrame:
    """Walk candidates (job_id, src, k1, k2, k3, target) in order and drop
    one that contains, or is contained in, an already kept candidate
    (case-sensitive).  Returns ``job_id, ord, target``, ``ord`` in the order of
    (src, k1, k2, k3); exact copies meet the fate of their first.

    For any candidates: texts of different lengths are compared.  For those of
    T5 ``uncontained`` needs almost no text comparison."""
    order = Window.partitionBy("job_id").orderBy("src", "k1", "k2", "k3")
    return _uncontained(cands.select("job_id", F.row_number().over(order).alias("ord"), F.lit(0).alias("ws"), "target",
                                     F.lit(True).alias("stepped"), F.lit(True).alias("alone")))


def uncontained(jobs: DataFrame, terms: str) -> DataFrame:
    """T6 over the context windows of ``terms`` (T5's for ``all_terms``).

    Text x stands in text y exactly if some place of x lies inside y's window.
    A window that is not clipped carries its term at a fixed offset, so each
    place of its text is a start of the term, and the window of that start is
    the same text: the places are the windows themselves (also of starts that
    the stepping search skips), and containment is found by comparing
    positions.  Only the few other texts are compared as text: windows clipped
    at a document's ends, first-hit windows (T3), and those of documents whose
    lower-casing moves positions.  Windows are moved once, sorted by job and
    order, and read as a stream that holds one job's candidates; the document
    is not moved at all."""
    return _uncontained(_windows(jobs, terms, every=True))


# ---------------------------------------------------------------- T7 entity presence
def _entities(jobs: DataFrame, *cols: Column) -> DataFrame:
    return jobs.select("job_id", *cols, F.posexplode_outer(I.key_entities_array(F.col("instruction"))).alias("ent_ord", "entity")).where("ent_ord is not null")


def entity_presence(jobs: DataFrame) -> DataFrame:
    """(job_id, ent_ord, entity, found) for the request's key entities."""
    x = _entities(jobs, F.col("lower_text"))
    return x.select("job_id", "ent_ord", "entity", F.contains(F.col("lower_text"), F.lower("entity")).alias("found"))


# ---------------------------------------------------------------- T8 entity paragraphs
def entity_paragraphs(jobs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """The text between the surrounding separators (or the document ends)
    of every occurrence of every found entity: ``job_id, k1, k3, n, ws, we,
    target``, one row per entity and paragraph, with the number ``n`` of its
    hits there and ``k3`` the first of them.

    Hits are read from left to right.  Equal paragraphs are neighbours, and
    each search for a separator starts where the hit before ended its own, so
    the text is read once per entity."""
    x = jobs.select("job_id", "n_chars", "text", "lower_text", F.transform(I.key_entities_array(F.col("instruction")), F.lower).alias("ents"))
    return x.mapInArrow(_paragraph_finder(sep), "job_id string, k1 int, k3 int, n long, ws long, we long, target string")


def _paragraph_finder(sep: str, rows: int = 1024):
    """The rows of ``entity_paragraphs``, ``rows`` at a time."""
    m = len(sep)
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["job_id", "k1", "k3", "n", "ws", "we", "target"])

    def paragraphs(text: str, low: str, n: int, t: str) -> Iterator[tuple[int, int, int, int]]:
        """(first hit, hits, start, end) of each paragraph."""
        p, k, last = low.find(t), 0, None
        ws, we, seen, none = 0, -1, 0, 1 << 62  # separators that start before ``seen`` are in ``ws``
        while p >= 0:
            s = text.rfind(sep, seen, p)
            ws, seen = s + m if s >= 0 else ws, max(p - m + 1, 0)
            if we < p < none:
                s = text.find(sep, p)
                we = s if s >= 0 else none
            now = (ws, n if we == none else we)
            if last is None or last[2:] != now:
                if last is not None:
                    yield last
                last = (k, 0, *now)
            last = (last[0], last[1] + 1, *now)
            p, k = low.find(t, p + len(t)), k + 1
        if last is not None:
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for job, n, text, low, ents in zip(*b.columns):
                ents = ents.as_py() or ()
                if not ents:  # searched only where an entity can be
                    continue
                job, n, text, low = job.as_py(), n.as_py(), text.as_py(), low.as_py()
                for k1, t in enumerate(ents):
                    for k3, hits, ws, we in paragraphs(text, low, n, t) if t else ():
                        out.append((job, k1, k3, hits, ws, we, text[ws:max(we, ws)]))
                        if len(out) == rows:
                            yield batch(out)
                            out = []
        if out:
            yield batch(out)
    return run


def entity_windows(jobs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """T8 with one row per hit, like T2-T5 and T9: ``job_id, src, k1, k2, k3,
    target``; hits of one paragraph each carry its text."""
    hits = F.explode(F.expr("sequence(k3, cast(k3 + n - 1 as int))"))
    return entity_paragraphs(jobs, sep).select("job_id", F.lit(4).alias("src"), "k1", F.lit(0).alias("k2"), hits.alias("k3"), "target")


# ---------------------------------------------------------------- T9 partial entities
def partial_entity_windows(jobs: DataFrame, before: int = K.PARTIAL_BEFORE, after: int = K.PARTIAL_AFTER,
                           min_len: int = K.MIN_PARTIAL_LEN) -> DataFrame:
    """Only for jobs where no key entity is found: each two-word run of an
    entity (at least ``min_len`` characters) that occurs, first hit only."""
    ents = I.key_entities_array(F.col("instruction"))
    none_found = jobs.select("job_id", "text", "lower_text", ents.alias("_ents")).where(
        ~F.exists("_ents", lambda e: F.contains(F.col("lower_text"), F.lower(e))))
    x = none_found.select("job_id", "text", "lower_text", F.posexplode_outer("_ents").alias("ent_ord", "entity")).where("ent_ord is not null")
    words = py_split(F.col("entity"))
    bigrams = F.when(F.size(words) >= 2,
                     F.transform(F.sequence(F.lit(0), F.size(words) - 2),
                                 lambda i: F.concat(F.element_at(words, i + 1), F.lit(" "), F.element_at(words, i + 2))))
    x = x.select("job_id", "text", "lower_text", "ent_ord", F.posexplode_outer(bigrams).alias("b_ord", "partial")).where(F.length("partial") >= min_len)
    x = x.withColumn("hit", F.call_function("locate", F.lower("partial"), F.col("lower_text")) - 1).where(F.col("hit") >= 0)
    return x.select("job_id", F.lit(5).alias("src"), F.col("ent_ord").alias("k1"), F.col("b_ord").alias("k2"),
                    F.lit(0).alias("k3"),
                    window_text(F.col("text"), F.col("hit"), F.length("partial"), before, after).alias("target"))


# ---------------------------------------------------------------- T10 target sections
def target_sections(jobs: DataFrame, fields=None, verbs=None, sep: str = "\n\n") -> DataFrame:
    """T6 result, then T8 and T9, as (job_id, target, n) where ``n`` is
    how often the text occurs in the list (repeats add to chunk scores).  T8's
    repeats arrive counted, so a text is moved once per entity, not per hit;
    dealt by job, it need not move again for what follows per job."""
    one = F.lit(1).cast("bigint").alias("n")
    kept = uncontained(jobs, all_terms(fields, verbs)).select("job_id", "target", one)
    paras = entity_paragraphs(jobs, sep).select("job_id", "target", "n")
    partial = partial_entity_windows(jobs).select("job_id", "target", one)
    found = kept.unionByName(paras).unionByName(partial).repartition("job_id")
    return found.groupBy("job_id", "target").agg(F.sum("n").alias("n"))
