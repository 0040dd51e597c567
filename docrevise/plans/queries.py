"""Registered queries over the driver tables (targeting, chunking, ranking).

Every query reads whole tables; requests are derived per document (see
``fixtures``).  Integer outputs are BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docrevise.operators import chunks as C
from docrevise.operators import ranking as P
from docrevise.operators import targets as T
from docrevise.plans import fixtures as FX
from docrevise.plans import sqlparts as S
from docrevise.plans.registry import register, table

SIZE, OVERLAP = FX.QUERY_CHUNK_SIZE, FX.QUERY_CHUNK_OVERLAP


def _partitions(spark) -> int:
    """The driver's tables are single files: deal their rows out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flagship_jobs(spark, sf):
    return T.jobs_from_documents(table(spark, sf, "documents"), FX.FLAGSHIP_INSTRUCTION, _partitions(spark))


def corpus_jobs(spark, sf):
    docs = table(spark, sf, "documents")
    return T.jobs_from_documents(docs, FX.instruction_col(F.col("doc_id"), F.col("text")), _partitions(spark))


def _flagship_sql() -> str:
    jobs = FX.sql_jobs(FX.sql_str(FX.FLAGSHIP_INSTRUCTION))
    return f"""
WITH jobs AS ({jobs}),
spans AS {S.quoted_spans()},
occ AS {S.occurrences('spans', ['k1'])},
cands AS (SELECT o.job_id, 1 AS src, o.k1, 0 AS k2, o.occ AS k3,
                 {S.window('j.text', 'o.pos', 'o.L', 'j.n', 100, 200)} AS target
          FROM occ o JOIN jobs j USING (job_id)),
kept AS {S.drop_contained('cands')},
targets AS (SELECT job_id, target, count(*) AS n FROM kept GROUP BY ALL),
chunks AS {S.fixed_chunks(SIZE, OVERLAP)},
pts AS {S.target_points('chunks', 'targets')},
scores AS (SELECT c.job_id, c.doc_id, c.chunk_no, CAST(coalesce(sum(p.p), 0) AS BIGINT) AS score
           FROM chunks c LEFT JOIN pts p USING (job_id, chunk_no) GROUP BY ALL)
SELECT doc_id, chunk_no, score,
       CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, chunk_no) AS BIGINT) AS rank
FROM scores WHERE job_id IN (SELECT job_id FROM targets)
"""


@register("flagship_rank_quoted", _flagship_sql())
def flagship_rank_quoted(spark, sf):
    """Minimum slice: quoted spans -> windows -> drop contained -> fixed chunks
    -> target score -> rank, for documents with at least one target."""
    jobs = flagship_jobs(spark, sf)
    targets = T.uncontained(jobs, T.quoted_terms()).select("job_id", "target", F.lit(1).cast("bigint").alias("n"))
    chunks = C.chunk_fixed(jobs, SIZE, OVERLAP)
    scored = P.score_targets(jobs, chunks, targets).withColumnRenamed("target_score", "score")
    ranked = P.rank_chunks(scored).join(targets.select("job_id").distinct(), "job_id", "left_semi")
    return ranked.join(chunks.select("job_id", "chunk_no", "doc_id"), ["job_id", "chunk_no"]).select(
        F.col("doc_id").cast("long"), F.col("chunk_no").cast("long"), F.col("score").cast("long"),
        F.col("rank").cast("long"))


# ====================================================================== I1-I8
from docrevise.functions import constants as K  # noqa: E402
from docrevise.operators import instructions as I  # noqa: E402

_JOBS = f"WITH jobs AS ({FX.sql_jobs()})"


def corpus_requests(spark, sf):
    return FX.corpus_requests(table(spark, sf, "documents"))


@register("i1_quoted_spans", f"""{_JOBS}, s AS {S.quoted_spans()}
SELECT job_id, CAST(k1 AS BIGINT) AS ord, term AS text FROM s""")
def i1_quoted_spans(spark, sf):
    """Quoted spans of every request, double-quoted first."""
    return I.quoted_spans(corpus_requests(spark, sf)).select("job_id", F.col("ord").cast("long"), "text")


@register("i2_instruction_parts", f"""{_JOBS}, p AS {S.parts()}
SELECT job_id, CAST(part_ord AS BIGINT) AS part_ord, part FROM p""")
def i2_instruction_parts(spark, sf):
    """Instruction parts (newline, numbering, dash), stripped, >= 5 chars."""
    return I.instruction_parts(corpus_requests(spark, sf)).select("job_id", F.col("part_ord").cast("long"), "part")


@register("i3_action_phrases", f"""{_JOBS}, p AS {S.parts()}, a AS {S.action_phrases('p', K.ACTION_VERBS)}
SELECT job_id, CAST(part_ord AS BIGINT) AS part_ord, CAST(verb_ord AS BIGINT) AS verb_ord, verb, phrase, search FROM a""")
def i3_action_phrases(spark, sf):
    """First three words after each action verb of each part."""
    a = I.action_phrases(I.instruction_parts(corpus_requests(spark, sf)))
    return a.select("job_id", F.col("part_ord").cast("long"), F.col("verb_ord").cast("long"), "verb", "phrase", "search")


@register("i4_field_mentions", f"""{_JOBS}, f AS {S.field_mentions(K.CONTRACT_FIELDS)}
SELECT job_id, CAST(field_ord AS BIGINT) AS field_ord, field FROM f""")
def i4_field_mentions(spark, sf):
    """I4: contract fields mentioned in the instruction (substring match)."""
    return I.field_mentions(corpus_requests(spark, sf)).select("job_id", F.col("field_ord").cast("long"), "field")


@register("i5_quoted_entities", f"""{_JOBS}, e AS {S._explode(f'SELECT job_id, {S.quoted_entity_list()} AS l FROM jobs', 'ord', 'entity')}
SELECT job_id, CAST(ord AS BIGINT) AS ord, entity FROM e""")
def i5_quoted_entities(spark, sf):
    """Text between any two quote marks, longer than 3."""
    return I.quoted_entities(corpus_requests(spark, sf)).select("job_id", F.col("ord").cast("long"), "entity")


@register("i6_company_entities", f"""{_JOBS}, e AS {S._explode(f'SELECT job_id, {S.company_entity_list()} AS l FROM jobs', 'ord', 'entity')}
SELECT job_id, CAST(ord AS BIGINT) AS ord, entity FROM e""")
def i6_company_entities(spark, sf):
    """Company names from the role / change / update patterns."""
    return I.company_entities(corpus_requests(spark, sf)).select("job_id", F.col("ord").cast("long"), "entity")


@register("i7_key_entities", f"""{_JOBS}, e AS {S.key_entities()}
SELECT job_id, CAST(ent_ord AS BIGINT) AS ent_ord, entity FROM e""")
def i7_key_entities(spark, sf):
    """Unique key entities in first-occurrence order."""
    return I.key_entities(corpus_requests(spark, sf)).select("job_id", F.col("ent_ord").cast("long"), "entity")


@register("i8_replacement_pairs", f"""{_JOBS},
a AS (SELECT job_id, regexp_extract_all(instruction, {S.lit(S.REPLACEMENT_PAIR)}, 1) AS o,
             regexp_extract_all(instruction, {S.lit(S.REPLACEMENT_PAIR)}, 2) AS w FROM jobs),
b AS (SELECT job_id, o, w, unnest(generate_series(1, len(o))) AS i FROM a)
SELECT job_id, CAST(i - 1 AS BIGINT) AS ord, o[i] AS old, w[i] AS new FROM b""")
def i8_replacement_pairs(spark, sf):
    """I8: (old, new) pairs stated as from 'X' to 'Y'."""
    return I.replacement_pairs(corpus_requests(spark, sf)).select("job_id", F.col("ord").cast("long"), "old", "new")


# ====================================================================== T1-T10
FIELDS, MARKERS, SEP = FX.CORPUS_FIELDS, FX.CORPUS_MARKERS, FX.QUERY_SEPARATOR


@register("t1_occurrences", f"""{_JOBS},
f AS (SELECT job_id, field_ord AS k1, field AS term FROM {S.field_mentions(FIELDS)}),
o AS {S.occurrences('f', ['k1'])}
SELECT job_id, term, CAST(occ AS BIGINT) AS occ, CAST(pos AS BIGINT) AS pos FROM o""")
def t1_occurrences(spark, sf):
    """Every non-overlapping, case-insensitive occurrence of each field
    the instruction mentions, over the whole document text."""
    o = T.instruction_occurrences(corpus_jobs(spark, sf), T.field_terms(FIELDS))
    return o.select("job_id", "term", F.col("occ").cast("long"), F.col("pos").cast("long"))


def _tsel(df):
    return df.select("job_id", F.col("k1").cast("long"), F.col("k2").cast("long"), F.col("k3").cast("long"), "target")


_TSQL = "SELECT job_id, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, CAST(k3 AS BIGINT) AS k3, target FROM w"


@register("t2_quoted_windows", f"{_JOBS}, w AS {S.quoted_windows()} {_TSQL}")
def t2_quoted_windows(spark, sf):
    """Context windows (100 before, 200 after) around every quoted-span hit."""
    return _tsel(T.quoted_windows(corpus_jobs(spark, sf)))


@register("t3_action_windows", f"{_JOBS}, w AS {S.action_windows(K.ACTION_VERBS)} {_TSQL}")
def t3_action_windows(spark, sf):
    """Window around the first hit of each action phrase."""
    return _tsel(T.action_windows(corpus_jobs(spark, sf)))


@register("t4_field_windows", f"{_JOBS}, w AS {S.field_windows(FIELDS)} {_TSQL}")
def t4_field_windows(spark, sf):
    """T4: windows (50 before, 200 after) around every hit of mentioned fields."""
    return _tsel(T.field_windows(corpus_jobs(spark, sf), FIELDS))


@register("t5_target_candidates", f"""{_JOBS}, w AS {S.candidates(FIELDS, K.ACTION_VERBS)}
SELECT job_id, CAST(src AS BIGINT) AS src, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2,
       CAST(k3 AS BIGINT) AS k3, target FROM w""")
def t5_target_candidates(spark, sf):
    """T5: all candidates with their order key (src, k1, k2, k3)."""
    c = T.target_candidates(corpus_jobs(spark, sf), FIELDS)
    return c.select("job_id", F.col("src").cast("long"), F.col("k1").cast("long"), F.col("k2").cast("long"),
                    F.col("k3").cast("long"), "target")


@register("t6_drop_contained", f"""{_JOBS}, k AS {S.drop_contained(S.candidates(FIELDS, K.ACTION_VERBS))}
SELECT job_id, CAST(t_ord AS BIGINT) AS t_ord, target FROM k""")
def t6_drop_contained(spark, sf):
    """Ordered candidates with contained / containing ones dropped."""
    k = T.uncontained(corpus_jobs(spark, sf), T.all_terms(FIELDS))
    t_ord = F.row_number().over(Window.partitionBy("job_id").orderBy("ord")) - 1
    return k.select("job_id", t_ord.cast("long").alias("t_ord"), "target")


@register("t7_entity_presence", f"""{_JOBS}, p AS {S.presence()}
SELECT job_id, CAST(ent_ord AS BIGINT) AS ent_ord, entity, found FROM p""")
def t7_entity_presence(spark, sf):
    """Whether each key entity occurs in the document (case-insensitive)."""
    p = T.entity_presence(corpus_jobs(spark, sf))
    return p.select("job_id", F.col("ent_ord").cast("long"), "entity", "found")


@register("t8_entity_paragraphs", f"{_JOBS}, pr AS {S.presence()}, w AS {S.paragraphs(SEP, 'pr')} {_TSQL}")
def t8_entity_paragraphs(spark, sf):
    """The paragraph (separator: newline) around every hit of every found entity, one row per hit."""
    return _tsel(T.entity_windows(corpus_jobs(spark, sf), SEP))


@register("t9_partial_entity_windows", f"{_JOBS}, pr AS {S.presence()}, w AS {S.partial_windows('pr')} {_TSQL}")
def t9_partial_entity_windows(spark, sf):
    """Two-word partial entity windows for jobs whose entities are all missing."""
    return _tsel(T.partial_entity_windows(corpus_jobs(spark, sf)))


@register("t10_target_sections", f"""{_JOBS}, s AS {S.sections(FIELDS, K.ACTION_VERBS, SEP)}
SELECT job_id, target, CAST(n AS BIGINT) AS n FROM s""")
def t10_target_sections(spark, sf):
    """Final target list with repeat counts."""
    s = T.target_sections(corpus_jobs(spark, sf), FIELDS, sep=SEP)
    return s.select("job_id", "target", F.col("n").cast("long"))


# ====================================================================== C1-C5
def _csel():
    return ["job_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end")]


def _c1_sql(size: int, overlap: int) -> str:
    """C1's contract as a recursive statement: one step per chunk."""
    zone = max(1, min(size // 2, size - overlap - 1)) if size - overlap > 1 else 1
    seps = [s for s in K.CHUNK_SEPARATORS if s]
    sep = {s: FX.sql_str(s) for s in seps}

    def end(s: str) -> str:
        lo = f"({s} + {size - zone})"
        tail = f"substring(text, {lo} + 1, {zone})"
        last = [f"CASE WHEN contains({tail}, {sep[x]}) THEN {lo} + length({tail}) - strpos(reverse({tail}), reverse({sep[x]})) + 1 END" for x in seps]
        return f"CASE WHEN {s} + {size} >= n THEN n ELSE coalesce({', '.join(last)}, {s} + {size}) END"

    lo = f"greatest(e - {overlap}, s + 1)"
    zone_text = f"substring(text, {lo} + 1, e - {lo})"
    begin = [f"CASE WHEN strpos({zone_text}, {sep[x]}) > 0 AND {lo} + strpos({zone_text}, {sep[x]}) - 1 + {len(x)} < e "
             f"THEN {lo} + strpos({zone_text}, {sep[x]}) - 1 + {len(x)} END" for x in seps]
    following = f"CASE WHEN e >= n THEN n ELSE coalesce({', '.join(begin)}, e) END"
    return f"""WITH RECURSIVE jobs AS ({FX.sql_jobs(FX.sql_str(FX.FLAGSHIP_INSTRUCTION))}),
w AS (SELECT job_id, text, n, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS s, CAST({end('0')} AS BIGINT) AS e FROM jobs
      UNION ALL
      SELECT job_id, text, n, chunk_no + 1, CAST(f AS BIGINT), CAST({end('f')} AS BIGINT)
      FROM (SELECT *, {following} AS f FROM w) WHERE f < n)
SELECT job_id, chunk_no, s AS start, e AS "end", e - s AS n_chars FROM w"""


@register("c1_recursive_chunks", _c1_sql(SIZE, OVERLAP))
def c1_recursive_chunks(spark, sf):
    """Separator-aware overlapping chunks (own contract, also checked by
    property tests)."""
    ch = C.chunk_recursive(flagship_jobs(spark, sf), SIZE, OVERLAP)
    return ch.select(*_csel(), F.length("text").cast("long").alias("n_chars"))


@register("c2_fixed_chunks", f"""{_JOBS}, c AS {S.fixed_chunks(SIZE, OVERLAP)}
SELECT job_id, chunk_no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", ctext AS text FROM c""")
def c2_fixed_chunks(spark, sf):
    """Fixed-width overlapping chunks of every document."""
    return C.chunk_fixed(corpus_jobs(spark, sf), SIZE, OVERLAP).select(*_csel(), "text")


@register("c3_small_document_chunks", f"""{_JOBS},
small AS (SELECT job_id, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start, CAST(n AS BIGINT) AS "end",
                 length({S.text_page('text')}) > n AS is_html,
                 CASE WHEN length({S.text_page('text')}) > n THEN {S.text_page('text')} ELSE text END AS text
          FROM jobs WHERE n < {SIZE}),
big AS (SELECT job_id, chunk_no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", false AS is_html,
               ctext AS text FROM {S.fixed_chunks(SIZE, OVERLAP, '(SELECT * FROM jobs WHERE n >= ' + str(SIZE) + ')')})
SELECT * FROM small UNION ALL SELECT * FROM big""")
def c3_small_document_chunks(spark, sf):
    """Short documents bypass chunking (one chunk, HTML page if longer)."""
    ch = C.small_document_chunks(corpus_jobs(spark, sf), SIZE, OVERLAP, chunker=C.chunk_fixed)
    return ch.select(*_csel(), "is_html", "text")


@register("c4_label_chunks", f"""{_JOBS}, c AS {S.fixed_chunks(SIZE, OVERLAP)}
SELECT job_id, chunk_no, CAST(count(*) OVER (PARTITION BY job_id) AS BIGINT) AS n_chunks,
       CAST(chunk_no + 1 AS VARCHAR) || '/' || CAST(count(*) OVER (PARTITION BY job_id) AS VARCHAR) AS label FROM c""")
def c4_label_chunks(spark, sf):
    """C4: chunk count per job and the i/n label."""
    ch = C.label_chunks(C.chunk_fixed(corpus_jobs(spark, sf), SIZE, OVERLAP))
    return ch.select("job_id", F.col("chunk_no").cast("long"), F.col("n_chunks").cast("long"), "label")


@register("c5_output_budget", f"""{_JOBS}, c AS {S.fixed_chunks(SIZE, OVERLAP)}
SELECT job_id, chunk_no, CAST(least(length(ctext) + 500, 4000) AS BIGINT) AS max_tokens FROM c""")
def c5_output_budget(spark, sf):
    """Output token budget per chunk."""
    ch = C.output_budget(C.chunk_fixed(corpus_jobs(spark, sf), SIZE, OVERLAP))
    return ch.select("job_id", F.col("chunk_no").cast("long"), F.col("max_tokens").cast("long"))


# ====================================================================== P1-P5
def _scored(spark, sf):
    jobs = corpus_jobs(spark, sf)
    targets = T.target_sections(jobs, FIELDS, sep=SEP)
    chunks = C.chunk_fixed(jobs, SIZE, OVERLAP)
    return P.score_chunks(jobs, chunks, targets, MARKERS)


_SC = S.scored_chunks(SIZE, OVERLAP, FIELDS, K.ACTION_VERBS, SEP, MARKERS)


@register("p1_target_scores", f"""{_JOBS}, s AS {_SC}
SELECT job_id, chunk_no, target_score FROM s""")
def p1_target_scores(spark, sf):
    """Target score of every chunk (occurrence-mapped, no chunk x target pairs)."""
    sc = _scored(spark, sf)
    return sc.select("job_id", F.col("chunk_no").cast("long"), "target_score")


@register("p2_marker_scores", f"""{_JOBS}, c AS {S.fixed_chunks(SIZE, OVERLAP)}
SELECT job_id, chunk_no, {S.marker_score('ctext', MARKERS)} AS marker_score FROM c""")
def p2_marker_scores(spark, sf):
    """Structure-marker score of every chunk."""
    ch = P.score_markers(C.chunk_fixed(corpus_jobs(spark, sf), SIZE, OVERLAP), MARKERS)
    return ch.select("job_id", F.col("chunk_no").cast("long"), "marker_score")


@register("p3_rank_chunks", f"""{_JOBS}, s AS {_SC}
SELECT job_id, chunk_no, score,
       CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, chunk_no) AS BIGINT) AS rank FROM s""")
def p3_rank_chunks(spark, sf):
    """Chunks ranked by score, ties by document order."""
    sc = _scored(spark, sf)
    return P.rank_chunks(sc).select("job_id", F.col("chunk_no").cast("long"), "score", F.col("rank").cast("long"))


_GATE_SQL = f"""{_JOBS}, s AS {_SC},
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, chunk_no) AS rk,
             count(*) OVER (PARTITION BY job_id) AS nc FROM s),
g AS (SELECT job_id, chunk_no, score, (n >= {SIZE} AND nc >= 3 AND n_targets > 0) AS ranked, rk FROM r)
SELECT job_id, chunk_no, score, ranked, CAST(CASE WHEN ranked THEN rk ELSE chunk_no + 1 END AS BIGINT) AS rank FROM g"""


@register("p4_ranking_gate", _GATE_SQL)
def p4_ranking_gate(spark, sf):
    """Rank only long documents with > 2 chunks and some target."""
    g = P.apply_ranking_gate(P.rank_chunks(_scored(spark, sf)), SIZE)
    return g.select("job_id", F.col("chunk_no").cast("long"), "score", "ranked", F.col("rank").cast("long"))


@register("p5_top_chunks", f"SELECT * FROM ({_GATE_SQL}) WHERE rank <= 2")
def p5_top_chunks(spark, sf):
    """P5: the two best chunks of every job."""
    return p4_ranking_gate(spark, sf).where(F.col("rank") <= 2)
