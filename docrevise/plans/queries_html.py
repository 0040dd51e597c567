"""Registered HTML / layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.operators import html as H
from docrevise.operators import instructions as I
from docrevise.operators import revision as R
from docrevise.plans import fixtures as FX
from docrevise.plans import sqlparts as S
from docrevise.plans.queries import _JOBS, corpus_jobs
from docrevise.plans.registry import register, table

WS, DIGIT = S.WS, S.DIGIT


def _sql_upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def _sql_any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {S.lit(w)})" for w in words) + ")"


def _sql_escape3(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# ---------------------------------------------------------------- H1-H3
_LINES_SQL = f"""WITH spans AS {FX.sql_spans()},
lines AS (SELECT doc_id, page_no, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS text,
                 min(x0) AS x0, max(x1) AS x1,
                 bool_or(contains(lower(font), 'bold') OR (flags & {K.BOLD_FLAG}) <> 0) AS bold,
                 first(page_width) AS page_width, arg_min(origin_y, span_no) AS origin_y
          FROM spans GROUP BY ALL),
l2 AS (SELECT *, abs(x0 + (x1 - x0) / 2 - page_width / 2) < {K.CENTRE_TOLERANCE}
                 AND (x1 - x0) < page_width * {K.CENTRE_WIDTH_SHARE} AS centered FROM lines)"""

_HEADING = S.lit(rf"\A{DIGIT}+\.({DIGIT}+\.?)?{WS}+[A-Z]")
_CLAUSE = S.lit(rf"\A{DIGIT}+\.|\A[a-z]\)")
_CLASS_SQL = f"""{_LINES_SQL},
l3 AS (SELECT *, {S.strip('text')} AS st FROM l2),
cl AS (SELECT *, CASE WHEN length(st) = 0 THEN 'spacer'
                      WHEN {_sql_any_contains('text', K.LINE_SIGNATURE_WORDS)} THEN 'signature'
                      WHEN (bold OR {_sql_upper('text')} OR ends_with(st, ':') OR regexp_matches(st, {_HEADING}))
                           AND centered THEN 'h1'
                      WHEN (bold OR {_sql_upper('text')} OR ends_with(st, ':') OR regexp_matches(st, {_HEADING})) THEN 'h2'
                      WHEN regexp_matches(st, {_CLAUSE}) THEN 'clause'
                      WHEN x0 > {K.INDENT_X0} THEN 'indent' ELSE 'paragraph' END AS cls FROM l3)"""


def _spans(spark, sf):
    return FX.spans_from_documents(table(spark, sf, "documents"))


@register("h1_layout_lines", f"""{_LINES_SQL}
SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CAST(block_no AS BIGINT) AS block_no,
       CAST(line_no AS BIGINT) AS line_no, text, x0, x1, bold, centered FROM l2""")
def h1_layout_lines(spark, sf):
    """H1: positioned spans -> lines with extent, bold and centring."""
    ln = H.layout_lines(_spans(spark, sf))
    return ln.select("doc_id", *[F.col(c).cast("long") for c in ("page_no", "block_no", "line_no")],
                     "text", "x0", "x1", "bold", "centered")


@register("h2_classify_lines", f"""{_CLASS_SQL}
SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CAST(block_no AS BIGINT) AS block_no,
       CAST(line_no AS BIGINT) AS line_no, cls FROM cl""")
def h2_classify_lines(spark, sf):
    """H2: line classes (spacer, signature, h1/h2, clause, indent, paragraph)."""
    c = H.classify_lines(H.layout_lines(_spans(spark, sf)))
    return c.select("doc_id", *[F.col(x).cast("long") for x in ("page_no", "block_no", "line_no")], "cls")


def _sql_line_element() -> str:
    eid = "'elem_' || CAST(page_no AS VARCHAR) || '_' || CAST(block_no AS VARCHAR) || '_' || CAST(origin_y AS VARCHAR)"
    esc = S.html_escape("text")
    return (f"CASE WHEN cls = 'spacer' THEN {S.lit(H.SPACER_DIV)} "
            f"WHEN cls = 'h1' THEN '<h1 id=\"' || {eid} || '\" class=\"heading\" align=\"center\">' || {esc} || '</h1>' "
            f"WHEN cls = 'h2' THEN '<h2 id=\"' || {eid} || '\" class=\"heading\">' || {esc} || '</h2>' "
            f"ELSE '<div id=\"' || {eid} || '\" class=\"' || cls || '\">' || {esc} || '</div>' END")


@register("h3_render_lines", f"""{_CLASS_SQL},
el AS (SELECT doc_id, page_no, block_no, line_no, {_sql_line_element()} AS el FROM cl)
SELECT doc_id, {S.lit(chr(10).join(H.PAGE_HEAD_LINES) + chr(10))}
       || string_agg(el, chr(10) ORDER BY page_no, block_no, line_no) || chr(10) || {S.lit(H.PAGE_TAIL)} AS html
FROM el GROUP BY doc_id""")
def h3_render_lines(spark, sf):
    """H3: classified lines -> one HTML page per document."""
    return H.render_lines(H.classify_lines(H.layout_lines(_spans(spark, sf))))


# ---------------------------------------------------------------- H4-H8 on responses
def _responses(spark, sf):
    return FX.responses_from_conversations(table(spark, sf, "conversations"))


def _sql_clean(x: str) -> str:
    s = S.strip(x)
    s1 = (f"CASE WHEN starts_with({s}, '\"') AND ends_with({s}, '\"') "
          f"THEN substring({s}, 2, greatest(length({s}) - 2, 0)) ELSE {s} END")
    s2 = f"CASE WHEN starts_with(s1, '```html') THEN substring(s1, 8) ELSE s1 END"
    s3 = f"CASE WHEN ends_with(s2, '```') THEN substring(s2, 1, length(s2) - 3) ELSE s2 END"
    return s1, s2, s3


_S1, _S2, _S3 = _sql_clean("response")
_CLEAN_SQL = f"""WITH r AS {FX.sql_responses()},
a AS (SELECT *, {_S1} AS s1 FROM r), b AS (SELECT *, {_S2} AS s2 FROM a), c AS (SELECT *, {_S3} AS s3 FROM b),
cleaned AS (SELECT conv_id, turn, original, {S.strip('s3')} AS cleaned FROM c)"""


@register("h4_clean_response", f"""{_CLEAN_SQL}
SELECT conv_id, turn, cleaned FROM cleaned""")
def h4_clean_response(spark, sf):
    """H4: strip wrapping quotes and html code fences from responses."""
    r = _responses(spark, sf)
    return r.select("conv_id", "turn", H.clean_response(F.col("response")).alias("cleaned"))


_IS_HTML = "(contains(cleaned, '<!DOCTYPE') OR contains(cleaned, '<html') OR (contains(cleaned, '<div') AND contains(cleaned, '</div>')))"


@register("h5_wrap_html", f"""{_CLEAN_SQL}
SELECT conv_id, turn, {_IS_HTML} AS is_html,
       CASE WHEN NOT {_IS_HTML} THEN NULL
            WHEN starts_with(cleaned, '<!DOCTYPE') OR starts_with(cleaned, '<html') THEN cleaned
            ELSE {S.lit(H.WRAP_HEAD)} || cleaned || {S.lit(H.WRAP_TAIL)} END AS page FROM cleaned""")
def h5_wrap_html(spark, sf):
    """H5: detect HTML responses and wrap fragments in the page frame."""
    r = _responses(spark, sf).withColumn("cleaned", H.clean_response(F.col("response")))
    return r.select("conv_id", "turn", H.is_html_response(F.col("cleaned")).alias("is_html"),
                    H.wrap_html(F.col("cleaned")).alias("page"))


def _sql_html_to_text(x: str) -> str:
    s = f"regexp_replace({x}, {S.lit(H.markup())}, '', 'g')"
    for k, v in H.ENTITIES:
        s = f"replace({s}, {S.lit(k)}, {S.lit(v)})"
    return f"replace({s}, '&amp;', '&')"


@register("h6_html_to_text", f"""SELECT page_id, {_sql_html_to_text('html')} AS text FROM pages""")
def h6_html_to_text(spark, sf):
    """H6: visible text of every web page (comments, scripts, styles, tags removed)."""
    p = table(spark, sf, "pages")
    return p.select("page_id", H.html_to_text(F.col("html")).alias("text"))


@register("h7_guard_short", f"""{_CLEAN_SQL}
SELECT conv_id, turn, length(cleaned) < length(original) * {K.SHORT_RESPONSE_SHARE} AS keep_original FROM cleaned""")
def h7_guard_short(spark, sf):
    """H7: keep the original when the cleaned response is under 30% of it."""
    r = _responses(spark, sf).withColumn("cleaned", H.clean_response(F.col("response")))
    return r.select("conv_id", "turn", H.guard_short(F.col("cleaned"), F.col("original")).alias("keep_original"))


def _sql_para_class(p: str) -> str:
    nw = f"len({S.pysplit(p)})"
    return (f"CASE WHEN upper({p}) = {p} AND {nw} <= 5 THEN 'h1' "
            f"WHEN ends_with({p}, ':') OR ({_sql_upper(p)} AND {nw} <= 8) THEN 'h2' "
            f"WHEN {_sql_any_contains(p, K.PARAGRAPH_SIGNATURE_WORDS)} THEN 'signature' "
            f"WHEN regexp_matches({p}, '\\A[1-9]') AND contains(substring({p}, 1, 10), '.') THEN 'clause' "
            f"ELSE 'paragraph' END")


@register("h8_rebuild_html", f"""{_CLEAN_SQL},
sp AS (SELECT conv_id, turn, string_split(cleaned, chr(10)) AS l FROM cleaned),
u AS (SELECT conv_id, turn, l, unnest(generate_series(1, len(l))) AS i FROM sp),
p AS (SELECT conv_id, turn, i, {S.strip('l[i]')} AS p FROM u),
e AS (SELECT conv_id, turn, i, {_sql_para_class('p')} AS cls, {_sql_escape3('p')} AS t FROM p WHERE length(p) > 0),
f AS (SELECT conv_id, turn, i, CASE WHEN cls = 'h1' THEN '<h1 class="heading" style="text-align: center;">' || t || '</h1>'
                                    WHEN cls = 'h2' THEN '<h2 class="heading">' || t || '</h2>'
                                    ELSE '<div class="' || cls || '">' || t || '</div>' END AS el FROM e)
SELECT conv_id, turn, {S.lit(chr(10).join(H.PAGE_HEAD_LINES))} || string_agg(el, '' ORDER BY i) || {S.lit(H.PAGE_TAIL)} AS html
FROM f GROUP BY conv_id, turn""")
def h8_rebuild_html(spark, sf):
    """H8: plain responses -> pages with one element per paragraph (newline paragraphs)."""
    r = _responses(spark, sf).withColumn("cleaned", H.clean_response(F.col("response")))
    return H.rebuild_html(r, ["conv_id", "turn"], "cleaned", sep="\n")


_PIECES = S.lit(H.markup() + "|[^<]+|<")
_BODY, _BODY_END = (S.lit(x.replace("\\A", "^").replace("\\z", "$")) for x in (H.BODY, H.BODY_END))


@register("h8b_rebuild_page", f"""WITH a AS (SELECT page_id, html, regexp_extract_all(html, {_PIECES}) AS p FROM pages WHERE html IS NOT NULL),
b AS (SELECT *, coalesce(list_position(list_transform(p, lambda x: regexp_matches(x, {_BODY})), true), 0) AS f,
             coalesce(list_position(list_transform(list_reverse(p), lambda x: regexp_matches(x, {_BODY_END})), true), 0) AS k FROM a),
c AS (SELECT *, CASE WHEN k > 0 AND len(p) + 1 - k > f THEN len(p) + 1 - k ELSE len(p) + 1 END AS l FROM b)
SELECT page_id, CASE WHEN f = 0 THEN html ELSE array_to_string(p[1:f], '') || '<h2 class="heading">Page:</h2><div class="paragraph">revised '
       || CAST(page_id AS VARCHAR) || ' a&lt;b</div>' || array_to_string(p[l:], '') END AS html FROM c""")
def h8b_rebuild_page(spark, sf):
    """H8, page form: the body of every web page replaced by a response; head,
    attributes and everything outside the body stay."""
    p = table(spark, sf, "pages").where("html is not null")
    response = F.concat(F.lit("Page:\n\nrevised "), F.col("page_id").cast("string"), F.lit(" a<b"))
    return H.rebuild_html(p.select("page_id", "html", response.alias("cleaned")), ["page_id"], "cleaned", page_col="html")


# ---------------------------------------------------------------- H9-H10 on documents
_ALIGN_SQL = f"""{_JOBS},
resp AS (SELECT job_id, {S.literal_revise('text', S.pairs_list('instruction'))} AS text FROM jobs),
ol AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT job_id, string_split(text, chr(10)) AS l FROM jobs)),
o AS (SELECT job_id, o, min(i) AS oi FROM (SELECT job_id, i, {S.strip('l[i]')} AS o FROM ol) WHERE length(o) > 0 GROUP BY ALL),
ml AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT job_id, string_split(text, chr(10)) AS l FROM resp)),
m0 AS (SELECT job_id, m, max(i) AS mj FROM (SELECT job_id, i, {S.strip('l[i]')} AS m FROM ml) WHERE length(m) > 0 GROUP BY ALL),
m AS (SELECT * FROM m0 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.job_id = m0.job_id AND o.o = m0.m)),
c AS (SELECT m.job_id, m.m, m.mj, o.o, o.oi FROM m JOIN o USING (job_id)
      WHERE abs(length(o.o) - length(m.m)) <= least(length(o.o), length(m.m)) * 0.3
        AND lower(left(o.o, least(length(o.o), length(m.m), 10))) = lower(left(m.m, least(length(o.o), length(m.m), 10)))),
f AS (SELECT job_id, m, mj, arg_min(o, oi) AS o FROM c GROUP BY ALL),
repl AS (SELECT job_id, o AS old, arg_max(m, mj) AS new FROM f GROUP BY ALL)"""


def _align(spark, sf):
    jobs = corpus_jobs(spark, sf).withColumn("pairs", I.replacement_pairs_array(F.col("instruction")))
    resp = jobs.select("job_id", R.literal_revise("text", "pairs").alias("text"))
    return jobs, H.align_lines(jobs.select("job_id", "text"), resp)


@register("h9_align_lines", f"""{_ALIGN_SQL}
SELECT job_id, old, new FROM repl""")
def h9_align_lines(spark, sf):
    """H9: line replacements found by aligning revised text to the original."""
    return _align(spark, sf)[1]


@register("h10_apply_replacements", f"""{_ALIGN_SQL},
dl AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT job_id, string_split(text, chr(10)) AS l FROM jobs)),
d AS (SELECT job_id, i, l[i] AS line, {S.strip('l[i]')} AS old FROM dl)
SELECT d.job_id, string_agg(coalesce(r.new, d.line), chr(10) ORDER BY d.i) AS text
FROM d LEFT JOIN repl r ON r.job_id = d.job_id AND r.old = d.old GROUP BY d.job_id""")
def h10_apply_replacements(spark, sf):
    """Apply aligned line replacements to the original document lines."""
    jobs, repl = _align(spark, sf)
    return H.apply_replacements(jobs.select("job_id", "text"), repl)


# ---------------------------------------------------------------- H11 styles
def _styles_sql(variant: str) -> str:
    p = S.strip("l[i]")
    w = S.pysplit("l[i]")
    if variant == "hosted":
        st = f"CASE WHEN length({p}) = 0 THEN 'spacer' WHEN {_sql_upper(p)} AND len({w}) <= 8 THEN 'heading' ELSE 'normal' END"
    else:
        first = f"substring(({w})[1], 1, 1)"
        heading = f"({_sql_upper(p)} OR ends_with({p}, ':') OR (len({w}) <= 8 AND coalesce({_sql_upper(first)}, false)))"
        st = (f"CASE WHEN length({p}) = 0 THEN 'spacer' WHEN {_sql_any_contains(p, K.LINE_SIGNATURE_WORDS)} THEN 'signature' "
              f"WHEN {heading} THEN 'heading' ELSE 'normal' END")
    return f"""WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM a)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS p_ord, {st} AS style FROM b"""


@register("h11_paragraph_styles", _styles_sql("hosted"))
def h11_paragraph_styles(spark, sf):
    """Hosted-variant paragraph styles of every document line."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    s = H.paragraph_styles(d, ["doc_id"], "text", "\n", "hosted")
    return s.select("doc_id", F.col("p_ord").cast("long"), "style")


@register("h11b_paragraph_styles_self_hosted", _styles_sql("self"))
def h11b_paragraph_styles_self_hosted(spark, sf):
    """Self-hosted-variant paragraph styles (signature / heading / normal)."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    s = H.paragraph_styles(d, ["doc_id"], "text", "\n", "self")
    return s.select("doc_id", F.col("p_ord").cast("long"), "style")


# ---------------------------------------------------------------- H12 complexity
def _cnt(p: str) -> str:
    return f"len(regexp_extract_all(html, {S.lit(p)}))"


@register("h12_layout_complexity", f"""WITH f AS (
  SELECT page_id, CAST({_cnt(r'(?i)<(article|nav|aside)\b')} AS BIGINT) AS column_count,
         {_cnt(r'(?i)<table\b')} > 0 AS has_tables, {_cnt(r'(?i)<form\b')} > 0 AS has_forms,
         length({_sql_html_to_text('html')}) > length(html) * 0.5 AS high_text_density FROM pages),
g AS (SELECT *, CAST(1 + column_count + 3 * CAST(has_tables AS INT) + 2 * CAST(has_forms AS INT)
                     + 2 * CAST(high_text_density AS INT) AS BIGINT) AS complexity FROM f),
h AS (SELECT *, CASE WHEN has_tables THEN 'table_heavy' WHEN column_count > 1 THEN 'multi_column'
                     WHEN has_forms THEN 'form_based' WHEN complexity < 3 THEN 'standard' ELSE 'mixed' END AS layout_type FROM g)
SELECT *, CASE WHEN complexity < 3 AND layout_type = 'standard' THEN 'standard_extraction'
               WHEN layout_type = 'table_heavy' THEN 'table_focused_processing'
               WHEN layout_type = 'multi_column' THEN 'column_aware_processing'
               WHEN layout_type = 'form_based' THEN 'form_preserving_processing' ELSE 'hybrid_processing' END AS strategy
FROM h""")
def h12_layout_complexity(spark, sf):
    """Documented complexity score, layout type and strategy per page."""
    f = H.page_features(table(spark, sf, "pages"))
    return H.layout_complexity(f).select("page_id", F.col("column_count").cast("long"), "has_tables", "has_forms",
                                         "high_text_density", "complexity", "layout_type", "strategy")
