"""HTML and layout: H1-H12.

Pages, lines and paragraphs are rows; a rendered page is assembled by one
ordered aggregation per document.  No HTML parser runs per row: tags are
removed with ordered regex passes (H6), layout comes from a spans table
(H1-H3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import DIGIT, WS, html_escape, is_upper, py_split, py_strip, str_array

# Page frame of rendered layouts (H3) and of wrapped responses (H5).
PAGE_HEAD_LINES = [
    "<!DOCTYPE html><html><head><style>",
    "body { font-family: Times New Roman, serif; font-size: 11pt; line-height: 1.5; }",
    ".section { margin-top: 10px; margin-bottom: 10px; }",
    ".signature { margin-top: 20px; margin-bottom: 20px; }",
    ".heading { font-weight: bold; }",
    ".indent { margin-left: 20px; }",
    ".clause { margin-top: 10px; margin-bottom: 10px; }",
    ".paragraph { margin-top: 6px; margin-bottom: 6px; }",
    "</style></head><body>",
]
PAGE_TAIL = "</body></html>"
SPACER_DIV = '<div style="height: 12px;"></div>'
WRAP_HEAD = (
    "<!DOCTYPE html>\n<html>\n<head>\n    <style>\n"
    "        body { font-family: Times New Roman, serif; font-size: 11pt; line-height: 1.5; }\n"
    "        .section { margin-top: 10px; margin-bottom: 10px; }\n"
    "        .signature { margin-top: 20px; margin-bottom: 20px; }\n"
    "        .heading { font-weight: bold; }\n"
    "        .indent { margin-left: 20px; }\n"
    "        .clause { margin-top: 10px; margin-bottom: 10px; }\n"
    "        .paragraph { margin-top: 6px; margin-bottom: 6px; }\n"
    "    </style>\n</head>\n<body>\n"
)
WRAP_TAIL = "\n</body>\n</html>"

HEADING_NUMBER = rf"\A{DIGIT}+\.({DIGIT}+\.?)?{WS}+[A-Z]"
CLAUSE_LINE = rf"\A{DIGIT}+\.|\A[a-z]\)"


# ---------------------------------------------------------------- H1 spans -> lines
def layout_lines(spans: DataFrame, centre_tol: float = K.CENTRE_TOLERANCE,
                 width_share: float = K.CENTRE_WIDTH_SHARE, bold_flag: int = K.BOLD_FLAG,
                 by_doc: bool = True) -> DataFrame:
    """H1: one row per (doc, page, block, line): text in span order, x0/x1,
    bold (font name contains "bold" or the bold flag bit), centred.

    With ``by_doc`` the spans are hash-partitioned by document once, so the
    line aggregation here and the page assembly of H3 share one exchange."""
    bold = F.call_function("contains", F.lower(F.col("font")), F.lit("bold")) | ((F.col("flags").bitwiseAND(bold_flag)) != 0)
    if by_doc:
        spans = spans.repartition("doc_id")
    g = spans.groupBy("doc_id", "page_no", "block_no", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("span_no", "text"))).alias("s"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.bool_or(bold).alias("bold"),
        F.first("page_width").alias("page_width"), F.min_by("origin_y", "span_no").alias("origin_y"))
    width = F.col("x1") - F.col("x0")
    centre = F.col("x0") + width / 2
    return g.select("doc_id", "page_no", "block_no", "line_no",
                    F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"),
                    "x0", "x1", "bold", "origin_y",
                    ((F.abs(centre - F.col("page_width") / 2) < centre_tol) & (width < F.col("page_width") * width_share)).alias("centered"))


# ---------------------------------------------------------------- H2 line classes
def line_class(text: Column, bold: Column, centered: Column, x0: Column, signature_words=None,
               indent_x0: float = K.INDENT_X0) -> Column:
    sig = signature_words or K.LINE_SIGNATURE_WORDS
    st = py_strip(text)
    is_sig = F.exists(str_array(sig), lambda w: F.call_function("contains", F.lower(text), w))
    heading = bold | is_upper(text) | F.endswith(st, F.lit(":")) | st.rlike(HEADING_NUMBER)
    clause = st.rlike(CLAUSE_LINE)
    return (F.when(F.length(st) == 0, "spacer").when(is_sig, "signature")
            .when(heading & centered, "h1").when(heading, "h2").when(clause, "clause")
            .when(x0 > indent_x0, "indent").otherwise("paragraph"))


def classify_lines(lines: DataFrame, signature_words=None) -> DataFrame:
    """H2: spacer, signature, heading (h1 centred / h2), clause, indent, paragraph."""
    return lines.withColumn("cls", line_class(F.col("text"), F.col("bold"), F.col("centered"), F.col("x0"),
                                              signature_words))


# ---------------------------------------------------------------- H3 render
def line_element(cls: Column, text: Column, elem_id: Column) -> Column:
    esc = html_escape(text)
    return (F.when(cls == "spacer", F.lit(SPACER_DIV))
            .when(cls == "h1", F.concat(F.lit('<h1 id="'), elem_id, F.lit('" class="heading" align="center">'), esc, F.lit("</h1>")))
            .when(cls == "h2", F.concat(F.lit('<h2 id="'), elem_id, F.lit('" class="heading">'), esc, F.lit("</h2>")))
            .otherwise(F.concat(F.lit('<div id="'), elem_id, F.lit('" class="'), cls, F.lit('">'), esc, F.lit("</div>"))))


def render_lines(classified: DataFrame) -> DataFrame:
    """H3: (doc_id, html): the page frame, then one element per line in
    page / block / line order, joined by newlines."""
    eid = F.concat(F.lit("elem_"), F.col("page_no").cast("string"), F.lit("_"), F.col("block_no").cast("string"),
                   F.lit("_"), F.col("origin_y").cast("string"))
    el = classified.withColumn("el", line_element(F.col("cls"), F.col("text"), eid))
    g = el.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "block_no", "line_no", "el"))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["el"]), "\n")
    head = "\n".join(PAGE_HEAD_LINES)
    return g.select("doc_id", F.concat(F.lit(head + "\n"), body, F.when(F.size("a") > 0, F.lit("\n")).otherwise(F.lit("")),
                                       F.lit(PAGE_TAIL)).alias("html"))


# ---------------------------------------------------------------- H4 clean
def clean_response(resp: Column) -> Column:
    """H4: strip; drop one pair of wrapping double quotes; drop a leading
    ```html and a trailing ```; strip again."""
    s = py_strip(resp)
    quoted = F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))
    s = F.when(quoted, F.call_function("substring", s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s)
    s = F.when(F.startswith(s, F.lit("```html")), F.call_function("substring", s, F.lit(8))).otherwise(s)
    s = F.when(F.endswith(s, F.lit("```")), F.call_function("substring", s, F.lit(1), F.length(s) - 3)).otherwise(s)
    return py_strip(s)


# ---------------------------------------------------------------- H5 wrap
def is_html_response(c: Column) -> Column:
    has = lambda t: F.call_function("contains", c, F.lit(t))
    return has("<!DOCTYPE") | has("<html") | (has("<div") & has("</div>"))


def wrap_html(c: Column) -> Column:
    """H5: an HTML response is used as is when it starts a document, else it
    is wrapped in the page frame; returns null for a non-HTML response."""
    starts = F.startswith(c, F.lit("<!DOCTYPE")) | F.startswith(c, F.lit("<html"))
    return (F.when(~is_html_response(c), F.lit(None).cast("string"))
            .when(starts, c).otherwise(F.concat(F.lit(WRAP_HEAD), c, F.lit(WRAP_TAIL))))


# ---------------------------------------------------------------- H6 html -> text
#: The rest of a tag: a quoted attribute value may hold ">"; a quote that is
#: never closed is an ordinary character.
ATTRIBUTES = r"""(?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*"""
#: The same for Java: possessive, because it never needs to go back.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""


def markup(attributes: str = ATTRIBUTES) -> str:
    """What is not text: comments, whole scripts and styles, tags.  One pattern
    read from left to right, so each knows nothing of what stands inside
    another."""
    return (rf"(?is)<!--.*?-->|<script\b{attributes}>.*?</script\s*>|<style\b{attributes}>.*?</style\s*>|<[a-z/!?]{attributes}>|<[^>]*>")


# Entities replaced first by H6; the others follow in one pass.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")]
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|amp|apos);"
# What HTML reads for &#128; to &#159; (Windows-1252 where that has a character).
C1_CHARS = [bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0)]


def reference_char(ref: Column) -> Column:
    """The character of one ``REFERENCE``: zero, surrogates and
    numbers beyond U+10FFFF are U+FFFD."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*);$", 1)
    short = F.when(F.length(digits) <= 7, digits).otherwise("0")
    n = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10))
    n = F.coalesce(n, F.lit("0")).cast("bigint")
    return (F.when(ref == "&amp;", "&").when(ref == "&apos;", "'")
            .when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.between(0x80, 0x9F), F.get(F.lit(C1_CHARS), (n - 0x80).cast("int")))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def html_to_text(c: Column) -> Column:
    """H6: comments, scripts and styles with their bodies, and tags are removed
    in one pass from left to right; then the entities above are replaced, and
    in one last pass ``&amp;``, ``&apos;`` and every decimal or hexadecimal
    character reference."""
    s = F.regexp_replace(c, markup(_ATTRIBUTES), "")
    for k, v in ENTITIES:
        s = F.replace(s, F.lit(k), F.lit(v))

    def decoded(x: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0)), reference_char)
        pieces = F.zip_with(F.split(x, REFERENCE, -1), chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(x.rlike("&(?:#|apos;)"), F.array_join(pieces, "")).otherwise(F.replace(x, F.lit("&amp;"), F.lit("&")))
    return F.element_at(F.transform(F.array(s), decoded), 1)  # s is evaluated once


# ---------------------------------------------------------------- H7 short guard
def guard_short(cleaned: Column, original_text: Column, share: float = K.SHORT_RESPONSE_SHARE) -> Column:
    """H7: true when the cleaned response is shorter than ``share`` of the
    original text (the original HTML is then kept)."""
    return F.length(cleaned) < F.length(original_text) * share


# ---------------------------------------------------------------- H8 rebuild
def paragraph_class(p: Column, signature_words=None) -> Column:
    sig = signature_words or K.PARAGRAPH_SIGNATURE_WORDS
    nwords = F.size(py_split(p))
    is_sig = F.exists(str_array(sig), lambda w: F.call_function("contains", F.lower(p), w))
    first10 = F.call_function("substring", p, F.lit(1), F.lit(10))
    clause = p.rlike(r"\A[1-9]") & F.call_function("contains", first10, F.lit("."))
    return (F.when((F.upper(p) == p) & (nwords <= 5), "h1")
            .when(F.endswith(p, F.lit(":")) | (is_upper(p) & (nwords <= 8)), "h2")
            .when(is_sig, "signature").when(clause, "clause").otherwise("paragraph"))


def _text_escape(c: Column) -> Column:
    s = F.replace(c, F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    return F.replace(s, F.lit(">"), F.lit("&gt;"))


# A page cut into comments, whole scripts and styles, tags and text; the pieces together are the page.
PIECE = markup(_ATTRIBUTES) + "|[^<]+|<"
BODY, BODY_END = r"(?is)\A<body(?:[\s/].*)?>\z", r"(?is)\A</body\s*>\z"


def body_bounds(pieces: Column) -> tuple[Column, Column]:
    """Numbers (from 1) of the first body tag, 0 without one, and of the last
    closing one after it, one past the end without one."""
    first = F.array_position(F.transform(pieces, lambda x: x.rlike(BODY)), True)
    back = F.array_position(F.transform(F.reverse(pieces), lambda x: x.rlike(BODY_END)), True)
    last = F.size(pieces) + 1 - back
    return first, F.when((back > 0) & (last > first), last).otherwise(F.size(pieces) + 1)


def replace_body(page: Column, body: Column) -> Column:
    """``page`` with ``body`` between its body tags, everything else as it is;
    a page without a body stays as it is."""
    def put(pieces: Column) -> Column:
        first, last = (x.cast("int") for x in body_bounds(pieces))
        head, tail = F.slice(pieces, F.lit(1), first), F.slice(pieces, last, F.size(pieces))
        return F.when(first > 0, F.concat(F.array_join(head, ""), body, F.array_join(tail, ""))).otherwise(page)
    return F.element_at(F.transform(F.array(F.regexp_extract_all(page, F.lit(PIECE), F.lit(0))), put), 1)


def paragraph_elements(text: Column, sep: str = "\n\n") -> Column:
    """H8: split on ``sep``, strip, drop empties, one element per paragraph
    (h1 / h2 / signature / clause / paragraph), as an array."""
    def element(p: Column) -> Column:
        cls = paragraph_class(p)
        return (F.when(cls == "h1", F.concat(F.lit('<h1 class="heading" style="text-align: center;">'), _text_escape(p), F.lit("</h1>")))
                .when(cls == "h2", F.concat(F.lit('<h2 class="heading">'), _text_escape(p), F.lit("</h2>")))
                .otherwise(F.concat(F.lit('<div class="'), cls, F.lit('">'), _text_escape(p), F.lit("</div>"))))
    parts = F.filter(F.transform(F.split(text, sep, -1), py_strip), lambda p: F.length(p) > 0)
    return F.transform(parts, element)


def rebuilt_page(text: Column, page: Column | None = None, sep: str = "\n\n") -> Column:
    """H8 in one row: the paragraphs of ``text`` in our page frame (null where
    there are none), or, where ``page`` is given, as the body of that page."""
    elements = paragraph_elements(text, sep)
    framed = F.concat(F.lit("\n".join(PAGE_HEAD_LINES)), F.array_join(elements, ""), F.lit(PAGE_TAIL))
    framed = F.when(F.size(elements) > 0, framed)
    if page is None:
        return framed
    return F.when(page.isNull(), framed).otherwise(replace_body(page, F.coalesce(F.array_join(elements, ""), F.lit(""))))


def rebuild_html(df: DataFrame, key: list[str], text_col: str = "cleaned", sep: str = "\n\n", page_col: str | None = None) -> DataFrame:
    """H8: plain response -> page: split on ``sep``, strip, drop empties, one
    element per paragraph (h1 / h2 / signature / clause / paragraph).  With
    ``page_col`` the elements replace the body of that original page (also
    when there are none); where it is null, and without it, the page frame is
    ours.  (The reference's indent branch tests a stripped paragraph for
    leading blanks and can never fire; it is left out.)"""
    out = df.select(*key, rebuilt_page(F.col(text_col), F.col(page_col) if page_col else None, sep).alias("html"))
    return out if page_col else out.where("html is not null")


# ---------------------------------------------------------------- H9 align lines
def _lines(df: DataFrame, key: str, text_col: str, idx: str, out: str) -> DataFrame:
    x = df.select(key, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias(idx, "raw"))
    return x.select(key, idx, py_strip(F.col("raw")).alias(out)).where(F.length(out) > 0)


def _changed_keys(orig: DataFrame, resp: DataFrame, key: str) -> DataFrame:
    """The keys whose response may hold a line that their original lacks: the
    texts differ and so do their sets of lines; keys of several rows all count."""
    def lines(c: str) -> Column:
        return F.transform(F.split(F.col(c), "\n", -1), py_strip)
    one = orig.groupBy(key).agg(F.count(F.lit(1)).alias("_no"), F.first("text").alias("_o"))
    other = resp.groupBy(key).agg(F.count(F.lit(1)).alias("_nm"), F.first("text").alias("_m"))
    differs = F.when(F.col("_o") != F.col("_m"), F.size(F.array_except(lines("_m"), lines("_o"))) > 0)
    return one.join(other, key).where((F.col("_no") > 1) | (F.col("_nm") > 1) | differs).select(key)


def align_lines(orig: DataFrame, resp: DataFrame, key: str = "job_id", share: float = 0.3,
                prefix: int = 10) -> DataFrame:
    """H9: (key, old, new) line replacements, response vs original.

    A response line that equals an original line adds nothing.  Otherwise
    its partner is the first original line whose length differs by at most
    ``share`` of the shorter one and whose first min(len, len, 10)
    characters agree ignoring case.  A later response line wins for the same
    original line.  Lines are deduplicated by text first; the prefix test is
    an equi-join on (key, lower(prefix)) - one join for full prefixes and one
    per shorter prefix length - never a pairing of all lines.  Texts are
    compared whole first; only those with a new line are cut into rows.
    """
    changed = _changed_keys(orig, resp, key).hint("shuffle_hash")
    orig, resp = orig.join(changed, key, "left_semi"), resp.join(changed, key, "left_semi")
    o = (_lines(orig, key, "text", "i", "o").groupBy(key, "o").agg(F.min("i").alias("oi")))
    m = (_lines(resp, key, "text", "j", "m").groupBy(key, "m").agg(F.max("j").alias("mj")))
    m = m.join(o.select(key, F.col("o").alias("m")), [key, "m"], "left_anti")
    # The compared prefix is min(len o, len m, prefix) long.  Each side emits
    # exactly the keys under which that prefix can be found, tagged by case:
    #   A: both lines have >= prefix characters   (one key each)
    #   B: the original line is the shorter one  (o: its whole text, m: its 1..prefix-1 prefixes)
    #   C: the response line is strictly shorter (m: its whole text, o: its 1..prefix-1 prefixes)
    # so a single equi-join finds every pair whose prefixes agree, once.
    def keys(col, short_tag, long_tag, strict):
        c, n = F.col(col), F.length(col)
        k = lambda tag, p: F.struct(F.lit(tag).alias("tag"), p.cast("int").alias("p"),
                                    F.lower(F.call_function("left", c, p)).alias("pk"))
        upto = F.least(n - 1, F.lit(prefix - 1)) if strict else F.least(n, F.lit(prefix - 1))
        # a shorter line of p characters is a partner only if the lengths are near
        near = F.filter(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda p: n - p <= p * share)
        longs = F.when((upto >= 1) & (n - prefix + 1 <= (prefix - 1) * share), F.transform(near, lambda p: k(long_tag, p)))
        return F.concat(
            F.when(n >= prefix, F.array(k("A", F.lit(prefix)))).otherwise(F.array().cast("array<struct<tag:string,p:int,pk:string>>")),
            F.when(n < prefix, F.array(k(short_tag, n))).otherwise(F.array().cast("array<struct<tag:string,p:int,pk:string>>")),
            F.coalesce(longs, F.array().cast("array<struct<tag:string,p:int,pk:string>>")))
    ok = o.select(key, "o", "oi", F.explode(keys("o", "B", "C", strict=True)).alias("k")).select(key, "o", "oi", "k.*")
    mk = m.select(key, "m", "mj", F.explode(keys("m", "C", "B", strict=False)).alias("k")).select(key, "m", "mj", "k.*")
    # The match test depends only on the prefix key and the two lengths, so
    # among originals with the same key and length only the first can win, and
    # all responses with the same key and length get the same partner: join
    # (key, length) classes, not lines.
    ok = (ok.withColumn("ol", F.length("o")).groupBy(key, "tag", "p", "pk", "ol")
          .agg(F.min_by("o", "oi").alias("o"), F.min("oi").alias("oi")))
    ml = mk.withColumn("ml", F.length("m"))
    classes = ml.select(key, "tag", "p", "pk", "ml").distinct()
    cand = ok.join(classes, [key, "tag", "p", "pk"])
    cand = cand.where(F.abs(F.col("ol") - F.col("ml")) <= F.least(F.col("ol"), F.col("ml")) * share)
    best = cand.groupBy(key, "tag", "p", "pk", "ml").agg(F.min_by("o", "oi").alias("o"), F.min("oi").alias("oi"))
    per_m = ml.join(best, [key, "tag", "p", "pk", "ml"])
    first = per_m.groupBy(key, "m", "mj").agg(F.min_by("o", "oi").alias("o"))
    return first.groupBy(key, "o").agg(F.max_by("m", "mj").alias("new")).select(key, F.col("o").alias("old"), "new")


# ---------------------------------------------------------------- H10 apply
def apply_to_page(pages: DataFrame, repl: DataFrame, key: str = "job_id", page_col: str = "html") -> DataFrame:
    """H10 on pages: replace every text node of the body whose stripped,
    decoded text equals a key by its new text, escaped; returns (key, html).
    All other pieces, and a page without a body, stay as they are; null is empty."""
    x = pages.select(key, F.regexp_extract_all(F.coalesce(F.col(page_col), F.lit("")), F.lit(PIECE), F.lit(0)).alias("pieces"))
    first, last = body_bounds(F.col("pieces"))
    x = x.select(key, first.alias("first"), last.alias("last"), F.posexplode_outer("pieces").alias("i", "piece"))
    inside = (F.col("first") > 0) & (F.col("i") + 1 > F.col("first")) & (F.col("i") + 1 < F.col("last")) & ~F.startswith(F.col("piece"), F.lit("<"))
    x = x.withColumn("old", F.when(inside, py_strip(html_to_text(F.col("piece")))))
    x = x.join(repl, [key, "old"], "left").withColumn("out", F.coalesce(_text_escape(F.col("new")), F.col("piece"), F.lit("")))
    g = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "out"))).alias("a"))
    return g.select(key, F.array_join(F.transform("a", lambda e: e["out"]), "").alias("html"))


def apply_replacements(docs: DataFrame, repl: DataFrame, key: str = "job_id") -> DataFrame:
    """H10 on plain text: replace every line whose stripped text equals a key
    by its new text; returns (key, text) with lines joined by newlines."""
    # a text without replacements that is its key's only one leaves as it came
    docs = docs.select(key, "text").where("text is not null")
    several = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    cut = repl.select(key).union(several).where(F.col(key).isNotNull()).distinct().hint("shuffle_hash")
    whole = docs.where(F.col(key).isNotNull()).join(cut, key, "left_anti")
    docs = docs.join(cut, key, "left_semi").unionByName(docs.where(F.col(key).isNull()))
    x = docs.select(key, F.posexplode(F.split(F.col("text"), "\n", -1)).alias("i", "line"))
    x = x.withColumn("old", py_strip(F.col("line")))
    x = x.join(repl, [key, "old"], "left").withColumn("out", F.coalesce(F.col("new"), F.col("line")))
    g = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "out"))).alias("a"))
    return g.select(key, F.array_join(F.transform("a", lambda e: e["out"]), "\n").alias("text")).unionByName(whole)


# ---------------------------------------------------------------- H11 paragraph styles
def paragraph_styles(df: DataFrame, key: list[str], text_col: str = "text", sep: str = "\n\n",
                     variant: str = "hosted") -> DataFrame:
    """Style per paragraph for plain rendering.  ``hosted``: heading if
    upper case with at most 8 words, else normal, blank = spacer.
    ``self``: signature, heading (upper, ends ':', or <= 8 words starting
    with an upper-case letter), normal; blank = spacer."""
    x = df.select(*key, F.posexplode(F.split(F.col(text_col), sep, -1)).alias("p_ord", "raw"))
    # each step reads the columns of the one before it: a paragraph is stripped and lower-cased once
    x = x.select(*key, "p_ord", py_strip(F.col("raw")).alias("p"))
    x = x.select(*key, "p_ord", "p", F.lower("p").alias("low"), F.upper("p").alias("up"))
    p, low = F.col("p"), F.col("low")
    upper = (F.col("up") == p) & (low != p)
    few_words = F.size(F.split(p, f"{WS}+", 9)) <= 8  # no more than nine parts are cut
    if variant == "hosted":
        style = F.when(F.length(p) == 0, "spacer").when(upper & few_words, "heading").otherwise("normal")
    else:
        first_upper = is_upper(F.call_function("substring", p, F.lit(1), F.lit(1)))
        heading = upper | F.endswith(p, F.lit(":")) | (first_upper & few_words)
        sig = F.lit(False)
        for w in K.LINE_SIGNATURE_WORDS:
            sig = sig | F.call_function("contains", low, F.lit(w))
        style = F.when(F.length(p) == 0, "spacer").when(sig, "signature").when(heading, "heading").otherwise("normal")
    return x.select(*key, "p_ord", style.alias("style"))


# ---------------------------------------------------------------- H12 complexity
def page_features(pages: DataFrame, density: float = 0.5) -> DataFrame:
    """Per page: column blocks (article / nav / aside), tables, forms and
    whether text is dense (text characters / HTML characters > density)."""
    h = F.col("html")
    cnt = lambda p: F.regexp_count(h, F.lit(p))
    text_len = F.length(html_to_text(h))
    return pages.select("page_id",
                        cnt(r"(?i)<(article|nav|aside)\b").alias("column_count"),
                        (cnt(r"(?i)<table\b") > 0).alias("has_tables"),
                        (cnt(r"(?i)<form\b") > 0).alias("has_forms"),
                        (text_len > F.length(h) * density).alias("high_text_density"))


def layout_complexity(features: DataFrame, base: int = 1) -> DataFrame:
    """score = base + columns*1 + tables*3 + forms*2 + dense*2, layout
    type and processing strategy (the documented formula; base, density and
    column counting are parameters)."""
    score = (F.lit(base) + F.col("column_count") + F.col("has_tables").cast("int") * 3
             + F.col("has_forms").cast("int") * 2 + F.col("high_text_density").cast("int") * 2)
    ltype = (F.when(F.col("has_tables"), "table_heavy").when(F.col("column_count") > 1, "multi_column")
             .when(F.col("has_forms"), "form_based").when(score < 3, "standard").otherwise("mixed"))
    strategy = (F.when((score < 3) & (ltype == "standard"), "standard_extraction")
                .when(ltype == "table_heavy", "table_focused_processing")
                .when(ltype == "multi_column", "column_aware_processing")
                .when(ltype == "form_based", "form_preserving_processing").otherwise("hybrid_processing"))
    return features.withColumn("complexity", score.cast("long")).withColumn("layout_type", ltype).withColumn("strategy", strategy)
