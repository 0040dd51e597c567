"""Hand-worked goldens for the edge cases listed in FIXTURES.md (expected rows
derived by reading the reference's rules, not by running it)."""

from pyspark.sql import functions as F

from docrevise.functions.text import py_strip
from docrevise.operators import chunks as C
from docrevise.operators import html as H
from docrevise.operators import instructions as I
from docrevise.operators import ranking as P
from docrevise.operators import revision as R
from docrevise.operators import targets as T
from docrevise.sources import intake as IN


def req(spark, *instrs):
    return spark.createDataFrame([(f"j{i}", s) for i, s in enumerate(instrs)], "job_id string, instruction string")


def jobs(spark, rows, instruction="x"):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return T.jobs_from_documents(docs, instruction)


def test_quoted_spans_order_and_apostrophes(spark):
    r = I.quoted_spans(req(spark, """Change "ABC Corp" to 'XYZ Inc' and "ab" """,
                           "the client's name, don't change")).orderBy("job_id", "ord").collect()
    assert [(x.job_id, x.ord, x.text) for x in r] == [
        ("j0", 0, "ABC Corp"), ("j0", 2, "XYZ Inc"), ("j1", 0, "s name, don")]


def test_parts_split_hyphen_and_number(spark):
    r = I.instruction_parts(req(spark, "co-operate", "Raise fee 1.5 percent")).orderBy("job_id", "part_ord").collect()
    assert [(x.job_id, x.part) for x in r] == [("j0", "operate"), ("j1", "Raise fee"), ("j1", "5 percent")]


def test_action_phrases_substring_verbs(spark):
    parts = I.instruction_parts(req(spark, "settle the address"))
    r = I.action_phrases(parts).orderBy("verb_ord").collect()
    assert [(x.verb, x.search) for x in r] == [("set", "tle the address"), ("add", "ress")]


def test_company_and_key_entities(spark):
    df = req(spark, "Change the Acme Corp name from 'A1b2' to 'B2c3'", "Update Vendor Name to 'New Supplier LLC'",
             "Update vendor name to 'New Supplier LLC'")
    ce = {(x.job_id, x.entity) for x in I.company_entities(df).collect()}
    assert ce == {("j0", "Acme Corp"), ("j1", "New Supplier LLC")}
    ke = I.key_entities(df).orderBy("job_id", "ent_ord").collect()
    assert [(x.job_id, x.entity) for x in ke] == [
        ("j0", "A1b2"), ("j0", "B2c3"), ("j0", "Acme Corp"), ("j1", "New Supplier LLC"), ("j2", "New Supplier LLC")]


def test_replacement_pairs_and_literal_revise(spark):
    df = req(spark, "Change company name from 'ABC Corp' to 'XYZ Inc'")
    assert [(x.old, x.new) for x in I.replacement_pairs(df).collect()] == [("ABC Corp", "XYZ Inc")]
    d = spark.createDataFrame([("ABC Corp signs. ABC Corp pays.", "Change company name from 'ABC Corp' to 'XYZ Inc'")],
                              "text string, instruction string").withColumn("pairs", I.replacement_pairs_array(F.col("instruction")))
    assert d.select(R.literal_revise("text", "pairs")).first()[0] == "XYZ Inc signs. XYZ Inc pays."


def test_occurrences_overlap_and_clipping(spark):
    j = jobs(spark, [(1, "aaaa"), (2, "xxMIT Licensexx")])
    terms = spark.createDataFrame([("job-1", 0, "aa"), ("job-2", 0, "mit license")], "job_id string, k1 int, term string")
    non = sorted((x.job_id, x.pos) for x in T.occurrences(j, terms, ["k1"]).collect())
    ovl = sorted((x.job_id, x.pos) for x in T.occurrences(j, terms, ["k1"], overlapping=True).collect())
    assert non == [("job-1", 0), ("job-1", 2), ("job-2", 2)]
    assert ovl == [("job-1", 0), ("job-1", 1), ("job-1", 2), ("job-2", 2)]
    j2 = jobs(spark, [(2, "xxMIT Licensexx")], "Change 'MIT License' now")
    assert [x.target for x in T.quoted_windows(j2).collect()] == ["xxMIT Licensexx"]


def test_drop_contained_both_orders(spark):
    words = {"job-1": ["abc", "xabcx"], "job-2": ["xabcx", "abc"], "job-3": ["ab", "cd", "abcd", "ab"]}
    j = jobs(spark, [(i + 1, "|".join(w)) for i, w in enumerate(words.values())])
    rows = [(job, 1, k, 0, 0, t, len("|".join(w[:k])) + (k > 0)) for job, w in words.items() for k, t in enumerate(w)]
    c = spark.createDataFrame(rows, "job_id string, src int, k1 int, k2 int, k3 int, target string, ws long")
    r = T.drop_contained(c).orderBy("job_id", "ord").collect()
    assert [(x.job_id, x.target) for x in r] == [("job-1", "abc"), ("job-2", "xabcx"), ("job-3", "ab"), ("job-3", "cd")]


def test_entity_windows_have_a_row_per_hit(spark):
    """Every hit is a row, also where several stand in one paragraph."""
    j = jobs(spark, [(1, "p1\n\nABC Corp and abc corp\n\nABC Corp")], "Change 'ABC Corp' to 'XYZ Co'")
    r = T.entity_windows(j).orderBy("k1", "k3").collect()
    assert [(x.k1, x.k2, x.k3, x.target) for x in r] == [(0, 0, 0, "ABC Corp and abc corp"), (0, 0, 1, "ABC Corp and abc corp"), (0, 0, 2, "ABC Corp")]
    from docrevise.plans import catalog
    assert "GROUP BY job_id, k1, ws, we" not in catalog.REGISTRY["t8_entity_paragraphs"].sql


def test_entity_paragraphs_and_partial(spark):
    j = jobs(spark, [(1, "p1\n\nthe ABC Corp here\n\np3")], "Change 'ABC Corp' to 'XYZ Co'")
    assert [x.target for x in T.entity_paragraphs(j).collect()] == ["the ABC Corp here"]
    j2 = jobs(spark, [(2, "We met Industries International today.")], "Replace 'Globex Industries International'")
    r = T.partial_entity_windows(j2).collect()
    assert [(x.k2, x.target) for x in r] == [(1, "We met Industries International today.")]


def test_fixed_chunk_boundaries(spark):
    j = jobs(spark, [(1, "a" * 24999), (2, "a" * 25000), (3, "a" * 25001), (4, "")])
    r = C.chunk_fixed(j, 25000, 5000).orderBy("job_id", "chunk_no").collect()
    got = [(x.job_id, x.start, x.end) for x in r]
    assert got == [("job-1", 0, 24999), ("job-2", 0, 25000), ("job-3", 0, 25000), ("job-3", 20000, 25001), ("job-4", 0, 0)]


def test_target_score_points(spark):
    j = jobs(spark, [(1, "hello world foo bar")])
    ch = C.chunk_fixed(j, 100, 10)
    t = spark.createDataFrame([("job-1", "world", 1), ("job-1", "zzzzzz foo bar", 1), ("job-1", "WORLD", 2)],
                              "job_id string, target string, n long")
    # world: contained at 6, len 19: 6 < 19//3=6 no, 6 < 38//3=12 -> 5+1 = 6 (x1, and x2 for "WORLD")
    # "zzzzzz foo bar" (14 > 10): not contained, second half "foo bar" contained -> 2
    assert P.score_targets(j, ch, t).first().target_score == 6 + 2 + 12


def test_markers_and_rank(spark):
    j = jobs(spark, [(1, "intro\nthe parties agree on payment\nend")])
    ch = C.chunk_fixed(j, 12, 2)
    sc = P.score_markers(ch).withColumn("score", F.col("marker_score"))
    r = P.rank_chunks(sc).orderBy("rank").collect()
    assert r[0].marker_score >= 1 and sorted(x.rank for x in r) == list(range(1, len(r) + 1))


def test_accept_threshold_and_flags(spark):
    df = spark.createDataFrame([("orig text A", "123456789", None), ("orig text B", "1234567890", None),
                                ("orig text C", "long enough response", "boom"), ("Same Text!", "same text!", None)],
                               "text string, response string, error string")
    r = R.change_flags(R.accept_responses(df)).collect()
    assert [(x.accepted, x.revised, x.differs) for x in r] == [
        (False, "orig text A", False), (True, "1234567890", True), (False, "orig text C", False), (True, "same text!", False)]


def test_response_text_rules(spark):
    bodies = ['{"outputs": [], "generation": "g"}', '{"outputs": [{"text": ""}], "generation": "g"}', '{"foo": 1}',
              '{"content": [{"text": "c"}]}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    r = df.select(R.response_text(F.col("body"), "hosted").alias("h"),
                  R.response_text(F.col("body"), "client", F.col("body").contains("content")).alias("c")).collect()
    assert [(x.h, x.c) for x in r] == [("g", "g"), ("", "g"), ("", '{"foo": 1}'), ("", "c")]


def test_error_classes(spark):
    errs = ["An error occurred (UnrecognizedClientException)", "The Security Token is invalid", "ThrottlingException",
            "InternalServerError", "boom", None]
    df = spark.createDataFrame([(e,) for e in errs], "error string")
    assert [x.error_class for x in R.classify_errors(df).collect()] == [
        "credentials", "credentials", "throttled", "unavailable", "other", None]


def test_retry_backoff_and_credentials():
    waits = []
    calls = {"n": 0}

    def flaky(p):
        calls["n"] += 1
        if calls["n"] <= 2:
            raise RuntimeError("ThrottlingException")
        return "ok"

    assert R.call_with_retry(flaky, "p", sleep=waits.append) == ("ok", None, 3)
    assert waits == [1.0, 2.0]
    waits.clear()
    body, err, n = R.call_with_retry(lambda p: 1 / 0, "p", sleep=waits.append)
    assert body is None and "ZeroDivisionError" in err and n == 3 and waits == [1.0, 2.0, 4.0]

    def creds(p):
        raise RuntimeError("UnrecognizedClientException: bad key")
    waits.clear()
    assert R.call_with_retry(creds, "p", sleep=waits.append)[2] == 1 and waits == []


def test_clean_wrap_guard(spark):
    o30 = "abcdefghij" * 3  # 30 characters: the guard threshold is 9
    df = spark.createDataFrame([('"```html<p>x</p>```"', o30), ("  plain  ", o30), ('"', "")],
                               "r string, o string")
    c = df.select(H.clean_response(F.col("r")).alias("c"), "o")
    rows = c.select("c", H.wrap_html(F.col("c")).alias("w"), H.guard_short(F.col("c"), F.col("o")).alias("g")).collect()
    assert [x.c for x in rows] == ["<p>x</p>", "plain", ""]
    assert rows[0].w is None and rows[1].w is None
    assert [x.g for x in rows] == [True, True, False]
    # exactly 30 %: 3 characters against 10 is not "shorter than"
    g = spark.createDataFrame([("abc", "abcdefghij")], "c string, o string").select(H.guard_short(F.col("c"), F.col("o"))).first()[0]
    assert g is False
    d = spark.createDataFrame([("<div>a</div>",)], "c string").select(H.wrap_html(F.col("c"))).first()[0]
    assert d.startswith("<!DOCTYPE html>\n<html>") and "<div>a</div>" in d


def test_line_classes(spark):
    rows = [("1. Definitions", False, False, 72.0), ("a) first item", False, False, 72.0), ("WHEREAS:", False, True, 72.0),
            ("Signed by the Client", False, False, 72.0), ("   ", False, False, 72.0), ("plain text", False, False, 120.0),
            ("plain text", True, False, 72.0), ("1.5 percent", False, False, 72.0)]
    df = spark.createDataFrame(rows, "text string, bold boolean, centered boolean, x0 double")
    assert [x.cls for x in H.classify_lines(df).collect()] == [
        "h2", "clause", "h1", "signature", "spacer", "indent", "h2", "clause"]


def test_paragraph_classes(spark):
    paras = ["TITLE", "Section one:", "Name: John", "1. The parties agree", "12345", "just text"]
    df = spark.createDataFrame([(p,) for p in paras], "p string")
    assert [x[0] for x in df.select(H.paragraph_class(F.col("p"))).collect()] == [
        "h1", "h2", "signature", "clause", "h1", "paragraph"]


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([(" abc ",), ("\r\nx y\t",), ("\x1cz\x1f",)], "s string")
    assert [x[0] for x in df.select(py_strip(F.col("s"))).collect()] == ["abc", "x y", "z"]


def test_align_and_apply(spark):
    orig = spark.createDataFrame([("a", "Payment is due in thirty days\nKeep me\nKeep me")], "job_id string, text string")
    resp = spark.createDataFrame([("a", "Payment is due in forty five days\nKeep me")], "job_id string, text string")
    repl = H.align_lines(orig, resp, key="job_id")
    assert [(x.old, x.new) for x in repl.collect()] == [("Payment is due in thirty days", "Payment is due in forty five days")]
    out = H.apply_replacements(orig, repl).first().text
    assert out == "Payment is due in forty five days\nKeep me\nKeep me"


def test_validation_order_and_names(spark):
    rows = [("a", False, "", "", 1), ("b", True, "", "", 1), ("c", True, "x.txt", "", 1), ("d", True, "x.txt", "go", 200 * 2**20),
            ("e", True, "x.txt", "go", 1)]
    df = spark.createDataFrame(rows, "job_id string, has_file boolean, file_name string, instruction string, size_bytes long")
    assert [x.reason for x in IN.validate_requests(df).collect()] == [
        "No file part", "No file selected", "No instruction provided", "File too large", None]
    n = spark.createDataFrame([("contract.final.pdf",), (".bashrc",), ("notes",)], "n string")
    ts = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = [x[0] for x in n.select(IN.output_name(F.col("n"), ts, F.lit("job"))).collect()]
    assert out[0].startswith("contract.final_20240201_000000_") and out[0].endswith(".pdf") and len(out[0]) == len("contract.final_20240201_000000_") + 12
    assert out[1].startswith(".bashrc_") and out[2].startswith("notes_")


def test_progress_formula(spark):
    df = spark.createDataFrame([("j", True)] * 3 + [("j", False)] * 2, "job_id string, ok boolean")
    from docrevise.operators import jobs as J
    # failed calls are done too; a chunk whose call has not ended is not
    assert J.job_progress(df).first().progress == 70
    assert J.job_progress(df, F.col("ok")).first().progress == 58


def test_log_rows_without_time_or_key_are_kept(spark):
    from docrevise.operators import jobs as J
    rows = [("a", 1, "2024-01-01 00:00:00", "queued"), ("a", 2, None, "queued"),
            (None, 3, "2024-01-01 00:00:00", "queued"), (None, 4, "2024-01-01 02:00:10", "completed"),
            ("a", 5, "2024-01-01 00:00:04", "completed")]
    log = spark.createDataFrame(rows, "job_id string, seq long, t string, status string").withColumn(
        "ts", F.col("t").cast("timestamp"))
    m = {r.status: r for r in J.job_metrics(log).collect()}
    assert (m["queued"].n_rows, m["completed"].n_rows) == (3, 2)
    assert m["queued"].median_sec == (4 + 7210) / 2 and m["completed"].median_sec is None
    n = J.neighbour_ts(log, ["job_id"], "ts", "seq", direction="prev")
    assert {r.seq: r.other_ts is not None for r in n.collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    g = J.gap_sessions(log, ["job_id"], "ts", "seq", 720)
    assert sum(r.n_events for r in g.collect()) == 5


def test_exact_median_against_statistics(spark):
    import random
    import statistics
    from docrevise.operators import jobs as J
    rnd = random.Random(5)
    data = {k: [rnd.choice([rnd.randrange(10), rnd.randrange(10**6), rnd.randrange(2**40), rnd.randrange(2**50)])
                for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 301), (None, 200))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v long")
    got = {r.k: r.median for r in J.exact_median(df.groupBy("k", "v").agg(F.count("*").alias("n")), "k", "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in data.items()}
    assert J.exact_median(spark.createDataFrame([], "k string, v long, n long"), "k", "v").count() == 0


def test_chunk_scores_after_a_letter_that_lowers_to_two(spark):
    from docrevise.operators import ranking as P
    text = "\u0130" * 300 + "needle and more text \u0130 tail needle"
    jobs = T.jobs_from_documents(spark.createDataFrame([(1, text), (2, "needle")], "doc_id long, text string"), "x")
    n = len(text)
    cuts = [("job-1", 0, 0, 310), ("job-1", 1, 302, n), ("job-1", 2, 320, n), ("job-2", 0, 0, 6)]
    ch = spark.createDataFrame([(*c, ("needle" if c[0] == "job-2" else text)[c[2]:c[3]]) for c in cuts],
                               "job_id string, chunk_no long, start long, end long, text string")
    tg = spark.createDataFrame([("job-1", "needle", 1), ("job-2", "needle", 1)], "job_id string, target string, n long")
    got = {(r.job_id, r.chunk_no): r.target_score for r in P.score_targets(jobs, ch, tg).collect()}

    def want(chunk):
        at, m = chunk.lower().find("needle"), len(chunk)
        return 0 if at < 0 else 5 + (2 if at < m // 3 else 1 if at < 2 * m // 3 else 0)
    assert {k: v or 0 for k, v in got.items()} == {
        ("job-1", 0): want(text[:310]), ("job-1", 1): want(text[302:]), ("job-1", 2): want(text[320:]), ("job-2", 0): 7}


def test_requests_without_a_document_end_as_errors(spark):
    from docrevise.plans.revise import NO_DOCUMENT, revise
    docs = spark.createDataFrame([("d", "Old Name pays the fee every month.")], "doc_id string, text string")
    reqs = spark.createDataFrame(
        [("a", "d", "Change 'Old Name' to 'New Name'"), ("b", "gone", "Change 'x' to 'y'"), ("c", None, "z")]
        + [(f"h{i}", "absent", "z") for i in range(30)], "job_id string, doc_id string, instruction string")
    out = revise(T.prepare_jobs(reqs, docs, hot_share=0.1))
    got = {r.job_id: (r.status, r.message) for r in out["results"].collect()}
    assert len(got) == 33 and got.pop("a")[0] == "completed"
    assert set(got.values()) == {("error", NO_DOCUMENT)}
    marks = {r.job_id: r.n for r in out["job_log"].groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert (marks["a"], marks["b"]) == (7, 3)


def test_inline_requests_need_both_parts(spark):
    df = spark.createDataFrame([("i", "t"), (None, "t"), ("i", None), ("", "")],
                               "instruction string, document_content string")
    assert [r.accepted for r in IN.validate_inline(df).collect()] == [True, False, False, True]


def test_align_short_lines_and_first_original(spark):
    orig = spark.createDataFrame([("a", "Payment\nInvoices\nTotal: 100 USD\nTotal: 100 EUR")], "job_id string, text string")
    resp = spark.createDataFrame([("a", "Payments\nINVOICE\nTotal: 100 GBP")], "job_id string, text string")
    got = {(x.old, x.new) for x in H.align_lines(orig, resp, key="job_id").collect()}
    assert got == {("Payment", "Payments"), ("Invoices", "INVOICE"), ("Total: 100 USD", "Total: 100 GBP")}


def test_hot_document_requests_join_exactly_once(spark):
    docs = spark.createDataFrame([(1, "hot text"), (2, "cold text"), (3, "unused")], "doc_id long, text string")
    reqs = spark.createDataFrame([(f"h{i}", 1, "x") for i in range(500)] + [("c0", 2, "y"), ("m0", 9, "z")],
                                 "job_id string, doc_id long, instruction string")
    out = T.join_requests(reqs, docs, hot_share=0.1, salts=8)
    rows = out.collect()
    assert len(rows) == 502 and len({r.job_id for r in rows}) == 502
    assert {(r.doc_id, r.text, r.found) for r in rows} == {
        (1, "hot text", True), (2, "cold text", True), (9, None, False)}
    j = T.prepare_jobs(reqs, docs)
    assert j.count() == 502 and j.where("found").count() == 501


def test_drop_contained_by_repeated_text(spark):
    # "foo bar" (origin 0) is inside "zzz foo bar baz" (origin 9) only through the repeat at 13
    j = jobs(spark, [(1, "foo bar. zzz foo bar baz.")])
    rows_a = [("job-1", 1, 0, 0, 0, "zzz foo bar baz", 9), ("job-1", 1, 1, 0, 0, "foo bar", 0)]
    rows_b = [("job-1", 1, 0, 0, 0, "foo bar", 0), ("job-1", 1, 1, 0, 0, "zzz foo bar baz", 9)]
    schema = "job_id string, src int, k1 int, k2 int, k3 int, target string, ws long"
    for rows, want in ((rows_a, ["zzz foo bar baz"]), (rows_b, ["foo bar"])):
        c = spark.createDataFrame(rows, schema)
        assert [x.target for x in T.drop_contained(c).orderBy("ord").collect()] == want


def test_terms_with_regex_characters(spark):
    text = r"x a.b*c y a.b*c z \E q \Ew (1+1) [x]"
    j = jobs(spark, [(1, text)])
    terms = spark.createDataFrame([("job-1", 0, "a.b*c"), ("job-1", 1, "\\E"), ("job-1", 2, "(1+1)"), ("job-1", 3, "[x]")],
                                  "job_id string, k1 int, term string")
    got = sorted((r.k1, r.pos) for r in T.occurrences(j, terms, ["k1"]).collect())
    want = []
    for k, t in enumerate(["a.b*c", "\\E", "(1+1)", "[x]"]):
        p = text.lower().find(t.lower())
        while p >= 0:
            want.append((k, p))
            p = text.lower().find(t.lower(), p + len(t))
    assert got == sorted(want)
    ovl = sorted((r.k1, r.pos) for r in T.occurrences(j, terms, ["k1"], overlapping=True).collect())
    assert ovl == sorted(want)


def test_positions_from_lowered_text_slice_the_original(spark):
    # "İ" lower-cases to two characters in Java and Python; positions found in
    # the lowered text are applied to the original, shifting the window by one
    text = "İ" + "a" * 150 + " MIT License " + "b" * 300
    assert len(text.lower()) == len(text) + 1
    j = jobs(spark, [(1, text)], "Change 'MIT License' now")
    p = text.lower().find("mit license")
    want = text[max(0, p - 100):min(len(text), p + len("MIT License") + 200)]
    assert [x.target for x in T.quoted_windows(j).collect()] == [want]


def test_layout_complexity_branches(spark):
    pages = [
        (1, "<html><body><p>plain text only here</p></body></html>"),
        (2, "<html><body><table><tr><td>x</td></tr></table><form><input></form></body></html>"),
        (3, "<html><body><article>a</article><aside>b</aside><nav>c</nav></body></html>"),
        (4, "<html><body><FORM action='x'></FORM></body></html>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    r = {x.page_id: x for x in H.layout_complexity(H.page_features(df)).collect()}
    # 1: base 1 + dense text (text/html > 0.5? no: 21/53) -> 1 -> standard
    assert (r[1].complexity, r[1].layout_type, r[1].strategy) == (1, "standard", "standard_extraction")
    # 2: 1 + tables 3 + forms 2 = 6, table_heavy wins
    assert (r[2].complexity, r[2].layout_type, r[2].strategy) == (6, "table_heavy", "table_focused_processing")
    # 3: 1 + 3 columns = 4 -> multi_column
    assert (r[3].complexity, r[3].layout_type, r[3].strategy) == (4, "multi_column", "column_aware_processing")
    # 4: 1 + forms 2 = 3 (case-insensitive tag) -> form_based
    assert (r[4].complexity, r[4].layout_type, r[4].strategy) == (3, "form_based", "form_preserving_processing")


def test_render_lines_exact_html(spark):
    # doc, page, width, block, line, span, text, x0, x1, origin_y, font, flags
    spans = [
        (1, 0, 612.0, 0, 0, 0, "AGREEMENT", 256.0, 356.0, 72.0, "Times-Bold", 0),
        (1, 0, 612.0, 0, 1, 0, "1. Definitions", 72.0, 150.0, 86.0, "Times-Roman", 0),
        (1, 0, 612.0, 0, 2, 0, "   ", 72.0, 80.0, 100.0, "Times-Roman", 0),
        (1, 0, 612.0, 1, 0, 0, "a) first <item>", 72.0, 160.0, 114.0, "Times-Roman", 0),
        (1, 0, 612.0, 1, 1, 0, "plain ", 72.0, 100.0, 128.0, "Times-Roman", 0),
        (1, 0, 612.0, 1, 1, 1, "text & more", 100.0, 500.0, 128.0, "Times-Roman", 0),
        (1, 0, 612.0, 1, 2, 0, "indented line", 120.0, 500.0, 142.0, "Times-Roman", 0),
    ]
    df = spark.createDataFrame(spans, "doc_id long, page_no int, page_width double, block_no int, line_no int, "
                                      "span_no int, text string, x0 double, x1 double, origin_y double, font string, flags int")
    html = H.render_lines(H.classify_lines(H.layout_lines(df))).first().html
    want = "\n".join(H.PAGE_HEAD_LINES + [
        '<h1 id="elem_0_0_72.0" class="heading" align="center">AGREEMENT</h1>',
        '<h2 id="elem_0_0_86.0" class="heading">1. Definitions</h2>',
        '<div style="height: 12px;"></div>',
        '<div id="elem_0_1_114.0" class="clause">a) first &lt;item&gt;</div>',
        '<div id="elem_0_1_128.0" class="paragraph">plain text &amp; more</div>',
        '<div id="elem_0_1_142.0" class="indent">indented line</div>',
        "</body></html>"])
    assert html == want


def test_rebuild_html_exact(spark):
    df = spark.createDataFrame([("k", "TITLE\n\nSection one:\n\n1. The parties <agree>\n\n\n\nplain & simple")],
                               "key string, cleaned string")
    html = H.rebuild_html(df, ["key"], "cleaned", sep="\n\n").first().html
    want = ("\n".join(H.PAGE_HEAD_LINES)
            + '<h1 class="heading" style="text-align: center;">TITLE</h1>'
            + '<h2 class="heading">Section one:</h2>'
            + '<div class="clause">1. The parties &lt;agree&gt;</div>'
            + '<div class="paragraph">plain &amp; simple</div>'
            + H.PAGE_TAIL)
    assert html == want


def test_call_health_warm_branch(spark):
    from docrevise.operators import jobs as J
    calls = spark.createDataFrame([("j", 1, "2024-02-01 00:00:00", True), ("j", 2, "2024-02-01 00:01:00", False)],
                                  "job_id string, chunk_no long, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    reqs = spark.createDataFrame([("2024-02-01 00:05:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-02-01 00:10:00").cast("timestamp")
    r = J.call_health(calls, reqs, now).first()
    assert (r.total, r.ok_calls, r.failed, r.last_ok, r.success_rate) == (2, 1, 1, False, 50.0)
    assert r.minutes_since_last_request == 5.0 and r.next_warmup == "00:17:00"   # 00:05 + 0.8 * 15 min
    cold = J.call_health(calls, reqs, F.lit("2024-02-01 00:30:00").cast("timestamp")).first()
    assert cold.next_warmup == "Soon (model likely cold)"


def test_small_document_bypass_variants(spark):
    j = jobs(spark, [(1, "short <text>"), (2, "x" * 50)])
    hosted = {r.job_id: r for r in C.small_document_chunks(j, 40, 10, use_html=True, chunker=C.chunk_fixed).collect()}
    assert hosted["job-1"].is_html and hosted["job-1"].text.startswith("<!DOCTYPE html><html><body><pre>short &lt;text&gt;")
    selfh = C.small_document_chunks(j, 40, 10, use_html=False, chunker=C.chunk_fixed).collect()
    assert {r.text for r in selfh if r.job_id == "job-1"} == {"short <text>"}
    assert sorted((r.start, r.end) for r in selfh if r.job_id == "job-2") == [(0, 40), (30, 50)]


def test_unchanged_texts_are_not_cut(spark):
    """Only keys with a new line, or with several rows, are cut into lines."""
    orig = spark.createDataFrame([("a", "x\ny"), ("b", "x\ny"), ("c", "x\ny"), ("d", "x"), ("d", "x"), (None, "x")], "job_id string, text string")
    resp = spark.createDataFrame([("a", "x\ny"), ("b", "y\nx"), ("c", "x\nz"), ("d", "x"), (None, "z")], "job_id string, text string")
    assert {r.job_id for r in H._changed_keys(orig, resp, "job_id").collect()} == {"c", "d"}
    repl = spark.createDataFrame([("c", "y", "w")], "job_id string, old string, new string")
    got = sorted((r.job_id or "", r.text) for r in H.apply_replacements(orig, repl).collect())
    assert got == [("", "x"), ("a", "x\ny"), ("b", "x\ny"), ("c", "x\nw"), ("d", "x\nx")]


def test_paragraphs_are_stripped_once(spark):
    """One strip per paragraph, no pattern over all its characters."""
    d = spark.createDataFrame([(1, "\u2003Title Line\x1f\n \nsigned BY me\none two three four five six seven eight nine")], "doc_id long, text string")
    s = H.paragraph_styles(d, ["doc_id"], "text", "\n", "self")
    assert [r.style for r in s.orderBy("p_ord").collect()] == ["heading", "spacer", "signature" if any(w in "signed by me" for w in H.K.LINE_SIGNATURE_WORDS) else "normal", "normal"]
    assert "regexp_replace" not in s._jdf.queryExecution().optimizedPlan().toString()
