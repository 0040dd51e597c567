"""H8 and H10 on original pages: head, attributes and markup are kept."""

from docrevise.operators import html as H

HEAD = "<!DOCTYPE html><html lang='en'><head><script>var x = '<body>';</script><!-- <body> --><title>T</title></head>"


def test_body_is_replaced_in_its_page(spark):
    pages = [f'{HEAD}<BODY class="a">old <b>text</b></BODY></html>', f"{HEAD}<body>old", "<p>no body</p>", None, f"{HEAD}<body>old</body></html>"]
    texts = ["One & two.", "One.", "One.", "One.", None]
    d = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, pages))], "k int, cleaned string, page string")
    got = {r["k"]: r["html"] for r in H.rebuild_html(d, ["k"], page_col="page").collect()}
    one = '<div class="paragraph">One.</div>'
    assert got[0] == f'{HEAD}<BODY class="a"><div class="paragraph">One &amp; two.</div></BODY></html>'
    assert got[1] == f"{HEAD}<body>{one}" and got[2] == pages[2] and got[4] == f"{HEAD}<body></body></html>"
    assert got[3] == {r["k"]: r["html"] for r in H.rebuild_html(d, ["k"]).collect()}[3] and one in got[3]


def test_text_nodes_are_replaced(spark):
    page = f'{HEAD}<body><p id="p">\n Old &amp; dear </p><b>T</b><script>T</script><a href="T">Te</a> &lt;<!--T--></body>T'
    d = spark.createDataFrame([(1, page), (2, "T"), (3, None)], "job_id int, html string")
    repl = spark.createDataFrame([(1, "Old & dear", "New < old"), (1, "T", "U"), (2, "T", "U")], "job_id int, old string, new string")
    got = {r["job_id"]: r["html"] for r in H.apply_to_page(d, repl).collect()}
    assert got == {1: page.replace("\n Old &amp; dear ", "New &lt; old").replace("<b>T</b>", "<b>U</b>"), 2: "T", 3: ""}
