"""H6: character references against Python's own decoder."""

import html

from pyspark.sql import functions as F

from docrevise.operators import html as H

SAME = ["&#8217;", "&#xE9;", "&#XE9;", "&#xe9;x", "&#0065;&#x0041;", "&#128512;", "&#x1F600;&#8364;", "&#128;&#150;&#x9f;", "&#0;", "&#xD800;", "&#1114112;",
        "&#99999999999999999999999;", "&#xFFFFFFFFFFFFFFFFFF;", "&apos;&quot;&#39;&#x27;", "&amp;#8217;", "&#38;amp;", "&#38;lt;", "&#38;#39;", "&amp;amp;", "a&#10;b", "& # ; &; &#; &#x;", "", "plain & simple"]


def test_references(spark):
    cases = [(t, html.unescape(t)) for t in SAME] + [("a&#160;b&#xA0;c&nbsp;d", "a\xa0b\xa0c\xa0d"), ("<p>it&#8217;s</p><script>&#65;</script>&lt;&#98;&gt;", "it’s<b>"), (None, None)]
    d = spark.createDataFrame(cases, "page string, want string")
    for r in d.select("page", "want", H.html_to_text(d["page"]).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_markup_is_read_as_tokens(spark):
    """Quoted attribute values may hold ">"; comments, scripts and styles know
    nothing of what stands inside another; a stray quote is a character."""
    cases = {
        '<p title="a>b">x</p>': "x", "<p title='a>b' id=c>x</p>y": "xy", '<p title="a>b>x</p>': "b>x", "<p don't>x": "x",
        "<script>var s = '<!--';</script>x<!-- <script> -->y": "xy", '<script data-a="</script>">z</script>x': "x",
        "<!-- a > b -->x": "x", "<style media=\"a>b\">p{}</style>x": "x", "a < b": "a < b", "1 <2> 3": "1  3", "<a href=x=\"y>z\">t</a>": "t", "<br/>x<hr class = 'q>'>": "x"}
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    assert [(r.html, r.got) for r in df.select("html", "want", H.html_to_text(F.col("html")).alias("got")).collect() if r.got != r.want] == []
