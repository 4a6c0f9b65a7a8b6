"""Pages to text: odd markup, entities, and article rules with nesting."""

import html
from html.entities import html5

from stratadoc.functions.html import article_title, clean_text, page_title, plain_text, unescape
from stratadoc.operators.corpus import extract_articles


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "html string").select(column.alias("v")).first()["v"]


def test_clean_text_drops_junk(spark):
    page = (
        "<html><head><meta charset=x><title>T  u</title><style>p{}</style>"
        '<script>var a="</p>";</script></head><body><!-- a <b> c --><noscript>no</noscript>'
        "<p>one&nbsp;two <b>three</b>  four\n five</p> <p> </p></body></html>"
    )
    assert value(spark, page, clean_text("html")) == "T\nu\none\u00a0two\nthree\nfour\nfive"


def test_unclosed_script_swallows_the_rest(spark):
    assert value(spark, "<p>a</p><script>b", clean_text("html")) == "a"


def test_entities(spark):
    text = "&lt;p&gt; &amp;lt; &#8364;&#x20AC; &#128512; &#38;lt; &bad; &#; &copy;"
    assert value(spark, text, unescape("html")) == "<p> &lt; €€ 😀 &lt; &bad; &#; ©"
    assert value(spark, "&eacute;&rarr;", unescape("html", all_names=True)) == "é→"


def test_titles(spark):
    assert value(spark, "<p>x</p>", page_title("html")) == "Untitled"
    assert value(spark, "<title> A &amp; B | Site </title>", article_title("html")) == "A & B"
    assert value(spark, "<title>| Site</title>", article_title("html")) == "| Site"
    assert value(spark, "<p>x</p>", article_title("html", "Default")) == "Default"


def test_plain_text_keeps_line_breaks_inside_a_node(spark):
    assert value(spark, "<p> a\nb </p><!-- c --><i>d</i>  e", plain_text("html")) == "a\nb\nd\ne"


def articles(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return [r["article"] for r in extract_articles(df).orderBy("page_id").collect()]


def test_article_rules_in_order(spark):
    got = articles(
        spark,
        '<body><main id="maindoc"><div class="x td-content"><div>in</div>ner</div>out</main></body>',
        '<body><main id="maindoc"><p>main</p></main><article>a</article></body>',
        "<body>x<article>one</article>y</body>",
        "<body>x<article>one<article>two</article>three</article>y</body>",
        "<body><p>only</p></body>",
        "<p>neither</p>",
        '<article>a<div class="feedback">f<div>g</div></div>b<div id="print">p</div><ul class="td-toc q">t</ul>c</article>',
    )
    assert got == [
        "<div>in</div>ner", "<p>main</p>", "one", "one<article>two</article>three", "<p>only</p>", None, "abc",
    ]


def test_simple_pages_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(0, "<article>a &hellip;</article>")], "page_id int, html string")
    out = extract_articles(df).select(plain_text("article").alias("a"), clean_text("html").alias("c"), "title")
    assert out.first()["a"] == "a …" and "Python" not in out._jdf.queryExecution().toString()


def test_all_names_of_the_list(spark):
    text = " ".join(f"&{n}" for n in html5 if n.endswith(";")) + " &#38;lt; &amp;lt; &amp;#60; & &; &nosuch; &#x;"
    assert value(spark, text, unescape("html", all_names=True)) == html.unescape(text)


def test_references_of_all_kinds(spark):
    cases = {
        "&#x20AC;&#x000020ac;&#8364;&#0008364;": "€€€€",
        "&#9999999;&#xD800;&#0;&#xFFFFFFFFFF;&#99999999999999999999;": "\ufffd" * 5,
        "&#128;&#x9f;&#150;": "€Ÿ–",
        "&#;&#x;&#xg;&# 1;": "&#;&#x;&#xg;&# 1;",
        "&eacute;&ndash;&amp;eacute;": "é–&eacute;",
        "&lt;b&gt;&amp;&copy;&unknown;": "<b>&©&unknown;",
    }
    for text, wanted in cases.items():
        assert value(spark, f"<p>{text}</p>", clean_text("html")) == wanted
        assert value(spark, f"<title>{text}</title>", page_title("html")) == wanted
