from collections import Counter

from pyspark.sql import functions as F

from foliant.functions.html_tree import COMMENT, TEXT, parse
from foliant.functions.html_markdown import ATTRIBUTE_BYTES, DEPTH, ELEMENTS
from foliant.operators import html as H
from foliant.operators.inspection import html_evidence
from foliant.queries import html as Q

SF = "/root/testdata/sf0.001"


def test_recovered_elements_are_counted(spark):
    page = "<title>t</title><article><p><b>one<br><p>two</p><p>three</article><!-- c -->"
    df = spark.createDataFrame([(1, page), (2, "<p>x<p>y")], "page_id long, html string")
    got = {r.tag: r.n for r in H.tag_histogram(H.html_nodes(df)).collect()}
    assert got == {"html": 2, "head": 2, "body": 2, "title": 1, "article": 1, "p": 5, "b": 3, "br": 1}


def test_whole_tag_histogram(spark):
    want = Counter(n.tag for r in Q._pages(spark, SF).collect() for n in parse(r.html).walk() if n.tag not in (TEXT, COMMENT) and not n.tag.startswith("-"))
    got = Q.html_tag_histogram(spark, SF).collect()
    assert {"p", "b", "html", "head", "body"} <= set(want) and len(got) == len(want) and {r.tag: r.n for r in got} == want


def test_whole_inspection_counts(spark):
    want = Counter((r.page_id, f[0]) for r in Q._pages(spark, SF).collect() for f in html_evidence(r.html))
    got = Q.inspection_counts(spark, SF).collect()
    assert len(got) == len(want) and {(r.page_id, r.capability): r.n for r in got} == want


def test_pages_beyond_the_limits_of_the_conversion(spark, tmp_path):
    """Elements are read from every page; without a row, a page that does not convert looked like one without headings."""
    h = "<title>t</title><h1>a  b</h1>"
    pages = [h, h + "<div>" * (DEPTH + 1) + "x", h + "<br>" * (ELEMENTS + 1), h + f'<p class="{"x" * (ATTRIBUTE_BYTES + 1)}">']
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'' as url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, Q.html_headings(spark, str(tmp_path)).collect())) == [(i, "a b") for i in range(4)]
    assert sorted(map(tuple, Q.html_title(spark, str(tmp_path)).collect())) == [(i, "t") for i in range(4)]
    assert H.html_nodes(Q._pages(spark, str(tmp_path))).select("source_id").distinct().count() == 4


ODD = [
    None, "", "x", "<title> \n </title><title>a  b</title><p> c </p>", "<svg><title>t</title><text>u</text></svg>v", "<p hidden>a<b>b</b></p><p>c", "<html hidden><p>a",
    "<p>a<body hidden>b", "<table>a<tr><td>b</table>", "<noscript><p>a</noscript>b", "<template>a</template>b", "<p style='display:none'>a</p>\u00a0b\U0001f600", "<b><p>a</b>b<!-- c -->",
    "<title>t</title>" + "<div>" * (DEPTH + 1) + "plain words " * 40 + "<script>", "<textarea>a</textarea><button>b</button><select><option>c", "<frameset><frame>", "a<head>b</head>\n",
]


def test_facts_are_those_of_the_nodes(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string")
    nodes = H.html_nodes(df)
    titles = {r.source_id: r.title for r in H.titles(nodes).collect()}
    visible = {r.source_id: r.visible_chars for r in H.visible_length(nodes).collect()}
    got = df.select("page_id", H.page_facts(F.col("html")).alias("f")).select("page_id", "f.*").collect()
    assert len(got) == len(ODD) and set(titles.values()) == {"a b", "t"} and len(set(visible.values())) > 3
    assert {r.page_id: (r.title, r.visible_chars) for r in got} == {i: (titles.get(i), visible.get(i)) for i in range(len(ODD))}
    assert sorted(map(tuple, H.page_lengths(df).collect())) == sorted(visible.items())


def test_page_check_reads_a_page_once(spark, tmp_path):
    """One pass to Python and no join; a deep page that has text is content and no shell."""
    spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string").selectExpr("page_id", "'' as url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    df = Q.page_check(spark, str(tmp_path))
    assert {r.page_id: r.page_class for r in df.collect()} == {i: "content" for i in range(len(ODD))}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
