import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import markdown as md
from foliant.functions import sanitise as S
from foliant.functions import text as X
from foliant.operators import grid as G
from foliant.operators import urls

TEXTS = [
    "", "AT&T &copy; snake_case *x* [y] <z> \"q\"", "_lead trail_ a_b 1_2 __init__ é_é _é", "&amp; &#45; &a_1; &; &#;", "\x00\x01\x0b\x1b\x7f\x85", "a\r\n\tb", "# T", "> q", "1. one",
    "2) two", "===", "~~~ x", ":-- | --:", "1.5 kg", ":-) smile", "a - b # c", "    four", "\\ back `tick`", "<&lt;", "| pipe", "12345678901. x", "- ", "+x",
]


def test_columns_equal_the_python_writers(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", X.escape_markdown(F.col("t")).alias("e"), X.escape_markdown(F.col("t"), quoted=True).alias("q"), X.escape_line_start(F.col("t")).alias("l"), X.escape_heading_end(F.col("t")).alias("h")).collect()
    for r in got:
        assert (r.e, r.q, r.l, r.h) == (md.escape(r.t), md.escape(r.t, quoted=True), md.escape_line_start(r.t), md.escape_heading_end(r.t)), r.t


def test_fence_table_units_and_numbers(spark):
    one = spark.range(1)
    r = one.select(
        X.fence(F.lit("a ```` b")).alias("f"), X.markdown_table(F.array(F.array(F.lit("a"), F.lit("b|")), F.array(F.lit("c")))).alias("t"),
        X.unit_key(F.lit("page"), F.lit(7)).alias("k"), X.unit_heading(F.lit("page"), F.lit(7), F.lit("x")).alias("p"), X.unit_heading(F.lit("sheet"), F.lit(2), F.lit('a"b')).alias("s"),
        *[X.ascii_integer(F.lit(v), F.lit(5)).alias(f"n{i}") for i, v in enumerate([" +12 ", "-007", "9" * 30, "x", None, "0", "1.5"])],
        X.heading_line(F.lit("t #"), F.lit(2)).alias("h2"), X.heading_line(F.lit("t"), F.lit(6)).alias("h6"), X.source_html(F.lit(" ```<b>&lt;"), raw=True).alias("raw"),
    ).first()
    assert r.f == "`````\na ```` b\n`````" and r.t == "| a | b\\| |\n| --- | --- |\n| c |  |"
    assert (r.k, r.p, r.s) == ("page/000007", "Page 7", 'Sheet 2: "a&quot;b"')
    assert [r[f"n{i}"] for i in range(7)] == [12, -7, 10**12, 5, 5, 0, 5]
    assert (r.h2, r.h6, r.raw) == ("#### t \\#", "**Heading 6: t**", " \\```&lt;b>&amp;lt;")


def test_sanitise_counts_every_loss():
    text, losses, broken = S.sanitise(" x\xa0y (cid:190) so\xadft oﬃce dišerent \x01 – ≥ 中")
    assert text == "- x y soft office diserent - >= ?" and broken == 1
    assert losses == {"control_chars": 1, "soft_hyphens": 1, "nbsp": 1, "pua_glyphs": 1, "cid_survivors": 1, "ligatures": 1, "non_ascii_replaced": 1}
    assert S.sanitise("a  (cid:190)(cid:2)  b")[0] == "a b" and S.sanitise("a  (cid:190)(cid:2)  b", layout=True)[0] == "a    b"
    assert S.sanitise("é 中 “q”", unicode=True)[0] == "é 中 “q”"


def test_sanitise_columns_agree(spark):
    texts = [" x\xa0y (cid:190) so\xadft oﬃce dišerent \x01  ", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.sanitise_text("t").alias("r"), *[c.alias(n) for n, c in X.loss_counts(F.col("t")).items()])
    for r in df.where("r.text is not null").collect():
        for name in ("control_chars", "soft_hyphens", "nbsp", "pua_glyphs", "cid_survivors", "ligatures", "broken_words"):
            assert r[name] == r.r[name], name


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a", " ", "b c", "*", "_", "!", "\n"]), st.sampled_from(["*", "**"])), max_size=8))
def test_inline_never_loses_text(parts):
    content, n = [], 0
    for p in parts:
        if p in ("*", "**"):
            content.append(md.Span(p, content=["x" + str(n)]))
            n += 1
        else:
            content.append(md.escape(p))
    out = md.inline(content)
    for i in range(n):
        assert f"x{i}" in out


def test_addresses_and_urls(spark):
    df = spark.createDataFrame([("A1",), ("$XFD$1048576",), ("XFE1",), ("A0",), ("a1",), ("AAA1",)], "a string").select(G.parse_address(F.col("a")).alias("p"))
    assert [tuple(r.p) if r.p else None for r in df.collect()] == [(1, 1), (1048576, 16384), None, None, None, (1, 703)]
    assert G.shift_formula("SUM(A1:$B$2)+'A1'!C3&\"A1\"+LOG10(A1)", 1, 1) == "SUM(B2:$B$2)+'A1'!D4&\"A1\"+LOG10(B2)"
    assert G.shift_formula("A1", -1, 0) == "#REF!"
    ips = ["8.8.8.8", "10.1.1.1", "172.32.0.1", "192.168.1.1", "239.1.1.1", "1.2.3.999", "x"]
    r = spark.createDataFrame([(i,) for i in ips], "ip string").select(urls.is_public_v4(F.col("ip"))).collect()
    assert [x[0] for x in r] == [True, False, True, False, False, None, None]


@pytest.mark.parametrize("html,want", [("<title>Just a moment...</title><script src=/cdn-cgi/cf-chl>", "cloudflare"), ("<form><input type=\"password\">", "login"), ("<p>" + "text " * 100, None), ("<script>x</script>", "shell")])
def test_page_check(spark, html, want):
    from foliant.operators import html as H

    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    nodes = H.html_nodes(pages)
    facts = pages.join(H.titles(nodes), pages.page_id == F.col("source_id"), "left").drop("source_id").join(H.visible_length(nodes), pages.page_id == F.col("source_id"), "left")
    assert facts.select(urls.page_check(F.col("html"), F.col("title"), F.coalesce("visible_chars", F.lit(0)))).first()[0] == want
