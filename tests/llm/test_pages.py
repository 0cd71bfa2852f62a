import random
import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from foliant.llm import pages


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_common_places_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        for most in (1, 10**6):
            got = pages.common_places(a, b, most)
            assert got == sorted(set(got)) and len(got) == lcs_length(a, b)
            assert is_subsequence([a[i] for i in got], b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="ad">Buy <b>now</b></div>
<div id="cookie-notice">We use cookies<div>x</div></div><main><article><header><h1>Title &amp; more</h1></header><p><b>First
  line&nbsp;here.<br><p>Second &lt;b&gt; <i>par</i>t<aside>Side</aside><form><p>Mail <input></form><p>Third<!-- <p>no --></p>
<section class="comments"><p>Reader says</p></section></article></main><div class=sidebar>Side</div><footer>&copy; x</footer>"""


def test_structure():
    want = "Title & more\nFirst line here.\nSecond <b> part\nThird"
    assert pages.main_text(pages.page_lines(PAGE), None) == want
    assert pages.main_text(pages.page_lines(PAGE), pages.page_lines(PAGE)) == want
    assert pages.page_lines("") == [] and pages.main_text([], []) == ""
    for broken in ("<", "<p", "a < b", "<script>x", "<!-- x", "</", "<p class='x>y", "&amp", "<nav>menu<article>text", "<p class=ad>x<p>text"):
        pages.page_lines(broken)
    assert pages.page_lines("<nav>menu<article>text") == [("text", True)]
    assert pages.page_lines("<p class=ad>x<p>text")[0][0] == "text"


def test_template_lines_of_bare_pages_are_deleted(spark):
    def page(body):
        return f"<html><body><div>Welcome to the site</div><p>{body} one</p><p>{body} two</p><p>{body} three</p><div>Contact us today</div></body></html>"

    rows = [(i, f"https://h.org/a/{i}", page(f"text {i}"), "x") for i in range(6)]
    rows += [(10, None, None, "x"), (11, "::bad url", "<p>lone</p>", "x"), (12, "https://k.org/", "", "x"), (None, "https://h.org/a/1", page("text 1"), "x")]
    rows += [(20, "https://c.org/1", page("same"), "x"), (21, "https://c.org/2", page("same"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(1)
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    assert len(got) == len(rows)
    for i in (0, 2, 3, 4, 5):
        assert got[i] == "\n".join(f"text {i} {n}" for n in ("one", "two", "three"))
    assert got[10] == "" and got[11] == "lone" and got[12] == ""
    assert got[20] == got[21] == "Welcome to the site\nsame one\nsame two\nsame three\nContact us today"
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_alignment_decides_for_pages_with_an_article(spark):
    def page(i):
        return f"<html><body><main><h2>Heading {i}</h2><article><p>Follow us</p><p>Text {i}</p><p>More {i}</p><p>Thanks for reading</p></article><p>After {i}</p><p>All rights</p></main></body></html>"

    rows = [(i, f"https://h.org/a/{i}", page(i)) for i in range(6)] + [(9, "https://alone.org/", page(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    assert got == {i: f"Heading {i}\nText {i}\nMore {i}\nAfter {i}" for i in range(6)} | {9: "Follow us\nText 9\nMore 9\nThanks for reading"}


def _bare(*lines):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in [*[f"Template {k}" for k in range(8)], *lines]) + "</body></html>"


def test_short_pages_and_copies_lose_a_large_template(spark):
    rows = [(i, f"https://short.org/a/{i}", _bare(f"one {i}", f"two {i}")) for i in range(5)]
    rows += [(100 + i, f"https://copies.org/a/{i:02d}", _bare(*[f"copied {k}" for k in range(10)])) for i in range(20)]
    rows += [(200 + i, f"https://copies.org/b/{i}", _bare(f"alpha {i}", f"beta {i}", f"gamma {i}")) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    want = {i: f"one {i}\ntwo {i}" for i in range(5)} | {200 + i: f"alpha {i}\nbeta {i}\ngamma {i}" for i in range(3)}
    assert got == want | {100 + i: "\n".join(f"copied {k}" for k in range(10)) for i in range(20)}


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, f"https://h{i // 2}.org/{i}", _bare(f"one {i}", f"two {i}", *[f"x {i} {k}" for k in range(4)])) for i in range(40)]
    rows += [(100 + i, f"https://k.org/{i // 9}/{i:02d}", _bare(*[f"copied {i // 9} {k}" for k in range(3)])) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append({r.page_id: r.text for r in pages.extract_main_text(df.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and len(results[0]) == 100
    assert all("Template" not in t for t in results[0].values())


def test_driver_pages_equal_their_articles(spark):
    src = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_main_text(src).collect()}
    for r in src.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id] == (want, len(want))


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '>", "<!", "<p>line</p>", "</script ", "<script>", "<!-- ", "<a x='1' y=\"2\" ", "<div class=x>"])
def test_hostile_pages_take_linear_time(unit):
    began = time.perf_counter()
    pages.page_lines(unit * (10_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_tags_with_open_quotes_end_at_the_next_bracket():
    assert pages.page_lines("<p class='x>one</p><p>two \"<b>three</b>") == [("one", False), ('two "three', False)]
    assert pages.page_lines('<p title="a>b">one</p>') == [("one", False)]
    assert pages.page_lines("<p>one</p><a href=x") == [("one", False), ("<a href=x", False)]


def test_alignment_of_very_long_pages():
    lines = [f"line {i}" for i in range(60_000)]
    other = random.Random(1).sample(lines, len(lines))
    assert len(pages.common_places(lines, lines[1000:] + lines[:1000])) == 59_000
    got = pages.common_places(lines, other)
    assert got == sorted(got) and is_subsequence([lines[i] for i in got], other) and len(got) > 400


def test_ties_of_path_and_repeated_rows_do_not_depend_on_partitions(spark):
    rows = [(i % 7, "https://t.org/same", _bare(f"one {i % 7}", f"two {i % 7}")) for i in range(21)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r.page_id, r.text) for r in pages.extract_main_text(df.repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] == sorted((i % 7, f"one {i % 7}\ntwo {i % 7}") for i in range(21))


def test_article_renamed_on_the_driver_tables(spark):
    src = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = src.withColumn("html", F.regexp_replace("html", "<(/?)(article|main)>", "<$1div>"))
    want = {r.page_id: r.text for r in pages.extract_main_text(src).collect()}
    got = {r.page_id: r.text for r in pages.extract_main_text(plain).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
