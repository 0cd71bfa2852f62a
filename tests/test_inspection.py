import json

import pytest

from foliant.functions import scanners as S
from foliant.operators import inspection as I
from foliant.plans.convert import page_units
from foliant.sources.files import scan
from foliant.sources import synthetic as D


def test_scanners():
    assert S.srcset("a.png 1x, data:image/png;base64,xx== 2x,b.png") == ["a.png", "data:image/png;base64,xx==", "b.png"]
    assert S.css_targets("/* url(no) */ @import 'a.css'; b{background:url( \"c\\20 d.png\" )} e{content:'url(no)'} f{src:url(g.woff)}") == [("import", "a.css"), ("url", "c d.png"), ("url", "g.woff")]
    text = "[a](b) `[no](x)` ![i](j.png) [ref][L] [l] <http://auto> http://bare.org/x.\n```\n[no](y)\n```\n[L]: /one\n[l]: /two\n"
    assert S.markdown_links(text) == [("link", "b"), ("image", "j.png"), ("reference", "/one"), ("reference", "/one"), ("autolink", "http://auto"), ("bare", "http://bare.org/x")]
    page = '<title>T</title><meta name=description content="D"><script type="application/ld+json">{"@type":"Article","headline":"H","x":{"@type":"BreadcrumbList","name":"no"}}</script><noscript>D</noscript>'
    assert S.embedded_texts(page) == ["D", "H"]
    assert S.resolve_url("https://a.org/b/c", "../d") == "https://a.org/d" and S.resolve_url("https://a.org", "javascript:x") is None
    assert S.resolve_internal("OPS/a/b.xhtml", "../c.xhtml#f") == "OPS/c.xhtml" and S.resolve_internal("a", "../../b") is None


def test_registered_functions(spark):
    assert "markdown_links" in S.register(spark)
    r = spark.sql("select markdown_links('[a](b)')[0].target as t, css_hidden('display:none') as h, resolve_url('http://a/', 'b') as u").first()
    assert (r.t, r.h, r.u) == ("b", True, "http://a/b")


def test_html_evidence():
    found = list(I.html_evidence('<!-- c --><p hidden>x</p><img src="data:text/plain,hi" onclick=go()><a href=/y style="background:url(z)">k</a><script>s</script><meta http-equiv=refresh content="0;url=/n">'))
    kinds = {(c, k) for c, k, *_ in found}
    assert {("comments", "comment"), ("images", "data"), ("embedded_documents", "data-url"), ("active_content", "event-handler"), ("links", "relative"), ("styles", "css-url")} <= kinds
    assert {("active_content", "script"), ("hidden_content", "p"), ("links", "refresh")} <= kinds


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("inspect")
    for name, data in {"c.xlsx": D.xlsx(), "h.eml": D.EML, "m.docx": b"no", "r.md": b"[a](b)", "z.bin": b"?"}.items():
        (path / name).write_bytes(data)
    return scan(spark, str(path)).cache()


def test_findings_coverage_and_reports(sources):
    names = {r.source_id: r.name for r in sources.select("source_id", "name").collect()}
    found = I.findings(sources).cache()
    got = {(names[r.source_id], r.capability) for r in found.collect()}
    assert {("c.xlsx", "formulas"), ("c.xlsx", "hidden_content"), ("h.eml", "attachments"), ("m.docx", "problem"), ("r.md", "links")} <= got
    status = {(names[r.source_id], r.capability): r.status for r in I.coverage(sources, found).collect()}
    assert status["m.docx", "links"] == "unavailable" and status["z.bin", "links"] == "not_applicable" and status["r.md", "images"] == "complete" and len(status) == 5 * 14
    reports = {names[r.source_id]: json.loads(r.report) for r in I.reports(sources).collect()}
    assert reports["r.md"]["findings"][0]["target"] == "b" and reports["m.docx"]["unavailable"] == 14 and set(reports) == set(names.values())
    assert all("findings" not in json.loads(r.report) for r in I.reports(sources, 10).collect())
    text = {names[r.source_id]: r.report for r in I.report_markdown(found).collect()}
    assert text["r.md"] == "## Links\n\n- link b"


def test_pages_table_has_findings(spark):
    pages = page_units(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert I.findings(pages).where("capability = 'links'").count() > 50
