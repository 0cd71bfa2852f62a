import corpus_pipeline as cp
import public_tokenizers
from tokenizers import Tokenizer

from foliant.llm import pii
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    one = cp.cut_lineage(cp.language_stage(spark, docs, SF))
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept >= {i for i, r in rows.items() if sum(c.isalpha() for c in r.text) > 200}
    two = cp.cut_lineage(cp.near_dedup_stage(spark, one, SF))
    roots = brute_components({i: brute_fingerprint(rows[i].text) for i in kept})
    first = {i for i, c in roots.items() if i == c}
    assert sorted(r.doc_id for r in two.collect()) == sorted(first) and two.columns == docs.columns
    three = cp.cut_lineage(cp.decontamination_stage(spark, two, SF))
    clean = {i for i in first if not leaks(items, rows[i].text)}
    assert {r.doc_id for r in three.collect()} == clean and len(clean) < len(first)
    four = cp.cut_lineage(cp.personal_data_stage(spark, three, SF))
    texts = {r.doc_id: r.text for r in four.collect()}
    assert texts == {i: pii.masked(rows[i].text, pii.find_spans(rows[i].text)) for i in clean}
    assert all(r.n_chars == len(r.text) for r in four.collect()) and four.columns == docs.columns
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = cp.packing_stage(spark, four, SF).collect()
    assert sum(r.length for r in packed) == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    whole = cp.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in whole if r.start == 0 and r.length == r.doc_tokens} and {r.doc_id for r in whole} == clean


def test_stages_on_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _id int, _first int, predicted int, failed_bits int"
    long = "This is a rather long text about nothing much. " * 3000
    rows = [
        (1, None, "en", "a", None, 1.0), (2, "", None, None, 0, None), (3, "12 34", "en", "a", 5, 1.0), (4, long, "en", "a", 1, 1.0),
        (5, long, "en", "a", 1, 1.0), (5, long, "en", "a", 1, 1.0), (None, "Some other words of a text here", None, "a", 1, 1.0),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], schema)
    for docs_in in (docs, docs.limit(0)):
        at = docs_in
        for name, stage in cp.STAGES:
            at = cp.cut_lineage(stage(spark, at, SF))
            if name != "packing":
                assert at.columns == docs.columns
        got = {r.doc_id for r in at.collect()}
        assert got == ({4, None} if docs_in is docs else set())
