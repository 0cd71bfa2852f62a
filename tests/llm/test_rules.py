import re

from pyspark.sql import functions as F

from foliant.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if times[g] > 1 for p in (i, i + 1, i + 2)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "a", "a b", "a b c", "a b c d", "a a a a", "x y z x y z", "é\xa0b c d # * $ | < >", "l1\nl1\n \nl2\nl1", "A B C\n" * 40,
    "w " * 3000, " ".join(f"w{i}" for i in range(5000)), "ab cd ef gh " * 2 + "once more ab cd ef", "\n".join(["same line here"] * 3 + ["other"]),
]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x")], "doc_id long, text string, extra string")
    ledger = rules.apply_policy(rules.evaluate_rules(df))
    assert "extra" in ledger.columns
    for r in ledger.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id]), r
        assert not (r.base_failed and r.kept)
    assert rules.evaluate_rules(df.limit(0)).count() == 0
    clash = rules.apply_policy(rules.evaluate_rules(df.withColumn("n_words", F.lit(-1)).withColumn("kept", F.lit("k")).withColumn("failed_bits", F.lit(-2))))
    assert {(r.n_words_input, r.kept_input, r.failed_bits_input) for r in clash.collect()} == {(-1, "k", -2)}
    assert sorted((r.doc_id, r.n_words, r.kept) for r in clash.collect()) == sorted((r.doc_id, r.n_words, r.kept) for r in ledger.collect())


def test_clean_documents_are_kept_and_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    judged = rules.apply_policy(rules.evaluate_rules(docs))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    good = judged.join(labels, "doc_id").where("not base_failed")
    assert good.where("not kept").count() <= 0.02 * good.count()


def test_ablation_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ledger = rules.evaluate_rules(docs).cache()
    rows = ledger.select("failed_bits").collect()
    mask = rules.policy_mask(rules.POLICIES["v2"])
    for r in rules.ablation(ledger, "v2").collect():
        bit = 1 << rules.RULES[r.rule]
        assert r.n_failed == sum(bool(x.failed_bits & bit) for x in rows)
        assert r.n_only == sum(x.failed_bits & mask == bit for x in rows)
        assert r.n_kept_without == sum(not x.failed_bits & mask & ~bit for x in rows)
