import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ftrl, language, perplexity, toxicity
from foliant.llm.queries.op6 import op6_language_id
from foliant.llm.queries.op10 import op10_toxicity
from foliant.llm.sampling import bounded_sample, held_out

SF = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect())


def test_sample_is_bounded(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    n = {r.g: r["count"] for r in bounded_sample(df, "g", 50).groupBy("g").count().collect()}
    assert n == {0: 50, 1: 50, 2: 50}
    with pytest.raises(ValueError):
        bounded_sample(df, "doc_id", 1)


def test_language_accuracy_on_held_out(spark):
    got = op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_document_frequencies_cover_all_training_rows(spark):
    rows = [(i, f"the cat {i}", "en") for i in range(90)] + [(i, f"und ruft {i}", "de") for i in range(90, 100)] + [(100, "12", "en"), (101, "other", None)]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    both, en = (set(language._counts(t)[0].tolist()) for t in ("und ruft", "the cat"))
    assert en - both and all(math.isclose(model.idf[k], math.log(101 / 91) + 1) for k in en - both)
    assert all(math.isclose(model.idf[k], math.log(101 / 11) + 1) for k in both - en)


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog sat here", "en"), ("der Hund und die Katze sind da", "de")] * 30)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 !?", "en"), (903, "x" * 2_000_000, None), (None, "und die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(df)
    out = {r.doc_id: r for r in language.predict_language(df, model).collect()}
    assert len(out) == len(rows) and out[0].lang_pred == "en" and out[1].lang_pred == "de"
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (900, 901, 902)) and out[903].lang_pred in ("en", "de")
    empty = language.fit_language(df.limit(0))
    assert {r.lang_pred for r in language.predict_language(df, empty).collect()} == {"und"}
    clash = language.predict_language(df.withColumn("Score", F.lit(7)).withColumn("score_input", F.lit(8)), model)
    assert clash.columns == ["doc_id", "lang", "Score_input_input", "score_input", "lang_pred", "score"]
    assert {(r.Score_input_input, r.score_input) for r in clash.collect()} == {(7, 8)}


def test_toxicity_on_held_out(spark):
    rows = op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    wrong = sum(r.toxic == 0 and r.predicted == 1 for r in rows)
    assert hit >= 0.75 * sum(r.toxic for r in rows) and wrong <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "bad bad words"), (3, "bad bad words"), (None, "w " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0), (9, 7)], "doc_id long, label int")
    for use in (labels, labels.limit(0)):
        out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, use)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    clash = toxicity.score_toxicity(docs.withColumn("score", F.lit("x")).withColumn("predicted", F.lit(3)), toxicity.fit_toxicity(docs, labels))
    assert clash.columns == ["doc_id", "score_input", "predicted_input", "score", "predicted"] and clash.count() == 5


def brute_char_counts(text):
    """Counts by bucket of the 1-, 2- and 3-grams, hashed with whole numbers of Python."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    found = Counter()
    for n in language.ORDERS:
        for i in range(len(low) - n + 1):
            h = 0
            for k, c in enumerate(low[i : i + n]):
                h = (h * 0xC2B2AE3D27D4EB4F * (k > 0) + ord(c) + 1) % 2**64
            h = (h * 0xC2B2AE3D27D4EB4F + n) % 2**64
            found[(h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.BITS)] += 1
    return found


def test_language_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language(docs)
    got = {r.doc_id: r for r in language.predict_language(docs, model).collect()}
    rows = docs.collect()
    letters = [r.text for r in rows if any(c.isalpha() for c in r.text or "")]
    counts = {r.doc_id: brute_char_counts(r.text) for r in rows}
    df = Counter(b for r in rows if any(c.isalpha() for c in r.text) for b in counts[r.doc_id])
    for r in rows[:60]:
        if not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        value = {b: (1 + math.log(c)) * (math.log((1 + len(letters)) / (1 + df[b])) + 1) for b, c in counts[r.doc_id].items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        s = [(sum(v / norm * float(model.weight[b, k]) for b, v in value.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x - max(s)) for x in s]
        best = max(range(len(p)), key=p.__getitem__)
        assert got[r.doc_id].lang_pred == model.languages[best] and math.isclose(got[r.doc_id].score, p[best] / sum(p), rel_tol=1e-4)


def test_toxicity_scores_equal_brute_force(spark):
    import re

    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_toxicity(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert weight
    rows = docs.limit(150).collect()
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    mix = lambda h: (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)
    for r in rows:
        h = [xxhash.xxh64_intdigest(w) for w in re.findall(r"[^\W_]+", r.text.lower())]
        hit = {mix(x) for x in h}
        for gap in (1, 2, 3):
            salt = gap * 0x632BE59BD9B4E019 % 2**64
            hit |= {mix((a * 0xC2B2AE3D27D4EB4F % 2**64) ^ ((b + salt) % 2**64)) for a, b in zip(h, h[gap:])}
        score = 1 / (1 + math.exp(-max(-35, min(35, sum(weight.get(b, 0.0) for b in hit) + model.bias))))
        assert math.isclose(got[r.doc_id].score, score, rel_tol=1e-4) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_toxicity_learns_from_the_whole_of_long_rows(spark):
    cache = toxicity.WordHashes()
    bucket = lambda w: int(toxicity.word_gram_buckets(w, toxicity.BITS, cache)[0])
    word = max((f"bad{i}" for i in range(2000)), key=bucket)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 10**9, 6000)) + (f" {word}" if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")))
    assert all(len(np.unique(toxicity.word_gram_buckets(t, toxicity.BITS, cache))) > 20_000 for _, t in rows)
    assert model.dense()[bucket(word)] > 0


def test_ftrl_leaves_noise_without_weight():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [(np.unique(np.append(rng.integers(2, 500, 20), [0] if k else [1])), None) for k in y]
    rows = [(i, np.ones(len(i))) for i, _ in rows]
    w, b = ftrl.fit_binary(rows, y, 500, alpha=1.0, l1=8.0)
    assert w[0] > 0 > w[1] and (w[2:] != 0).mean() < 0.1
    score = np.array([w[i].sum() + b for i, _ in rows])
    assert ((score > 0) == (y == 1)).mean() > 0.97
    assert 0.9 < ftrl.temperature(np.array([[2.0, 0.0]] * 88 + [[0.0, 2.0]] * 12), np.zeros(100, int), 0.0) < 1.1


def brute_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over characters by dictionaries: the probability of an n-gram's last symbol."""
    counts = {order: Counter()}
    for t in texts:
        s = chr(2) * (order - 1) + t + chr(3)
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def prepared(c):
        n = Counter(x for x in c.values() if x <= 4)
        d = [0.5, 0.75, 0.9]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            r = lambda a, b: b / a if a else 0.0
            raw = (1 - 2 * y * r(n[1], n[2]), 2 - 3 * y * r(n[2], n[3]), 3 - 4 * y * r(n[3], n[4]))
            d = [min(max(x, 0.05), top) for x, top in zip(raw, (0.95, 1.9, 2.9))]
        total, held = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            held[g[:-1]] += d[min(x, 3) - 1]
        return d, total, held

    ready = {k: prepared(c) for k, c in counts.items()}

    def p(g):
        if not g:
            return 1 / 0x110000
        d, total, held = ready[len(g)]
        h, x = g[:-1], counts[len(g)].get(g, 0)
        if not total[h]:
            return p(g[1:])
        return (x - d[min(x, 3) - 1] if x else 0.0) / total[h] + held[h] / total[h] * p(g[1:])

    return p


def brute_nll(p, text, order):
    s = chr(2) * (order - 1) + text + chr(3)
    return -sum(math.log(p(s[i : i + order])) for i in range(len(s) - order + 1))


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity_equals_brute_force_on_whole_texts(spark, order, monkeypatch):
    """Several chunks, several shards, texts longer than a chunk, characters of all kinds."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["zzz Quite new ### é", "𝒳𝒴 漢字 ß", "a", " ", "\n" * 50, "the cat sat " * 500]
    rows = [(i, t, i % 3 == 0, "x") for i, t in enumerate(texts)] + [(98, None, True, "x"), (99, "", False, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, trusted boolean, lang string").repartition(3)
    monkeypatch.setattr(perplexity, "CHUNK_CHARS", 3000)
    table = perplexity.log_probabilities(df, order=order)
    p = brute_kneser_ney([t for i, t in enumerate(texts) if i % 3 == 0], order)
    known = {r.g: r.logp for r in table.collect()}
    assert all(math.isclose(known[g], math.log(p(g)), rel_tol=1e-9) for g in known)
    assert set(known) == {s[i : i + order] for t in texts for s in [chr(2) * (order - 1) + t + chr(3)] for i in range(len(s) - order + 1)}
    got = perplexity.score_texts(df.select("doc_id", "text", "lang"), table, shards=5, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id >= 98:
            assert (r._nll, r._symbols) == (0.0, 0)
        else:
            assert r._symbols == len(texts[r.doc_id]) + 1 and math.isclose(r._nll, brute_nll(p, texts[r.doc_id], order), rel_tol=1e-5)


def test_marks_inside_a_text_and_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "a" + chr(2) + "b" + chr(3), True), (2, "ab " * 4_000_000, True)], "doc_id long, text string, trusted boolean").repartition(2)
    table = perplexity.log_probabilities(df)
    assert not [r.g for r in table.collect() if chr(3) in r.g[:-1]]
    got = {r.doc_id: r for r in perplexity.score_texts(df.select("doc_id", "text"), table).collect()}
    assert got[2]._symbols == 12_000_001 and 0 <= got[2]._nll / got[2]._symbols < 0.01


def test_quality_equals_brute_force(spark):
    """Perplexity, threshold and verdict of every document, with two languages of enough documents and one too rare."""
    rng = np.random.default_rng(5)
    words = {"en": ["the", "cat", "sat", "on", "mat", "and", "dog"], "de": ["und", "der", "Hund", "Katze", "saß", "auf"], "fr": ["le", "chat"]}
    rows = [(i, " ".join(rng.choice(words[x], int(rng.integers(3, 60)))), x) for i, x in enumerate(["en"] * 220 + ["de"] * 180 + ["fr"] * 10)]
    rows += [(500, "qqq zzz xxx " * 20, "en"), (501, "cat the on sat " * 9, None), (502, "", "en"), (503, None, "de"), (504, "und der " * 9, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = df.where("doc_id < 410").select("doc_id")
    aside = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(perplexity.CALIBRATION)) == 0).collect()}
    p = brute_kneser_ney([t for i, t, _ in rows if i < 410 and i not in aside], perplexity.ORDER)
    nll = {i: brute_nll(p, t, perplexity.ORDER) for i, t, _ in rows if t}
    size = {i: len(t) + 1 for i, t, _ in rows if t}
    lang = {i: x for i, _, x in rows}
    mean = lambda ids: sum(nll[i] for i in ids) / sum(size[i] for i in ids)
    of = {x: [i for i in aside if lang[i] == x] for x in words}
    assert min(len(of["en"]), len(of["de"])) >= perplexity.LEAST > len(of["fr"])
    level = {x: mean(of[x]) for x in ("en", "de")}
    drawn = lambda i: (nll[i] + perplexity.PRIOR * level.get(lang[i], mean(aside))) / (size[i] + perplexity.PRIOR)
    quantile = lambda ids: sorted(map(drawn, ids))[math.ceil(perplexity.QUANTILE * len(ids)) - 1]
    bound = {x: quantile(of[x]) for x in level}
    got = {r.doc_id: r for r in perplexity.judge_quality(df, trusted).collect()}
    assert len(got) == len(rows)
    for i, t, x in rows:
        r, limit = got[i], bound.get(x, quantile(aside))
        assert math.isclose(r.threshold, math.exp(limit), rel_tol=1e-4)
        if t:
            assert math.isclose(r.perplexity, math.exp(nll[i] / size[i]), rel_tol=1e-4)
            assert abs(drawn(i) - limit) < 1e-4 or r.kept == (drawn(i) <= limit)
        else:
            assert r.perplexity is None and not r.kept
    assert not got[500].kept


def test_quality_keeps_good_and_handles_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = perplexity.judge_quality(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "some text", "en"), (3, "some text", "en"), (None, "x", None)], "doc_id long, text string, lang string")
    for trusted in (odd.select("doc_id"), odd.select("doc_id").limit(0)):
        out = {(r.doc_id, r.kept, r.perplexity is None) for r in perplexity.judge_quality(odd, trusted).collect()}
        assert {(1, False, True), (2, False, True)} <= out and len(out) == 4
    assert perplexity.judge_quality(odd.limit(0), odd.select("doc_id")).count() == 0
