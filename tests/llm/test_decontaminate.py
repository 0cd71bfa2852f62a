import random
from collections import Counter
import math

from foliant.llm import decontaminate as dc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def brute(items, text):
    """Every part of every item scored against every passage."""
    parts = []
    for k, (_, t) in enumerate(items):
        q, a = dc.question_and_answer(t or "")
        w = q + a
        for at in range(0, len(w), dc.WINDOW):
            p = w[at : at + dc.WINDOW]
            cut = min(max(len(q) - at, 0), dc.WINDOW)
            parts.append((k, p[:cut], p[cut:]))
    bags = [Counter(q + a) for _, q, a in parts]
    n, df = len(bags), Counter(w for b in bags for w in b)
    mean = sum(sum(b.values()) for b in bags) / max(n, 1)
    words, found = dc.words_of(text), set()
    for start in range(0, max(len(words), 1), dc.WINDOW):
        passage = words[start : start + 2 * dc.WINDOW]
        have = set(passage)
        for (k, q, a), bag in zip(parts, bags):
            size = sum(bag.values())
            imp = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size / mean)) for w, c in bag.items()}
            if sum(v for w, v in imp.items() if w in have) >= 0.6 * sum(imp.values()) - 1e-9:
                if lcs(q, passage) >= 0.8 * len(q) and lcs(a, passage) >= 0.8 * len(a):
                    found.add(k)
    return found


def test_search_equals_brute_force():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + [f"longer{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 90)))) for i in range(150)] + [(150, None), (151, "!?"), (152, "What is it? A cat")]
    index = dc.ItemIndex.build(items)
    some = 0
    for n in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 400)))
        if n % 2:
            words = items[rng.randrange(150)][1].split()
            for _ in range(len(words) // 6):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = f"{text} {' '.join(words)} {text[:300]}"
        got = set(index.search(text))
        some += len(got)
        assert got == brute(items, text)
    assert some > 20


def test_wand_finds_what_plain_sums_find(monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(3, 40)))) for i in range(1500)]
    index = dc.ItemIndex.build(items)
    assert max(len(p.parts) for p in index.postings) > 10 * dc.BLOCK
    hits = 0
    for n in range(60):
        words = set(rng.choices(vocabulary, weights, k=rng.randint(0, 90))) | set(items[rng.randrange(1500)][1].split() if n % 2 else [])
        plain = Counter()
        for w in words & set(index.terms):
            p = index.postings[index.terms[w]]
            plain.update(dict(zip(p.parts, p.impacts)))
        got = index.due(words)
        want = sorted(part for part, x in plain.items() if x >= 1 - 1e-9)
        assert [part for part, _ in got] == want and all(math.isclose(x, plain[part]) for part, x in got)
        hits += len(got)
    assert hits > 100


def test_blocks_end_by_words_too(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 30)
    items = [(i, f"what stands in line {i} of the book of tables? it is entry number {i} and nothing more") for i in range(7)] + [(7, "alone " + "long item " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [len(b.item_ids) for b in dc._blocks(bench, "item_id", "text", 100)] == [1] * 8
    docs = spark.createDataFrame([(i, f"so {t} it goes") for i, t in items] + [(50, "clean")], "doc_id long, text string")
    assert {r.doc_id for r in dc.drop_leaks(docs, bench).collect()} == {50}
    assert {(i, i) for i in range(8)} <= {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}


def test_long_items_are_verified_as_a_whole(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    items, docs, want = [], [], set()
    for k, (nq, na) in enumerate([(64, 1), (64, 30), (10, 55), (130, 70), (33, 200), (500, 400), (20, 10)]):
        q, a = rng.sample(vocabulary, nq), rng.sample(vocabulary, na)
        items.append((k, f"{' '.join(q)}? {' '.join(a)}"))
        thinned = [w for i, w in enumerate(q) if i % 8], [w for i, w in enumerate(a) if i % 8 or na < 5]
        pad = lambda: rng.choices(["filler", "more"], k=rng.randint(0, 300))
        for whole, (x, y) in ((True, (q, a)), (True, thinned), (False, (q, [])), (False, ([], a)), (False, (q[: nq // 2], a)), (False, ([], a[-1:]))):
            docs.append((len(docs), " ".join([*pad(), *x, *y, *pad()])))
            if whole:
                want.add((len(docs) - 1, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench).collect()} == want
    assert {r.doc_id for r in dc.drop_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_common_in_order():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 20)) for _ in range(2))
        assert dc.common_in_order(a, b) == lcs(a, b)


def test_leaks_edges(spark):
    item = "What colour is the northern sky at early morning in summer? It is pale green and silver"
    bench = spark.createDataFrame([(1, item), (1, item), (None, "alpha beta gamma delta epsilon"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, f"x {item.upper()} y"), (3, f"x {item.upper()} y"), (None, "z " * 5000 + "alpha beta, gamma delta epsilon"), (5, "nothing here")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    want = [(3, 1)] * 4 + [(None, None)]
    for size in (2, 100):
        got = [(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench, block_items=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 and dc.find_leaks(docs.limit(0), bench).count() == 0


def test_verbatim_items_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    flat = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in flat if t in " ".join(r.text.split())}
    assert want and got >= want and len(got - want) <= len(want) // 10
