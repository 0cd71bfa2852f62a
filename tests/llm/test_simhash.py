import re
from itertools import combinations

import numpy as np
import xxhash

from foliant.llm import golay, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_equal_brute_force():
    texts = ["", " \n", "A", "a B", "One two three", "x " * 500 + "y", "É è\tÇ ü A\x0bb", "a\xa0b c d e", "w" * 9000]
    texts += [" ".join(f"W{i * k % 97}" for i in range(k * 7)) for k in range(1, 20)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    long = " ".join(map(str, range(3000)))
    assert simhash.fingerprint(long, chunk=128) == brute_fingerprint(long)


def test_words_within_two_bits_share_a_golay_key():
    rng = np.random.default_rng(3)
    words = np.concatenate([rng.integers(0, 1 << 23, 400), [0, (1 << 23) - 1]])
    own = [set(r[r >= 0]) for r in golay.fuzzy_keys(words)]
    for n in (1, 2):
        for places in combinations(range(23), n):
            flipped = words ^ sum(1 << p for p in places)
            for a, r in zip(own, golay.fuzzy_keys(flipped)):
                assert a & set(r[r >= 0])


def run(spark, fps, hot):
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in sorted(set(fps.values()))], "fp long")
    links = {(r.a, r.b) for r in simhash.near_links(frame, hot).collect()}
    return links


def test_links_give_the_exact_components_hot_or_not(spark):
    rng = np.random.default_rng(11)
    fps, base = {}, [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for i in range(260):
        v = base[i % len(base)]
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            v ^= 1 << int(b)
        fps[i] = v
    want = brute_components(fps)
    for hot in (2, 10_000):
        root = {v: v for v in fps.values()}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in run(spark, fps, hot):
            a, b = (int(np.int64(x).view(np.uint64)) for x in (a, b))
            assert bin(a ^ b).count("1") <= 2
            x, y = sorted((find(a), find(b)))
            root[y] = x
        groups = {}
        for i, v in fps.items():
            groups.setdefault(find(v), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    assert {i: int(np.int64(f).view(np.uint64)) for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == want


def test_edges(spark):
    rows = [(5, None, "k"), (3, "", "k"), (3, "", "k"), (None, "one two three four", None), (9, "one two three four", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 9), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_first_with_repeated_ids_and_by_shuffle(spark):
    other = "quite another text with words of its own that nobody has copied"
    rows = [(1, "one text that is long enough", 5), (1, "one text that is long enough", 4), (2, "one text that is long enough", 3), (3, other, 2), (3, "a third", 1), (None, other, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    want = [(1, "one text that is long enough", 4), (3, "a third", 1), (None, other, 9)]
    for most in (0, 10):
        got = [tuple(r) for r in simhash.keep_first(df, broadcast_ids=most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
