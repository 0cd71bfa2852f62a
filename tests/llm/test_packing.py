import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(lengths, pieces, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        assert n > 0
        by_doc[d].append((s, n))
        by_seq[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(by_doc[d]):
            assert s == at
            at += k
        assert at == n
    fills = []
    for q, parts in by_seq.items():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at <= length
        fills.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert all(f & (f - 1) == 0 for f in fills)  # no sequence needs padding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_every_token_is_in_one_piece(lengths):
    check(lengths, packing.pack(lengths, 64), 64)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 900, 3000).tolist()
    pieces = packing.pack(lengths)
    check(lengths, pieces, 4096)
    cost = defaultdict(float)
    for _, _, n, q, o in pieces:
        cost[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [cost[q] for q in cost if sum(n for _, _, n, p, _ in pieces if p == q) == 4096]
    assert np.std(full) / np.mean(full) < 0.05


def test_chunked_ids_equal_the_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text for r in docs] + ["", " ", "\n\n a\tb　c\x1cd  e", "İstanbul ΣΑΣ Ǆ é ́x", "<|endoftext|>a b<|endoftext|>", "don't 12 3,4 x" * 50, "_a__b ½²³ ªº ŉ it'ſ 'S 'll rock'n'roll", "a\xa0b\x85c\u2003d\xade", "".join(map(chr, range(1, 600)))]
    t, plain = packing.WordTokens(PATH), Tokenizer.from_file(PATH)
    assert packing.words_are_known(PATH)
    for x in texts:
        assert t.encode(x).tolist() == plain.encode(x, add_special_tokens=False).ids
    t.clear()
    t.MOST = 50  # a full generation at every step
    got = [t.encode(x).tolist() for x in texts]
    assert got == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_query_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "one two three", 0), (3, "one two three", 0), (None, "word " * 9000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(1)
    got = packing.pack_documents(df, PATH, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    whole = sorted((r for r in got if r.doc_id is None), key=lambda r: r.start)
    assert [i for r in whole for i in r.ids] == plain.encode("word " * 9000, add_special_tokens=False).ids + [2]
    assert sum(r.length for r in got if r.doc_id == 1) == 1 and sum(r.length for r in got if r.doc_id == 3) == 8
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_random_latin_texts_equal_the_tokenizers():
    rng = np.random.default_rng(2)
    letters = "abcXYZéßÄ'’ .,-_0129\n\t\xa0½²µĀŁſ<|>&$ts\x85\x1cİ中"
    t, plain = packing.WordTokens(PATH), Tokenizer.from_file(PATH)
    t.MOST = 2000
    for n in rng.integers(0, 40, 5000):
        x = "".join(letters[i] for i in rng.integers(0, len(letters), n))
        assert t.encode(x).tolist() == plain.encode(x, add_special_tokens=False).ids


def test_a_document_longer_than_a_block(spark):
    long = "some words of a text. " * 900_000
    df = spark.createDataFrame([(1, "short"), (2, long), (3, "short")], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df, PATH).collect()
    one = len(Tokenizer.from_file(PATH).encode("some words of a text.", add_special_tokens=False).ids)
    own = sorted((r.start, r.length) for r in got if r.doc_id == 2)
    assert 900_000 * one + 1 > packing.BLOCK_TOKENS
    assert sum(n for _, n in own) == 900_000 * one + 1 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
