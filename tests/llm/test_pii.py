import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The base kinds by plain regular expressions over the whole text."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.+-_ 0123456789()%\né", max_size=60))
def test_base_kinds_equal_plain_expressions(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    "text",
    [
        "", "@", "a@b", "x a.b+c@d-e.f.g@h.i", "1.2.3.4.5.6.7.8", "300.1.1.1 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
        "+1 (523) 555-1055 équeou", "++1 234 567 890", "000.000.000.0255", "+4111111111111111", "7" * 5000, "1 " * 3000, "a" * 5000 + "@",
    ],
)
def test_base_kinds_on_edges(text):
    assert base(text) == brute(text)


def test_cues_add_accounts_secrets_and_addresses():
    text = 'Account no: 12345678. IBAN DE89 3704 0044 0532 0130 00, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mailto:a.b@c.org https://u:p@h.org/x https://h.org/a@b'
    kinds = [(k, text[s:e]) for k, s, e in pii.find_spans(text)]
    assert ("account", "12345678") in kinds and ("account", "DE89 3704 0044 0532 0130 00") in kinds
    assert ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff") in kinds
    assert ("address", "mailto:a.b@c.org") in kinds and ("address", "https://u:p@h.org/x") in kinds
    assert not any("https://h.org" in t for _, t in kinds)


def test_masking_joins_overlaps():
    text = "call +1 (523) 555-1055 or mailto:a@b.org now"
    assert pii.masked(text, pii.find_spans(text)) == "call <PHONE> or <ADDRESS> now"


def test_query_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.org", "x"), (3, "a@b.org", "x"), (None, "8.8.8.8", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.spans) for r in pii.personal_data(df).collect()}
    assert got == {(1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:7"), (None, 0, 1, "ip:0:7")}
    digests = [r.base_sha256 for r in pii.personal_data(df).where("doc_id = 3").collect()]
    assert digests == [hashlib.sha256(b"email:0:7").hexdigest()] * 2
    assert pii.personal_data(df.limit(0)).count() == 0
    assert [r.text for r in pii.mask_personal_data(df).where("doc_id < 3").collect()] == [None, ""]


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.base_sha256 for r in pii.personal_data(docs).collect()}
    want = {r.doc_id: hashlib.sha256(pii.joined(brute(r.text)).encode()).hexdigest() for r in docs.collect()}
    assert got == want


@pytest.mark.parametrize("unit", ["token=", "a://", "mailto:", "x@y://", "1 ", "+1 ", "1."])
def test_hostile_texts_take_linear_time(unit):
    text = unit * (10_000_000 // len(unit))
    began = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - began < 20


def test_runs_without_a_key_do_not_hide_later_keys():
    text = "token=" * 50 + " token=abcdefghijklmnop1234 a://b://u@host.org/x"
    assert [s[0] for s in pii.find_spans(text) if s[0] in ("secret", "address")] == ["secret", "address"]
