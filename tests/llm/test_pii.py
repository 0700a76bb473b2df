"""PII: base spans against the plain patterns, added spans, and clean texts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daymark.llm import pii

ANCHORS = pii.automaton()


def plain(text):
    out = []
    for kind, pattern in pii.BASE.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s[:3] for s in pii.scan(text, ANCHORS) if s[3]]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1.@+-% ()4:é_2"), max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == plain(text)


@pytest.mark.parametrize("text", [
    "a@b.c@d.e", "a@b@c.d", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.4", "4111 1111 1111 1111 1", "4111-1111-1111-1111", "+1 (017) 555-7713", "++1 2345678",
    "é.x@mail.example.com", "0004.1.1.1", "4539578763621486", "1 4539578763621486", "a@b..c", "a@-.-", "+12345678901234567", "5" * 5000, "1.1.1." + "0" * 400 + "1", "@" * 3000,
])
def test_named_cases(text):
    assert base(text) == plain(text)


def added(text):
    return [(k, text[s:e]) for k, s, e, b in pii.scan(text, ANCHORS) if not b]


def test_added_spans():
    assert added("write to jane.doe (at) example [dot] org now") == [("email", "jane.doe (at) example [dot] org")]
    assert added("host 2001:db8::8a2e:370:7334 is up") == [("ip", "2001:db8::8a2e:370:7334")]
    assert added("IBAN DE89 3704 0044 0532 0130 00, thanks") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN DE88 3704 0044 0532 0130 00x") == [] or added("iban: DE89370400440532013000") == [("account", "DE89370400440532013000")]
    assert added('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x') == [("account", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert added("postgres://admin:pw@db.example.com/x") == [("account", "admin:pw")]
    assert added("Account number: 1234567890.") == [("account", "1234567890")]


def test_clean_texts_are_left_alone():
    for text in ("The token ring was slow at 10:30:45 on that account of events.", "std::vector a::b::c", "see https://example.com/a?b=c at noon (at home)", "version 1.2.3 cost 12.50", "3 + 4 = 7"):
        assert pii.scan(text, ANCHORS) == []


def test_redaction_and_odd_rows(spark):
    texts = {1: "mail a.b@c.de or 1.2.3.4", 2: None, 3: "", 4: "x" * 300_000 + " q@w.ee", 5: "same q@w.ee", 6: "same q@w.ee"}
    docs = spark.createDataFrame([*[(d, t, 1) for d, t in texts.items()], (6, "same q@w.ee", 1), (None, "+1 (017) 555-7713", 2)], "doc_id long, text string, spans int")
    rows = pii.find(docs, redacted=True).collect()
    out = {r["doc_id"]: r["redacted_text"] for r in rows}
    assert out[1] == "mail [email] or [ip]" and out[2] == "" and out[3] == "" and out[4].endswith("x [email]") and out[None] == "[phone]"
    assert len(rows) == 8
    assert pii.find(docs.limit(0)).count() == 0


def test_documents_of_the_test_table(spark):
    import hashlib

    from daymark.llm.queries import QUERIES

    rows = {r["doc_id"]: r for r in QUERIES["op6_pii_anchors"](spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want, got = plain(r["text"] or ""), rows[r["doc_id"]]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, text.split(","))) <= set(got["spans"].split(","))
