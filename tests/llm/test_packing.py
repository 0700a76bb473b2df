"""Packing: ids against the tokenizer, plans against the lower bound, places against the contract."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daymark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a", "a  b", "a \n b\n  c", "\n", "   ", " x\t y", "a\n\n b", " don't  we're 's", "<|endoftext|> x <|endoftext|>", "a　  b", "é è\n\n\n  q", "x" * 3000, "\x1c a \x1c"]


def reference():
    import tokenizers

    inner = tokenizers.Tokenizer.from_file(PATH)
    inner.encode_special_tokens = True
    return lambda text: inner.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    ids, words = reference(), packing.WordTokens(PATH)
    assert words.apart
    for text in ODD * 2:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t 　'.19ÄЖ中\x1c"), max_size=30))
def test_any_text_has_the_same_ids(text):
    assert np.frombuffer(WORDS.encode(text), "<u4").tolist() == IDS(text)


WORDS, IDS = packing.WordTokens(PATH), reference()


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 7, 64, 2048])
    counts = np.zeros(size + 1, np.int64)
    for _ in range(rng.choice([0, 3, 200, 5000])):
        counts[rng.randint(1, size)] += rng.choice([1, 1, 40])
    used, sequences = np.zeros(size + 1, np.int64), 0
    for pattern, times in packing.plan(counts, size):
        assert times > 0 and sum(pattern) <= size
        sequences += times
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    # Neither fewer than the tokens fill, nor fewer than there are pieces longer than half a sequence.
    bound = max(-(-int((counts * np.arange(size + 1)).sum()) // size), int(counts[size // 2 + 1 :].sum()))
    assert bound <= sequences <= bound * (1.02 if size == 2048 else 1.1) + 2


def test_plans_do_not_grow_with_the_number_of_pieces():
    counts = np.random.default_rng(1).integers(1, 50, 2049)
    counts[0] = 0
    assert len(packing.plan(counts * 10_000_000, 2048)) < 3 * 2048


def check(rows, texts, size):
    ids = reference()
    by_sequence, got = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        got.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    for doc_id, text in texts.items():
        whole = np.array([*ids(text or ""), 0], "<u4")
        parts = sorted(got[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(whole) // size)
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(whole[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    return by_sequence


def test_pieces_and_places(spark):
    from daymark.llm.queries import digested

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["token", "ab", "Wörter", "the"]) for _ in range(rng.randint(0, 90))) for i in range(150)}
    texts |= {200 + i: t for i, t in enumerate(ODD)} | {300: None, 301: "same", 302: "same"}
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in texts.items()], "doc_id long, text string, length int, offset string")
    rows = packing.pack(digested(packing.tokenise(docs, size=64)), size=64).collect()
    sequences = check(rows, texts, 64)
    bound = -(-sum(r["length"] for r in rows) // 64)
    assert len(sequences) <= bound + 2


def test_equal_rows_and_the_empty_table(spark):
    from daymark.llm.queries import digested

    docs = spark.createDataFrame([(1, "again and again")] * 30, "doc_id long, text string")
    rows = packing.pack(digested(packing.tokenise(docs, size=16)), size=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 30
    assert packing.pack(digested(packing.tokenise(docs.limit(0)))).count() == 0
    missing = spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string")
    assert packing.pack(packing.tokenise(missing)).count() == 2


def test_documents_of_the_test_table(spark):
    from daymark.llm.queries import QUERIES

    rows = QUERIES["op3_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sequences = check(rows, {r["doc_id"]: r["text"] for r in docs}, 2048)
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    """As the library gives them by its defaults."""
    import tokenizers

    from daymark.llm.queries import QUERIES

    plain = tokenizers.Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "no such token", *ODD]
    words = packing.WordTokens(PATH, added=True)
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect():
        ids = np.array([*plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        if len(ids) <= 2048:
            assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
