"""Language mixtures: held-out accuracy, mixtures, and texts that no language explains."""

import random

import numpy as np
import pytest

from daymark.llm import langid
from daymark.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"
LANGS = {"aa": "ka te mo ri sa", "bb": "xu vol bri gen dax", "cc": "éla öne üsi çor ñad"}


def sentence(lang, n, rng):
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(i, sentence(lang, 60, rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(900, None, "aa"), (901, "x", None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy_on_the_test_table(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = QUERIES["op7_language_mixture"](spark, DIR).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 150
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_shares_of_a_mixed_text(model):
    rng = random.Random(1)
    text = sentence("aa", 200, rng) + " " + sentence("bb", 100, rng)
    name, score, shares, other = langid.judge(model, text)
    assert name == "aa" and 0.55 < score < 0.8 and other < 0.05
    assert {s.split(":")[0] for s in shares.split(",")} == {"aa", "bb"}
    assert langid.judge(model, sentence("cc", 50, rng))[:3] == ("cc", 1.0, "cc:1.000")


def test_texts_without_a_language(model):
    for text in (None, "", "123 !!! \n 4", "   "):
        assert langid.judge(model, text) == ("und", 0.0, "", 1.0)
    assert langid.judge(model, "ЖЩ ЪЫ ЭЮЯ ФХЦ ЧШЩ ЬЫЪ " * 20)[3] > 0.9
    assert langid.judge(model, "e")[0] in LANGS


def test_expectation_maximisation_equals_a_plain_version(model):
    rng = random.Random(2)
    text = sentence("aa", 80, rng) + sentence("cc", 60, rng)
    grams = langid.trigrams(text)
    pair = [model.names.index("aa"), model.names.index("cc")]
    share = np.ones(2) / 2
    for _ in range(200):
        joint = share[:, None] * model.rows[pair][:, grams]
        share = (joint / joint.sum(axis=0)).mean(axis=1)
    found = langid.shares(model, text)
    assert set(found) == set(pair)
    assert all(abs(found[i] - s) < 0.01 for i, s in zip(pair, share))


def test_frame_with_odd_rows(spark, model):
    rows = [(1, "kate mori", "k", 0.5), (1, "kate mori", "k", 0.5), (None, None, None, None), (2, "Xuvol brigen " * 9000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.predict(docs, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in out) == [("1", "aa"), ("1", "aa"), ("2", "bb"), ("None", "und")]
    assert langid.predict(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "shares", "unexplained"]
    empty = docs.limit(0)
    assert langid.identified(empty).count() == 0 and langid.identified(empty).columns == docs.columns
    nothing = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_too_many_labels_are_refused(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(langid.MAX_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(docs)
