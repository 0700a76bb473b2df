"""The pipeline, stage by stage, on what the stage before it kept."""

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from daymark.llm import langid
from daymark.llm.common import documents, table
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_mixing import plain_count
from tests.llm.test_nearcopies import plain_kept

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = documents(spark, DIR)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], DIR), name))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_entry(spark, stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mix", "pack"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, DIR).count() == stages[-1].count()


def test_language_stage(spark, stages):
    judged = langid.predict(stages[0], langid.train(langid.learned(stages[0]))).collect()
    want = {r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["unexplained"] <= 0.5}
    assert set(rows(stages[1])) == want and len(want) > 0.95 * len(judged)


def test_line_stage(stages):
    want = {d: t for d, (_, _, t) in plain_lines(list(rows(stages[1]).items())).items()}
    got = stages[2].collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_duplicate_stage(stages):
    docs = sorted(rows(stages[2]).items())
    assert set(rows(stages[3])) == {docs[i][0] for i in plain_kept(docs)}


def test_mixing_stage(stages):
    sources = {r["doc_id"]: r["source"] for r in stages[3].collect()}
    sizes = Counter(sources.values())
    total = sum(n ** 0.7 for n in sizes.values())
    want = {d: plain_count(sizes[s] ** 0.7 / total * len(sources) / sizes[s], d) for d, s in sources.items()}
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert got == {d: n for d, n in want.items() if n}


def test_packing_stage(stages):
    texts = rows(stages[4])
    packed = stages[5].collect()
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    pieces = Counter((r["doc_id"], r["piece"]) for r in packed)
    assert all(n == copies[d] for (d, _), n in pieces.items()) and {d for d, _ in pieces} == set(texts)
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    once = {}
    for r in packed:
        once.setdefault((r["doc_id"], r["piece"]), r)
    assert sum(r["length"] for r in packed) <= 2048 * len({r["sequence_id"] for r in packed})



def test_columns_called_like_an_operators_own_keep_their_values(spark):
    rows = [(i, f"line {i} of some text that goes on for a while\nand more", "en", "s", 7.5, 77, "k", 3, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rate double, n_lines int, shuffle_key string, copy int, n_dropped int")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all((r["rate"], r["n_lines"], r["shuffle_key"], r["copy"], r["n_dropped"]) == (7.5, 77, "k", 3, r["doc_id"]) for r in got)
