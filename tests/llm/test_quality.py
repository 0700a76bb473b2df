"""Quality rules: statistics against a plain version, the estimator against numpy, and verdicts on the labelled table."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.llm import quality

DIR = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    triples = list(zip(words, words[1:], words[2:]))
    times = Counter(triples)
    covered = {j for i, t in enumerate(triples) if times[t] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_the_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\n\nx y z ", "é\x0bü\x0cß #*$%&|<>", "a b a b a b a b", "w " * 30000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["l m", "l  m", "", " ", "n#"]) for _ in range(rng.randint(0, 12))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, words int, t int")
    for r in quality.statistics(docs).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == plain(texts[r["doc_id"]]), texts[r["doc_id"]][:50]


def distances(x, mean, cov):
    off = x - mean
    return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([5, 1, 2, 0, 1], np.diag([2, 0.5, 1, 0.3, 1]) + 0.2, 900)
    bad = rng.normal(20, 0.5, (200, 5))
    x = np.concatenate([good, bad])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"x{i} double" for i in range(5)))
    estimated = quality.robust_estimates(rows)
    model = estimated.first()
    mean = np.array([model[f"m{i}"] for i in range(5)])
    factor = np.zeros((5, 5))
    for i, j in quality.PAIRS:
        factor[i, j] = model[f"l{i}{j}"]
    cov = factor @ factor.T
    assert np.abs(mean - good.mean(axis=0)).max() < 0.2
    assert np.abs(cov - np.cov(good.T) - np.diag(quality.FLOORS)).max() < 0.6
    frame = quality.with_distance(rows.join(F.broadcast(estimated), "g"))
    got = np.array([r["d2"] for r in frame.orderBy("x0", "x1").collect()])
    order = np.lexsort((x[:, 1], x[:, 0]))
    assert np.allclose(got, distances(x, mean, cov)[order], rtol=1e-6)
    assert (distances(bad, mean, cov) > quality.CUT).all() and (distances(good, mean, cov) < quality.CUT).all()


def test_a_concentration_step_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, [1, 2, 1, 1, 3], (400, 5))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"x{i} double" for i in range(5)))
    start = quality.median_start(rows)
    after = quality.concentrated(rows, start).first()
    s = start.first()
    d2 = distances(x, np.array([s[f"m{i}"] for i in range(5)]), np.diag([s[f"l{i}{i}"] ** 2 for i in range(5)]))
    bins = np.floor(20 * np.log1p(d2))
    inner = x[bins <= np.sort(bins)[299]]
    cov = np.cov(inner.T, bias=True) * quality.CONSISTENT_75 + np.diag(quality.FLOORS)
    assert np.allclose([after[f"m{i}"] for i in range(5)], inner.mean(axis=0), atol=1e-9)
    assert np.isclose(after["logdet"], np.linalg.slogdet(cov)[1])


def test_verdicts_on_the_test_table(spark):
    rows = quality.judged(spark.read.parquet(f"{DIR}/documents.parquet")).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    poor = [r for r in rows if labels.get(r["doc_id"]) == 0]
    assert len(rows) == 1000
    assert np.mean([r["kept"] for r in good]) > 0.98
    assert np.mean([r["kept"] for r in poor]) < 0.3
    assert not any(r["kept"] for r in rows if r["base_failed"])


@pytest.mark.parametrize("n", [0, 1, 20])
def test_too_few_rows_reject_nothing(spark, n):
    docs = spark.createDataFrame([(i if i else None, " ".join(f"w{i}x{j}" for j in range(60)), None, None) for i in range(n)], "doc_id long, text string, lang string, source string")
    rows = quality.judged(docs).collect()
    assert len(rows) == n and all(r["kept"] and r["distance"] is None for r in rows)


def test_small_sources_are_pooled(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60 + i % 9)), "aa", f"s{i % 7}") for i in range(100)]
    rows.append((1000, "### " * 400, "aa", "s0"))
    rows.append((1001, " ".join(f"#w{j}" + "*" * 9 for j in range(300)), "aa", "s1"))
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[1000]["base_failed"] and not out[1001]["base_failed"] and not out[1001]["kept"]
    assert all(out[i]["kept"] and out[i]["distance"] is not None for i in range(100))
