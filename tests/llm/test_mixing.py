"""Poisson mixing against a plain version, and its means."""

import hashlib
import math

from daymark.llm import mixing


def plain_count(rate, doc_id, seed="mix"):
    draws = math.ceil(rate / 50)
    total = 0
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        mean, below, k = rate / draws, 0.0, 0
        while True:
            below += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
            if u < below or k > mean + 12 * math.sqrt(mean) + 20:
                break
            k += 1
        total += k
    return total


def rows(spark, n=3000):
    return spark.createDataFrame([(i, f"text {i}", None if i % 10 == 0 else "hot" if i % 10 < 7 else f"s{i % 10}", 9, "z") for i in range(n)],
                                 "doc_id long, text string, source string, copy int, rate string")


def test_counts_equal_the_plain_version(spark):
    weights = spark.createDataFrame([("hot", 1.0), ("s7", 4.0), ("s8", 200.0), ("", 1.0)], "source string, weight double")
    docs = rows(spark)
    got = {}
    for r in mixing.mix(docs, weights).collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    sizes = {"hot": 1800, "s7": 300, "s8": 300, "": 300}
    for i in range(3000):
        source = {0: "", 7: "s7", 8: "s8", 9: None}.get(i % 10, "hot")
        w = {"hot": 1, "s7": 4, "s8": 200, "": 1}.get(source)
        want = plain_count(w / 206 * 3000 / sizes[source], i) if w else 0
        assert sorted(got.get(i, [])) == list(range(want)), i


def test_rates_above_the_split_and_the_share_of_sources(spark):
    docs = rows(spark, 400).where("source is not null")
    weights = spark.createDataFrame([("hot", 1.0), ("s7", 99.0)], "source string, weight double")
    out = mixing.mix(docs, weights, epochs=20.0)
    by = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = docs.count() * 20
    assert set(by) == {"hot", "s7"}
    assert abs(by["s7"] - 0.99 * total) < 5 * math.sqrt(total) and abs(by["hot"] - 0.01 * total) < 5 * math.sqrt(0.01 * total)


def test_global_order_does_not_depend_on_partitions(spark):
    docs = rows(spark, 500)
    a = [(r["doc_id"], r["copy"]) for r in mixing.mix(docs.repartition(3)).collect()]
    b = [(r["doc_id"], r["copy"]) for r in mixing.mix(docs.repartition(7)).collect()]
    assert a == b and a != sorted(a)
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "copy", "rate", "shuffle_key"]


def test_odd_rows(spark):
    assert mixing.mix(rows(spark, 5).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (None, "a", None), (1, "", "x"), (1, "", "x")], "doc_id long, text string, source string")
    out = mixing.mix(odd, epochs=3.0).collect()
    assert {r["doc_id"] for r in out} <= {None, 1}
    ones = [r["copy"] for r in out if r["doc_id"] == 1]
    assert sorted(ones) == sorted(2 * sorted(set(ones)))  # equal rows draw alike
