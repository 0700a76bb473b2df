"""SimHash near-dedup against all pairs, with every level of sharding."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daymark.llm import simhash
from daymark.llm.graph import components


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """doc ids and fingerprints to the smallest reachable doc_id, by all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {k: min([d for d in v if d is not None], default=None) for k, v in groups.items()}
    return [low[find(i)] for i in range(len(rows))]


TEXTS = [None, "", " \t\n", "one", "One", "a b c", "Ünï ÄB ab cd e f g", "x " * 5000, "a b c d", "A B C D", "a b c d e\x0bf"]


def test_fingerprint_is_the_contract():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shard", [4096, 16, 3])
def test_components_equal_all_pairs(spark, shard):
    rng = random.Random(shard)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in prints[:3]:
        for _ in range(60):
            value = base
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                value ^= 1 << bit
            prints.append(value)
    prints += [0, 1, (1 << 64) - 1, (1 << 63)] + prints[:5]
    rows = [(1000 - i, p) for i, p in enumerate(prints)]
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    roots = components(simhash.links(df.select("fp").distinct(), shard=shard)).collect()
    root = {r["node"]: r["root"] for r in roots}
    low = {}
    for d, p in signed:
        key = root.get(p, p)
        low[key] = min(low.get(key, d), d)
    assert [low[root.get(p, p)] for _, p in signed] == plain_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    texts = TEXTS + ["the same long text of several words in a row"] * 4
    rows = [(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)] + [(20, "again", "y", 1), (20, "again", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = plain_components(pairs)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == sorted(
        ((d, f, c) for (d, f), c in zip(pairs, want)), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(20) == 1 and None in ids and len(set(ids)) == len(ids)
    assert set(ids) == {c for c in want if c is not None} | {None}


def test_documents_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip([d for d, _ in rows], plain_components(rows)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_search_follows_only_edges_within_the_radius():
    values = np.array([random.Random(5).getrandbits(64) for _ in range(300)], np.uint64)
    keys, children, roots = simhash.forest(values, np.zeros(300, np.int64))
    assert len(children) == 299 and set(children.tolist()) == set(range(1, 300)) and (roots == 0).all()
    distance = np.bitwise_count(values[children] ^ values[keys // 65])
    assert (distance == keys % 65).all()


def test_components_of_a_chain_and_a_star(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(100, 400).select(F.lit(99).cast("long").alias("a"), F.col("id").alias("b"))
    roots = {r["node"]: r["root"] for r in components(chain.unionByName(star)).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(99, 400), 99)}
