"""Shards by the histogram sort against one sort of all rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from daymark.llm import sharding

COLUMNS = "doc_id long, text string, shard string, size string, slot double, extra int"


def digest(value):
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:15], 16)


def plain(docs, shards):
    """{doc_id: (shard, slot)} of rows whose ids are distinct."""
    rows = [(digest(t), digest(d), d, len((t or "").encode()) + 8) for d, t in docs]
    total = sum(r[3] for r in rows)
    large = sorted((r for r in rows if r[3] > total // (shards * 16)), key=lambda r: (-r[3], r[0], r[1]))
    held, out, n = [0] * shards, {}, [0] * shards
    for r in large:
        i = held.index(min(held))
        held[i] += r[3]
        out[r[2]] = (i, n[i])
        n[i] += 1
    small = sorted(r for r in rows if r[2] not in out)
    rest, low = sum(r[3] for r in small), sorted(held)
    level = max((rest + sum(low[:k])) // k if (rest + sum(low[:k])) // k >= low[k - 1] else -1 for k in [max(k for k in range(1, shards + 1) if (rest + sum(low[:k])) // k >= low[k - 1])])
    ends, upto = [], 0
    for h in held[:-1]:
        upto += max(0, level - h)
        ends.append(upto)
    before = 0
    for r in small:
        i = sum(2 * e < 2 * before + r[3] for e in ends)
        out[r[2]] = (i, n[i])
        n[i] += 1
        before += r[3]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    docs = [(i, "t" * rng.randrange(0, 60) + str(rng.randrange(10**6))) for i in range(n)]
    docs += [(n + i, "one text that a third of all rows hold") for i in range(n // 2)]
    docs += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, "ä" * 4000), (2 * n + 3, "x" * 3000), (None, "no id")]
    rng.shuffle(docs)
    return docs


def run(spark, docs, parts=5, **given):
    df = spark.createDataFrame([(d, t, "clash", "clash", 0.5, 3) for d, t in docs], COLUMNS).repartition(parts)
    return sharding.shard(sharding.measured(df), **given).collect()


@pytest.mark.parametrize("n,shards", [(400, 24), (900, 5), (30, 24), (200, 1)])
def test_equal_to_plain(spark, n, shards):
    docs = corpus(n, n)
    got = run(spark, docs, shards=shards, tolerance=0.0)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == plain(docs, shards) and len(got) == len(docs)
    texts = dict(docs)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and r["extra"] == 3 and r["text"] == texts[r["doc_id"]] for r in got)


@pytest.mark.parametrize("tolerance", [1e-6, 0.05])
def test_near_equal_and_gapless(spark, tolerance):
    docs = corpus(1, 3000)
    docs += [(7, "repeated row")] * 700 + [(None, None)] * 300
    got = run(spark, docs, parts=9, shards=24, tolerance=tolerance)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 24
    assert len(got) == len(docs) and set(sizes) == set(range(24))
    assert all(abs(s - mean) <= (0.02 + tolerance) * mean for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, "a"), (2, None)])
    assert len({r["shard"] for r in got}) == 2 and all(r["slot"] == 0 for r in got)


def test_written_shards(spark, tmp_path):
    docs = corpus(3, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sharding.write(sharding.shard(sharding.measured(df), shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(docs) and sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    want = plain(docs, 4)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back.collect()} == want
