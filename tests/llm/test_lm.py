"""Language model: base scores against a plain version, gradients against differences, probabilities that sum to one."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from daymark.llm import lm


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 50)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \t "), (1003, "NEW never Seen WORDS W1"), (1003, "NEW never Seen WORDS W1"), (None, "w1 w2"), (1004, "w1 " * 30_000)]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [lm.END]


def test_base_scores_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 20)  # most words go through the join
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1.0, "x") for d, t in rows], "doc_id long, text string, score double, word string")
    out = lm.score(docs, lm.learned(docs)).collect()
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5
    c = Counter(w for d, t in rows if fold(d) != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((d, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows), key=key)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(10), "doc_id long, text string")
    assert lm.score(docs.limit(0), docs).count() == 0
    rows = lm.score(docs, docs.limit(0)).collect()
    assert len(rows) == 17 and all(r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 and math.isfinite(r["score"]) for r in rows)


class Small:
    """A vocabulary without Spark."""

    def __init__(self, texts):
        c = Counter(w for t in texts for w in tokens(t))
        head = sorted(c.items(), key=lambda r: (r[0] != lm.END, -r[1], r[0]))
        self.ids = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head], float)
        self.tokens, self.distinct = sum(c.values()), len(c)
        self.other_tokens, self.other_distinct = 0, 0


def net_and_texts(seed=1, n=40):
    texts = [t for _, t in corpus(n, seed)[:n]]
    vocabulary = Small(texts)
    return lm.initial(vocabulary), [lm.net_tokens(lm.words_of(t), vocabulary.ids)[1] for t in texts]


def test_chances_of_all_words_sum_to_one():
    net, _ = net_and_texts()
    states = np.random.default_rng(0).uniform(-1, 1, (3, lm.STATE)).astype(np.float32)
    every = np.arange(lm.NET_WORDS + 1)
    for s in states:
        chances = np.exp(lm.log_chances(net, np.repeat(s[None], len(every), axis=0), every))
        assert abs(chances.sum() - 1) < 1e-4


def test_gradients_equal_differences():
    net, texts = net_and_texts()
    _, x, y, fresh, number = next(iter(lm.windows(texts[:5], 3, 8)))
    state = np.zeros((3, lm.STATE), np.float32)
    net = {k: v.astype(np.float64) for k, v in net.items()}
    grad, _, _ = lm.gradients(net, x, y, fresh, number >= 0, state)
    scale = lm.WINDOW * lm.TRAIN_LANES
    rng = np.random.default_rng(2)
    for name in lm.SHAPES:
        flat = grad[name].ravel()
        for at in rng.choice(np.argsort(-np.abs(flat))[:50], 3):
            loss = []
            for step in (1e-2, -1e-2):
                moved = {k: v.copy() for k, v in net.items()}
                moved[name].ravel()[at] += step
                loss.append(lm.gradients(moved, x, y, fresh, number >= 0, state)[2])
            assert (loss[0] - loss[1]) / 2e-2 / scale == pytest.approx(flat[at], rel=0.05, abs=2e-6)


def test_state_is_carried_over_windows(monkeypatch):
    net, texts = net_and_texts()
    whole = lm.score_texts(net, texts)
    one_by_one = []
    for t in texts:
        x = np.concatenate([[0], t[:-1]])[:, None]
        states, _ = lm.run_window(net, x, np.arange(len(t))[:, None] == 0, np.zeros((1, lm.STATE), np.float32))
        one_by_one.append(lm.log_chances(net, states[:, 0], t).sum())
    assert np.allclose(whole, one_by_one, rtol=1e-4)
    monkeypatch.setattr(lm, "LANES", 3)
    monkeypatch.setattr(lm, "WINDOW", 5)
    assert np.allclose(lm.score_texts(net, texts), whole, rtol=1e-4)


def test_training_helps_on_held_out_text(monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_LANES", 16)
    rng = random.Random(3)
    def chain(n):  # a word decides the next one
        at, out = 0, []
        for _ in range(n):
            at = (3 * at + rng.randint(0, 1)) % 12
            out.append(f"w{at}")
        return " ".join(out)
    texts = [chain(40) for _ in range(300)]
    vocabulary = Small(texts)
    net = lm.initial(vocabulary)
    number = lambda some: [lm.net_tokens(lm.words_of(t), vocabulary.ids)[1] for t in some]
    held = number([chain(40) for _ in range(50)])
    before = lm.score_texts(net, held).sum()
    squares = {k: np.full(s, 1e-2, np.float32) for k, s in lm.SHAPES.items()}
    for _ in range(5):
        lm.train_texts(net, number(texts), squares)
    assert lm.score_texts(net, held).sum() > 0.9 * before


def test_replicas_are_averaged(spark):
    docs = spark.createDataFrame(corpus(400, 4), "doc_id long, text string").repartition(3)
    vocabulary = lm.Vocabulary(lm.word_counts(docs))
    net = lm.train(docs, vocabulary)
    assert {k: v.shape for k, v in net.items()} == lm.SHAPES
    assert not np.allclose(lm.flat(net), lm.flat(lm.initial(vocabulary))) and np.isfinite(lm.flat(net)).all()


def test_every_training_text_is_trained_on_once(spark):
    docs = spark.createDataFrame(corpus(400, 5) + [(None, None), (7, None)], "doc_id long, text string").repartition(3)
    parts = [docs.where(lm.part_of(turn)) for turn in range(lm.ROUNDS)]
    assert sum(p.count() for p in parts) == docs.count() and all(p.exceptAll(docs).count() == 0 for p in parts)
    for doc_id in (1, 2, None):  # a single text moves the network from its start
        one = spark.createDataFrame([(doc_id, "w1 w2 w3 w1 w2 w4")], "doc_id long, text string")
        vocabulary = lm.Vocabulary(lm.word_counts(one))
        assert not np.allclose(lm.flat(lm.train(one, vocabulary)), lm.flat(lm.initial(vocabulary)))


def test_scores_are_above_the_counts_on_held_out_documents(spark):
    from daymark.llm.common import documents

    rows = lm.score_learned(documents(spark, "/root/testdata/sf0.01"), lm.learning()).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert len(held) > 100 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum((r["score"] - r["base_score"]) / r["n_tokens"] for r in held) > 0


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 2000)
    rows = corpus(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = lm.Vocabulary(lm.word_counts(docs))
    assert vocabulary.tokens // lm.GROUP_TOKENS > 10
    one, other = (lm.flat(lm.train(docs.repartition(n), vocabulary)) for n in (2, 9))
    assert np.allclose(one, other, atol=1e-4) and not np.allclose(one, lm.flat(lm.initial(vocabulary)))


def test_a_mixture_of_network_and_counts_sums_to_one_and_can_leave_the_network_out():
    net, texts = net_and_texts()
    vocabulary = Small([t for _, t in corpus(40, 1)[:40]])
    counted = np.append(np.zeros(lm.NET_WORDS), 0.5) + 0.5
    counted[: len(vocabulary.counts)] += vocabulary.counts
    counted /= counted.sum()
    assert np.allclose(lm.score_texts(net, texts, counted, 0.0), [np.log(counted[t]).sum() for t in texts])
    state = np.zeros((1, lm.STATE), np.float32)
    every = np.arange(lm.NET_WORDS + 1)
    chances = np.exp(lm.log_chances(net, np.repeat(state, len(every), axis=0), every))
    assert abs((0.7 * chances + 0.3 * counted).sum() - 1) < 1e-4
    ones = [np.array([w]) for w in (0, 5, lm.NET_WORDS)]
    mixed = lm.score_texts(net, ones, counted, 0.7)
    assert np.allclose(mixed, [np.log(0.7 * np.exp(lm.score_texts(net, [t])[0]) + 0.3 * counted[t[0]]) for t in ones], rtol=1e-5)


def test_the_mix_is_judged_on_every_training_text(spark, monkeypatch):
    seen = []
    real = lm.best_mix
    monkeypatch.setattr(lm, "best_mix", lambda learn, net, counted: (seen.append(learn.count()), real(learn, net, counted))[1])
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    lm.score(docs.limit(3), lm.learned(docs)).collect()
    assert seen == [lm.learned(docs).count()]


def test_few_lanes_take_longer_windows(monkeypatch):
    net, _ = net_and_texts()
    text = np.random.default_rng(4).integers(0, 60, 4000)
    calls = []
    real = lm.log_chances
    monkeypatch.setattr(lm, "log_chances", lambda net, states, targets: (calls.append(len(targets)), real(net, states, targets))[1])
    got = lm.score_texts(net, [text])[0]
    assert sum(calls) == 4000 and len(calls) <= 16
    states, _ = lm.run_window(net, np.concatenate([[0], text[:-1]])[:, None], np.arange(4000)[:, None] == 0, np.zeros((1, lm.STATE), np.float32))
    assert got == pytest.approx(real(net, states[:, 0], text).sum(), rel=1e-5)


ODD = ["", " a  b ", " \t ", "\x0bA\x0cB\x1cc\x85d \xa0E\u0130\u2003x", None, "a\rb\nc ", "\x00 z", "\x1f\x1e y", "\xc9 \xc9a"]


def test_words_are_split_alike_in_arrow(monkeypatch):
    for size in (1 << 24, 4):  # in one slice and text by text
        monkeypatch.setattr(lm, "SLICE", size)
        found = [[] for _ in ODD]
        for at, texts in lm.slices(pa.array(ODD, pa.string())):
            words, text = lm.split_texts(texts)
            for word, i in zip(words.to_pylist(), text):
                found[at + i].append(word.encode())
        assert found == [lm.words_of(t) for t in ODD]


def test_chances_equal_the_plain_formula():
    net, _ = net_and_texts()
    rng = np.random.default_rng(5)
    net = {k: v + rng.standard_normal(v.shape).astype(np.float32) for k, v in net.items()}
    targets = np.concatenate([rng.integers(0, lm.NET_WORDS + 1, 900), np.full(70, 3), [lm.NET_WORDS] * 5])
    states = rng.uniform(-1, 1, (len(targets), lm.STATE)).astype(np.float32)
    for lift in (0, 300):
        net["class_bias"][5], net["word_bias"][:, 7] = lift, lift
        want = []
        for s, w in zip(states.astype(np.float64), targets):
            logits = s @ net["class"] + net["class_bias"]
            chance = logits[min(w // lm.CLASS, lm.CLASSES)] - np.logaddexp.reduce(logits)
            if w < lm.NET_WORDS:
                logits = s @ net["word"][w // lm.CLASS] + net["word_bias"][w // lm.CLASS]
                chance += logits[w % lm.CLASS] - np.logaddexp.reduce(logits)
            want.append(chance)
        assert np.allclose(lm.log_chances(net, states, targets), want, rtol=1e-4, atol=1e-4)


def test_rare_classes_share_products(monkeypatch):
    net, _ = net_and_texts()
    targets = np.random.default_rng(6).integers(0, lm.NET_WORDS + 1, 2000)
    calls = []
    real = lm.softmax_parts
    monkeypatch.setattr(lm, "softmax_parts", lambda *a: (calls.append(1), real(*a))[1])
    lm.log_chances(net, np.zeros((2000, lm.STATE), np.float32), targets)
    assert len(calls) <= 10  # one a class would be 65


def test_pieces_add_up_to_their_texts():
    net, texts = net_and_texts()
    counted = np.full(lm.NET_WORDS + 1, 1 / (lm.NET_WORDS + 1))
    whole = lm.mixed_scores(net, texts, counted, lm.GRID)
    n = lm.pieces_of(texts, 16)
    pieces = lm.mixed_scores(net, texts, counted, lm.GRID, 16)
    assert pieces.shape == (len(lm.GRID), n.sum()) and n.max() > 2
    assert np.allclose(np.add.reduceat(pieces, np.cumsum(n) - n, axis=1), whole)
    sizes = [len(t[at : at + 16]) for t in texts for at in range(0, len(t), 16)]
    assert np.allclose(pieces[0], np.log(counted[0]) * np.array(sizes))


def test_the_trained_network_is_run_once_over_a_text(spark, monkeypatch):
    sizes = []
    real = lm.map_arrow
    monkeypatch.setattr(lm, "map_arrow", lambda df, run, schema: (sizes.append((df.count(), df.columns)), real(df, run, schema))[1])
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    lm.score_learned(docs, lm.learning()).collect()
    assert [n for n, columns in sizes if "tokens" in columns] == [docs.count()]


def test_the_mix_is_the_surest_of_a_plain_count(spark):
    docs = spark.createDataFrame(corpus(300, 8), "doc_id long, text string")
    vocabulary = lm.Vocabulary(lm.word_counts(docs))
    rows = docs.selectExpr("doc_id", "text", "doc_id % 3 > 0 AS learn", "true AS judge").fillna(False, ["learn"])
    rows = lm.table(lm.encoded(lm.dealt(rows, vocabulary), vocabulary).withColumn("row", lm.F.monotonically_increasing_id()), "rows")
    net, counted = lm.learned_net(rows, vocabulary), vocabulary.counted()
    runs = lm.table(lm.run_texts(rows, net, counted), "runs")
    kept = {r["row"]: r for r in rows.collect()}
    pieces = []
    for r in runs.collect():
        text = lm.numbers(kept[r["row"]]["tokens"])
        assert np.allclose(r["net"], lm.mixed_scores(net, [text], counted, lm.GRID)[:, 0] / np.log(10), rtol=1e-4)
        if kept[r["row"]]["learn"]:
            sizes = np.array([len(text[at : at + lm.JUDGED]) for at in range(0, len(text), lm.JUDGED)])
            found = lm.mixed_scores(net, [text], counted, lm.GRID, lm.JUDGED) / sizes
            pieces.append(found - found[0])
    gains = np.concatenate(pieces, axis=1)
    sure = gains.mean(axis=1) - gains.std(axis=1) / math.sqrt(gains.shape[1])
    best = lm.best_mix(runs.where("learn"), "gain", "square")
    assert sure[lm.GRID.index(best)] == pytest.approx(sure.max(), abs=1e-5)
