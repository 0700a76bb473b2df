"""The divergence audit against a plain version over all pairs and terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from daymark.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term string, rank int, value double, number int"


def plain(docs, least=10, top=10):
    words = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[A-Za-z\u0080-\U0010ffff]+", text or "")]) for text, lang, source in docs]
    found = Counter()
    for lang, _, terms in words:
        found.update((lang, t) for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in found.items():
        if n >= least:
            kept[lang].add(t)
    counts = {(lang, source): Counter() for lang, source, _ in words}
    for lang, source, terms in words:
        counts[lang, source].update(t for t in terms if t in kept[lang])
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def weights(c, lang):
        n, v = sum(c.values()), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept[lang]}

    p = {g: weights(c, g[0]) for g, c in counts.items()}
    out = set()
    apart = lambda a, b: (a - b) ** 2 // (a + b)
    for (lang, source), own in p.items():
        pairs = [(s, sum(apart(own[t], other[t]) for t in own)) for (la, s), other in p.items() if la == lang and s != source]
        q = weights(whole[lang], lang)
        terms = [(t, apart(own[t], q[t])) for t in own if counts[lang, source][t] and own[t] > q[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(order[:limit])}
    return out


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Été", "été", "gamma-delta", "x1y", "\U0001f600", "zz", "KO", "ko", *[f"w{c}" for c in "abcdefghijklm"]]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = rng.choice(["s1"] * 6 + [f"s{k}" for k in range(2, 9)] + [None])
        rows.append((" ".join(rng.choices(vocabulary, k=rng.randrange(0, 14))), lang, source))
    rows += [rows[0]] * 5 + [(None, "en", "s1"), ("", "en", "empty"), ("123 456", "xx", "a"), ("rare words", "xx", "b"), (None, "xx", None), ("only", "alone", "one")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i % 200 or None, t, la, s, "clash", 7, 0.5, 3) for i, (t, la, s) in enumerate(rows)], COLUMNS)
    return [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("block,tile", [(16384, 64), (3, 2)])
def test_equal_to_plain(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus(block)
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert {("xx", "a", "pair", "", 0, 1), ("xx", "a", "pair", "b", 0, 2)} <= set(got)


def test_empty_table(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert divergence.audit(df).count() == 0
    assert run(spark, [("a b", "en", "s")]) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "One twoTHREE äöüsix; " * 50 + "averyverylongterm"
    assert [t for part in divergence.terms_of(text.encode()) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


def test_weights_are_exact(spark):
    import numpy as np

    pairs = [(0, 5), (3, 7), (10**12, 3 * 10**15), (999_999_999_998, 10**12), (1, 3)]
    want = [1 + 10**9 * (c + 2) // n for c, n in pairs]
    assert divergence.weight(np.array([c for c, _ in pairs]), np.array([n for _, n in pairs])).tolist() == want
    df = spark.createDataFrame(pairs, "c long, n long").selectExpr(f"{divergence.weight_sql('c', 'n')} AS p")
    assert [r["p"] for r in df.collect()] == want
