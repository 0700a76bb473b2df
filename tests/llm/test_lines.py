"""Line dedup: the filter, the reversible index, and the result against a plain version."""

import hashlib
import random

import pytest

from daymark.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_chars=40, min_docs=5):
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, text in rows:
        ls = (text or "").split("\n")
        stay = [x for x in ls if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out[d] = (len(ls), len(ls) - len(stay), "\n".join(stay))
    return out


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    pool = [f"Shared line number {i} of the corpus, long enough ÄÖ {'x' * (i % 7)}" for i in range(12)]
    pool += ["é" * 39, "é" * 40, "short", "", "  \tPadded shared line of forty characters or more\r "]
    rows = []
    for d in range(n):
        text = "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 9)))
        rows.append((d, rng.choice([text, text.upper(), None, ""]) if d % 5 == 0 else text))
    return rows


def test_filter_finds_what_was_inserted_and_forgets_what_was_deleted():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    one = lines.filled(keys)
    assert one.contains(keys).all()
    one.delete(keys[:2500])
    again = lines.CuckooFilter.load(one.dump())
    assert again.contains(keys[2500:]).all()
    assert again.contains(keys[:2500]).mean() < 0.01
    assert lines.filled([]).contains(keys[:3]).sum() == 0


def test_result_equals_the_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "a", 7) for d, t in rows], "doc_id long, text string, n_lines string, key int")
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == plain(rows)
    assert any(v[1] for v in plain(rows).values())


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(docs).count() == 0
    line = "a line that is surely longer than forty characters, yes"
    rows = [(d, line) for d in (1, 1, 2, 3, 4)] + [(None, "short")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and not any(r["n_dropped"] for r in got)  # four documents hold it
    rows += [(None, line)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["text"] == line) == ["4"]


def test_very_long_text(spark):
    line = "the only line that is repeated in these documents, over and over"
    rows = [(d, "\n".join([line] + [f"{d} unique filler line number {i} with some more characters" for i in range(4000)])) for d in range(6)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_insert_and_delete_are_reversible(spark):
    rows = corpus(40, seed=3)
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = lines.LineIndex(spark).insert(frame(rows[:25])).insert(frame(rows[25:])).delete(frame(rows[5:15]))
    left = rows[:5] + rows[15:]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in index.dedup(frame(left)).collect()}
    assert got == plain(left)
    index.insert(frame(rows[5:15]))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in index.dedup(frame(rows)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("line,chars,found", [("x" * 40, 40, True), ("x" * 39, 40, False), ("é" * 40, 40, True), ("é" * 39, 40, False), ("  " + "é" * 39 + "  ", 40, False)])
def test_line_length_is_in_code_points(line, chars, found):
    assert (lines.line_key(line.encode(), chars) is not None) == found
