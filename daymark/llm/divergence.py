"""Divergence audit of sources: how far each source's term counts are from those of the other sources of its language.

A term is a run of letters A-Z, a-z or characters from U+0080 on; only A-Z is lower-cased. Each language keeps the terms found in
at least ``LEAST`` of its documents. A group (language, source), and the language as a whole, gives a kept term the weight
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))`` with N the group's kept occurrences and V the kept terms, and two weights differ by
``f = floor((p - q)**2 / (p + q))``. All of it is integer arithmetic.

Sums of f over all kept terms come from run-length columns:

1. A kept term's signature is its list of (source number, count). Terms of one signature are one row with a weight, and the
   vocabulary is reordered by signature, sources with the fewest different counts first, so equal counts stand together.
2. The order is cut into blocks of ``BLOCK`` signatures. In a block each source's column is run-length encoded: the
   ends of its runs and their counts. Sources that a block lacks are one run of zeros.
3. A pair of columns is walked once over the joined ends of its runs; f of the two counts is multiplied by the run's length.
   Sums per block are added by pair. f is symmetric, so each unordered pair is walked once.

Scale: counting is done per task and summed by (language, source, term). Blocks of the order go to different tasks, and pairs of
columns are dealt by tiles of ``TILE`` sources, so a task holds two tiles of one block however large a language is. Sums do not
depend on where the blocks are cut. The result holds all ordered pairs of sources of a language, as its definition asks.

Defined cases: a null text, language or source is the empty string. Every row is a document of its own, repeated rows and rows without an
id included. A group without terms counts zero for all. A language without kept terms has pairs of value 0 and no terms. Equal
values are ranked by the item's UTF-8 bytes. An empty table gives no rows. Other columns are ignored. Counts must stay below 9e15.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, shuffle_parts, table

LEAST, TOP = 10, 10
BLOCK, TILE = 16384, 64
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # in UTF-8 every byte of a character from U+0080 on is 0x80 or more
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
SLICE, HELD = 1 << 20, 400_000


def terms_of(text: bytes):
    """Lists of the terms of a text, a slice at a time, cut between terms."""
    text, at = text.lower(), 0  # bytes: A-Z only
    while at < len(text):
        gap = GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text, at, end)
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) summed; a row with a null term counts the documents of each group."""

    def count(batches):
        held, groups = defaultdict(lambda: (Counter(), Counter())), Counter()

        def rows():
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (counts, docs_) in held.items():
                for column, values in zip(columns, ([lang] * len(counts), [source] * len(counts), counts.keys(), counts.values(), [docs_[t] for t in counts])):
                    column.extend(values)
            for (lang, source), n in groups.items():
                for column, value in zip(columns, (lang, source, None, 0, n)):
                    column.append(value)
            held.clear()
            groups.clear()
            arrays = [*[pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:3]], *[pa.array(c, pa.int64()) for c in columns[3:]]]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "count", "docs"])

        for batch in batches:
            lang, source, text = (pc.fill_null(batch.column(i).cast(pa.binary()), b"").to_pylist() for i in range(3))
            for group in zip(lang, source, text):
                counts, docs_ = held[group[:2]]
                groups[group[:2]] += 1
                own: set = set()
                for terms in terms_of(group[2]):
                    counts.update(terms)
                    own.update(terms)
                docs_.update(own)
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield rows()
        yield rows()

    text = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in ("lang", "source", "text")])
    made = map_arrow(text, count, "lang string, source string, term string, count long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def weight(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), in three exact steps of a long division."""
    left, out = count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def weight_sql(count: str, total: str) -> str:
    """The same as an expression of Spark."""
    first = f"({count} + 2) * 1000"
    second = f"({first} % {total}) * 1000"
    third = f"({second} % {total}) * 1000"
    return f"1 + ({first} div {total}) * 1000000 + ({second} div {total}) * 1000 + ({third} div {total})"


def encoded(signatures: DataFrame) -> DataFrame:
    """Run-length columns (lang, block, number, ends, counts) of rows (lang, signature, weight) in the order of the partitions.

    ``number`` is null once a block, for the length of a source that the block lacks.
    """
    schema = "lang string, block long, number int, ends array<bigint>, counts array<bigint>"

    def columns(lang: str, block: int, rows: list[tuple]):
        ends = np.cumsum(np.array([w for _, w in rows], np.int64))
        places: dict[int, list] = defaultdict(list)
        for at, (signature, _) in enumerate(rows):
            for entry in signature:
                places[entry["number"]].append((at, entry["count"]))
        out = [(lang, block, None, ends[-1:].tolist(), [0])]
        for number, found in places.items():
            dense = np.zeros(len(rows), np.int64)
            at, counts = zip(*found)
            dense[list(at)] = counts
            last = np.append(dense[1:] != dense[:-1], True)
            out.append((lang, block, number, ends[last].tolist(), dense[last].tolist()))
        names = ["lang", "block", "number", "ends", "counts"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def encode(batches):
        waiting, lang, block = [], None, 0
        for batch in batches:
            base = batch.column(3)[0].as_py() << 32 if batch.num_rows else 0
            for row_lang, signature, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if waiting and (row_lang != lang or len(waiting) == BLOCK):
                    yield columns(lang, base + block, waiting)
                    waiting, block = [], block + 1
                lang = row_lang
                waiting.append((signature, n))
        if waiting:
            yield columns(lang, base + block, waiting)

    ordered = signatures.repartitionByRange(shuffle_parts(signatures.sparkSession), "lang", "signature").sortWithinPartitions("lang", "signature")
    return map_arrow(ordered.select("lang", "signature", "weight", F.spark_partition_id().cast("long").alias("part")), encode, schema)


def run_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) of a block's pairs of columns: f of two runs times the length of their overlap.

    ``side`` tells the two tiles; a tile with itself is on both sides, and only pairs a < b are walked.
    """
    columns = [(r.number, r.side, np.asarray(r.ends), weight(np.asarray(r.counts), r.total) if len(r.ends) and r.total else None) for r in pdf.itertuples()]
    left = sorted((c for c in columns if c[1] != 1), key=lambda c: c[0])
    right = sorted((c for c in columns if c[1] != 0), key=lambda c: c[0])
    found = []
    for a, _, ends, p in left:
        for b, _, other, q in right:
            if a < b:
                value = 0
                if p is not None and q is not None:
                    cuts = np.union1d(ends, other)
                    x, y = p[np.searchsorted(ends, cuts)], q[np.searchsorted(other, cuts)]
                    value = int(((x - y) ** 2 // (x + y) * np.diff(cuts, prepend=0)).sum())
                found.append((a, b, value))
    return pd.DataFrame(found, columns=["a", "b", "value"]).assign(lang=pdf["lang"].iloc[0])[["lang", "a", "b", "value"]]


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for the unordered pairs of source numbers of each language."""
    blocks = columns.where("number is null").select("lang", "block", F.col("ends").alias("whole"), F.col("counts").alias("zero"))
    blocks = groups.select("lang").distinct().join(blocks, "lang", "left")  # a language without kept terms has one empty block
    spread = blocks.join(groups.select("lang", "number", "total", "n_sources"), "lang")
    held = spread.join(columns.where("number is not null"), ["lang", "block", "number"], "left")
    tile = F.floor(F.col("number") / TILE).cast("int")
    tiles = F.ceil(F.col("n_sources") / TILE).cast("int")
    held = held.select(
        "lang", F.coalesce("block", F.lit(-1)).alias("block"), "number", "total", tile.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"),
        F.coalesce("ends", "whole", F.array().cast("array<bigint>")).alias("ends"), F.coalesce("counts", "zero", F.array().cast("array<bigint>")).alias("counts"))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), -1).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    dealt = held.withColumns({"low": low, "high": high, "side": side})
    sums = dealt.groupBy("lang", "block", "low", "high").applyInPandas(run_sums, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares with each other source of the language, part ``term`` names
    the ``TOP`` terms that the source has more of than its language."""
    counts = table(term_counts(docs), "term-counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("whole")).where(F.col("docs") >= LEAST)
    kept = table(terms.join(kept.select("lang", "term", "whole"), ["lang", "term"]).select("lang", "source", "term", "count", "whole"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("count").alias("n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.countDistinct("count").alias("kinds"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").fillna(0)
    groups = groups.join(sizes.select("lang", "v", (F.col("n") + 2 * F.col("v")).alias("lang_total")), "lang", "left").fillna(0)
    by_kinds = Window.partitionBy("lang").orderBy("kinds", "source")
    groups = groups.select(
        "lang", "source", (F.row_number().over(by_kinds) - 1).alias("number"), F.count("*").over(Window.partitionBy("lang")).alias("n_sources"),
        (F.col("n") + 2 * F.col("v")).alias("total"), "lang_total")
    groups = table(groups, "source-groups")

    numbered = kept.join(groups.select("lang", "source", "number"), ["lang", "source"])
    signed = numbered.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("number", "count"))).alias("signature"))  # a term has one entry a source
    columns = table(encoded(signed.groupBy("lang", "signature").agg(F.count("*").alias("weight"))), "run-columns")
    sums = pair_sums(columns, groups)
    name = lambda c, to: groups.select("lang", F.col("number").alias(c), F.col("source").alias(to))
    named = sums.join(name("a", "x"), ["lang", "a"]).join(name("b", "y"), ["lang", "b"])
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = ranked(named.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value"))

    weighed = kept.where("count > 0").join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    weighed = weighed.select("lang", "source", F.col("term").alias("item"), F.expr(weight_sql("count", "total")).alias("p"), F.expr(weight_sql("whole", "lang_total")).alias("q"))
    above = weighed.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return pairs.unionByName(ranked(above).where(F.col("rank") <= TOP))
