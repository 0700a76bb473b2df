"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints at ``RADIUS`` or fewer differing bits are linked, and links are closed to components. Two fingerprints
that differ in at most four bits agree on one of five blocks of bits, so the distinct fingerprints are sharded by
(block number, block value) and every link lies inside a shard. A shard is a BK-tree: the children of a node are
keyed by their Hamming distance to it, and a search for radius r at distance d follows the edges d-r to d+r only.

Scale: all copies of a text are one fingerprint before anything is sharded. A shard of more than ``SHARD`` members
is sharded again by five blocks of the remaining bits; what is still larger (thousands of near copies of one text)
is cut into trees of about ``SHARD`` members, and every pair of trees is searched by itself, so no task holds
more than two. The tree rows travel to the tasks by the shuffle, not by one broadcast that grows with the data.
A task returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, table
from daymark.llm.graph import components

RADIUS = 4
WIDTHS = (13, 13, 13, 13, 12)
SHARD = 4096
#: Pairs of query and node that one step of a search holds at most.
FRONTIER = 2_000_000


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the word shingles of ``text``; zero if it has no word."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *after[:-shingle].tolist()]
        ends = (after[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends)]
    marks = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        marks += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * marks > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits in a signed long."""

    def compute(batches):
        for batch in batches:
            marks = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), compute, "doc_id long, fp long")


def forest(values: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over ``values``, one for each run of equal numbers in ``tree``, built level by level.

    Returns the sorted edge keys (parent * 65 + distance), the child at each key, and the root of each member. The
    first member of a tree is its root. In each level the first member that arrives at an edge becomes its child and
    the others go down with it, as if they were inserted one after another.
    """
    _, first, inverse = np.unique(tree, return_index=True, return_inverse=True)
    roots = first[inverse]
    items = np.flatnonzero(np.arange(len(values)) != roots)
    parent = roots[items]
    keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(items):
        edge = parent * 65 + np.bitwise_count(values[items] ^ values[parent]).astype(np.int64)
        kinds, at, back = np.unique(edge, return_index=True, return_inverse=True)
        keys.append(kinds)
        children.append(items[at])
        parent = items[at][back]
        stay = items != parent
        items, parent = items[stay], parent[stay]
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys)
    return keys[order], children[order], roots


def search(values: np.ndarray, keys: np.ndarray, children: np.ndarray, queries: np.ndarray, starts: np.ndarray, radius: int):
    """Yield (query number, member) pairs within ``radius``, following only edges that can lead to one."""
    who, node = np.arange(len(queries)), starts
    stack = [(who[i : i + 4096], node[i : i + 4096]) for i in range(0, len(who), 4096)]
    while stack:
        who, node = stack.pop()
        if len(who) > FRONTIER:
            half = len(who) // 2
            stack += [(who[:half], node[:half]), (who[half:], node[half:])]
            continue
        far = np.bitwise_count(queries[who] ^ values[node]).astype(np.int64)
        near = far <= radius
        if near.any():
            yield who[near], node[near]
        low = np.searchsorted(keys, node * 65 + np.maximum(far - radius, 0))
        high = np.searchsorted(keys, node * 65 + np.minimum(far + radius, 64), side="right")
        width = high - low
        if (total := int(width.sum())) == 0:
            continue
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(total)
        stack.append((np.repeat(who, width), children[at]))


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a`` and ``b`` in the forest ``parent``; every member points to the smallest of its set."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def spanning_links(tree: list[np.ndarray], other: list[np.ndarray | None], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tree, link its members to each other, or to the members of ``other``; a spanning forest of the links."""
    sizes = [len(t) for t in tree]
    values = np.concatenate(tree).view(np.uint64)
    number = np.repeat(np.arange(len(tree)), sizes)
    keys, children, roots = forest(values, number)
    begin = np.cumsum([0, *sizes])
    asked = [t if o is None else o for t, o in zip(tree, other)]
    queries = np.concatenate(asked).view(np.uint64)
    starts = np.repeat(begin[:-1], [len(x) for x in asked])
    # Query q is member q of its own tree, or a new member behind all trees.
    place = np.concatenate([np.arange(s, s + n) if o is None else np.full(len(o), -1) for s, n, o in zip(begin, sizes, other)])
    new = place < 0
    place[new] = len(values) + np.arange(int(new.sum()))
    parent = np.arange(len(values) + int(new.sum()))
    for who, node in search(values, keys, children, queries, starts, radius):
        hook(parent, place[who], node)
    names = np.concatenate([values, queries[new]]).view(np.int64)
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return names[linked], names[parent[linked]]


def block_keys(fp, widths, start: int = 0):
    """Array of (block number, block value) as one long each."""
    keys, low = [], start
    for number, width in enumerate(widths):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(value.cast("long") + F.lit(number << 16))
        low += width
    return keys


def tree_rows(prints: DataFrame, shard: int) -> DataFrame:
    """(tree, other): arrays of fingerprints to be searched for links; ``other`` is null to search a tree in itself."""
    level1 = prints.select("fp", F.explode(F.array(*block_keys(F.col("fp"), WIDTHS))).alias("key"))
    # At most 5 * 2^13 rows, whatever the number of documents.
    sizes = level1.groupBy("key").agg(F.count("*").alias("n"))
    sized = level1.join(F.broadcast(sizes), "key")
    small = sized.where((F.col("n") > 1) & (F.col("n") <= shard)).select("key", F.lit(0).alias("part"), F.lit(1).alias("parts"), "fp")

    # Larger shards: the shared block is cut out, and the 51 or 52 bits that remain are cut into five blocks.
    low = F.shiftright("key", 16).cast("int") * WIDTHS[0]
    large = sized.where(F.col("n") > shard).select("key", "fp", low.alias("low"), F.least(low + WIDTHS[0], F.lit(64)).alias("high"))
    below = F.expr("fp & (shiftleft(1L, low) - 1)")
    above = F.expr("CASE WHEN high >= 64 THEN 0L ELSE shiftleft(shiftrightunsigned(fp, high), low) END")
    rest = large.select("key", "fp", below.bitwiseOR(above).alias("rest"))
    finer = [-(F.shiftleft("key", 20) + block) for block in block_keys(F.col("rest"), (11, 11, 10, 10, 10))]  # negative: apart from the first level
    level2 = rest.select("fp", F.explode(F.array(*finer)).alias("key"))
    sizes2 = level2.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / shard).cast("int")
    fine = level2.join(sizes2, "key").select("key", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), parts.alias("parts"), "fp")

    members = small.unionByName(fine).groupBy("key", "part", "parts").agg(F.collect_list("fp").alias("tree"))
    own = members.select("tree", F.lit(None).cast("array<bigint>").alias("other"))
    cut = members.where("parts > 1")
    left = cut.where("part < parts - 1").select("key", "tree", F.explode(F.expr("sequence(part + 1, parts - 1)")).alias("part"))
    pairs = left.join(cut.select("key", "part", F.col("tree").alias("other")), ["key", "part"])
    return own.unionByName(pairs.select("tree", "other"))


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column ``fp``) at ``radius`` or fewer differing bits."""
    if radius >= len(WIDTHS):
        raise ValueError("five blocks find links of at most four differing bits")

    def run(batches):
        for batch in batches:
            tree, other = batch.column(0), batch.column(1)
            for at in range(0, len(tree), 512):
                trees = [np.asarray(x.values, np.int64) for x in tree[at : at + 512]]
                others = [np.asarray(x.values, np.int64) if x.is_valid else None for x in other[at : at + 512]]
                a, b = spanning_links(trees, others, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(tree_rows(prints, shard), run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) of every row; ``component_id`` is the smallest doc_id of its component.

    Null and empty texts have fingerprint zero. Rows without a doc_id take part in links; a component of such rows
    alone has no id. Repeated rows are returned as often as they stand in the input.
    """
    marked = table(fingerprints(docs), "fingerprints")
    prints = table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    roots = components(links(prints, radius, shard)).withColumnRenamed("node", "fp")
    linked = roots.join(prints, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first_doc").alias("component")), "root").select("fp", "component")
    labels = prints.join(named, "fp", "left").select("fp", F.coalesce("component", "first_doc").alias("component_id"))
    labels = table(labels, "fingerprint-labels")  # so that the join with a fingerprint of very many documents can be split
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of each component only; rows without an id stay.

    Rows that repeat a doc_id are one document.
    """
    labels = near_duplicates(docs)
    keep = labels.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    joined = docs.join(keep, F.col("doc_id") == F.col("__keep"), "left").where("doc_id is null or __keep is not null").drop("__keep")
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return joined.withColumn("__row", unnamed).dropDuplicates(["doc_id", "__row"]).drop("__row")
