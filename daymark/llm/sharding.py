"""Shards of nearly equal bytes, by a histogram sort.

Rows are ordered by a key of three parts: a hash of the text, a hash of the id, and the row number, so equal texts stand together and
no two rows are equal. A shard is a range of that order:

1. Probes are keys between rows. A pass over the written keys counts the exact bytes and rows between neighbouring probes in every
   partition and adds them up, with the first and last key of each interval.
2. An interval that holds a wanted boundary gets ``FAN`` new probes between its first and last key, until the boundary is met within
   the tolerance, or one row is left; then the nearer side of that row is taken.
3. The rows are exchanged once. Ranges are cut further into pieces of about one part of a shuffle, whose row counts the histogram
   knows, so a row's slot is the rows before its piece plus its place in the piece.

A row of more than 1 / ``LARGE`` of a shard would push a boundary far off. Such rows, at most ``LARGE`` a shard, are placed first, the
largest to the emptiest shard, and ranges fill the shards up to one level. So a shard is within 1 / ``LARGE`` of the mean
unless single rows exceed it, and copies of a text stay together but for such rows and the boundaries.

Scale: passes read keys and sizes only. Rounds grow with the logarithm of the rows, not their spread: probes follow the
keys that exist, so a text that a third of the rows hold is split like any other. The driver holds a few thousand probes.

Defined cases: a null text is empty and has size 8. Rows that repeat or lack an id are rows of their own. With fewer rows than shards some
shards stay empty. An empty table gives no rows. Columns of ``docs`` stay; those named like a new column are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, shuffle_parts, table

SHARDS, LARGE, FAN = 24, 16, 64
#: Share of a shard by which a boundary may miss; a piece may miss by a quarter.
TOLERANCE, PIECE_TOLERANCE = 1e-6, 0.25
WIDTH = 24  # bytes of a key
HASH_DIGITS = 15


def digest(column: str):
    """The first 60 bits of the md5 of a string column."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, HASH_DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with size, text_crc32 and the hashes that order them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)})
    return out.withColumns({"_text_hash": digest("text"), "_id_hash": digest("doc_id")})


def keys_of(batch) -> np.ndarray:
    """Keys of the first three columns as byte strings, in the order of the numbers."""
    return np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(">i8").view(f"S{WIDTH}").ravel()


def number(key: bytes) -> int:
    return int.from_bytes(key.ljust(WIDTH, b"\0"), "big")


def key(value: int) -> bytes:
    return value.to_bytes(WIDTH, "big")


def as_keys(values: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(map(key, values)), f"S{WIDTH}")


class Interval:
    """Keys between two probes: bytes and rows before it and in it, its first and last key."""

    def __init__(self, before: int, rows_before: int, size: int, rows: int, first: int, last: int):
        self.before, self.rows_before, self.size, self.rows, self.first, self.last = before, rows_before, size, rows, first, last


def histogram(keys: DataFrame, probes: list[int]) -> list[Interval]:
    """The non-empty intervals between the probes, in order. Interval i holds keys from probe i - 1 on and below probe i."""
    sent = keys.sparkSession.sparkContext.broadcast(as_keys(probes))

    def count(batches):
        cuts, total = sent.value, {}
        for batch in batches:
            found, size = keys_of(batch), batch.column(3).to_numpy()
            at = np.searchsorted(cuts, found, side="right") if len(cuts) else np.zeros(len(found), int)
            order = np.lexsort((found, at))
            at, found, size = at[order], found[order], size[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sums, rows = np.add.reduceat(size, first) if len(first) else [], np.diff(np.append(first, len(at)))
            last = np.append(first[1:], len(at)) - 1
            for i, s, n, low, high in zip(at[first].tolist(), sums, rows, found[first].tolist(), found[last].tolist()):
                low, high = low.ljust(WIDTH, b"\0"), high.ljust(WIDTH, b"\0")
                held = total.get(i)
                total[i] = (int(s), int(n), low, high) if held is None else (held[0] + int(s), held[1] + int(n), min(held[2], low), max(held[3], high))
        if total:
            columns = list(zip(*total.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(total, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                ["interval", "size", "n", "low", "high"])

    made = map_arrow(keys.select("_text_hash", "_id_hash", "_row", "size"), count, "interval long, size long, n long, low binary, high binary")
    rows = made.groupBy("interval").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out, before, rows_before = [], 0, 0
    for r in sorted(rows, key=lambda r: r["interval"]):
        out.append(Interval(before, rows_before, r["size"], r["n"], number(r["low"]), number(r["high"])))
        before, rows_before = before + r["size"], rows_before + r["n"]
    return out


def met(target: int, tolerance: float, intervals: list[Interval]) -> tuple[tuple | None, Interval | None]:
    """((probe, rows before it), None) where ``target`` bytes are met, else (None, the interval that holds it)."""
    low, high = 0, len(intervals)
    while low < high:  # the last interval that starts at the target or before it
        middle = (low + high) // 2
        low, high = (middle + 1, high) if intervals[middle].before <= target else (low, middle)
    if not low:
        return (0, 0), None
    i = intervals[low - 1]
    start, end = (i.first, i.rows_before), (i.last + 1, i.rows_before + i.rows)
    if target >= i.before + i.size or i.rows == 1 and 2 * i.before + i.size <= 2 * target:
        return end, None
    if i.rows == 1 or target == i.before:
        return start, None
    if min(target - i.before, i.before + i.size - target) <= tolerance:
        return (start if 2 * target <= 2 * i.before + i.size else end), None
    return None, i


def boundaries(keys: DataFrame, targets: list[tuple[int, float]]) -> list[tuple[int, int]]:
    """For each (bytes, tolerance) the first key behind the boundary and the rows before it."""
    probes: set[int] = set()
    while True:
        intervals = histogram(keys, sorted(probes))
        found = [met(t, tolerance, intervals) for t, tolerance in targets]
        wanted = {id(i): i for _, i in found if i is not None}
        if not wanted:
            return [place for place, _ in found]
        for i in wanted.values():
            # One probe behind the first key and one at the last isolate both, so every round gains.
            probes.update({i.first, i.first + 1, i.last, i.last + 1, *(i.first + (i.last - i.first) * k // FAN for k in range(1, FAN))})


def filled(total: int, taken: list[int]) -> list[int]:
    """How many of ``total`` bytes each shard takes so that all reach one level over what they hold already."""
    held, rest = sorted(taken), total
    for k in range(len(held), 0, -1):
        level = (rest + sum(held[:k])) // k
        if level >= held[k - 1]:
            break
    return [max(0, level - t) for t in taken]


def shard(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``measured`` and any other columns, with law, shard, slot and grown_shard; the hashes are dropped."""
    numbered = table(rows.withColumn("_row", F.monotonically_increasing_id()), "keyed-rows")
    total = numbered.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = total // (shards * LARGE)
    large = numbered.where(F.col("size") > limit).select("_row", "_text_hash", "_id_hash", "size").collect()  # at most shards * LARGE rows
    small = numbered.where(F.col("size") <= limit)
    heap, placed, taken = [(0, i) for i in range(shards)], {}, [0] * shards
    counts = [0] * shards
    for r in sorted(large, key=lambda r: (-r["size"], r["_text_hash"], r["_id_hash"], r["_row"])):
        size, i = heapq.heappop(heap)
        placed[r["_row"]], counts[i], taken[i] = (i, counts[i]), counts[i] + 1, size + r["size"]
        heapq.heappush(heap, (taken[i], i))
    rest = total - sum(taken)
    ends = np.cumsum([0, *filled(rest, taken)])[1:-1].tolist()
    pieces = max(shards, shuffle_parts(rows.sparkSession))
    slack = PIECE_TOLERANCE * rest / pieces
    inner = [(rest * k // pieces, slack) for k in range(1, pieces)]
    found = boundaries(small, [*((t, tolerance * total / shards) for t in ends), *inner])
    edges = found[: shards - 1]
    starts = sorted({(0, 0), *found})
    cuts, before = as_keys([k for k, _ in starts]), np.array([n for _, n in starts], np.int64)
    shard_of = np.searchsorted(as_keys([k for k, _ in edges]), cuts, side="right")
    base = np.array([0, *(n for _, n in edges)], np.int64)
    first_slot = before - base[shard_of] + np.array(counts, np.int64)[shard_of]  # rows placed first come first
    sent = rows.sparkSession.sparkContext.broadcast((cuts, shard_of.astype(np.int32), first_slot, placed))

    def place(batches):
        cuts_, shard_, slot_, placed_ = sent.value
        for batch in batches:
            at = np.searchsorted(cuts_, keys_of(batch), side="right") - 1
            where, slot, piece = shard_[at], slot_[at], at.astype(np.int64)
            for i, row in enumerate(batch.column(2).to_pylist()):
                if row in placed_:
                    where[i], slot[i] = placed_[row]
                    piece[i] = -1 - row
            arrays = [*batch.columns, pa.array(where), pa.array(slot), pa.array(piece)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(n, a.type) for n, a in zip([*names, "shard", "slot", "_piece"], arrays)]))

    inputs = [c for c in numbered.columns if c not in ("shard", "slot", "law", "grown_shard", "_piece")]
    names = ["_text_hash", "_id_hash", "_row", *[c for c in inputs if c not in ("_text_hash", "_id_hash", "_row")]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*[F.col(f"`{c}`") for c in names]).schema)
    dealt = map_arrow(numbered.select(*[F.col(f"`{c}`") for c in names]), place, f"{fields}, shard int, slot long, _piece long")
    inside = Window.partitionBy("_piece").orderBy("_text_hash", "_id_hash", "_row")
    out = dealt.withColumn("slot", F.col("slot") + F.row_number().over(inside) - 1)
    kept = [F.col(f"`{c}`") for c in inputs if c not in ("_text_hash", "_id_hash", "_row")]
    return out.select(*kept, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots in each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
