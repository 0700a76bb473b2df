"""Best-fit packing of token sequences by exact complements.

Every document is tokenised and closed by an end token; only documents longer than a sequence are cut. What matters for packing
is the number of pieces of each length, at most ``size`` numbers, so the packing is planned on counts: a plan is a list of
patterns (the lengths in a sequence) with the number of sequences that follow each.

1. Exact complements: for each length from the longest down, the gap it leaves is filled exactly by one length, in a
   second and a third pass by two and three whose sum is the gap. A combination is used as often as the counts allow.
2. Best fit for the residue: in decreasing length into the smallest gap that takes it, many equal bins at a time.

Each step uses up a length or a kind of gap, so a plan has some thousands of patterns whether there are a thousand pieces or
a trillion. Pieces then take the places of their length in turn: a piece's place follows from its rank among the
pieces of its length, which is found without gathering them: rank inside its task's slice plus the totals of
the earlier slices.
"""

from __future__ import annotations

import bisect
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, table

CACHE = 400_000
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids binary"


#: A space before white space, at the start or at the end: such texts are not taken apart.
UNEVEN = re.compile(r"^ | (?=\s|$)")


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordTokens:
    """Token ids of whole texts under a byte-level BPE file of ``tokenizers``, with the ids of space-led words kept for reuse.

    The vocabulary's split always cuts before a space that stands before a non-space, so a text's ids are the ids of these
    parts in turn. The file's own merge order is its id order, so its merges are run by ``tiktoken``, which gives
    the same ids in a third of the time; a file of another kind is read by ``tokenizers`` itself.

    With ``added``, texts that hold one of the file's added tokens are read by ``tokenizers`` with its defaults, which gives such a
    token its one id. Otherwise added tokens are text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"].get("vocab", {})
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        numbers = [vocab.get(a + b) for a, b in merges]
        if spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and numbers == list(range(256, 256 + len(merges))) and spec["normalizer"] is None:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
            inner = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids, self.apart = inner.encode_ordinary, True
        else:
            other = tokenizers.Tokenizer.from_file(path)
            other.encode_special_tokens = not added
            self.ids, self.apart = lambda text: other.encode(text, add_special_tokens=False).ids, False
        self.known: dict[str, bytes] = {}
        names = [t["content"] for t in spec.get("added_tokens") or []] if added else []
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.default = tokenizers.Tokenizer.from_file(path) if names else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.special and self.special.search(text):
            return np.array(self.default.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not self.apart or not text or UNEVEN.search(text):
            return np.array(self.ids(text), "<u4").tobytes()
        first, *words = text.split(" ")
        known = self.known
        parts = list(map(known.get, words))
        if None in parts:
            if len(known) > CACHE:
                known.clear()
            pack, ids = struct.pack, self.ids
            for i, part in enumerate(parts):
                if part is None:
                    found = known.get(words[i])
                    if found is None:
                        new = ids(" " + words[i])
                        found = known[words[i]] = pack(f"<{len(new)}I", *new)
                    parts[i] = found
        return np.array(self.ids(first), "<u4").tobytes() + b"".join(parts)


def tokenise(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 0, added: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of every row; a null text is empty. ``ids`` are unsigned 32-bit numbers.
    ``added`` as in ``WordTokens``.

    Of a document longer than ``size`` the first piece holds what is over, and may be shorter.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        words = WordTokens(tokenizer, added)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[list] = [[], [], [], [], []]
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = words.encode(text or "") + end
                    n = len(ids) // 4
                    first = n % size or size
                    for piece, start in enumerate([0, *range(first, n, size)]):
                        part = ids[4 * start : 4 * (start + (size if piece else first))]
                        for column, value in zip(rows, (doc_id, piece, start, len(part) // 4, part)):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECE_COLUMNS)


def pair(counts: np.ndarray, there: np.ndarray, a: int, total: int, most: int) -> tuple[int, int] | None:
    """Two lengths of at most ``most`` with the sum ``total`` besides one piece of length ``a``, the longest first."""
    if total < 2:
        return None
    high = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
    for b in high[there[high] & there[total - high]].tolist():
        if 2 * b != total or counts[b] > 1 + (b == a):
            return b, total - b
    return None


def complement(counts: np.ndarray, a: int, gap: int, number: int) -> tuple[int, ...] | None:
    """As many lengths as ``number`` (one to three) that are there besides one piece of length ``a`` and sum to ``gap``."""
    there = counts > 0
    there[a] = counts[a] > 1
    if number == 1:
        return (gap,) if there[gap] else None
    if number == 2:
        return pair(counts, there, a, gap, gap)
    for b in np.flatnonzero(there[: max(0, gap - 1)])[::-1].tolist():
        if 3 * b < gap:
            return None
        if found := pair(counts, there, a, gap - b, b):
            trio = (b, *found)
            if all(counts[x] >= trio.count(x) + (x == a) for x in trio):
                return trio
    return None


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; together they use every piece of ``counts`` once.

    Gaps are filled exactly by single lengths first, over all lengths, then by pairs, then by triples. Where few lengths occur, exact triples can
    spend short pieces that best fit uses better, so plans that stop at pairs and at singles are made too, and the shortest one is taken.
    """
    plans = [plan_with(counts, size, most) for most in (3, 2, 1)]
    return min(plans, key=lambda patterns: sum(n for _, n in patterns))


def plan_with(counts: np.ndarray, size: int, most_lengths: int) -> list[tuple[tuple[int, ...], int]]:
    counts = counts.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    if counts[size]:
        patterns.append(((size,), int(counts[size])))
        counts[size] = 0
    for number in range(1, most_lengths + 1):
        for a in range(size - 1, 0, -1):
            while counts[a] > 0 and (rest := complement(counts, a, size - a, number)) is not None:
                pattern = (a, *rest)
                times = min(int(counts[x]) // pattern.count(x) for x in set(pattern))
                for x in pattern:
                    counts[x] -= times
                patterns.append((pattern, times))
    # Best fit: bins of equal gap and pattern are handled together.
    open_: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if gap not in open_:
            bisect.insort(gaps, gap)
            open_[gap] = []
        open_[gap].append([pattern, times])

    for a in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[a])
        while left:
            at = bisect.bisect_left(gaps, a)
            if at < len(gaps):
                gap = gaps[at]
                pattern, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, pattern, times = size, (), left
            each = min(gap // a, left)
            used = min(times, left // each)
            put(gap - each * a, pattern + (a,) * each, used)
            left -= used * each
            if times > used and pattern:
                put(gap, pattern, times - used)
    patterns += [(p, n) for bins in open_.values() for p, n in bins]
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), and for each the first sequence and the offset in it."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append(((length << 44) + rank, base - rank, offset))
            taken[length] = rank + times
            offset += length
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3).T
    return columns[0].copy(), columns[1].copy(), columns[2].copy()


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Needs ``length``, from 1 to ``size``; other columns stay.

    ``pieces`` is written to the shared folder once. An empty table gives an empty one; equal rows get different places.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = table(pieces.select(*[F.col(f"`{c}`") for c in kept], F.spark_partition_id().alias("__slice")), "pieces")
    counts = table(pieces.groupBy("length", "__slice").agg(F.count("*").alias("__n")), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # at most ``size`` rows
        histogram[row["length"]] = row["n"]
    if histogram[0]:
        raise ValueError("a piece has no token")
    sent = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, size)))

    earlier = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__slice").orderBy("length")
    ranked = pieces.withColumn("__rank", F.row_number().over(inside).cast("long") - 1).join(offsets, ["length", "__slice"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in kept], (F.shiftleft(F.col("length").cast("long"), 44) + F.col("__rank") + F.col("__before")).alias("__key"))

    def place(batches):
        keys, base, offset = sent.value
        for batch in batches:
            key = batch.column(len(kept)).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            rank = key & ((1 << 44) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base[at] + rank), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return map_arrow(ranked, place, f"{schema}, sequence_id long, offset long")
