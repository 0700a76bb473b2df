"""Line dedup with sharded cuckoo filters over exact reference counts.

The index is two tables. ``holdings`` has one row (key, doc_id) for each document that holds a line: counting its
rows gives the exact reference count of a line, inserting a document adds rows, deleting it removes them, so every
insertion can be undone. ``filters`` has one cuckoo filter per shard with the keys that stand in ``min_docs`` or
more documents; when counts pass that number in either direction only the changed keys are inserted or deleted.
A document's lines are first tried on the filter of their shard; only those that pass meet the exact table.

A key is the MD5 of the line, stripped of ASCII white space and with A-Z in lower case.

Scale: keys of 16 bytes are shuffled, never lines. A line held by a third of the documents is counted by partial
aggregation, tried in (shard, salt) groups that share copies of one filter, and joined to one row of the exact
table by a join that adaptive execution can split. The number of shards follows the number of frequent keys, so a
filter stays near ``KEYS_PER_SHARD`` keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, table

KEYS_PER_SHARD = 20_000
SLOTS = 4


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """MD5 of the normalised line, or None if it has fewer than ``min_chars`` code points."""
    key = line.strip()  # on bytes: exactly the ASCII white space
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key.lower()).digest()


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; the second bucket is the first one xor a hash of the fingerprint."""

    def __init__(self, keys: int = 0, slots: np.ndarray | None = None):
        if slots is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
            slots = np.zeros((buckets, SLOTS), np.uint16)
        self.slots = slots

    @staticmethod
    def load(data: bytes) -> CuckooFilter:
        return CuckooFilter(slots=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        words = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4)
        mask = np.uint32(len(self.slots) - 1)
        mark = (words[:, 1] & np.uint32(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = words[:, 2] & mask
        return mark, first, (first ^ self.jump(mark)) & mask

    @staticmethod
    def jump(mark):
        return (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)).astype(np.uint32)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, first, second = self.places(keys)
        hit = self.slots[first] == mark[:, None]
        hit |= self.slots[second] == mark[:, None]
        return hit.any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """False if a key found no room; the filter must then be built anew with more buckets."""
        if not keys:
            return True
        mask = len(self.slots) - 1
        for mark, first, second in zip(*(x.tolist() for x in self.places(keys))):
            at = first if (self.slots[first] == 0).any() else second
            for kick in range(500):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    break
                turn = (mark + kick) % SLOTS
                mark, self.slots[at, turn] = int(self.slots[at, turn]), mark
                at = (at ^ int(self.jump(mark))) & mask
            else:
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Remove one fingerprint of each key; only keys that were inserted may be given."""
        if not keys:
            return
        for mark, first, second in zip(*(x.tolist() for x in self.places(keys))):
            for at in (first, second):
                found = np.flatnonzero(self.slots[at] == mark)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break


def filled(keys: list[bytes]) -> CuckooFilter:
    room = len(keys)
    while True:
        made = CuckooFilter(room)
        if made.insert(keys):
            return made
        room = 2 * max(room, 16)


def holdings(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """One row (key, doc_id) for each document and distinct line of ``min_chars`` or more code points."""

    def extract(batches):
        for batch in batches:
            keys, owners = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {line_key(line, min_chars) for line in (text or "").encode().split(b"\n") if len(line) >= min_chars}
                own.discard(None)
                keys.extend(own)
                owners.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc_id"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), extract, "key binary, doc_id long")
    return found.dropDuplicates(["key", "doc_id"])


def reference_counts(held: DataFrame) -> DataFrame:
    """(key, n_docs, last_doc): in how many documents a line stands, and the largest id among them.

    Documents without an id count as one, and are the smallest.
    """
    return held.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_of(key, shards: int):
    return (F.conv(F.hex(F.substring(key, 1, 3)), 16, 10).cast("int") % shards).alias("shard")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, n_shards, filter) over the keys of ``frequent``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = filled([bytes(k) for k in pdf["key"]])
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n_shards": shards, "filter": [made.dump()]})

    return frequent.select("key", shard_of("key", shards)).groupBy("shard").applyInPandas(
        build, "shard int, n_shards int, filter binary"
    )


def changed_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int, frequent: DataFrame) -> DataFrame:
    """Filters after inserting and deleting keys; a shard without room is built anew from the exact table."""
    delta = added.select("key", F.lit(True).alias("more")).unionByName(removed.select("key", F.lit(False).alias("more")))
    delta = delta.select("key", "more", shard_of("key", shards))

    def change(filters_: pd.DataFrame, delta_: pd.DataFrame) -> pd.DataFrame:
        one = CuckooFilter.load(filters_["filter"].iloc[0]) if len(filters_) else CuckooFilter(KEYS_PER_SHARD)
        keys = [bytes(k) for k in delta_["key"]]
        one.delete([k for k, more in zip(keys, delta_["more"]) if not more])
        full = not one.insert([k for k, more in zip(keys, delta_["more"]) if more])
        shard = int((filters_ if len(filters_) else delta_)["shard"].iloc[0])
        return pd.DataFrame({"shard": [shard], "n_shards": [shards], "filter": [None if full else one.dump()]})

    out = filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(
        change, "shard int, n_shards int, filter binary"
    )
    out = table(out, "line-filters")
    full = out.where("filter is null").select("shard")
    again = build_filters(frequent.join(frequent.select("key", shard_of("key", shards)).join(full, "shard"), "key", "left_semi"), shards)
    return out.where("filter is not null").unionByName(again)


def probe(held: DataFrame, filters: DataFrame, shards: int, rows: int) -> DataFrame:
    """The holdings whose key passes the filter of its shard: every frequent key, and a few others."""
    salts = -(-max(64, rows // 50_000) // shards)
    left = held.select("key", "doc_id", shard_of("key", shards), F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)).cast("int").alias("salt"))
    right = filters.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def passing(held_: pd.DataFrame, filters_: pd.DataFrame) -> pd.DataFrame:
        if not len(held_) or not len(filters_):
            return held_.iloc[:0][["key", "doc_id"]]
        hit = CuckooFilter.load(filters_["filter"].iloc[0]).contains([bytes(k) for k in held_["key"]])
        return held_.loc[hit, ["key", "doc_id"]]

    grouped = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt"))
    return grouped.applyInPandas(passing, "key binary, doc_id long")


def drop_lists(passed: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, drops): the keys that a document loses. A line stays in the largest doc_id that holds it."""
    lost = passed.join(frequent.select("key", "last_doc"), "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("drops"))


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int = 40) -> DataFrame:
    """``docs`` with the lines of ``drops`` taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``.

    Other columns stay; ``n_lines`` and ``n_dropped`` of the input are replaced. A null text is one empty line.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = drops.select(F.col("doc_id").alias("__doc"), F.col("drops").alias("__drops"))
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(drops, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
    at = kept.index("text")

    def rewrite(batches):
        for batch in batches:
            texts, before, lost = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist()):
                text = text or ""
                n = text.count("\n") + 1
                before.append(n)
                if drop is not None:
                    drop = set(drop)
                    stay = [line for line in text.encode().split(b"\n") if line_key(line, min_chars) not in drop]
                    text, n = b"\n".join(stay).decode(), n - len(stay)
                else:
                    n = 0
                texts.append(text)
                lost.append(n)
            columns = list(batch.columns[: len(kept)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(lost, pa.int64())], [*kept, "n_lines", "n_dropped"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema])
    return map_arrow(joined, rewrite, f"{schema}, n_lines long, n_dropped long")


class LineIndex:
    """Incremental index: insert and delete documents, and dedup documents against all that it holds."""

    def __init__(self, spark, min_chars: int = 40, min_docs: int = 5):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.held = self.frequent = self.filters = None
        self.shards = self.rows = 0

    def _refresh(self, held: DataFrame) -> None:
        """Take over new holdings; the filters change by the keys that became frequent or ceased to be."""
        before = self.frequent
        self.held = table(held, "line-holdings")
        counts = reference_counts(self.held).where(F.col("n_docs") >= self.min_docs)
        self.frequent = table(counts, "line-frequent")
        n = self.frequent.count()
        self.rows = self.held.count()
        shards = max(1, -(-n // KEYS_PER_SHARD))
        if before is None or shards > 2 * self.shards:
            self.shards = shards
            self.filters = table(build_filters(self.frequent, shards), "line-filters")
        else:
            added = self.frequent.join(before, "key", "left_anti")
            removed = before.join(self.frequent, "key", "left_anti")
            self.filters = table(changed_filters(self.filters, added, removed, self.shards, self.frequent), "line-filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        new = holdings(docs, self.min_chars)
        self._refresh(new if self.held is None else self.held.unionByName(new).dropDuplicates(["key", "doc_id"]))
        return self

    def delete(self, docs: DataFrame) -> LineIndex:
        """Forget documents by ``doc_id``."""
        gone = docs.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        if self.held is not None:
            self._refresh(self.held.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti"))
        return self

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs``, which the index holds, without the repeated lines."""
        passed = probe(self.held, self.filters, self.shards, self.rows)
        return without_lines(docs, drop_lists(passed, self.frequent), self.min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` without the lines that stand in ``min_docs`` or more of them, but for the largest ``doc_id``.

    Null and empty texts are one empty line, which is too short to go. Rows of one ``doc_id`` are one document.
    """
    return LineIndex(docs.sparkSession, min_chars, min_docs).insert(docs).dedup(docs)
