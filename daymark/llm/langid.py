"""Language identification by mixtures.

Every language has a distribution over hashed character trigrams. A document's trigrams are taken as a mixture of the
languages and of a uniform background; expectation-maximisation estimates the shares. The set of languages is
chosen by penalised likelihood: the best single language first, then the language with the next share as long as
the log-likelihood grows by more than ``PENALTY`` times the log of the number of trigrams. The prediction is the
language with the largest share, and the score is that share.

Scale: training counts trigrams over all labelled texts, summed per task before the shuffle. The model has one row
of ``BUCKETS`` numbers per language, whatever the corpus; more than ``MAX_LANGUAGES`` labels are refused, which bounds
the collected table and its broadcast. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, remainder, table

BUCKETS = 1 << 16
MAX_LANGUAGES = 100
PENALTY = 3.0
NEW_COLUMNS = {"lang_pred": pa.string(), "score": pa.float64(), "shares": pa.string(), "unexplained": pa.float64()}
#: Characters below this: letters in lower case, everything else a space. Others stand for themselves.
FOLDED = np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x250)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Bucket of the trigram around each letter of the text."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < len(FOLDED)
    codes = np.where(low, FOLDED[np.where(low, codes, 0)], codes).astype(np.uint64)
    mid = codes[1:-1]
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + mid) * np.uint64(0x85EBCA77) + codes[2:]
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(48))[mid != 32].astype(np.uint16)


@dataclass
class Model:
    names: list[str]
    #: Probability of each bucket; one row per language, the last one is the background.
    rows: np.ndarray


def train(docs: DataFrame) -> Model:
    """Trigram distributions from all rows whose ``text`` and ``lang`` are not null."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(trigrams(text))
            for lang, parts in by.items():
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    labelled = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = map_arrow(labelled, count, "lang string, bucket int, n long")
    counts = table(found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = np.full((len(names) + 1, BUCKETS), 0.1)
    if names:
        found = counts.toPandas()
        rows[np.searchsorted(np.array(names, object), found["lang"].to_numpy(object)), found["bucket"]] += found["n"]
    rows[-1] = 1.0
    return Model(names, rows / rows.sum(axis=1, keepdims=True))


def shares(model: Model, text: str) -> dict[int, float]:
    """Share of each selected row of the model, for a text with letters."""
    buckets, weight = np.unique(trigrams(text), return_counts=True)
    chances = model.rows[:, buckets]
    weight = weight / 1.0
    n = weight.sum()
    bound = PENALTY * np.log(n + 1)
    alone = np.log(chances) @ weight
    best = int(alone.argmax())

    def fit(part: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        share = np.full(len(part), 1 / len(part))
        for _ in range(rounds):
            joint = share @ part
            last, share = share, share * (part @ (weight / joint)) / n
            if np.abs(last - share).max() < 1e-3:
                break
        return share, float(np.log(share @ part) @ weight)

    share, reached = fit(chances, 6)
    if reached - alone[best] < bound:  # nothing that could be added is worth it
        return {best: 1.0}
    order = [best, *(int(i) for i in np.argsort(-share) if i != best)]
    chosen, value, kept = [best], float(alone[best]), np.ones(1)
    for i in order[1:]:
        more, gained = fit(chances[[*chosen, i]], 30)
        if gained - value < bound:
            break
        chosen, value, kept = [*chosen, i], gained, more
    return dict(zip(chosen, kept.tolist()))


def judge(model: Model, text: str | None) -> tuple[str, float, str, float]:
    """(lang_pred, score, shares, unexplained) of one text; ``und`` without a letter or without a model."""
    if not text or not model.names or not any(map(str.isalpha, text)):
        return "und", 0.0, "", 1.0
    found = shares(model, text)
    other = found.pop(len(model.names), 0.0)
    if not found:  # all background: the likeliest language, with no share
        buckets = trigrams(text)
        top = int(np.log(model.rows[:-1, buckets]).sum(axis=1).argmax())
        return model.names[top], 0.0, "", 1.0
    ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))
    text_ = ",".join(f"{model.names[i]}:{s:.3f}" for i, s in ranked)
    return model.names[ranked[0][0]], min(1.0, max(0.0, ranked[0][1])), text_, other


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, shares (``lang:share``, comma-joined) and unexplained (the background's share).

    Columns of these names are replaced. Reads ``text`` only.
    """
    kept = [c for c in docs.columns if c not in NEW_COLUMNS]
    at = kept.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.rows))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            found = [judge(own, t) for t in batch.column(at).to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(NEW_COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *NEW_COLUMNS])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{schema}, lang_pred string, score double, shares string, unexplained double")


def learned(docs: DataFrame) -> DataFrame:
    """The rows to learn from: remainder of the id not 2."""
    return docs.where(remainder("doc_id", 4) != 2)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without documents that no learned language explains: no letters, or mostly background."""
    model = train(learned(docs))
    names = [f"c{i}" for i in range(len(docs.columns))]  # clear of the names that a prediction adds
    at = docs.columns.index("text")
    judged = predict(docs.toDF(*names).withColumnRenamed(names[at], "text"), model)
    kept = judged.where("lang_pred <> 'und' and unexplained <= 0.5")
    return kept.select(*["text" if i == at else n for i, n in enumerate(names)]).toDF(*docs.columns)
