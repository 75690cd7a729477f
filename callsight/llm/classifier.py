"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products (operator 9).

Features of a text are its word unigrams and bigrams in lower case, the n-grams (one to three) of its words' shapes
(``Xx,`` for "Then,"), and whether words repeat the one or two before. Each kind's counts are divided by the number of
words, so a score is the mean of the weights that the text's n-grams hash to. Only the text is an input.

Learning uses a bounded sample: at most ``sample`` labelled rows, those with the smallest hashes of their ids, dealt
to ``shards`` tasks. Each runs FTRL-proximal over its own rows; the weights are averaged. Rows whose crc32 of the id as
text leaves 2 modulo 4 are never learnt from. Scoring covers every row in one pass without a shuffle.

Defined cases: a null or empty text has the two constant features alone and is scored by them; a null doc_id is scored
and not held out; a null label is not learnt from, and of several labels of a document the smallest counts; repeated rows
are scored each; without any labelled row every score is 0.5; a very long text is scored alone, whole; empty tables give no rows;
other columns are no inputs. Of rows that repeat a labelled doc_id the one with the smallest text is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text, shipped
from callsight.llm.wordhash import Words, blocks, column_blocks, grams, mix

BITS = 18
#: Labelled rows that are learnt from, at most.
SAMPLE = 8_192
SHARDS = 4
THRESHOLD = 0.7

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)  # a symbol stands for itself
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


@dataclass(frozen=True)
class Ftrl:
    """Step size, its smoothing, and the two penalties; passes over the sample."""

    alpha: float = 0.5
    beta: float = 0.05
    l1: float = 0.001
    l2: float = 0.01
    epochs: int = 4


def shapes(w: Words) -> np.ndarray:
    """Hash of each word's classes of characters, runs of one class taken once."""
    classes = _CLASS[w.bytes]
    keep = np.ones(len(classes), dtype=bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[w.starts] = True
    number = np.cumsum(keep)  # of kept bytes up to each place
    kept = classes[keep]
    short = Words.__new__(Words)
    short.bytes, short.starts, short.ends = kept, number[w.starts] - 1, number[w.ends - 1]
    return short.hashes()


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and per kind of feature (texts, feature numbers) of its occurrences."""
    w = Words(texts)
    of, shape = w.texts_of(), shapes(w)
    w.bytes = _ASCII_LOWER[w.bytes]
    words = w.hashes()
    kinds = []
    number = lambda keys, kind: (mix(keys + np.uint64(kind + 1)) >> np.uint64(64 - bits)).astype(np.int64)
    for kind, (of_kind, n) in enumerate(((words, 1), (words, 2), (shape, 1), (shape, 2), (shape, 3))):
        at = np.flatnonzero(w.windows(n)) if n > 1 else np.arange(len(of))
        kinds.append((of[at], number(grams(of_kind, n)[at], kind)))
    for back in (1, 2):
        at = np.arange(back, len(words))
        at = at[(of[at] == of[at - back]) & (words[at] == words[at - back])]
        kinds.append((of[at], number(np.full(len(at), back, dtype=np.uint64), 10)))
    return w.counts, kinds


def _constants(counts: np.ndarray, bits: int) -> tuple[int, int, np.ndarray]:
    """Numbers of the constant feature and of the one for texts without words, and which texts have the latter."""
    number = mix(np.array([101, 102], dtype=np.uint64)) >> np.uint64(64 - bits)
    return int(number[0]), int(number[1]), counts == 0


def vectors(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """A sparse vector (numbers, values) per text."""
    counts, kinds = features(texts, bits)
    always, empty, none = _constants(counts, bits)
    of = np.concatenate([np.arange(len(texts)), np.flatnonzero(none), *(a for a, _ in kinds)])
    numbers = np.concatenate([np.full(len(texts), always), np.full(int(none.sum()), empty), *(b for _, b in kinds)])
    worth = np.concatenate([np.ones(len(texts) + int(none.sum())), *(1.0 / counts[a] for a, _ in kinds)])
    keys, inverse = np.unique(of << bits | numbers, return_inverse=True)
    values = np.bincount(inverse, weights=worth)
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) << bits)
    numbers = (keys & ((1 << bits) - 1)).astype(np.int32)
    return [(numbers[a:b], values[a:b].astype(np.float32)) for a, b in zip(cut, cut[1:])]


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], how: Ftrl, bits: int = BITS) -> np.ndarray:
    """Weights after FTRL-proximal updates over the rows in order, ``how.epochs`` times."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(z, n):
        return np.where(np.abs(z) <= how.l1, 0.0, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for (numbers, values), label in zip(rows, labels):
            own_z, own_n = z[numbers], n[numbers]
            w = weights(own_z, own_n)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            z[numbers] = own_z + g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / how.alpha * w
            n[numbers] = own_n + g * g
    return weights(z, n)


def score(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The probability of label 1 per text."""
    bits = len(weights).bit_length() - 1
    out = np.zeros(len(texts))
    for first, some in blocks(texts):
        counts, kinds = features(some, bits)
        always, empty, none = _constants(counts, bits)
        total = weights[always] + weights[empty] * none
        for of, numbers in kinds:
            total += np.bincount(of, weights=weights[numbers], minlength=len(some)) / np.maximum(1, counts)
        out[first : first + len(some)] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, shards: int = SHARDS, how: Ftrl = Ftrl(), bits: int = BITS) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows of ``docs``. Only the weights, 2**bits a shard, come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: bounded, whatever the size of the tables. Of rows that repeat an id one is learnt from.
    found = id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def fit(shard):
        shard = shard.sort_values(["doc_id", "text"])
        shard = shard.iloc[np.argsort(mix(shard.doc_id.to_numpy().astype(np.uint64)), kind="stable")]
        texts = [(t or "").encode() for t in shard.text]
        sparse = [v for _, some in blocks(texts, 256 << 10) for v in vectors(some, bits)]
        import pandas as pd

        return pd.DataFrame({"rows": [len(texts)], "weights": [learn(sparse, shard.label.tolist(), how, bits).astype("<f4").tobytes()]})

    got = rows.groupBy("shard").applyInPandas(fit, "rows long, weights binary").collect()
    if not got:
        return np.zeros(1 << bits)
    parts = np.array([np.frombuffer(r.weights, dtype="<f4") for r in got], dtype=float)
    return np.average(parts, axis=0, weights=[r.rows for r in got])


def scores(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score(some, shared.value) for _, some in column_blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *got]))], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score(some, shared.value) for _, some in column_blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *got]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
