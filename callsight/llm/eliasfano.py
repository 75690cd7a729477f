"""Token-id files with Elias-Fano document boundaries (operator 7).

A dataset is a Parquet folder whose rows are segments in ascending document order. A segment holds the concatenated ids
of its documents (little-endian, two bytes each where the vocabulary allows it, else four) and the cumulative lengths as
an Elias-Fano sequence: the low bits of each value packed side by side, the high parts as a unary bit vector, and the
bit position of every ``SAMPLE``-th value for select. For n values up to u that is n * (2 + log2(u / n)) bits, not 64 n.

Defined cases: a null text is an empty text, and a document without ids still has the end id; a null doc_id sorts first
and stays null; rows that repeat a doc_id keep their own ids, ordered by a hash of their text; a very long text is a
segment of its own length; an empty table gives an empty dataset; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text

#: Every so many values the bit position of one is kept.
SAMPLE = 64
#: Documents whose bounds are read together.
BATCH = 1 << 12
#: A segment is closed when its ids reach this size.
SEGMENT_BYTES = 8 << 20
SEGMENT_SCHEMA = (
    "part int, segment int, first_doc long, docs long, doc_ids binary, null_docs binary, id_bytes int, n_ids long, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("values must be non-negative and not decrease")
        width = max(0, int(values[-1] // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(width)) & 1
        ones = (values >> width) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, width, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Value number ``i``: from the nearest sample on, the bytes' counts of ones lead to its bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(at, 8)
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        first, width = i * self.low_bits, self.low_bits
        if not width:
            return 0
        raw = self.low[first // 8 : (first + width + 7) // 8].tobytes()
        return int.from_bytes(raw, "little") >> first % 8 & ((1 << width) - 1)

    def select_range(self, first: int, stop: int) -> np.ndarray:
        """Values number ``first`` to ``stop`` - 1: only the bits from the sample before them to the one after them are looked at."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        if first == stop:
            return np.zeros(0, dtype=np.int64)
        sample, after = first // SAMPLE, -(-stop // SAMPLE)
        begin = int(self.samples[sample])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")) + begin // 8 * 8
        ones = ones[ones >= begin][first - sample * SAMPLE :][: stop - first]
        out = (ones - np.arange(first, stop)).astype(np.int64) << self.low_bits
        if self.low_bits:
            a, b = first * self.low_bits, stop * self.low_bits
            bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(stop - first, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def values(self) -> np.ndarray:
        """All values, decoded at once."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def size(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Writes the dataset at ``path``, a folder that all executors share. Rows are dealt by ranges of doc_id and text hash."""
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from callsight.llm.tokens import Encoder

        encoder = Encoder.of(tokenizer)
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        kind, end = "<u4" if wide else "<u2", np.array([end_id], dtype="<u4").tobytes()
        part, number, ids, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids]))
            flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(kind)
            nulls = np.packbits([k is None for k in keys], bitorder="little").tobytes()
            # Sorted keys as steps from the first one, in as few bytes as the largest step needs.
            steps = np.diff(np.array([k or 0 for k in keys], dtype=np.int64), prepend=np.int64(keys[0] or 0))
            width = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.abs(steps).max() <= np.iinfo(t).max)
            row = [part, number, keys[0] or 0, len(keys), width.encode() + steps.astype(width).tobytes(), nulls, flat.itemsize,
                   len(flat), flat.tobytes(), ends.low_bits, ends.low.tobytes(), ends.high.tobytes(), ends.samples.tobytes()]
            fields = [f.split() for f in SEGMENT_SCHEMA.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, (_, t) in zip(row, fields)], [f for f, _ in fields])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encoder.ids(text.as_py()) + end)
                keys.append(key)
                size += len(ids[-1])
                if size >= SEGMENT_BYTES:
                    yield close()
                    ids, keys, size, number = [], [], 0, number + 1
        if keys:
            yield close()

    rows = id_and_text(docs)
    if rows.isEmpty():
        rows.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path)
        return
    dealt = rows.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    dealt.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files alone; ``start`` counts the ids of all documents before it."""
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One small row a segment: its place in the whole file follows from the sizes of those before it.
    sizes = stored.select("part", "segment", "n_ids")
    in_part = sizes.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("outer"))
    base = in_part.join(before, "part").select("part", "segment", (F.col("inner") + F.col("outer")).alias("base"))
    placed = stored.join(base, ["part", "segment"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = EliasFano(r["docs"], r["low_bits"], r["low"], r["high"], r["samples"])
                flat = np.frombuffer(r["ids"], dtype=f"<u{r['id_bytes']}")
                width, steps = r["doc_ids"][:3].decode(), r["doc_ids"][3:]
                keys = r["first_doc"] + np.cumsum(np.frombuffer(steps, dtype=width).astype(np.int64))
                null = np.unpackbits(np.frombuffer(r["null_docs"], dtype=np.uint8), bitorder="little")[: r["docs"]].astype(bool)
                for first in range(0, r["docs"], BATCH):
                    # A batch's bounds by select, the end of the document before it included.
                    stop = min(first + BATCH, r["docs"])
                    bounds = ends.select_range(max(0, first - 1), stop) if first else np.concatenate([[0], ends.select_range(0, stop)])
                    begin = int(bounds[0])
                    some = flat[begin : int(bounds[-1])].astype("<u4").tobytes()
                    crc = [zlib.crc32(some[4 * a : 4 * b]) for a, b in pairwise((bounds - begin).tolist())]
                    own = pa.array(keys[first:stop], pa.int64(), mask=null[first:stop])
                    columns = [own, pa.array(bounds[:-1] + r["base"], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ROW_SCHEMA.split(", ")])

    return placed.mapInArrow(documents, ROW_SCHEMA)
