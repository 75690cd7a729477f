"""Packing by vector bin packing under simultaneous limits (operator 2).

Examples are placed into sequences by the dot-product heuristic: an open sequence takes the example whose demand vector
(tokens, segments, loss-bearing tokens) has the largest weighted dot product with the room that is left. What no whole
example fills is filled by the first tokens of one that is cut; its rest goes back to the waiting examples.

Each task packs the rows of its own input split through a bounded pool, so there is no shuffle and no group that grows
with the data; texts are tokenised once, where their pieces are placed.

Defined cases: a null text is an empty text; an empty text is one end id; a null id stays null; repeated rows are packed
each on its own; an empty table gives no rows; other columns of the input are ignored. A text longer than a sequence
gives several pieces. The last tokens of a task, fewer than one sequence, are cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from callsight.llm.common import id_and_text

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "segment int, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``pool`` bounds the examples that wait in a task, ``pool_tokens`` their tokens."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 2048
    pool_tokens: int = 4_000_000


class Packer:
    """Places examples ``(key, n_tokens, loss_from)``: tokens from ``loss_from`` on bear loss (a prompt does not).

    ``add`` and ``finish`` yield pieces ``(key, start, length, sequence, offset, segment, loss)``. A key may be any value.
    """

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.sequence = limits, 0
        self.keys: list = []
        self.spans: list[tuple[int, int, int]] = []  # start, end, loss_from
        self.waiting = 0

    def loss(self, start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def add(self, key, n: int, loss_from: int) -> Iterator[tuple]:
        start, most = 0, self.limits.tokens
        # Pieces that fill a sequence alone, unless the loss limit is the tighter one.
        while n - start >= most and self.loss(start, start + most, loss_from) <= self.limits.loss_tokens:
            yield key, start, most, self._next(), 0, 0, self.loss(start, start + most, loss_from)
            start += most
        if start < n:
            self.keys.append(key)
            self.spans.append((start, n, loss_from))
            self.waiting += n - start
        if len(self.keys) >= self.limits.pool or self.waiting >= self.limits.pool_tokens:
            yield from self._pack(leave=self.limits.tokens * 8)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(leave=0)

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _pack(self, leave: int) -> Iterator[tuple]:
        """Fills sequences until at most ``leave`` tokens wait (0: until fewer than a sequence's, then the tail)."""
        lim = self.limits
        room_all = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=float)
        span = np.array(self.spans, dtype=np.int64).reshape(-1, 3)
        keys, alive = list(self.keys), np.ones(len(span), dtype=bool)

        def demands():
            tokens = span[:, 1] - span[:, 0]
            loss = np.maximum(0, span[:, 1] - np.maximum(span[:, 0], span[:, 2]))
            return np.stack([tokens, np.ones(len(span), dtype=np.int64), loss], axis=1)

        need = demands()
        weight = need.mean(axis=0) / room_all**2 if len(span) else room_all  # scarce dimensions weigh more
        while alive.any() and self.waiting > (leave or lim.tokens - 1):
            room, at, segment, number = room_all.copy(), 0, 0, self._next()
            while room[0] >= 1 and room[1] >= 1:
                fits = alive & (need <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, need @ (weight * room), -1.0)
                    i = int(score.argmax())
                    start, end = int(span[i, 0]), int(span[i, 1])
                else:
                    open_ = np.flatnonzero(alive)
                    if not len(open_):
                        break
                    i = int(open_[need[open_, 0].argmax()])
                    start, free_of_loss = int(span[i, 0]), max(0, int(span[i, 2]) - int(span[i, 0]))
                    end = min(int(span[i, 1]), start + min(int(room[0]), free_of_loss + int(room[2])))
                    if end == start:
                        break
                loss = self.loss(start, end, int(span[i, 2]))
                yield keys[i], start, end - start, number, at, segment, loss
                room -= (end - start, 1, loss)
                at, segment = at + end - start, segment + 1
                self.waiting -= end - start
                if end == span[i, 1]:
                    alive[i] = False
                else:
                    span[i, 0] = end
                    need[i] = span[i, 1] - end, 1, self.loss(end, int(span[i, 1]), int(span[i, 2]))
        self.keys = [keys[i] for i in np.flatnonzero(alive)]
        self.spans = [tuple(map(int, span[i])) for i in np.flatnonzero(alive)]
        if not leave:
            yield from self._tail()

    def _tail(self) -> Iterator[tuple]:
        """The last tokens: sequences whose lengths are powers of two, as far as the other limits let them be."""
        lim, i = self.limits, 0
        while i < len(self.spans):
            size = 1 << (self.waiting.bit_length() - 1)
            at = segment = loss_used = 0
            number = self._next()
            while at < size and i < len(self.spans) and segment < lim.segments:
                start, end, loss_from = self.spans[i]
                free_of_loss = max(0, loss_from - start)
                cut = min(end, start + size - at, start + free_of_loss + lim.loss_tokens - loss_used)
                if cut == start:
                    break
                loss = self.loss(start, cut, loss_from)
                yield self.keys[i], start, cut - start, number, at, segment, loss
                at, segment, loss_used = at + cut - start, segment + 1, loss_used + loss
                self.waiting -= cut - start
                self.spans[i] = (cut, end, loss_from)
                i += cut == end
        self.keys, self.spans = [], []


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """One row per placed piece; ``loss_tokens`` leaves out the first token of a document, which nothing predicts.

    A ``sequence_id`` holds the number of the input split above bit 32 and the sequence's number in it below.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callsight.llm.tokens import Encoder

        encoder, packer = Encoder.of(tokenizer), Packer(limits)
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # key -> document, ids, tokens placed so far
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int32() if f.endswith(" int") else pa.int64() for f in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def settle(pieces):
            for key, start, length, number, offset, segment, loss in pieces:
                doc, ids, placed = held[key]
                rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + number, offset, segment, loss))
                if placed + length == len(ids) // 4:
                    del held[key]
                else:
                    held[key] = doc, ids, placed + length

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return batch

        key = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                held[key] = doc, ids, 0
                settle(packer.add(key, len(ids) // 4, 1))
                key += 1
                if len(rows) >= 20_000:
                    yield out()
        settle(packer.finish())
        if rows:
            yield out()

    return id_and_text(docs).mapInArrow(place, SCHEMA)
