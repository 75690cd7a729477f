"""Benchmark decontamination by q-gram lemma filtering (operator 5).

Benchmark items and documents are compared as UTF-8 bytes with A-Z in lower case and one space between words. An item is
cut into overlapping patterns of ``span`` bytes (a shorter item is one pattern). A pattern of m bytes within k edits of a
document's passage shares at least m - q + 1 - q * k of its q-grams with it, on diagonals at most k apart. So shared
q-grams are counted in overlapping bands of diagonals, bands that reach the bound are regions, and an alignment of the
pattern with the region decides: bit-parallel over many regions at once for patterns of up to 64 bytes, banded for longer
ones. A document is contaminated when one pattern is found with at most ``rate`` * m edits.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, and the documents are scanned whole, once
a block, without a shuffle. With q = 8 a q-gram is one 64-bit number, so equal numbers are equal q-grams.

Items of fewer than ``shortest`` bytes hold too few q-grams to tell an edited one from ordinary prose; they are searched word for
word, all at once by an automaton, and found only as whole words.

Defined cases: a null or empty text holds nothing, and a null or blank item is found nowhere; a null doc_id stays null; a very
long text is scanned alone, in parts of bounded size; repeated rows and repeated items are reported each; an empty table on either
side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text, shipped
from callsight.llm.wordhash import column_blocks

Q = 8
#: Bytes of benchmark text that go to the tasks at once, at most (one item alone may be longer).
QUERY_BYTES = 4 << 20
#: Places of q-grams in patterns that are counted at once.
COUNTED = 2_000_000
#: Regions aligned at once: each takes a table of 2 KB.
ALIGNED = 2048
_TABLE_BITS = 22


def normal(text: str | bytes | None) -> bytes:
    """A-Z in lower case, words (runs without ASCII white space) joined by one space."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return b" ".join(raw.lower().split())


def banded_distance(pattern: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, end): the fewest edits between the pattern and any part of the region, and where that part ends.

    ``region`` starts at the band's first diagonal; it is len(pattern) + width long, and an alignment may drift by
    ``most`` beyond the band. Distances above ``most`` come back as most + 1.
    """
    m, n = len(pattern), len(region)
    width = max(1, n - m + 1) + 2 * most  # diagonals -most .. n - m + most
    steps, diagonal = np.arange(width), np.arange(width) - most
    row = np.where((diagonal >= 0) & (diagonal <= n), 0, most + 1)  # a part may start anywhere
    padded = np.concatenate([np.full(most + 1, -1), region.astype(np.int64), np.full(m + width + 1, -1)])
    for i in range(1, m + 1):
        j = diagonal + i  # column of each cell
        letters = padded[most + j]  # region[j - 1]
        cell = row + (letters != pattern[i - 1])
        cell[:-1] = np.minimum(cell[:-1], row[1:] + 1)
        cell[(j < 0) | (j > n)] = most + 1
        at_edge = j == 0
        cell[at_edge] = i
        cell = np.minimum.accumulate(cell - steps) + steps
        cell[(j < 0) | (j > n)] = most + 1
        row = np.minimum(cell, most + 1)
        if row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), int(best - most + m)


def aligned(patterns: list[np.ndarray], buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) per pattern of at most 64 bytes: the fewest edits between it and any part of buffer[begin:end], and where the
    first such part ends, counted from begin. Myers' bit-parallel columns, one column of all patterns a step."""
    size = np.array([len(p) for p in patterns])
    each, one = np.arange(len(patterns)), np.uint64(1)
    equal = np.zeros((len(patterns), 256), dtype=np.uint64)  # per byte, the places of the pattern that hold it
    for i in range(int(size.max())):
        long = np.flatnonzero(size > i)
        equal[long, np.array([patterns[k][i] for k in long])] |= one << np.uint64(i)
    last = (size - 1).astype(np.uint64)
    up, down = np.full(len(patterns), ~np.uint64(0)), np.zeros(len(patterns), dtype=np.uint64)
    score, best, end = size.copy(), size.copy(), np.zeros(len(patterns), dtype=np.int64)
    for j in range(int((ends - begins).max())):
        same = equal[each, buffer[np.minimum(begins + j, len(buffer) - 1)]]
        across = same | down
        same = (((same & up) + up) ^ up) | same
        more, less = down | ~(same | up), up & same
        score += ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
        more, less = more << one, less << one  # a part may start anywhere
        up, down = less | ~(across | more), more & across
        better = (score < best) & (begins + j < ends)
        best[better], end[better] = score[better], j + 1
    return best, end


@dataclass
class Patterns:
    """The patterns of some items and the index of their q-grams."""

    items: list[tuple[int, bytes]]
    span: int
    rate: float
    shortest: int = 2 * Q

    def __post_init__(self):
        self.item, self.at, self.text = [], [], []
        self.short: dict[bytes, list[int]] = {}
        for i, (_, text) in enumerate(self.items):
            if len(text) < max(self.shortest, 2 * Q):
                self.short.setdefault(text, []).append(i)
                continue
            last = max(0, len(text) - self.span)
            for a in sorted({*range(0, last + 1, self.span // 2), last}):
                self.item.append(i)
                self.at.append(a)
                self.text.append(np.frombuffer(text[a : a + self.span], dtype=np.uint8))
        self.automaton = None  # of the short items; made where it is used
        if not self.text:
            return
        length = np.array([len(t) for t in self.text])
        self.most = np.minimum((length * self.rate).astype(int), (length - Q) // Q)  # the bound stays at least 1
        self.bound = length - Q + 1 - Q * self.most
        self.step = int(self.most.max()) + 1  # a band is two steps wide, so every drift lies within one
        grams = np.concatenate([qgrams(t) for t in self.text])
        of = np.repeat(np.arange(len(length)), length - Q + 1)
        place = np.concatenate([np.arange(n - Q + 1) for n in length])
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(order))
        self.of, self.place = of[order], place[order]
        # Places by q-gram and then pattern: those of a range of patterns are found by bisection.
        self.gram_of = np.repeat(np.arange(len(self.grams), dtype=np.int64), np.diff(self.first)) << 32 | self.of
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[slot(self.grams)] = True
        # A passage, with all its hits, lies in a window of the longest passage's length that begins with a hit.
        self.window = int((length + self.most).max())
        self.window_hits = int(self.bound.min())
        self.reach = int((length + 2 * self.most).max()) + 2 * self.step

    def regions(self, buffer: np.ndarray) -> list[tuple[int, int]]:
        """(pattern, first diagonal) of the bands that reach their pattern's bound, in text joined by newlines."""
        if len(buffer) < Q:
            return []
        hit = self.table[slot(qgrams(buffer))]
        hits = np.flatnonzero(hit)
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        ends = np.minimum(hits + self.window, len(hit))
        dense = hits[sums[ends] - sums[hits] >= self.window_hits]  # windows that begin with a hit are enough
        if not len(dense):
            return []
        mark = np.zeros(len(hit) + 1, dtype=np.int32)
        np.add.at(mark, np.maximum(0, dense - self.reach), 1)
        np.add.at(mark, np.minimum(len(hit), dense + self.reach), -1)
        hits = hits[np.cumsum(mark[:-1])[hits] > 0]
        values = qgrams(buffer)[hits]
        row = np.minimum(np.searchsorted(self.grams, values), len(self.grams) - 1)
        real = self.grams[row] == values
        hits, row = hits[real], row[real]
        found: list[tuple[int, int]] = []
        size = self.first[row + 1] - self.first[row]
        # Places and patterns of each hit, in parts that end where no region can span them; a part with more places than are counted
        # at once, as of a q-gram that many patterns share, is taken by ranges of patterns.
        for part in self._parts(hits, size):
            ranges = 1 + int(size[part].sum()) // COUNTED
            for low, high in pairwise(np.linspace(0, len(self.text), min(ranges, len(self.text)) + 1).astype(np.int64).tolist()):
                base = row[part].astype(np.int64) << 32
                first = np.searchsorted(self.gram_of, base | low) if low else self.first[row[part]]
                n = (np.searchsorted(self.gram_of, base | high) if high < len(self.text) else self.first[row[part] + 1]) - first
                index = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                of = self.of[index]
                band = (np.repeat(hits[part], n) - self.place[index]) // self.step
                both = np.concatenate([band, band - 1]) + 2**20  # a diagonal may be negative at the buffer's start
                keys, counts = np.unique(np.concatenate([of, of]).astype(np.int64) << 40 | both, return_counts=True)
                reached = counts >= self.bound[keys >> 40]
                found += [(int(k >> 40), (int(k & (1 << 40) - 1) - 2**20) * self.step) for k in keys[reached]]
        return found

    def _parts(self, hits: np.ndarray, size: np.ndarray) -> Iterator[slice]:
        """Slices of the hits with some COUNTED places each, cut at gaps longer than any region."""
        gaps = np.flatnonzero(np.diff(hits) > self.reach) + 1
        total = np.cumsum(size)
        start, done = 0, 0
        for g in gaps.tolist():
            if total[g - 1] - done >= COUNTED:
                yield slice(start, g)
                start, done = g, int(total[g - 1])
        if start < len(hits):
            yield slice(start, len(hits))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, place in the item, start, end, edits) of every pattern found in texts, places in normalised bytes."""
        yield from self._exact(texts)
        if not self.text:
            return
        raw = b"\n".join(texts)
        buffer = np.frombuffer(raw, dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        seen: set[tuple[int, int, int]] = set()
        for text, p, edits, end in self._aligned(raw, buffer, begins):
            if edits <= self.most[p] and (text, p, end) not in seen:
                seen.add((text, p, end))
                start = end - len(self.text[p]) - int(begins[text])
                yield text, self.item[p], self.at[p], max(0, start), end - int(begins[text]), edits

    def _exact(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``search`` for the short items: as they stand, between spaces or ends of the text."""
        if not self.short:
            return
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word in self.short:
                self.automaton.add_word(f" {word.decode('latin-1')} ", word)
            self.automaton.make_automaton()
        for text, raw in enumerate(texts):
            for end, word in self.automaton.iter(f" {raw.decode('latin-1')} "):
                for item in self.short[word]:
                    yield text, item, 0, end - len(word) - 1, end - 1, 0

    def _aligned(self, raw: bytes, buffer: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, pattern, edits, end in the buffer) of every region, aligned in each text that it touches."""
        found = np.array(self.regions(buffer), dtype=np.int64).reshape(-1, 2)
        p, diagonal = found[:, 0], found[:, 1]
        size, most = np.array([len(t) for t in self.text])[p], self.most[p]
        stop = diagonal + 2 * self.step + size
        probes = np.clip(np.stack([diagonal, diagonal + self.step + size // 2, stop], axis=1), 0, max(0, len(buffer) - 1))
        touched = np.sort(np.searchsorted(begins, probes, side="right") - 1, axis=1)
        new = np.diff(touched, axis=1, prepend=-1) > 0
        region, text = np.nonzero(new)[0], touched[new]
        a = np.maximum(begins[text], diagonal[region])
        b = np.minimum(begins[text + 1] - 1, (stop + most)[region])
        fits = b - a >= (size - most)[region]
        region, text, a, b = region[fits], text[fits], a[fits], b[fits]
        if self.span > 64:
            for k, t, x, y in zip(p[region].tolist(), text.tolist(), a.tolist(), b.tolist()):
                pattern = self.text[k]
                exact = raw.find(pattern.tobytes(), x, y)
                edits, end = (0, exact + len(pattern) - x) if exact >= 0 else banded_distance(pattern, buffer[x:y], int(self.most[k]))
                yield t, k, edits, x + end
            return
        for i in range(0, len(region), ALIGNED):
            some = slice(i, i + ALIGNED)
            own = p[region[some]].tolist()
            edits, end = aligned([self.text[k] for k in own], buffer, a[some], b[some])
            yield from zip(text[some].tolist(), own, edits.tolist(), (a[some] + end).tolist())


def qgrams(data: np.ndarray) -> np.ndarray:
    """The q-grams of a byte array as 64-bit numbers, a view without a copy."""
    return np.ndarray((max(0, len(data) - Q + 1),), dtype="<u8", buffer=data, strides=(1,)) if len(data) >= Q else np.zeros(0, dtype=np.uint64)


def slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def query_blocks(benchmark: DataFrame, item_col: str, text_col: str, span: int, rate: float, shortest: int) -> Iterator[Patterns]:
    """The benchmark in blocks of about QUERY_BYTES: the only part of it that is on the driver at a time."""
    items = id_and_text(benchmark, item_col, text_col).toDF("item", "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + 2 * int(total) // QUERY_BYTES
    for b in range(count):
        mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == b).collect()  # bounded: half of QUERY_BYTES on average
        rows = [(r["item"], normal(r["text"])) for r in sorted(mine, key=lambda r: (r["item"] is None, r["item"], r["text"]))]
        if rows := [r for r in rows if r[1]]:
            yield Patterns(rows, span, rate, shortest)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, span: int = 64, rate: float = 0.1, shortest: int = 40, item_col: str = "item_id", bench_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, start, end, patterns, edits, coverage): one row per document and item found in it.

    ``start`` and ``end`` bound what was found, in bytes of the normalised text; ``edits`` is the fewest of a pattern;
    ``coverage`` is the share of the item's bytes that lie in patterns that were found.
    """
    schema = "doc_id long, item_id long, start long, end long, patterns long, edits long, coverage double"
    rows = id_and_text(docs)
    out = None
    for patterns in query_blocks(benchmark, item_col, bench_text_col, span, rate, shortest):
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for first, some in column_blocks(batch.column(1)):
                    by: dict[tuple[int, int], list[tuple]] = {}
                    for text, item, *rest in index.search([normal(t) for t in some]):
                        by.setdefault((text, item), []).append(rest)
                    for (text, item), hits in sorted(by.items()):
                        name, whole = index.items[item]
                        places = {a for a, *_ in hits}
                        inside = np.zeros(len(whole), dtype=bool)
                        for a in places:
                            inside[a : a + index.span] = True
                        found.append((ids[first + text], name, min(h[1] for h in hits), max(h[2] for h in hits), len(places), min(h[3] for h in hits), float(inside.mean())))
                if found:
                    names = [f.split()[0] for f in schema.split(", ")]
                    types = [*[pa.int64()] * 6, pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", span: int = 64, rate: float = 0.1, shortest: int = 40, item_col: str = "item_id", bench_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    out, at = shipped(docs), docs.columns.index(text_col)
    for patterns in query_blocks(benchmark, item_col, bench_text_col, span, rate, shortest):
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, some in column_blocks(batch.column(at)):
                    for text, *_ in shared.value.search([normal(t) for t in some]):
                        keep[first + text] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
