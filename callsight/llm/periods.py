"""Runs of words that repeat with a period: Baier's grouping gives Lyndon arrays, Lyndon roots extend to runs (operator 13).

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``shortest`` words long, that no
neighbouring word extends. Every run holds its Lyndon root, under one of an order of the words and the reverse order, as the
longest Lyndon word that starts at some place. The first phase of Baier's suffix sorting groups the places by just that word:
it starts with one group a word, takes the groups from the greatest to the smallest, and moves the nearest smaller place
left of a group's members to a new group right behind its own, its word lengthened by the members'. The phase is run once for
each order and needs no suffix array. Each root that is followed by two more is extended to both sides as far as words one
period apart are equal (the longest common extension, compared block by block), once a run.

A run of four periods holds each of its words four times. So texts are first cut at words that their part holds fewer times,
again and again until nothing changes; only what is left, as whole parts, is grouped. This drops no run, and costs nothing
but a sort where texts do not repeat.

Defined cases: a null or empty text has no words and no run, and the hash of the empty text; a null doc_id stays null (and
plants nothing); repeated rows give repeated rows; a very long text is taken alone, in time that grows as n log n; ties for
the longest run go to the smallest start, then period; an empty table gives no rows; other columns are ignored. Words are the
same where their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callsight.llm.common import id_and_text
from callsight.llm.wordhash import Words, column_blocks

#: Words compared at first when a root is extended; each further comparison takes twice as many.
STEP = 16


def dense_parts(words: np.ndarray, text_of: np.ndarray, times: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, part of each): what is left when parts are cut at words that they hold fewer than ``times`` times."""
    places, part = np.arange(len(words)), text_of
    while len(places):
        order = np.lexsort((words[places], part))
        a, b = part[order], words[places][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        often = np.empty(len(order), dtype=bool)
        often[order] = np.bincount(group)[group] >= times
        places, part = places[often], part[often]
        cut = np.ones(len(places), dtype=bool)
        cut[1:] = (part[1:] != part[:-1]) | (places[1:] != places[:-1] + 1)
        part = np.cumsum(cut) - 1
        long = np.bincount(part, minlength=1)[part] >= shortest if len(part) else np.zeros(0, dtype=bool)
        if often.all() and long.all():
            break
        places, part = places[long], part[long]
    return places, part


def lyndon_lengths(ranks: list[int], stops: list[bool]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the first phase of Baier's suffix sorting.

    ``ranks`` orders the words, from 0 on; a place with ``stops`` ends its part and belongs to no word. An end of a part is
    smaller than any word.
    """
    n = len(ranks)
    # Groups as a list from small to great: ``below`` is the next smaller group; a new one stands right above its old one.
    count = max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    group_of = [0] * n
    for i in range(n):
        if not stops[i]:
            members[ranks[i]].append(i)
            group_of[i] = ranks[i]
    below = list(range(-1, count - 1))
    above = [*range(1, count), -1]
    length = [1] * count
    out = [0] * n
    # The nearest place to the left that is not in a group taken so far: a forest with path halving. ``left[i] == i``: not taken.
    left = list(range(n))
    now = count - 1
    while now >= 0:
        # Places that moved on stand in the old list still: only those whose group this is count.
        own = [i for i in members[now] if group_of[i] == now]
        members[now] = own
        size = length[now]
        for i in own:
            out[i] = size
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and left[j] != j:
                up = left[j]
                if up >= 0:
                    left[j] = left[up]
                j = up
            left[i] = j
            if j >= 0 and not stops[j]:
                times[j] = times.get(j, 0) + 1
        if times:
            by: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                by.setdefault((-k, group_of[j]), []).append(j)
            for key in sorted(by) if len(by) > 1 else by:  # the most repetitions first: they end up highest
                moved, old = by[key], key[1]
                new = len(length)
                length.append(length[old] - key[0] * size)
                members.append(moved)
                for j in moved:
                    group_of[j] = new
                over = above[old]
                below.append(old)
                above.append(over)
                above[old] = new
                if over >= 0:
                    below[over] = new
        now = below[now]
    return out


def extended(words: np.ndarray, i: int, p: int, first: int, end: int) -> tuple[int, int]:
    """[a, b): the stretch around [i, i + p) within [first, end) in which words p apart are equal."""
    a, step = i, STEP
    while a > first:
        low = max(first, a - step)
        other = np.flatnonzero(words[low:a] != words[low + p : a + p])
        if len(other):
            a = low + int(other[-1]) + 1
            break
        a, step = low, 2 * step
    b, step = i + p, STEP
    while b < end:
        high = min(end, b + step)
        other = np.flatnonzero(words[b:high] != words[b - p : high - p])
        if len(other):
            b += int(other[0])
            break
        b, step = high, 2 * step
    return a, b


def runs_of(words: np.ndarray, text_of: np.ndarray, exponent: int = 4, shortest: int = 6) -> np.ndarray:
    """Rows (place, length, period), sorted, of all runs of the texts; places count over all texts."""
    places, part = dense_parts(words, text_of, exponent, max(shortest, exponent))
    if not len(places):
        return np.zeros((0, 3), dtype=np.int64)
    # The parts one after the other, each closed by a place that ends it.
    at = np.arange(len(places)) + part
    size = int(at[-1]) + 2
    ranks, stops = np.zeros(size, dtype=np.int64), np.ones(size, dtype=bool)
    ranks[at] = np.unique(words[places], return_inverse=True)[1]
    stops[at] = False
    back = np.full(size, -1, dtype=np.int64)
    back[at] = places
    flat = np.where(stops, -1, ranks)
    edges = np.flatnonzero(stops)  # the end of each part
    begins = np.concatenate([[0], edges[:-1] + 1])
    found: set[tuple[int, int, int]] = set()
    for order in (ranks, ranks.max() - ranks):
        lam = np.array(lyndon_lengths(order.tolist(), stops.tolist()), dtype=np.int64)
        roots = np.flatnonzero(~stops)
        for times in range(1, exponent - 1):  # a run of four periods holds three whole roots in a row
            p = lam[roots]
            follows = roots + p * times
            roots = roots[(follows < size) & (lam[np.minimum(follows, size - 1)] == p)]
        p = lam[roots]
        part_no = np.searchsorted(edges, roots)
        until: dict[int, int] = {}  # period -> where the last run of it ended; places come in ascending order
        for i, q, k in zip(roots.tolist(), p.tolist(), part_no.tolist()):
            if i + q <= until.get(q, -1):
                continue
            a, b = extended(flat, i, q, int(begins[k]), int(edges[k]))
            until[q] = b
            if b - a >= max(shortest, exponent * q):
                found.add((int(back[a]), b - a, q))
    return np.array(sorted((a, q, n) for a, n, q in found), dtype=np.int64).reshape(-1, 3)[:, [0, 2, 1]]


#: Place of each word in the source text, given the text's doc_id and number of words; None where nothing is changed.
Order = Callable[[int | None, int], np.ndarray | None]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Fixed rule: in a tenth of the texts, chosen by a checksum of the doc_id, the words from one place on repeat a first few."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long, collapsed string, runs array<struct<start:long,length:long,period:long>>"


def block_runs(ids: list[int | None], texts: list[bytes], order: Order | None, exponent: int, shortest: int) -> list[tuple]:
    """A row of SCHEMA for each text."""
    w = Words(texts)
    hashes, of = w.hashes(), w.texts_of()
    orders = [order(i, int(n)) if order else None for i, n in zip(ids, w.counts)]
    source = np.arange(len(hashes))
    for k, own in enumerate(orders):
        if own is not None:
            source[w.first[k] : w.first[k + 1]] = w.first[k] + own
    words = hashes[source]
    runs = runs_of(words, of, exponent, shortest)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(marks[:-1]) > 0
    edges = np.searchsorted(runs[:, 0], w.first)
    rows = []
    for k, (doc_id, text) in enumerate(zip(ids, texts)):
        first, end = int(w.first[k]), int(w.first[k + 1])
        own = runs[edges[k] : edges[k + 1]] - [first, 0, 0]
        if orders[k] is None and not len(own):
            kept = b" ".join(text.split())  # of bytes: at the six white-space ones
        else:
            at = source[first:end][~dropped[first:end]].tolist()
            kept = b" ".join([w.raw[w.starts[i] : w.ends[i]] for i in at])
        listed = own.tolist()
        best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        text_of_runs = "".join(f"{a},{n},{q}\n" for a, n, q in listed)
        rows.append(
            (doc_id, len(listed), *top, hashlib.sha256(text_of_runs.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
             end - first, int(dropped[first:end].sum()), kept.decode(), [dict(zip(("start", "length", "period"), r)) for r in listed])
        )
    return rows


def periodic_runs(
    docs: DataFrame, exponent: int = 4, shortest: int = 6, order: Order | None = None, details: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: the number of runs, the longest one, hashes of all runs and of the text without repetitions.

    ``exponent`` is a whole number, 2 at least. Words of a run after its first period are dropped from the collapsed text. With ``details`` the columns n_words,
    n_dropped, collapsed and runs follow. ``order`` rearranges the words of a text first.
    """
    fields = SCHEMA.split(", ")
    names = [f.split()[0] for f in fields][: 12 if details else 8]
    record = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(record)][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, some in column_blocks(batch.column(1)):
                rows = block_runs(ids[first : first + len(some)], some, order, exponent, shortest)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ", ".join(fields[: len(names)]))
