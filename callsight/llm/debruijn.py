"""Substring dedup on the De Bruijn graph of the texts' words (operator 1).

An edge is a window of ``k`` words, between the nodes of its first and last k - 1 words. A word goes when a window that
covers it also starts in a document with a smaller doc_id.

1. Paths. In each document, consecutive edges whose smallest inner gram of ``m`` words is the same one are gathered to
   a path, known by the hash of that gram (its anchor), the hash of all its edges, and its source coordinates (document,
   first word, number of edges). Equal windows have equal anchors, so all that a window could equal meets at the anchor.
2. Nonbranching paths are compacted: where every place of an anchor has the same path, the path stands for all its edges,
   and places in other than the smallest document are repeats. The same holds for equal paths of a branching anchor.
3. What is left of branching anchors is broken up again: a join with the documents brings the edges at those coordinates
   one by one, and they are matched in the same way.
4. Repeats that continue each other, in the document and in their source, are joined to spans (an anti join finds where spans
   begin), and source coordinates verify them: the words at both coordinates are hashed where the texts are, and a join on the
   coordinates keeps the spans whose words agree. A join of these with the documents removes their words.

Rows go to the matching tasks as columns of numbers in binary values, one value for each block of texts and each of
``parts`` parts of the anchors' hashes. A block sends each of its paths once, for its smallest document; the other
places are repeats already. An anchor with more than ``CROWD`` different paths in a block is branching for certain: one
row says so, and the paths are settled as such. So no anchor, however frequent, sends more than a few rows a block.

Paths are taken as equal when 112 bits agree (anchor and edges), single edges when 88 bits do (edge and anchor); the words of
what goes are then compared with those of its source by SHA-256.

Defined cases: a null or empty text has no words and the hash of the empty string; fewer than k words: nothing goes; a
null doc_id takes no part and loses nothing; a very long text is one block; rows that repeat a doc_id are windows
of one document, each row with its own result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text, landed
from callsight.llm.wordhash import Words, blocks, column_blocks, grams, mix

#: Different paths of one anchor in a block from which on it is taken for branching without being asked.
CROWD = 8
REPEAT, BRANCH = 1, 2
PACKED = "part int, anchor binary, path binary, start binary, edges binary, crowd binary, docs binary, counts binary, texts binary, settled binary"
PLACES = "doc_id long, variant long, start int, edges int, source_doc long, source_start int, kind int"
SETTLED = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("edges", "<i4"), ("source_doc", "<i8"), ("source_start", "<i4"), ("kind", "<i4")])
PATH_BITS, EDGE_BITS = np.uint64((1 << 48) - 1), np.uint64(40)


class Paths:
    """Columns of paths: anchor, path, doc, text (which of a document's rows), start, edges, crowd (a mark, not a path)."""

    def __init__(self, **columns: np.ndarray):
        self.columns = columns
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.anchor)

    def take(self, rows: np.ndarray) -> Paths:
        return Paths(**{c: x[rows] for c, x in self.columns.items()})

    @staticmethod
    def joined(all_: list[Paths]) -> Paths:
        return Paths(**{c: np.concatenate([p.columns[c] for p in all_]) for c in all_[0].columns})


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by the keys, whether a row begins a new group."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def windows_of(texts: list[bytes], k: int, m: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first words of the windows, the windows' hashes, places of their smallest gram of m words, its hash)."""
    w = Words(texts)
    hashes, at = w.hashes(), np.flatnonzero(w.windows(k))
    if not len(at):
        return w, at, hashes[:0], at, hashes[:0]
    inner = grams(hashes, m)
    count = len(inner) - (k - m)
    least, place = inner[:count].copy(), np.zeros(count, dtype=np.int64)
    for step in range(1, k - m + 1):
        other = inner[step : step + count]
        smaller = other < least
        least[smaller] = other[smaller]
        place[smaller] = step
    return w, at, grams(hashes, k)[at], at + place[at], least[at]


def paths_of(ids: np.ndarray, variants: np.ndarray, texts: list[bytes], k: int, m: int) -> Paths:
    """The paths of a block of texts."""
    w, at, edge, least, anchor = windows_of(texts, k, m)
    text = w.texts_of()[at]
    head = np.flatnonzero(_groups(least, text))
    n = np.diff(np.append(head, len(at)))
    # The edges' places against the anchor belong to the path: equal paths lie equally around equal anchors.
    rank = (least - at).astype(np.uint64)
    sums = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(mix(edge + rank * np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    return Paths(
        anchor=anchor[head],
        path=mix(sums[head + n] - sums[head]) & PATH_BITS,
        doc=ids[text[head]],
        text=variants[text[head]],
        start=(at[head] - w.first[text[head]]).astype(np.uint32),
        edges=n.astype(np.uint8),
        crowd=np.zeros(len(head), dtype=np.uint8),
    )


def edges_of(ids: np.ndarray, variants: np.ndarray, texts: list[bytes], asked: Places, k: int, m: int) -> Paths:
    """The single edges at the places asked for, as paths of their own: the edge's hash stands as the anchor."""
    w, at, edge, _, anchor = windows_of(texts, k, m)
    wanted = np.zeros(len(w.starts) + 1, dtype=np.int32)
    first = np.repeat(w.first[:-1], asked.counts) + asked.starts
    np.add.at(wanted, first, 1)
    np.add.at(wanted, first + asked.edges, -1)
    rows = np.flatnonzero(np.cumsum(wanted)[at] > 0)
    text = w.texts_of()[at[rows]]
    return Paths(
        anchor=edge[rows],
        path=anchor[rows] >> EDGE_BITS,
        doc=ids[text],
        text=variants[text],
        start=(at[rows] - w.first[text]).astype(np.uint32),
        edges=np.ones(len(rows), dtype=np.uint8),
        crowd=np.zeros(len(rows), dtype=np.uint8),
    )


class Places:
    """The places of some texts as flat arrays: a text's own lie between two of ``cuts``."""

    def __init__(self, starts: np.ndarray, edges: np.ndarray, counts: np.ndarray):
        self.starts, self.edges, self.counts = starts, edges, counts
        self.cuts = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def of(cls, column: pa.ListArray) -> Places:
        flat = column.flatten()
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return cls(flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False), counts)

    def between(self, a: int, b: int) -> Places:
        own = slice(self.cuts[a], self.cuts[b])
        return Places(self.starts[own], self.edges[own], self.counts[a:b])


def settled(p: Paths, source: Paths, kind: int) -> np.ndarray:
    out = np.empty(len(p), dtype=SETTLED)
    for name, column in (("doc", p.doc), ("text", p.text), ("start", p.start), ("edges", p.edges), ("source_doc", source.doc), ("source_start", source.start), ("kind", kind)):
        out[name] = column
    return out


def match(p: Paths, in_block: bool) -> tuple[np.ndarray, Paths]:
    """(what is settled among these paths, what is open). Within one block, others may hold more paths of an anchor; else nothing stays open."""
    marks = np.unique(p.anchor[p.crowd > 0])
    p = p.take(np.flatnonzero(p.crowd == 0))
    if not len(p):
        return np.empty(0, dtype=SETTLED), p
    s = p.take(np.lexsort((p.start, p.text, p.doc, p.path, p.anchor)))
    new = _groups(s.anchor, s.path)
    first = np.flatnonzero(new)  # of each path, its place in the smallest document
    source = first[np.cumsum(new) - 1]
    later = s.doc > s.doc[source]
    new_anchor = _groups(s.anchor)
    heads, anchor = np.flatnonzero(new_anchor), np.cumsum(new_anchor) - 1
    kinds = np.bincount(anchor[first], minlength=len(heads))
    if in_block:
        branching = kinds > CROWD
    else:
        apart = np.maximum.reduceat(s.doc, heads) > np.minimum.reduceat(s.doc, heads)
        branching = (kinds > 1) & apart | np.isin(s.anchor[heads], marks)
    rows, branch = np.flatnonzero(later), np.flatnonzero(branching[anchor] & ~later)
    done = np.concatenate([settled(s.take(rows), s.take(source[rows]), REPEAT), settled(s.take(branch), s.take(branch), BRANCH)])
    if not in_block:
        return done, s.take(rows[:0])
    crowds = s.take(heads[branching])
    crowds.crowd = crowds.columns["crowd"] = np.ones(len(crowds), dtype=np.uint8)
    return done, Paths.joined([s.take(np.flatnonzero(~later & ~branching[anchor])), crowds])


def _planes(x: np.ndarray) -> bytes:
    """Little-endian bytes, all first ones first: small numbers leave runs of zeros that a shuffle compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, order[cuts[i] : cuts[i + 1]]


def sent(p: Paths, parts: int) -> Iterator[pa.RecordBatch]:
    """The PACKED rows of a block: open paths to the part of their anchor, settled ones to the part of their document."""
    done, open_ = match(p, in_block=True)
    rows = []
    for i, own in _by_part((open_.anchor % np.uint64(parts)).astype(np.int64), parts):
        s = open_.take(np.sort(own))
        s = s.take(np.lexsort((s.start, s.text, s.doc)))
        run = np.flatnonzero(_groups(s.doc, s.text))
        counts = np.diff(np.append(run, len(s))).astype("<u4")
        rows.append([i, _planes(s.anchor), _planes(s.path), _planes(s.start), s.edges.tobytes(), s.crowd.tobytes(), _planes(s.doc[run]), counts.tobytes(), _planes(s.text[run]), b""])
    for i, own in _by_part((mix(done["doc"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), parts):
        rows.append([i, *[b""] * 8, done[own].tobytes()])
    if rows:
        types = [pa.int32(), *[pa.binary()] * 9]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in PACKED.split(", ")])


def settle(table: pa.Table) -> pa.Table:
    """PLACES of one part."""
    paths, done = [], []
    for r in table.to_pylist():
        if r["settled"]:
            done.append(np.frombuffer(r["settled"], dtype=SETTLED))
            continue
        counts = np.frombuffer(r["counts"], dtype="<u4")
        paths.append(Paths(
            anchor=_numbers(r["anchor"], "<u8"), path=_numbers(r["path"], "<u8"), doc=np.repeat(_numbers(r["docs"], "<i8"), counts), text=np.repeat(_numbers(r["texts"], "<i8"), counts),
            start=_numbers(r["start"], "<u4"), edges=np.frombuffer(r["edges"], dtype=np.uint8), crowd=np.frombuffer(r["crowd"], dtype=np.uint8),
        ))
    if paths:
        done.append(match(Paths.joined(paths), in_block=False)[0])
    got = np.concatenate(done) if done else np.empty(0, dtype=SETTLED)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(got[f]), t) for f, t in zip(SETTLED.names, kinds)], [f.split()[0] for f in PLACES.split(", ")])


class Graph:
    """The repeats of a table's windows of k words, and what is made of them."""

    def __init__(self, docs: DataFrame, k: int = 13, m: int = 5, parts: int | None = None):
        if not 1 <= m <= k <= 255:
            raise ValueError("1 <= m <= k <= 255")
        self.k, self.m = k, m
        rows = id_and_text(docs)
        self.parts = parts or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = rows.select("doc_id").filter("doc_id IS NOT NULL")
        # Rows of one doc_id are told apart by a hash of their text, where there are any.
        self.again = not ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        self.rows = rows.select("doc_id", (F.xxhash64("text") if self.again else F.lit(0).cast("long")).alias("variant"), "text")
        first = self._settled(self.rows.mapInArrow(self._path_blocks(), PACKED))
        self.first = landed(first, "debruijn-paths")
        self.texts = self.rows.mapInArrow(squeezed, "doc_id long, variant long, squeezed binary")

    def _settled(self, blocks_: DataFrame) -> DataFrame:
        return blocks_.groupBy("part").applyInArrow(settle, PLACES)

    def _path_blocks(self):
        k, m, parts = self.k, self.m, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(0).is_valid())
                ids, variants = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy()
                for first, some in column_blocks(batch.column(2)):
                    own = slice(first, first + len(some))
                    yield from sent(paths_of(ids[own], variants[own], some, k, m), parts)

        return run

    def with_places(self, places: DataFrame) -> DataFrame:
        """Every text, compressed, with its places as an array that is no longer than the text; both uses share one shuffle of the texts."""
        of_text = places.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "edges")).alias("places"))
        return self.texts.join(of_text, ["doc_id", "variant"], "left").select("doc_id", "variant", "squeezed", "places")

    def repeats(self) -> DataFrame:
        """PLACES of all repeats, of whole paths and of single edges."""
        k, m, parts = self.k, self.m, self.parts

        def edge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(3).is_valid())
                ids, variants = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                asked = Places.of(batch.column(3))
                for first, some in blocks([plain(t.as_py()) for t in batch.column(2)]):
                    own = slice(first, first + len(some))
                    yield from sent(edges_of(ids[own], variants[own], some, asked.between(own.start, own.stop), k, m), parts)

        branches = self.with_places(self.first.filter(F.col("kind") == BRANCH))
        single = self._settled(branches.mapInArrow(edge_blocks, PACKED))
        return self.first.unionByName(single).filter(F.col("kind") == REPEAT)

    def kept(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept): every row's words without those of verified repeats, joined by one space."""
        k = self.k
        places = self.verified().select("doc_id", "variant", "start", (F.col("words") - (k - 1)).alias("edges"))

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                count, gone, kept = [], [], []
                all_places = Places.of(batch.column(3))
                for i, text in enumerate(batch.column(2)):
                    words = plain(text.as_py()).split()  # of bytes: the six ASCII white-space ones
                    count.append(len(words))
                    places = all_places.between(i, i + 1)
                    if len(places.starts):
                        step = np.zeros(len(words) + 1, dtype=np.int32)
                        np.add.at(step, places.starts, 1)
                        np.add.at(step, places.starts + places.edges + k - 1, -1)
                        stays = np.cumsum(step[:-1]) == 0
                        words = [w for w, s in zip(words, stays.tolist()) if s]
                    gone.append(count[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

        return self.with_places(places).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")

    def spans(self) -> DataFrame:
        """(doc_id, variant, start, words, source_doc, source_start): repeats that continue each other, joined.

        A repeat is joined with the one before it when that ends where it begins, in the document and in the source.
        """
        found = self.repeats().select("doc_id", "variant", "start", "edges", "source_doc", "source_start")
        rows = landed(found.distinct() if self.again else found, "debruijn-repeats")  # equal rows have equal repeats
        ends = rows.select("doc_id", "variant", (F.col("start") + F.col("edges")).alias("start"), "source_doc", (F.col("source_start") + F.col("edges")).alias("source_start"))
        on = ["doc_id", "variant", "start", "source_doc", "source_start"]
        heads = rows.join(ends, on, "left_anti").select(*on)
        # Along one diagonal of a document and its source, a repeat belongs to the last head before it.
        line = Window.partitionBy("doc_id", "variant", "source_doc", F.col("source_start") - F.col("start")).orderBy("start")
        marked = rows.join(heads.withColumn("head", F.lit(1)), on, "left").withColumn("span", F.sum(F.coalesce("head", F.lit(0))).over(line))
        key = ["doc_id", "variant", "source_doc", (F.col("source_start") - F.col("start")).alias("shift"), "span"]
        joined = marked.groupBy(*key).agg(F.min("start").alias("start"), F.sum("edges").alias("edges"), F.min("source_start").alias("source_start"))
        return joined.select("doc_id", "variant", "start", (F.col("edges") + self.k - 1).cast("int").alias("words"), "source_doc", "source_start")


    def verified(self) -> DataFrame:
        """The spans whose words are those at their source coordinates; the others, equal by chance in their hashes alone, are left out."""
        spans = landed(self.spans(), "debruijn-spans")
        here = spans.select("doc_id", "variant", "start", F.col("words").alias("edges"))
        # A source's rows of one doc_id may differ; each is asked and one that agrees is enough.
        there = spans.select(F.col("source_doc").alias("doc_id"), F.col("source_start").alias("start"), F.col("words").alias("edges")).distinct()
        if self.again:
            there = there.join(self.rows.select("doc_id", "variant").distinct(), "doc_id")
        else:
            there = there.withColumn("variant", F.lit(0).cast("long"))
        asked = self.with_places(here.unionByName(there.select("doc_id", "variant", "start", "edges")).distinct()).filter("places IS NOT NULL")
        seen = landed(asked.mapInArrow(digests, "doc_id long, variant long, start int, words int, digest binary"), "debruijn-digests")
        sources = seen.select(F.col("doc_id").alias("source_doc"), F.col("start").alias("source_start"), "words", F.col("digest").alias("source_digest")).distinct()
        checked = spans.join(seen, ["doc_id", "variant", "start", "words"]).join(sources, ["source_doc", "source_start", "words"])
        return checked.filter("digest = source_digest").select("doc_id", "variant", "start", "words", "source_doc", "source_start").distinct()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words, joined by one space, at each place asked for."""
    for batch in batches:
        places, out = Places.of(batch.column(3)), []
        for i, (doc, variant, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
            own = places.between(i, i + 1)
            words = plain(text.as_py()).split()
            for a, n in zip(own.starts.tolist(), own.edges.tolist()):
                if a + n <= len(words):
                    out.append((doc, variant, a, n, hashlib.sha256(b" ".join(words[a : a + n])).digest()))
        if out:
            names, kinds = ["doc_id", "variant", "start", "words", "digest"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: half of what a shuffle's own compression leaves."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        small = [squeeze.compress((t.as_py() or "").encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], ["doc_id", "variant", "squeezed"])


def plain(squeezed_text: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(squeezed_text)


def dedup_substrings(docs: DataFrame, k: int = 13, m: int = 5, parts: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``."""
    return Graph(docs, k, m, parts).kept()


def repeated_spans(docs: DataFrame, k: int = 13, m: int = 5, parts: int | None = None) -> DataFrame:
    """The spans that go, each with a copy in a smaller document: (doc_id, variant, start, words, source_doc, source_start)."""
    return Graph(docs, k, m, parts).verified()
