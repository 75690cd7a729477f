"""Ranked lexical search by impact-sorted lists without random access, NRA (operator 12).

The terms of a block of query items are known to every task. One pass over the table writes, per document, its length and the
counts of those terms (a forward table); the numbers of documents that hold each term, and with them the terms' weights,
are summed from it. A task then takes the forward rows in shards of a bounded size. A shard has one list of postings a term,
the highest impact first, and answers every item from them alone:

* lists are read in order, all of them down to the same impact, which falls by ``STEEP`` a round,
* a document's lower bound is the sum of the impacts read; its upper bound adds the next impact of each list in which it was
  not met,
* the k-th largest lower bound is the threshold. Documents with an upper bound below it go for good; when even a document not met yet
  would stay below, only the ones that are left are looked for,
* it ends when both bounds of all that are left are equal, so that membership, ties and scores are settled; a tie with the
  threshold is never dropped.

A shard's best k are merged by rank, first by a salt, then over all. So no list, no item's candidates and no score table is
ever whole in one place. Items are taken in blocks of a bounded number of bytes, one pass over the table each.

Defined cases: a null or empty text has no terms and is no document of the statistics; an item without terms, or a null one, has
no rows; items that share an id are answered one by one, under that id; rows that repeat a doc_id are documents of their
own, each with a rank; a null doc_id is ranked behind equal scores; a very long text is one row of the forward table, no longer than the
block's terms; empty tables give no rows; other columns are ignored. Terms are the same where their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text, landed
from callsight.llm.wordhash import Words, column_blocks

#: Fixed rule: terms are runs of ASCII letters and digits and of characters outside ASCII; only A-Z are lower-cased.
PARTS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
#: Bytes of query items that are answered together.
QUERY_BYTES = 4 << 20
#: A shard has so many postings and documents, or one document.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 15
#: The impact down to which lists are read falls by this factor a round.
STEEP = 4
SALTS = 64


def terms_of(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of lower-cased texts and their hashes."""
    w = Words([t.lower() for t in texts], PARTS)  # of bytes: A-Z alone
    return w, w.hashes()


class Items:
    """A block of query items: their different terms, and each item's terms as numbers among them."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        w, hashes = terms_of([t.encode() for _, t in rows])
        self.terms = np.unique(hashes)
        number = np.searchsorted(self.terms, hashes)
        self.of_item = [np.unique(number[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]

    def counts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per text: its number of terms, and the block's terms in it with their occurrences."""
        w, hashes = terms_of(texts)
        at = np.searchsorted(self.terms, hashes)
        mine = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == hashes)) if len(self.terms) else at[:0]
        keys, tf = np.unique(w.texts_of()[mine] * max(1, len(self.terms)) + at[mine], return_counts=True)
        edges = np.searchsorted(keys, np.arange(len(texts) + 1) * max(1, len(self.terms)))
        for k, n in enumerate(w.counts.tolist()):
            a, b = edges[k], edges[k + 1]
            yield n, keys[a:b] - k * max(1, len(self.terms)), tf[a:b]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of about QUERY_BYTES: the only part of them that is on the driver at a time."""
    rows = id_and_text(items, id_col, text_col).toDF("item", "text").filter("text != ''")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * int(total) // QUERY_BYTES
    for b in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()  # bounded: half of QUERY_BYTES on average
        if mine:
            yield Items(sorted(((r["item"], r["text"]) for r in mine), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


FORWARD = "doc_id long, n long, terms binary, tf binary"


def forward_table(docs: DataFrame, shared) -> DataFrame:
    """One row per document with a term: its number of terms, and the items' terms in it (numbers and counts, 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in column_blocks(batch.column(1)):
                found = [(first + k, n, t.astype("<u4").tobytes(), tf.astype("<u4").tobytes()) for k, (n, t, tf) in enumerate(shared.value.counts(some)) if n]
                at, n, terms, tf = zip(*found) if found else ((),) * 4
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, FORWARD)


def holders(forward: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "df"])

    df = np.zeros(size, dtype=np.int64)
    if size:
        for r in forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term
            df[r["term"]] = r["df"]
    return df


class Shard:
    """The postings of some documents: a list a term, the highest impact first."""

    def __init__(self, size: int, weights: np.ndarray, norm: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        """``norm``: m of each document; ``counts``: how many of the postings are of each document."""
        self.docs = len(norm)
        doc = np.repeat(np.arange(self.docs), counts)
        tf = tf.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
        order = np.lexsort((-impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.rising = -self.impact  # within a list
        self.edges = np.searchsorted(terms[order], np.arange(size + 1))

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best above 0 and of all that tie with the last of them."""
        at, ends = self.edges[terms], self.edges[terms + 1]
        some = at < ends
        at, ends = at[some].copy(), ends[some]
        level = int(self.impact[at].max(initial=0))
        lower, alive = np.zeros(self.docs), None
        read: list[tuple[np.ndarray, np.ndarray]] = []  # (documents, number of the list) of what was read
        while level:
            level //= STEEP
            stops = np.array([a + np.searchsorted(self.rising[a:b], -level, side="right" if level else "left") for a, b in zip(at, ends)], dtype=np.int64)
            docs = np.concatenate([self.doc[a:b] for a, b in zip(at, stops)])
            gains = np.concatenate([self.impact[a:b] for a, b in zip(at, stops)])
            lists = np.repeat(np.arange(len(at)), stops - at)
            if alive is not None:
                docs, gains, lists = docs[alive[docs]], gains[alive[docs]], lists[alive[docs]]
            lower += np.bincount(docs, gains, self.docs)  # whole numbers below 2**53
            read.append((docs, lists))
            at = stops
            ahead = np.where(at < ends, self.impact[np.minimum(at, len(self.impact) - 1)], 0)
            met = sum(np.bincount(d, ahead[n], self.docs) for d, n in read)
            slack = ahead.sum() - met
            kth = np.partition(lower, -k)[-k] if self.docs >= k else 0
            stay = (lower + slack >= max(kth, 1)) if alive is None else alive & (lower + slack >= max(kth, 1))
            if ahead.sum() < kth:  # no document that was not met can reach the threshold
                alive = stay
            if not ahead.any() or (alive is not None and not slack[alive].any()):
                break
        sure = np.flatnonzero(lower > 0)
        if len(sure) > k:
            sure = sure[lower[sure] >= np.partition(lower[sure], -k)[-k]]
        return sure, lower[sure].astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, total: tuple[int, int]) -> Iterator[tuple[np.ndarray, Shard]]:
    """(rows of doc_ids, shard) of bounded size over a task's forward rows."""
    documents, length = total

    def made(rows: list[tuple]) -> tuple[list, Shard]:
        ids, n, terms, tf = zip(*rows)
        norm = 50 + (50 * np.array(n, dtype=np.int64) * documents) // length
        counts = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms)) // 4
        flat = [np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (terms, tf)]
        return list(ids), Shard(len(weights), weights, norm, counts, *flat)

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if rows and (len(rows) >= SHARD_DOCS or size + len(row[2]) // 4 > SHARD_POSTINGS):
                yield made(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2]) // 4
    if rows:
        yield made(rows)


def top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties by doc_id."""
    if k < 1:
        raise ValueError("k is 1 at least")
    spark, out, total = docs.sparkSession, None, None
    for block in item_blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)
        forward = landed(forward_table(id_and_text(docs, id_col, text_col), shared), "forward")
        if total is None:
            total = tuple(int(x or 0) for x in forward.agg(F.count("*"), F.sum("n")).first())
        df = holders(forward, len(block.terms))
        weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        shared_weights = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, weights=shared_weights, total=total) -> Iterator[pa.RecordBatch]:
            of_item = [t[weights.value[t] > 0] for t in shared.value.of_item]
            for ids, shard in shards(batches, weights.value, total):
                for item, terms in enumerate(of_item):
                    best = [(ids[i], s) for i, s in zip(*(x.tolist() for x in shard.best(terms, k)))]
                    best = sorted(best, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]  # of ties with the last, the first doc_ids
                    if best:
                        columns = [pa.array([item] * len(best), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*best))]
                        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

        found = forward.mapInArrow(run, "item long, doc_id long, score long")
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
        best = top(top(salted, ["item", "salt"], k).drop("rank"), ["item"], k)
        ids = F.array(*(F.lit(i).cast("long") for i in block.ids)) if len(block.ids) <= 1000 else None
        if ids is not None:
            named = best.withColumn("item_id", F.get(ids, F.col("item").cast("int")))
        else:
            names = spark.createDataFrame([(n, i) for n, i in enumerate(block.ids)], "item long, item_id long")
            named = best.join(names, "item")
        part = named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle(k: int = 50) -> str:
    """The same over ``documents`` and ``benchmark`` as DuckDB SQL: every document is scored for every item."""
    parts = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{parts}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ts FROM documents),
    own AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
    stats AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM own),
    tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM own) GROUP BY r, t),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, stats GROUP BY t),
    norm AS (SELECT r, doc_id, 50 + (50 * n * all_docs) // all_terms AS m FROM own, stats),
    i AS (SELECT DISTINCT q, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS q, item_id, {found} AS ts FROM benchmark)),
    scores AS (
      SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN w USING (t) JOIN tf USING (t) JOIN norm USING (r) GROUP BY q, r
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}
    """
