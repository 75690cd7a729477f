"""Ranked search against scoring every document for every item, in plain Python and in DuckDB."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from callsight.llm import lexical, wordhash
from callsight.llm.queries import op12_ranked_search
from tests.llm.cases import LOWER, SMALL, TEXTS, no_docs, odd_docs

PART = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def terms(text):
    return PART.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, len(t), Counter(t)) for i, t in own if t]
    n, total = len(own), sum(x[1] for x in own)
    df = Counter(t for _, _, c in own for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, size, counts in own:
            m = 50 + 50 * size * n // total
            score = 0
            for t in set(terms(text)) & set(counts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return rows


def ranked(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], str(r[2])))


def random_table(seed, n, words=60):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 80)) if x < words)) for i in rng.integers(0, n, n)]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_odd_rows(spark, k):
    items = [(1, "one long passage"), (2, None), (3, ""), (None, "word x don't 中文"), (4, "w1 w2 W3 w1"), (4, "two"), (5, "absent words only!"), (6, " ".join(f"w{i}" for i in range(3000)))]
    got = lexical.search(odd_docs(spark), spark.createDataFrame(items, ITEMS), k)
    assert ranked(got.collect()) == ranked(brute(TEXTS, items, k))


@pytest.mark.parametrize("shard", [1, 7, 1 << 15])
def test_shards_and_query_blocks(spark, monkeypatch, shard):
    docs, items = random_table(1, 300), [(i, t) for i, t in enumerate(t for _, t in random_table(2, 25, 90))]
    monkeypatch.setattr(lexical, "QUERY_BYTES", 2000)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = ranked(brute(docs, items, 4))
    assert ranked(lexical.search(frame, spark.createDataFrame(items, ITEMS), 4).collect()) == expected
    # The same through shards of a few documents, in this process.
    block = lexical.Items([(i, t) for i, t in items])
    rows = [x for x in block.counts([t.encode() for _, t in docs])]
    keep = [(i, r) for (i, _), r in zip(docs, rows) if r[0]]
    total = (len(keep), sum(r[0] for _, r in keep))
    df = np.zeros(len(block.terms), dtype=np.int64)
    for _, (_, t, _) in keep:
        df[t] += 1
    w = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * int(x) + 1))) for x in df])
    all_scores = {}
    for a in range(0, len(keep), shard):
        some = keep[a : a + shard]
        norm = np.array([50 + 50 * r[0] * total[0] // total[1] for _, r in some])
        own = lexical.Shard(len(w), w, norm, np.array([len(r[1]) for _, r in some]), np.concatenate([r[1] for _, r in some]), np.concatenate([r[2] for _, r in some]))
        for item, chosen in enumerate(block.of_item):
            at, score = own.best(chosen[w[chosen] > 0], 4)
            all_scores.setdefault(block.ids[item], []).extend((-int(s), some[i][0]) for i, s in zip(at.tolist(), score))
    got = [(item, r + 1, doc, -s) for item, x in all_scores.items() for r, (s, doc) in enumerate(sorted(x)[:4])]
    assert ranked(got) == expected


def test_all_that_tie_with_the_last():
    n = 2000
    terms_, tf = np.tile([0, 1], n), np.tile([1, 1], n)
    tf[: 2 * 5] = 50
    shard = lexical.Shard(2, np.array([1000, 900]), np.full(n, 100), np.full(n, 2), terms_, tf)
    at, score = shard.best(np.array([0, 1]), 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and len(set(score.tolist())) == 1


def test_ties_go_to_the_first_ids(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(1, "words")], ITEMS), 50)
    expected = brute(docs, [(1, "words")], 50)
    assert ranked(got.collect()) == expected


def test_a_text_over_a_block(spark):
    docs = [(1, "needle " + "hay " * 400_000), (2, "needle"), (3, "hay")]
    assert len(docs[0][1]) > wordhash.BLOCK
    items = [(1, "Needle in the hay")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    assert ranked(got.collect()) == ranked(brute(docs, items, 50))


def test_no_rows(spark):
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert lexical.search(no_docs(spark), items).count() == 0
    assert lexical.search(odd_docs(spark), items.limit(0)).count() == 0


def test_registered_form(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    assert ranked(op12_ranked_search(spark, SMALL).collect()) == ranked(con.execute(lexical.oracle(k=50)).fetchall())
