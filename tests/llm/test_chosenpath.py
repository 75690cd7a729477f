"""Chosen-path groups against a comparison of all pairs of whole sets."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from callsight.llm import chosenpath, wordhash
from callsight.llm.queries import ORACLE, op11_chosen_path
from tests.llm import cases
from tests.llm.cases import LOWER, SMALL, no_docs, odd_docs, rows_of, small_docs, words


def shingles(text, size):
    own = words((text or "").translate(LOWER))
    return frozenset(tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))) if own else frozenset()


def brute(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and find(i) != find(j) and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [x for x in names[find(i)] if x is not None]
        name = min(known, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), name, doc == name))
    return cases.multiset(out)


def cluster(seed, copies, length, changes, start=0):
    """One text and copies of it with up to so many words replaced."""
    rng = random.Random(seed)
    base = [f"b{seed}x{rng.randrange(400)}" for _ in range(length)]
    rows = []
    for i in range(copies):
        own = list(base)
        for k in rng.sample(range(length), rng.randrange(changes + 1)):
            own[k] = f"new{rng.randrange(10**9)}"
        rows.append((start + i, " ".join(own)))
    return rows


def test_odd_rows(spark):
    got = chosenpath.near_duplicates(odd_docs(spark))
    assert cases.multiset(got.collect()) == brute(cases.TEXTS)


@pytest.mark.parametrize("limit", [20, 2048])
def test_clusters_beyond_a_node(spark, monkeypatch, limit):
    """Clusters larger than a node may be compare whole, dense and loose, so that groups are brought up to date and nodes branch."""
    monkeypatch.setattr(chosenpath, "LIMIT", limit)
    rows = cluster(1, 70, 120, 4) + cluster(2, 45, 120, 14, 1000) + cluster(3, 12, 30, 2, 2000) + [(3000 + i, f"alone {i} in this table {i * 7}") for i in range(40)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cases.multiset(chosenpath.near_duplicates(docs).collect()) == brute(rows)


@pytest.mark.parametrize("size,percent", [(1, 50), (2, 90), (5, 100)])
def test_other_limits(spark, size, percent):
    rows = cluster(5, 40, 40, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cases.multiset(chosenpath.near_duplicates(docs, size, percent).collect()) == brute(rows, size, percent)


def test_levels_keep_common_paths(spark):
    """The share of pairs at the threshold with a common node after each level is the one stated at TREES."""
    rng, rows = random.Random(7), []
    for i in range(600):  # a similarity of 0.8: 80 words of 100 in common
        common = [rng.getrandbits(64) for _ in range(80)]
        rows += [(2 * i + k, " ".join(f"w{x}" for x in common + [rng.getrandbits(64) for _ in range(10)])) for k in (0, 1)]
    sketches = chosenpath.sketch_rows(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    nodes = sketches.selectExpr("*", "doc_id div 2 AS comp", "xxhash64(7, substring(tokens, 1, 4)) AS node").cache()
    for share in (0.80, 0.67, 0.58, 0.51, 0.46):
        met = nodes.groupBy("comp", "node").agg(F.countDistinct("cls").alias("n")).filter("n = 2").select("comp").distinct().count() / 600
        assert abs(met - share) < 0.07
        nodes = chosenpath.children(nodes.withColumn("size", F.lit(1))).cache()


def test_a_text_over_a_block(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(200_000))
    assert len(long) > wordhash.BLOCK
    rows = [(1, long), (2, "short " + long), (3, long[: len(long) // 2]), (4, "other")]
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert cases.multiset(got.collect()) == brute(rows)


def test_no_rows(spark):
    assert chosenpath.near_duplicates(no_docs(spark)).count() == 0


def test_registered_form(spark):
    got = cases.multiset(op11_chosen_path(spark, SMALL).collect())
    assert got == brute(rows_of(small_docs(spark)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == cases.multiset(con.execute(ORACLE["op11_chosen_path"]).fetchall())
