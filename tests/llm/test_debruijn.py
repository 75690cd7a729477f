import random

import pytest

from callsight.llm import debruijn
from callsight.llm.debruijn import dedup_substrings, repeated_spans

from .cases import multiset, no_docs, odd_docs, rows_of, small_docs, words


def removed(rows, k=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - k + 1):
            if doc is not None:
                first[tuple(w[i : i + k])] = min(doc, first.get(tuple(w[i : i + k]), doc))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - k + 1) if doc is not None and first[tuple(w[i : i + k])] < doc for j in range(i, i + k)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_small_table(spark):
    docs = small_docs(spark)
    want = removed(rows_of(docs))
    assert multiset(dedup_substrings(docs).collect()) == multiset(want) and sum(r[2] for r in want) > 0


def mixed(rng, docs):
    """Texts over few words, with shared passages, edited copies and one passage that most texts hold."""
    vocabulary = [f"v{i}" for i in range(8)]
    hot = rng.choices([f"h{i}" for i in range(50)], k=20)
    rows = []
    for d in range(docs):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.7:
            at = rng.randint(0, len(w))
            w[at:at] = hot[rng.randint(0, 5) :]
        if rows and rng.random() < 0.4:
            w += rng.choice(rows)[1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "edit"
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,m", [(13, 5), (5, 2), (4, 4), (3, 1)])
@pytest.mark.parametrize("crowd", [0, 8])
def test_branching_texts(spark, monkeypatch, k, m, crowd):
    monkeypatch.setattr(debruijn, "CROWD", crowd)  # tasks of a local session are forked or read the default; either is exact
    rows = mixed(random.Random(k * 10 + m), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert multiset(dedup_substrings(docs, k, m).collect()) == multiset(removed(rows, k))


@pytest.mark.parametrize("crowd", [0, 1, 8])
def test_blocks_settle_what_parts_would(monkeypatch, crowd):
    """A block's own view, joined with the others', settles the same places as one view of all paths."""
    import numpy as np

    monkeypatch.setattr(debruijn, "CROWD", crowd)
    rows = mixed(random.Random(1), 120)
    paths, sent = [], []
    for part in (rows[:40], rows[40:80], rows[80:]):
        ids = np.array([d for d, _ in part])
        p = debruijn.paths_of(ids, np.zeros(len(ids), dtype=np.int64), [t.encode() for _, t in part], 5, 2)
        paths.append(p)
        sent += list(debruijn.sent(p, 3))
    places = {"repeat": set(), "branch": set()}
    import pyarrow as pa

    for i in range(3):
        table = pa.Table.from_batches(sent).filter(pa.compute.equal(pa.Table.from_batches(sent)["part"], i))
        for r in debruijn.settle(table).to_pylist():
            places["repeat" if r["kind"] == debruijn.REPEAT else "branch"].add((r["doc_id"], r["start"], r["edges"]))
    whole = debruijn.match(debruijn.Paths.joined(paths), in_block=False)[0]
    repeat = {(int(r["doc"]), int(r["start"]), int(r["edges"])) for r in whole if r["kind"] == debruijn.REPEAT}
    branch = {(int(r["doc"]), int(r["start"]), int(r["edges"])) for r in whole if r["kind"] == debruijn.BRANCH}
    assert places["repeat"] <= repeat and branch <= places["branch"]
    assert repeat - places["repeat"] <= places["branch"]  # a marked anchor's paths are matched edge by edge instead


def test_spans_have_verified_sources(spark):
    rows = mixed(random.Random(5), 120)
    spans = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2).collect()
    texts, covered = {d: words(t) for d, t in rows}, {}
    for s in spans:
        assert s.source_doc < s.doc_id
        assert texts[s.doc_id][s.start : s.start + s.words] == texts[s.source_doc][s.source_start : s.source_start + s.words]
        covered.setdefault(s.doc_id, set()).update(range(s.start, s.start + s.words))
    assert {d: n for d, _, n, _ in removed(rows, 5) if n} == {d: len(c) for d, c in covered.items()}


def test_defined_cases(spark):
    docs = odd_docs(spark)
    assert multiset(dedup_substrings(docs).collect()) == multiset(removed(rows_of(docs)))
    assert dedup_substrings(no_docs(spark)).count() == 0


def test_equal_hashes_of_other_words_remove_nothing(spark, monkeypatch):
    """Where places count as equal whose words differ, the words at both coordinates decide."""
    rows = [(1, " ".join(f"a{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(30))), (3, " ".join(f"a{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    graph = debruijn.Graph(docs, 13, 5)
    fake = spark.createDataFrame([(2, 0, 0, 18, 1, 0, 1), (3, 0, 0, 18, 1, 0, 1)], debruijn.PLACES)
    monkeypatch.setattr(graph, "repeats", lambda: fake)
    assert multiset(graph.kept().collect()) == multiset(removed(rows))


def test_a_text_over_a_block(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i % 70_000}" for i in range(250_000))
    rows = [(1, f"own {passage}"), (2, f"{long} {passage} end"), (3, " ".join(long.split()[100_000:100_080])), (4, None)]
    assert len(rows[1][1]) > 1 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(dedup_substrings(docs).collect()) == multiset(removed(rows))
