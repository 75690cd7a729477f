"""Runs against a brute force over every period, and Lyndon arrays against the definition."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callsight.llm import periods, wordhash
from callsight.llm.queries import op13_periodic_runs
from tests.llm import cases
from tests.llm.cases import SMALL, no_docs, odd_docs, rows_of, small_docs, words

letters = st.integers(0, 3)


def brute_runs(s, exponent=4, shortest=6):
    """(start, length, period) of each maximal stretch whose smallest period repeats often enough."""
    found = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if n >= max(shortest, exponent * q) and not any(s[i : i + n - p] == s[i + p : i + n] for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i) + 1 if s[i] == s[i + q] else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    own = words(text)
    n = len(own)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and n and h % 10 == 0:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(own)
    gone = {i for a, k, q in runs for i in range(a + q, a + k)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{k},{q}\n" for a, k, q in runs)
    left = " ".join(w for i, w in enumerate(own) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=16))
def test_lyndon_array(s):
    order = sorted(set(s))
    ranks = [order.index(x) for x in s]
    is_lyndon = lambda u: all(u < u[k:] for k in range(1, len(u)))
    expected = [max(k for k in range(1, len(s) - i + 1) if is_lyndon(s[i : i + k])) for i in range(len(s))]
    assert periods.lyndon_lengths(ranks + [0], [False] * len(s) + [True])[: len(s)] == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(letters, min_size=1, max_size=5), st.integers(1, 8), st.integers(0, 2)), max_size=5), min_size=1, max_size=4))
def test_runs_of_several_texts(built):
    texts = [[x for u, times, less in parts for x in (u * times)[less:]] for parts in built]
    flat = np.array([x for t in texts for x in t], dtype=np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    expected, first = [], 0
    for t in texts:
        expected += [(a + first, n, q) for a, n, q in brute_runs(t)]
        first += len(t)
    assert [tuple(r) for r in periods.runs_of(flat, of).tolist()] == expected


@pytest.mark.parametrize("exponent,shortest", [(2, 2), (3, 5), (5, 12)])
def test_other_limits(exponent, shortest):
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(0, 2, rng.integers(0, 40)).astype(np.uint64)
        got = [tuple(r) for r in periods.runs_of(s, np.zeros(len(s), dtype=np.int64), exponent, shortest).tolist()]
        assert got == brute_runs(s.tolist(), exponent, shortest)


def test_overlapping_words_that_fool_power_sums():
    """Thue-Morse words have no cube, Fibonacci words no fourth power: comparing hashes of sums would find some."""
    s = [0]
    while len(s) < 4096:
        s += [1 - x for x in s]
    assert len(periods.runs_of(np.array(s, dtype=np.uint64), np.zeros(len(s), dtype=np.int64))) == 0


def test_odd_rows(spark):
    got = periods.periodic_runs(odd_docs(spark), order=periods.planted, details=False).collect()
    assert cases.multiset(got) == cases.multiset(brute_row(i, t) for i, t in cases.TEXTS)


def test_details(spark):
    docs = spark.createDataFrame([(1, "x a b  a b\ta b a b y"), (2, None), (None, "z z z z z z")], "doc_id long, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert got[1].collapsed == "x a b y" and got[1].n_dropped == 6 and got[1].runs[0].asDict() == {"start": 1, "length": 8, "period": 2}
    assert got[2].collapsed == "" and got[2].runs == [] and got[2].n_words == 0
    assert got[None].collapsed == "z" and got[None].exponent_milli == 6000


def test_a_text_over_a_block(spark):
    text = "a b c " * 200_000 + " ".join(f"w{i}" for i in range(50_000)) + " end" * 7
    assert len(text) > wordhash.BLOCK
    docs = spark.createDataFrame([(5, "before"), (6, text), (7, "after")], "doc_id long, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[6].runs] == [(0, 600_000, 3), (650_000, 7, 1)]
    assert got[6].n_dropped == 600_000 - 3 + 6 and got[5].n_runs == got[7].n_runs == 0


def test_no_rows(spark):
    assert periods.periodic_runs(no_docs(spark)).count() == 0


def test_registered_form(spark):
    got = op13_periodic_runs(spark, SMALL).collect()
    assert cases.multiset(got) == cases.multiset(brute_row(i, t) for i, t in rows_of(small_docs(spark)))
