import random

import numpy as np

from callsight.llm import decontam
from callsight.llm.decontam import banded_distance, clean, contaminated, normal

from .cases import SMALL, multiset, no_docs, odd_docs, small_docs


def best_match(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdefgh ")]
    return "".join(out)


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(300):
        m, most = rng.randint(16, 40), rng.randint(0, 4)
        pattern = "".join(rng.choices("abc ", k=m)).encode()
        inner = edited(rng, pattern.decode(), rng.randint(0, 6)).encode()
        region = bytes(rng.choices(b"abc ", k=rng.randint(0, 5))) + inner + bytes(rng.choices(b"abc ", k=rng.randint(0, 5)))
        if len(region) < m - most:
            continue
        edits, end = banded_distance(np.frombuffer(pattern, np.uint8), np.frombuffer(region, np.uint8), most)
        real = best_match(pattern, region)
        assert edits == real if real <= most else edits > most
        if real <= most:
            assert best_match(pattern, region[max(0, end - m - most) : end]) == real


def brute(docs, items, span, rate, shortest):
    found = set()
    for doc, text in docs:
        text = normal(text)
        for name, item in items:
            item = normal(item)
            if len(item) < max(shortest, 16):  # word for word
                if item and b" " + item + b" " in b" " + text + b" ":
                    found.add((doc, name))
                continue
            last = max(0, len(item) - span)
            for a in sorted({*range(0, last + 1, span // 2), last}):
                pattern = item[a : a + span]
                most = min(int(len(pattern) * rate), (len(pattern) - 8) // 8)
                if best_match(pattern, text) <= most:
                    found.add((doc, name))
    return found


def test_every_match_within_the_budget(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeinorst", k=rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(rng.randint(5, 30))) for i in range(12)] + [(90, None), (91, "short"), (3, prose(12))]
    docs = []
    for d in range(70):
        text = prose(rng.randint(0, 40))
        if d % 2:
            item = rng.choice(items[:12])[1]
            cut = rng.randint(0, len(item) // 3) if d % 3 else 0
            passage = edited(rng, item[cut:], rng.randint(0, 7))
            text = f"{text}\n{passage.upper()}  {prose(rng.randint(0, 20))}"
        docs.append((d, text))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for span, rate in ((60, 0.08), (60, 0.0), (40, 0.1)):
        want = brute(docs, items, span, rate, 30)
        got = contaminated(a, b, span, rate, 30).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 5
        kept = {r.doc_id for r in clean(a, b, span=span, rate=rate, shortest=30).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_short_items_word_for_word(spark):
    items = [(1, "Two words"), (2, "two"), (3, " words  and "), (4, ""), (5, None), (6, "é"), (7, "two words"), (8, "a benchmark item of more than forty bytes stands here")]
    docs = [(1, "two words and more"), (2, "TWO\nwords"), (3, "twofold words andante"), (4, "and é"), (5, "éa"), (6, None), (7, "x two two words"), (8, f"so {items[7][1]} too")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 64, 0.1, 40)
    assert {(r.doc_id, r.item_id) for r in contaminated(a, b).collect()} == want and (3, 2) not in want and (8, 8) in want and (1, 3) in want
    found = {(r.doc_id, r.item_id): (r.start, r.end, r.edits, r.coverage) for r in contaminated(a, b).collect()}
    assert found[1, 1] == (0, 9, 0, 1.0) and found[7, 7] == (6, 15, 0, 1.0)
    assert {r.doc_id for r in clean(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert {(r.doc_id, r.item_id) for r in contaminated(a, b.filter("item_id < 8")).collect()} == {x for x in want if x[1] < 8}


def test_common_grams_are_counted_in_ranges_of_patterns(spark, monkeypatch):
    """Items that share a phrase, in a text that repeats it: the same regions, however few places are counted at once."""
    rng = random.Random(17)
    phrase = "the one phrase that all of them share"
    items = [(i, f"{phrase} {rng.random()} {phrase}") for i in range(30)]
    texts = [normal(f"{phrase} " * 40 + items[3][1] + f" {phrase}" * 20), normal(items[7][1]), normal(phrase)]
    patterns = decontam.Patterns([(i, normal(t)) for i, t in items], 64, 0.1, 40)
    whole = sorted(patterns.search(texts))
    monkeypatch.setattr(decontam, "COUNTED", 100)
    assert sorted(patterns.search(texts)) == whole and {w[1] for w in whole} >= {3, 7}


def test_a_text_over_a_block(spark):
    item = "a benchmark item of more than forty bytes stands here"
    docs = [(1, "word " * 300_000 + item + " more" * 100_000), (2, item), (3, "word " * 10)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.start) for r in contaminated(a, b).collect()} == {(1, 1_500_000), (2, 0)}


def test_small_table_in_query_blocks(spark, monkeypatch):
    docs, bench = small_docs(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = contaminated(docs, bench).collect()
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if normal(b.text) in normal(d.text)}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in whole}
    monkeypatch.setattr(decontam, "QUERY_BYTES", 4000)
    assert multiset(contaminated(docs, bench).collect()) == multiset(whole)


def test_defined_cases(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "more than thirteen words that stand in several of these small texts", 0), (None, None, 0)], "item_id long, text string, start int")
    got = contaminated(docs, bench).collect()
    holds = [(r.doc_id, r.text) for r in docs.collect() if r.text and "thirteen words" in r.text]
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, _ in holds)
    left = clean(docs, bench)
    assert left.schema == docs.schema and left.count() == docs.count() - len(holds)
    assert contaminated(no_docs(spark), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0 and clean(docs, bench.limit(0)).count() == docs.count()


def test_six_edits_in_64_bytes(spark):
    rng = random.Random(4)
    items = [(i, "".join(rng.choices("abcdefghijklmnop", k=64))) for i in range(20)]
    docs = []
    for i, item in items:  # every tenth byte replaced: six edits, and the q-grams of 9 bytes in between are left
        broken = "".join("z" if at % 10 == 9 else c for at, c in enumerate(item))
        docs += [(i, f"before {broken} after"), (100 + i, f"before z{broken[1:]} after")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert multiset((r.doc_id, r.item_id, r.edits) for r in contaminated(a, b).collect()) == multiset((i, i, 6) for i, _ in items)
    assert {r.doc_id for r in clean(a, b).collect()} == {100 + i for i, _ in items}


def test_alignments_at_once():
    rng = random.Random(6)
    patterns, texts = [], []
    for _ in range(400):
        pattern = "".join(rng.choices("abc ", k=rng.choice([16, 40, 63, 64])))
        patterns.append(np.frombuffer(pattern.encode(), np.uint8))
        texts.append(("".join(rng.choices("abc ", k=rng.randint(0, 9))) + edited(rng, pattern, rng.randint(0, 8)) + "".join(rng.choices("abc ", k=rng.randint(0, 9)))).encode())
    begins = np.cumsum([0, *(len(t) for t in texts)])
    edits, end = decontam.aligned(patterns, np.frombuffer(b"".join(texts), np.uint8), begins[:-1], begins[1:])
    for k, (pattern, text) in enumerate(zip(patterns, texts)):
        assert edits[k] == best_match(pattern, text) == best_match(pattern, text[: end[k]])
        assert not end[k] or best_match(pattern, text[: end[k] - 1]) > edits[k]


def test_patterns_longer_than_a_machine_word(spark):
    rng = random.Random(13)
    items = [(i, "".join(rng.choices("abcdefgh ", k=150))) for i in range(6)]
    docs = [(d, f"begin {edited(rng, items[d % 6][1][10:140], d % 14)} end") for d in range(40)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 80, 0.1, 40)
    assert {(r.doc_id, r.item_id) for r in contaminated(a, b, span=80).collect()} == want and len(want) > 5
