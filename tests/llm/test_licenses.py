import math
import re

from callsight.llm.licenses import PHRASES, TEMPLATES, license_scan

from .cases import LOWER, multiset, no_docs, odd_docs, rows_of, small_docs

PART = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return PART.findall((text or "").translate(LOWER))


def expected(rows, threshold, templates=TEMPLATES):
    out = []
    for doc, text in rows:
        w, hits, blocks = plain(text), [], []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        for number, line in enumerate((text or "").split("\n")):
            for label, template in templates:
                t = set(plain(template))
                overlap = len(t & set(plain(line)))
                if overlap >= math.ceil(threshold * len(t) - 1e-9):
                    blocks.append((number, label, overlap / len(t)))
        base = {label for _, label in hits}
        starts = [i for i, _ in hits]
        out.append((
            doc, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {b[1] for b in blocks})), max((b[2] for b in blocks), default=0.0), tuple(sorted(blocks)),
        ))
    return out


def got(docs, *args):
    rows = license_scan(docs, *args).collect()
    return multiset((*r[:8], tuple(sorted((b.line, b.label, b.containment) for b in r.blocks))) for r in rows)


def test_small_table(spark):
    docs = small_docs(spark)
    want = expected(rows_of(docs), 0.9)
    assert got(docs) == multiset(want) and any(r[8] for r in want)


def test_every_block_at_lower_thresholds(spark):
    texts = [
        "This Work is LICENSED, under a creative-commons attribution noncommercial license!\nReleased under MIT",
        "all\nrights reserved and all rights\nreserved; cc\nby cc by",
        "permission is hereby granted free of charge to any person obtaining this software\n" * 3,
        "license public general\ngnu general public license version under work this is the",
        "the of is in under this work a to",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.3, 0.6, 0.8, 1.0):
        assert got(docs, threshold) == multiset(expected(rows_of(docs), threshold)), threshold


def test_defined_cases(spark):
    docs = odd_docs(spark)
    assert got(docs, 0.5) == multiset(expected(rows_of(docs), 0.5))
    assert license_scan(no_docs(spark)).count() == 0


def windowed(text, threshold):
    """(label, containment) of every window of words that holds enough of a template, by trying all windows."""
    w, out = plain(text), set()
    for label, template in TEMPLATES:
        words = plain(template)
        t = set(words)
        span = math.floor(len(words) / threshold + 1e-9)
        best = max((len(t & set(w[i : i + span])) for i in range(len(w))), default=0)
        if best >= math.ceil(threshold * len(t) - 1e-9):
            out.add((label, best / len(t)))
    return ",".join(sorted({label for label, _ in out})), max((share for _, share in out), default=0.0)


def test_wrapped_notices_and_scattered_words(spark, tmp_path):
    import textwrap

    from callsight.llm import queries

    texts = ["\n".join(f"# {x}" for x in textwrap.wrap(f"Copyright of some of us. {template} and so on.", 40)) for _, template in TEMPLATES]
    far = "all of it " + "word " * 50 + "rights " + "word " * 50 + "reserved; released under the sun, " + "word " * 50 + "MIT has a license"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, far, None, ""])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, str(tmp_path)).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, (label, _) in enumerate(TEMPLATES))
    assert all(got[len(TEMPLATES) + k].labels == "" and got[len(TEMPLATES) + k].score == 0 for k in range(3))
    lines = {r.doc_id: [b.line for b in r.blocks] for r in license_scan(docs, wrapped=True).collect()}
    assert all(lines[i] and max(lines[i]) <= 1 for i in range(len(TEMPLATES)))


def test_every_window_that_holds_enough(spark):
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            notice = plain(rng.choice(TEMPLATES)[1])
            words += [w for w in notice if rng.random() > 0.08] if rng.random() < 0.5 else rng.sample(notice, len(notice))
            words += rng.choices(["the", "of", "license", "other", "rights"], k=rng.randint(0, 12))
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words) + 1), "between")
        texts.append("".join(w + rng.choice([" ", " ", "\n", ", "]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8, 0.9, 1.0):
        found = {r.doc_id: r for r in license_scan(docs, threshold, wrapped=True).collect()}
        for i, text in enumerate(texts):
            labels, score = windowed(text, threshold)
            assert (",".join(sorted({b.label for b in found[i].blocks})), found[i].score) == (labels, score), (threshold, text)


def test_a_text_over_a_block_and_odd_rows_in_windows(spark):
    notice = "Released under\nthe MIT License"
    long = "plain words of a line\n" * 60_000 + notice + "\nend" * 1000
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, "before"), (2, long), (3, notice)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan(docs, wrapped=True).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "", 2: "mit", 3: "mit"} and found[2].n_words == len(plain(long))
    odd = odd_docs(spark)
    rows = license_scan(odd, wrapped=True).collect()
    assert multiset((r.doc_id, r.n_words) for r in rows) == multiset((i, len(plain(t))) for i, t in rows_of(odd))
    assert license_scan(no_docs(spark), wrapped=True).count() == 0
