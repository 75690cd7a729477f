import random
import re
import struct

import xxhash

from callsight.llm.lines import dedup_lines

from .cases import LINES, multiset, no_docs, odd_docs, small_docs


def of_text(text):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), seed=42)))[0]


def expected(rows, min_lines=3, min_words=50):
    """What should go, said without fingerprints: (doc_id, text, n_lines, n_deleted) per row.

    A window of ``min_lines`` lines, or of one or two with ``min_words`` words, goes where the same lines stood earlier.
    """
    first, own = {}, {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        plain = [" ".join(re.split("[ \t\x0b\f\r]+", line)).strip(" ") for line in text.split("\n")]
        lines = [(i, p, len(p.split(" "))) for i, p in enumerate(plain) if p]
        windows = {(i, n) for n in (1, 2, min_lines) for i in range(len(lines) - n + 1) if n == min_lines or sum(x[2] for x in lines[i : i + n]) >= min_words}
        own[doc, text] = lines, windows
        for i, n in windows:
            key = tuple(x[1] for x in lines[i : i + n])
            spot = doc, i, of_text(text)
            first[key] = min(first.get(key, spot), spot)
    out = []
    for doc, text in rows:
        all_, gone = text.split("\n") if text is not None else [], set()
        if doc is not None and text is not None:
            lines, windows = own[doc, text]
            for i, n in windows:
                if first[tuple(x[1] for x in lines[i : i + n])] < (doc, i, of_text(text)):
                    gone.update(range(lines[i][0], lines[i + n - 1][0] + 1))
        left = "\n".join(x for i, x in enumerate(all_) if i not in gone) if text is not None else None
        out.append((doc, left, len(all_), len(gone)))
    return out


def got(docs, **options):
    return multiset(dedup_lines(docs, counts=True, **options).select("doc_id", "text", "n_lines", "n_deleted").collect())


def test_small_table(spark):
    docs = small_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    assert got(docs) == multiset(want) and sum(r[3] for r in want) > 0


def test_random_lines(spark):
    rng = random.Random(11)
    passage = "\n".join(" ".join(rng.choices("abcdefgh", k=4)) for _ in range(6))
    rows = []
    for doc in range(60):
        lines = [" ".join(rng.choices(["x", "y", "z", "long"], k=rng.choice([0, 1, 2, 3, 60]))) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append((doc // 2 if doc < 10 else doc, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"min_lines": 2}, {"min_words": 5}, {"min_lines": 2, "min_words": 5}):
        assert got(docs, **options) == multiset(expected(rows, **options)), options


def test_runs_of_the_guaranteed_length_go(spark):
    rows = [(i, f"own {i}\nown too {i}\n{LINES}\nlast {i}") for i in range(5)]
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == rows[0][1] and all(kept[i] == f"own {i}\nown too {i}\nlast {i}" for i in range(1, 5))


def test_defined_cases(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == multiset(expected(rows))
    plain = dedup_lines(docs)
    assert plain.columns == docs.columns and plain.schema == docs.schema
    assert dedup_lines(no_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(small_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_every_run_that_stood_earlier(spark):
    rng = random.Random(5)
    rows = [(1, "x1\nx2\nedited"), (2, "x1\nx2\nx3"), (3, "above\nx1\nx2\nx3\nbelow")]
    for trial in range(300):  # three copies of a run, the first one edited in its first or last line
        run = [f"{rng.random()}" for _ in range(rng.randint(3, 6))]
        broken = run[:]
        broken[rng.choice([0, -1])] = f"edit {rng.random()}"
        for k, lines in enumerate((broken, run, run)):
            rows.append((10 + 3 * trial + k, "\n".join([f"{rng.random()}", *lines, f"{rng.random()}"])))
    rows += [(5000 + d, "\n".join(rng.choices(["a", "b", "c", "d", "e", "", " "], k=rng.randint(0, 14)))) for d in range(200)]
    want = expected(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == multiset(want) and sum(r[3] for r in want) > 1000


def test_matches_of_different_sources_are_not_one_run(spark):
    rows = []
    for i in range(100):
        a, b, c, d = (f"{x} {i}" for x in "abcd")
        rows += [(3 * i, f"{a}\n{b}"), (3 * i + 1, f"{c}\n{d}"), (3 * i + 2, f"{a}\n{b}\n{c}\n{d}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_deleted == 0 for r in dedup_lines(docs, counts=True).collect())


def test_blank_lines_between_matches_stay(spark):
    rows = [(1, "a\nb\nc"), (2, "d\ne\nf"), (3, "a\n\nb\nc\n\nd\ne\n \nf\nown")]
    kept = {r.doc_id: (r.text, r.n_deleted) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert kept[3] == ("\nown", 8)


def test_a_text_over_a_megabyte(spark):
    lines = [f"line number {i} of a long text" for i in range(50_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own", *lines[100:40_000], "end"])), (3, "\n".join(reversed(lines)))]
    assert len(rows[0][1]) > 1 << 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == multiset(expected(rows))


def test_registered_queries_delete_whole_runs(spark, tmp_path):
    import corpus_pipeline
    from callsight.llm import queries

    texts = []
    for trial in range(20):
        a, b, c = (f"{trial} {x}" for x in ("alpha", "beta", "gamma"))
        texts += [f"{a}\n{b}\nedited {trial}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}\nown {trial}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.n_deleted for r in queries.op6_line_winnowing(spark, str(tmp_path)).collect()}
    assert found == {i: 3 * (i % 3 == 2) for i in range(60)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert all(kept[i] == (f"own {i // 3}" if i % 3 == 2 else t) for i, t in enumerate(texts))
