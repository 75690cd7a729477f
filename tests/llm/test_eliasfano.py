import tempfile
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from callsight.llm import eliasfano as E
from callsight.llm.queries import tokenizer
from callsight.llm.tokens import Encoder

from .cases import multiset, no_docs, odd_docs, rows_of, small_docs

BPE = tokenizer("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=300), st.sampled_from([1, 7, 1000]))
def test_round_trip_and_select(steps, scale):
    values = np.cumsum([s // scale for s in steps], dtype=np.int64)
    e = E.EliasFano.encode(values)
    again = E.EliasFano(e.n, e.low_bits, e.low.tobytes(), e.high.tobytes(), e.samples.tobytes())
    assert again.values().tolist() == values.tolist()
    assert [again.select(i) for i in range(len(values))] == values.tolist()
    for a, b in ((0, len(values)), (len(values) // 3, len(values)), (len(values) // 2, len(values) // 2), (len(values) // 5, len(values) // 2), (min(63, len(values)), min(130, len(values)))):
        assert again.select_range(a, b).tolist() == values[a:b].tolist()


def test_near_minimal_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert E.EliasFano.encode(values).size() * 8 < 50_000 * (2.6 + np.log2(values[-1] / 50_000))


def written_and_read(spark, docs, **options):
    path = tempfile.mkdtemp() + "/ids"
    E.write_token_files(docs, path, BPE, **options)
    return E.read_token_files(spark, path)


def expected(docs):
    encoder, out, at = Encoder.of(BPE), [], 0
    rows = [(doc, encoder.direct(text or "") + b"\x01\0\0\0") for doc, text in rows_of(docs)]
    for doc, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_small_table(spark):
    docs = small_docs(spark)
    assert multiset(written_and_read(spark, docs, partitions=3).collect()) == multiset(expected(docs))


def test_bounds_in_batches(spark, monkeypatch):
    docs = small_docs(spark)
    monkeypatch.setattr(E, "BATCH", 7)
    assert multiset(written_and_read(spark, docs, partitions=2).collect()) == multiset(expected(docs))


def test_a_text_over_a_megabyte(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "word, " * 300_000), (3, "end")], "doc_id long, text string")
    assert multiset(written_and_read(spark, docs, partitions=2).collect()) == multiset(expected(docs))


def test_small_segments(spark, monkeypatch):
    docs = small_docs(spark).limit(40)
    monkeypatch.setattr(E, "SEGMENT_BYTES", 1 << 10)
    assert multiset(written_and_read(spark, docs, partitions=2).collect()) == multiset(expected(docs))


def test_defined_cases(spark):
    docs = odd_docs(spark)
    got, want = written_and_read(spark, docs).collect(), expected(docs)
    strip = lambda rows: multiset((r[0], r[2], r[3]) for r in rows)  # noqa: E731  rows of one id stand in the order of their texts' hashes
    assert strip(got) == strip(want)
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in ends] == list(np.cumsum([0, *(n for _, n in ends)])[:-1])
    assert written_and_read(spark, no_docs(spark)).count() == 0
