from collections import Counter

import pytest

from callsight.llm.repetition import GRAM_LIMITS, LINE_CHARS_LIMIT, LINE_LIMIT, repetition_rules

from .cases import multiset, no_docs, odd_docs, rows_of, small_docs, words

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"gram{n}" for n in GRAM_LIMITS), "line_share", "line_chars_share"]


def expected(rows):
    out = []
    for doc, text in rows:
        text, w = text or "", words(text)
        chars = sum(map(len, w))
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        shares = []
        for n in GRAM_LIMITS:
            seen, inside = set(), set()
            for i in range(len(w) - n + 1):
                gram = tuple(w[i : i + n])
                if gram in seen:
                    inside.update(range(i, i + n))
                seen.add(gram)
            shares.append(sum(len(w[i]) for i in inside) / max(1, chars))
        seen, dup, dup_chars, full, all_chars = set(), 0, 0, 0, 0
        for line in text.split("\n"):
            if words(line):
                size = len(line.encode())
                full, all_chars = full + 1, all_chars + size
                dup, dup_chars = dup + (line in seen), dup_chars + size * (line in seen)
                seen.add(line)
        lines, line_chars = dup / max(1, full), dup_chars / max(1, all_chars)
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        kept = not failed and all(s <= x for s, x in zip(shares, GRAM_LIMITS.values())) and lines <= LINE_LIMIT and line_chars <= LINE_CHARS_LIMIT
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        out.append((doc, len(w), chars, symbols, dup, len(repeat), failed, kept, *(round(s, 9) for s in (*shares, lines, line_chars))))
    return out


def got(docs):
    rows = repetition_rules(docs).select(COLUMNS).collect()
    return multiset((*r[:8], *(round(x, 9) for x in r[8:])) for r in rows)


def test_small_table(spark):
    docs = small_docs(spark)
    want = expected(rows_of(docs))
    assert got(docs) == multiset(want) and 0 < sum(r[7] for r in want) < len(want)


def test_defined_cases(spark):
    docs = odd_docs(spark)
    assert got(docs) == multiset(expected(rows_of(docs)))
    assert repetition_rules(no_docs(spark)).count() == 0


def test_shorter_windows_are_refused(spark):
    with pytest.raises(ValueError):
        repetition_rules(no_docs(spark), {3: 0.1})


def test_a_text_over_a_block(spark):
    long = "one two three four five six seven eight nine ten eleven\n" * 3 + "\n".join(f"w{i} and x{i % 977} some# more" for i in range(60_000))
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, "a short text before it"), (2, long), (3, "and one after")], "doc_id long, text string")
    assert got(docs) == multiset(expected(rows_of(docs)))
