"""Repetition rules: characters inside repeated n-grams and lines (operator 4).

Every text is judged alone, in one pass without a shuffle. Rolling hashes of several n-gram lengths find the windows that
occur again; an n-gram can only repeat where its first n - 1 words do, so the longer lengths look at those places alone.
A share counts the characters (code points of words) in windows whose words stood earlier in the text; the first
occurrence is not counted. The limits are the usual ones for web text: 15 % for five words down to 10 % for ten, 20 % of
the characters and 30 % of the lines for repeated lines.

Defined cases: a null or empty text has no words and fails the base rule; a null doc_id stays null; repeated rows give
repeated rows; a very long text is judged alone, whole; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callsight.llm.common import id_and_text
from callsight.llm.wordhash import Words, column_blocks, covered, grams, mix

#: Largest share of characters in repeated windows, by their number of words.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHARS_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places with these keys: whether another place has the same key, and whether an earlier one has."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    both, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    both[order[1:]] = same
    both[order[:-1]] |= same
    return both, later


def measure(texts: list[bytes], grams_of: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of the base rules and the shares, an array with one value per text each."""
    w = Words(texts)
    hashes, of = w.hashes(), w.texts_of()
    # Code points of a word: its bytes that do not continue a character.
    starts_character = np.concatenate([[0], np.cumsum((w.bytes & 0xC0) != 0x80)])
    chars = starts_character[w.ends] - starts_character[w.starts]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[w.bytes])])
    out = {"n_words": w.counts, "word_chars": w.per_text(chars)}
    ends = np.minimum(w.text_at[1:], len(w.bytes))
    out["n_symbols"] = symbols[ends] - symbols[w.text_at[:-1]]

    salted = mix(of.astype(np.uint64) + np.uint64(1))
    places = None
    for n in grams_of:
        if places is None:  # all windows of the shortest length
            places = np.flatnonzero(w.windows(n))
        else:
            places = places[w.windows(n)[places]]
        both, later = again(grams(hashes, n)[places] ^ salted[places])
        if n == grams_of[0]:
            out["n_repeat_words"] = w.per_text(covered(places[both], n, len(hashes)))
        inside = covered(places[later], n, len(hashes))
        out[f"gram{n}"] = w.per_text(chars * inside) / np.maximum(1, out["word_chars"])
        places = places[both]

    dup, dup_chars, full, all_chars = np.zeros((4, len(texts)), dtype=np.int64)
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if not line.strip():  # of bytes: the six white-space ones
                continue
            size = len(line)
            full[i] += 1
            all_chars[i] += size
            if line in seen:
                dup[i] += 1
                dup_chars[i] += size
            seen.add(line)
    return out | {"n_dup_lines": dup, "line_share": dup / np.maximum(1, full), "line_chars_share": dup_chars / np.maximum(1, all_chars)}


def repetition_rules(
    docs: DataFrame, gram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, line_chars_limit: float = LINE_CHARS_LIMIT
) -> DataFrame:
    """One row per document: the counts, the shares, ``base_failed`` and ``kept`` (every share within its limit, base not failed).

    The base rule's five-word windows are always measured; ``gram_limits`` names the lengths that are judged, 5 or more.
    """
    limits = gram_limits or GRAM_LIMITS
    if min(limits) < 5:
        raise ValueError("windows of 5 words or more")
    lengths = tuple(sorted({5, *limits}))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [f"gram{n}" for n in sorted(limits)] + ["line_share", "line_chars_share"]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", *(f"{c} double" for c in shares)])
    most = {f"gram{n}": x for n, x in limits.items()} | {"line_share": line_limit, "line_chars_share": line_chars_limit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in column_blocks(batch.column(1)):
                got = measure(some, lengths)
                failed = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
                kept = ~failed
                for name, limit in most.items():
                    kept &= got[name] <= limit
                columns = [*(got[c] for c in counts), failed, kept, *(got[c] for c in shares)]
                ids = batch.column(0).slice(first, len(some))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], [f.split()[0] for f in schema.split(", ")])

    return id_and_text(docs).mapInArrow(run, schema)
