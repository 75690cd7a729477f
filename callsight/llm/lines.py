"""Removal of repeated runs of lines by winnowing (operator 6). Only DataFrame functions; no Python code runs on rows.

A line is compared by the hash of its words; blank lines are left out. Grams are two consecutive lines. Of each window of
``min_lines - 1`` consecutive grams the one with the smallest hash is a fingerprint, the first of equal ones, so each run of
``min_lines`` lines holds one at the same place in every copy. A fingerprint is matched with all places that have it: it is
extended to the left and to the right, by the line there, to the whole of each window that chose it, and places are
aggregated by fingerprint and extension, which keeps the first one in the order (doc_id, place). A match is thus one run of one
source, and never put together from several. Grams and single lines of ``min_words`` words or more are fingerprints of their own.

Every later match is deleted, and the first place stays: all runs of ``min_lines`` lines, and all of one or two lines with
``min_words`` words, that stood earlier anywhere go, and no others. Longer runs are the union of matches that share a line; the blank
lines inside a match go with it, those between two matches that share no line stay.

Defined cases: a null text or doc_id stays as it is and takes no part; blank lines match nothing; a text whose lines all
go becomes empty; a very long text is one row of many lines, each with its own fingerprints; rows that repeat a doc_id are told
apart by a hash of their text, and rows equal in both are one place and treated alike; an empty table gives no rows; all
columns come back under their names. Equal 64-bit hashes count as equal lines and as equal matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line is trimmed of, and what makes it more than a blank one.
BLANK, FULL = r"[ \t\x0B\f\r]+", r"[^ \t\x0B\f\r]"


def all_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def word_lines(text: Column) -> Column:
    """Lines that are not blank: (line number, hash of the words, number of words)."""
    plain = lambda line: F.trim(F.regexp_replace(line, BLANK, " "))
    numbered = F.transform(F.transform(all_lines(text), plain), lambda words, i: F.struct(i.alias("line"), words.alias("words")))
    return F.transform(
        F.filter(numbered, lambda x: x.words != ""),
        lambda x: F.struct(x.line.alias("line"), F.xxhash64(x.words).alias("hash"), F.size(F.split(x.words, " ")).alias("words")),
    )


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator's output, which later filters and columns cannot inline again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def matched_places(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, variant, place, joined): lines, counted without blank ones, in a match, and whether one match holds the next line too."""
    if min_lines not in (2, 3):
        raise ValueError("runs of 2 or 3 lines at least")
    own = _own(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("variant"), word_lines(F.col("text")).alias("lines"))

    def neighbours(x: Column, i: Column) -> Column:
        at = lambda k: F.when(i + k >= 0, F.get(F.col("lines"), i + k))  # noqa: E731  null outside of the array
        hashes = [at(k).hash.alias(name) for k, name in ((-1, "before"), (0, "line"), (1, "second"), (2, "after"))]
        return F.struct(i.alias("place"), x.words.alias("words"), F.coalesce(at(1).words, F.lit(0)).alias("next_words"), *hashes)

    each = own.select("doc_id", "variant", F.explode(F.transform("lines", neighbours)).alias("x")).select("doc_id", "variant", "x.*")
    gram = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.xxhash64(a, b))
    previous, gram_here, following = gram("before", "line"), gram("line", "second"), gram("second", "after")

    def match(when: Column, start: int, height: int, *key: Column | str) -> Column:
        return F.when(when, F.struct(F.xxhash64(F.lit(height), F.lit(start), *key).alias("print"), F.lit(start).alias("from"), F.lit(height).alias("height")))

    if min_lines == 3:  # a window of two grams: the smaller one, extended by the line on its other side
        prints = [match(gram_here < previous, -1, 3, gram_here, "before"), match(gram_here <= following, 0, 3, gram_here, "after")]
    else:  # a window of one gram
        prints = [match(gram_here.isNotNull(), 0, 2, gram_here)]
    if min_lines > 2:
        prints.append(match(gram_here.isNotNull() & (F.col("words") + F.col("next_words") >= min_words), 0, 2, gram_here))
    prints.append(match(F.col("words") >= min_words, 0, 1, F.col("line")))
    marks = each.select("doc_id", "variant", "place", F.explode(F.array_compact(F.array(*prints))).alias("p")).select(
        F.struct("doc_id", (F.col("place") + F.col("p.from")).alias("place"), "variant").alias("spot"), "p.print", "p.height"
    )
    first = marks.groupBy("print").agg(F.min("spot").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = marks.join(first, "print").filter("spot > first")
    last = F.col("height") - 1
    covered = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((F.col("spot.place") + k).alias("place"), (k < last).alias("joined")))
    places = later.select("spot.doc_id", "spot.variant", F.explode(covered).alias("x")).select("doc_id", "variant", "x.*")
    return places.groupBy("doc_id", "variant", "place").agg(F.max("joined").alias("joined"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50, counts: bool = False) -> DataFrame:
    """``docs`` without its later repeated runs of lines; with ``counts`` also n_lines and n_deleted (all lines, blank ones too)."""
    found = matched_places(docs, id_col, text_col, min_lines, min_words)
    # A document's own matched lines: an array no longer than its text.
    places = found.groupBy("doc_id", "variant").agg(F.array_sort(F.collect_list(F.struct("place", "joined"))).alias("at"))
    begins = F.filter("at", lambda x, i: (i == 0) | ~F.coalesce(F.get(F.col("at"), F.greatest(i - 1, F.lit(0))).joined, F.lit(False)))
    ends = F.filter("at", lambda x: ~x.joined)
    runs = places.select("doc_id", "variant", F.arrays_zip(F.transform(begins, lambda x: x.place).alias("a"), F.transform(ends, lambda x: x.place).alias("b")).alias("runs"))

    # The input's columns travel under names of their own, so that none can clash.
    own = {c: f"_input{i}" for i, c in enumerate(docs.columns)}
    text = F.col(own[text_col])
    renamed = docs.toDF(*own.values())
    rows = renamed.select("*", F.col(own[id_col]).alias("doc_id"), F.xxhash64(text).alias("variant"))
    joined = rows.join(runs, ["doc_id", "variant"], "left")
    cut = once(joined, "all", F.when(F.col("runs").isNotNull(), all_lines(text)))  # only where lines go
    full = F.filter(F.transform("all", lambda line, i: F.when(line.rlike(FULL), i)), lambda i: i.isNotNull())
    cut = once(cut, "full", full)
    number = lambda place: F.get(F.col("full"), place)
    spans = F.transform("runs", lambda r: F.struct(number(r.a).alias("a"), number(r.b).alias("b")))
    cut = once(cut, "spans", F.coalesce(spans, F.array().cast("array<struct<a:int,b:int>>")))
    # What stands before each run and after the last one.
    after = lambda i: F.when(i > 0, F.get(F.col("spans"), F.greatest(i - 1, F.lit(0))).b + 1).otherwise(0)
    until = lambda i: F.coalesce(F.get(F.col("spans"), i).a, F.size("all"))
    parts = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.slice("all", after(i) + 1, until(i) - after(i)))
    left = once(cut, "kept", F.when(F.size("spans") == 0, text).otherwise(F.array_join(F.flatten(parts), "\n")))
    out = [F.col("kept" if c == text_col else name).alias(c) for c, name in own.items()]
    if counts:
        n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
        out += [n_lines.alias("n_lines"), F.aggregate("spans", F.lit(0), lambda n, s: n + s.b - s.a + 1).alias("n_deleted")]
    return left.select(*out)
