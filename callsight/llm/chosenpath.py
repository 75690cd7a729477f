"""Near-duplicates by a chosen-path set similarity join (operator 11).

A document is the set of its shingles; equal sets are one class from here on. Minwise tokens stand for a set: two sets share
each of them with their similarity as the chance. Trees branch the classes by such tokens. A tree's root sends each
class to the node of one token; a node that is too large chooses one token number more, in a quarter of the nodes two, the same for
all its members, and sends each member to the child its tokens name. So two classes at the threshold have one common child of a node
on average, while classes that are less alike part after a few levels. Nodes of one class are dropped.

* Nodes of up to ``CROWD`` classes are compared exhaustively: four bits of each token estimate the similarity of every pair.
* Larger nodes first compare all members with ``PIVOTS`` of them. What is found is confirmed on whole sets, each class
  with one candidate, and gives first groups.
* Only nodes that hold members of different groups go on: of up to ``LIMIT`` classes they are compared exhaustively, on whole
  sets, between groups; the larger ones branch on. So a large cluster of near copies never gives its pairs.

A link always rests on whole sets. ``TREES`` independent trees find a pair at the threshold, in nodes that are small at
once, with a chance of 1 - (1 - similarity) ** TREES; each further level takes a tree off by the share stated at ``TREES``. Links that
the trees miss are the only ones that can be lost; there is no limit on partners or candidates.

Defined cases: a null or empty text has an empty set, is linked with nothing and its own component; fewer words than a
shingle are one shingle; a null doc_id is never a component's name, and a component without any doc_id has none; repeated rows are one class;
a very long text is one set, compared like any other; an empty table gives no rows; other columns are ignored. Equal 64-bit hashes
count as equal shingles, and classes are named by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text, landed
from callsight.llm.components import connected_components
from callsight.llm.wordhash import BLOCK, Words, blocks, column_blocks, grams, mix

#: Minwise tokens of a set that paths choose from; and how many are estimated with, as 64-bit numbers that hold four bits of each.
TOKENS, ESTIMATED = 64, 128
LANES = [f"lane{i}" for i in range(ESTIMATED // 16)]
#: Trees. At a similarity of 0.8 a tree keeps a pair in common with a chance of 0.80, 0.67, 0.58, 0.51 and 0.46 after 1 to 5 levels:
#: twelve lose one pair of 10^8, 10^6, 30,000, 5,000 and 1,600; none of these figures counts the pivots.
TREES = 12
#: Classes of a node: compared pair by pair at once; compared on whole sets in one task, with so many shingles together.
CROWD, LIMIT, LIMIT_SHINGLES = 16, 2048, 1 << 20
#: Members of a large node with which all others are compared.
PIVOTS = 4
#: Standard deviations by which the estimate may fall short of the threshold.
MARGIN = 4.5
#: Bits that mark wanted texts, a megabyte, in pages as Spark's bitmaps have them.
MARKS, PAGE = 1 << 23, 1 << 15
#: Levels that a node takes at once when it is larger than so many times LIMIT: as many tokens, chosen as one level each would.
JUMPS = [(64, 4), (4, 2)]

_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, ESTIMATED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, shingle hash), sorted and without repeats, for lower-cased texts."""
    w = Words([t.lower() for t in texts])  # of bytes: A-Z alone
    hashes, of = w.hashes(), w.texts_of()
    whole = np.flatnonzero(w.windows(size))
    found, owner = [grams(hashes, size)[whole]], [of[whole]]
    for n in range(1, size):  # the whole sequence of short texts
        short = np.flatnonzero(w.counts == n)
        if len(short):
            found.append(mix(grams(hashes, n)[w.first[:-1][short]] + np.uint64(n)))
            owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], found[new]


def sketch_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, variant, n, cls, tokens, lanes): a hash of the row, size and name of the set, its minwise tokens; tokens are null for an empty set."""
    schema = ", ".join(["doc_id long, variant long, n long, cls long, tokens binary", *(f"{c} long" for c in LANES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in column_blocks(batch.column(2)):
                owner, hashes = shingle_sets(some, size)
                counts = np.bincount(owner, minlength=len(some))
                full = np.flatnonzero(counts)
                starts = np.concatenate([[0], np.cumsum(counts)])[full]
                tokens = np.zeros((len(full), ESTIMATED), dtype=np.uint32)
                names = np.zeros(len(some), dtype=np.uint64)
                if len(full):
                    sums = [np.add.reduceat(mix(h), starts) for h in (hashes, hashes ^ _SECOND)]
                    names[full] = mix(sums[0] + mix(sums[1]) + counts[full].astype(np.uint64))
                    for i, a in enumerate(_FACTORS):
                        tokens[:, i] = np.minimum.reduceat(hashes * a, starts) >> np.uint64(16)
                # Four mixed bits of each token, sixteen tokens a number.
                bits = (mix(tokens.astype(np.uint64)) & np.uint64(15)).reshape(len(full), len(LANES), 16) << np.arange(0, 64, 4, dtype=np.uint64)
                lanes = np.zeros((len(some), len(LANES)), dtype=np.uint64)
                lanes[full] = np.bitwise_or.reduce(bits, axis=2)
                packed: list[bytes | None] = [None] * len(some)
                for k, row in zip(full.tolist(), tokens[:, :TOKENS].astype("<u4")):
                    packed[k] = row.tobytes()
                ids, variants = (batch.column(c).slice(first, len(some)) for c in (0, 1))
                columns = [ids, variants, pa.array(counts, pa.int64()), pa.array(names.view(np.int64)), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(lanes[:, i].view(np.int64)) for i in range(len(LANES)))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("variant"), "text").mapInArrow(run, schema)


def most_differences(percent: int, margin: float = MARGIN) -> int:
    """Tokens of which four bits may differ in a pair that is worth comparing."""
    p = (1 - percent / 100) * 15 / 16
    return math.floor(ESTIMATED * p + margin * math.sqrt(ESTIMATED * p * (1 - p)))


def differences(x: str, y: str) -> Column:
    """How many tokens' bits differ between the lanes of two aliased tables."""
    ones = F.lit(0x1111111111111111)

    def lane(c: str) -> Column:
        v = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(ones))

    return reduce(lambda a, b: a + b, map(lane, LANES))


def sized(a: Column | str, b: Column | str, percent: int) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def crowded(rows: DataFrame, *more: Column) -> DataFrame:
    """``rows`` (node, cls, ...) of nodes that hold several classes, with the node's ``size`` and ``shingles``."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), *more).filter("size > 1")
    return rows.join(sizes, "node")


def pivot_pairs(large: DataFrame, percent: int, *apart: Column) -> DataFrame:
    """(a, b, differing): members of large nodes that are like one of the node's pivots, which are chosen by a hash."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "cls"), "cls")
    chosen = landed(large.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= PIVOTS).drop("no", "size", "shingles"), "path-pivots")
    like = (F.col("x.node") == F.col("y.node")) & (F.col("x.cls") != F.col("y.cls")) & sized("x.n", "y.n", percent)
    like = reduce(lambda a, b: a & b, apart, like) & (differences("x", "y") <= most_differences(percent))
    return large.alias("x").join(chosen.alias("y"), like).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), differences("x", "y").alias("differing"))


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``variant`` may be wanted: those whose hash meets a bit set by ``wanted``.

    MARKS bits, whatever the number of rows, go to every task; they keep most texts out of the shuffle that follows while fewer
    rows than bits are wanted, and change no result.
    """
    bit = lambda c: F.pmod(F.col(c), F.lit(MARKS))
    pages = wanted.groupBy(F.floor(bit("variant") / PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg((bit("variant") % PAGE)).alias("bits"))
    rows = docs.withColumn("page", F.floor(bit("variant") / PAGE).cast("long")).join(F.broadcast(pages), "page")  # at most MARKS bits
    place = (bit("variant") % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("page", "bits")


class Texts:
    """Texts of classes, each fetched from the table once: that of the class's representative row."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes, self.parts = docs.select(F.xxhash64("doc_id", "text").alias("variant"), "text"), classes, []

    def of(self, *sides: DataFrame) -> DataFrame:
        """(cls, text) of at least the classes named by one-column tables."""
        names = reduce(DataFrame.union, sides).toDF("cls").distinct()
        for part in self.parts:
            names = names.join(part.select("cls"), "cls", "left_anti")
        # Written first, so that Spark sees its size: few rows are broadcast, and the table is not shuffled for them.
        wanted = landed(self.classes.select("cls", F.col("rep").alias("variant")).join(names, "cls", "left_semi"), "path-wanted")
        if not wanted.isEmpty():
            found = marked(self.docs, wanted).join(wanted, "variant").dropDuplicates(["variant"])  # repeated rows
            self.parts.append(landed(found.select("cls", "text"), "path-texts"))
        return reduce(DataFrame.unionByName, self.parts) if self.parts else wanted.select("cls", F.lit("").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)))
            at = done = 0
            while at < len(ends):  # pairs of at most BLOCK bytes, or one pair
                stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
                sides = [batch.column(i).slice(at, stop - at).cast(pa.binary()).to_pylist() for i in (2, 3)]
                owner, hashes = shingle_sets([t for pair in zip(*sides) for t in pair], size)
                counts = np.bincount(owner, minlength=2 * (stop - at))
                order = np.lexsort((hashes, owner // 2))
                p, h = owner[order] // 2, hashes[order]
                common = np.bincount(p[1:][(p[1:] == p[:-1]) & (h[1:] == h[:-1])], minlength=stop - at)
                good = np.flatnonzero(100 * common >= percent * (counts[0::2] + counts[1::2] - common))
                if len(good):
                    yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good + at)) for i in (0, 1)], names=["a", "b"])
                at, done = stop, int(ends[stop - 1])

    first = pairs.join(texts.toDF("a", "text_a"), "a")
    return first.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def linked_within(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Of one node's rows (cls, comp, text): links (a, b) between classes of different groups, enough to join all that are linked there."""
    names, comp = (table.column(c).to_numpy() for c in ("cls", "comp"))
    texts = table.column("text").cast(pa.binary()).to_pylist()
    sets, counts = [], []
    for _, some in blocks(texts):
        owner, hashes = shingle_sets(some, size)
        sets.append(hashes)
        counts.append(np.bincount(owner, minlength=len(some)))
    hashes, counts = np.concatenate(sets), np.concatenate(counts)
    number = np.unique(hashes, return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(counts)])
    group = np.unique(comp, return_inverse=True)[1]
    a, b = [], []
    mark = np.zeros(int(number.max(initial=0)) + 1, dtype=bool)
    for i in range(len(names) - 1):
        if not (group[i + 1 :] != group[i]).any():
            continue
        own = number[starts[i] : starts[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[number[starts[i + 1] :]].astype(np.int64), starts[i + 1 : -1] - starts[i + 1])
        mark[own] = False
        near = np.flatnonzero(100 * common >= percent * (counts[i] + counts[i + 1 :] - common)) + i + 1
        for j in near.tolist():
            if group[j] != group[i]:
                a.append(names[i])
                b.append(names[j])
                group[group == group[j]] = group[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of small root nodes, pairs with pivots, rows of large root nodes)."""
    roots = F.array(*(F.xxhash64(F.lit(t), F.substring("tokens", 4 * t + 1, 4)) for t in range(TREES)))
    # Nodes of several classes are found on the ids alone; only their members get the lanes.
    members = classes.select(F.explode(roots).alias("node"), "cls")
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    shared = landed(members.join(sizes, "node").join(classes.select("cls", "n", *LANES), "cls"), "path-nodes")
    small = shared.filter(F.col("size") <= CROWD)
    like = (F.col("x.node") == F.col("y.node")) & (F.col("x.cls") < F.col("y.cls")) & sized("x.n", "y.n", percent) & (differences("x", "y") <= most_differences(percent))
    pairs = small.alias("x").join(small.alias("y"), like).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), differences("x", "y").alias("differing"))
    large = shared.filter(F.col("size") > CROWD)
    return landed(pairs.distinct(), "path-pairs"), landed(pivot_pairs(large, percent).distinct(), "path-stars"), large.drop("size")


def first_choices(pairs: DataFrame, percent: int) -> DataFrame:
    """Of each class one candidate, as pairs: the smallest of those that are estimated to be similar enough, else the nearest."""
    both = pairs.select("a", "b", "differing").union(pairs.select("b", "a", "differing"))
    short = F.greatest(F.col("differing") - most_differences(percent, margin=0), F.lit(0))
    chosen = both.groupBy("a").agg(F.min(F.struct(short.alias("short"), "b")).alias("best")).select("a", "best.b")
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(groups: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The groups (cls, comp) after links (a, b) between classes."""
    if not links:
        return groups
    of = lambda side: groups.toDF(side, f"comp_{side}")
    between = reduce(DataFrame.unionByName, links).join(of("a"), "a").join(of("b"), "b").select("comp_a", "comp_b")
    roots = connected_components(between, "comp_a", "comp_b").toDF("comp", "root")
    return landed(groups.join(roots, "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp")), "path-groups")


def children(rows: DataFrame) -> DataFrame:
    """Rows of large nodes sent on to the nodes below: one token of the node's choice, in a quarter of the nodes two."""

    def token(k: int) -> Column:
        number = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS)).cast("int")
        return F.xxhash64("node", F.lit(k), F.substring(F.col("tokens"), 4 * number + 1, F.lit(4)))

    below = F.array_compact(F.array(token(0), F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(4)) == 0, token(1))))
    levels = reduce(lambda rest, j: F.when(F.col("size") > j[0] * LIMIT, j[1]).otherwise(rest), reversed(JUMPS), F.lit(1))
    rows = rows.withColumn("levels", levels)
    for done in range(max(n for _, n in JUMPS)):
        rows = rows.withColumn("node", F.explode(F.when(F.col("levels") > done, below).otherwise(F.array("node"))))
    return rows.select("node", "cls", "n", "comp", "tokens", *LANES)


def settled_groups(texts: Texts, classes: DataFrame, large: DataFrame, groups: DataFrame, links: list[DataFrame], size: int, percent: int) -> DataFrame:
    """The groups after ``links`` and all that the nodes below large root nodes give: nodes of one group are dropped, the others branch until they are small."""
    active = large.join(groups, "cls")
    level = 0
    while True:
        level += 1
        rows = crowded(active, F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").drop("lo", "hi")
        rows = landed(rows, "path-nodes")
        fits = (F.col("size") <= CROWD) | (F.col("size") <= LIMIT) & (F.col("shingles") <= LIMIT_SHINGLES)
        small, beyond = rows.filter(fits), rows.filter(~fits)
        apart = F.col("x.comp") != F.col("y.comp")
        like = (F.col("x.node") == F.col("y.node")) & apart & sized("x.n", "y.n", percent) & (differences("x", "y") <= most_differences(percent))
        members = landed(small.alias("x").join(small.alias("y"), like, "left_semi").select("node", "cls", "comp"), "path-members")
        if not members.isEmpty():
            whole = members.join(texts.of(members.select("cls")), "cls").select("node", "cls", "comp", "text")
            found = whole.groupBy("node").applyInArrow(lambda t: linked_within(t, size, percent), "a long, b long")
            links.append(landed(found.distinct(), "path-links"))
        if beyond.isEmpty():
            return merged(groups, links)
        if level & (level - 1) == 0:  # at levels 1, 2, 4, ...: pivots again, between groups, and the groups are brought up to date
            stars = landed(first_choices(pivot_pairs(beyond, percent, apart), percent), "path-stars")
            links.append(landed(confirmed(stars, texts.of(stars.select("a"), stars.select("b")), size, percent), "path-links"))
            groups, links = merged(groups, links), []
            beyond = beyond.drop("comp").join(groups, "cls")
        if level == 1:
            beyond = beyond.join(classes.select("cls", "tokens"), "cls")
        active = children(beyond)


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; linked documents share the smallest doc_id that links reach."""
    if not 0 < percent <= 100:
        raise ValueError("a similarity of 1 to 100 percent")
    own = id_and_text(docs, id_col, text_col)
    rows = landed(sketch_rows(own, shingle), "path-rows")
    full = rows.filter("n > 0")
    values = [F.any_value(c).alias(c) for c in ("n", "tokens", *LANES)]
    classes = landed(full.groupBy("cls").agg(F.min("variant").alias("rep"), F.min("doc_id").alias("first_doc"), *values), "path-classes")

    pairs, stars, large = candidates(classes, percent)
    chosen = landed(first_choices(pairs.unionByName(stars), percent), "path-chosen")
    texts = Texts(own, classes)
    links = landed(confirmed(chosen, texts.of(*(p.select(c) for p in (pairs, stars) for c in ("a", "b"))), shingle, percent), "path-links")
    groups = merged(classes.select("cls", F.col("cls").alias("comp")), [links])

    # What the first choices left open: pairs of small nodes between groups, and large nodes with several groups.
    left = pairs.select("a", "b").join(groups.toDF("a", "ca"), "a").join(groups.toDF("b", "cb"), "b").filter("ca != cb").select("a", "b")
    left = landed(left.join(chosen, ["a", "b"], "left_anti"), "path-left")
    rest = landed(confirmed(left, texts.of(left.select("a"), left.select("b")), shingle, percent), "path-links")
    groups = settled_groups(texts, classes, large, groups, [rest], shingle, percent)
    roots = groups.withColumnRenamed("comp", "root")
    named = roots.join(classes.select("cls", "first_doc"), "cls")
    of_root = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_class = named.join(of_root, "root").select("cls", "component_id")

    linked = full.join(of_class, "cls").select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(shingle: int = 4, percent: int = 80) -> str:
    """The same over ``documents`` as DuckDB SQL: shingles in common are counted for every pair that has any."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = rf"regexp_extract_all(translate(text, {letters}), '[^\x20\x09-\x0D]+')"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
    s AS (
      SELECT DISTINCT r, array_to_string(ws[p : p + {shingle - 1}], ' ') AS x
      FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - {shingle - 1}) + 1)) AS p FROM d WHERE len(ws) > 0)
    ),
    n AS (SELECT r, count(*)::BIGINT AS n FROM s GROUP BY r),
    common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
    links AS (SELECT a, b FROM common JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
    reach AS (SELECT a AS r, b FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT reach.r, min(d.doc_id) AS doc_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.r),
    named AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, least.doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r))
    SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named
    """
