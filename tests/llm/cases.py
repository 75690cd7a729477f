"""Small tables with the cases that every operator has to define, and the small driver table."""

import re

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Column names that operators use inside, to clash with.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("fp", T.IntegerType()),
        T.StructField("row", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("variant", T.StringType()),
        T.StructField("lines", T.IntegerType()),
        T.StructField("part", T.StringType()),
    ]
)

PASSAGE = "one long passage of more than thirteen words that stands in several of these small texts again and again"
LINES = "first line here\nsecond line there\nthird line everywhere\nfourth line nowhere"

TEXTS = [
    (0, f"{PASSAGE} and so on"),
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, f"A start. {PASSAGE}\nand an end"),
    (5, LINES),
    (6, "Above\n" + LINES + "\n\nBelow"),
    (7, "word " * 4000),
    (8, "x" * 50_000),
    (9, "Ünïcödé 中文 \U0001f600 é İ \x1c \xa0 don't it's 1,234 <|endoftext|> a b"),
    (10, LINES),
    (11, PASSAGE),
    (11, PASSAGE),  # a repeated row
    (12, PASSAGE + " with one end"),
    (12, "another text of the same id"),
    (None, PASSAGE),
    (None, "no id"),
    (13, " ".join(f"w{i}" for i in range(3000))),
    (14, " ".join(f"w{i}" for i in range(3000)) + " w"),
    (15, "one"),
    (16, "two words"),
]


def odd_docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "r", None, "v", 2, "p") for i, t in texts], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text or "")


def multiset(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
