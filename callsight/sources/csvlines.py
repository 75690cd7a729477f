"""A CSV file with line breaks in quoted fields, read by many tasks.

A multi-line CSV reader takes a file whole, in one task, because only a scan
from its start tells whether a line break stands inside quotes. Here the file
is read as lines, which Spark splits, and that state is found by a distributed
prefix composition:

1. Each line is a function of the state before it ("outside" or "inside" a
   quoted field): what the state is after the line, for either state before.
   Two regular expressions on the line tell; no line is looked at in order.
2. Within a split, the state before each line follows from the last line that
   sets it whatever came before, and from the number of lines since that turn
   it over: running values of a window over one split.
3. A split is again such a function; running values over the splits of a file
   (a row each) give the state before each split.
4. A record begins at a line that starts outside of quotes. Records of one line
   are passed on; only those of several lines are gathered, by file and number
   of the first line. ``from_csv`` then reads each record's fields, with the
   options of the plain reader.

Fields are quoted only where the quote opens the field, and a doubled quote
inside is a quote character. A quote that is never closed makes the rest of its
file one record, as for any CSV reader. Lines end with ``\\n`` or ``\\r\\n``. Empty
lines between records are skipped. Each file has a header line, whose names come
from the first file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+$'  # a quote that the line does not close
_FIELD = rf'(?:{_QUOTED}[^,]*+|(?!")[^,]*+)'
#: From outside: whole fields, then one that stays open.
LEFT_OPEN = rf"(?s)^(?:{_FIELD},)*+{_OPEN}"
#: From inside: the field goes on to the end; or it closes, and a later one stays open.
KEPT_OPEN = r'(?s)^[^"]*+(?:""[^"]*+)*+$'
OPENED_AGAIN = rf'(?s)^[^"]*+(?:""[^"]*+)*+"[^,]*+,(?:{_FIELD},)*+{_OPEN}'

OPTIONS = {"escape": '"', "multiLine": "true"}


def _state(reset: Column, flips: Column, before: Column | bool) -> Column:
    """State after lines whose last setting line is ``reset`` (its value and the turns up to it), with ``flips`` turns in all."""
    start = F.lit(before) if isinstance(before, bool) else before
    since = F.when(reset.isNotNull(), flips - reset["flips"]).otherwise(flips)
    return F.coalesce(reset["value"], start) != (since % 2 == 1)


def lines_with_state(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, line, inside): every line, by file, split and number within it, and whether it starts inside quotes."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"),  # ascending in a split
        F.col("value").alias("line"),
    )
    quoted = F.instr("line", '"') > 0
    from_outside = F.when(quoted, F.col("line").rlike(LEFT_OPEN)).otherwise(False)
    from_inside = F.when(quoted, F.col("line").rlike(KEPT_OPEN) | F.col("line").rlike(OPENED_AGAIN)).otherwise(True)
    steps = lines.withColumn("out0", from_outside).withColumn("out1", from_inside)

    in_split = Window.partitionBy("file", "block").orderBy("no")
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("out0") & ~F.col("out1"), 1).otherwise(0)
    counted = steps.withColumn("flips", F.sum(turns).over(so_far))
    setting = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("value"), "flips"))
    running = counted.withColumn("turns", turns).withColumn("reset", F.last(setting, ignorenulls=True).over(so_far))
    running = running.withColumn("reset_before", F.last("reset", ignorenulls=True).over(earlier))

    splits = running.groupBy("file", "block").agg(F.max_by(F.struct("reset", "flips"), "no").alias("end"))
    in_file = Window.partitionBy("file").orderBy("block")  # a row a split
    total = F.sum("end.flips").over(in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    splits = splits.withColumn("total", total).withColumn("base", F.col("total") - F.col("end.flips"))
    last_set = F.when(F.col("end.reset").isNotNull(), F.struct(F.col("end.reset.value").alias("value"), (F.col("base") + F.col("end.reset.flips")).alias("flips")))
    before = F.last(last_set, ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.withColumn("set", before).select("file", "block", _state(F.col("set"), F.col("base"), False).alias("start"))

    joined = running.join(starts, ["file", "block"])
    inside = _state(F.col("reset_before"), F.col("flips") - F.col("turns"), F.col("start"))
    return joined.select("file", "block", "no", "line", inside.alias("inside"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header): the text of every record of the files, empty lines left out, and whether it is its file's first."""
    lines = lines_with_state(spark, path)
    in_split = Window.partitionBy("file", "block").orderBy("no")
    starts = F.when(F.col("inside"), None).otherwise(F.col("no"))
    # The line a record begins with: in this split, or the last one begun in an earlier split of the file.
    own = lines.withColumn("first", F.last(starts, ignorenulls=True).over(in_split)).withColumn("alone", ~F.col("inside") & ~F.coalesce(F.lead("inside").over(in_split), F.lit(True)))
    begun = own.groupBy("file", "block").agg(F.max("first").alias("last"))
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("no"))), ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    headers = F.first(F.when(F.col("last").isNotNull(), F.col("block")), ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = begun.select("file", "block", earlier.alias("earlier"), headers.alias("head_block"))
    keyed = own.join(carried, ["file", "block"])
    key = F.when(F.col("first").isNotNull(), F.struct(F.col("block").alias("block"), F.col("first").alias("no"))).otherwise(F.col("earlier"))
    keyed = keyed.select("file", "block", "no", "line", "alone", key.alias("key"), "head_block")

    single = keyed.filter("alone").select("file", "key", "head_block", F.col("line").alias("record"))
    parts = keyed.filter("NOT alone").groupBy("file", "key", "head_block").agg(F.array_sort(F.collect_list(F.struct("block", "no", "line"))).alias("lines"))
    several = parts.select("file", "key", "head_block", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    records = single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record != ''")
    # The header is the first record of the first split in which one begins.
    heads = records.filter("key.block = head_block").groupBy("file").agg(F.min("key.no").alias("head_no"))
    named = records.join(heads, "file", "left")
    return named.select("record", ((F.col("key.block") == F.col("head_block")) & (F.col("key.no") == F.col("head_no"))).alias("header"))


def read_csv_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header CSV with quoted line breaks, split across tasks; the rows of ``files.read_csv``.

    Without a schema every column is text. Rows come in no particular order.
    """
    plain = spark.read.option("header", True).options(**OPTIONS)
    fields = (plain.schema(schema) if schema else plain).csv(path).schema  # reads the head of one file at most
    wanted = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    records = csv_records(spark, path).filter(~F.col("header"))
    return records.select(F.from_csv("record", wanted.toDDL(), OPTIONS).alias("r")).select("r.*")
