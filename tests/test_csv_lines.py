"""Split reading of CSV files with line breaks in quotes, against Spark's multi-line reader and Python's ``csv``."""

import csv
import io
import random

import pytest

from callsight.sources import files as Y
from callsight.sources.csvlines import lines_with_state, read_csv_lines


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def made_rows(rng, n):
    parts = ["a", "b c", "\n", '"', '""', ",", "é中", " ", "x" * 40, '",', ',"', "\n\n", '"\n"']
    return [[str(i), *("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(2))] for i in range(n)]


def write(path, rows, quoting=csv.QUOTE_MINIMAL, end="\n", header=("id", "one", "two")):
    out = io.StringIO()
    w = csv.writer(out, quoting=quoting, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_of_the_plain_reader(spark, small_splits, tmp_path, quoting, end):
    rng = random.Random(f"{quoting}{end}")
    for k in range(2):
        write(tmp_path / f"part{k}.csv", made_rows(rng, 120), quoting, end)
    path = str(tmp_path)
    got = read_csv_lines(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert got.columns == ["id", "one", "two"] and rows_of(got) == rows_of(Y.read_csv(spark, path))


def test_values_of_python(spark, small_splits, tmp_path):
    rows = made_rows(random.Random(3), 200)
    write(tmp_path / "a.csv", rows)
    got = {r.id: (r.one, r.two) for r in read_csv_lines(spark, str(tmp_path / "a.csv")).collect()}
    want = {r[0]: tuple(x or None for x in r[1:]) for r in rows}
    assert {k: tuple(x or None for x in v) for k, v in got.items()} == want


def test_quotes_inside_plain_fields(spark, small_splits, tmp_path):
    """A quote that does not open its field is a character like any other, however many there are."""
    text = "id,one,two\n" + "".join(f'{i},{i}" pipe,"line\nbreak ""{i}"""\n' for i in range(80))
    (tmp_path / "a.csv").write_text(text)
    got = rows_of(read_csv_lines(spark, str(tmp_path / "a.csv")))
    want = sorted((tuple(r) for r in list(csv.reader(io.StringIO(text)))[1:]), key=str)
    assert got == want


def test_state_of_every_line(spark, small_splits, tmp_path):
    rng = random.Random(8)
    write(tmp_path / "a.csv", made_rows(rng, 150))
    data = (tmp_path / "a.csv").read_text()
    inside, want = False, []
    for line in data.split("\n")[:-1]:
        want.append((line, inside))
        i, start = 0, not inside
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
            elif c == '"' and start:
                inside = True
            start = not inside and c == ","
            i += 1
    got = [(r.line, r.inside) for r in lines_with_state(spark, str(tmp_path / "a.csv")).orderBy("block", "no").collect()]
    assert got == want


def test_schema_short_rows_and_empty_lines(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('call_id,n\nc1,1\n\nc2\n"c\n3",3,more\n')
    path = str(tmp_path / "a.csv")
    want = sorted([("c\n3", 3), ("c1", 1), ("c2", None)], key=str)
    assert rows_of(read_csv_lines(spark, path, "call_id STRING, n INT")) == want == rows_of(Y.read_csv(spark, path, "call_id STRING, n INT"))
    (tmp_path / "empty.csv").write_text("call_id,n\n")
    assert read_csv_lines(spark, str(tmp_path / "empty.csv")).count() == 0


def test_one_field_larger_than_many_splits(spark, small_splits, tmp_path):
    rows = [["1", "first\n" * 500, "x"], ["2", "", 'say "hi"\n' * 300], ["3", "end", "end"]]
    write(tmp_path / "a.csv", rows)
    got = {r.id: (r.one or "", r.two) for r in read_csv_lines(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in rows}
