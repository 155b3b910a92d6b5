"""One large quoted CSV file read by many tasks."""

import csv
import io
import random

import pytest

from notecode.sources import split_csv, tables

HEADER = ["id", "clinical note", "das"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written(rows, line_end="\n", extra=""):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerow(HEADER)
    writer.writerows(rows)
    return out.getvalue() + extra


def random_rows(seed, n):
    draw = random.Random(seed)
    pieces = ["a", "b,c", '"', '""', "\n", "\n\n", "é", " ", '",', ',"', "NA", "x" * 40, '\n"']
    return [[str(i), "".join(draw.choices(pieces, k=draw.randrange(9))), draw.choice(["", "NA", "K1|K2"])] for i in range(n)]


@pytest.mark.parametrize("size", [17, 64, 300, 1 << 20])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_blocks_of_any_size_give_the_rows_of_one_reader(spark, tmp_path, small_blocks, size, line_end):
    rows = random_rows(size, 60)
    rows.append(["60", "inside\n" * 200 + 'of "one" note', "K1"])  # longer than several blocks
    rows += random_rows(size + 1, 20)
    (tmp_path / "notes.csv").write_text(written(rows, line_end), newline="")
    path = (tmp_path / "notes.csv").as_uri()
    expected = rows_of(tables.read_notes_csv(spark, path))
    small_blocks(size)
    assert rows_of(split_csv.read_split_csv(spark, path)) == expected
    assert len(expected) == len(rows)


def test_short_and_long_rows_and_quotes_inside_plain_fields(spark, tmp_path, small_blocks):
    extra = 'short\n\nlong,a,b,c\nlonger,a,b,c,d\n1,5" tube,x\n2,plain,7"\n3,"q\n4,r",y\n'
    (tmp_path / "notes.csv").write_text(written(random_rows(3, 10), extra=extra), newline="")
    path = (tmp_path / "notes.csv").as_uri()
    expected = rows_of(tables.read_notes_csv(spark, path))
    assert ("short", None, None) in expected and ("3", "q\n4,r", "y") in expected and ("1", '5" tube', "x") in expected
    assert not [r for r in expected if r[0].startswith("long")]
    small_blocks(11)
    assert rows_of(split_csv.read_split_csv(spark, path)) == expected


def test_several_files_and_empty_ones(spark, tmp_path, small_blocks):
    folder = tmp_path / "set"
    folder.mkdir()
    for n in range(3):
        (folder / f"part-{n}.csv").write_text(written(random_rows(n, 15)), newline="")
    (folder / "part-3.csv").write_text(written([]))
    expected = rows_of(tables.read_notes_csv(spark, folder.as_uri()))
    small_blocks(50)
    read = split_csv.read_split_csv(spark, folder.as_uri())
    assert rows_of(read) == expected and read.columns == HEADER
    assert split_csv.read_split_csv(spark, (folder / "part-3.csv").as_uri()).count() == 0
