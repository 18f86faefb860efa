"""Delimited files against a plain reader, cut into ranges of any size."""

import csv
import io
import random

import pytest

from tabloom.sources.records import quoted_after, read_delimited
from tabloom.sources.tables import load_dataset


def plain(text, delimiter=","):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    return [tuple((r + [""] * len(rows[0]))[: len(rows[0])]) for r in rows[1:]]


def got(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


def write(path, rows, delimiter=",", end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(rows)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(out.getvalue())
    return out.getvalue()


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    yield lambda n: [spark.conf.set(name, str(n)) for name in names]
    for name, value in zip(names, old, strict=True):
        spark.conf.set(name, value)


def table(n, seed, pieces):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))
    return [["id", "text", 'a "name"', "last"], *([str(k), cell(), cell(), "x" + cell()] for k in range(n))]


BREAKS = ["a", "b ", "\n", '"', '""', ",", "\n\n", "é", "x,\n", '",\n"']


@pytest.mark.parametrize("cut", [10, 3])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fields_across_lines_and_ranges(spark, tmp_path, ranges, cut, end):
    text = write(tmp_path / "a.csv", table(400, 1, BREAKS), end=end)
    ranges(len(text.encode()) // cut)
    df = read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "text", 'a "name"', "last"]
    assert got(df) == sorted(plain(text))


def test_a_field_over_many_ranges(spark, tmp_path, ranges):
    rows = [["k", "v"], ["1", "p,\n" * 3_000], ["2", "q"], ["3", 'r""\n' * 2_000], ["4", "s"]]
    text = write(tmp_path / "a.csv", rows)
    ranges(500)
    assert got(read_delimited(spark, str(tmp_path / "a.csv"))) == sorted(plain(text))


def test_folder_with_headers_other_delimiter_and_blank_lines(spark, tmp_path, ranges):
    (tmp_path / "d").mkdir()
    want = []
    for k in range(3):
        text = write(tmp_path / "d" / f"{k}.csv", table(60, k, [*BREAKS, ";", "|"]), delimiter="|")
        want += plain(text, "|")
    ranges(400)
    assert got(read_delimited(spark, str(tmp_path / "d"), "|")) == sorted(want)
    (tmp_path / "b.csv").write_text('\n\n"a\nb",c,c,\n\n1,"x\ny",3,4\n\n5,6\n7,8,9,10,11\n')
    df = read_delimited(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["a\nb", "c", "c.1", "Unnamed: 3"]
    assert got(df) == [("1", "x\ny", "3", "4"), ("5", "6", "", ""), ("7", "8", "9", "10")]


def test_lines_without_breaks_and_open_quotes(spark, tmp_path, ranges):
    text = write(tmp_path / "a.csv", table(300, 2, ["a", '"', '""', ",", "é "]))
    ranges(700)
    assert got(read_delimited(spark, str(tmp_path / "a.csv"))) == sorted(plain(text))
    (tmp_path / "b.csv").write_text('a,b\n1,x"y\n2,"open\n3,z\n')
    assert got(read_delimited(spark, str(tmp_path / "b.csv")))[0] == ("1", 'x"y')
    assert read_delimited(spark, str(tmp_path / "b.csv")).count() == 2


def test_types_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,note,v\n1,"caf\xe9\nau lait",2.5\n2,NA,\n'.encode("latin-1"))
    _, df = load_dataset(spark, str(tmp_path / "a.csv"), encoding="ISO-8859-1")
    assert df.dtypes == [("id", "bigint"), ("note", "string"), ("v", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "café\nau lait", 2.5), (2, None, None)]
    (tmp_path / "none.csv").write_text("\n")
    with pytest.raises(ValueError, match="no columns"):
        read_delimited(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize(("line", "quoted", "after"), [
    ("a,b", False, False), ('a,"b', False, True), ('a"b,c', False, False), ('b",c', True, False), ('b"",c', True, True), ('"a""', False, True),
    ('"a"b"c,"d', False, True), ("", True, True), ('"",""', False, False), ('""', True, True),
])
def test_quoted_after(line, quoted, after):
    assert quoted_after(line, quoted, ",") is after
