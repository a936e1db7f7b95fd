"""CSV as labelled lines."""

import csv

import pytest

from tallyloom.sources import tables


def read(spark, path, **options):
    return [(r["row"], r["line"]) for r in tables.csv_lines(spark, str(path), **options).orderBy("file", "row").collect()]


@pytest.fixture(params=[None, "40"], ids=["one block", "small blocks"])
def blocks(spark, request):
    """Whether a file is read in one block or in many."""
    if request.param:
        before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        for k in before:
            spark.conf.set(k, request.param)
    yield
    if request.param:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cells_past_64_and_line_breaks_in_quotes_stay(spark, tmp_path, blocks):
    wide = [f"v{i}" for i in range(800)]
    records = [["a", "", " b "], ["two\nlines", 'say "x", y'], wide, ["x" * 90 + "\n\n" + "y" * 90, "end"], ["last", "\n,\n\"\n"]]
    with open(tmp_path / "a.csv", "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows(records)
    got = read(spark, tmp_path / "a.csv")
    assert [n for n, _ in got] == [1, 2, 3, 4, 5]
    assert [x for _, x in got[:2]] == ["Row 1 | A1: a | C1: b", 'Row 2 | A2: two\nlines | B2: say "x", y']
    assert got[2][1].startswith("Row 3 | A3: v0 | ") and got[2][1].endswith(" | ADT3: v799") and " | BM3: v64 | " in got[2][1] and got[2][1].count(" | ") == 800
    assert got[3][1] == "Row 4 | A4: " + "x" * 90 + "\n\n" + "y" * 90 + " | B4: end"
    assert got[4][1] == 'Row 5 | A5: last | B5: ,\n"'


def test_every_file_has_its_own_numbers(spark, tmp_path, blocks):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("".join(f'{name}{i},"q\n{i}"\n' for i in range(30)))
    assert read(spark, tmp_path) == [(i + 1, f"Row {i + 1} | A{i + 1}: {name}{i} | B{i + 1}: q\n{i}") for name in "ab" for i in range(30)]


def test_what_would_be_cut_is_an_error(spark, tmp_path):
    (tmp_path / "many.csv").write_text("a\n" * 4)
    assert len(read(spark, tmp_path / "many.csv", max_records=4)) == 4
    with pytest.raises(ValueError, match="more than 3 records"):
        read(spark, tmp_path / "many.csv", max_records=3)
    (tmp_path / "open.csv").write_text('a,"b\nc\n')
    with pytest.raises(ValueError, match="not closed"):
        read(spark, tmp_path / "open.csv")
    (tmp_path / "wide.csv").write_text("," * tables.MAX_COLUMNS + "x\n")
    with pytest.raises(Exception, match="cells in row 1"):
        read(spark, tmp_path / "wide.csv")


def test_labels_are_those_of_columns(spark):
    at = [0, 25, 26, 701, 702, 1377, 1378, 18277]
    labels = [r[0] for r in spark.createDataFrame([(i,) for i in at], "i long").select(tables.column_label(tables.F.col("i"))).collect()]
    assert [tables._label(i) for i in at] == labels == ["A", "Z", "AA", "ZZ", "AAA", "AZZ", "BAA", "ZZZ"]


@pytest.mark.parametrize("line,open_,after", [('a,"b', False, True), ('5" pipe', False, False), ('"a""', False, True), ('"a"",b', False, True), ('x",y', True, False), ('x","y', True, True), ("", True, True), ("", False, False), ('a"b,"c"', False, False)])
def test_quotes(line, open_, after):
    assert tables.quote_open(line, open_) is after
