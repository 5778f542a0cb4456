"""Delimited files whose cells hold line ends, read in small byte ranges."""

import csv
import random

import pytest

from seqloom.sources import delimited

CELLS = ["a", "b", " ", "\n", '"', ",", "\r\n", "xyz", "é", '""', ",\n"]
FILES = "spark.sql.files."


def rows(spark, path, sep=","):
    header, df = delimited.scan(spark, f"file://{path}", sep)
    return header, sorted(map(tuple, df.collect()))


@pytest.fixture(params=[32, 64, 200])
def small_ranges(spark, request):
    names = {"maxPartitionBytes": request.param, "openCostInBytes": 0, "minPartitionNum": 1}
    for k, v in names.items():
        spark.conf.set(FILES + k, str(v))
    yield request.param
    for k in names:
        spark.conf.unset(FILES + k)


def test_byte_ranges_read_as_the_csv_module_does(spark, tmp_path, small_ranges):
    rng, expected = random.Random(small_ranges), []
    for name, n, head in (("a.csv", 50, True), ("b.csv", 0, True), ("c.csv", 25, False), ("d.csv", 40, True)):
        cells = [[f"r{i}", *("".join(rng.choices(CELLS, k=rng.randint(0, 9))) for _ in range(2))] for i in range(n)]
        with open(tmp_path / name, "w", newline="", encoding="utf8") as out:
            csv.writer(out, lineterminator="\n").writerows([["a", "b", "c"]] * head + cells)
        expected += cells
    assert len(list(tmp_path.iterdir())) == 4
    header, found = rows(spark, tmp_path)
    assert header == ["a", "b", "c"] and found == [(i, *r) for i, r in enumerate(expected)]


def test_a_row_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "line, with \"quotes\"\n" * 60
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["id", "text"], ["1", long], ["2", "x"], ["3", long], ["4", ""]])
    assert rows(spark, tmp_path / "a.csv")[1] == [(0, "1", long), (1, "2", "x"), (2, "3", long), (3, "4", "")]


def test_stray_quotes_blank_lines_and_an_open_end(spark, tmp_path, small_ranges):
    path = tmp_path / "a.csv"
    path.write_text('\ufeff"a",b,c\n\n1,2"x"y,"3\n\n4"\n,,\n5,in"side\n\n7,"8"z,9\r\n"",,x\n', encoding="utf8")
    assert rows(spark, path) == (["a", "b", "c"], [(0, "1", '2"x"y', "3\n\n4"), (2, "5", 'in"side', ""), (3, "7", '"8"z', "9"), (4, "", "", "x")])
    path.write_text('a,b\n1,"2\n3,4\n5,6\n')
    assert [r[:2] for r in rows(spark, path)[1]] == [(0, "1")]
    path.write_text('\n\na,b\n1,"2\n\n\n3"\n\r\n\n4,5\n\n' + "\n" * 150 + "6,7\n", newline="")
    assert rows(spark, path) == (["a", "b"], [(0, "1", "2\n\n\n3"), (1, "4", "5"), (2, "6", "7")])
    path.write_text('a\tb\n1\t"2,\t\n3"\n4\t5,"\n')
    assert rows(spark, path, "\t")[1] == [(0, "1", "2,\t\n3"), (1, "4", '5,"')]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert rows(spark, tmp_path / "a.csv") == ([], [])
    (tmp_path / "a.csv").write_text("a,b\n")
    assert rows(spark, tmp_path / "a.csv") == (["a", "b"], [])
    (tmp_path / "a.csv").write_text("\n\r\na,b\n\n")
    assert rows(spark, tmp_path / "a.csv") == (["a", "b"], [])
