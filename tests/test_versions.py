"""Tables in several part files, and what a broken write leaves behind."""

import pytest
from pyspark.sql import functions as F

from seqloom.sources import delimited, sinks, versions


def read(spark, path):
    return delimited.named(*delimited.scan(spark, path))


def test_parts_have_one_header_and_running_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/t.tsv"
    df = spark.range(10).select("id", F.concat(F.lit("line\n"), "id").alias("text")).repartitionByRange(3, "id")
    sinks.write_table(df, path, ["id", "text"])
    rows = read(spark, path).orderBy("_row").collect()
    assert [(r._row, r.id, r.text) for r in rows] == [(i, str(i), f"line\n{i}") for i in range(10)]
    assert delimited.count_rows(spark, path) == 10
    sinks.write_table(df.where("id < 0"), path, ["id", "text"])
    assert read(spark, path).count() == 0 and delimited.scan(spark, path)[0] == ["id", "text"]


def test_a_broken_write_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t.tsv"
    sinks.write_table(spark.range(5), path, ["id"])
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_table(broken, path, ["id"])
    assert {r.id for r in read(spark, path).collect()} == set("01234")


def test_backup_and_pinned_readers(spark, tmp_path):
    path = f"file://{tmp_path}/t.tsv"
    sinks.write_table(spark.range(2), path, ["id"])
    pinned = read(spark, path)
    sinks.replace_table(pinned.withColumn("id", F.concat("id", F.lit("x"))), path, ["id"])
    assert {r.id for r in read(spark, path).collect()} == {"0x", "1x"} and {r.id for r in pinned.collect()} == {"0", "1"}
    versions.restore(spark, path)
    assert {r.id for r in read(spark, path).collect()} == {"0", "1"}
    assert versions.current(spark, path, backup=True) != versions.current(spark, path)
    sinks.write_table(spark.range(7, 8), path, ["id"])
    assert len([x for x in (tmp_path / "t.tsv").iterdir() if x.name.startswith("v-")]) == 2


def test_a_foreign_file_keeps_its_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("3,4\n\n5,\n")
    rows = delimited.named(*delimited.scan(spark, f"file://{tmp_path}", ",")).orderBy("_row").collect()
    assert [(r.a, r.b) for r in rows] == [("1", "2"), ("3", "4"), ("5", "")]
