"""CSV with line ends in quotes, cut into many byte ranges, against a plain reader."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import types as T

from postlake.sources import csv_split

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def table(n, seed):
    rnd = random.Random(seed)
    words = ["x", "", "two words", 'a "quote"', "line\nend", "a,b", "\n", '"', "é", "\r\n in it", "long " * 400, "many\nlines\n" * 60]
    return [(str(i), rnd.choice(words), rnd.choice(words)) for i in range(n)]


def read(spark, path, **options):
    return sorted([tuple(r) for r in csv_split.rows(spark, path, SCHEMA, **options).collect()], key=str)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("ranges", ["700", "20000", "100000000"])
def test_ranges(spark, tmp_path, ranges, ending):
    data = table(900, len(ranges))
    for name, part in (("one", data[:500]), ("two", data[500:])):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ending, quoting=csv.QUOTE_ALL)
        writer.writerows([("a", "b\nof header", "c"), *part])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", ranges)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert read(spark, str(tmp_path)) == sorted(data, key=str)
        if ranges == "20000":
            assert csv_split.records(spark, str(tmp_path)).count() == 900
            sizes = [os.path.getsize(tmp_path / f) for f in ("one.csv", "two.csv")]
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= sum(sizes) // 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_record_over_many_ranges(spark, tmp_path):
    data = [("1", "x", "y"), ("2", "no quote in it\n" * 3_000, "z"), ("3", '"\n' * 2_000, "end"), ("4", "", "last")]
    with open(tmp_path / "f.csv", "w", newline="") as file:
        csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([("a", "b", "c"), *data])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert read(spark, str(tmp_path)) == sorted(data, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b,c\n1,5" pipe,x\n\n2,,""\n3,"a"" b",y', newline="")
    assert read(spark, str(tmp_path)) == [("1", '5" pipe', "x"), ("2", None, ""), ("3", 'a" b', "y")]
    (tmp_path / "f.csv").write_text("")
    assert read(spark, str(tmp_path)) == []
    (tmp_path / "f.csv").write_text("1,2,3\n")
    assert read(spark, str(tmp_path), header=False) == [("1", "2", "3")]
