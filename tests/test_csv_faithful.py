"""Ledgers as they are: quotes, edge spaces, line breaks, mixed headers."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import csv as io_csv


def test_doubled_quotes_and_commas(spark, write_text):
    p = write_text("q.csv", 'Description,Category,Sub_Category\n'
                            '"Kit 5"" pipe, steel",Home,Tools\n"back\\slash \\"" x",a,b\n')
    got = [(r.Description, r.Category, r.Sub_Category)
           for r in io_csv.read_ledger(spark, p).orderBy("_pos").collect()]
    assert got == [('Kit 5" pipe, steel', "Home", "Tools"), ('back\\slash \\" x', "a", "b")]


def test_mixed_headers_in_one_folder(spark, tmp_path):
    folder = tmp_path / "ledgers"
    folder.mkdir()
    (folder / "a.csv").write_text("Description,Category,Sub_Category\nlandlord,Home,Rent\n")
    (folder / "b.v2.csv").write_text("Category,Sub_Category,Description\nHome,Rent,landlord\n")
    (folder / "c.csv").write_text("﻿subcategory,other,DESCRIPTION,category\nRent,1,landlord,Home\n")
    (folder / "empty.csv").write_text("")
    (folder / "notes.txt").write_text("not a ledger\n")
    rows = io_csv.read_ledger(spark, str(folder)).collect()
    assert {(r.Description, r.Category, r.Sub_Category) for r in rows} == {
        ("landlord", "Home", "Rent")}
    assert sorted(r._source for r in rows) == ["a", "b", "c"]


def test_missing_column_names_the_file(spark, write_text):
    p = write_text("short.csv", "Description,Category\nx,y\n")
    with pytest.raises(KeyError, match="Sub_Category"):
        io_csv.read_ledger(spark, p)
    with pytest.raises(FileNotFoundError):
        io_csv.read_ledger(spark, os.path.dirname(p) + "/none.csv")


def test_values_come_back_unchanged(spark, tmp_path):
    values = ["Baby ", " lead", 'say ""hi""', 'a "b", c', "two\nlines\r\nthree", "back\\slash\\",
              "tab\tinside", ",", '"', "  "]
    df = spark.createDataFrame([(i, v, "c", "s") for i, v in enumerate(values)],
                               "key int, Description string, Category string, Sub_Category string")
    path = io_csv.write_csv(df, str(tmp_path / "out.csv"))
    back = io_csv.read_ledger(spark, path, extra=["key"], multi_line=True)
    got = {int(r.key): r.Description for r in back.collect()}
    assert got == dict(enumerate(values))
    assert {r._source for r in back.collect()} == {"out"}


def test_dates_with_a_time_and_own_patterns(spark):
    df = spark.createDataFrame([("9/2/2023",), ("2023-09-02",), ("2023-09-02 10:11:12",),
                                ("2023-09-02T10:11:12",), ("9/2/2023 7:05",)], "d string")
    assert {str(r[0]) for r in df.select(io_csv.parse_date("d")).collect()} == {"2023-09-02"}
    own = spark.createDataFrame([("02.09.2023",)], "d string")
    assert str(own.select(io_csv.parse_date("d", ["dd.MM.yyyy"])).first()[0]) == "2023-09-02"


def test_sub_cent_prices_are_rounded_after_the_sum(spark, write_text):
    import datetime as dt
    from decimal import Decimal
    from ledgerlens.operators import summary
    p = write_text("p.csv", "Description,Category,Sub_category,Price,Date\n"
                            "a,Food,x,0.004,9/2/2023\nb,Food,x,0.004,9/2/2023\n"
                            "c,Food,y,0.125,9/2/2023\n")
    led = io_csv.read_dated(spark, p)
    day = dt.date(2023, 9, 15)
    total = summary.mtd_total(led.where("Sub_category = 'x'"), day).first()[0]
    assert total == Decimal("0.01")
    assert summary.mtd_total(led.where(F.col("Sub_category") == "y"), day).first()[0] \
        == Decimal("0.12")
