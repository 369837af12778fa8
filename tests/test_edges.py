import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.augment import compose_description, shuffle_words
from ledgerlens.operators.columns import standardise_columns
from ledgerlens.operators.rules import map_by_rule
from ledgerlens.sources import csv as io_csv
from ledgerlens.taxonomy import RETAILER_SUB_RULES


def test_merge_file_count_bounds(spark, write_text):
    paths = [write_text(f"f{i}.csv", "Description,Category,Sub_Category\nx,y,z\n") for i in range(9)]
    with pytest.raises(ValueError):
        io_csv.merge_sources(spark, paths[:1])
    with pytest.raises(ValueError):
        io_csv.merge_sources(spark, paths)
    assert io_csv.merge_sources(spark, paths[:2]).count() == 2
    assert io_csv.merge_sources(spark, paths[:8]).count() == 8


def test_header_by_name_and_na_tokens(spark, write_text):
    p = write_text("odd.csv", "Subcategory,Tok-Cat,description,CATEGORY\nN/A,,Shop,NA\nGym,,Club,Home\n")
    rows = io_csv.read_ledger(spark, p).orderBy("_pos").collect()
    assert [(r.Description, r.Category, r.Sub_Category) for r in rows] == [
        ("Shop", None, None), ("Club", "Home", "Gym")]
    with pytest.raises(ValueError):
        io_csv.read_csv(spark, write_text("x.txt", "a\n1\n"))


def test_bad_date_fails_blank_is_null(spark, write_text):
    ok = write_text("ok.csv", "Description,Category,Sub_category,Price,Date\na,b,c,1.5,9/2/2023\n"
                              "a,b,c,2,2023-09-03\n,,,,\n")
    got = [r.Date for r in io_csv.read_dated(spark, ok).collect()]
    assert [str(d) if d else None for d in got] == ["2023-09-02", "2023-09-03", None]
    bad = write_text("bad.csv", "Description,Category,Sub_category,Price,Date\na,b,c,1,31/31/2023\n")
    with pytest.raises(Exception):
        io_csv.read_dated(spark, bad).collect()


def test_compose_null_propagates(spark):
    df = spark.createDataFrame([("n", "a", "c", "ci", "co", "p"), ("n", None, "c", "ci", "co", "p")],
                               "name string, address string, categories string, city string, "
                               "country string, province string")
    got = [r[0] for r in df.select(compose_description(*df.columns)).collect()]
    assert got == ["n a n c n ci co p co", None]


def test_standardise_rejects_two_description_columns(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`Product Name` string, Description string, Category string")
    with pytest.raises(ValueError):
        standardise_columns(df)


def test_shuffle_words_doubles_and_permutes(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, "")], "k int, Description string")
    out = shuffle_words(df, "k").collect()
    assert len(out) == 4
    shuffled = {r.k: r.Description for r in out if r.is_augmented}
    assert sorted(shuffled[1].split()) == sorted("one two three four".split())
    assert shuffled[2] == ""


def test_retailer_rules_first_match(spark):
    df = spark.createDataFrame([("Home|Furniture|Sofas",), ("Baby|Diapering|Wipes",),
                                ("Electronics|Computers",), ("Garden",)], "path string")
    got = [r.target for r in map_by_rule(df, "path", RETAILER_SUB_RULES).collect()]
    assert got == ["Furniture/Appliances", "Baby", "Electronics", None]


def test_source_name_from_file_metadata(spark, write_text):
    p = write_text("Food - Fast Food.v2.csv", "Description,Category,Sub_Category\nx,y,z\n")
    got = io_csv.read_csv(spark, p).select(io_csv.source_name_col().alias("s")).first().s
    assert got == "Food - Fast Food"
    assert io_csv.source_name_of(p) == "Food - Fast Food"
