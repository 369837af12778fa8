"""Spending summaries on the dated sample ledger."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixture_rows import GRAPH_TEST_CSV
from ledgerlens.operators import summary
from ledgerlens.sources import csv as io_csv
from ledgerlens.taxonomy import SUMMARY_TAXONOMY

AS_OF = dt.date(2023, 9, 15)


@pytest.fixture
def ledger(spark, write_text):
    return io_csv.read_dated(spark, write_text("GraphTest.csv", GRAPH_TEST_CSV))


def _one(df):
    return df.first()[0]


def test_rows_by_month(ledger):
    assert ledger.count() == 105
    by = {(r.y, r.m): r.n for r in ledger.groupBy(
        F.year("Date").alias("y"), F.month("Date").alias("m")).agg(F.count("*").alias("n")).collect()}
    assert by == {(2023, 1): 24, (2023, 8): 4, (2023, 9): 76, (None, None): 1}


@pytest.mark.parametrize("as_of,mtd,ytd", [
    (AS_OF, "5958.35", "10591.35"),
    (dt.date(2023, 1, 15), "4579.84", "10591.35"),
    (dt.date(2024, 1, 1), "0.00", "0.00"),
])
def test_totals(ledger, as_of, mtd, ytd):
    assert _one(summary.mtd_total(ledger, as_of)) == Decimal(mtd)
    assert _one(summary.ytd_total(ledger, as_of)) == Decimal(ytd)
    both = summary.spend_totals(ledger, as_of).first()
    assert (both.mtd_total, both.ytd_total) == (Decimal(mtd), Decimal(ytd))


CAT_VALUES = {
    "Auto": ("530.43", "530.43"), "Baby": ("199.67", "199.67"),
    "Clothes": ("664.65", "689.39"), "Electronics": ("135.99", "135.99"),
    "Entertainment": ("120.98", "120.98"), "Food": ("1048.24", "5086.83"),
    "Home": ("1798.31", "1816.14"), "Personal_Care": ("322.05", "322.05"),
    "Pets": ("40.99", "396.91"), "Subscriptions_Memberships": ("20.99", "216.91"),
    "Travel": ("1029.83", "1029.83"),
}


@pytest.mark.parametrize("period,col,total", [("month", 0, "5912.13"), ("year", 1, "10545.13")])
def test_tree(ledger, period, col, total):
    nodes = summary.spend_tree(ledger, SUMMARY_TAXONOMY, AS_OF, period).collect()
    cats = {n.label: n.value for n in nodes if n.parent == ""}
    subs = [n for n in nodes if n.parent != ""]
    assert len(cats) == 11 and len(subs) == 25
    assert sum(cats.values()) == Decimal(total)
    assert cats == {k: Decimal(v[col]) for k, v in CAT_VALUES.items()}
    # every child's parent is a kept category
    assert {n.parent for n in subs} <= set(cats)
    if period == "month":
        clothes = [n for n in subs if n.label == "Clothes (sub)"]
        assert len(clothes) == 1 and clothes[0].value == Decimal("23.14")


def test_labels(ledger):
    r = summary.summary_labels(ledger, AS_OF).first()
    assert r.mtd_title == "Spending in September"
    assert r.ytd_title == "Spending for 2023"
    assert r.mtd_label == "$5958.35" and r.ytd_label == "$10591.35"


def test_tree_edges(spark):
    rows = [
        ("a", "Food", "Groceries", Decimal("10.00"), dt.date(2023, 9, 1)),
        ("b", "Food", "Groceries", Decimal("-10.00"), dt.date(2023, 9, 2)),   # Food sums to 0
        ("c", "Food", "FastFood_Restaurants", Decimal("5.00"), dt.date(2023, 9, 2)),
        ("d", "Food", "FastFood_Restaurants", Decimal("-5.00"), dt.date(2023, 9, 2)),
        ("e", "Clothes", "Clothes", Decimal("7.50"), dt.date(2023, 9, 3)),    # label (sub)
        ("f", "Clothes", "Unlisted", Decimal("2.50"), dt.date(2023, 9, 3)),   # parent only
        ("g", "Clothes", None, Decimal("1.00"), dt.date(2023, 9, 3)),        # parent only
        ("h", "Baby ", "Diapers", Decimal("3.00"), dt.date(2023, 9, 3)),      # trailing space
        ("i", "Home", "Rent", Decimal("4.00"), dt.date(2023, 8, 31)),         # other month
    ]
    led = spark.createDataFrame(
        rows, "Description string, Category string, Sub_category string, Price decimal(18,2), Date date")
    nodes = {(n.parent, n.label): n.value for n in
             summary.spend_tree(led, SUMMARY_TAXONOMY, AS_OF, "month").collect()}
    assert nodes == {("", "Clothes"): Decimal("11.00"),
                     ("Clothes", "Clothes (sub)"): Decimal("7.50")}
