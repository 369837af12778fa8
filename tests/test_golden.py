"""Golden values from the reference's sample ledgers (rows carried inline)."""

import csv
import io

from pyspark.sql import functions as F

from fixture_rows import DECOR_CSV, FAST_FOOD_CSV, FINISHED_CSV
from ledgerlens.functions.text import clean_text
from ledgerlens.operators.dedupe import dedupe_first
from ledgerlens.sources import csv as io_csv


def _finished_descriptions():
    rows = list(csv.DictReader(io.StringIO(FINISHED_CSV)))
    return [r["Description"] for r in rows]


def test_merge_dedupe_clean_equals_finished(spark, write_text):
    a = write_text("Food - Fast Food.csv", FAST_FOOD_CSV)
    b = write_text("Decor Stores.csv", DECOR_CSV)
    merged = io_csv.merge_sources(spark, [a, b])
    assert merged.count() == 220
    first = dedupe_first(merged, ["Description", "Category"], "_pos")
    assert first.count() == 140
    cleaned = first.select(clean_text("Description").alias("d"), "_pos").orderBy("_pos")
    got = [r.d for r in cleaned.collect()]
    want = _finished_descriptions()
    assert len(want) == 140
    assert got == want
    assert got.count("cheesecake factory") == 2


def test_fast_food_keep_first(spark, write_text):
    p = write_text("Food - Fast Food.csv", FAST_FOOD_CSV)
    led = io_csv.read_ledger(spark, p)
    assert led.count() == 200
    assert dedupe_first(led, ["Description", "Category"], "_pos").count() == 120
    assert led.select("_source").distinct().first()[0] == "Food - Fast Food"
    # unlabelled: both label columns are all null
    assert led.filter(F.col("Category").isNotNull()).count() == 0


def test_prediction_file_reads_back(spark, write_text):
    p = write_text("finished.csv", FINISHED_CSV)
    back = io_csv.read_predictions(spark, p)
    assert back.columns[:3] == ["Description", "Category", "Sub_Category"]
    assert back.count() == 140
