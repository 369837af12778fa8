"""End-to-end jobs on the sample ledgers."""

import csv
import io

from pyspark.sql import functions as F

from fixture_rows import DATAS_CSV, DECOR_CSV, FAST_FOOD_CSV, GRAPH_TEST_CSV
from ledgerlens.operators.encode import classes_from_data
from ledgerlens.operators.evaluate import class_weights
from ledgerlens.plans import jobs
from ledgerlens.sources import csv as io_csv
from ledgerlens.taxonomy import MODEL_TAXONOMY, distinct_subs


def test_datas_facts(spark, write_text):
    led = io_csv.read_ledger(spark, write_text("Datas.csv", DATAS_CSV))
    assert led.count() == 474
    assert jobs.prepare(led).count() == 473
    w = {r.class_name: float(r.weight) for r in
         class_weights(led, "Category", classes_from_data(led, "Category")).collect()}
    assert abs(w["Food"] - 487 / 243) < 1e-6 and abs(w["Pets"] - 121.75) < 1e-6
    cats = set(MODEL_TAXONOMY)
    assert led.filter(~F.col("Category").isin(list(cats))).count() == 6
    assert led.filter(~F.col("Sub_Category").isin(distinct_subs(MODEL_TAXONOMY))).count() == 27


def test_train_then_predict(spark, write_text, tmp_path):
    datas = write_text("Datas.csv", DATAS_CSV)
    out = jobs.train_models(spark, datas, str(tmp_path / "models"))
    rows = list(csv.DictReader(io.StringIO(DATAS_CSV.lstrip("﻿"))))
    subs = set(distinct_subs(MODEL_TAXONOMY))
    bad = {(r["Description"], r["Category"]) for r in rows
           if r["Category"] not in MODEL_TAXONOMY or r["Sub_Category"] not in subs}
    assert out["rejects"].count() == len(bad)
    metrics = {r.head: r for r in out["metrics"].where("split = 'test'").collect()}
    assert set(metrics) == {"category", "sub_category"}
    assert 0.0 <= float(metrics["category"].accuracy) <= 1.0

    ff = write_text("Food - Fast Food.csv", FAST_FOOD_CSV)
    decor = write_text("Decor Stores.csv", DECOR_CSV)
    res = jobs.predict_ledger(spark, [ff, decor], str(tmp_path / "models"),
                              str(tmp_path / "pred.csv"))
    got = res.collect()
    assert len(got) == 140
    assert all(r.Category in MODEL_TAXONOMY and r.Sub_Category in subs for r in got)


def test_summarise_job(spark, write_text):
    import datetime as dt
    from decimal import Decimal
    out = jobs.summarise(spark, write_text("GraphTest.csv", GRAPH_TEST_CSV), dt.date(2023, 9, 15))
    t = out["totals"].first()
    assert (t.mtd_total, t.ytd_total) == (Decimal("5958.35"), Decimal("10591.35"))
    assert out["tree_ytd"].count() == 36 and out["tree_mtd"].count() == 36


def test_logistic_pipeline_save_load(spark, write_text, tmp_path):
    from ledgerlens.functions.text import clean_tokens
    from ledgerlens.operators.logistic import fit_lr, predict_lr
    from ledgerlens.sources.models import load_pipeline, save_pipeline
    led = io_csv.read_ledger(spark, write_text("Datas.csv", DATAS_CSV))
    rows = led.select("_pos", "Category", clean_tokens("Description").alias("tokens"))
    model = fit_lr(rows, "Category", "tokens", max_iter=5)
    path = save_pipeline(model, str(tmp_path / "lr"))
    a = {str(r._pos): r.pred_label for r in predict_lr(model, rows).collect()}
    b = {str(r._pos): r.pred_label for r in predict_lr(load_pipeline(path), rows).collect()}
    assert a == b and len(a) == 474


def _flags(spark, led):
    from ledgerlens.operators.split import content_key, train_test_split
    rows = jobs.prepare(led)
    keyed = rows.withColumn("_key", content_key("Raw_Description", "Category"))
    return {(r.Raw_Description, r.Category): r.is_test
            for r in train_test_split(keyed, "_key").collect()}


def test_split_does_not_depend_on_files(spark, write_text, tmp_path):
    """Same flags from one file, from a folder of many and from another path."""
    one = io_csv.read_ledger(spark, write_text("Datas.csv", DATAS_CSV))
    want = _flags(spark, one)
    assert 0 < sum(want.values()) < len(want)
    many = str(tmp_path / "elsewhere" / "many.csv")
    io_csv.write_csv(one.select("Description", "Category", "Sub_Category").repartition(7), many)
    assert _flags(spark, io_csv.read_ledger(spark, many)) == want


def test_jobs_on_a_dataframe_with_a_number_for_position(spark, write_text, tmp_path):
    """S2: train, predict and summarise from DataFrames; rows without a
    description are not learned from."""
    import datetime as dt
    led = io_csv.read_ledger(spark, write_text("Datas.csv", DATAS_CSV))
    rows = led.orderBy("_pos").select("Description", "Category", "Sub_Category").collect()
    extra = [(None, r.Category, r.Sub_Category) for r in rows[:20]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*map(tuple, rows), *extra])],
                               "_pos long, Description string, Category string, "
                               "Sub_Category string")
    out = jobs.train_models(spark, df, str(tmp_path / "a"))
    same = jobs.train_models(spark, led, str(tmp_path / "b"))
    assert sorted(map(tuple, out["metrics"].collect())) == \
        sorted(map(tuple, same["metrics"].collect()))
    assert {r.split for r in out["metrics"].collect()} == {"train", "test"}
    pred = jobs.predict_ledger(spark, df.where("Description is not null"), str(tmp_path / "a"))
    assert pred.count() == 473
    dated = spark.createDataFrame([("d", "Food", "Groceries", 1.25, dt.date(2023, 9, 1))],
                                  "Description string, Category string, Sub_category string, "
                                  "Price double, Date date")
    assert float(jobs.summarise(spark, dated, dt.date(2023, 9, 2))["totals"].first()[0]) == 1.25


def test_augmented_training_learns_more_rows(spark, write_text, tmp_path):
    datas = write_text("Datas.csv", DATAS_CSV)
    plain = jobs.train_models(spark, datas, str(tmp_path / "p"))["models"]["category"]
    more = jobs.train_models(spark, datas, str(tmp_path / "m"), augment=True)["models"]["category"]
    docs = [sum(r.n_docs for r in m.classes.collect()) for m in (plain, more)]
    assert docs[1] == 2 * docs[0] and plain.vocab_size == more.vocab_size


def test_augment_cities_job(spark, write_text, tmp_path):
    shops = write_text("shops.csv", "Description,Category,Sub_Category\nBurger,Food,Fast_Food\n"
                                    "Sofa,Home,Furniture\nBurger,Food,Fast_Food\n")
    cities = write_text("cities.csv", "city,state\n" + "".join(f"town{i},st\n" for i in range(7)))
    out = jobs.augment_cities(spark, shops, cities, str(tmp_path / "out.csv"))
    rows = [(r.Description, r.Category, r.Sub_Category) for r in out.collect()]
    assert len(rows) == 7
    assert {(d.split(" ")[0], c, s) for d, c, s in rows} == {
        ("Burger", "Food", "Fast_Food"), ("Sofa", "Home", "Furniture")}
    assert sorted(d.split(" ", 1)[1] for d, _, _ in rows) == [f"town{i} st" for i in range(7)]
    few = jobs.augment_cities(spark, shops, cities, str(tmp_path / "few.csv"), cap=3)
    assert few.count() == 3


def test_compose_job(spark, write_text, tmp_path):
    p = write_text("r.csv", "name,address,categories,city,country,province\n"
                            'Joe\'s,"1 Main St, A",Burgers,Town,US,ST\nX,,b,c,d,e\n')
    out = jobs.compose_restaurants(spark, p, str(tmp_path / "out.csv")).collect()
    assert [(r.Description, r.Category, r.Sub_Category) for r in out] == [
        ("Joe's 1 Main St, A Joe's Burgers Joe's Town US ST US", "Food", "Fast_Food")]


def test_logistic_ignores_no_token(spark):
    """Every token reaches the features, however rare."""
    from ledgerlens.operators.logistic import fit_lr
    rows = spark.createDataFrame([("a", [f"w{i}" for i in range(3000)]), ("b", ["x", "w1"])],
                                 "label string, toks array<string>")
    model = fit_lr(rows, "label", "toks", max_iter=2)
    tf = model.transform(rows).select("_tf").collect()
    assert sorted(sum(r[0].values) for r in tf) == [2.0, 3000.0]
