"""Ledgers on shared storage: nested folders, months, order, sums, versions."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rollup, summary
from ledgerlens.operators.rank import global_rank
from ledgerlens.sources import csv as io_csv
from ledgerlens.sources import ledgers, versions
from ledgerlens.taxonomy import SUMMARY_TAXONOMY

HEAD = "Description,Category,Sub_Category\n"


def test_nested_folders_are_read(spark, tmp_path):
    (tmp_path / "sub" / "deeper").mkdir(parents=True)
    (tmp_path / "year=2024").mkdir()
    (tmp_path / "a.csv").write_text(HEAD + "a,Home,Rent\n")
    (tmp_path / "sub" / "b.csv").write_text("Sub_Category,Description,Category\nRent,b,Home\n")
    (tmp_path / "sub" / "deeper" / "C [1] {x}.CSV").write_text(HEAD + "c,Home,Rent\n")
    (tmp_path / "year=2024" / "d+e f.csv").write_text(HEAD + "d,Home,Rent\n")
    (tmp_path / "sub" / "notes.txt").write_text("x\ny\n")
    (tmp_path / "sub" / "empty.csv").write_text("")
    rows = io_csv.read_ledger(spark, str(tmp_path)).collect()
    assert {(r.Description, r.Category, r.Sub_Category, r._source) for r in rows} == {
        ("a", "Home", "Rent", "a"), ("b", "Home", "Rent", "b"), ("c", "Home", "Rent", "C [1] {x}"),
        ("d", "Home", "Rent", "d+e f")}
    with_year = io_csv.read_ledger(spark, str(tmp_path / "year=2024"), extra=["year"])
    assert [(r.Description, r.year) for r in with_year.collect()] == [("d", "2024")]
    with pytest.raises(KeyError, match="year"):
        io_csv.read_ledger(spark, str(tmp_path), extra=["year"])


def test_headers_by_a_spark_job(spark, tmp_path, monkeypatch):
    """Every file is a partition; the driver opens none."""
    for i in range(30):
        (tmp_path / f"f{i}.csv").write_text(
            (HEAD if i % 2 else "Category,Description,Sub_Category\n") + "x,y,z\n" * 50)
    monkeypatch.setattr("builtins.open", lambda *a, **k: pytest.fail("the driver opened a file"))
    groups = io_csv.header_groups(spark, str(tmp_path))
    monkeypatch.undo()
    assert sorted(len(files) for _, files in groups) == [15, 15]
    assert {h for h, _ in groups} == {HEAD.strip(), "Category,Description,Sub_Category"}
    # the caller's session keeps its settings
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1"


LEDGER = "Description string, Category string, Sub_category string, Price decimal(20,6), Date date"


def random_ledger(spark, n=400, seed=1):
    rng = random.Random(seed)
    cats = [*SUMMARY_TAXONOMY, "Elsewhere", None]
    rows = []
    for i in range(n):
        cat = rng.choice(cats)
        subs = [*SUMMARY_TAXONOMY.get(cat, []), "unlisted", None, cat]
        day = dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(-40, 400))
        rows.append((f"d{i}", cat, rng.choice(subs), Decimal(rng.randrange(-5000, 9000)) / 1000,
                     day if rng.random() > 0.03 else None))
    return rows, spark.createDataFrame(rows, LEDGER)


DAY = dt.date(2023, 9, 15)


def test_a_month_reads_one_folder(spark, tmp_path):
    rows, led = random_ledger(spark)
    path = ledgers.write_by_month(led, str(tmp_path / "led"))
    back = ledgers.read_by_month(spark, path)
    assert back.count() == len(rows)
    month = ledgers.period_rows(back, DAY, "month")
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan.replace("isnotnull(month#", "month#") \
        or "PartitionFilters: [isnotnull(month" in plan
    read = {f.split("month=")[1][:7] for f in month.inputFiles()}
    assert read == {"2023-09"} or len({f for f in month.select(
        F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1
    want = sum(r[3] for r in rows if r[4] and (r[4].year, r[4].month) == (2023, 9))
    assert month.agg(F.sum("Price")).first()[0] == want
    year = ledgers.period_rows(back, DAY, "year")
    assert year.count() == sum(r[4] is not None and r[4].year == 2023 for r in rows)


def test_a_corrected_month_replaces_that_month_alone(spark, tmp_path):
    rows, led = random_ledger(spark)
    path = ledgers.write_by_month(led, str(tmp_path / "led"))
    fixed = led.withColumn("Price", F.lit("1.5").cast("decimal(20,6)"))
    ledgers.write_by_month(fixed, path, months=["2023-09"])
    back = {r.Description: r for r in ledgers.read_by_month(spark, path).collect()}
    assert len(back) == len(rows)
    for name, _, _, price, day in rows:
        changed = day is not None and (day.year, day.month) == (2023, 9)
        assert back[name].Price == (Decimal("1.5") if changed else price)
        assert back[name].month == (day.strftime("%Y-%m") if day else "none")


def test_part_files_hold_the_order(spark, tmp_path):
    df = spark.range(0, 5000, numPartitions=7).select(
        F.col("id"), F.md5(F.col("id").cast("string")).alias("Description"),
        F.lit("c").alias("Category"), F.lit("s").alias("Sub_Category"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")             # small data would be put into one task
    path = ledgers.write_in_order(df, str(tmp_path / "out.csv"), ["Description"])
    spark.conf.set(key, "true")
    led = io_csv.read_ledger(spark, path, extra=["id"])
    got = global_rank(led, ["_pos"], "n").orderBy("n").collect()
    assert [r.Description for r in got] == sorted(r.Description for r in df.collect())
    assert len({r._pos.file for r in got}) > 1          # no single task wrote them all


def expected_nodes(rows):
    """The summary by plain loops."""
    out = {}
    for period, inside in (("month", lambda d: (d.year, d.month) == (2023, 9)),
                           ("year", lambda d: d.year == 2023)):
        use = [r for r in rows if r[4] is not None and inside(r[4])]
        out[period, "total", ""] = sum((r[3] for r in use), Decimal(0))
        for cat, subs in SUMMARY_TAXONOMY.items():
            mine = [r for r in use if r[1] == cat]
            total = sum(r[3] for r in mine)
            if not total:
                continue
            out[period, "category", cat] = total
            for sub in subs:
                value = sum(r[3] for r in mine if r[2] == sub)
                if value:
                    label = f"{sub} (sub)" if sub == cat else sub
                    out[period, "sub_category", f"{cat}/{label}"] = value
    return {k: v.quantize(Decimal("0.01"), "ROUND_HALF_EVEN") for k, v in out.items()}


def nodes(df):
    return {(r.period, r.kind, r.node_id): r.value for r in df.collect()}


def test_summary_in_one_scan(spark):
    rows, led = random_ledger(spark)
    assert nodes(rollup.summary_nodes(led, SUMMARY_TAXONOMY, DAY)) == expected_nodes(rows)
    none = nodes(rollup.summary_nodes(led, SUMMARY_TAXONOMY, dt.date(1999, 1, 1)))
    assert none == {("month", "total", ""): 0, ("year", "total", ""): 0}
    plan = rollup._folded(led.select(F.col("Category").alias("category"),
                                     F.col("Sub_category").alias("sub_category"),
                                     F.col("Price").alias("amount"), F.col("Date").alias("on")),
                          rollup.taxonomy_df(spark, SUMMARY_TAXONOMY), DAY, F.col("amount"),
                          F.col("on"))._jdf.queryExecution().executedPlan().toString()
    # one scan and one shuffle of the ledger; the other is the taxonomy's distinct
    assert plan.count("Scan ExistingRDD[Description") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_sums_follow_appends_and_corrections(spark, tmp_path):
    path = str(tmp_path / "sums")
    rows, led = random_ledger(spark)
    assert rollup.read_sums(spark, path).count() == 0
    old, new = rows[:250], rows[250:]
    frame = lambda part: spark.createDataFrame(part, LEDGER)
    rollup.add_batch(rollup.partial_sums(frame(old)), path, "old")
    for _ in range(2):                                   # a job that ran twice
        rollup.add_batch(rollup.partial_sums(frame(new)), path, "new")
    assert nodes(rollup.summary_of_sums(rollup.read_sums(spark, path), SUMMARY_TAXONOMY, DAY)) \
        == expected_nodes(rows)
    gone, moved = rows[:40], [(a, "Home", "Rent", p, dt.date(2023, 9, 9))
                              for a, _, _, p, _ in rows[40:60]]
    rollup.add_batch(rollup.merge_sums(
        rollup.partial_sums(frame(rows[:60]), sign=-1), rollup.partial_sums(frame(moved))),
        path, "fixes")
    now = moved + rows[60:]
    for _ in range(2):
        sums = rollup.read_sums(spark, path)
        assert nodes(rollup.summary_of_sums(sums, SUMMARY_TAXONOMY, DAY)) == expected_nodes(now)
        full = rollup.partial_sums(frame(now)).orderBy("month", "category", "sub_category")
        assert sums.orderBy("month", "category", "sub_category").collect() == full.collect()
        rollup.compact(spark, path)
    assert len(gone) == 40


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "model")
    assert versions.committed(spark, path) is None

    def write(value):
        return lambda folder: spark.createDataFrame([(value,)], "v int").write.parquet(folder)

    def read():
        return spark.read.parquet(versions.committed(spark, path)).first().v

    assert versions.publish(spark, path, write(1)) == 1
    with pytest.raises(RuntimeError):
        def dies(folder):
            write(2)(folder)
            raise RuntimeError("lost")
        versions.publish(spark, path, dies)
    assert read() == 1
    # a second writer that took the next number first
    def slow(folder):
        versions.publish(spark, path, write(3))
        write(4)(folder)
    assert versions.publish(spark, path, slow) == 3
    assert read() == 4
    assert spark.read.parquet(versions.committed(spark, path, 2)).first().v == 3
    versions.drop_old(spark, path, keep=1)
    assert read() == 4 and versions.committed(spark, path, 2) is None


def test_a_model_is_replaced_as_a_whole(spark, tmp_path):
    from ledgerlens.operators import naive_bayes as nb
    from ledgerlens.sources.models import load_nb
    path = str(tmp_path / "nb")
    one = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "l string, t array<string>")
    nb.fit(one, "l", "t").save(path)
    first = load_nb(spark, path)
    nb.fit(one.where("l = 'a'"), "l", "t").save(path)
    assert first.tokens.count() == first.token_rows      # still there for who has it
    assert load_nb(spark, path).classes.count() == 1
    with pytest.raises(FileNotFoundError):
        load_nb(spark, str(tmp_path / "none"))


def test_keep_first_by_position_on_a_stream(spark, tmp_path):
    """The smallest position stays though it comes last; later rows are repeats;
    the state goes."""
    from ledgerlens.streaming.first import keep_first_stream
    schema = "Description string, Category string, Price decimal(20,6), n long, t timestamp"
    batches = [
        [("a", "x", "1.5", 7, "10:00"), ("b", None, None, 3, "10:01"), ("a", "y", "2", 9, "10:02")],
        [("a", "x", "1.25", 2, "10:03"), ("b", None, "9", 8, "09:59"), ("c", "x", "1", 5, "10:04")],
        [("z", "z", "0", 100, "14:00")],
        [("z", "z", "0", 101, "14:10"), ("a", "x", "7", 1, "14:05")],
        [("z", "z", "0", 102, "23:00")], [("z", "z", "0", 103, "23:30")],
        [("b", None, "8", 50, "23:40")], [("end", "", "0", 104, "23:59")], [("end", "", "0", 105, "23:59")]]
    rows = []
    for i, batch in enumerate(batches):
        part = [(d, c, None if p is None else Decimal(p), n,
                 dt.datetime.fromisoformat(f"2023-09-01 {t}:00.123456")) for d, c, p, n, t in batch]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
        rows += part
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    out = keep_first_stream(stream, ["Description", "Category"], "n", "t", delay="30 minutes",
                            hold_ms=6 * 3_600_000)
    q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
         .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted(((r.Description, r.Category, r.Price, r.n, r.t)
                  for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()),
                 key=lambda r: r[3])
    by_n = {r[3]: r for r in rows}
    # 2, not 7 (position) nor 1 (came after the time was over, in the time the key is
    # remembered); 50 came after that
    assert [r for r in got if r[0] in "abc"] == [by_n[2], by_n[3], by_n[5], by_n[9]]
