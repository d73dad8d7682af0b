import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderlens.config import SMALL
from ladderlens.sources import matrices, readers, sinks, staging

DAYS = [datetime.date(2024, 1, d) for d in range(1, 22)]


def write_days(spark, folder, days, scale=1.0):
    rows = [(f"page{k}", float(scale * (k + 1) * (1 + d.day % 3))) for d in days for k in range(6)]
    for i, d in enumerate(days):
        spark.createDataFrame(rows[6 * i : 6 * i + 6], "name string, likes double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dump-{d}.parquet")


def load(spark, folder, store):
    return staging.load(spark, folder, store, F.col("name"), F.col("likes"), 4)


def plain(days, scale=1.0):
    out = {}
    for d in days:
        week = d - datetime.timedelta(days=d.weekday())
        for k in range(6):
            out.setdefault(week, {}).setdefault(f"page{k}", 0.0)
            out[week][f"page{k}"] += scale * (k + 1) * (1 + d.day % 3)
    return {(w, e, round(v, 2), r) for w, own in out.items() for r, (e, v) in enumerate(sorted(own.items(), key=lambda x: -x[1])[:4], 1)}


def rows_of(spark, store):
    return {tuple(r) for r in staging.ranked(spark, store).collect()}


def test_late_and_changed_files(spark, tmp_path):
    folder, store = f"{tmp_path}/dumps", f"{tmp_path}/store"
    early = [d for d in DAYS if d.day not in (3, 16)]
    write_days(spark, folder, early)
    assert load(spark, folder, store) == len(early) and rows_of(spark, store) == plain(early)
    assert load(spark, folder, store) == 0
    untouched = os.path.getmtime(f"{store}/ranked/week_start=2024-01-08")
    write_days(spark, folder, [datetime.date(2024, 1, 3), datetime.date(2024, 1, 16)])
    assert load(spark, folder, store) == 2 and rows_of(spark, store) == plain(DAYS)
    assert os.path.getmtime(f"{store}/ranked/week_start=2024-01-08") == untouched
    assert load(spark, folder, store) == 0 and staging.ledger(spark, store).count() == len(DAYS)


def test_a_load_that_fails_before_its_ledger_is_done_again(spark, tmp_path, monkeypatch):
    folder, store = f"{tmp_path}/dumps", f"{tmp_path}/store"
    write_days(spark, folder, DAYS[:5])

    def fail(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(staging, "append_periods", fail)
        with pytest.raises(OSError):
            load(spark, folder, store)
    assert load(spark, folder, store) == 5 and rows_of(spark, store) == plain(DAYS[:5])


def test_other_days_files_are_never_opened(spark, tmp_path):
    folder = f"{tmp_path}/dumps"
    write_days(spark, folder, DAYS)
    own = readers.sampled_dumps(spark, folder, 4, 42)
    days = {r["file_date"] for r in own.select("file_date").distinct().collect()}
    assert len(days) == 4 and days == {r["file_date"] for r in readers.sampled_dumps(spark, folder, 4, 42).collect()}
    opened = {os.path.basename(os.path.dirname(p)) for p in own.inputFiles()}
    assert opened == {f"dump-{d}.parquet" for d in days}
    for d in set(DAYS) - days:  # what isn't chosen may even be broken
        for name in os.listdir(f"{folder}/dump-{d}.parquet"):
            if name.endswith(".parquet"):
                with open(f"{folder}/dump-{d}.parquet/{name}", "wb") as f:
                    f.write(b"broken")
    assert readers.sampled_dumps(spark, folder, 4, 42).count() == 24


def test_matrices_come_back(spark, tmp_path):
    spark.dataSource.register(matrices.WeekdayMatrices)
    path = f"{tmp_path}/m"
    rows = [(w, i, j, i * j + 1, 0.25 * j) for w in ("Monday", "Sunday") for i in range(1, 30) for j in range(1, 4)]
    df = spark.createDataFrame(rows, matrices.SCHEMA)
    df.repartition(3, "weekday").write.format("weekday_matrices").mode("overwrite").save(path)
    read = lambda: {tuple(r) for r in spark.read.format("weekday_matrices").load(path).collect()}
    assert read() == set(rows)
    assert sorted(n for n in os.listdir(path) if n.startswith("_part")) == [] and sum(n.endswith(".npz") for n in os.listdir(path)) == 2
    monday = next(n for n in os.listdir(path) if n.startswith("Monday"))
    assert np.load(f"{path}/{monday}")["n"].sum() == sum(r[3] for r in rows if r[0] == "Monday")
    more = [("Friday", 1, 2, 3, 1.0)]
    spark.createDataFrame(more, matrices.SCHEMA).write.format("weekday_matrices").mode("append").save(path)
    assert read() == set(rows + more)
    with pytest.raises(Exception, match="repartition|already"):
        df.repartition(4).write.format("weekday_matrices").mode("append").save(path)
    assert read() == set(rows + more) and not [n for n in os.listdir(path) if n.startswith("_part")]
    spark.createDataFrame(more, matrices.SCHEMA).write.format("weekday_matrices").mode("overwrite").save(path)
    assert read() == set(more) and sum(n.endswith(".npz") for n in os.listdir(path)) == 1


def test_the_record_of_a_run(spark, tmp_path):
    path, run = f"{tmp_path}/out", sinks.RunRecord("r", SMALL)
    df = run.watch(spark.range(100).withColumn("x", F.col("id") % 7), "start", most=F.max("x"))
    run.write(run.watch(df.groupBy("x").agg(F.count("*").alias("n")), "end", n=F.sum("n")), path)
    got = {(r["frame"], r["metric"]): r["value"] for r in sinks.read_record(spark, path).collect()}
    assert got == {("start", "rows"): 100.0, ("start", "most"): 6.0, ("end", "rows"): 7.0, ("end", "n"): 100.0}
    assert '"k_head": 50' in spark.read.text(f"{path}.run").first()[0] and spark.read.parquet(path).count() == 7


def test_a_single_file(spark, tmp_path):
    path = f"{tmp_path}/one.parquet"
    for n in (10, 20):
        sinks.write_one(spark.range(n).repartition(3), path)
        assert os.path.isfile(path) and spark.read.parquet(path).count() == n and os.listdir(tmp_path).count("one.parquet.writing") == 0
