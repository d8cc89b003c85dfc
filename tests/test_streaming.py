"""Running metrics over files that come in any order."""

import datetime

import pytest

from vesselspark.streaming import metrics as sm

SCHEMA = "ts timestamp, epoch string, case_id long, name string, value double, n long"


def rows_of(day, cases, value):
    ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    return [(ts, f"e{day // 10}", c, name, value + c, 1 + c % 3) for c in cases for name in ("seg_dice", "loss")]


@pytest.mark.parametrize("newest_first", [True, False])
def test_late_files_give_the_batch_result(spark, tmp_path, newest_first):
    files = [rows_of(0, range(5), 0.5), rows_of(25, range(4), 2.0), rows_of(9, range(5, 9), 1.0) + rows_of(0, [1, 2], 0.5)]
    order = sorted(range(3), key=lambda i: files[i][0][0], reverse=newest_first)
    for step, i in enumerate(order):
        spark.createDataFrame(files[i], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{step}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {(r["epoch"], r["name"]): r["value"] for r in sm.run_available(sm.running_epoch_metrics(stream), ["epoch", "name"]).collect()}
    batch = spark.createDataFrame(sum(files, []), SCHEMA)
    want = {(r["epoch"], r["name"]): r["value"] for r in sm.running_epoch_metrics(batch).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {r["name"]: (r["best"], r["case_id"]) for r in sm.run_available(sm.best_so_far(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))), ["name"]).collect()}
    assert best == {"seg_dice": (9.0, 8), "loss": (9.0, 8)}
