"""Running products of many groups at once."""

import numpy as np
import pandas as pd

from vesselspark.operators import frames


def test_products_begin_anew_and_calls_do_not_follow_the_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(c, t, k, *rng.normal(size=9)) for c in range(3) for t in range(40) for k in range(1 + (7 * t + c) % 11)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["case_id", "trace_id", "seq", *frames.MAT]))
    keys = ["case_id", "trace_id"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for inclusive in (True, False):
            got = frames._chain(keys, "seq", inclusive)(df).toPandas().sort_values([*keys, "seq"]).reset_index(drop=True)
            want = []
            for _, g in pd.DataFrame(rows, columns=got.columns).groupby(keys):
                now = np.eye(3)
                for m in g.sort_values("seq")[frames.MAT].to_numpy().reshape(-1, 3, 3):
                    before, now = now, m @ now
                    want.append((now if inclusive else before).ravel())
            assert len(got) == len(rows) and np.allclose(got[frames.MAT].to_numpy(), np.array(want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = frames.rotation_frames(df.selectExpr("case_id", "trace_id", "seq", "m00 x", "m01 y", "m02 z"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
