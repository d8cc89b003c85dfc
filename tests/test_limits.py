"""Filters at their limits."""

import random

from pyspark.sql import functions as F

from vesselspark.operators import traces


def test_a_mean_at_the_limit_does_not_depend_on_partitions(spark):
    # All means are the limit up to rounding; the sum in order decides.
    rng = random.Random(5)
    limit, rows = 1.95, []
    while len(rows) < 40 * 60:
        rad = [0.5 + rng.randrange(30) / 10 for _ in range(40)]
        gap = round(limit * 40 * 10) - sum(round(r * 10) for r in rad)
        if abs(gap) < 12 and 5 <= round(rad[0] * 10) + gap <= 34:
            rad[0] = 0.5 + (round(rad[0] * 10) + gap - 5) / 10
            rows += [(1, len(rows) // 40, i, r) for i, r in enumerate(rad)]
    want = set()
    for t in range(len(rows) // 40):
        total = 0.0
        for r in rows[t * 40:t * 40 + 40]:
            total += r[3]
        if total / 40 <= limit:
            want.add(t)
    p = spark.createDataFrame(rows, "case_id long, trace_id long, seq long, rad double")
    assert 0 < len(want) < len(rows) // 40
    for n in (1, 7):
        dealt = p.orderBy(F.xxhash64("seq", F.lit(n))).repartition(n)
        assert {r["trace_id"] for r in traces.remove_large(dealt, limit).collect()} == want
