import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vesselspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


def points(spark, traces, case_id=1):
    """Traces given as lists of (x, y, z) or (x, y, z, rad)."""
    rows = [
        (case_id, t, i, float(p[0]), float(p[1]), float(p[2]), float(p[3]) if len(p) > 3 else 1.0)
        for t, pts in enumerate(traces) for i, p in enumerate(pts)
    ]
    return spark.createDataFrame(rows, "case_id long, trace_id long, seq long, x double, y double, z double, rad double")


def walk(seed, n, case_id=1, trace_id=0, scale=1.0):
    import numpy as np

    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.integers(-2, 3, size=(n, 3)) / 2 * scale, axis=0) + 20
    rad = rng.uniform(0.5, 3.0, n).round(1)
    return [(case_id, trace_id, i, *map(float, at[i]), float(rad[i])) for i in range(n)]


SCHEMA = "case_id long, trace_id long, seq long, x double, y double, z double, rad double"
