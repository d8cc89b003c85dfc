"""Links of trace ends carried out as edits."""

from conftest import points

from vesselspark.operators.compositions import connect_ends, join_near_ends


def line(start, step, n):
    return [tuple(float(s + d * i) for s, d in zip(start, step)) for i in range(n)]


def traces_of(df):
    out = {}
    for r in df.orderBy("trace_id", "seq").collect():
        out.setdefault(r["trace_id"], []).append((r["x"], r["y"], r["z"]))
    return out


def test_near_ends_merge_and_branch(spark):
    p = points(spark, [
        line((0, 0, 0), (1, 0, 0), 10),         # 0: its tail meets the tail of 1
        line((30, 0, 0), (-1, 0, 0), 18),       # 1: ends at x = 13
        line((15, 6, 0), (0, 1, 0), 12),        # 2: its head lies 6 beside the inside of 1, which is ahead of it
        line((22, -3, 0), (0, 1, 0), 3),        # 3: its tail points at the inside of 1; its head does not
        line((300, 0, 0), (1, 0, 0), 4),        # 4: far from all
    ])
    got = traces_of(join_near_ends(p, 7.0, gap=None))
    x = lambda *v: [(float(i), 0.0, 0.0) for i in v]
    assert got[0] == x(*range(10), *range(13, 31)) and 1 not in got
    assert got[2] == [(15.0, 0.0, 0.0)] + line((15, 6, 0), (0, 1, 0), 12)
    assert got[3] == line((22, -3, 0), (0, 1, 0), 3) + [(22.0, 0.0, 0.0)]
    assert got[4] == line((300, 0, 0), (1, 0, 0), 4) and set(got) == {0, 2, 3, 4}


def test_each_end_is_merged_once(spark):
    # Three ends within reach of each other: the nearest two merge, the third stays.
    p = points(spark, [line((0, 0, 0), (-1, 0, 0), 6), line((2, 0, 0), (1, 0, 0), 6), line((0, 3, 0), (0, 1, 0), 6)])
    got = traces_of(join_near_ends(p, 5.0, gap=None))
    assert sorted(map(len, got.values())) == [6, 12] and len(got) == 2


def test_accepted_links_are_carried_out(spark):
    bright = spark.createDataFrame([(1, x, 0, 0, 1.0) for x in range(-12, 32)] + [(1, 25, -y, 0, 1.0) for y in range(12)], "case_id long, x long, y long, z long, score double")
    p = points(spark, [line((-10, 0, 0), (1, 0, 0), 11), line((10, 0, 0), (1, 0, 0), 21), line((25, -5, 0), (0, -1, 0), 10)])
    got = traces_of(connect_ends(p, bright, gap=None))
    whole = [(float(i), 0.0, 0.0) for i in [*range(-10, 1), *range(10, 31)]]
    assert got[0] in (whole, whole[::-1]) and 1 not in got
    assert got[2] == [(25.0, 0.0, 0.0)] + line((25, -5, 0), (0, -1, 0), 10)
