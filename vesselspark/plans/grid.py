"""Joins by nearness in space, as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

XYZ = ("x", "y", "z")
# Rows of one cell that a single task may hold before the cell is split.
CELL_ROWS = 200_000
# A list of crowded cells is broadcast only up to this many rows.
BROADCAST_ROWS = 100_000
# Distances that a task holds at once.
PAIRS = 1 << 20
# Boxes' cells along the edge of a cell in which boxes meet.
WIDE = 8


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def reach(df: DataFrame, at: Sequence[str], r: float, cell: float) -> DataFrame:
    """One copy of each row per grid cell its ball of radius ``r`` touches."""
    for axis, c in zip(XYZ, at):
        df = df.withColumn(
            f"_c{axis}",
            F.explode(F.sequence(F.floor((F.col(c) - r) / cell), F.floor((F.col(c) + r) / cell))),
        )
    return df


def _split_crowded(queries: DataFrame, targets: DataFrame, on: list[str], limit: int, salt: str = "_salt"):
    crowded = (
        targets.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        .select(*on, F.ceil(F.col("_n") / limit).alias("_pieces"))
    )
    found = crowded.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return queries, targets, on
    if found <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    pieces = F.coalesce("_pieces", F.lit(1))
    targets = targets.join(crowded, on, "left").withColumn(
        salt, F.pmod(F.xxhash64(*targets.columns), pieces)
    ).drop("_pieces")
    queries = queries.join(crowded, on, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1))
    ).drop("_pieces")
    return queries, targets, [*on, salt]


def near_pairs(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    at: Sequence[str],
    keys: Sequence[str] = ("case_id",),
    where: Column | None = None,
    closed: bool = False,
    cell: float | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """All (query, target) rows closer than ``r``, with their ``dist``.

    Queries name their position by ``at``; targets by x, y, z.  All other column
    names must differ, apart from ``keys``.  Cells are ``2r`` wide, so a query
    is copied to at most eight of them.  Crowded cells are split into salted
    pieces; the queries that touch one visit every piece.
    """
    cell = cell or 2.0 * r
    spread = reach(queries, at, r, cell)
    placed = targets.withColumns({f"_c{c}": F.floor(F.col(c) / cell) for c in XYZ})
    on = [*keys, "_cx", "_cy", "_cz"]
    spread, placed, on = _split_crowded(spread, placed, on, cell_rows)
    dist = distance([F.col(c) for c in at], [F.col(c) for c in XYZ])
    joined = spread.join(placed, on).withColumn("dist", dist)
    joined = joined.where(F.col("dist") <= r if closed else F.col("dist") < r)
    if where is not None:
        joined = joined.where(where)
    return joined.drop("_cx", "_cy", "_cz", "_salt")


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    at: Sequence[str],
    qid: Sequence[str],
    ties: Sequence[str],
    keep: Sequence[str] = (),
    keys: Sequence[str] = ("case_id",),
    where: Column | None = None,
    closed: bool = False,
    group: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The closest target of each query (and ``group``), misses left out.

    The minimum is an aggregate, so candidates are reduced before they are shuffled.
    """
    pairs = near_pairs(queries, targets, r, at, keys, where, closed, cell_rows=cell_rows)
    first = ["dist", *ties, *keep]
    best = pairs.groupBy(*qid, *group).agg(F.min(F.struct(*first)).alias("_m"))
    return best.select(*qid, *group, *[F.col(f"_m.{c}").alias(c) for c in first])


def nearest_staged(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    at: Sequence[str],
    qid: Sequence[str],
    ties: Sequence[str],
    keep: Sequence[str] = (),
    keys: Sequence[str] = ("case_id",),
    where: Column | None = None,
    share: float = 0.25,
) -> DataFrame:
    """``nearest`` in two passes: queries that find a target within ``share * r`` are done.

    Same result: whatever lies beyond cannot be closer.  Where points are dense, most
    queries compare with a small neighbourhood only.
    """
    from ..session import stored

    close = stored(nearest(queries, targets, share * r, at, qid, ties, keep, keys, where), "near")
    rest = queries.join(close.select(*qid), list(qid), "left_anti")
    return close.unionByName(nearest(rest, targets, r, at, qid, ties, keep, keys, where))


def nearest_growing(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    at: Sequence[str],
    qid: Sequence[str],
    ties: Sequence[str],
    keys: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Closest target at any distance: double the radius for queries still open.

    A query whose key has no target at all is dropped before the first round.
    """
    from ..session import stored

    left = stored(queries.join(targets.select(*keys).distinct(), list(keys), "left_semi"), "open")
    done = None
    while left.limit(1).count():
        hit = stored(nearest(left, targets, r, at, qid, ties, keys=keys), "near")
        done = hit if done is None else done.unionByName(hit)
        left = stored(left.join(hit.select(*qid), list(qid), "left_anti"), "open")
        r *= 2.0
    if done is None:
        done = nearest(left, targets, r, at, qid, ties, keys=keys)
    return done


def _distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    d = q[:, None, :] - t[None, :, :]
    return np.sqrt(d[:, :, 0] * d[:, :, 0] + d[:, :, 1] * d[:, :, 1] + d[:, :, 2] * d[:, :, 2])


def _as_named(kind: pa.DataType) -> pa.DataType:
    """The type as a schema in text names it: every field of a struct may be null."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _as_named(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _as_named(kind.value_type)))
    return kind


def nearest_in_groups(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    at: Sequence[str],
    qid: Sequence[str],
    tie: str,
    group: str,
    own: str,
    same: bool,
    keys: Sequence[str] = ("case_id",),
    closed: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The closest target of each query in every ``group`` but its ``own`` one, or (``same``) in its own only: (qid, group, dist, tie).

    Queries are distinct by ``qid``.  Of equally close targets the one with the least ``tie`` counts.  A query stays in its cell and targets are copied to the cells
    that their ball touches, so a query meets all its targets in one place; there the distances are numpy
    arrays of bounded size, and no pair is a row.  Cells with too many targets or queries are split.
    """
    cell = 3.0 * r
    cells = [f"_c{c}" for c in XYZ]
    finite = lambda names: reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in names])
    q = queries.where(finite(at)).select(*dict.fromkeys([*keys, *qid, own]), *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(at)])
    q = q.withColumns({c: F.floor(F.col(f"_q{i}") / cell) for i, c in enumerate(cells)})
    t = targets.where(finite(XYZ)).select(*keys, *XYZ, F.col(group).alias("_group"), F.col(tie).alias("_tie"))
    t = reach(t, XYZ, r, cell).withColumns({c: F.col(c).cast("double") for c in XYZ})
    on = [*keys, *cells]
    q, t, on = _split_crowded(q, t, on, cell_rows)
    parts = "_salt" in on
    # A query may find a row in each group, so that fewer of them make up a piece.
    t, q, on = _split_crowded(t, q, on, max(1, cell_rows // 10), "_part")
    qid, spot = list(qid), [f"_q{i}" for i in range(3)]
    types = {f.name: f.dataType.simpleString() for f in q.schema} | {f.name: f.dataType.simpleString() for f in t.schema}
    # The group's column may be named like a query column: it is set apart until the end.
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in qid], f"_group {types['_group']}", "dist double", f"_tie {types['_tie']}"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("_group", "ascending"), ("_tie", "ascending")])
        take, put, dist = [], [], []
        if left.num_rows and right.num_rows:
            tp = np.stack([right[c].to_numpy() for c in XYZ], axis=1)
            qp = np.stack([left[c].to_numpy() for c in spot], axis=1)
            names = right["_group"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            stop = np.append(start[1:], len(names))
            mine = left[own].to_numpy()
            near = (lambda d: d <= r) if closed else (lambda d: d < r)
            if same:
                order = np.argsort(mine, kind="stable")
                lo, hi = np.searchsorted(mine[order], names[start], "left"), np.searchsorted(mine[order], names[start], "right")
                jobs = [(order[a:b], s, e) for a, b, s, e in zip(lo, hi, start, stop) if b > a]
            else:
                jobs = [(np.arange(len(qp)), 0, len(tp))]
            for rows, s, e in jobs:
                step = max(1, PAIRS // (e - s))
                for k in range(0, len(rows), step):
                    some = rows[k:k + step]
                    d = _distances(qp[some], tp[s:e])
                    if same:
                        best = d.argmin(axis=1)
                        least = d[np.arange(len(some)), best]
                        ok = np.flatnonzero(near(least))
                        take.append(some[ok]), put.append(s + best[ok]), dist.append(least[ok])
                    else:
                        least = np.minimum.reduceat(d, start, axis=1)
                        ok = near(least) & (names[start][None, :] != mine[some][:, None])
                        first = np.where(d == np.repeat(least, stop - start, axis=1), np.arange(e - s), e - s)
                        first = np.minimum.reduceat(first, start, axis=1)
                        i, j = np.nonzero(ok)
                        take.append(some[i]), put.append(first[i, j]), dist.append(least[i, j])
        whole = lambda parts_, kind: np.concatenate(parts_) if parts_ else np.empty(0, kind)
        out = left.select(qid).take(pa.array(whole(take, np.int64)))
        hit = right.select(["_group", "_tie"]).take(pa.array(whole(put, np.int64)))
        out = out.append_column("_group", hit["_group"]).append_column("dist", pa.array(whole(dist, float))).append_column("_tie", hit["_tie"])
        return out.cast(pa.schema([pa.field(f.name, _as_named(f.type)) for f in out.schema]))

    # Both sides may stem from one frame: named anew, their columns are told apart.
    q, t = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (q, t))
    out = q.groupBy(*on).cogroup(t.groupBy(*on)).applyInArrow(run, schema)
    if parts:  # targets of one cell stood in several pieces
        out = out.groupBy(*qid, "_group").agg(F.min(F.struct("dist", "_tie")).alias("_m")).select(*qid, "_group", "_m.*")
    names = [] if group in qid else [F.col("_group").alias(group)]
    return out.select(*qid, *names, "dist", F.col("_tie").alias(tie))


def within(targets: np.ndarray):
    """``search(q, r)`` for a table of positions in memory: arrays (i, j, dist) of bounded size, every target j nearer than r[i] to q[i].

    Targets are sorted by cells a little wider than the ball, one set of cells for each power of two that radii reach, so that a query meets
    the targets of eight cells at most.
    """
    made: dict[int, tuple] = {}

    def cells(power: int) -> tuple:
        if power not in made:
            width = 2.02 * 2.0 ** power
            at = np.floor(targets / width)
            axes, codes = zip(*(np.unique(at[:, i], return_inverse=True) for i in range(3)))
            key = (codes[0] * len(axes[1]) + codes[1]) * len(axes[2]) + codes[2]
            order = np.argsort(key, kind="stable")
            keys, start = np.unique(key[order], return_index=True)
            made[power] = width, axes, order, keys, start, np.append(start[1:], len(order)) - start
        return made[power]

    def search(q: np.ndarray, r: np.ndarray):
        some = np.flatnonzero(np.isfinite(q).all(axis=1) & np.isfinite(r) & (r > 0)) if len(targets) else np.empty(0, np.int64)
        powers = np.ceil(np.log2(r[some])).astype(np.int64)
        for power in np.unique(powers):
            rows = some[powers == power]
            width, axes, order, keys, start, size = cells(int(power))
            far = r[rows, None] * (1 + 1e-6)  # a little more keeps rounding out of the reach
            low, high = np.floor((q[rows] - far) / width), np.floor((q[rows] + far) / width)
            for corner in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)):
                code, ok = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                for i, second in enumerate(corner):
                    at = high[:, i] if second else low[:, i]
                    spot = np.minimum(np.searchsorted(axes[i], at), len(axes[i]) - 1)
                    ok &= axes[i][spot] == at
                    if second:
                        ok &= high[:, i] > low[:, i]
                    code = code * len(axes[i]) + spot
                spot = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                ok &= keys[spot] == code
                mine, spot = rows[ok], spot[ok]
                count = size[spot]
                total = np.cumsum(count)
                begin = 0
                while begin < len(mine):
                    end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
                    n = count[begin:end]
                    i = np.repeat(mine[begin:end], n)
                    j = order[np.repeat(start[spot[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    d = q[i] - targets[j]
                    d = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
                    near = d < r[i]
                    yield i[near], j[near], d[near]
                    begin = end

    return search


def near_groups(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    at: Sequence[str],
    group: Sequence[str],
    keys: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Groups of queries (distinct ``keys`` and ``group``) with a row nearer than ``r`` to some target.

    Both sides are summed up in boxes, one for each cell of half the radius (and group).  Two boxes that are
    nearer than ``r`` throughout settle the group, two that are farther apart are done; only
    boxes in between are opened, for groups that are still open: first the queries against the other box, then
    point by point.  Boxes meet in cells of four radii, so that a target's box is sent once and a query's to a few.
    """
    from ..session import stored

    side = r / 2.0
    tcell, qcell, here = [f"_t{c}" for c in XYZ], [f"_q{c}" for c in XYZ], [f"_c{c}" for c in XYZ]
    group = [*keys, *[c for c in group if c not in keys]]
    # A position that is not finite is near to nothing, and has no place in a box.
    finite = lambda names: reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in names])
    limits = lambda names, tag: [f(n).alias(f"_{tag}{k}{c}") for n, c in zip(names, XYZ) for k, f in (("lo", F.min), ("hi", F.max))]
    placed = targets.where(finite(XYZ)).select(*keys, *XYZ).withColumns({t: F.floor(F.col(c) / side) for t, c in zip(tcell, XYZ)})
    boxes = placed.groupBy(*keys, *tcell).agg(*limits(XYZ, "t")).withColumns({h: F.floor(F.col(t) / WIDE) for h, t in zip(here, tcell)})
    asked = queries.where(finite(at)).select(*group, *[F.col(a).alias(f"_a{c}") for a, c in zip(at, XYZ)])
    spots = [f"_a{c}" for c in XYZ]
    asked = asked.withColumns({q: F.floor(F.col(a) / side) for q, a in zip(qcell, spots)})
    mine = asked.groupBy(*group, *qcell).agg(*limits(spots, "q"))
    for h, c in zip(here, XYZ):
        # A little more on both sides keeps rounding out of the reach.
        low, high = F.floor((F.col(f"_qlo{c}") - r * (1 + 1e-6)) / side), F.floor((F.col(f"_qhi{c}") + r * (1 + 1e-6)) / side)
        mine = mine.withColumn(h, F.explode(F.sequence(F.floor(low / WIDE), F.floor(high / WIDE))))

    def bounds(low, high):
        near, far = F.lit(0.0), F.lit(0.0)
        for c in XYZ:
            out = F.greatest(F.col(f"_tlo{c}") - F.col(high + c), F.col(low + c) - F.col(f"_thi{c}"), F.lit(0.0))
            most = F.greatest(F.col(f"_thi{c}") - F.col(low + c), F.col(high + c) - F.col(f"_tlo{c}"))
            near, far = near + out * out, far + most * most
        # A margin keeps rounding out of the bounds: what is close to them is looked at point by point.
        return F.sqrt(near) < r * (1 + 1e-9), F.sqrt(far) < r * (1 - 1e-9)

    edge = [f"_t{k}{c}" for c in XYZ for k in ("lo", "hi")]
    maybe, surely = bounds("_qlo", "_qhi")
    met = mine.join(boxes, [*keys, *here]).where(maybe).withColumn("_sure", surely)
    met = stored(met.select(*group, *qcell, *tcell, *edge, "_sure"), "boxes-met")
    sure = met.where("_sure").select(*group).distinct()
    open_ = met.where("not _sure").drop("_sure").join(sure, group, "left_anti")
    maybe, surely = bounds("_a", "_a")
    met = open_.join(asked, [*group, *qcell]).where(maybe).select(*group, *spots, *tcell, surely.alias("_sure"))
    met = stored(met, "boxes-opened")
    also = met.where("_sure").select(*group).distinct()
    rest = met.where("not _sure").drop("_sure").join(also, group, "left_anti")
    dist = distance([F.col(c) for c in spots], [F.col(c) for c in XYZ])
    looked = rest.join(placed, [*keys, *tcell]).where(dist < r).select(*group).distinct()
    return sure.unionByName(also).unionByName(looked)
