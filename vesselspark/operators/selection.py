"""Choice of traces by clustering of their points, each case by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g
from ..plans.casework import by_size, in_cases
from ..plans.grid import PAIRS, near_groups, within
from ..session import stored
from .matching import AT
from .traces import KEYS, POS

CENTRE = ["kx", "ky", "kz"]


def cluster_centres(points: DataFrame, k: int) -> DataFrame:
    """(case_id, cluster, kx, ky, kz): ``k`` means of the points of every case.

    Starts at the least position, then the position farthest from the centres so far
    (ties: the least); assignment and means alternate, all cases in one job, until no centre
    moves.  A case with fewer distinct positions has fewer clusters.
    """
    p = stored(points.select("case_id", *POS), "positions")
    here = F.struct(*POS)
    centres = p.groupBy("case_id").agg(F.min(here).alias("c")).select("case_id", F.lit(0).alias("cluster"), *[F.col(f"c.{c}").alias(n) for c, n in zip(POS, CENTRE)])
    centres = stored(centres, "centres")
    away = g.dist(g.vec(*POS), g.vec(*CENTRE))
    for i in range(1, k):
        d = p.distinct().join(centres, "case_id").groupBy("case_id", *POS).agg(F.min(away).alias("d")).where("d > 0")
        far = d.groupBy("case_id").agg(F.min(F.struct((-F.col("d")).alias("d"), *POS)).alias("c"))
        new = far.select("case_id", F.lit(i).alias("cluster"), *[F.col(f"c.{c}").alias(n) for c, n in zip(POS, CENTRE)])
        centres = stored(centres.unionByName(new), "centres")
    while True:
        near = p.distinct().join(centres, "case_id").groupBy("case_id", *POS).agg(F.min(F.struct(away.alias("d"), "cluster")).alias("m"))
        near = near.select("case_id", *POS, F.col("m.cluster").alias("cluster"))
        means = p.join(near, ["case_id", *POS]).groupBy("case_id", "cluster").agg(*[F.round(F.avg(c), 9).alias(n) for c, n in zip(POS, CENTRE)])
        means = stored(means, "centres")
        moved = means.join(centres.toDF("case_id", "cluster", "ox", "oy", "oz"), ["case_id", "cluster"], "left")
        still = F.lit(True)
        for a, b in zip(CENTRE, ("ox", "oy", "oz")):
            still = still & (F.abs(F.col(a) - F.col(b)) < 1e-6)
        centres = means
        if moved.where(~F.coalesce(still, F.lit(False))).isEmpty():
            return centres


def _away(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = p - c
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])


def _centres(p: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """``cluster_centres`` of the positions of a case."""
    if not len(p):
        return {}
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0]))
    p = p[order]
    centres = {0: p[0]}
    for i in range(1, k):
        d = np.min([_away(p, c) for c in centres.values()], axis=0)
        far = int(d.argmax())  # the least position of equally far ones
        if d[far] > 0:
            centres[i] = p[far]
    while True:
        names = sorted(centres)
        near = np.asarray(names)[np.argmin([_away(p, centres[n]) for n in names], axis=0)]
        means = {}
        for n in names:
            if (near == n).any():
                m = p[near == n].mean(axis=0)
                means[n] = np.copysign(np.floor(np.abs(m) * 1e9 + 0.5) / 1e9, m)
        still = all((np.abs(m - centres[n]) < 1e-6).all() for n, m in means.items())
        centres = means
        if still:
            return centres


def _near_any(q: np.ndarray, t: np.ndarray, r: float) -> np.ndarray:
    """Which of the positions ``q`` have one of ``t`` nearer than ``r``: tight boxes decide, points only where these leave it open."""
    out = np.zeros(len(q), bool)
    if not len(q) or not len(t):
        return out
    at = np.floor(t / (r / 4))
    order = np.lexsort(at.T)
    at, t = at[order], t[order]
    start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
    low, high = np.minimum.reduceat(t, start), np.maximum.reduceat(t, start)
    ask, step = [], max(1, PAIRS // len(start))
    for a in range(0, len(q), step):
        under, over = low - q[a:a + step, None], q[a:a + step, None] - high
        most, least = np.maximum(-under, -over), np.maximum(np.maximum(under, over), 0)
        # A margin keeps rounding out of the bounds.
        sure = (_away(most, 0.0) < r * (1 - 1e-9)).any(axis=1)
        out[a:a + step] = sure
        ask.append(a + np.flatnonzero(~sure & (_away(least, 0.0) < r * (1 + 1e-9)).any(axis=1)))
    ask = np.concatenate(ask)
    for i, _, _ in within(t)(q[ask], np.full(len(ask), r)):
        out[ask[i]] = True
    return out


def _selection(k: int, most: float, every: int = 5) -> Callable[[pa.Table], Iterator[dict]]:
    """``central_traces`` and ``grown`` on the points of a case: (trace_id, failed, cluster, round); ``_in`` tells points that centres come from."""

    def run(table: pa.Table) -> Iterator[dict]:
        table = table.sort_by([("trace_id", "ascending"), ("seq", "ascending")])
        ids, seq = table["trace_id"].to_numpy(), table["seq"].to_numpy()
        p = np.stack([table[c].to_numpy().astype(float) for c in POS], axis=1)
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        size = np.diff(np.append(start, len(ids)))
        of = np.repeat(np.arange(len(start)), size)
        fine = np.isfinite(p).all(axis=1)
        mean = np.add.reduceat(p[:, :2], start) / size[:, None]
        centres = _centres(p[table["_in"].to_numpy(zero_copy_only=False) & fine], k)
        free, picked = np.ones(len(start), bool), {}
        for i in sorted(centres):
            cost = np.minimum.reduceat(np.where(fine, _away(p, centres[i]), np.inf), start) / size
            cost[~free] = np.inf
            best = int(cost.argmin())
            if cost[best] < most:
                picked[best] = i
                free &= ~(np.hypot(*(mean - mean[best]).T) < most)
                free[of[fine][_near_any(p[fine], p[fine & (of == best)], most)]] = False
        failed = k - len(picked) > 1
        turn, n = np.full(len(start), -1), 0
        if not failed:
            turn[list(picked)] = 0
            sample = np.flatnonzero(fine & ((seq % every == 0) | (seq == np.repeat(np.maximum.reduceat(seq, start), size))))
            while (turn == n).any():
                ask = sample[turn[of[sample]] < 0]
                turn[of[ask[_near_any(p[ask], p[fine & (turn[of] == n)], most)]]] = n + 1
                n += 1
        else:
            picked = {}
        cluster = [picked.get(t) for t in range(len(start))]
        yield {
            "trace_id": table["trace_id"].combine_chunks().take(pa.array(start)), "failed": pa.array([failed] * len(start)),
            "cluster": pa.array(cluster, pa.int32()), "round": pa.array(turn, pa.int32(), mask=turn < 0),
        }

    return run


def grown(points: DataFrame, start: DataFrame, r: float = 25.0, every: int = 5) -> DataFrame:
    """Traces (case_id, trace_id, round) that a search reaches from the traces of ``start``; these have round 0.

    Breadth first: a trace is reached if one of its sampled points, every fifth and the last, is
    nearer than ``r`` to any point of a trace of the round before.  The frontier is a set of traces
    whose points are summed up in cells; no list of trace pairs is made, and rounds follow the
    longest way, not the number of traces.
    """
    last = points.groupBy(*KEYS).agg(F.max("seq").alias("_last"))
    some = points.join(last, KEYS).where((F.col("seq") % every == 0) | (F.col("seq") == F.col("_last")))
    waiting = stored(some.select(*KEYS, *[F.col(c).alias(q) for c, q in zip(POS, AT)]), "samples")
    front = stored(start.select(*KEYS).distinct().withColumn("round", F.lit(0)), "front")
    found, n = front, 0
    while True:
        n += 1
        near = near_groups(waiting.join(found.select(*KEYS), KEYS, "left_anti"), points.join(front.select(*KEYS), KEYS, "left_semi"), r, AT, KEYS)
        front = stored(near.withColumn("round", F.lit(n)), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def central_traces(points: DataFrame, k: int, most: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """(case_id, cluster, trace_id): the trace of each cluster centre, NULL where a centre has none.

    Cluster by cluster the free trace with the least (distance of its nearest point / point count)
    to the centre is taken if that is below ``most`` (ties: the lower trace).  Traces nearer than ``most`` to it, by points or
    by 2-D centroids, are no longer free.  Centres come from points with ``low`` <= z <= ``high``.
    """
    inside = points
    if low is not None:
        inside = inside.where(F.col("z") >= low)
    if high is not None:
        inside = inside.where(F.col("z") <= high)
    centres = cluster_centres(inside, k)
    size = points.groupBy(*KEYS).agg(F.count("*").alias("np"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    traces = stored(size, "traces")
    away = F.min(g.dist(g.vec(*POS), g.vec(*CENTRE))).alias("d")
    cost = points.join(centres, "case_id").groupBy(*KEYS, "cluster").agg(away)
    free = stored(cost.join(traces, KEYS).select(*KEYS, "cluster", (F.col("d") / F.col("np")).alias("cost")), "costs")
    asked = points.select(*KEYS, *[F.col(c).alias(q) for c, q in zip(POS, AT)])
    chosen = None
    for i in range(k):
        best = free.where(F.col("cluster") == i).groupBy("case_id").agg(F.min(F.struct("cost", "trace_id")).alias("m")).where(F.col("m.cost") < most)
        new = stored(best.select("case_id", F.lit(i).alias("cluster"), F.col("m.trace_id").alias("trace_id")), "chosen")
        chosen = new if chosen is None else chosen.unionByName(new)
        mid = traces.join(new.select(*KEYS), KEYS).select("case_id", F.col("mx").alias("ox"), F.col("my").alias("oy"))
        flat = traces.join(mid, "case_id").where(F.hypot(F.col("mx") - F.col("ox"), F.col("my") - F.col("oy")) < most).select(*KEYS)
        close = near_groups(asked, points.join(new.select(*KEYS), KEYS, "left_semi"), most, AT, KEYS)
        free = stored(free.join(flat.unionByName(close).distinct(), KEYS, "left_anti"), "costs")
    every = points.select("case_id").distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.join(chosen, ["case_id", "cluster"], "left")


def select_traces(points: DataFrame, k: int = 2, most: float = 25.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Label traces of every case: 0 chosen for a cluster centre, 1 reached from the chosen ones, -1 not reached.

    ``cluster`` names the centre of a chosen trace, ``round`` the step in which a trace was reached.
    Cases with fewer than three traces stay 0.  Where two or more centres find no trace the
    selection has failed and labels are NULL.  Cases with few enough points go through all steps in a task each.
    """
    size = points.groupBy(*KEYS).agg(F.count("*").alias("np")).withColumn("traces", F.count("*").over(Window.partitionBy("case_id")))
    traces = stored(size, "traces")
    some = stored(points.join(traces.where("traces >= 3").select(*KEYS), KEYS, "left_semi").select(*KEYS, "seq", *POS), "points")
    inside = F.lit(True)
    if low is not None:
        inside = inside & F.coalesce(F.col("z") >= low, F.lit(False))
    if high is not None:
        inside = inside & F.coalesce(F.col("z") <= high, F.lit(False))
    small, large = by_size(some)
    found = in_cases(small.withColumn("_in", inside), _selection(k, most), f"trace_id {dict(some.dtypes)['trace_id']}, failed boolean, cluster int, round int")
    if large is not None:
        some = stored(some.join(large, "case_id", "left_semi"), "points")
        pick = stored(central_traces(some, k, most, low, high), "picked")
        failed = pick.groupBy("case_id").agg((F.sum(F.col("trace_id").isNull().cast("int")) > 1).alias("failed"))
        chosen = pick.join(failed.where("not failed"), "case_id", "left_semi").where("trace_id is not null")
        rest = some.select(*KEYS).distinct().join(failed, "case_id", "left").join(chosen, KEYS, "left").join(grown(some, chosen, most), KEYS, "left")
        found = found.unionByName(rest.select(*found.columns))
    out = traces.join(found, KEYS, "left")
    label = F.when(F.col("traces") < 3, 0).when(F.col("failed"), F.lit(None)).when(F.col("cluster").isNotNull(), 0).when(F.col("round").isNotNull(), 1).otherwise(-1)
    return out.select(*KEYS, label.alias("label"), "cluster", "round")
