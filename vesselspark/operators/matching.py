"""Joins by position: nearest points, comparison maps, sampling and painting."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from ..plans.blocks import BLOCK, running
from ..plans.cubes import AT_CUBE, by_cubes, in_cube, interpolated, positions
from ..plans.grid import near_groups, near_pairs, nearest, nearest_growing, nearest_in_groups, nearest_staged
from ..session import stored
from .traces import KEYS, POS, direction, resample

AT = ["qx", "qy", "qz"]


def as_queries(points: DataFrame, keep: Sequence[str] = (), ids: Sequence[str] = ("trace_id", "seq")) -> DataFrame:
    """Rename a point table to the query side: q_<id>, qx, qy, qz, q_<kept>."""
    return points.select(
        "case_id", *[F.col(c).alias(f"q_{c}") for c in (*ids, *keep)], *[F.col(c).alias(f"q{c}") for c in POS]
    )


def ends(points: DataFrame) -> DataFrame:
    """First and last point of every trace: ``end`` 0 = head, 1 = tail."""
    cols = [c for c in points.columns if c not in KEYS]
    both = points.groupBy(*KEYS).agg(
        F.min_by(F.struct(*cols), "seq").alias("h"), F.max_by(F.struct(*cols), "seq").alias("t"), F.max("seq").alias("last_seq")
    )
    pair = F.explode(F.array(
        F.struct(F.lit(0).alias("end"), *[F.col(f"h.{c}").alias(c) for c in cols]),
        F.struct(F.lit(1).alias("end"), *[F.col(f"t.{c}").alias(c) for c in cols]),
    ))
    return both.select(*KEYS, "last_seq", pair.alias("e")).select(*KEYS, "last_seq", "e.*")


def nearest_other(queries: DataFrame, points: DataFrame, r: float = 5.0, keep: Sequence[str] = ("rad",)) -> DataFrame:
    """Closest point of any other trace, strictly nearer than ``r``; ties: lowest trace, then point."""
    return nearest_staged(
        queries, points.select(*KEYS, "seq", *POS, *keep), r, AT, ["case_id", "q_trace_id", "q_seq"],
        ["trace_id", "seq"], keep, where=F.col("trace_id") != F.col("q_trace_id"),
    )


def nearest_any(queries: DataFrame, points: DataFrame, r: float = 5.0, keep: Sequence[str] = ("rad",)) -> DataFrame:
    """Closest point of another trace set."""
    return nearest_staged(
        queries, points.select(*KEYS, "seq", *POS, *keep), r, AT, ["case_id", "q_trace_id", "q_seq"], ["trace_id", "seq"], keep
    )


def nearest_per_trace(queries: DataFrame, points: DataFrame, r: float = 5.0) -> DataFrame:
    """Closest point in every other trace within ``r``; points flagged ``linked`` are skipped."""
    if "linked" in points.columns:
        points = points.where(~F.col("linked"))
    return nearest_in_groups(
        queries, points, r, AT, ["case_id", "q_trace_id", "q_seq"], "seq", group="trace_id", own="q_trace_id", same=False,
    ).select("case_id", "q_trace_id", "q_seq", "trace_id", "dist", "seq")


def nearest_in_trace(queries: DataFrame, points: DataFrame, r: float | None = None) -> DataFrame:
    """Closest point of a given trace (``trace_id`` of the query), at most ``r`` away or at any distance."""
    t = points.select(*KEYS, "seq", *POS)
    qid = [*KEYS, "q_id"]
    if r is None:
        return nearest_growing(queries, t, 5.0, AT, qid, ["seq"], keys=KEYS)
    return nearest_in_groups(queries, t, r, AT, qid, "seq", group="trace_id", own="trace_id", same=True, closed=True)


def trace_distance(points: DataFrame, r: float) -> DataFrame:
    """Least distance of every two traces of a case that come nearer than ``r``."""
    pairs = near_pairs(as_queries(points), points.select(*KEYS, *POS), r, AT, where=F.col("q_trace_id") < F.col("trace_id"))
    return pairs.groupBy("case_id", F.col("q_trace_id").alias("trace_a"), F.col("trace_id").alias("trace_b")).agg(F.min("dist").alias("dist"))


def in_traces(queries: DataFrame, points: DataFrame, r: float = 3.0) -> DataFrame:
    """Queries that have a point of some trace nearer than ``r``."""
    ids = [c for c in queries.columns if c not in AT]
    return near_groups(queries, points, r, AT, ids)


def with_key(df: DataFrame, cols: Sequence[str] = POS, name: str = "_key") -> DataFrame:
    return df.withColumn(name, g.position_cells(g.vec(*cols)))


def landmark_nodes(landmarks: DataFrame, points: DataFrame) -> DataFrame:
    """Trace points at exactly the position (3 decimals) of a landmark."""
    return with_key(points).join(with_key(landmarks).select("case_id", "_key", "lm_type"), ["case_id", "_key"]).drop("_key")


def branch_candidates(points: DataFrame, r: float = 5.0) -> DataFrame:
    """Trace ends that touch the inside of another trace: 0 < distance < sum of the radii."""
    e = ends(points)
    q = as_queries(e, keep=["rad", "end"])
    last = points.groupBy(*KEYS).agg(F.max("seq").alias("last"))
    hit = nearest_other(q.select("case_id", "q_trace_id", "q_seq", *AT).distinct(), points, r)
    out = hit.join(last, KEYS).join(q.select("case_id", "q_trace_id", "q_seq", "q_end", "q_rad"), ["case_id", "q_trace_id", "q_seq"])
    return out.where("dist > 0 and seq > 0 and seq < last and dist < rad + q_rad").drop("last")


def neighbour_segments(points: DataFrame, r: float = 15.0) -> DataFrame:
    """Traces whose nearer end lies within ``r`` of my tail and not nearer to my head.

    Traces with an end on my own points are left out.  ``reversed`` = its tail is the nearer end.
    """
    e = stored(ends(points).select(*KEYS, "end", *POS), "ends")
    tail = e.where("end = 1").select("case_id", F.col("trace_id").alias("q_trace_id"), *[F.col(c).alias(f"q{c}") for c in POS])
    near = near_pairs(tail, e, r, AT, where=F.col("trace_id") != F.col("q_trace_id")).select("case_id", "q_trace_id", "trace_id").distinct()

    def side(end, tag):
        return e.where(f"end = {end}").select(*KEYS, *[F.col(c).alias(f"{tag}{c}") for c in POS])

    mine = side(0, "mh").join(side(1, "mt"), KEYS).withColumnRenamed("trace_id", "q_trace_id")
    full = near.join(mine, ["case_id", "q_trace_id"]).join(side(0, "oh").join(side(1, "ot"), KEYS), KEYS)
    v = lambda t: g.vec(*[f"{t}{c}" for c in POS])
    full = full.withColumns({
        "d1": g.dist(v("oh"), v("mt")), "d2": g.dist(v("ot"), v("mt")),
        "hd": F.least(g.dist(v("oh"), v("mh")), g.dist(v("ot"), v("mh"))),
    }).withColumn("dist", F.least("d1", "d2"))
    full = full.where(f"hd >= dist and dist > 0 and dist < {r}")
    # An end of the other trace on one of my points rules the pair out.
    mine_at = with_key(points).select("case_id", F.col("trace_id").alias("q_trace_id"), "_key").distinct()
    touch = with_key(e).select(*KEYS, "_key").join(mine_at, ["case_id", "_key"]).select("case_id", "q_trace_id", "trace_id").distinct()
    return full.join(touch, ["case_id", "q_trace_id", "trace_id"], "left_anti").select(
        "case_id", "q_trace_id", "trace_id", "dist", (F.col("d1") > F.col("d2")).cast("int").alias("reversed")
    )


def representative(points: DataFrame, reference: DataFrame, count: int = 5, r: float = 3.0) -> DataFrame:
    """Reference trace that most of the ``count`` points at an end match, and its first matched point.

    Points without a match vote for no trace (-1); equal votes go to the trace met first.
    """
    last = points.groupBy(*KEYS).agg(F.max("seq").alias("last"))
    p = points.join(last, KEYS)
    head = p.where(F.col("seq") < count).select(*KEYS, "seq", *POS, F.lit(0).alias("end"), F.col("seq").alias("k"))
    tail = p.where(F.col("last") - F.col("seq") < count).select(*KEYS, "seq", *POS, F.lit(1).alias("end"), (F.col("last") - F.col("seq")).alias("k"))
    both = stored(head.unionByName(tail), "ends")
    hit = nearest_any(as_queries(both.dropDuplicates([*KEYS, "seq"])), reference, r, keep=())
    named = hit.select("case_id", F.col("q_trace_id").alias("trace_id"), F.col("q_seq").alias("seq"), F.col("trace_id").alias("m"), F.col("seq").alias("ms"))
    votes = both.join(named, [*KEYS, "seq"], "left").withColumns({"m": F.coalesce("m", F.lit(-1)), "ms": F.coalesce("ms", F.lit(-1))})
    per = votes.groupBy(*KEYS, "end", "m").agg(F.count("*").alias("n"), F.min("k").alias("k0"), F.min_by("ms", "k").alias("ms"))
    best = per.groupBy(*KEYS, "end").agg(F.max(F.struct("n", (-F.col("k0")).alias("o"), "m", "ms")).alias("b"))
    return best.select(*KEYS, "end", F.col("b.m").alias("ref_trace"), F.col("b.ms").alias("ref_seq"))


# -- comparison of two trace sets --------------------------------------------------------


def comparison_map(traced: DataFrame, reference: DataFrame, gap: float = 1.0, r: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Both sets at ``gap``; each point with its nearest of the other set (NULL beyond ``r``).

    ``rad`` is the radius of the reference point in both maps.
    """
    t, ref = stored(resample(traced, gap), "traced"), stored(resample(reference, gap), "reference")

    def look(a, b, own_radius):
        hit = nearest_any(as_queries(a), b, r)
        hit = hit.select("case_id", F.col("q_trace_id").alias("trace_id"), F.col("q_seq").alias("seq"),
                         F.col("trace_id").alias("match_trace"), F.col("seq").alias("match_seq"), "dist", F.col("rad").alias("_r"))
        out = a.select(*KEYS, "seq", "rad").join(hit, [*KEYS, "seq"], "left")
        return out.withColumn("rad", F.when(F.col("dist").isNotNull(), F.col("rad") if own_radius else F.col("_r"))).drop("_r")

    return look(t, ref, False), look(ref, t, True)


# Fixed value: radius (in voxels of 0.4297 mm) of the clinically relevant part.
CLINICAL_RADIUS = 0.75 / 0.4297


def _overlap_side(cmap: DataFrame, tag: str, size: int) -> DataFrame:
    """Counts per case for one direction of the comparison."""
    lost = cmap.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("dist").isNull()).alias("u"))
    m = cmap.join(lost, KEYS).withColumn("gone", F.col("u") / F.col("n") > 0.5)
    hit = F.col("dist").isNotNull()
    flags = running(
        m.where(~F.col("gone")), KEYS, "seq",
        {"thin": (hit & (F.col("rad") < CLINICAL_RADIUS)).cast("int"), "err": (hit & (F.col("dist") >= F.col("rad"))).cast("int")},
        how="max", size=size,
    )
    ok, wide = F.col("dist") < F.col("rad"), F.col("thin") == 0
    per = flags.groupBy("case_id").agg(
        F.count_if(hit & ok).alias("tp_ov"), F.count_if(~hit | ~ok).alias("f_ov"),
        F.count_if(hit & ok & wide).alias("tp_ot"), F.count_if(hit & ~ok & wide).alias("f_ot"),
        F.count_if(hit & ok & (F.col("err") == 0)).alias("tp_of"), F.count_if(hit & (F.col("err") == 1)).alias("f_of"),
        F.count_if(~hit).alias("um"), F.sum(F.when(hit & ok, F.col("dist"))).alias("dsum"),
    )
    bad = m.where("gone").groupBy("case_id").agg(F.count("*").alias("bad"), F.count_distinct("trace_id").alias("bad_traces"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = per.join(bad, "case_id", "full").select(
        "case_id", z("tp_ov").alias("tp_ov"), (z("f_ov") + z("bad")).alias("f_ov"), z("tp_ot").alias("tp_ot"), (z("f_ot") + z("bad")).alias("f_ot"),
        z("tp_of").alias("tp_of"), (z("f_of") + z("bad")).alias("f_of"), (z("um") + z("bad")).alias("um"), z("bad_traces").alias("ums"), "dsum",
    )
    return out.select("case_id", *[F.col(c).alias(f"{tag}_{c}") for c in out.columns if c != "case_id"])


def trace_overlap(traced: DataFrame, reference: DataFrame, size: int = BLOCK) -> DataFrame:
    """OV, OF, OT, AI per case, unmatched counts, mean distance of the matched traced points.

    A trace with more than half of its points unmatched counts as wrong as a whole.
    """
    cmap, rmap = comparison_map(traced, reference)
    c = lambda n: F.coalesce(n, F.lit(0))
    both = _overlap_side(stored(cmap, "map"), "m", size).join(_overlap_side(stored(rmap, "map"), "r", size), "case_id", "full")
    return both.select(
        "case_id",
        F.try_divide(c("m_tp_ov") + c("r_tp_ov"), c("m_tp_ov") + c("r_tp_ov") + c("m_f_ov") + c("r_f_ov")).alias("ov"),
        F.try_divide(c("r_tp_of"), c("r_tp_of") + c("r_f_of")).alias("of"),
        F.try_divide(c("m_tp_ot") + c("r_tp_ot"), c("m_tp_ot") + c("r_tp_ot") + c("m_f_ot") + c("r_f_ot")).alias("ot"),
        F.try_divide("r_dsum", "r_tp_ov").alias("ai"),
        c("m_um").alias("um"), c("m_ums").alias("ums"), c("r_um").alias("ref_um"), c("r_ums").alias("ref_ums"),
        F.try_divide("m_dsum", "m_tp_ov").alias("mean_dist"),
    )


# -- sampling of volumes at points -------------------------------------------------------


def sample(points: DataFrame, voxels: DataFrame, value: str, ids: Sequence[str], linear: bool = True) -> DataFrame:
    """Interpolated value at x, y, z; positions without a voxel count as 0."""
    vox = voxels.select("case_id", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), F.col(value).alias("_v"))
    if not linear:
        near = points.withColumns({f"v{c}": F.ceil(F.col(c) - 0.5) for c in POS})
        return near.join(vox, ["case_id", "vx", "vy", "vz"], "left").select(*ids, F.coalesce("_v", F.lit(0.0)).alias("v"))
    return _around(points, voxels, value, ids, [(0, 0, 0)])


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *more])


def _around(points: DataFrame, voxels: DataFrame, value: str, ids: Sequence[str], offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Mean of the interpolated values at the position of a row plus each of ``offsets``; rows without a position are left out."""
    rows = points.dropna(subset=list(POS)).select(*ids, *[F.col(c).alias(f"_{c}") for c in POS], *([] if "case_id" in ids else ["case_id"]))
    rows = rows.withColumns(dict(zip(AT_CUBE, in_cube([F.col(f"_{c}") for c in POS]))))

    def look(table, grid, low):
        v = interpolated(grid, low, positions(table, [f"_{c}" for c in POS]), offsets) / len(offsets)
        return table.select(list(ids)).append_column("v", pa.array(v))

    reach = 1 + max(abs(n) for o in offsets for n in o)
    return by_cubes(rows, voxels, value, reach, look, _schema(points.select(*ids), "v double"))


def sample_sets(rows: DataFrame, voxels: DataFrame, value: str, ids: Sequence[str], tag: str) -> DataFrame:
    """Interpolated values at the positions that a row lists in ``_at``, an array of (``tag`` int, x, y, z): (ids, ``tag``, v).

    A row is sent once to every cube that one of its positions lies in, with the positions there.
    """
    cube = lambda p: F.struct(*[e.alias(c) for e, c in zip(in_cube([p[c] for c in POS]), AT_CUBE)])
    rows = rows.withColumn("_cube", F.explode(F.array_distinct(F.transform("_at", cube))))
    rows = rows.withColumn("_at", F.filter("_at", lambda p: cube(p) == F.col("_cube")))
    rows = rows.select(*ids, *([] if "case_id" in ids else ["case_id"]), "_at", *[F.col(f"_cube.{c}").alias(c) for c in AT_CUBE])

    def look(table, grid, low):
        lists = table["_at"].combine_chunks()
        each = lists.flatten()
        at = np.stack([each.field(c).to_numpy(zero_copy_only=False).astype(float) for c in POS], axis=1)
        row = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        out = table.select(list(ids)).take(pa.array(row))
        return out.append_column(tag, each.field(tag)).append_column("v", pa.array(interpolated(grid, low, at)))

    return by_cubes(rows, voxels, value, 1, look, _schema(rows.select(*ids), f"`{tag}` int", "v double"))


def mean_around(points: DataFrame, voxels: DataFrame, value: str, ids: Sequence[str], half: int = 1, ball: bool = False) -> DataFrame:
    """Mean sampled value over the cube (or ball) of offsets around a point."""
    span = range(-half, half + 1)
    return _around(points, voxels, value, ids, [(a, b, c) for a in span for b in span for c in span if not ball or a * a + b * b + c * c <= half * half])


def profile(points: DataFrame, voxels: DataFrame, value: str, ring: float = 2.0, step: int = 30) -> DataFrame:
    """Value on the trace (``angle`` -1) and on a ring of ``ring`` radii across its direction."""
    d = direction(points)
    angles = F.explode(F.array(*[F.lit(a) for a in [-1, *range(0, 360, step)]]))
    cut = d.withColumn("angle", angles)
    r = F.when(F.col("angle") < 0, F.lit(0.0)).otherwise(F.col("rad") * ring)
    t = F.radians(F.col("angle"))
    at = g.cross_section_point(g.vec("dx", "dy", "dz"), g.vec(*POS), r * F.cos(t), r * F.sin(t))
    # Exploded, the position is worked out once and not again in each expression on it.
    moved = cut.select(*KEYS, "seq", "angle", F.explode(F.array(F.struct(*[e.alias(c) for e, c in zip(at, POS)]))).alias("_p"))
    return sample(moved.select(*KEYS, "seq", "angle", "_p.*"), voxels, value, [*KEYS, "seq", "angle"])


def radius_from_mask(points: DataFrame, mask: DataFrame, ids: Sequence[str], max_rad: int = 10) -> DataFrame:
    """Grow r until fewer than three of six axis probes lie in the mask; radius = r + inside / 6."""
    rows = points.select(*ids, *[F.col(c).cast("double").alias(f"_{c}") for c in POS], *([] if "case_id" in ids else ["case_id"]))
    rows = rows.withColumns(dict(zip(AT_CUBE, in_cube([F.bround(f"_{c}") for c in POS]))))

    def look(table, grid, low):
        at = positions(table, [f"_{c}" for c in POS])
        fine = np.isfinite(at).all(axis=1)
        at = np.where(fine[:, None], at, (low + max_rad).astype(float))
        rad, open_ = np.full(len(at), float(max_rad - 1)), np.ones(len(at), dtype=bool)
        for r in range(1, max_rad):
            inside = np.zeros(len(at))
            for axis in range(3):
                for way in (r, -r):
                    moved = at.copy()
                    moved[:, axis] += way
                    # Halves go to the even voxel, so that a probe may lie one voxel further than its offset.
                    i = np.rint(moved).astype(np.int64) - low
                    inside += grid[i[:, 0], i[:, 1], i[:, 2]]
            inside[~fine] = 0
            stop = open_ & (inside < 3)
            rad[stop] = r + inside[stop] / 6
            open_ &= ~stop
        return table.select(list(ids)).append_column("fit_rad", pa.array(rad))

    return by_cubes(rows, mask.withColumn("_in", F.lit(1.0)), "_in", max_rad, look, _schema(points.select(*ids), "fit_rad double"))


# -- painting ----------------------------------------------------------------------------


def _balls(points: DataFrame, reach: Column, upper: int) -> DataFrame:
    """Voxels of the ball around each point: ``center`` flag and distance ``d`` to the true position."""
    p = points.withColumns({f"c{c}": g.voxel(F.col(c)) for c in POS}).withColumn("_r", reach.cast("bigint"))
    for c in POS:
        p = p.withColumn(f"_o{c}", F.explode(F.sequence(-F.col("_r"), F.greatest(F.col("_r") + upper, -F.col("_r")))))
    at = tuple(F.col(f"c{c}") + F.col(f"_o{c}") for c in POS)
    mid = (F.col("_ox") == 0) & (F.col("_oy") == 0) & (F.col("_oz") == 0)
    d = g.dist(tuple(a.cast("double") for a in at), g.vec(*POS))
    out = p.select(*KEYS, "seq", "rad", *[a.alias(f"v{c}") for a, c in zip(at, POS)], d.alias("d"), mid.alias("center"),
                   *[(a - F.col(c)).alias(f"o{c}") for a, c in zip(at, POS)])
    return out.where((F.col("d") <= F.col("rad")) | F.col("center"))


VOX = ["case_id", "vx", "vy", "vz"]


def paint_last(points: DataFrame) -> DataFrame:
    """Voxel -> trace that painted it last (traces in id order, points in trace order)."""
    b = _balls(points, F.bround("rad"), -1)
    return b.groupBy(*VOX).agg(F.max("trace_id").alias("trace_id"))


def paint_unique(points: DataFrame) -> DataFrame:
    """Voxel -> trace, or -1 where balls of different traces meet after the last centre painted there."""
    b = _balls(points, F.bround("rad"), 0).select(*VOX, "trace_id", "seq", "center").distinct()
    # Traces paint one after the other, so a later painter has a larger id.
    top = b.groupBy(*VOX).agg(
        F.max(F.when(F.col("center"), F.col("trace_id"))).alias("mid"), F.min("trace_id").alias("lo"), F.max("trace_id").alias("hi")
    )
    return top.select(*VOX, F.when(F.col("mid").isNotNull(), F.when(F.col("hi") > F.col("mid"), F.lit(-1)).otherwise(F.col("mid")))
                      .when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(-1)).alias("trace_id"))


def paint_distance(points: DataFrame) -> DataFrame:
    """Voxel -> normalised closeness ``1 - d / rad`` of the best ball and the offset to its point.

    Centres count as 1; of several centres the last one, of equal closeness the first one is kept.
    """
    b = _balls(points, F.ceil("rad"), -1)
    close = F.when(F.col("center"), F.lit(1.0)).otherwise((F.col("rad") - F.col("d")) / F.col("rad"))
    b = b.withColumn("w", close).where("w > 0")
    sign = F.when(F.col("center"), F.lit(1)).otherwise(F.lit(-1))
    key = F.struct("w", F.col("center").cast("int").alias("c"), (sign * F.col("trace_id")).alias("t"), (sign * F.col("seq")).alias("s"), "ox", "oy", "oz")
    return b.groupBy(*VOX).agg(F.max(key).alias("m")).select(*VOX, "m.w", "m.ox", "m.oy", "m.oz")


def centreline_map(points: DataFrame) -> DataFrame:
    """Voxel -> first trace through it and its last point there; ``conflicts`` = points of other traces."""
    p = points.select(*KEYS, "seq", *[g.voxel(F.col(c)).alias(f"v{c}") for c in POS])
    per = p.groupBy(*VOX, "trace_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
    return per.groupBy(*VOX).agg(F.min(F.struct("trace_id", "seq", "n")).alias("m"), F.sum("n").alias("t")).select(
        *VOX, "m.trace_id", "m.seq", (F.col("t") - F.col("m.n")).alias("conflicts")
    )


def surrounding_voxels(points: DataFrame, r: int, box: Sequence[int]) -> DataFrame:
    """Distinct grid cells within ``r`` of a trace, inside 0 .. box - 1."""
    offs = [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= r * r]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offs])
    # Rounded positions repeat along a trace: each is spread once.
    base = points.select(*KEYS, *[g.voxel(F.col(c)).alias(c) for c in POS]).distinct()
    cut = base.withColumn("_o", F.explode(arr)).select(*KEYS, *[(F.col(c) + F.col(f"_o.{n}")).alias(c) for c, n in zip(POS, "abc")])
    ok = F.lit(True)
    for c, n in zip(POS, box):
        ok = ok & (F.col(c) >= 0) & (F.col(c) <= n - 1)
    return cut.where(ok).distinct()


def crossing_links(links: DataFrame, painted: DataFrame) -> DataFrame:
    """Links (case_id, trace_a, trace_b, ax.. bz) whose straight path enters a third trace."""
    from .points import path

    steps = path(links).select("case_id", "trace_a", "trace_b", *[g.voxel(F.col(c)).alias(f"v{c}") for c in POS])
    hit = steps.join(painted, VOX).where("trace_id not in (-1, trace_a, trace_b)")
    return hit.select("case_id", "trace_a", "trace_b").distinct()


def curve_coordinates(voxels: DataFrame, points: DataFrame, r: float, size: int = BLOCK) -> DataFrame:
    """Coordinates of voxels (trace_id, x, y, z) along a trace: across (u, v) and position ``w``.

    A voxel belongs to the nearest segment whose two end planes enclose it; the search
    radius doubles for voxels still open until it exceeds the extent of the data.
    """
    from .frames import rotation_frames

    fr = stored(rotation_frames(points, size), "frames")
    from .traces import shifted

    cols = [*POS, "tx", "ty", "tz"]
    seg = shifted(fr, [1], cols, size).where("n1_x is not null")
    names = {c: f"s{c}" for c in POS}
    seg = seg.select(*KEYS, "seq", *POS, *[F.col(c).alias(names[c]) for c in POS], "tx", "ty", "tz", "ux", "uy", "uz", "vx", "vy", "vz",
                     *[f"n1_{c}" for c in cols])
    seg = stored(seg, "segments")
    q = stored(voxels.select(*KEYS, *[F.col(c).cast("double").alias(f"q{c}") for c in POS]), "open")
    ext = points.agg(*[(F.max(c) - F.min(c) + 2 * r).alias(c) for c in POS]).first()
    limit = math.sqrt(sum(v * v for v in ext))
    sign = lambda t, c: F.signum(g.dot(g.vec(*[f"{t}{x}" for x in POS]), g.sub(g.vec(*AT), g.vec(*[f"{c}{x}" for x in POS]))))
    inside = sign("t", "s") * sign("n1_t", "n1_") <= 0
    found, reach_ = None, 2.0 * r
    while True:
        hit = stored(nearest(q, seg.select(*KEYS, "seq", *POS, "sx", "sy", "sz", "tx", "ty", "tz", "n1_x", "n1_y", "n1_z", "n1_tx", "n1_ty", "n1_tz"),
                             reach_, AT, [*KEYS, *AT], ["seq"], keys=KEYS, where=inside), "near")
        found = hit if found is None else found.unionByName(hit)
        q = stored(q.join(hit, [*KEYS, *AT], "left_anti"), "open")
        if reach_ > limit or not q.limit(1).count():
            break
        reach_ *= 2
    full = found.drop("dist").join(seg.drop(*POS), [*KEYS, "seq"])
    t1, t2 = g.vec("tx", "ty", "tz"), g.vec("n1_tx", "n1_ty", "n1_tz")
    c1, c2, p = g.vec("sx", "sy", "sz"), g.vec("n1_x", "n1_y", "n1_z"), g.vec(*AT)
    # The plane at share l of the first end: (l t1 + (1-l) t2) . (p - l c1 - (1-l) c2) = 0.
    dt, dc = g.sub(t1, t2), g.sub(c1, c2)
    qa, qb, qc = -g.dot(dt, dc), g.dot(dt, g.sub(p, c2)) - g.dot(t2, dc), g.dot(t2, g.sub(p, c2))
    full = full.withColumns({"_a": qa, "_b": qb, "_c": qc})
    root = F.sqrt(F.greatest(F.col("_b") * F.col("_b") - 4 * F.col("_a") * F.col("_c"), F.lit(0.0)))
    near01 = lambda v: F.when((v > -1e-4) & (v < 1 + 1e-4), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    quad = F.least(near01(F.try_divide(-F.col("_b") + root, 2 * F.col("_a"))), near01(F.try_divide(-F.col("_b") - root, 2 * F.col("_a"))))
    full = full.withColumn("_l", F.when(F.col("_a") == 0, F.coalesce(F.try_divide(-F.col("_c"), F.col("_b")), F.lit(1.0))).otherwise(quad))
    share = F.col("_l")
    mix = lambda a, b: tuple(share * m + (1 - share) * n for m, n in zip(a, b))
    full = full.withColumns({f"_t{c}": e for c, e in zip(POS, mix(t1, t2))} | {f"_m{c}": e for c, e in zip(POS, mix(c1, c2))})
    a, b = t1, g.unit(g.vec("_tx", "_ty", "_tz"))
    axis = g.cross(a, b)
    full = full.withColumns({f"_k{c}": e for c, e in zip(POS, axis)} | {"_cos": g.dot(a, b)})
    k = g.vec("_kx", "_ky", "_kz")
    s2 = F.greatest(g.dot(k, k), F.lit(1e-10))

    def turned(v):
        kv = g.cross(k, v)
        return tuple(x + y + z * (1 - F.col("_cos")) / s2 for x, y, z in zip(v, kv, g.cross(k, kv)))

    d = g.sub(p, g.vec("_mx", "_my", "_mz"))
    return full.select(
        *KEYS, *[F.col(f"q{c}").alias(c) for c in POS], g.dot(d, turned(g.vec("ux", "uy", "uz"))).alias("u"),
        g.dot(d, turned(g.vec("vx", "vy", "vz"))).alias("v"), (1 - share + F.col("seq")).alias("w"),
    )

