"""Operators on traces: ordered points keyed by (case_id, trace_id, seq)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g
from ..plans.blocks import BLOCK, framed, neighbours, renumber, running, running_values

KEYS = ["case_id", "trace_id"]
POS = ("x", "y", "z")


def shifted(points: DataFrame, offsets: Sequence[int], cols: Sequence[str] = POS, size: int = BLOCK) -> DataFrame:
    """Columns ``p1_x`` / ``n2_x`` ...: values 1 back, 2 ahead, ..."""
    wanted = {
        f"{'p' if o < 0 else 'n'}{abs(o)}_{c}": (c, o) for o in offsets for c in cols
    }
    return neighbours(points, KEYS, "seq", wanted, size)


def with_step(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """``step`` = distance from the previous point, NULL at the head."""
    cols = [*POS, "rad"] if "rad" in points.columns else list(POS)
    near = shifted(points, [-1], cols, size)
    return near.withColumn("step", g.dist(g.vec("x", "y", "z"), g.vec("p1_x", "p1_y", "p1_z")))


# -- windows ---------------------------------------------------------------------------


def accumulated_length(points: DataFrame, size: int = BLOCK) -> DataFrame:
    stepped = with_step(points, size).drop("p1_x", "p1_y", "p1_z", "p1_rad")
    return running(stepped, KEYS, "seq", {"acc": F.coalesce("step", F.lit(0.0))}, size=size)


def direction(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """Forward difference; backward at the tail; the position itself for a single point."""
    near = shifted(points, [-1, 1], size=size)
    return near.withColumns(
        {f"d{c}": F.coalesce(F.col(f"n1_{c}") - F.col(c), F.col(c) - F.col(f"p1_{c}"), F.col(c)) for c in POS}
    ).drop(*[f"{s}_{c}" for s in ("p1", "n1") for c in POS])


def tangent(points: DataFrame, normalised: bool = False, size: int = BLOCK) -> DataFrame:
    """Sum of the unit steps before and after a point."""
    near = shifted(points, [-1, 1], size=size)
    here = g.vec(*POS)
    back = g.unit(g.sub(here, g.vec(*[f"p1_{c}" for c in POS])))
    ahead = g.unit(g.sub(g.vec(*[f"n1_{c}" for c in POS]), here))
    zero = F.lit(0.0)
    total = tuple(F.coalesce(b, zero) + F.coalesce(a, zero) for b, a in zip(back, ahead))
    out = near.withColumns({f"t{c}": e for c, e in zip(POS, total)})
    if normalised:
        out = out.withColumns({f"t{c}": e for c, e in zip(POS, g.unit(g.vec("tx", "ty", "tz")))})
    return out.drop(*[f"{s}_{c}" for s in ("p1", "n1") for c in POS])


def _at_abscissa(points: DataFrame, s: str, lo: Column, hi: Column, target: Column, carry: Sequence[str]) -> DataFrame:
    """Linear interpolation at the targets numbered ``lo`` .. ``hi`` of each bracket (s, n1_s)."""
    cut = points.where(lo <= hi).withColumn("_k", F.explode(F.sequence(lo, hi)))
    span = F.col(f"n1_{s}") - F.col(s)
    f = F.when(span == 0, F.lit(0.0)).otherwise((target - F.col(s)) / F.when(span == 0, F.lit(1.0)).otherwise(span))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
    values = {c: F.col(c) + (F.col(f"n1_{c}") - F.col(c)) * f for c in (*POS, "rad")}
    return cut.withColumns({f"_{c}": e for c, e in values.items()}).select(
        *KEYS, F.col("_k").alias("seq"), *[F.col(f"_{c}").alias(c) for c in (*POS, "rad")], *carry
    )


def resample(points: DataFrame, gap: float, size: int = BLOCK) -> DataFrame:
    """``max(3, floor(length / gap))`` points at equal arc length, ends kept.

    Every segment makes the samples that fall into it, so no bracket join is needed.
    Traces of a single point pass unchanged.
    """
    acc = accumulated_length(points, size).drop("step")
    whole = acc.groupBy(*KEYS).agg(F.max("acc").alias("_len"), F.max("seq").alias("_last"))
    seg = neighbours(acc, KEYS, "seq", {f"n1_{c}": (c, 1) for c in (*POS, "rad", "acc")}, size).join(whole, KEYS)
    n = F.greatest(F.lit(3), F.floor(F.col("_len") / gap))
    seg = seg.withColumn("_n", n).withColumn("_gap", F.col("_len") / (F.col("_n") - 1))
    still = F.col("_gap") == 0
    safe = F.when(still, F.lit(1.0)).otherwise(F.col("_gap"))
    final = F.col("seq") == F.col("_last") - 1
    lo = F.when(still, F.when(final, F.lit(0)).otherwise(F.lit(1))).otherwise(
        F.least(F.ceil(F.col("acc") / safe), F.col("_n") - 1)
    ).cast("bigint")
    hi = F.when(still, F.when(final, F.col("_n") - 1).otherwise(F.lit(0))).otherwise(
        F.when(final, F.col("_n") - 1).otherwise(
            F.least(F.ceil(F.col("n1_acc") / safe) - 1, F.col("_n") - 2)
        )
    ).cast("bigint")
    many = _at_abscissa(seg.where("n1_x is not null"), "acc", lo, hi, F.col("_k") * F.col("_gap"), [])
    single = seg.where("_last = 0").select(*KEYS, "seq", *POS, "rad")
    return many.unionByName(single)


def resample_at_slices(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """One point at every integer z between the lowest and highest point of a trace.

    Points are taken in z order; of points at one z the first in the trace counts.
    """
    by_z = points.groupBy(*KEYS, "z").agg(F.min_by(F.struct("x", "y", "rad"), "seq").alias("_p")).select(
        *KEYS, "z", "_p.*"
    )
    order = running_values(by_z, KEYS, "z", {"_n": F.lit(1).cast("bigint")}, size)
    order = order.withColumn("seq", F.col("_n") - 1).drop("_n").withColumn("zz", F.col("z"))
    seg = neighbours(order, KEYS, "seq", {f"n1_{c}": (c, 1) for c in (*POS, "rad", "zz")}, size)
    # The last slice belongs to the topmost point.
    seg = seg.withColumns({f"n1_{c}": F.coalesce(f"n1_{c}", c) for c in (*POS, "rad")}).withColumn(
        "_top", F.col("n1_zz").isNull()
    ).withColumn("n1_zz", F.coalesce("n1_zz", "zz"))
    lo = F.ceil("zz")
    hi = F.when(F.col("_top"), F.floor("zz")).otherwise(F.ceil("n1_zz") - 1)
    return _at_abscissa(seg, "zz", lo, hi, F.col("_k").cast("double"), [])


def resample_along_axis(points: DataFrame, chunk: int | None = None, size: int = BLOCK) -> DataFrame:
    """As many points as before at equal steps along the end-to-end axis (linear).

    Steps run between whole numbers inside the projected range.  With ``chunk``, each
    run of that many points is treated as a trace of its own; the last run reaches
    back so that it is full, and only its new part is kept.
    """
    count = points.groupBy(*KEYS).agg(F.count("*").alias("_np"))
    p = points.join(count, KEYS)
    if chunk is None:
        p = p.withColumn("_c", F.lit(0).cast("bigint")).withColumn("_i", F.col("seq"))
        span = F.col("_np")
    else:
        full = F.floor(F.col("_np") / chunk)
        own = F.floor(F.col("seq") / chunk)
        back = F.col("_np") - chunk
        short = F.col("_np") <= chunk
        runs = F.array_compact(
            F.array(
                F.when(short, F.lit(0).cast("bigint")).when(own < full, own),
                F.when(~short & (F.col("_np") % chunk != 0) & (F.col("seq") >= back), full),
            )
        )
        p = p.withColumn("_full", full).withColumn("_c", F.explode(runs))
        start = F.when(F.col("_c") == F.col("_full"), F.greatest(back, F.lit(0))).otherwise(F.col("_c") * chunk)
        p = p.withColumn("_i", F.col("seq") - start).drop("_full")
        span = F.least(F.col("_np"), F.lit(chunk))
    keys = [*KEYS, "_c"]
    p = p.withColumn("_m", span)
    ends = p.groupBy(*keys).agg(
        *[F.min_by(c, "_i").alias(f"_a{c}") for c in POS], *[F.max_by(c, "_i").alias(f"_b{c}") for c in POS]
    )
    axis = g.unit(g.sub(g.vec("_bx", "_by", "_bz"), g.vec("_ax", "_ay", "_az")))
    along = g.dot(g.sub(g.vec(*POS), g.vec("_ax", "_ay", "_az")), axis)
    # Samples need a single-valued order: the first point at each abscissa (to 1e-9) counts.
    flat = p.join(ends, keys).withColumn("_s", F.round(along, 9))
    flat = flat.groupBy(*keys, "_s", "_m", "_np").agg(F.min_by(F.struct(*POS, "rad"), "_i").alias("_p")).select(
        *keys, "_s", "_m", "_np", "_p.*"
    )
    lim = flat.groupBy(*keys).agg(F.ceil(F.min("_s")).alias("_lo"), F.floor(F.max("_s")).alias("_hi"))
    flat = running_values(flat, keys, "_s", {"_j": F.lit(1).cast("bigint")}, size)
    flat = flat.withColumn("_j", F.col("_j") - 1)
    seg = neighbours(flat, keys, "_j", {f"n1_{c}": (c, 1) for c in (*POS, "rad", "_s")}, size).join(lim, keys)
    seg = seg.where("n1__s is not null and _m > 1 and _hi >= _lo")
    gap = (F.col("_hi") - F.col("_lo")) / (F.col("_m") - 1)
    seg = seg.withColumn("_gap", gap)
    safe = F.when(F.col("_gap") == 0, F.lit(1.0)).otherwise(F.col("_gap"))
    last = F.col("_m") - 1
    # A segment owns the samples in [s, next s); the one that reaches the top limit also the last sample.
    lo = F.greatest(F.ceil((F.col("_s") - F.col("_lo")) / safe), F.lit(0))
    reaches = (F.col("n1__s") >= F.col("_hi")) & (F.col("_s") < F.col("_hi"))
    hi = F.when(reaches, last).otherwise(F.least(F.ceil((F.col("n1__s") - F.col("_lo")) / safe) - 1, last - 1))
    lo = F.when(F.col("_gap") == 0, F.when(reaches, F.lit(0).cast("bigint")).otherwise(last + 1)).otherwise(lo)
    out = _at_abscissa(seg, "_s", lo.cast("bigint"), hi.cast("bigint"), F.col("_lo") + F.col("_k") * F.col("_gap"), ["_c", "_np"])
    if chunk is None:
        return out.drop("_c", "_np")
    full = F.floor(F.col("_np") / chunk)
    tail = (F.col("_c") == full) & (F.col("_np") > chunk)
    overlap = full * chunk - (F.col("_np") - chunk)
    return (
        out.where(~tail | (F.col("seq") >= overlap))
        .withColumn("seq", F.when(tail, F.col("_np") - chunk + F.col("seq")).otherwise(F.col("_c") * chunk + F.col("seq")))
        .drop("_c", "_np")
    )


def moving_average(points: DataFrame, width: int = 5, size: int = BLOCK) -> DataFrame:
    """Centred mean over ``width`` points; ``h + 1`` points at the head and ``h`` at the tail stay (h = width // 2)."""
    h = width // 2
    near = neighbours(points, KEYS, "seq", {"_end": ("seq", h)}, size)
    smooth = framed(near, KEYS, "seq", {f"_m{c}": F.avg(c) for c in (*POS, "rad")}, h, h, size)
    keep = (F.col("seq") <= h) | F.col("_end").isNull()
    return smooth.withColumns(
        {c: F.when(keep, F.col(c)).otherwise(F.col(f"_m{c}")) for c in (*POS, "rad")}
    ).drop("_end", *[f"_m{c}" for c in (*POS, "rad")])


def trim_end_radius(points: DataFrame, ratio: float = 1.5, size: int = BLOCK) -> DataFrame:
    """Flatten a swollen end: the first (last) three radii take the fourth if the end is ``ratio`` times larger."""
    wanted = {f"_r{o}".replace("-", "m"): ("rad", o) for o in range(-3, 4)}
    wanted |= {f"_f{o}".replace("-", "m"): ("seq", o) for o in (-7, -6, -5, 5, 6, 7)}
    near = neighbours(points, KEYS, "seq", wanted, size)
    rad = F.col("rad")
    for s in range(3):  # s = place from the head / from the tail
        end_h = F.col(f"_rm{s}") if s else F.col("rad")
        end_t = F.col(f"_r{s}") if s else F.col("rad")
        head = (F.col("seq") == s) & F.col(f"_f{7 - s}").isNotNull() & (end_h > F.col(f"_r{3 - s}") * ratio)
        # ``s`` places before the tail: a value s ahead exists, one s + 1 ahead does not.
        is_tail = F.col(f"_r{s + 1}").isNull() & (F.col(f"_r{s}").isNotNull() if s else F.lit(True))
        tail = is_tail & F.col(f"_fm{7 - s}").isNotNull() & (end_t > F.col(f"_rm{3 - s}") * ratio)
        rad = F.when(head, F.col(f"_r{3 - s}")).when(tail, F.col(f"_rm{3 - s}")).otherwise(rad)
    return near.withColumn("rad", rad).drop(*wanted)


def sharp_turn(points: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    near = shifted(points, [-2, 2], size=size)
    here = g.vec(*POS)
    turn = g.angle_deg(g.sub(g.vec("n2_x", "n2_y", "n2_z"), here), g.sub(here, g.vec("p2_x", "p2_y", "p2_z")))
    return near.groupBy(*KEYS).agg(F.coalesce(F.max(turn), F.lit(0.0)).alias("max_angle")).withColumn(
        "sharp", F.col("max_angle") > threshold
    )


def position_energy(points: DataFrame, b: float = 5, size: int = BLOCK) -> DataFrame:
    near = shifted(points, [-1, -2], size=size)
    first = sum((F.abs(F.col(c) - F.col(f"p1_{c}")) for c in POS), F.lit(0.0))
    second = sum((F.abs(F.col(c) - 2 * F.col(f"p1_{c}") + F.col(f"p2_{c}")) for c in POS), F.lit(0.0))
    return near.groupBy(*KEYS).agg(
        (F.coalesce(F.sum(first), F.lit(0.0)) + b * F.coalesce(F.sum(second), F.lit(0.0))).alias("energy")
    )


def direction_breaks(points: DataFrame, least: float = 0.25, size: int = BLOCK) -> DataFrame:
    """Points where the direction two steps before and after differs too much (``brk`` flag)."""
    near = shifted(points, [-2, -1, 1, 2], size=size)
    before = g.unit(g.sub(g.vec("p1_x", "p1_y", "p1_z"), g.vec("p2_x", "p2_y", "p2_z")))
    after = g.unit(g.sub(g.vec("n2_x", "n2_y", "n2_z"), g.vec("n1_x", "n1_y", "n1_z")))
    return near.withColumn("brk", F.coalesce(g.dot(before, after) < least, F.lit(False))).drop(
        *[f"{s}_{c}" for s in ("p2", "p1", "n1", "n2") for c in POS]
    )


def split_at(points: DataFrame, flag: str, least_points: int = 2, size: int = BLOCK) -> DataFrame:
    """Cut traces at flagged points; pieces shorter than ``least_points`` go.  Adds ``piece``."""
    cut = running(points, KEYS, "seq", {"piece": F.col(flag).cast("bigint")}, size=size)
    first = cut.groupBy(*KEYS, "piece").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    kept = cut.join(first.where(F.col("_n") >= least_points), [*KEYS, "piece"])
    return kept.withColumn("seq", F.col("seq") - F.col("_first")).drop("_n", "_first", flag)


def islands(points: DataFrame, flag: str, more_than: int = 2, size: int = BLOCK) -> DataFrame:
    """Runs of flagged points longer than ``more_than``: one row per run."""
    near = neighbours(points, KEYS, "seq", {"_before": (flag, -1)}, size)
    change = (F.col(flag) != F.coalesce("_before", ~F.col(flag))).cast("bigint")
    runs = running(near, KEYS, "seq", {"run": change}, size=size).where(flag)
    return runs.groupBy(*KEYS, "run").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("np")
    ).where(F.col("np") > more_than).drop("run")


# -- filters ---------------------------------------------------------------------------


def trim_range(points: DataFrame, box: tuple) -> DataFrame:
    return points.where(~g.out_of_box(g.vec(*POS), box))


def remove_short(points: DataFrame, n: int) -> DataFrame:
    long = points.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > n).drop("_n")
    return points.join(long, KEYS, "left_semi")


def remove_large(points: DataFrame, radius: float, size: int = BLOCK) -> DataFrame:
    """Drop traces whose mean radius is greater than ``radius``.

    Radii are added up in the order of the trace, so that a mean at the limit itself falls the same way on any partitioning.
    """
    so_far = Window.partitionBy(*KEYS, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cut = points.select(*KEYS, "seq", "rad", F.floor(F.col("seq") / size).alias("_block")).withColumn("_s", F.sum("rad").over(so_far))
    part = cut.groupBy(*KEYS, "_block").agg(F.max_by("_s", "seq").alias("_s"), F.count("rad").alias("_n"))
    whole = part.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("_block", "_s"))).alias("_p"), F.sum("_n").alias("_n"))  # one entry a block
    total = F.aggregate("_p", F.lit(0.0), lambda a, b: a + F.coalesce(b["_s"], F.lit(0.0)))
    thin = whole.where(F.try_divide(total, F.col("_n")) <= radius).select(*KEYS)
    return points.join(thin, KEYS, "left_semi")


def valid(points: DataFrame, flags: DataFrame) -> DataFrame:
    """Keep traces whose row in ``flags(case_id, trace_id, ok)`` is 1."""
    return points.join(flags.where("ok = 1"), KEYS, "left_semi")


def sub_trace(points: DataFrame, start: int, end: int | None = None) -> DataFrame:
    kept = points.where((F.col("seq") >= start) & (F.lit(True) if end is None else F.col("seq") < end))
    return kept.withColumn("seq", F.col("seq") - start)


def trim(points: DataFrame, at: int, keep_tail: bool = False) -> DataFrame:
    return sub_trace(points, at) if keep_tail else sub_trace(points, 0, at)


def points_at(points: DataFrame, z: float) -> DataFrame:
    return points.where(F.abs(F.col("z") - z) < 1)


def remove_duplicate_points(points: DataFrame, size: int = BLOCK) -> DataFrame:
    stepped = with_step(points, size)
    kept = stepped.where("step is null or step >= 0.001").drop("step", "p1_x", "p1_y", "p1_z", "p1_rad")
    return renumber(kept, KEYS, size=size)


def remove_self_loop(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """For every return to a position, drop what lies between the first visit and the return."""
    keyed = points.withColumn("_key", g.position_cells(g.vec(*POS)))
    last = keyed.groupBy(*KEYS, "_key").agg(F.max("seq").alias("_last"))
    back = running(keyed.join(last, [*KEYS, "_key"]), KEYS, "seq", {"_reach": F.col("_last")}, how="max", size=size)
    return renumber(back.where("_reach <= seq").drop("_key", "_last", "_reach"), KEYS, size=size)


def reverse(points: DataFrame, only_thin_head: bool = False) -> DataFrame:
    """Reverse traces; with ``only_thin_head`` those whose head radius is below the tail radius."""
    ends = points.groupBy(*KEYS).agg(
        F.max("seq").alias("_top"), F.min_by("rad", "seq").alias("_head"), F.max_by("rad", "seq").alias("_tail")
    )
    turn = (F.col("_head") < F.col("_tail")) if only_thin_head else F.lit(True)
    return points.join(ends, KEYS).withColumn(
        "seq", F.when(turn, F.col("_top") - F.col("seq")).otherwise(F.col("seq"))
    ).drop("_top", "_head", "_tail")


def has_nan(points: DataFrame) -> DataFrame:
    bad = F.isnan("x") | F.isnan("y") | F.isnan("z")
    return points.groupBy(*KEYS).agg(F.bool_or(bad).alias("has_nan"))


# -- measures --------------------------------------------------------------------------


def trace_features(points: DataFrame, size: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """Count, length, volume, tortuosity, radius, box and centroid of every trace."""
    disc = F.col("step") * math.pi * (F.col("rad") * F.col("rad") + F.col("p1_rad") * F.col("p1_rad")) / 2
    agg = [
        F.count("*").alias("np"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"),
        F.coalesce(F.sum(disc), F.lit(0.0)).alias("volume"),
        F.avg("rad").alias("mean_rad"),
        F.min("rad").alias("min_rad"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in POS],
        *[F.min_by(c, "seq").alias(f"_a{c}") for c in POS],
        *[F.max_by(c, "seq").alias(f"_b{c}") for c in POS],
        *[F.first(c).alias(c) for c in carry],
    ]
    out = with_step(points, size).groupBy(*KEYS).agg(*agg)
    chord = g.dist(g.vec("_ax", "_ay", "_az"), g.vec("_bx", "_by", "_bz"))
    box = F.lit(1.0)
    for c in POS:
        box = box * (F.col(f"max_{c}") - F.col(f"min_{c}"))
    return out.withColumns({"tortuosity": F.try_divide("length", chord), "box_volume": box}).drop(
        *[f"_{e}{c}" for e in "ab" for c in POS]
    )
