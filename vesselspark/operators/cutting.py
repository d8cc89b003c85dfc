"""Cuts of a trace that depend on the cuts before them.

Each round moves every trace to its next cut with plain joins and minima, so the
number of rounds is the largest number of cuts, never the length of a trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.blocks import BLOCK, running
from ..session import stored
from .traces import KEYS, POS, accumulated_length, direction_breaks


def _jump(first: DataFrame, next_cut) -> DataFrame:
    """Collect cuts: ``next_cut(starts)`` maps (keys, b) to the next (keys, cut, b)."""
    cuts, now = None, first
    while True:  # every cut lies behind the one before it
        hit = stored(next_cut(now), "cuts")
        if not hit.limit(1).count():
            break
        cuts = hit if cuts is None else cuts.unionByName(hit)
        now = hit.drop("cut")
    return next_cut(first).limit(0) if cuts is None else cuts


def intensity_cuts(points: DataFrame, signal: str, nstd: float = 3, least: int = 5, size: int = BLOCK) -> DataFrame:
    """Cut where the direction breaks or the signal leaves ``nstd`` deviations of the current group.

    A group needs ``least`` points before it can be left.  Direction breaks do not depend on
    other cuts, so they split the traces first; group means and deviations are differences
    of running sums.  Adds ``piece``; pieces of one point go, of two points get a middle one.
    """
    d = direction_breaks(points, size=size).withColumn("_k", F.col("brk").cast("bigint"))
    cum = running(d, KEYS, "seq", {"part": F.col("_k"), "_s": F.col(signal), "_q": F.col(signal) * F.col(signal)}, size=size)
    # Sums before a point, so that a group is the difference of two of them.
    cum = stored(cum.withColumns({"_s": F.col("_s") - F.col(signal), "_q": F.col("_q") - F.col(signal) * F.col(signal)}).drop("_k", "brk"), "sums")
    keys = [*KEYS, "part"]
    start = cum.groupBy(*keys).agg(F.min(F.struct("seq", "_s", "_q")).alias("b"))

    def next_cut(now):
        w = cum.join(now, keys)
        n = F.col("seq") - F.col("b.seq")
        mean = F.try_divide(F.col("_s") - F.col("b._s"), n)
        std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - F.col("b._q"), n) - mean * mean))
        out = F.abs(F.col(signal) - mean) > nstd * std + 1e-9
        return w.where((n >= least) & out).groupBy(*keys).agg(F.min(F.struct("seq", "_s", "_q")).alias("b")).select(*keys, F.col("b.seq").alias("cut"), "b")

    cuts = _jump(start, next_cut).select(*KEYS, F.col("cut").alias("seq"), F.lit(1).cast("bigint").alias("_cut"))
    first = start.select(*KEYS, F.col("b.seq").alias("seq"), F.lit(1).cast("bigint").alias("_cut"))
    marks = cuts.unionByName(first).distinct()
    flagged = points.join(marks, [*KEYS, "seq"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    p = running(flagged, KEYS, "seq", {"piece": F.col("_cut")}, size=size).withColumn("piece", F.col("piece") - 1).drop("_cut")
    n = p.groupBy(*KEYS, "piece").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    kept = p.join(n.where("_n > 1"), [*KEYS, "piece"]).withColumn("seq", F.col("seq") - F.col("_first"))
    cols = [*KEYS, "piece", "seq", *POS, "rad"]
    a, b = F.min_by(F.struct(*POS, "rad"), "seq"), F.max_by(F.struct(*POS, "rad"), "seq")
    two = kept.where("_n = 2").groupBy(*KEYS, "piece").agg(a.alias("a"), b.alias("b"))
    mid = two.select(*KEYS, "piece", F.lit(1).cast("bigint").alias("seq"), *[((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(c) for c in (*POS, "rad")])
    moved = kept.withColumn("seq", F.when((F.col("_n") == 2) & (F.col("seq") == 1), 2).otherwise(F.col("seq")).cast("bigint"))
    return moved.select(*cols).unionByName(mid)


def overlap_breaks(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """Break points of a trace that returns to a cell it visited since the last break.

    A return counts if the way since the first visit is longer than the (whole) radius and
    more than 5 points; the break lies midway between the two.
    """
    acc = accumulated_length(points, size).select(
        *KEYS, "seq", "acc", F.floor("rad").alias("crad"), *[F.col(c).cast("bigint").alias(f"c{c}") for c in POS]
    )
    acc = stored(acc, "cells")
    cell = [*KEYS, "cx", "cy", "cz"]
    start = acc.select(*KEYS).distinct().withColumn("b", F.lit(0).cast("bigint"))

    def next_cut(now):
        w = acc.join(now, KEYS).where("seq >= b")
        first = w.groupBy(*cell).agg(F.min(F.struct("seq", "acc")).alias("f"))
        hit = w.join(first, cell).where((F.col("acc") - F.col("f.acc") > F.col("crad")) & (F.col("seq") - F.col("f.seq") > 5))
        top = hit.groupBy(*KEYS).agg(F.min(F.struct("seq", F.col("f.seq").alias("j"))).alias("m"))
        return top.select(*KEYS, F.floor((F.col("m.seq") + F.col("m.j")) / 2).alias("cut"), (F.col("m.seq") + 1).alias("b"))

    return _jump(start, next_cut).select(*KEYS, "cut")

