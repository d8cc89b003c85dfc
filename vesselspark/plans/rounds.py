"""Greedy selections that depend on an order, decided in parallel rounds.

Every round decides at least the first item in rank, so the rounds end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def first_free(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Items (id) kept by walking in rank order and skipping those in conflict with a kept one.

    ``conflicts(winner, loser)``: the winner ranks first.  In a round an item whose
    earlier rivals are all decided is decided too; the result equals the sequential walk.
    """
    open_ = stored(items.select("id"), "items")
    pairs = stored(conflicts.select("winner", "loser").distinct(), "rivals")
    kept = None
    while True:
        now = stored(open_.join(pairs.select(F.col("loser").alias("id")).distinct(), "id", "left_anti"), "kept")
        if not now.limit(1).count():
            break
        kept = now if kept is None else kept.unionByName(now)
        out = stored(pairs.join(now.select(F.col("id").alias("winner")), "winner", "left_semi").select(F.col("loser").alias("id")).distinct(), "out")
        gone = now.unionByName(out)
        open_ = stored(open_.join(gone, "id", "left_anti"), "items")
        pairs = pairs.join(gone.select(F.col("id").alias("winner")), "winner", "left_anti")
        pairs = stored(pairs.join(gone.select(F.col("id").alias("loser")), "loser", "left_anti"), "rivals")
    return items.select("id").limit(0) if kept is None else kept


def best_free(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment: in rank order each left item takes its best free right item.

    ``pairs(left, right, rank, score)``: lower rank goes first, higher score is better,
    equal scores go to the lower ``right``.  A left item is decided once it is the first in
    rank among the undecided ones that could take its choice.
    """
    pairs = stored(pairs.select("left", "right", "rank", "score"), "pairs")
    taken = None
    while True:
        first = pairs.groupBy("right").agg(F.min(F.struct("rank", "left")).alias("_f")).select("right", F.col("_f.left").alias("_first"))
        choice = pairs.groupBy("left").agg(F.min(F.struct((-F.col("score")).alias("s"), "right")).alias("_c")).select(
            "left", F.col("_c.right").alias("right"), (-F.col("_c.s")).alias("score")
        )
        now = stored(choice.join(first, "right").where("left = _first").drop("_first"), "taken")
        if not now.limit(1).count():
            break
        taken = now if taken is None else taken.unionByName(now)
        pairs = stored(
            pairs.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti"), "pairs"
        )
    return pairs.select("left", "right", "score").limit(0) if taken is None else taken.select("left", "right", "score")
