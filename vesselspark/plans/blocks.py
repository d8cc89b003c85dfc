"""Ordered work on sequences of any length.

A trace may hold a large share of all rows, so no window here is partitioned by
the trace alone.  Sequences are cut into blocks of ``size`` positions; a row near
a block edge is also copied to the adjoining block (its halo), and running totals
get the sum of the blocks before them from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

BLOCK = 65536


def with_halo(df: DataFrame, keys: Sequence[str], seq: str, before: int, after: int, size: int) -> DataFrame:
    if max(before, after) >= size:
        raise ValueError("block must be longer than the halo")
    own = F.floor(F.col(seq) / size)
    offset = F.col(seq) - own * size
    places = [own]
    if after:
        places.append(F.when((offset < after) & (own > 0), own - 1))
    if before:
        places.append(F.when(offset >= size - before, own + 1))
    return df.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(F.array(*places))))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    wanted: Mapping[str, tuple[str, int]],
    size: int = BLOCK,
) -> DataFrame:
    """Add columns holding a value ``offset`` positions away (NULL beyond the ends).

    ``seq`` counts 0, 1, 2, ... without gaps inside every key.
    """
    before = max([0] + [-o for _, o in wanted.values()])
    after = max([0] + [o for _, o in wanted.values()])
    w = Window.partitionBy(*keys, "_block").orderBy(seq)
    cells = {
        name: (F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w))
        for name, (c, o) in wanted.items()
    }
    return (
        with_halo(df, keys, seq, before, after, size)
        .withColumns(cells)
        .where("_block = _own")
        .drop("_block", "_own")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    aggregates: Mapping[str, Column],
    before: int,
    after: int,
    size: int = BLOCK,
) -> DataFrame:
    """Aggregates over the rows from ``before`` behind to ``after`` ahead."""
    w = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(-before, after)
    return (
        with_halo(df, keys, seq, before, after, size)
        .withColumns({n: e.over(w) for n, e in aggregates.items()})
        .where("_block = _own")
        .drop("_block", "_own")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    how: str = "sum",
    block: Column | None = None,
    size: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of each expression along ``order``.

    ``block`` is any non-decreasing function of ``order`` that bounds the rows of
    one block; by default positions are cut every ``size``.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    cut = F.floor(F.col(order) / size) if block is None else block
    cut_df = df.withColumn("_block", cut).withColumns({f"_v_{n}": e for n, e in totals.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    rows = cut_df.withColumns({n: fold(f"_v_{n}").over(inside) for n in totals})
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cut_df.groupBy(*keys, "_block")
        .agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n in totals])
        .withColumns({f"_c_{n}": fold(f"_t_{n}").over(earlier) for n in totals})
        .drop(*[f"_t_{n}" for n in totals])
    )
    joined = rows.join(carry, [*keys, "_block"])
    combine = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": F.greatest,
        "min": F.least,
    }[how]
    return joined.withColumns({n: combine(F.col(n), F.col(f"_c_{n}")) for n in totals}).drop(
        "_block", *[f"_v_{n}" for n in totals], *[f"_c_{n}" for n in totals]
    )


def running_values(
    df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, Column], size: int = BLOCK
) -> DataFrame:
    """``running`` along values whose range is not known, with block limits drawn from the data.

    Where every key has at most ``size`` rows, a key is one block.  Else rows are range-partitioned by
    key and value into pieces of about ``size`` rows: a key with most of the rows has as many blocks as it needs,
    however close its values lie, and small keys share a piece.
    """
    from ..session import stored

    rows = stored(df, "values")
    count = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (count[0] or 0) <= size:
        return running(rows, keys, order, totals, block=F.lit(0))
    spread = rows.repartitionByRange(-(-count[1] // size), *keys, order).withColumn("_range", F.spark_partition_id())
    return running(stored(spread, "ranges"), keys, order, totals, block=F.col("_range")).drop("_range")


def renumber(df: DataFrame, keys: Sequence[str], seq: str = "seq", size: int = BLOCK) -> DataFrame:
    """Make ``seq`` count 0, 1, 2, ... again after rows were dropped."""
    return running(df, keys, seq, {"_n": F.lit(1)}, size=size).withColumn(seq, F.col("_n") - 1).drop("_n")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Global 1-based rank without sending all rows through one task.

    Rows are range-partitioned and stored once; the rank inside a partition is
    shifted by the sizes of the partitions before it.
    """
    from ..session import stored

    spread = df.repartitionByRange(*([parts] if parts else []), *order)
    placed = stored(spread.withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the partition count.
    shift = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    return (
        placed.join(F.broadcast(shift.drop("_n")), "_part")
        .withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_shift"))
        .drop("_part", "_shift")
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], size: int = BLOCK
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per key and probability.

    Equal values are counted first, so the ordered part runs over distinct values, in
    blocks of about ``size`` of them.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_w"))
    ladder = running_values(counts, keys, value, {"_hi": F.col("_w")}, size)
    sizes = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("_w").alias("_n"))
    wanted = (
        sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_at", F.col("p") * (F.col("_n") - 1))
        .withColumns({"_from": F.floor("_at"), "_to": F.ceil("_at")})
    )
    steps = ladder.withColumn("_lo", F.col("_hi") - F.col("_w"))
    # A key has as many wanted ranks as probabilities, so this join stays narrow.
    hit = F.expr("(_lo <= _from and _from < _hi) or (_lo <= _to and _to < _hi)")
    for k in keys:
        hit = hit & (F.col(k) == F.col(f"_k_{k}"))
    return steps.join(wanted, hit).groupBy(*keys, "p", "_at").agg(
        F.min(value).alias("_a"), F.max(value).alias("_b")
    ).select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("q"))
