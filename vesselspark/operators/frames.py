"""Rotation-minimising frames along traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as g
from .traces import KEYS, POS, shifted, tangent

FRAME_BLOCK = 4096
MAT = [f"m{i}{j}" for i in range(3) for j in range(3)]


def _products(mats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running matrix products that begin anew at the rows ``first``.

    The product is associative: with every doubling of the shift all rows take the product that ends
    that far before them, so groups of n rows take log2(n) batched products.
    """
    size = np.diff(np.append(first, len(mats)))
    place = np.arange(len(mats)) - np.repeat(first, size)
    out, shift = mats, 1
    while shift < size.max(initial=0):
        on = np.flatnonzero(place >= shift)
        new = out.copy()
        new[on] = out[on] @ out[on - shift]
        out, shift = new, 2 * shift
    return out


def _chain(keys: list[str], order: str, inclusive: bool):
    """Running products over sorted batches, for many groups at once; a group's rows wait until it is whole (one block, or one row per block)."""

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        df = df.reset_index(drop=True)
        named = df[keys]
        first = np.flatnonzero((named != named.shift()).any(axis=1).to_numpy())
        mats = df[MAT].to_numpy().reshape(-1, 3, 3)
        if not inclusive and len(df):
            mats = np.concatenate([np.eye(3)[None], mats[:-1]])
            mats[first] = np.eye(3)
        df[MAT] = _products(mats, first).reshape(-1, 9)
        return df

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            same = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            held = rows[same]
            if not same.all():
                yield solve(rows[~same])
        if held is not None:
            yield solve(held)

    def build(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, df.schema)

    return build


def rotation_frames(points: DataFrame, size: int = FRAME_BLOCK) -> DataFrame:
    """Unit axes u, v across each point that turn as little as possible along the trace.

    Turning from tangent to tangent is a matrix product.  It is associative, so blocks are
    multiplied on their own and each takes the product of the blocks before it.
    """
    size = min(size, FRAME_BLOCK)
    t = tangent(points, normalised=True, size=size)
    near = shifted(t, [-1], ["tx", "ty", "tz"], size)
    x = [F.coalesce(f"p1_t{c}", F.lit(v)) for c, v in zip(POS, (1.0, 0.0, 0.0))]
    a, b = g.unit(tuple(x)), g.unit(g.vec("tx", "ty", "tz"))
    near = near.withColumns({f"a{c}": e for c, e in zip(POS, a)} | {f"b{c}": e for c, e in zip(POS, b)})
    a, b = g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz")
    k = g.cross(a, b)
    near = near.withColumns({f"k{c}": e for c, e in zip(POS, k)} | {"cosine": g.dot(a, b)})
    k = g.vec("kx", "ky", "kz")
    f = (1 - F.col("cosine")) / F.greatest(g.dot(k, k), F.lit(1e-10))
    zero, one = F.lit(0.0), F.lit(1.0)
    skew = [[zero, -k[2], k[1]], [k[2], zero, -k[0]], [-k[1], k[0], zero]]
    rot = {}
    for i in range(3):
        for j in range(3):
            square = sum((skew[i][n] * skew[n][j] for n in range(3)), zero)
            rot[f"m{i}{j}"] = (one if i == j else zero) + skew[i][j] + square * f
    base = near.withColumns(rot).withColumn("block", F.floor(F.col("seq") / size)).select(*KEYS, "block", "seq", *MAT)
    local = _chain([*KEYS, "block"], "seq", True)(base)
    whole = local.groupBy(*KEYS, "block").agg(*[F.max_by(m, "seq").alias(m) for m in MAT])
    before = _chain(KEYS, "block", False)(whole)
    before = before.select(*KEYS, "block", *[F.col(m).alias(f"p{m}") for m in MAT])
    full = local.join(before, [*KEYS, "block"])
    prod = {
        f"c{i}{j}": sum((F.col(f"m{i}{n}") * F.col(f"pm{n}{j}") for n in range(3)), zero) for i in range(3) for j in (1, 2)
    }
    full = full.withColumns(prod)
    u, v = g.unit(g.vec("c01", "c11", "c21")), g.unit(g.vec("c02", "c12", "c22"))
    axes = full.select(*KEYS, "seq", *[e.alias(f"u{c}") for e, c in zip(u, POS)], *[e.alias(f"v{c}") for e, c in zip(v, POS)])
    return t.join(axes, [*KEYS, "seq"])
