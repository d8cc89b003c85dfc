"""Nearest neighbours: bounds from several shifted Hilbert orders, then a scan within the bounds.

Equal vectors form a class named by its smallest id; of its ids the ``k`` + 1
smallest are kept, more can't be among ``k`` nearest. Each of ``CURVES`` orders
projects the class vectors onto ``DIMS`` random orthogonal directions, shifts the
grid at random and sorts by the Hilbert key, range-partitioned by Spark. The
orders are cut into blocks of ``BLOCK`` ranks; a query class visits the blocks that
hold the ``WINDOW`` ranks before and after its own, where exact distances pick its
best; the orders' bests merge. Their last distance bounds the query: a scan over all
class vectors, with packs of queries as products of matrices, takes every class
within the bound. So the result is exact whatever the size of the table, the orders
only keep down what the scan sends, and the work is queries times vectors.

Random directions and shifts depend on ``SEED`` only; centre and scale are fitted on
a sample of at most ``SAMPLE`` vectors, the smallest by hash, and every vector is
indexed. Vectors that are null, zero, of another length than most of the sample, or
hold null or non-finite components take no part, as candidates or as queries.
Repeated rows of one id count once. Fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

CURVES = 20
DIMS = 8
BITS = 7
WINDOW = 1280
BLOCK = 4096
SAMPLE = 4096
SEED = 7
#: Numbers in the query vectors of one pass of the scan, and in one product of matrices.
PACK = 4_000_000
TILE = 2_000_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer cell (row) on the Hilbert curve; at most 63 bits in all."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    # From the top bit down, undo the reflections and exchanges of each subcube.
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and scale of every order."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = SEED):
        self.length = sample.shape[1]
        self.centre = sample.mean(0)
        d = min(DIMS, self.length)
        self.bases, self.low, self.width, self.shift = [], [], [], []
        for c in range(curves):
            draw = np.random.default_rng([seed, c])
            basis = np.linalg.qr(draw.normal(size=(self.length, self.length)))[0][:, :d]
            y = (sample - self.centre) @ basis
            self.bases.append(basis)
            self.low.append(y.min())
            self.width.append(max(float(np.ptp(y)), 1e-12))
            self.shift.append(draw.uniform(0, 1, d))

    def keys(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of the vectors ``x`` in each order."""
        for basis, low, width, shift in zip(self.bases, self.low, self.width, self.shift):
            y = (((x - self.centre) @ basis - low) / width + shift) / 2
            cells = np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield hilbert_keys(cells, BITS)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, as doubles, equal rows once."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).filter("id is not null and vec is not null")
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0)
    return rows.filter(sound).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vec, cls, id): each distinct vector's ``k`` + 1 smallest ids; ``cls`` is the smallest."""
    first = Window.partitionBy("vec").orderBy("id")
    ranked = rows.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    return ranked.withColumn("cls", F.min("id").over(Window.partitionBy("vec"))).select("vec", "cls", "id")


def ranked_orders(reps: DataFrame, curves: Curves) -> DataFrame:
    """(curve, cls, rank): ranks run through all orders, one after the other."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def start():
        index = shared.value

        def work(vecs):
            keys = np.stack(list(index.keys(np.array(vecs, float).reshape(len(vecs), index.length))), 1) if vecs else []
            return [[k.tolist() for k in keys]]

        return work

    keyed = with_columns(reps.select("cls", "vec"), ["vec"], [("keys", "array<long>")], start).drop("vec")
    rows = stored(keyed.select("cls", F.posexplode("keys").alias("curve", "key")), "curve-keys")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "curve", "key", "cls").sortWithinPartitions("curve", "key", "cls")
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "curve-order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["part"], total))
        total += r["count"]
    table_of = spark.createDataFrame(offsets, "part long, offset long")
    return placed.withColumn("part", part).join(F.broadcast(table_of), "part").select("curve", "cls", (F.col("offset") + row).alias("rank"))


def best_in_block(k: int, window: int):
    """Exact bests of the queries of one block among its candidates within the window."""

    def run(cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(cands) and len(asks):
            cands = cands.sort_values("rank")
            rank, cls = cands["rank"].to_numpy(), cands["cls"].to_numpy()
            x = np.stack(cands["vec"].to_numpy())
            for q, at, vec in zip(asks["cls"], asks["rank"], asks["vec"]):
                lo, hi = np.searchsorted(rank, [at - window, at + window + 1])
                if lo < hi:
                    d = np.sqrt(((x[lo:hi] - vec) ** 2).sum(1))
                    top = np.lexsort((cls[lo:hi], d))[:k + 1]
                    out.append(pd.DataFrame({"q": q, "cls": cls[lo:hi][top], "score": d[top]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "cls": [], "score": []})

    return run


def scanner(ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int):
    """Classes of Arrow batches (cls, vec) that may be among the ``k`` + 1 best of the queries ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, limit = (x**2).sum(1), bound**2
        for batch in batches:
            cls = batch.column(0).to_numpy()
            y = batch.column(1).flatten().to_numpy().reshape(len(cls), x.shape[1])
            for start in range(0, len(y), 4096):
                part, name = y[start:start + 4096], cls[start:start + 4096]
                size = (part**2).sum(1)
                tile = max(1, TILE // len(part))
                for lo in range(0, len(x), tile):
                    at = slice(lo, lo + tile)
                    # Products round otherwise than differences do; the slack covers both.
                    slack = 1e-12 * x.shape[1] * (norm[at] + size.max())
                    d2 = norm[at, None] + size - 2 * (x[at] @ part.T)
                    over = np.flatnonzero((d2 <= (limit[at] + slack)[:, None]).sum(1) > k + 1)
                    if len(over):
                        last = np.partition(d2[over], k, axis=1)[:, k] + slack[over]
                        limit[lo + over] = np.minimum(limit[lo + over], last)
                    i, j = np.nonzero(d2 <= (limit[at] + slack)[:, None])
                    for s in range(0, len(i), 65536):
                        a, b = i[s:s + 65536], j[s:s + 65536]
                        score = np.sqrt(((part[b] - x[lo + a]) ** 2).sum(1))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + a]), pa.array(name[b]), pa.array(score)], names=["q", "cls", "score"])

    return run


def within_bounds(reps: DataFrame, bounds: DataFrame, length: int, k: int) -> DataFrame:
    """(q, cls, score): for each query (q, vec, bound) every class that may be among its ``k`` + 1 best."""
    spark = reps.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = reps.select("cls", "vec").repartition(parts, "cls")
    packs = max(1, -(-bounds.count() * length // PACK))
    found = None
    for p in range(packs):
        pack = bounds.filter(F.pmod(F.xxhash64("q"), F.lit(packs)) == p).select("q", "vec", "bound").toArrow().combine_chunks()
        if not pack.num_rows:
            continue
        x = pack["vec"].combine_chunks().flatten().to_numpy().reshape(pack.num_rows, length)
        shared = spark.sparkContext.broadcast((pack["q"].to_numpy(), x, pack["bound"].to_numpy()))

        def run(batches, shared=shared):
            return scanner(*shared.value, k)(batches)

        one = stored(dealt.mapInArrow(run, "q long, cls long, score double"), "vector-scan")
        shared.unpersist()
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], "q long, cls long, score double") if found is None else found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", n_curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest of each query among all other rows.

    ``queries`` holds ids of rows of ``vectors`` in ``id_col``. ``n_curves`` and ``window``
    decide how tight the scan's bounds are, not what is found.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    picked = rows.orderBy(F.xxhash64("vec"), "id").limit(SAMPLE).collect()
    empty = spark.createDataFrame([], f"query_id {dict(vectors.dtypes)[id_col]}, rank int, {id_col} {dict(vectors.dtypes)[id_col]}, score double")
    if not picked:
        return empty
    sizes = [len(r["vec"]) for r in picked]
    length = max(set(sizes), key=lambda n: (sizes.count(n), -n))
    curves = Curves(np.array([r["vec"] for r in picked if len(r["vec"]) == length], float), n_curves)
    rows = rows.filter(F.size("vec") == length)
    members = stored(classes(rows, k), "vector-classes")
    reps = members.filter("id = cls").select("cls", "vec")
    asked = rows.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    # Every row of a class may ask, also beyond its smallest ids.
    asks = stored(asked.distinct().join(reps.withColumnRenamed("cls", "q"), "vec").select(F.col("id").alias("query_id"), "q"), "vector-queries")
    placed = stored(ranked_orders(reps, curves).join(reps, "cls").select("curve", "rank", "cls", "vec"), "curve-ranks")
    cands = placed.withColumn("block", F.floor(F.col("rank") / BLOCK))
    visits = placed.join(asks.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi").withColumn(
        "block", F.explode(F.sequence(F.floor((F.col("rank") - window) / BLOCK), F.floor((F.col("rank") + window) / BLOCK)))
    )
    names = ["curve", "block", "rank", "cls", "vec"]
    cands, visits = cands.select(*names), visits.select(*names).toDF(*names)
    found = (
        cands.groupBy("curve", "block").cogroup(visits.groupBy("curve", "block"))
        .applyInPandas(best_in_block(k, window), "q long, cls long, score double")
    )
    merged = found.groupBy("q", "cls").agg(F.min("score").alias("score"))
    best = Window.partitionBy("q").orderBy("score", "cls")
    last = merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k + 1).select("q", F.col("score").alias("bound"))
    bounds = asks.select("q").distinct().join(reps.withColumnRenamed("cls", "q"), "q").join(last, "q", "left")
    bounds = stored(bounds.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "vector-bounds")
    scanned = within_bounds(reps, bounds, length, k)
    top = scanned.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    near = stored(top.join(members.select("cls", "id"), "cls"), "vector-near")
    pairs = asks.join(near, "q").filter(F.col("id") != F.col("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


@query()
def op5_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0").select("vec_id"))
