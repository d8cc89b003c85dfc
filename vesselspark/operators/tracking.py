"""Multi-object-tracking metrics of traced against reference vessels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.blocks import BLOCK, neighbours
from ..plans.casework import by_size, in_cases
from ..plans.grid import PAIRS, near_pairs, within
from ..session import forget, stored
from .matching import AT
from .traces import KEYS, POS

GT = ["case_id", "g"]


def _picks(open_: list[tuple[int, int, list[int]]]) -> list[int]:
    """Order in which one reference trace takes traced ids: most open points first.

    ``open_`` has the distinct candidate sets along the trace with their first point and
    point count, so that it does not grow with the length of the trace.
    """
    picks = []
    while open_:
        votes: dict[int, int] = {}
        met: dict[int, tuple[int, int]] = {}
        for first, n, sig in open_:
            for p in sig:
                votes[p] = votes.get(p, 0) + n
                met[p] = min(met.get(p, (first, p)), (first, p))
        best = min(votes, key=lambda p: (-votes[p], met[p]))
        picks.append(best)
        open_ = [row for row in open_ if best not in row[2]]
    return picks


def _cover(pdf: pd.DataFrame) -> pd.DataFrame:
    """``_picks`` of one reference trace."""
    picks = _picks([(int(r.first_seq), int(r.n), [int(p) for p in r.sig]) for r in pdf.itertuples()])
    return pd.DataFrame({
        "case_id": [int(pdf["case_id"].iloc[0])] * len(picks), "g": [int(pdf["g"].iloc[0])] * len(picks),
        "p": picks, "ord": range(len(picks)),
    })


def _match(table: pa.Table) -> Iterator[dict]:
    """Assignment (``what`` 0), matched (1) and linked (2) traced points of a case, walking its vessels in order; ``what`` of the input is 0 for vessels."""
    table = table.sort_by([("a", "ascending"), ("s", "ascending")])
    side = lambda k: table.filter(pc.equal(table["what"], k))
    place = lambda t: np.stack([t[c].to_numpy().astype(float) for c in POS], axis=1)
    vessels, traced = side(0), side(1)
    g, gseq, at, reach = vessels["a"].to_numpy(), vessels["s"].to_numpy(), place(vessels), vessels["rad"].to_numpy().astype(float) + 1
    spots = place(traced)
    fine = np.isfinite(spots).all(axis=1)
    spots, p, pseq = spots[fine], traced["a"].to_numpy()[fine], traced["s"].to_numpy()[fine]
    # Rows are in the order of (trace, point): one number for each distinct point.
    point = np.cumsum(np.concatenate([[False], (p[1:] != p[:-1]) | (pseq[1:] != pseq[:-1])])[:len(p)])
    linked, matched = np.zeros(len(p), bool), np.zeros(len(p), bool)
    trace = np.cumsum(np.concatenate([[False], p[1:] != p[:-1]])[:len(p)])
    search = within(spots)
    out: list[tuple] = []

    def closest(a: int, found: list[tuple]) -> tuple:
        """Of (vessel point, traced point, distance) the nearest point of each trace; equally near ones: the first."""
        i, j, d = (np.concatenate(c) for c in zip(*found))
        # Vessel points with one number count as one.
        same = np.searchsorted(gseq[a:a + i.max() + 1], gseq[a + i]) if len(i) else i
        key = same * (trace[-1] + 1) + trace[j]
        order = np.lexsort((j, d, key))
        key = key[order]
        order = order[np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]]
        return same[order], j[order], d[order]

    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[:len(g)])
    for a, b in zip(start, np.append(start[1:], len(g))):
        best, held = [], 0
        for i, j, d in search(at[a:b], reach[a:b]):
            free = ~linked[point[j]]
            best.append((i[free], j[free], d[free]))
            held += len(best[-1][0])
            if held > PAIRS:
                best = [closest(a, best)]
                held = len(best[0][0])
        if not held:
            continue
        i, j, d = closest(a, best)
        s = gseq[a + i]
        names = p[j].tolist()
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[:len(s)]).tolist()
        sets: dict[tuple, list] = {}
        for lo, hi in zip(first, [*first[1:], len(s)]):
            sets.setdefault(tuple(names[lo:hi]), [int(s[lo]), 0])[1] += 1
        rank = {name: k for k, name in enumerate(_picks([(f, n, list(sig)) for sig, (f, n) in sets.items()]))}
        ord_ = [rank.get(name, -1) for name in names]
        for lo, hi in zip(first, [*first[1:], len(s)]):
            k = max(range(lo, hi), key=ord_.__getitem__)
            out.append((int(g[a]), int(s[lo]), names[k], float(d[k])))
        matched[point[j]] = True
        linked[point[j[np.asarray(ord_) >= 0]]] = True
    head = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]])[:len(point)])
    for what, flag in ((1, matched), (2, linked)):
        rows = head[flag[point[head]]]
        yield {"what": np.full(len(rows), what, np.int32), "g": pa.nulls(len(rows), pa.int64()), "seq": pseq[rows], "p": p[rows], "dist": pa.nulls(len(rows), pa.float64())}
    yield {"what": np.zeros(len(out), np.int32)} | {n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate((("g", pa.int64()), ("seq", pa.int64()), ("p", pa.int64()), ("dist", pa.float64())))}


def turns(cand: DataFrame) -> DataFrame:
    """Round in which each vessel is matched (case_id, g, turn): after every earlier vessel that shares a candidate point.

    Around a point each vessel waits for the one before it there, so rivals are no pairs of candidates.
    """
    around = Window.partitionBy("case_id", "p", "pseq").orderBy("g")
    rivals = cand.select("case_id", "p", "pseq", "g").distinct().select(*GT, F.lag("g").over(around).alias("_before"))
    rivals = stored(rivals.where("_before is not null").distinct(), "rivals")
    open_ = stored(cand.select(*GT).distinct(), "open")
    out, turn = open_.withColumn("turn", F.lit(0)).limit(0), 0
    while not open_.isEmpty():  # the first vessel left is always ready
        now = stored(open_.join(rivals.select(*GT).distinct(), GT, "left_anti"), "turns")
        turn += 1
        out = now.withColumn("turn", F.lit(turn)) if turn == 1 else out.unionByName(now.withColumn("turn", F.lit(turn)))
        held = (rivals, open_)
        rivals = stored(rivals.join(now.withColumnRenamed("g", "_before"), ["case_id", "_before"], "left_anti"), "rivals")
        open_ = stored(open_.join(now, GT, "left_anti"), "open")
        for old in held:
            forget(old)
    return stored(out, "turns")


def assign_traces(vessels: DataFrame, traced: DataFrame, cell: float = 6.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match vessel points to traced points nearer than their radius + 1.

    ``vessels(case_id, g, seq, x, y, z, rad)``; vessels are taken in the order of ``g``, and
    traced points linked by an earlier vessel are not offered again.  Cases with few enough points are walked
    inside a task each, the others in rounds.  Returns (assignment, matched traced points, linked traced points).
    """
    here = vessels.select("case_id", F.lit(0).alias("what"), F.col("g").cast("bigint").alias("a"), F.col("seq").cast("bigint").alias("s"), *POS, "rad")
    there = traced.select("case_id", F.lit(1).alias("what"), F.col("trace_id").cast("bigint").alias("a"), F.col("seq").cast("bigint").alias("s"), *POS, F.lit(None).cast(here.schema["rad"].dataType).alias("rad"))
    small, large = by_size(here.unionByName(there).dropna(subset=["case_id", "a", "s"]))
    found = stored(in_cases(small, _match, "what int, g bigint, seq bigint, p bigint, dist double"), "matches")
    name = {"p": F.col("p").cast(traced.schema["trace_id"].dataType), "g": F.col("g").cast(vessels.schema["g"].dataType)}
    seq = lambda df, alias: F.col("seq").cast(df.schema["seq"].dataType).alias(alias)
    assigned = found.where("what = 0").withColumns(name).select(*GT, seq(vessels, "gseq"), "p", "dist")
    matched, linked = (found.where(F.col("what") == k).withColumns(name).select("case_id", "p", seq(traced, "pseq")) for k in (1, 2))
    if large is None:
        return assigned, matched, linked
    rest = _assign_rounds(*(df.join(large, "case_id", "left_semi") for df in (vessels, traced)), cell)
    return tuple(a.unionByName(b) for a, b in zip((assigned, matched, linked), rest))


def _assign_rounds(vessels: DataFrame, traced: DataFrame, cell: float = 6.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``assign_traces`` in rounds.

    Vessels that share no candidate point do not depend on each other, so each round handles every vessel whose
    earlier rivals are done.  Candidates are written once, in the order of their rounds, and a round reads its own.
    """
    q = vessels.select(*GT, F.col("seq").alias("gseq"), F.col("rad").alias("q_rad"), *[F.col(c).alias(f"q{c}") for c in POS])
    t = traced.select("case_id", F.col("trace_id").alias("p"), F.col("seq").alias("pseq"), *POS)
    cand = stored(near_pairs(q, t, F.col("q_rad") + 1, AT, cell=cell).select(*GT, "gseq", "p", "pseq", "dist"), "pairs")
    turn = turns(cand)
    ordered = stored(cand.join(turn, GT).sortWithinPartitions("turn"), "candidates")
    forget(cand)
    assigned = matched = linked = None
    for k in range(1, (turn.agg(F.max("turn")).first()[0] or 0) + 1):
        now = ordered.where(F.col("turn") == k).drop("turn")
        if linked is not None:
            now = now.join(linked, ["case_id", "p", "pseq"], "left_anti")
        best = now.groupBy(*GT, "gseq", "p").agg(F.min(F.struct("dist", "pseq")).alias("m")).select(*GT, "gseq", "p", "m.*")
        best = stored(best, "best")
        sig = best.groupBy(*GT, "gseq").agg(F.sort_array(F.collect_set("p")).alias("sig"))
        sets = sig.groupBy(*GT, "sig").agg(F.count("*").alias("n"), F.min("gseq").alias("first_seq"))
        picks = sets.groupBy(*GT).applyInPandas(_cover, "case_id long, g long, p long, ord long")
        hit = stored(best.join(picks, [*GT, "p"], "left"), "hits")
        forget(best)
        took = hit.where("ord is not null")
        a = took.groupBy(*GT, "gseq").agg(F.max(F.struct("ord", "p", "dist")).alias("m")).select(*GT, "gseq", "m.p", "m.dist")
        m = hit.select("case_id", "p", "pseq")
        lk = took.select("case_id", "p", "pseq")
        assigned = a if assigned is None else assigned.unionByName(a)
        matched = m if matched is None else matched.unionByName(m)
        linked = lk if linked is None else linked.unionByName(lk)
    forget(ordered)
    if assigned is None:
        none = t.join(vessels.select(*GT, F.col("seq").alias("gseq"), F.lit(0.0).alias("dist")), "case_id").limit(0)
        empty = none.select("case_id", "p", "pseq")
        return none.select(*GT, "gseq", "p", "dist"), empty, empty
    return stored(assigned, "assigned"), stored(matched.distinct(), "matched"), stored(linked.distinct(), "linked")


def mot_metrics(vessels: DataFrame, traced: DataFrame, size: int = BLOCK) -> DataFrame:
    """TP, FN, FP, IDS, MOTA, MOTP, MT, ML, fragmentation, IDTP, IDFN, IDFP, IDF1 per case."""
    vessels = stored(vessels, "vessels")
    assigned, matched, linked = assign_traces(vessels, traced)
    along = vessels.select(*GT, "seq").join(assigned.withColumnRenamed("gseq", "seq"), [*GT, "seq"], "left").withColumn(
        "p", F.coalesce("p", F.lit(-1))
    )
    near = neighbours(along, GT, "seq", {"p0": ("p", -1)}, size)
    lost, was_lost = F.col("p") == -1, F.col("p0") == -1
    per = near.groupBy(*GT).agg(
        F.count("*").alias("t"), F.count_if(~lost).alias("tp"), F.count_if(lost).alias("fn"),
        F.count_if(F.col("p0").isNotNull() & (lost != was_lost)).alias("frag"), F.count_if(F.col("p") != F.col("p0")).alias("ids"),
        F.sum("dist").alias("dsum"), F.count("dist").alias("dn"),
    )
    case = per.groupBy("case_id").agg(
        F.sum("t").alias("t"), F.sum("tp").alias("TP"), F.sum("fn").alias("FN"), F.sum("ids").alias("IDS"), F.sum("frag").alias("fragmentation"),
        F.count_if(F.col("tp") / F.col("t") > 0.8).alias("MT"), F.count_if(F.col("fn") / F.col("t") > 0.8).alias("ML"),
        (F.sum("dsum") / F.sum("dn")).alias("MOTP"),
    )
    np_ = traced.groupBy("case_id").agg(F.count("*").alias("np"))
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    out = case.join(np_, "case_id", "left").join(n(matched, "m"), "case_id", "left").join(n(linked, "l"), "case_id", "left").fillna(0, ["np", "m", "l"])
    out = out.withColumns({"FP": F.col("np") - F.col("m"), "IDFP": F.col("np") - F.col("l"), "IDTP": F.col("TP"), "IDFN": F.col("FN")})
    return out.withColumns({
        "MOTA": 1 - (F.col("FN") + F.col("FP") + F.col("IDS")) / F.col("t"),
        "IDF1": F.try_divide(2 * F.col("IDTP"), 2 * F.col("IDTP") + F.col("IDFP") + F.col("IDFN")),
    }).drop("t", "np", "m", "l")


def vessel_order(points: DataFrame) -> DataFrame:
    """Add ``g``: vessels in the order of vessel type, then trace."""
    return points.withColumn("g", F.col("vestype") * (1 << 40) + F.col("trace_id"))
