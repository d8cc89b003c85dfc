"""Edits of trace sets: priority, union, concatenation, branching, transfer, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from ..plans.blocks import BLOCK, ranked, running
from ..plans.casework import by_size, coverage, exchanges, in_cases
from ..session import stored
from .matching import AT, VOX, _balls, ends, nearest_in_trace
from .traces import KEYS, POS


def trace_priority(points: DataFrame) -> DataFrame:
    """Traces of a case by box volume, then point count, descending: ``place`` 1, 2, ..."""
    box = F.lit(1.0)
    for c in POS:
        box = box * (F.max(c) - F.min(c))
    t = points.groupBy(*KEYS).agg(F.round(box, 6).alias("box_volume"), F.count("*").alias("np"))
    order = ranked(t, [F.col("case_id"), F.desc("box_volume"), F.desc("np"), F.col("trace_id")], "_rank")
    first = order.groupBy("case_id").agg(F.min("_rank").alias("_first"))
    return order.join(first, "case_id").select(*KEYS, "box_volume", "np", (F.col("_rank") - F.col("_first") + 1).alias("place"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both trace sets; ids of the second continue after those of the first."""
    top = F.broadcast(a.agg(F.max("trace_id").alias("_top")))  # one row
    return a.unionByName(b.crossJoin(top).withColumn("trace_id", F.col("trace_id") + F.col("_top") + 1).drop("_top"))


def integer_traces(points: DataFrame) -> DataFrame:
    return points.select(*KEYS, "seq", *[g.voxel(F.col(c)).alias(c) for c in POS])


def concatenate(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merge trace ``b`` into trace ``a`` for every row of ``pairs(case_id, a, b, flip, append)``.

    With ``append`` b follows a, else it comes before it.  A prepended trace is stored
    reversed unless ``flip`` is set; an appended one is reversed if ``flip`` is set.
    """
    size = points.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    na = size.select("case_id", F.col("trace_id").alias("a"), F.col("_n").alias("_na"))
    nb = size.select("case_id", F.col("trace_id").alias("b"), F.col("_n").alias("_nb"))
    plan = pairs.join(na, ["case_id", "a"]).join(nb, ["case_id", "b"])
    turned = F.col("flip") == F.col("append")
    part_b = points.join(plan.withColumn("trace_id", F.col("b")), KEYS).withColumn(
        "seq", F.when(turned, F.col("_nb") - 1 - F.col("seq")).otherwise(F.col("seq")) + F.when(F.col("append"), F.col("_na")).otherwise(0)
    ).withColumn("trace_id", F.col("a"))
    part_a = points.join(plan.withColumn("trace_id", F.col("a")), KEYS).withColumn(
        "seq", F.col("seq") + F.when(F.col("append"), 0).otherwise(F.col("_nb"))
    )
    used = pairs.select("case_id", F.col("a").alias("trace_id")).unionByName(pairs.select("case_id", F.col("b").alias("trace_id")))
    rest = points.join(used, KEYS, "left_anti")
    cols = points.columns
    return rest.select(cols).unionByName(part_a.select(cols)).unionByName(part_b.select(cols))


def closest_ends(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """How to merge a and b at their nearest ends: adds ``flip``, ``append`` and ``dist``.

    Order of preference at equal distance: head-head, head-tail, tail-head, tail-tail.
    """
    e = stored(ends(points).select(*KEYS, "end", *POS), "ends")

    def pick(end, tag, name):
        return e.where(f"end = {end}").select("case_id", F.col("trace_id").alias(name), *[F.col(c).alias(f"{tag}{c}") for c in POS])

    full = pairs
    for tag, end, name in (("ah", 0, "a"), ("at", 1, "a"), ("bh", 0, "b"), ("bt", 1, "b")):
        full = full.join(pick(end, tag, name), ["case_id", name])
    v = lambda t: g.vec(*[f"{t}{c}" for c in POS])
    ways = [("ah", "bh", False, False), ("ah", "bt", True, False), ("at", "bh", False, True), ("at", "bt", True, True)]
    best = F.array_min(F.array(*[
        F.struct(g.dist(v(s), v(t)).alias("dist"), F.lit(i).alias("i"), F.lit(f).alias("flip"), F.lit(p).alias("append")) for i, (s, t, f, p) in enumerate(ways)
    ]))
    return full.withColumn("_b", best).select(*pairs.columns, "_b.dist", "_b.flip", "_b.append")


def branch_to(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Snap or add end points: ``targets(case_id, trace_id, end, tx, ty, tz, t_rad)``.

    An end nearer than 1 moves to the target, else the target becomes the new end.
    """
    size = points.groupBy(*KEYS).agg(F.max("seq").alias("_top"))
    h = targets.where("end = 0").select(*KEYS, *[F.col(f"t{c}").alias(f"_h{c}") for c in POS], F.col("t_rad").alias("_hr"))
    t = targets.where("end = 1").select(*KEYS, *[F.col(f"t{c}").alias(f"_t{c}") for c in POS], F.col("t_rad").alias("_tr"))
    e = stored(ends(points).select(*KEYS, "end", *POS), "ends")
    near = e.join(targets.select(*KEYS, "end", "tx", "ty", "tz"), [*KEYS, "end"]).withColumn(
        "_snap", g.dist(g.vec(*POS), g.vec("tx", "ty", "tz")) < 1
    ).select(*KEYS, "end", "_snap")
    sh = near.where("end = 0").select(*KEYS, F.col("_snap").alias("_sh"))
    st = near.where("end = 1").select(*KEYS, F.col("_snap").alias("_st"))
    plan = size.join(h, KEYS, "left").join(t, KEYS, "left").join(sh, KEYS, "left").join(st, KEYS, "left")
    p = points.join(plan, KEYS)
    is_h, is_t = F.col("seq") == 0, F.col("seq") == F.col("_top")
    moved = p.withColumns({
        c: F.when(is_h & F.col("_sh"), F.col(f"_h{c}")).when(is_t & F.col("_st"), F.col(f"_t{c}")).otherwise(F.col(c)) for c in POS
    }).withColumn("seq", F.col("seq") + F.when(F.col("_sh") == F.lit(False), 1).otherwise(0))
    base = ["seq", *POS, "rad"]
    shift = F.when(F.col("_sh") == F.lit(False), 1).otherwise(0)
    new_h = plan.where("_sh = false").select(*KEYS, F.lit(0).cast("bigint").alias("seq"), *[F.col(f"_h{c}").alias(c) for c in POS], F.col("_hr").alias("rad"))
    new_t = plan.where("_st = false").select(*KEYS, (F.col("_top") + 1 + shift).alias("seq"), *[F.col(f"_t{c}").alias(c) for c in POS], F.col("_tr").alias("rad"))
    return moved.select(*KEYS, *base).unionByName(new_h).unionByName(new_t)


def junction_table(points: DataFrame) -> DataFrame:
    """Trace ends that lie exactly on the inside of another trace (one row per end).

    (case_id, trace_id, end, other, at, other_n, n): the other trace meets the end at ``at``.
    """
    e = ends(points)
    size = points.groupBy(*KEYS).agg(F.count("*").alias("n"))
    keyed = lambda df: df.withColumn("_k", g.position_cells(g.vec(*POS)))
    body = keyed(points).select("case_id", "_k", F.col("trace_id").alias("other"), F.col("seq").alias("at"))
    hit = keyed(e).select(*KEYS, "end", "_k").join(body, ["case_id", "_k"]).where("trace_id <> other")
    first = hit.groupBy(*KEYS, "end").agg(F.min(F.struct("other", "at")).alias("m")).select(*KEYS, "end", "m.*")
    on = size.select("case_id", F.col("trace_id").alias("other"), F.col("n").alias("other_n"))
    return first.join(on, ["case_id", "other"]).join(size, KEYS).where("at > 0 and at < other_n - 1")


def transfer_decisions(points: DataFrame, mode: str = "length", degree: DataFrame | None = None) -> DataFrame:
    """For each junction: which piece of the other trace joins the ending trace.

    ``piece`` is front, back or NULL (no change).  ``length``: the shorter half, if the
    ending trace has at least as many points.  ``z``: the half that covers more slices together
    with it.  ``angle``: the half that continues its direction best (degree above 2 only).
    """
    j = junction_table(points)
    if mode == "length":
        small = F.least("at", F.col("other_n") - F.col("at"))
        return j.withColumn("piece", F.when(F.col("n") < small, F.lit(None)).when(F.col("at") > F.floor(F.col("other_n") / 2), "front").otherwise("back"))
    j = stored(j, "junctions")
    other = points.select("case_id", F.col("trace_id").alias("other"), F.col("seq").alias("oseq"), *POS)
    if mode == "z":
        half = other.join(j.select("case_id", "other", "at", "trace_id", "end"), ["case_id", "other"]).withColumn("_z", g.voxel(F.col("z")))
        front = F.col("oseq") < F.col("at")
        lim = half.groupBy(*KEYS, "end").agg(
            F.min(F.when(front, F.col("_z"))).alias("a0"), F.max(F.when(front, F.col("_z"))).alias("a1"),
            F.min(F.when(~front, F.col("_z"))).alias("b0"), F.max(F.when(~front, F.col("_z"))).alias("b1"),
        )
        own = points.groupBy(*KEYS).agg(F.min(g.voxel(F.col("z"))).alias("i0"), F.max(g.voxel(F.col("z"))).alias("i1"))

        def span(p, q):  # size of the union of two half-open ranges
            over = F.greatest(F.lit(0), F.least(F.col(f"{p}1"), F.col(f"{q}1")) - F.greatest(F.col(f"{p}0"), F.col(f"{q}0")))
            return (F.col(f"{p}1") - F.col(f"{p}0")) + (F.col(f"{q}1") - F.col(f"{q}0")) - over

        w = j.join(lim, [*KEYS, "end"]).join(own, KEYS).withColumns({"_f": span("i", "a"), "_e": span("i", "b")})
        alone = F.greatest(F.col("i1") - F.col("i0"), F.greatest("a1", "b1") - F.least("a0", "b0"))
        pick = F.when(alone > F.greatest("_f", "_e"), F.lit(None)).when(F.col("_f") > F.col("_e"), "front").otherwise("back")
        return w.withColumn("piece", pick).select(*j.columns, "piece")
    e = points.select(*KEYS, "seq", *POS)

    def at(df, key, seq, tag):
        side = e.select("case_id", F.col("trace_id").alias(key), F.col("seq").alias("_s"), *[F.col(c).alias(f"{tag}{c}") for c in POS])
        return df.withColumn("_s", seq.cast("bigint")).join(side, ["case_id", key, "_s"]).drop("_s")

    own_end = F.when(F.col("end") == 0, F.lit(0)).otherwise(F.col("n") - 1)
    own_in = F.when(F.col("end") == 0, F.least(F.col("n") - 1, F.lit(2))).otherwise(F.greatest(F.lit(0), F.col("n") - 3))
    w = at(at(j, "trace_id", own_end, "p"), "trace_id", own_in, "q")
    w = at(at(at(w, "other", F.col("at"), "o"), "other", F.greatest(F.lit(0), F.col("at") - 2), "f"), "other", F.least(F.col("other_n") - 1, F.col("at") + 2), "b")
    v = lambda t: g.vec(*[f"{t}{c}" for c in POS])
    s, f, b = (g.unit(g.sub(v(x), v(y))) for x, y in (("q", "p"), ("f", "o"), ("b", "o")))
    v1, v2, v12 = g.dot(s, f), g.dot(s, b), g.dot(f, b)
    least = F.least(v1, v2, v12)
    pick = F.when(v1 == least, "front").when(v2 == least, "back")
    if degree is not None:
        deg = degree.select("case_id", F.col("trace_id").alias("other"), F.col("seq").alias("at"), "degree")
        w = w.join(deg, ["case_id", "other", "at"])
        pick = F.when(F.col("degree") > 2, pick)
    return w.withColumn("piece", pick).select(*j.columns, "piece")


def transfer(points: DataFrame, mode: str = "length", degree: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Re-join traces at junctions until nothing changes; each round settles a junction at least.

    ``degree(points)`` gives the degrees of the traces as they are; the angle mode asks for
    them anew in every round.

    In a round a trace takes part in one exchange only: the decision with the lowest
    (trace, end) wins; a junction position is handled once.  By length, cases with few enough points go through
    their rounds inside a task each.
    """
    cols = points.columns
    pts = stored(points, "traces")
    if mode != "length":
        return _transfer_rounds(pts, mode, degree)
    small, large = by_size(pts)
    spot = small.withColumn("_spot", F.to_json(g.position_cells(g.vec(*POS))))
    done = in_cases(spot, exchanges, ", ".join(f"`{c}` {t}" for c, t in pts.dtypes if c != "case_id")).select(cols)
    return done if large is None else done.unionByName(_transfer_rounds(stored(pts.join(large, "case_id", "left_semi").select(cols), "traces"), mode))


def _transfer_rounds(pts: DataFrame, mode: str, degree: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``transfer`` in rounds of joins."""
    cols = pts.columns
    seen = None
    while True:
        d = transfer_decisions(pts, mode, degree(pts) if degree else None).where("piece is not null")
        spot = pts.select("case_id", F.col("trace_id").alias("other"), F.col("seq").alias("at"), g.position_cells(g.vec(*POS)).alias("spot"))
        d = stored(d.join(spot, ["case_id", "other", "at"]), "decisions")
        if seen is not None:
            d = d.join(seen, ["case_id", "spot"], "left_anti")
        # The lowest decision of every trace it touches goes ahead.
        touch = d.select("case_id", F.col("trace_id").alias("t"), F.struct("trace_id", "end").alias("me")).unionByName(
            d.select("case_id", F.col("other").alias("t"), F.struct("trace_id", "end").alias("me"))
        )
        low = touch.groupBy("case_id", "t").agg(F.min("me").alias("lo"))
        go = d.join(low.select("case_id", F.col("t").alias("trace_id"), F.col("lo").alias("l1")), KEYS).join(
            low.select("case_id", F.col("t").alias("other"), F.col("lo").alias("l2")), ["case_id", "other"]
        ).where((F.col("l1") == F.struct("trace_id", "end")) & (F.col("l2") == F.struct("trace_id", "end"))).drop("l1", "l2")
        go = stored(go, "exchange")
        if not go.limit(1).count():
            break
        new = go.select("case_id", "spot").distinct()
        seen = new if seen is None else seen.unionByName(new)
        # The cut piece excludes the junction point itself; the rest of the other trace keeps its order.
        cut = pts.join(go.select("case_id", F.col("other").alias("trace_id"), F.col("trace_id").alias("_to"), "end", "at", "other_n", "n", "piece"), KEYS)
        back = F.col("piece") == "back"
        gone = F.when(back, F.col("seq") > F.col("at")).otherwise(F.col("seq") < F.col("at"))
        k = F.when(back, F.col("seq") - F.col("at") - 1).otherwise(F.col("at") - 1 - F.col("seq"))  # steps from the junction
        m = F.when(back, F.col("other_n") - F.col("at") - 1).otherwise(F.col("at"))
        moved = cut.where(gone).withColumn("_k", k).withColumn("_m", m).withColumn(
            "seq", F.when(F.col("end") == 0, F.col("_m") - 1 - F.col("_k")).otherwise(F.col("n") + F.col("_k"))
        ).withColumn("trace_id", F.col("_to")).select(cols)
        rest = cut.where(~gone).withColumn("seq", F.when(back, F.col("seq")).otherwise(F.col("seq") - F.col("at"))).select(cols)
        grow = pts.join(go.select(*KEYS, "end", F.when(back, F.col("other_n") - F.col("at") - 1).otherwise(F.col("at")).alias("_m")), KEYS).withColumn(
            "seq", F.when(F.col("end") == 0, F.col("seq") + F.col("_m")).otherwise(F.col("seq"))
        ).select(cols)
        used = go.select(*KEYS).unionByName(go.select("case_id", F.col("other").alias("trace_id")))
        pts = stored(pts.join(used, KEYS, "left_anti").select(cols).unionByName(moved).unionByName(rest).unionByName(grow), "traces")
    return pts


def _uncovered(points: DataFrame) -> DataFrame:
    """Points with ``covered`` and the ``owner`` of the ball that covers them.

    Cases with few enough points are walked inside a task each, the others in rounds of joins.
    """
    pr = trace_priority(points).select(*KEYS, "place")
    small, large = by_size(points)
    rows = small.join(pr, KEYS).where("seq is not null").withColumns({f"_v{c}": g.voxel(F.col(c)) for c in POS}).withColumn("_r", F.bround("rad").cast("bigint"))
    kind = dict(points.dtypes)
    schema = [f"`{c}` {kind[c]}" for c in points.columns if c != "case_id"] + [f"owner {kind['trace_id']}", "covered boolean"]
    done = in_cases(rows.select(*points.columns, "place", "_vx", "_vy", "_vz", "_r"), coverage, ", ".join(schema))
    return done if large is None else done.unionByName(_uncovered_rounds(stored(points.join(large, "case_id", "left_semi"), "traces"), pr))


def _uncovered_rounds(points: DataFrame, pr: DataFrame) -> DataFrame:
    """``_uncovered`` in rounds: a trace is decided once all before it that reach it are."""
    pr = pr.join(points.select(*KEYS).distinct(), KEYS, "left_semi")
    balls = stored(_balls(points, F.bround("rad"), 0).select(*VOX, "trace_id", "seq").distinct().join(pr, KEYS), "balls")
    at = stored(points.withColumns({f"v{c}": g.voxel(F.col(c)) for c in POS}).select(*VOX, "trace_id", "seq").join(pr, KEYS), "places")
    over = balls.select(*VOX, F.col("trace_id").alias("winner"), F.col("place").alias("w_place")).distinct()
    wait = at.join(over, VOX).where("w_place < place").select("case_id", "trace_id", "winner").distinct()
    wait = stored(wait, "waiting")
    left = stored(pr, "undecided")
    painted = decided = None
    while True:
        now = stored(left.join(wait.select(*KEYS).distinct(), KEYS, "left_anti"), "ready")
        if now.isEmpty():
            break
        mine = at.join(now.select(*KEYS), KEYS, "left_semi")
        if painted is None:
            flag = mine.withColumn("owner", F.lit(None).cast("bigint"))
        else:
            flag = mine.join(painted, VOX, "left").groupBy(*KEYS, "seq", *VOX[1:], "place").agg(
                F.min(F.when(F.col("w_place") < F.col("place"), F.struct("w_place", "winner"))).alias("o")
            ).withColumn("owner", F.col("o.winner")).drop("o")
        flag = stored(flag.select(*KEYS, "seq", "owner"), "flags")
        kept = flag.where("owner is null").select(*KEYS, "seq")
        new = stored(balls.join(kept, [*KEYS, "seq"], "left_semi").select(*VOX, F.col("trace_id").alias("winner"), F.col("place").alias("w_place")).distinct(), "painted")
        painted = new if painted is None else painted.unionByName(new)
        decided = flag if decided is None else decided.unionByName(flag)
        left = stored(left.join(now.select(*KEYS), KEYS, "left_anti"), "undecided")
        wait = stored(wait.join(now.select("case_id", F.col("trace_id").alias("winner")), ["case_id", "winner"], "left_anti"), "waiting")
    if decided is None:
        return points.withColumns({"owner": F.lit(None).cast("bigint"), "covered": F.lit(False)})
    return points.join(decided, [*KEYS, "seq"]).withColumn("covered", F.col("owner").isNotNull())


def remove_duplicate_coverage(points: DataFrame, reattach: float = 5.0, size: int = BLOCK) -> DataFrame:
    """Drop points inside the balls of kept points of traces with higher priority; split what is left and re-attach it.

    A trace is decided once all traces of higher priority whose balls reach one of its points
    are, so the result is that of walking the traces in order of priority.
    Pieces of at least two points stay; a piece end cut off by a covering trace gets the nearest
    point of that trace if it is closer than ``reattach``.  Adds ``piece``.
    """
    p = stored(_uncovered(points), "covered")
    run = running(p, KEYS, "seq", {"piece": F.col("covered").cast("bigint")}, size=size).where("not covered")
    span = run.groupBy(*KEYS, "piece").agg(F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.count("*").alias("np")).where("np > 1")
    span = stored(span, "pieces")
    kept = run.join(span, [*KEYS, "piece"])
    body = kept.select(*KEYS, "piece", (F.col("seq") - F.col("s0") + 1).alias("seq"), *POS, "rad")
    edge = p.select(*KEYS, F.col("seq").alias("_at"), "owner", "covered")
    side = []
    for name, pos, at, new in (("s0", "s0", F.col("s0") - 1, F.lit(0).cast("bigint")), ("s1", "s1", F.col("s1") + 1, F.col("np") + 1)):
        cut = span.withColumn("_at", at).join(edge, [*KEYS, "_at"]).where("covered").withColumn("_new", new)
        own = points.select(*KEYS, F.col("seq").alias(pos), *[F.col(c).alias(f"q{c}") for c in POS])
        q = cut.join(own, [*KEYS, pos]).select("case_id", F.col("owner").alias("trace_id"), F.struct(F.col("trace_id").alias("t"), "piece", "_new").alias("q_id"), *AT)
        hit = nearest_in_trace(q, points, reattach).where(F.col("dist") < reattach)
        got = hit.join(points.select(*KEYS, "seq", *POS, "rad"), [*KEYS, "seq"])
        side.append(got.select("case_id", F.col("q_id.t").alias("trace_id"), F.col("q_id.piece").alias("piece"), F.col("q_id._new").alias("seq"), *POS, "rad"))
    return body.unionByName(side[0]).unionByName(side[1])


def link_costs(values: DataFrame, keys: list[str]) -> DataFrame:
    """Costs of links from their sampled values: ``-mean`` and ``-mean + std``."""
    return values.groupBy(*keys).agg((-F.avg("v")).alias("neg_mean"), (F.stddev_pop("v") - F.avg("v")).alias("loss"))


def radius_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (a + b) * 2

