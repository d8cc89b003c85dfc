"""Evaluation metrics over voxel, score and box tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lookups import CLASS_LABELS
from ..plans import casework
from ..plans.blocks import BLOCK, neighbours, ranked, running, running_values
from ..plans.casework import by_size, in_cases, surfaces
from ..plans.grid import distance, nearest_growing
from ..plans.graphloop import components
from ..plans.rounds import best_free, first_free
from ..plans.voxelgrid import KEY, SIX, TWENTY_SIX, mask_components, neighbour_edges, run_edges, runs, spread, surface, voxel_id  # noqa: F401
from ..session import stored

EPS = 1e-8


def dice_ratio(overlap2: Column, total: Column, eps: float = EPS) -> Column:
    return (overlap2 + eps) / (total + eps)


def dice(voxels: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Smoothed Dice of ``gt > 0`` and ``pred > 0`` with its two parts."""
    g, p = (F.col("gt") > 0).cast("bigint"), (F.col("pred") > 0).cast("bigint")
    return voxels.groupBy(*keys).agg((2 * F.sum(g * p)).alias("overlapx2"), F.sum(g + p).alias("total")).withColumn(
        "dice", dice_ratio(F.col("overlapx2"), F.col("total"))
    )


def dice_of_ratio(voxels: DataFrame, value: str, ratio: float = 0.5, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Plain Dice of ``value > ratio * max`` against the true mask."""
    top = voxels.groupBy(*keys).agg((F.max(value) * ratio).alias("_t"))
    g, p = (F.col("gt") > 0).cast("bigint"), (F.col(value) > F.col("_t")).cast("bigint")
    return voxels.join(top, list(keys)).groupBy(*keys).agg(
        F.try_divide(2.0 * F.sum(g * p), F.sum(g + p)).alias("dsc")
    )


def ratios(counts: DataFrame) -> DataFrame:
    """Sensitivity, precision, F1 and specificity from summed counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({
        "sensitivity": tp / (tp + fn + EPS), "precision": tp / (tp + fp + EPS), "specificity": tn / (tn + fp + EPS),
    })
    se, pc = F.col("sensitivity"), F.col("precision")
    return out.withColumn("f1", 2 * pc * se / (pc + se + EPS))


def confusion(voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g, p = F.col("gt") > 0, F.col("pred") > 0
    return ratios(voxels.groupBy(*keys).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    ))


def slice_confusion(voxels: DataFrame, keys: Sequence[str] = (), ref_tn: bool = False) -> DataFrame:
    """A slice counts as positive if any of its voxels is.

    ``ref_tn`` gives the true negatives of a logical instead of an arithmetic sum.
    """
    slices = voxels.groupBy(*dict.fromkeys([*keys, "case_id", "z"])).agg(
        F.bool_or(F.col("gt") > 0).alias("g"), F.bool_or(F.col("pred") > 0).alias("p")
    )
    g, p = F.col("g"), F.col("p")
    tn = F.count_if(~g & ~p) + (F.count_if(g & p) if ref_tn else 0)
    return ratios(slices.groupBy(*keys).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), tn.alias("tn")
    ))


def dice_per_class(voxels: DataFrame) -> DataFrame:
    """Dice of every label in either mask, their plain average and the merged mask.

    One partial count per (case, gt, pred) pair feeds all rows.  A case without labels scores 0.
    """
    pair = voxels.groupBy("case_id", "gt", "pred").agg(F.count("*").alias("n"))
    pair = stored(pair, "pairs")
    side = F.explode(F.array(
        F.struct(F.col("gt").alias("lab"), F.col("n").alias("size"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("lab"), F.col("n").alias("size"), F.lit(0).cast("bigint").alias("hit")),
    ))
    per = pair.select("case_id", side.alias("s")).select("case_id", "s.*").where("lab > 0").groupBy("case_id", "lab").agg(
        (2.0 * F.sum("hit") / F.sum("size")).alias("dice")
    )
    names = F.create_map(*[F.lit(v) for kv in CLASS_LABELS.items() for v in kv])
    rows = per.select("case_id", F.coalesce(names[F.col("lab").cast("int")], F.col("lab").cast("string")).alias("label"), "dice")
    cases = pair.groupBy("case_id").agg(
        F.coalesce(F.try_divide(2.0 * F.sum(F.when((F.col("gt") > 0) & (F.col("pred") > 0), F.col("n"))),
                                F.sum(((F.col("gt") > 0).cast("int") + (F.col("pred") > 0).cast("int")) * F.col("n"))), F.lit(0.0)).alias("merged")
    )
    avg = cases.join(per.groupBy("case_id").agg(F.avg("dice").alias("avg")), "case_id", "left")
    return rows.unionByName(avg.select("case_id", F.lit("average").alias("label"), F.coalesce("avg", F.lit(0.0)).alias("dice"))).unionByName(
        avg.select("case_id", F.lit("merged").alias("label"), F.col("merged").alias("dice"))
    )


def class_mean_dice(per_class: DataFrame) -> DataFrame:
    """Mean over the classes of a case without NaN, then over cases."""
    ok = F.when(~F.isnan("dice"), F.col("dice"))
    return per_class.groupBy("case_id").agg(F.avg(ok).alias("d")).agg(F.avg("d").alias("mean_dice"))


def difference(voxels: DataFrame) -> DataFrame:
    """Voxel class 1 = false positive, 2 = false negative, 3 = true positive, 0 = true negative."""
    g, p = F.col("gt") > 0, F.col("pred") > 0
    return voxels.withColumn("diff", F.when(g & p, 3).when(g, 2).when(p, 1).otherwise(0))


def align(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Sparse truth and prediction tables (case_id, x, y, z, label) side by side; absent = 0."""
    p = pred.select(*KEY, F.col("label").alias("pred"))
    return gt.select(*KEY, F.col("label").alias("gt")).join(p, KEY, "full").fillna(0, ["gt", "pred"])


# -- topology --------------------------------------------------------------------------


def euler_number(mask: DataFrame) -> DataFrame:
    """Vertices - edges + faces - cells of the union of closed unit cubes."""
    cells = [(a, b, c, 3 - (a != 0) - (b != 0) - (c != 0)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    doubled = mask.select("case_id", *[(F.col(c) * 2).alias(c) for c in "xyz"])
    keys = spread(doubled, cells, extra="dim").distinct()
    sign = F.when(F.col("dim") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return keys.groupBy("case_id").agg(F.sum(sign).alias("euler"))


def run_euler(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Euler numbers of masks given as runs.

    A run covers nine lines of the grid of vertices, edges, faces and cells.  Along a line every merged
    stretch has one vertex more than edges (or one face more than cells), so it
    counts once, with the sign of its line.
    """
    nine = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
    wide = lines.withColumn("_o", F.explode(nine)).select(
        *keys, (2 * F.col("x") + F.col("_o.p")).alias("X"), (2 * F.col("y") + F.col("_o.q")).alias("Y"),
        (2 * F.col("z0") - 1).alias("a"), (2 * F.col("z1") + 1).alias("b"),
    )
    before = Window.partitionBy(*keys, "X", "Y").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    starts = wide.withColumn("_top", F.max("b").over(before)).where("_top is null or a > _top")
    sign = F.when((F.col("X") + F.col("Y")) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return starts.groupBy(*keys).agg(F.sum(sign).alias("euler"))


def betti(mask: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """b0, b1, b2 of each mask: 26-connected pieces, tunnels, 6-connected cavities.

    Masks are runs along z.  Pieces come from joining runs of neighbouring lines that overlap; cavities from the
    gaps between runs of a line.  What lies before the first and after the last run of a line, and
    every line without a run, is outside, so that no box of background voxels is made.
    """
    keys = list(keys)
    group = F.to_json(F.struct(*keys))
    lines = stored(runs(mask, keys).withColumn("_g", group), "runs")
    r = lines.select(F.col("_g").alias("case_id"), "x", "y", "z0", "z1")
    node = voxel_id("x", "y", "z0").alias("node")
    pieces = components(run_edges(r, ["case_id"], [(0, 1), (1, -1), (1, 0), (1, 1)], 1), r.select("case_id", node))
    b0 = pieces.groupBy("case_id").agg(F.count_distinct("comp").alias("b0"))
    w = Window.partitionBy("case_id", "x", "y").orderBy("z0")
    gaps = r.withColumn("_next", F.lead("z0").over(w)).where("_next is not null").select("case_id", "x", "y", (F.col("z1") + 1).alias("z0"), (F.col("_next") - 1).alias("z1"))
    gaps = stored(gaps, "gaps")
    extent = r.groupBy("case_id", "x", "y").agg(F.min("z0").alias("_lo"), F.max("z1").alias("_hi"))
    four = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    asked = gaps.withColumn("node", voxel_id("x", "y", "z0")).withColumn("_o", F.explode(four))
    asked = asked.withColumns({"x": F.col("x") + F.col("_o.p"), "y": F.col("y") + F.col("_o.q")}).join(extent, ["case_id", "x", "y"], "left")
    open_ = asked.where("_lo is null or z0 < _lo or z1 > _hi").select("case_id", "node").distinct().withColumn("_out", F.lit(True))
    inner = components(run_edges(gaps, ["case_id"], [(1, 0), (0, 1)], 0), gaps.select("case_id", node))
    holes = inner.join(open_, ["case_id", "node"], "left").groupBy("case_id", "comp").agg(F.max("_out").alias("_out")).where("_out is null")
    b2 = holes.groupBy("case_id").agg(F.count("*").alias("b2"))
    names = lines.groupBy(F.col("_g").alias("_group")).agg(*[F.first(k).alias(k) for k in keys])
    # Dealt out by mask, the nine lines that a run covers are not shuffled; only masks with many runs are spread over their lines.
    small, large = by_size(r)
    euler = run_euler(small.repartition("case_id"), ["case_id"])
    if large is not None:
        euler = euler.unionByName(run_euler(r.join(large, "case_id", "left_semi"), ["case_id"]))
    out = b0.join(euler, "case_id").join(b2, "case_id", "left").withColumn("b2", F.coalesce("b2", F.lit(0))).withColumnRenamed("case_id", "_group")
    return out.join(names, "_group").select(*keys, "b0", (F.col("b0") + F.col("b2") - F.col("euler")).alias("b1"), "b2")


def betti_errors(voxels: DataFrame) -> DataFrame:
    """Absolute Betti differences of truth and prediction: (case_id, label, err_b0, err_b1).

    One row for each label that stands in either, ``average`` over these and ``merged`` for all labels as one;
    b1 is compared for the merged masks only.  A case without labels has 0 in both.
    """
    side = lambda c, n: voxels.where(F.col(c) > 0).select(*KEY, F.lit(n).alias("side"), F.col(c).cast("string").alias("label"))
    each = side("gt", 0).unionByName(side("pred", 1))
    both = each.unionByName(each.withColumn("label", F.lit("merged")))
    found = betti(both, ["case_id", "side", "label"])
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    error = found.groupBy("case_id", "label").agg(*[F.abs(F.sum(sign * F.col(c))).alias(f"err_{c}") for c in ("b0", "b1")])
    error = stored(error, "betti")
    single = error.where("label <> 'merged'").select("case_id", "label", F.col("err_b0").cast("double").alias("err_b0"), F.lit(None).cast("bigint").alias("err_b1"))
    cases = voxels.select("case_id").distinct()
    mean = cases.join(single, "case_id", "left").groupBy("case_id").agg(F.coalesce(F.avg("err_b0"), F.lit(0.0)).alias("err_b0"))
    mean = mean.select("case_id", F.lit("average").alias("label"), "err_b0", F.lit(None).cast("bigint").alias("err_b1"))
    whole = cases.join(error.where("label = 'merged'"), "case_id", "left").select(
        "case_id", F.lit("merged").alias("label"), F.coalesce("err_b0", F.lit(0)).cast("double").alias("err_b0"), F.coalesce("err_b1", F.lit(0)).cast("bigint").alias("err_b1")
    )
    return single.unionByName(mean).unionByName(whole)


def centreline_dice(gt: DataFrame, gt_line: DataFrame, pred: DataFrame, pred_line: DataFrame) -> DataFrame:
    """Share of the predicted centreline in the true mask and the reverse, and their harmonic mean."""
    def share(line, mask, name):
        hit = mask.select(*KEY).distinct().withColumn("_h", F.lit(1))
        return line.select(*KEY).join(hit, KEY, "left").groupBy("case_id").agg((F.count("_h") / F.count("*")).alias(name))

    both = share(pred_line, gt, "precision").join(share(gt_line, pred, "sensitivity"), "case_id", "full").fillna(0.0)
    p, s = F.col("precision"), F.col("sensitivity")
    return both.withColumn("cldice", F.coalesce(F.try_divide(2 * p * s, p + s), F.lit(0.0)))


# -- surface distance ------------------------------------------------------------------


def surface_distance(masks: DataFrame, spacing: Sequence[float], keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Average symmetric surface distance of the masks on side 0 and 1 (column ``side``) of a key.

    Keys with an empty side are left out.  Both directions and all keys share one search.
    """
    keys = list(keys)
    edge = surface(masks, (*keys, "side"))
    edge = stored(edge.select(*keys, "side", *[(F.col(c) * k).alias(c) for c, k in zip("xyz", spacing)]), "surface")
    at = ["qx", "qy", "qz"]
    asked = edge.select(*keys, (1 - F.col("side")).alias("side"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    near = nearest_growing(asked, edge, 1.01 * max(spacing), at, [*keys, "side", *at], ["x", "y", "z"], keys=[*keys, "side"])
    way = near.groupBy(*keys, "side").agg(F.avg("dist").alias("m"))
    return way.groupBy(*keys).agg(F.avg("m").alias("assd"), F.count("*").alias("_n")).where("_n = 2").drop("_n")


def in_roi(voxels: DataFrame, roi: DataFrame) -> DataFrame:
    """Voxels inside the half-open box x0..x1, y0..y1, z0..z1 of their case."""
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & (F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1"))
    return voxels.join(roi, "case_id").where(ok).drop("x0", "x1", "y0", "y1", "z0", "z1")


THRESHOLDS = (0.2, 0.3, 0.4)
#: A voxel takes less room in a task than an edge of a graph: so many times the rows of a case may stand there.
SURFACE_CASES = 5


def surface_score(voxels: DataFrame, spacing: Sequence[float], roi: DataFrame | None = None) -> DataFrame:
    """``max((nf - d) / nf, 0)``: surface distance against that of plain intensity thresholds.

    The whole volume uses the mean over three thresholds, the region of interest the last
    one only; an empty prediction there counts as the normaliser itself.  Cases with few enough voxels
    are measured inside a task each, a voxel being one row whatever the number of masks.
    """
    voxels = stored(voxels.select(*KEY, "intensity", "gt", "pred"), "voxels")
    lim = voxels.groupBy("case_id").agg(F.max("intensity").alias("_hi"), F.min("intensity").alias("_lo"))
    base = F.when(F.col("_hi") > 0, F.col("_hi")).otherwise(F.col("_lo"))

    def variants(v, ths, region):
        v = v.join(lim, "case_id")
        made = [F.when(F.col("pred") > 0, F.lit(0.0))] + [F.when(F.col("intensity") > base * t, F.lit(t)) for t in ths]
        pred = v.select(*KEY, F.explode(F.array_compact(F.array(*made))).alias("which"), F.lit(0).alias("side"))
        true = v.where("gt > 0").select(*KEY, F.explode(F.array(*[F.lit(t) for t in (0.0, *ths)])).alias("which"), F.lit(1).alias("side"))
        return pred.unionByName(true).withColumn("region", F.lit(region))

    small, large = by_size(voxels.dropna(subset=KEY), SURFACE_CASES * casework.CASE_ROWS)
    v = small.join(lim, "case_id").withColumn("_in", F.lit(False))
    regions = [(0, F.lit(True), (0.0, *THRESHOLDS))]
    if roi is not None:
        boxes = roi.groupBy("case_id").agg(F.collect_list(F.struct(*[f"{c}{k}" for c in "xyz" for k in (0, 1)])).alias("_boxes"))
        here = F.exists("_boxes", lambda b: reduce(lambda p, q: p & q, [(F.col(c) >= b[f"{c}0"]) & (F.col(c) < b[f"{c}1"]) for c in "xyz"]))
        v = v.join(boxes, "case_id", "left").withColumn("_in", here)
        regions.append((1, F.col("_in"), (0.0, THRESHOLDS[-1])))
    specs, bits = [], F.lit(0).cast("bigint")
    for region, inside, whichs in regions:
        for which in whichs:
            for side, mask in ((0, F.col("intensity") > base * which if which else F.col("pred") > 0), (1, F.col("gt") > 0)):
                bits = bits + F.when(inside & mask, F.lit(1 << len(specs))).otherwise(F.lit(0))
                specs.append((which, region, side))
    v = v.select(*KEY, bits.alias("bits")).where("bits <> 0")
    dist = in_cases(v, surfaces(specs, tuple(spacing)), "which double, region int, assd double")
    if large is not None:
        rest = stored(voxels.dropna(subset=KEY).join(large, "case_id", "left_semi"), "voxels")
        masks = variants(rest, THRESHOLDS, 0)
        if roi is not None:
            masks = masks.unionByName(variants(in_roi(rest, roi), THRESHOLDS[-1:], 1))
        dist = dist.unionByName(surface_distance(masks, spacing, ["case_id", "which", "region"]).select("case_id", "which", "region", "assd"))
    per = stored(dist.groupBy("case_id", "region").agg(
        F.max(F.when(F.col("which") == 0, F.col("assd"))).alias("d"), F.avg(F.when(F.col("which") > 0, F.col("assd"))).alias("nf")
    ), "distance")

    def score(d):
        return F.greatest((F.col("nf") - d) / F.col("nf"), F.lit(0.0))

    out = per.where("region = 0").select("case_id", F.col("d").alias("assd"), "nf", score(F.col("d")).alias("surface_score"))
    if roi is not None:
        d = F.coalesce("d", "nf")
        part = per.where("region = 1").select("case_id", d.alias("assd_roi"), F.col("nf").alias("nf_roi"), score(d).alias("surface_score_roi"))
        out = out.join(part, "case_id", "left")
    return out


def final_score(scores: DataFrame) -> DataFrame:
    """Weighted sum of dice, surface_score and, where there is a region, their regional forms."""
    whole = 0.5 * F.col("dice") + 0.5 * F.col("surface_score")
    part = 0.35 * F.col("dice") + 0.35 * F.col("surface_score") + 0.15 * F.col("surface_score_roi") + 0.15 * F.col("dice_roi")
    return scores.withColumn("final_score", F.when(F.col("dice_roi").isNull(), whole).otherwise(part))


# -- curves ----------------------------------------------------------------------------


def slice_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.max("y").alias("y"), F.max("score").alias("score"))


def _ladder(scores: DataFrame, size: int) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first."""
    step = scores.groupBy("score").agg(F.sum("y").alias("_p"), F.count("*").alias("_n")).withColumn("_o", -F.col("score"))
    out = running_values(step, [], "_o", {"tps": F.col("_p"), "all": F.col("_n"), "i": F.lit(1).cast("bigint")}, size)
    return out.select("score", "tps", (F.col("all") - F.col("tps")).alias("fps"), (F.col("i") - 1).alias("i"))


def roc_curve(scores: DataFrame, size: int = BLOCK) -> DataFrame:
    """False and true positive rate by threshold; collinear points are left out."""
    lad = _ladder(scores, size)
    near = neighbours(lad, [], "i", {"t0": ("tps", -1), "t1": ("tps", 1), "f0": ("fps", -1), "f1": ("fps", 1)}, size)
    bend = (F.col("t1") - 2 * F.col("tps") + F.col("t0") != 0) | (F.col("f1") - 2 * F.col("fps") + F.col("f0") != 0)
    kept = near.where(F.col("t0").isNull() | F.col("t1").isNull() | bend)
    whole = scores.agg(F.sum("y").alias("P"), (F.count("*") - F.sum("y")).alias("N"), (F.max("score") + 1).alias("top"))
    rows = kept.crossJoin(F.broadcast(whole)).select(  # one row
        (F.col("fps") / F.col("N")).alias("fp_rate"), (F.col("tps") / F.col("P")).alias("tp_rate"), F.col("score").alias("threshold")
    )
    return rows.unionByName(whole.select(F.lit(0.0).alias("fp_rate"), F.lit(0.0).alias("tp_rate"), F.col("top").alias("threshold")))


LAST_THRESHOLD = 99999.0


def pr_curve(scores: DataFrame, size: int = BLOCK) -> DataFrame:
    lad = _ladder(scores, size)
    whole = scores.agg(F.sum("y").alias("P"))
    rows = lad.crossJoin(F.broadcast(whole)).select(  # one row
        (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"), (F.col("tps") / F.col("P")).alias("recall"), F.col("score").alias("threshold")
    )
    return rows.unionByName(whole.select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(LAST_THRESHOLD).alias("threshold")))


def dice_curve(scores: DataFrame, steps: int = 80) -> DataFrame:
    """Smoothed Dice at ``steps`` equal thresholds from the least to the greatest score (strictly above).

    Scores are counted per threshold interval first; the curve is a suffix sum over ``steps`` rows.
    """
    lim = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    wide = scores.crossJoin(F.broadcast(lim)).withColumn("gap", (F.col("hi") - F.col("lo")) / (steps - 1))  # one row
    guess = F.coalesce(F.floor(F.try_divide(F.col("score") - F.col("lo"), F.col("gap"))), F.lit(0))
    above = F.lit(0).cast("bigint")
    for d in (-1, 0, 1):  # thresholds next to the guess are compared exactly
        i = guess + d
        above = above + ((i >= 0) & (F.col("lo") + i * F.col("gap") < F.col("score"))).cast("bigint")
    below = F.greatest(guess - 1, F.lit(0))
    bins = wide.withColumn("_b", F.least(below + above, F.lit(steps))).groupBy("_b").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    grid = lim.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")).select(
        "k", (F.col("lo") + F.col("k") * ((F.col("hi") - F.col("lo")) / (steps - 1))).alias("threshold")
    )
    bins = F.broadcast(bins)  # at most steps + 1 rows
    total = F.broadcast(scores.agg(F.sum("y").alias("g")))
    at = grid.join(bins, F.col("_b") > F.col("k"), "left").groupBy("k", "threshold").agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("pos")
    )
    return at.crossJoin(total).select(dice_ratio(2 * F.col("tp"), F.col("g") + F.col("pos")).alias("dice"), "threshold")


# -- boxes -----------------------------------------------------------------------------

BOX = ["x0", "y0", "z0", "x1", "y1", "z1"]


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    inter = va = vb = F.lit(1.0)
    for i in range(3):
        inter = inter * F.greatest(F.lit(0), F.least(a[3 + i], b[3 + i]) - F.greatest(a[i], b[i]))
        va = va * (a[3 + i] - a[i])
        vb = vb * (b[3 + i] - b[i])
    return inter / (va + vb - inter)


def box_ious(pred: DataFrame, true: DataFrame, keys: Sequence[str] = ("image_id", "cls"), cell: float = 64.0, least: float = 0.0) -> DataFrame:
    """Overlapping pairs (keys, left, right, iou) of boxes with ``box_id``.

    Boxes are listed in the grid cells they touch; a pair is emitted only in the cell that
    holds the lower corner of its intersection, so no pair appears twice.
    """
    keys = list(keys)

    def listed(df, tag):
        df = df.select(*keys, F.col("box_id").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in BOX])
        for c in "xyz":
            df = df.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(f"{tag}_{c}0") / cell), F.floor(F.col(f"{tag}_{c}1") / cell))))
        return df

    both = listed(pred, "left").join(listed(true, "right"), [*keys, "_cx", "_cy", "_cz"])
    own = F.lit(True)
    for c in "xyz":
        own = own & (F.col(f"_c{c}") == F.floor(F.greatest(f"left_{c}0", f"right_{c}0") / cell))
    value = iou([F.col(f"left_{c}") for c in BOX], [F.col(f"right_{c}") for c in BOX])
    return both.where(own).withColumn("iou", value).where(F.col("iou") > least).select(*keys, "left", "right", "iou")


def top_boxes(pred: DataFrame, k: int, keys: Sequence[str] = ("image_id",), score_above: float | None = None) -> DataFrame:
    """The ``k`` best boxes of each key (equal scores: lower id)."""
    from pyspark.sql import Window

    if score_above is not None:
        pred = pred.where(F.col("score") > score_above)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "box_id")
    return pred.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def non_maximum_suppression(pred: DataFrame, threshold: float, keys: Sequence[str] = ("image_id", "cls")) -> DataFrame:
    """Keep boxes that overlap no better kept box by more than ``threshold``."""
    pred = stored(pred, "boxes")
    rank = pred.select("box_id", "score")
    pairs = box_ious(pred, pred, keys, least=threshold).where("left <> right")
    pairs = pairs.join(rank.withColumnsRenamed({"box_id": "left", "score": "_sl"}), "left").join(
        rank.withColumnsRenamed({"box_id": "right", "score": "_sr"}), "right"
    )
    wins = (F.col("_sl") > F.col("_sr")) | ((F.col("_sl") == F.col("_sr")) & (F.col("left") < F.col("right")))
    rivals = pairs.where(wins).select(F.col("left").alias("winner"), F.col("right").alias("loser"))
    kept = first_free(pred.select(F.col("box_id").alias("id")), rivals)
    return pred.join(kept.select(F.col("id").alias("box_id")), "box_id", "left_semi")


def match_boxes(pred: DataFrame, true: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each prediction, best score first, takes the best-overlapping free true box of its image and class."""
    pairs = box_ious(pred, true).where(F.col("iou") >= threshold)
    order = pred.select(F.col("box_id").alias("left"), F.struct((-F.col("score")).alias("s"), F.col("box_id").alias("b")).alias("rank"))
    return best_free(pairs.join(order, "left").select("left", "right", "rank", F.col("iou").alias("score")))


def _matched_in_lists(pred: DataFrame, true: DataFrame, threshold: float) -> DataFrame:
    """The matched predictions (box_id) of ``match_boxes`` where ``max_det`` bounds those of an image and class."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("s"), "right")))
    options = box_ious(pred, true).where(F.col("iou") >= threshold).groupBy("image_id", "cls", "left").agg(best.alias("options"))
    scored = options.join(pred.select(F.col("box_id").alias("left"), "score"), "left")
    queue = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "left", "options")))
    lists = scored.groupBy("image_id", "cls").agg(queue.alias("queue"))
    ids = dict(lists.select(F.col("queue")[0]["left"].alias("l"), F.col("queue")[0]["options"][0]["right"].alias("r")).dtypes)
    none = F.struct(F.array().cast(f"array<{ids['r']}>").alias("taken"), F.array().cast(f"array<{ids['l']}>").alias("hits"))

    def step(state, p):
        free = F.filter(p["options"], lambda o: ~F.array_contains(state["taken"], o["right"]))
        took = F.struct(F.concat(state["taken"], F.array(free[0]["right"])).alias("taken"), F.concat(state["hits"], F.array(p["left"])).alias("hits"))
        return F.when(F.size(free) > 0, took).otherwise(state)

    return lists.select(F.explode(F.aggregate("queue", none, step)["hits"]).alias("box_id"))


def average_precision(pred: DataFrame, true: DataFrame, threshold: float = 0.5, max_det: int = 10) -> DataFrame:
    """Average precision per class over 101 recall levels."""
    pred = stored(top_boxes(pred, max_det, ("image_id", "cls")), "top")
    hit = _matched_in_lists(pred, true, threshold).select("box_id", F.lit(1).alias("tp"))
    det = pred.join(hit, "box_id", "left").select("cls", "score", "box_id", F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"))
    ordered = ranked(det, [F.col("cls"), F.desc("score"), F.col("box_id")])
    cum = running(ordered, ["cls"], "rank", {"ctp": F.col("tp"), "n": F.lit(1).cast("bigint")})
    truth = true.groupBy("cls").agg(F.count("*").alias("n_gt"))
    level = cum.join(truth, "cls").select(
        "cls", F.floor(F.col("ctp") * 100 / F.col("n_gt")).alias("lvl"), (F.col("ctp") / F.col("n")).alias("precision")
    ).groupBy("cls", "lvl").agg(F.max("precision").alias("p"))  # at most 101 rows per class
    grid = truth.select("cls", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k"))
    best = grid.join(level.withColumnRenamed("cls", "_cls"), (F.col("cls") == F.col("_cls")) & (F.col("lvl") >= F.col("k")), "left").groupBy(
        "cls", "k"
    ).agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"))
    return best.groupBy("cls").agg(F.avg("p").alias("ap"))


def patch_weight(patches: DataFrame, boxes: DataFrame, keys: Sequence[str], weight: float = 5.0) -> DataFrame:
    """``weight`` for patches that strictly overlap the box of their key, else 1.

    Box columns end in ``_b``; a key without a box (or NULL limits) weighs 1.
    """
    hit = F.lit(True)
    for c in "xyz":
        hit = hit & (F.col(f"{c}0_b") < F.col(f"{c}1")) & (F.col(f"{c}1_b") > F.col(f"{c}0"))
    return patches.join(boxes, list(keys), "left").withColumn("weight", F.when(hit, F.lit(weight)).otherwise(F.lit(1.0)))


def inside_box2d(points: DataFrame, boxes: DataFrame, keys: Sequence[str], cell: float = 32.0) -> DataFrame:
    """Points (px, py) inside boxes given by centre bx, by and size bw, bh (limits included)."""
    listed = boxes
    for c, s in (("x", "w"), ("y", "h")):
        half = F.col(f"b{s}") / 2
        listed = listed.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((F.col(f"b{c}") - half) / cell), F.floor((F.col(f"b{c}") + half) / cell))))
    placed = points.withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    ok = (F.abs(F.col("px") - F.col("bx")) <= F.col("bw") / 2) & (F.abs(F.col("py") - F.col("by")) <= F.col("bh") / 2)
    return placed.join(listed, [*keys, "_cx", "_cy"]).where(ok).drop("_cx", "_cy")


# -- labels, epochs, losses ------------------------------------------------------------


def label_accuracy(nodes: DataFrame, by: str = "case_id") -> DataFrame:
    """Share of right labels and of groups without a wrong one."""
    right = (F.col("pred") == F.col("true")).cast("int")
    per = nodes.groupBy(by).agg(F.sum(right).alias("r"), F.count("*").alias("n"), F.min(right).alias("all"))
    return per.agg((F.sum("r") / F.sum("n")).alias("accuracy"), F.avg("all").alias("solved"))


def epoch_metrics(rows: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """``seg_*`` values are summed, all others averaged by sample count ``n``."""
    total = F.sum("value")
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    return rows.groupBy(*keys, "name").agg(F.when(F.col("name").startswith("seg_"), total).otherwise(mean).alias("value"))


def agreement(voxels: DataFrame) -> DataFrame:
    """Counts of the four agreement classes and the mean absolute difference of two maps."""
    g, p = F.col("gt") > 0, F.col("pred") > 0
    return voxels.groupBy("case_id").agg(
        F.count_if(g & p).alias("both"), F.count_if(g & ~p).alias("only_gt"), F.count_if(~g & p).alias("only_pred"),
        F.avg(F.abs(F.col("score") - g.cast("double"))).alias("mean_abs"),
    )


def grid_search(scores: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean score per parameter combination, the best one flagged (ties: first in order)."""
    mean = scores.groupBy(*params).agg(F.avg("score").alias("mean_score"))
    best = mean.agg(F.min(F.struct((-F.col("mean_score")).alias("s"), *params)).alias("_b"))
    same = F.lit(True)
    for p in params:
        same = same & F.col(p).eqNullSafe(F.col(f"_b.{p}"))
    return mean.crossJoin(F.broadcast(best)).withColumn("best", same).drop("_b")  # one row


def loss_metrics(voxels: DataFrame, weights: DataFrame | None = None, pos_weight: float = 1.0) -> DataFrame:
    """Cross entropy (score as logit) and soft Dice loss, averaged over cases by weight ``w``."""
    y = (F.col("gt") > 0).cast("double")
    s = F.col("score")
    ce = -(pos_weight * y * -F.log1p(F.exp(-s)) + (1 - y) * -(s + F.log1p(F.exp(-s))))
    per = voxels.groupBy("case_id").agg(
        F.avg(ce).alias("ce"), (1 - 2 * F.sum(s * y) / (F.sum(s + y) + 1e-6)).alias("soft_dice")
    )
    per = per.withColumn("w", F.lit(1.0)) if weights is None else per.join(weights, "case_id")
    return per.agg(*[(F.avg(F.col("w") * F.col(c)) / F.avg("w")).alias(c) for c in ("ce", "soft_dice")])


def critical_voxels(labels: DataFrame, a: int, c: int, inclusion: bool, offsets=TWENTY_SIX) -> DataFrame:
    """Voxels that break the rule between classes a and c.

    Exclusion: a and c must not touch.  Inclusion: a may touch only a and c.
    """
    is_a = labels.where(F.col("label") == a)
    other = ~F.col("label").isin(a, c) if inclusion else F.col("label") == c
    is_c = labels.where(other)
    near_c = spread(is_c.select(*KEY), offsets).distinct()
    near_a = spread(is_a.select(*KEY), offsets).distinct()
    return is_a.select(*KEY).join(near_c, KEY, "left_semi").unionByName(is_c.select(*KEY).join(near_a, KEY, "left_semi"))
