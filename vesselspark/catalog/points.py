"""Projections and filters on points, boxes and voxel values."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import points as op
from ..operators.traces import with_step
from . import query
from .features import STEPS, rounded

ID = ["case_id", "trace_id", "seq"]


def here():
    return g.vec("x", "y", "z")


def mid():
    return g.literal(40, 41, 39)


@query("vector_algebra", ["fx_points"], """SELECT case_id, trace_id, seq, x + 40 AS add_x, y - 41 AS sub_y, z * 1.5 AS scale_z, -x AS neg_x,
  x*40 + y*41 + z*39 AS dot, CASE WHEN rad = 2 THEN x ELSE x / (rad - 2) END AS div_x, round(sqrt(x*x + y*y + z*z), 6) AS len,
  round(CASE WHEN (x-40)*(x-40) + (y-41)*(y-41) + (z-39)*(z-39) = 0 THEN 0 ELSE (x-40) / sqrt((x-40)*(x-40) + (y-41)*(y-41) + (z-39)*(z-39)) END, 6) + 0.0 AS unit_x FROM fx_points""")
def vector_algebra(p):
    out = p.select(
        *ID, g.add(here(), mid())[0].alias("add_x"), g.sub(here(), mid())[1].alias("sub_y"), g.scale(here(), 1.5)[2].alias("scale_z"),
        g.negate(here())[0].alias("neg_x"), g.dot(here(), mid()).alias("dot"), g.divide(here(), F.col("rad") - 2)[0].alias("div_x"),
        F.round(g.length(here()), 6).alias("len"), F.round(g.unit(g.sub(here(), mid()))[0], 6).alias("unit_x"),
    )
    return out


@query("point_distance", ["fx_points"], """SELECT case_id, trace_id, seq, round(sqrt((x-40)*(x-40) + (y-41)*(y-41) + (z-39)*(z-39)), 6) AS d3,
  round(sqrt((x-40)*(x-40) + (y-41)*(y-41)), 6) AS d2, round(acos(least(1, (x*40 + y*41 + z*39) / (sqrt(x*x + y*y + z*z) * sqrt(40*40 + 41*41 + 39*39)))), 5) AS rad_angle,
  round(degrees(acos(least(1, (x*40 + y*41 + z*39) / (sqrt(x*x + y*y + z*z) * sqrt(40*40 + 41*41 + 39*39))))), 3) AS deg_angle
FROM fx_points""")
def point_distance(p):
    return p.select(
        *ID, F.round(g.dist(here(), mid()), 6).alias("d3"), F.round(g.dist2d(here(), mid()), 6).alias("d2"),
        F.round(g.angle(here(), mid()), 5).alias("rad_angle"), F.round(g.angle_deg(here(), mid()), 3).alias("deg_angle"),
    )


@query("position_keys", ["fx_points"], """SELECT case_id, trace_id, seq, printf('%.3f-%.3f-%.3f', x, y, z) AS hash_pos,
  concat(CAST(CAST(trunc(x) AS BIGINT) AS VARCHAR), '-', CAST(CAST(trunc(y) AS BIGINT) AS VARCHAR), '-', CAST(CAST(trunc(z) AS BIGINT) AS VARCHAR)) AS int_key,
  CAST(round_even(x, 0) AS BIGINT) AS vx, CAST(round_even(y, 0) AS BIGINT) AS vy, CAST(round_even(z, 0) AS BIGINT) AS vz FROM fx_points""")
def position_keys(p):
    return p.select(
        *ID, g.position_key(here()).alias("hash_pos"), g.truncated_key(here()).alias("int_key"),
        *[g.voxel(c).alias(n) for c, n in zip(here(), ("vx", "vy", "vz"))],
    )


@query("bounds_check", ["fx_points"], """SELECT case_id, trace_id, seq, (x < 0 OR x > 44 OR y < 0 OR y > 43 OR z < 0 OR z > 42) AS out_of_bound,
  (x < 36 - 1 OR x > 44 - 1 + 1 OR y < 36 - 1 OR y > 44 - 1 + 1 OR z < 36 - 1 OR z > 44 - 1 + 1) AS out_of_box,
  least(greatest(x, 0), 44) AS bx, least(greatest(y, 0), 43) AS by_, least(greatest(z, 0), 42) AS bz FROM fx_points""")
def bounds_check(p):
    shape = (45, 44, 43)
    return p.select(
        *ID, g.out_of_bound(here(), shape).alias("out_of_bound"), g.out_of_box(here(), (36, 44, 36, 44, 36, 44), 1).alias("out_of_box"),
        *[c.alias(n) for c, n in zip(g.clamp(here(), shape), ("bx", "by_", "bz"))],
    )


ENDS = """ends AS (SELECT case_id, trace_id, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_min(z, seq) AS az, arg_max(x, seq) AS bx, arg_max(y, seq) AS b_y, arg_max(z, seq) AS bz
  FROM fx_points GROUP BY case_id, trace_id)"""


def trace_ends(p):
    return p.groupBy("case_id", "trace_id").agg(
        *[F.min_by(c, "seq").alias(f"a{c}") for c in "xyz"], *[F.max_by(c, "seq").alias(f"b{c}") for c in "xyz"]
    )


@query("unit_path", ["fx_points"], f"""WITH {ENDS}, d AS (SELECT *, CAST(floor(sqrt((ax-bx)*(ax-bx) + (ay-b_y)*(ay-b_y) + (az-bz)*(az-bz))) AS BIGINT) AS n FROM ends)
SELECT case_id, trace_id, k, round(CASE WHEN k = n THEN bx ELSE ax + (bx-ax) / n * k END, 6) AS x, round(CASE WHEN k = n THEN b_y ELSE ay + (b_y-ay) / n * k END, 6) AS y,
  round(CASE WHEN k = n THEN bz ELSE az + (bz-az) / n * k END, 6) AS z FROM d, LATERAL unnest(generate_series(0, n)) AS g(k)""")
def unit_path(p):
    return rounded(op.path(trace_ends(p)), list("xyz")).select("case_id", "trace_id", "k", "x", "y", "z")


RTM_SQL = """rtm AS (SELECT DISTINCT case_id, 1.0 + case_id % 3 AS r11, 0.5 AS r12, 0.0 AS r13, -0.5 AS r21, 1.0 AS r22, 0.25 AS r23, 0.0 AS r31, -0.25 AS r32, 1.0 AS r33,
  CAST(case_id AS DOUBLE) AS t1, 2.0 AS t2, -3.0 AS t3 FROM fx_points)"""


def transforms(p):
    row = {"r11": 1.0, "r12": 0.5, "r13": 0.0, "r21": -0.5, "r22": 1.0, "r23": 0.25, "r31": 0.0, "r32": -0.25, "r33": 1.0, "t2": 2.0, "t3": -3.0}
    cols = {c: F.lit(v) for c, v in row.items()}
    cols["r11"] = F.lit(1.0) + F.col("case_id") % 3
    cols["t1"] = F.col("case_id").cast("double")
    return p.select("case_id").distinct().select("case_id", *[cols[c].alias(c) for c in op.RTM])


@query("rigid_transform", ["fx_points"], f"""WITH {RTM_SQL} SELECT p.case_id, trace_id, seq, CAST(r11*x + r12*y + r13*z + t1 AS DOUBLE) AS x,
  CAST(r21*x + r22*y + r23*z + t2 AS DOUBLE) AS y, CAST(r31*x + r32*y + r33*z + t3 AS DOUBLE) / 2 AS z FROM fx_points p JOIN rtm r ON p.case_id = r.case_id""")
def rigid_transform(p):
    return op.rigid(p.select(*ID, "x", "y", "z"), transforms(p), z_ratio=2.0)


def _compose_sql():
    cells = [f"CAST({' + '.join(f'b.r{i}{k} * a.r{k}{j}' for k in (1, 2, 3))} AS DOUBLE) AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    cells += [f"CAST({' + '.join(f'b.r{i}{k} * a.t{k}' for k in (1, 2, 3))} + b.t{i} AS DOUBLE) AS t{i}" for i in (1, 2, 3)]
    return f"WITH {RTM_SQL} SELECT a.case_id, {', '.join(cells)} FROM rtm a JOIN rtm b ON a.case_id = b.case_id"


@query("compose_transforms", ["fx_points"], _compose_sql())
def compose_transforms(p):
    t = transforms(p)
    return op.compose(t, t)


@query("transform_units", ["fx_points"], f"""WITH {RTM_SQL} SELECT case_id, {', '.join(f"round(CAST(r{i}{j} * {m} / {f} AS DOUBLE), 6) AS r{i}{j}" for i, m in ((1, .5), (2, .25), (3, 2.0)) for j, f in ((1, .6), (2, .3), (3, .8)))},
  {', '.join(f"round(CAST(t{i} * {m} AS DOUBLE), 6) AS t{i}" for i, m in ((1, .5), (2, .25), (3, 2.0)))} FROM rtm""")
def transform_units(p):
    return rounded(op.to_physical(transforms(p), (0.6, 0.3, 0.8), (0.5, 0.25, 2.0)), op.RTM)


def _orient_sql():
    def axis(t, j):
        a = [f"abs({t}.embedding[{k + j + 1}])" for k in (0, 3, 6)]
        return f"CASE WHEN {a[0]} >= {a[1]} AND {a[0]} >= {a[2]} THEN 0 WHEN {a[1]} >= {a[2]} THEN 1 ELSE 2 END"

    axes = ", ".join(f"{axis('e', j)} AS d{j}" for j in range(3))
    signs = ", ".join(f"CAST(sign(CASE d{j} WHEN 0 THEN embedding[{j + 1}] WHEN 1 THEN embedding[{j + 4}] ELSE embedding[{j + 7}] END) AS DOUBLE) AS s{j}" for j in range(3))
    perm = ", ".join(f"CASE WHEN b.d2 = a.d{i} THEN 2 WHEN b.d1 = a.d{i} THEN 1 WHEN b.d0 = a.d{i} THEN 0 ELSE -1 END AS perm{i}" for i in range(3))
    flip = ", ".join(f"a.s{i} * b.s{i} < 0 AS flip{i}" for i in range(3))
    return f"""WITH o AS (SELECT e.*, {axes} FROM embeddings e), s AS (SELECT *, {signs} FROM o)
SELECT a.vec_id, {', '.join(f'a.d{i} AS axis{i}, a.s{i} AS sign{i}' for i in range(3))}, {perm}, {flip}
FROM s a JOIN s b ON a.label = b.label AND a.vec_id + 8 = b.vec_id"""


@query("image_orientation", ["embeddings"], _orient_sql())
def image_orientation(e):
    axes, signs = op.orientation([F.element_at("embedding", i).cast("double") for i in range(1, 10)])
    o = e.select("vec_id", "label", *[a.alias(f"axis{i}") for i, a in enumerate(axes)], *[s.alias(f"sign{i}") for i, s in enumerate(signs)])
    names = [f"{n}{i}" for n in ("axis", "sign") for i in range(3)]
    other = o.select((F.col("vec_id") - 8).alias("vec_id"), "label", *[F.col(n).alias(f"b_{n}") for n in names])
    both = o.join(other, ["vec_id", "label"])
    perm, flips = op.permutation_and_flips(
        [F.col(f"axis{i}") for i in range(3)], [F.col(f"sign{i}") for i in range(3)],
        [F.col(f"b_axis{i}") for i in range(3)], [F.col(f"b_sign{i}") for i in range(3)],
    )
    return both.select(
        "vec_id", *names, *[c.alias(f"perm{i}") for i, c in enumerate(perm)], *[c.alias(f"flip{i}") for i, c in enumerate(flips)]
    )


DIRS = ", ".join(f"({i}, {x!r}, {y!r}, {z!r})" for i, x, y, z in g.directions26())


@query("direction_counts", ["fx_points"], f"""WITH {STEPS}, dirs(d, dx, dy, dz) AS (VALUES {DIRS}),
m AS (SELECT case_id, trace_id, seq, d, row_number() OVER (PARTITION BY trace_id, seq ORDER BY (x-px)*dx + (y-py)*dy + (z-pz)*dz DESC, d) AS rn,
  (x-px)*dx + (y-py)*dy + (z-pz)*dz AS s FROM steps, dirs WHERE px IS NOT NULL)
SELECT case_id, trace_id, d AS dir, count(*) AS n FROM m WHERE rn = 1 AND s > 0 GROUP BY ALL""")
def direction_counts(p):
    step = g.sub(here(), g.vec("p1_x", "p1_y", "p1_z"))
    near = with_step(p).where("step is not null").withColumn("dir", g.best_direction(step))
    return near.where("dir is not null").groupBy("case_id", "trace_id", "dir").agg(F.count("*").alias("n"))


STEP_PLANE = f"""{STEPS}, s AS (SELECT case_id, trace_id, seq, x, y, z, (x-px)/step AS xn, (y-py)/step AS yn, (z-pz)/step AS zn FROM steps WHERE step > 0),
q AS (SELECT *, yn*yn + zn*zn AS side, sqrt(pow(yn*yn + zn*zn, 2) + xn*xn*yn*yn + xn*xn*zn*zn) AS root FROM s),
pl AS (SELECT *, CASE WHEN side = 0 THEN 0 ELSE side/root END AS ux, CASE WHEN side = 0 THEN 0 ELSE -xn*yn/root END AS uy, CASE WHEN side = 0 THEN -1 ELSE -zn*xn/root END AS uz,
  0 AS vx, CASE WHEN side = 0 THEN 1 ELSE zn/sqrt(side) END AS vy, CASE WHEN side = 0 THEN 0 ELSE -yn/sqrt(side) END AS vz FROM q)"""


def step_planes(p):
    near = with_step(p).where("step > 0")
    n = g.unit(g.sub(here(), g.vec("p1_x", "p1_y", "p1_z")))
    near = near.withColumns({f"{c}n": e for c, e in zip("xyz", n)})
    u, v = g.plane_axes(g.vec("xn", "yn", "zn"))
    return near.withColumns({f"u{c}": e for c, e in zip("xyz", u)} | {f"v{c}": e for c, e in zip("xyz", v)})


@query("cross_section", ["fx_points"], f"""WITH {STEP_PLANE}, a AS (SELECT *, CASE WHEN yn*yn + zn*zn = 0 THEN 1 ELSE sqrt(yn*yn + zn*zn) END AS rt FROM pl)
SELECT case_id, trace_id, seq, round(x + 1.5*ux - 0.5*vx, 6) AS cx, round(y + 1.5*uy - 0.5*vy, 6) AS cy, round(z + 1.5*uz - 0.5*vz, 6) AS cz,
  round(x + 2*xn, 6) AS nx, round(y + 3*zn/rt + 2*yn, 6) AS ny, round(z - 3*yn/rt + 2*zn, 6) AS nz,
  round(CASE WHEN side = 0 THEN 40 ELSE -(ux*(40-x) + uy*(41-y) + uz*(39-z)) END, 6) + 0.0 AS lu,
  round(CASE WHEN side = 0 THEN 41 ELSE vx*(40-x) + vy*(41-y) + vz*(39-z) END, 6) + 0.0 AS lv,
  round(CASE WHEN side = 0 THEN 39 ELSE xn*(40-x) + yn*(41-y) + zn*(39-z) END, 6) + 0.0 AS lw,
  true AS round_trip FROM a""")
def cross_section(p):
    n = g.vec("xn", "yn", "zn")
    pl = step_planes(p)
    cs = g.cross_section_point(n, here(), 1.5, -0.5)
    npl = g.normal_plane_point(n, here(), 3.0, 2.0, "x")
    loc = g.to_local(n, here(), mid())
    out = pl.select(
        *ID, *here(), *n, *[F.round(e, 6).alias(f"c{c}") for c, e in zip("xyz", cs)],
        *[F.round(e, 6).alias(f"n{c}") for c, e in zip("xyz", npl)], *[e.alias(f"l{c}") for c, e in zip("uvw", loc)],
    )
    back = g.from_local(n, here(), g.vec("lu", "lv", "lw"))
    out = out.withColumn("round_trip", g.dist(back, mid()) < 1e-9)
    return rounded(out.drop("x", "y", "z", "xn", "yn", "zn"), ["lu", "lv", "lw"])


@query("plane_grid", ["fx_points"], f"""WITH {STEP_PLANE}, r AS (SELECT unnest(generate_series(0, 2)) AS "row"), c AS (SELECT unnest(generate_series(0, 3)) AS col)
SELECT case_id, trace_id, seq, "row", col, round((col - 1.5)*ux + (2 - "row" - 1)*vx, 6) + 0.0 AS gx, round((col - 1.5)*uy + (2 - "row" - 1)*vy, 6) + 0.0 AS gy,
  round((col - 1.5)*uz + (2 - "row" - 1)*vz, 6) + 0.0 AS gz FROM pl, r, c""")
def plane_grid(p):
    out = op.rect_grid(step_planes(p), 3, 4)
    return rounded(out, ["gx", "gy", "gz"]).select(*ID, "row", "col", "gx", "gy", "gz")


@query("polar_grid", ["fx_points"], f"""WITH {STEP_PLANE}, r AS (SELECT unnest(generate_series(0, 2)) AS "row"), c AS (SELECT unnest(generate_series(0, 4)) AS col),
w AS (SELECT *, ("row" - 1) * cos(col * 2 * pi() / 4) AS a, ("row" - 1) * sin(col * 2 * pi() / 4) AS b FROM pl, r, c)
SELECT case_id, trace_id, seq, "row", col, round(a*ux + b*vx, 6) + 0.0 AS gx, round(a*uy + b*vy, 6) + 0.0 AS gy, round(a*uz + b*vz, 6) + 0.0 AS gz FROM w""")
def polar_grid(p):
    out = op.polar_grid(step_planes(p), 5, 3)
    return rounded(out, ["gx", "gy", "gz"]).select(*ID, "row", "col", "gx", "gy", "gz")


@query("relabel", ["fx_points"], """SELECT case_id, trace_id, min(CASE vestype WHEN 15 THEN 13 ELSE vestype END) AS voxel_label,
  min(CASE vestype WHEN 12 THEN 5 WHEN 13 THEN 6 ELSE vestype END) AS vessel, min(CASE WHEN vestype > 22 THEN 0 ELSE vestype END) AS node FROM fx_points GROUP BY case_id, trace_id""")
def relabel(p):
    v = F.col("vestype")
    return p.groupBy("case_id", "trace_id").agg(
        F.min(op.relabel(v, op.VOXEL_RELABEL)).alias("voxel_label"), F.min(op.relabel(v, op.VESSEL_MERGE)).alias("vessel"),
        F.min(op.relabel(v, {}, above=22)).alias("node"),
    )


@query("normalise", ["fx_voxels"], """SELECT case_id, x, y, z, round((intensity - 25) / 14, 6) AS fixed, round(least(1, greatest(0, (intensity + 10) / (40 + 10))), 6) AS clipped,
  round(coalesce((intensity - min(intensity) OVER c) / nullif(max(intensity) OVER c - min(intensity) OVER c, 0), 0), 6) AS norm FROM fx_voxels WINDOW c AS (PARTITION BY case_id)""")
def normalise(v):
    out = op.min_max_norm(v, "intensity").select(
        "case_id", "x", "y", "z", op.fixed_norm(F.col("intensity"), 25, 14).alias("fixed"), op.clip_range(F.col("intensity"), -10, 40).alias("clipped"), "norm"
    )
    return rounded(out, ["fixed", "clipped", "norm"])


@query("z_score", ["fx_voxels"], """WITH q AS (SELECT case_id, quantile_cont(intensity, 0.005) AS lo, quantile_cont(intensity, 0.995) AS hi, avg(intensity) AS m, stddev_pop(intensity) AS s FROM fx_voxels GROUP BY case_id)
SELECT v.case_id, x, y, z, round((greatest(lo, least(hi, intensity)) - m) / (s + 1e-9), 6) AS z_score FROM fx_voxels v JOIN q ON v.case_id = q.case_id""")
def z_score(v):
    return rounded(op.clipped_z_score(v, "intensity"), ["z_score"]).select("case_id", "x", "y", "z", "z_score")


@query("box_rescale", ["fx_boxes_gt"], ("SELECT box_id, " + ", ".join(
    f"CAST(round_even({b} * {o} / {n}, 0) AS INTEGER) AS {b}" for b, o, n in
    (("z0", .5, .6), ("z1", .5, .6), ("x0", .375, .25), ("x1", .375, .25), ("y0", .3, .25), ("y1", .3, .25))) +
    ", [y0, y1, z0, z1, x0, x1] AS rolled FROM fx_boxes_gt"))
def box_rescale(b):
    cols = ["z0", "z1", "x0", "x1", "y0", "y1"]
    new = op.rescale_box([F.col(c) for c in cols], [F.lit(0.5), F.lit(0.375), F.lit(0.3)], (0.6, 0.25, 0.25))
    arr = F.array("z0", "z1", "x0", "x1", "y0", "y1")
    return b.select("box_id", *[e.alias(c) for e, c in zip(new, cols)], op.roll(arr, 2).alias("rolled"))


@query("rename_plan", ["customer"], """WITH f AS (SELECT DISTINCT CASE WHEN c_nationkey = 3 THEN concat('TOF_', c_name) ELSE c_name END AS file FROM customer)
SELECT file, concat('TOF_', printf('%03d', row_number() OVER (ORDER BY file) + (SELECT count(*) FROM f WHERE file LIKE 'TOF!_%' ESCAPE '!')), '_0000.nii.gz') AS new_name
FROM f WHERE file NOT LIKE 'TOF!_%' ESCAPE '!'""")
def rename_plan(c):
    name = F.when(F.col("c_nationkey") == 3, F.concat(F.lit("TOF_"), "c_name")).otherwise(F.col("c_name"))
    return op.rename_plan(c.select(name.alias("file")).distinct(), "TOF")


@query("large_z", ["fx_voxels"], """SELECT case_id, max(y) + 1 AS ny, max(z) + 1 AS nz, (max(y) + 1) / (max(z) + 1) < 3.5 AS large_z FROM fx_voxels GROUP BY case_id""")
def large_z(v):
    return op.large_z(v)


CROP = """req AS (SELECT case_id, lm_type, CAST(round_even(x, 0) AS BIGINT) - 32 AS cx, CAST(round_even(y, 0) AS BIGINT) - 32 AS cy, CAST(round_even(z, 0) AS BIGINT) - 36 AS cz FROM fx_landmarks),
grid AS (SELECT r.*, ix, iy, iz, cx - 3 + ix AS x, cy - 3 + iy AS y, cz - 2 + iz AS z FROM req r, LATERAL unnest(generate_series(0, 5)) AS a(ix), LATERAL unnest(generate_series(0, 5)) AS b(iy), LATERAL unnest(generate_series(0, 3)) AS c(iz)),
patch AS (SELECT g.*, coalesce(v.intensity, 0) AS v FROM grid g LEFT JOIN fx_voxels v ON g.case_id = v.case_id AND g.x = v.x AND g.y = v.y AND g.z = v.z)"""


def crop_requests(lm):
    return lm.select("case_id", "lm_type", *[(g.voxel(F.col(c)) - o).alias(f"c{c}") for c, o in (("x", 32), ("y", 32), ("z", 36))])


@query("crop_patch", ["fx_landmarks", "fx_voxels"], f"WITH {CROP} SELECT case_id, lm_type, cx, cy, cz, ix, iy, iz, v FROM patch")
def crop_patch(lm, v):
    return op.crop(crop_requests(lm), v, (3, 3, 2), "intensity").select("case_id", "lm_type", "cx", "cy", "cz", "ix", "iy", "iz", "v")


@query("fill_patch", ["fx_landmarks", "fx_voxels"], f"""WITH {CROP}, b AS (SELECT case_id, x, y, z, max(v + 1) AS v FROM patch GROUP BY ALL)
SELECT v.case_id, v.x + 5 AS x, v.y + 7 AS y, v.z, coalesce(b.v, v.intensity) AS intensity FROM fx_voxels v LEFT JOIN b ON v.case_id = b.case_id AND v.x = b.x AND v.y = b.y AND v.z = b.z""")
def fill_patch(lm, v):
    patch = op.crop(crop_requests(lm), v, (3, 3, 2), "intensity").withColumn("v", F.col("v") + 1)
    return op.expand(op.fill_back(v, patch, "intensity"), 5, 7).select("case_id", "x", "y", "z", "intensity")


@query("padded_extent", ["fx_voxels"], """SELECT case_id, CAST(ceil((max(x) + 1) / 6) * 6 AS BIGINT) AS px, CAST(ceil((max(y) + 1) / 6) * 6 AS BIGINT) AS py, CAST(ceil((max(z) + 1) / 6) * 6 AS BIGINT) AS pz FROM fx_voxels GROUP BY case_id""")
def padded_extent(v):
    return v.groupBy("case_id").agg(*[op.padded_size(F.max(c) + 1, 6).alias(f"p{c}") for c in "xyz"])


@query("slice_at", ["fx_voxels"], "SELECT case_id, x, y, intensity FROM fx_voxels WHERE z = 4")
def slice_at(v):
    return op.slice_at(v, "z", 4).select("case_id", "x", "y", "intensity")


@query("class_scores", ["embeddings"], """WITH s AS (SELECT vec_id, label, u.i AS cls, CAST(embedding[u.i + 1] AS DOUBLE) AS v FROM embeddings, LATERAL (SELECT unnest(generate_series(0, len(embedding) - 1)) AS i) u),
t AS (SELECT label, sum(exp(v)) AS t FROM s GROUP BY label)
SELECT vec_id, arg_max(cls, v) AS best, round(max(exp(v) / t), 9) AS p, [CAST(arg_max(cls, v) = 0 AS INTEGER), CAST(arg_max(cls, v) = 1 AS INTEGER), CAST(arg_max(cls, v) = 2 AS INTEGER)] AS hot
FROM s JOIN t ON s.label = t.label GROUP BY vec_id""")
def class_scores(e):
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("cls", "v")).withColumn("v", F.col("v").cast("double"))
    out = op.softmax_all(long, "v", ["label"]).groupBy("vec_id").agg(F.max_by("cls", "v").cast("bigint").alias("best"), F.round(F.max("p"), 9).alias("p"))
    return out.withColumn("hot", op.one_hot(F.col("best"), 3))


@query("soft_threshold", ["fx_voxels"], "SELECT case_id, x, y, z, round(1 / (1 + exp(-10 * (score - 0.5))), 9) AS s FROM fx_voxels")
def soft_threshold(v):
    return v.select("case_id", "x", "y", "z", F.round(op.soft_threshold(F.col("score"), 10, 0.5), 9).alias("s"))


@query("polar_contour", ["fx_points"], """WITH n AS (SELECT *, count(*) OVER (PARTITION BY case_id, trace_id) AS n FROM fx_points)
SELECT case_id, trace_id, seq, round(64 + rad * cos(radians(360.0 / n * seq)), 6) AS px, round(60 + rad * sin(radians(360.0 / n * seq)), 6) AS py FROM n""")
def polar_contour(p):
    size = p.groupBy("case_id", "trace_id").agg(F.count("*").alias("n"))
    px, py = op.contour_point(F.col("rad"), F.col("seq"), F.col("n"), 64, 60)
    return p.join(size, ["case_id", "trace_id"]).select(*ID, F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query("sphere_points", ["fx_landmarks"], """WITH s AS (SELECT l.*, i, (2*i + 1) / 20.0 - 1 AS w FROM fx_landmarks l, LATERAL unnest(generate_series(0, 19)) AS g(i))
SELECT case_id, lm_type, x AS lx, i, round(x + 3 * cos(((i + 1) % 20) * pi() * (3 - sqrt(5))) * sqrt(1 - CAST(w AS DOUBLE) * w), 6) AS px,
  round(y + 3 * sin(((i + 1) % 20) * pi() * (3 - sqrt(5))) * sqrt(1 - CAST(w AS DOUBLE) * w), 6) AS py, round(z + 3 * CAST(w AS DOUBLE), 6) AS pz FROM s""")
def sphere_points(lm):
    cut = lm.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    at = g.add(here(), g.sphere_point(F.col("i"), 20, 3.0))
    return cut.select("case_id", "lm_type", F.col("x").alias("lx"), "i", *[F.round(e, 6).alias(f"p{c}") for c, e in zip("xyz", at)])
