"""Queries of drift fields, fixed points, bootstraps and first passage (STAT-08 to STAT-22 and their parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions.angles import PI
from driftloom.operators import aggregates as agg
from driftloom.operators import dynamics as dyn
from driftloom.operators import filters as flt
from driftloom.operators import joins as jn
from driftloom.operators import windows as win
from driftloom.operators.grid import Axis, integral, marginal
from driftloom.operators.resampling import draws_sql, multiplicities, multiplicity_arrays, resampled_sums
from driftloom.operators.statistics import line_fit_both_errors, signed_distance_to_line
from driftloom.plans.filters import _COND, S
from driftloom.plans.joins import greedy_sql
from driftloom.registry import query
from driftloom.sources.scratch import settled
from driftloom.sources.tables import ANNOTATIONS, DATASETS, DUST, FLOW, T_SQL, U_SQL, setting, trajectories

RHO = Axis("rho", -1.0, 0.25, 20)
THETA = Axis("polar_theta", 0.0, PI / 12, 12, PI)
DT = 12.0
W = f"WITH {T_SQL}, {U_SQL}, a AS ({ANNOTATIONS}), dust AS ({DUST}), ds AS ({DATASETS}), flow AS ({FLOW})"
OVER = "OVER (PARTITION BY dataset, position, crop_index ORDER BY frame_number)"
_D = f"d AS (SELECT *, lead(rho) {OVER} - rho AS dx, lead(frame_number) {OVER} - frame_number AS gap FROM t)"
_H = f"{_D}, h AS (SELECT dataset, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i0, count(*) AS m0, sum(dx) AS m1_0, sum(dx * dx) AS m2_0 FROM d WHERE gap = 1 AND rho BETWEEN -1 AND 4 GROUP BY ALL)"
_K = f"exp(-(((i - i0) * 0.25 / 0.3) ** 2) / 2) / sqrt(2 * {PI!r}) / 0.3"
_S = f"g AS (SELECT CAST(unnest(generate_series(0, 19)) AS INTEGER) AS i), s AS (SELECT dataset, i AS i0, sum(m0 * {_K}) AS m0, sum(m1_0 * {_K}) AS m1_0, sum(m2_0 * {_K}) AS m2_0 FROM h, g GROUP BY ALL), n AS (SELECT dataset, sum(m0 * CASE WHEN i0 IN (0, 19) THEN 0.125 ELSE 0.25 END) AS total FROM s GROUP BY 1)"
_F = f"{_S}, f AS (SELECT dataset, i0, -1 + (i0 + 0.5) * 0.25 AS x0, m0 / total AS density, CASE WHEN m0 / total >= 1e-10 THEN m1_0 / (m0 * 12) END AS drift_0, CASE WHEN m0 / total >= 1e-10 THEN m2_0 / (2 * m0 * 12) END AS diffusion_0 FROM s JOIN n USING (dataset))"
KERNEL = [("gaussian", 0.3)]


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def field(spark, sf):
    return dyn.drift_field(trajectories(spark, sf), [RHO], KERNEL, DT, ["dataset"])


@query("stat08_moments", f"{W}, {_H} SELECT dataset, i0, CAST(m0 AS DOUBLE) AS m0, round(m1_0, 7) AS m1_0, round(m2_0, 7) AS m2_0 FROM h")
def stat08(spark, sf):
    m = dyn.moments(trajectories(spark, sf), [RHO], ["dataset"])
    return m.select("dataset", "i0", "m0", r("m1_0", "m1_0", 7), r("m2_0", "m2_0", 7))


@query("stat09_smoothed", f"{W}, {_H}, {_S} SELECT dataset, i0, round(m0, 5) AS m0, round(m1_0, 5) AS m1_0 FROM s")
def stat09(spark, sf):
    from driftloom.operators.grid import smoothed

    m = smoothed(dyn.moments(trajectories(spark, sf), [RHO], ["dataset"]), [RHO], KERNEL, ["m0", "m1_0"], ["dataset"])
    return m.select("dataset", "i0", r("m0", "m0", 5), r("m1_0", "m1_0", 5))


#: A radial kernel over the circle of k and rho: 1 - (dk / 35)^2 - (drho / 0.7)^2 where that is above 0.
_RADIAL = f"""{_D}, h AS (SELECT dataset, k // 10 AS i0, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i1, count(*) AS m0, sum(dx) AS m1 FROM d WHERE gap = 1 AND rho BETWEEN -1 AND 4 AND k BETWEEN 0 AND 99 GROUP BY ALL),
  g AS (SELECT CAST(i % 10 AS INTEGER) AS t0, CAST(i // 10 AS INTEGER) AS t1 FROM (SELECT unnest(generate_series(0, 199)) AS i)),
  s AS (SELECT dataset, t0 AS i0, t1 AS i1, m0, m1, 1 - ((((t0 - h.i0 + 14) % 10 - 4) * 10 / 35.0) ** 2) - (((t1 - h.i1) * 0.25 / 0.7) ** 2) AS w FROM h, g),
  q AS (SELECT dataset, i0, i1, round(sum(m0 * w), 5) AS m0, round(sum(m1 * w), 5) AS m1 FROM s WHERE w > 0 GROUP BY ALL)"""
RADIAL_AXES = [Axis("k", 0.0, 10.0, 10, 100.0), RHO]


def radial(dk, drho):
    return F.greatest(F.lit(0.0), 1 - (dk / 35) ** 2 - (drho / 0.7) ** 2)


def displacements(spark, sf):
    from driftloom.operators.grid import histogram

    steps = win.forward_differences(trajectories(spark, sf), ["rho"]).where("k between 0 and 99")
    return histogram(steps, RADIAL_AXES, {"m0": F.lit(1), "m1": F.col("d_rho")}, ["dataset"])


@query("stat09b_radial_kernel", f"{W}, {_RADIAL} SELECT * FROM q")
def stat09b(spark, sf):
    from driftloom.operators.grid import stencil

    out = stencil(displacements(spark, sf), RADIAL_AXES, radial, [3, 3], ["m0", "m1"], ["dataset"])
    return out.select("dataset", "i0", "i1", r("m0", "m0", 5), r("m1", "m1", 5))


@query("stat34b_one_target_cell", f"{W}, {_RADIAL} SELECT dataset, m0, m1 FROM q WHERE i0 = 9 AND i1 = 4")
def stat34b(spark, sf):
    from driftloom.operators.grid import stencil_at

    out = stencil_at(displacements(spark, sf), RADIAL_AXES, radial, [9, 4], ["m0", "m1"], ["dataset"])
    return out.select("dataset", r("m0", "m0", 5), r("m1", "m1", 5))


@query("stat10_normalized", f"{W}, {_H}, {_F} SELECT dataset, i0, round(density, 6) AS density, round(diffusion_0, 6) AS diffusion_0 FROM f")
def stat10(spark, sf):
    return field(spark, sf).select("dataset", "i0", r("density", "density"), r("diffusion_0", "diffusion_0"))


_KDE = f"""h AS (SELECT dataset, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i0, count(*) AS m0, 0 AS m1_0, 0 AS m2_0 FROM {{t}} WHERE rho BETWEEN -1 AND 4 GROUP BY ALL), {_S}, p AS (SELECT dataset, i0, m0 / total AS density FROM s JOIN n USING (dataset))"""


@query("stat11_density", f"{W}, {_KDE.format(t='t')} SELECT dataset, i0, round(density, 6) AS density FROM p")
def stat11(spark, sf):
    return dyn.density_of(trajectories(spark, sf), [RHO], KERNEL, ["dataset"]).select("dataset", "i0", r("density", "density"))


@query("stat12_integral", f"{W}, {_KDE.format(t='t')} SELECT dataset, round(sum(density * density * CASE WHEN i0 IN (0, 19) THEN 0.125 ELSE 0.25 END), 6) AS total FROM p GROUP BY 1")
def stat12(spark, sf):
    p = dyn.density_of(trajectories(spark, sf), [RHO], KERNEL, ["dataset"])
    return p.groupBy("dataset").agg(r(integral(F.col("density") * F.col("density"), [RHO]), "total"))


@query("stat13_drift_field", f"{W}, {_H}, {_F} SELECT dataset, i0, round(x0, 6) AS x0, round(density, 6) AS density, round(drift_0, 6) AS drift_0 FROM f")
def stat13(spark, sf):
    return field(spark, sf).select("dataset", "i0", r("x0", "x0"), r("density", "density"), r("drift_0", "drift_0"))


@query("stat13b_field_by_condition", f"{_COND.replace('t AS', 't AS', 1)}, d AS (SELECT *, lead(rho) {OVER} - rho AS dx, lead(frame_number) {OVER} - frame_number AS gap FROM w) SELECT dataset, shear_stress, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i0, count(*) AS n, round(sum(dx), 6) AS m1 FROM d WHERE gap = 1 AND rho BETWEEN -1 AND 4 GROUP BY ALL")
def stat13b(spark, sf):
    s = S(spark, sf)
    rows = flt.with_condition(s.t, s.flow)
    m = dyn.moments(rows, [RHO], ["dataset", "shear_stress"])
    return m.select("dataset", "shear_stress", "i0", F.col("m0").cast("long").alias("n"), r("m1_0", "m1"))


#: The angle in hundredths of its period: whole numbers, so half turns are told apart alike.
_FIELD_3D = f"""e AS (SELECT *, lead(polar_r) {OVER} - polar_r AS d0, lead(k) {OVER} - k AS dk, lead(rho) {OVER} - rho AS d2, lead(frame_number) {OVER} - frame_number AS gap FROM t),
  w AS (SELECT *, CASE WHEN dk = 50 THEN 50 ELSE (dk + 150) % 100 - 50 END AS d1 FROM e),
  h3 AS (SELECT dataset, CAST(least(12, floor((polar_r - 0.0) / 0.5)) AS INTEGER) AS a, k // 10 AS b, CAST(least(9, floor((rho + 1) / 0.5)) AS INTEGER) AS c, count(*) AS n, sum(d0) AS d0, sum(d1) AS d1, sum(d2) AS d2
    FROM w WHERE gap = 1 AND polar_r BETWEEN 0 AND 6.5 AND rho BETWEEN -1 AND 4 GROUP BY ALL),
  g3 AS (SELECT CAST(i % 13 AS INTEGER) AS i0, CAST(i // 13 % 10 AS INTEGER) AS i1, CAST(i // 130 AS INTEGER) AS i2 FROM (SELECT unnest(generate_series(0, 1299)) AS i)),
  k3 AS (SELECT h3.*, i0, i1, i2, exp(-((i0 - a) ** 2) / 2) * (exp(-2 * (sin((i1 - b) * {PI!r} / 10) ** 2 / 0.4) ** 2) / 0.4) * exp(-((i2 - c) ** 2) / 2) / (2 * {PI!r}) / 0.25 AS k FROM h3, g3),
  s3 AS (SELECT dataset, i0, i1, i2, sum(n * k) AS n, sum(d0 * k) AS d0, sum(d1 * k) AS d1, sum(d2 * k) AS d2 FROM k3 GROUP BY ALL),
  n3 AS (SELECT *, n / sum(n * CASE WHEN i0 IN (0, 12) THEN 0.25 ELSE 0.5 END * CASE WHEN i1 IN (0, 9) THEN 5 ELSE 10 END * CASE WHEN i2 IN (0, 9) THEN 0.25 ELSE 0.5 END) OVER (PARTITION BY dataset) AS p FROM s3)"""


@query("stat13c_field_3d", f"{W}, {_FIELD_3D} SELECT dataset, i0, i1, i2, " + ", ".join(f"round(CASE WHEN p >= 1e-10 THEN d{k} / (n * 12) END, 6) AS drift_{k}" for k in range(3)) + " FROM n3")
def stat13c(spark, sf):
    axes = [Axis("polar_r", 0.0, 0.5, 13), Axis("k", 0.0, 10.0, 10, 100.0), Axis("rho", -1.0, 0.5, 10)]
    kernels = [("gaussian", 0.5), ("periodic", 0.4), ("gaussian", 0.5)]
    out = dyn.drift_field(trajectories(spark, sf), axes, kernels, DT, ["dataset"])
    return out.select("dataset", "i0", "i1", "i2", *(r(f"drift_{k}", f"drift_{k}") for k in range(3)))


@query("stat14_filled", f"{W}, {_H}, {_F} SELECT dataset, i0, round(coalesce(CASE WHEN density >= 0.05 THEN drift_0 END, 0), 6) AS drift_0 FROM f")
def stat14(spark, sf):
    rows = field(spark, sf).withColumn("drift_0", F.when(F.col("density") >= 0.05, F.col("drift_0")))
    return dyn.filled(rows, ["drift_0"]).select("dataset", "i0", r("drift_0", "drift_0"))


@query("flt16_masked_by_density", f"{W}, {_H}, {_F}, p AS (SELECT dataset, i0, density FROM f) SELECT dataset, i0, round(CASE WHEN density >= 0.1 THEN drift_0 END, 6) AS drift_0 FROM f")
def flt16(spark, sf):
    f = field(spark, sf)
    return dyn.masked_by_density(f, f.select("dataset", "i0", "density"), ["dataset", "i0"], ["drift_0"], 0.1).select("dataset", "i0", r("drift_0", "drift_0"))


_ROOTS = f"q AS (SELECT *, lead(drift_0) OVER (PARTITION BY dataset ORDER BY i0) AS nv FROM f WHERE drift_0 IS NOT NULL), z AS (SELECT dataset, round(x0 - drift_0 * 0.25 / (nv - drift_0), 4) AS rho, CASE WHEN nv < drift_0 THEN 'stable' ELSE 'unstable' END AS stability FROM q WHERE drift_0 * nv < 0)"


def roots(spark, sf):
    return dyn.fixed_points_1d(field(spark, sf), RHO, ["dataset"])


@query("stat15_fixed_points_1d", f"{W}, {_H}, {_F}, {_ROOTS} SELECT dataset, rho, stability FROM z")
def stat15(spark, sf):
    return roots(spark, sf)


#: A field in two dimensions and, cell by cell, f = a + b u + c v + e u v of both components; roots solve a quadratic equation in v.
_FIELD_2D = f"""e AS (SELECT *, lead(k) {OVER} - k AS dk, lead(rho) {OVER} - rho AS d1, lead(frame_number) {OVER} - frame_number AS gap FROM t),
  w AS (SELECT *, CASE WHEN dk = 50 THEN 50 ELSE (dk + 150) % 100 - 50 END AS d0 FROM e),
  h2 AS (SELECT dataset, k // 10 AS b, CAST(least(9, floor((rho + 1) / 0.5)) AS INTEGER) AS c, count(*) AS n, sum(d0) AS d0, sum(d1) AS d1 FROM w WHERE gap = 1 AND rho BETWEEN -1 AND 4 GROUP BY ALL),
  g2 AS (SELECT CAST(i % 10 AS INTEGER) AS i0, CAST(i // 10 AS INTEGER) AS i1 FROM (SELECT unnest(generate_series(0, 99)) AS i)),
  k2 AS (SELECT h2.*, i0, i1, (exp(-2 * (sin((i0 - b) * {PI!r} / 10) ** 2 / 0.4) ** 2) / 0.4) * exp(-((i1 - c) ** 2) / 2) / sqrt(2 * {PI!r}) / 0.5 AS k FROM h2, g2),
  s2 AS (SELECT dataset, i0, i1, sum(n * k) AS n, sum(d0 * k) AS d0, sum(d1 * k) AS d1 FROM k2 GROUP BY ALL),
  f2 AS (SELECT dataset, i0, i1, d0 / (n * 12) AS p, d1 / (n * 12) AS q FROM (SELECT *, n / sum(n * CASE WHEN i0 IN (0, 9) THEN 5 ELSE 10 END * CASE WHEN i1 IN (0, 9) THEN 0.25 ELSE 0.5 END) OVER (PARTITION BY dataset) AS density FROM s2) WHERE density >= 1e-10),
  c2 AS (SELECT f.dataset, f.i0, f.i1, f.p AS a1, g.p - f.p AS b1, h.p - f.p AS c1, f.p - g.p - h.p + k.p AS e1, f.q AS a2, g.q - f.q AS b2, h.q - f.q AS c2, f.q - g.q - h.q + k.q AS e2
    FROM f2 f JOIN f2 g ON g.dataset = f.dataset AND g.i0 = (f.i0 + 1) % 10 AND g.i1 = f.i1 JOIN f2 h ON h.dataset = f.dataset AND h.i0 = f.i0 AND h.i1 = f.i1 + 1 JOIN f2 k ON k.dataset = f.dataset AND k.i0 = (f.i0 + 1) % 10 AND k.i1 = f.i1 + 1),
  q2 AS (SELECT *, c1 * e2 - c2 * e1 AS aa, a1 * e2 + c1 * b2 - a2 * e1 - c2 * b1 AS bb, a1 * b2 - a2 * b1 AS cc FROM c2),
  v2 AS (SELECT *, CASE WHEN abs(aa) < 1e-14 THEN -cc / nullif(bb, 0) ELSE (-bb + sign * sqrt(bb * bb - 4 * aa * cc)) / (2 * aa) END AS v FROM q2, (VALUES (-1), (1)) s(sign) WHERE bb * bb - 4 * aa * cc >= 0 AND (sign = 1 OR abs(aa) >= 1e-14)),
  u2 AS (SELECT *, CASE WHEN abs(b1 + e1 * v) > abs(b2 + e2 * v) THEN -(a1 + c1 * v) / (b1 + e1 * v) ELSE -(a2 + c2 * v) / (b2 + e2 * v) END AS u FROM v2 WHERE v BETWEEN 0 AND 1),
  j2 AS (SELECT *, (b1 + e1 * v) / 10.0 + (c2 + e2 * u) / 0.5 AS tr, ((b1 + e1 * v) * (c2 + e2 * u) - (c1 + e1 * u) * (b2 + e2 * v)) / 5.0 AS det FROM u2 WHERE u BETWEEN 0 AND 1)"""


def field_2d(t):
    """The drift field over k and rho."""
    return dyn.drift_field(t, PLANE, [("periodic", 0.4), ("gaussian", 0.5)], DT, ["dataset"])


PLANE = [Axis("k", 0.0, 10.0, 10, 100.0), Axis("rho", -1.0, 0.5, 10)]
_POINTS_2D = "SELECT DISTINCT dataset, round((i0 + 0.5 + u) % 10 * 10, 4) AS k, round(-1 + (i1 + 0.5 + v) * 0.5, 4) AS rho, CASE WHEN det < 0 THEN 'saddle' WHEN tr < 0 THEN 'stable' ELSE 'unstable' END AS stability FROM j2"


@query("stat15b_fixed_points_nd", f"{W}, {_FIELD_2D} {_POINTS_2D}")
def stat15b(spark, sf):
    return dyn.fixed_points_nd(field_2d(trajectories(spark, sf)), PLANE, ["dataset"])


@query("stat16_stability", f"{W}, {_H}, {_F}, {_ROOTS} SELECT dataset, stability, count(*) AS n FROM z GROUP BY ALL")
def stat16(spark, sf):
    return roots(spark, sf).groupBy("dataset", "stability").agg(F.count("*").alias("n"))


@query("stat17_within_bounds", f"{W}, {_H}, {_F}, {_ROOTS}, b AS (SELECT dataset, quantile_cont(rho, 0.05) AS lo, quantile_cont(rho, 0.95) AS hi FROM t GROUP BY 1) SELECT dataset, rho, stability FROM z JOIN b USING (dataset) WHERE rho BETWEEN lo AND hi")
def stat17(spark, sf):
    return dyn.within_bounds(roots(spark, sf), dyn.percentile_bounds(trajectories(spark, sf), [RHO], ["dataset"]), ["dataset"], [RHO])


#: Bounds of k along its circle, cut behind the largest gap of its distinct values; whole numbers, so equal gaps are told apart alike.
_CIRCLE = f"""ck AS (SELECT dataset, k, coalesce(lead(k) OVER w, min(k) OVER (PARTITION BY dataset) + 100) AS nk FROM (SELECT DISTINCT dataset, k FROM t) WINDOW w AS (PARTITION BY dataset ORDER BY k)),
  cc AS (SELECT DISTINCT dataset, first_value(nk % 100) OVER (PARTITION BY dataset ORDER BY nk - k DESC, k) AS cut FROM ck),
  cb AS (SELECT dataset, (quantile_cont(CAST((k + 100 - cut) % 100 AS DOUBLE), 0.2) + any_value(cut)) % 100 AS lk, (quantile_cont(CAST((k + 100 - cut) % 100 AS DOUBLE), 0.8) + any_value(cut)) % 100 AS hk,
    quantile_cont(rho, 0.2) AS lo, quantile_cont(rho, 0.8) AS hi FROM t JOIN cc USING (dataset) GROUP BY dataset)"""


@query("stat17b_within_circular_bounds", f"{W}, {_FIELD_2D}, z2 AS ({_POINTS_2D}), {_CIRCLE} SELECT dataset, k, rho, stability FROM z2 JOIN cb USING (dataset) WHERE rho BETWEEN lo AND hi AND CASE WHEN lk <= hk THEN k BETWEEN lk AND hk ELSE k >= lk OR k <= hk END")
def stat17b(spark, sf):
    t = trajectories(spark, sf)
    points = dyn.fixed_points_nd(field_2d(t), PLANE, ["dataset"])
    return dyn.within_bounds(points, dyn.percentile_bounds(t, PLANE, ["dataset"], 20, 80), ["dataset"], PLANE)


REPLICATES = 500


def _times(replicates: int) -> str:
    tracks = "SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY crop_index) - 1 AS j, count(*) OVER (PARTITION BY dataset) AS n FROM (SELECT DISTINCT dataset, crop_index FROM t)"
    return f"j AS (SELECT *, n AS m FROM ({tracks})), {draws_sql(replicates)}"


@query("stat18_multiplicities", f"{W}, {_times(REPLICATES)} SELECT * FROM y")
def stat18(spark, sf):
    return multiplicities(trajectories(spark, sf), ["dataset"], "crop_index", REPLICATES)


def boot(spark, sf):
    return dyn.bootstrap_field(trajectories(spark, sf), [RHO], KERNEL, DT, ["dataset"], "crop_index", REPLICATES)


_BOOT = f"""{_D}, pc AS (SELECT dataset, crop_index, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i0, count(*) AS m0, sum(dx) AS m1 FROM d WHERE gap = 1 AND rho BETWEEN -1 AND 4 GROUP BY ALL), {_times(REPLICATES)},
  bh AS (SELECT dataset, replicate, i0, sum(m0 * times) AS m0, sum(m1 * times) AS m1 FROM pc JOIN y USING (dataset, crop_index) GROUP BY ALL),
  g AS (SELECT CAST(unnest(generate_series(0, 19)) AS INTEGER) AS i), bs AS (SELECT dataset, replicate, i AS i0, sum(m0 * {_K}) AS m0, sum(m1 * {_K}) AS m1 FROM bh, g GROUP BY ALL)"""


@query("stat19_bootstrap_field", f"{W}, {_BOOT} SELECT dataset, replicate, i0, round(CASE WHEN m0 / sum(m0 * CASE WHEN i0 IN (0, 19) THEN 0.125 ELSE 0.25 END) OVER (PARTITION BY dataset, replicate) >= 1e-10 THEN m1 / (m0 * 12) END, 5) AS drift_0 FROM bs")
def stat19(spark, sf):
    return boot(spark, sf).select("dataset", "replicate", "i0", r("drift_0", "drift_0", 5))


def baseline(spark, sf):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("dataset").orderBy("rho"))  # a few roots a data set
    return roots(spark, sf).withColumn("point_id", order.cast("int"))


def summary(base, found, replicates):
    """Summary of the found roots by root of ``base``, however many a data set has; matches are within dataset and stability."""
    from pyspark.sql import Window

    keys = ["dataset", "stability"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("rho")) - 1
    base = settled(base.withColumn("rank", rank))
    rounds = (base.agg(F.max("rank")).first()[0] or 0) + 1
    found = found.withColumn("found_id", F.col("rho"))
    matched = jn.greedy_matches(base, found, keys, ["rho"], 0.3, rounds)
    return dyn.match_summary(base, matched, keys, [RHO], replicates)


@query(
    "stat20_bootstrap_summary",
    f"""{W}, {_H}, {_F}, {_ROOTS}, pc AS (SELECT dataset, crop_index, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i0, count(*) AS m0, sum(dx) AS m1 FROM d WHERE gap = 1 AND rho BETWEEN -1 AND 4 GROUP BY ALL), {_times(REPLICATES)},
    bh AS (SELECT dataset, replicate, i0, sum(m0 * times) AS m0, sum(m1 * times) AS m1 FROM pc JOIN y USING (dataset, crop_index) GROUP BY ALL),
    bs AS (SELECT dataset, replicate, i AS i0, sum(m0 * {_K}) AS m0, sum(m1 * {_K}) AS m1 FROM bh, g GROUP BY ALL),
    bd AS (SELECT dataset, replicate, i0, -1 + (i0 + 0.5) * 0.25 AS x0, CASE WHEN m0 / sum(m0 * CASE WHEN i0 IN (0, 19) THEN 0.125 ELSE 0.25 END) OVER (PARTITION BY dataset, replicate) >= 1e-10 THEN m1 / (m0 * 12) END AS v FROM bs),
    bq AS (SELECT *, lead(v) OVER (PARTITION BY dataset, replicate ORDER BY i0) AS nv FROM bd WHERE v IS NOT NULL),
    bz AS (SELECT dataset, replicate, round(x0 - v * 0.25 / (nv - v), 4) AS rho, CASE WHEN nv < v THEN 'stable' ELSE 'unstable' END AS stability FROM bq WHERE v * nv < 0),
    zb AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rho) AS point_id, row_number() OVER (PARTITION BY dataset, stability ORDER BY rho) - 1 AS rank FROM z),
    near AS (SELECT dataset, stability, replicate, point_id, rank, bz.rho AS rho, bz.rho AS found_id, abs(bz.rho - zb.rho) AS distance FROM bz JOIN zb USING (dataset, stability) WHERE abs(bz.rho - zb.rho) <= 0.3), {greedy_sql("dataset, stability", 10)},
    s2 AS (SELECT dataset, stability, point_id, count(*) AS hits, avg(rho) AS m, quantile_cont(rho, 0.05) AS lo, quantile_cont(rho, 0.95) AS hi FROM taken GROUP BY ALL)
    SELECT dataset, stability, CAST(point_id AS INTEGER) AS point_id, hits, round(m, 6) AS rho_mean, round(CASE WHEN hits >= 2 THEN lo END, 6) AS rho_low, round(CASE WHEN hits >= 2 THEN hi END, 6) AS rho_high, round(coalesce(hits, 0) / {REPLICATES}.0, 6) AS detection_rate
    FROM zb LEFT JOIN s2 USING (dataset, stability, point_id)""",
)
def stat20(spark, sf):
    found = settled(dyn.fixed_points_1d(boot(spark, sf), RHO, ["dataset", "replicate"]))
    out = summary(baseline(spark, sf), found, REPLICATES)
    return out.select("dataset", "stability", "point_id", "hits", *(r(c, c) for c in ("rho_mean", "rho_low", "rho_high", "detection_rate")))


#: Thresholds of distance: 41 from 0 to 1.
THRESHOLDS = [j / 40.0 for j in range(41)]


@query(
    "stat21_first_passage",
    f"""{W}, {_H}, {_F}, {_ROOTS}, c AS (SELECT DISTINCT dataset, rho AS point FROM z WHERE stability = 'stable'),
    x AS (SELECT 'grid_based' AS patch_type, t.* FROM t UNION ALL SELECT 'cell_centered', u.* FROM u),
    l AS (SELECT *, max(frame_number) OVER w - min(frame_number) OVER w AS dur FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.dataset = x.dataset AND a.position = x.position AND annotation = 'not_steady_state' AND frame_number BETWEEN start_frame AND stop_frame) AND EXISTS (SELECT 1 FROM ds WHERE ds.dataset = x.dataset AND frame_number < duration) WINDOW w AS (PARTITION BY patch_type, dataset, position, crop_index)),
    j AS (SELECT unnest(generate_series(0, 40)) AS j),
    fp AS (SELECT patch_type, dataset, position, crop_index, point, j, min(frame_number) AS f FROM (SELECT * FROM l WHERE dur >= 24) JOIN c USING (dataset), j WHERE abs(rho - point) <= j / 40.0 GROUP BY ALL),
    p AS (SELECT patch_type, dataset, point, j, rho, f - frame_number AS tt FROM (SELECT * FROM l WHERE dur >= 24) JOIN fp USING (patch_type, dataset, position, crop_index)),
    b AS (SELECT patch_type, dataset, point, j, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS bin_index, count(tt) AS n, avg(tt) AS mean, CASE WHEN count(tt) > 1 THEN stddev_samp(tt) / sqrt(count(tt)) END AS sem FROM p WHERE tt > 0 AND rho BETWEEN -1 AND 4 GROUP BY ALL)
    SELECT g.dataset, g.point, CAST(g.j AS INTEGER) AS j, g.bin_index, g.n AS n_grid_based, round(g.mean, 6) AS mean_grid_based, round(g.sem, 6) AS sem_grid_based, k.n AS n_cell_centered, round(k.mean, 6) AS mean_cell_centered, round(k.sem, 6) AS sem_cell_centered
    FROM b g JOIN b k USING (dataset, point, j, bin_index) WHERE g.patch_type = 'grid_based' AND k.patch_type = 'cell_centered'""",
)
def stat21(spark, sf):
    return passage_stats(spark, sf, THRESHOLDS).select("dataset", "point", "j", "bin_index", *(c if c.startswith("n_") else r(c, c) for c in PASSAGE))


PASSAGE = [f"{m}_{p}" for p in ("grid_based", "cell_centered") for m in ("n", "mean", "sem")]


def passage_stats(spark, sf, thresholds):
    """Statistics of the frames until first passage to each stable fixed point, by threshold (j) and bin, both patch types side by side."""
    s = S(spark, sf)
    track = ["patch_type", *win.TRACK]
    both = s.t.withColumn("patch_type", F.lit("grid_based")).unionByName(trajectories(spark, sf, last=True).withColumn("patch_type", F.lit("cell_centered")))
    rows = flt.steady_state(both, s.ds, both, s.dust, s.a)
    points = roots(spark, sf).where("stability = 'stable'").select("dataset", F.col("rho").alias("point")).distinct()
    rows = jn.distances_to_points(rows, points, ["dataset"], [("rho", "point")])
    # Points first, so that the duration and the passages share one sort.
    rows = flt.by_track_length(win.with_track_duration(rows, [*track, "point"]), 24)
    rows = win.passages(rows, "distance", thresholds, [*track, "point"]).where("time_to_passage > 0").withColumn("bin_index", RHO.index()).where("bin_index is not null")
    x, cell = F.col("time_to_passage"), ["dataset", "point", "j", "bin_index"]
    stats = rows.groupBy("patch_type", *cell).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), agg.sem(x).alias("sem"))
    side = lambda p: stats.where(F.col("patch_type") == p).drop("patch_type").withColumnsRenamed({c: f"{c}_{p}" for c in ("n", "mean", "sem")})
    return side("grid_based").join(side("cell_centered"), cell)


@query("stat22_line_fit")
def stat22(spark, sf):
    stats = passage_stats(spark, sf, [0.05]).where("n_grid_based >= 10 and n_cell_centered >= 10")
    out = line_fit_both_errors(stats, ["dataset", "point"], "mean_grid_based", "mean_cell_centered", "sem_grid_based", "sem_cell_centered")
    return out.select("dataset", "point", *(r(c, c) for c in ("slope", "intercept", "slope_error", "intercept_error", "chi2")), "n")


@query("stat23_distance_histogram", f"{W}, f AS (SELECT dataset, regr_slope(rho, polar_r) AS m, regr_intercept(rho, polar_r) AS b FROM t GROUP BY 1), e AS (SELECT t.dataset, (rho - m * polar_r - b) / sqrt(1 + m * m) AS e FROM t JOIN f USING (dataset)), h AS (SELECT dataset, CAST(least(19, floor((e + 1) / 0.1)) AS INTEGER) AS b FROM e WHERE e BETWEEN -1 AND 1) SELECT dataset, b, round(count(*) / (sum(count(*)) OVER (PARTITION BY dataset) * 0.1), 6) AS density FROM h GROUP BY dataset, b")
def stat23(spark, sf):
    from driftloom.operators.grid import density_histogram

    t = trajectories(spark, sf)
    fit = t.groupBy("dataset").agg(F.regr_slope("rho", "polar_r").alias("m"), F.regr_intercept("rho", "polar_r").alias("b"))
    rows = t.join(fit, "dataset").withColumn("e", signed_distance_to_line(F.col("polar_r"), F.col("rho"), F.col("m"), F.col("b")))
    return density_histogram(rows.select("dataset", "e"), ["dataset"], "e", -1.0, 0.1, 20).withColumn("density", F.round("density", 6))


def _by_track(source: str) -> str:
    return f"(SELECT dataset || ':' || feature AS dataset, crop_index, CAST(x AS DOUBLE) AS rho FROM (SELECT dataset, crop_index, unnest(['mean', 'variance']) AS feature, unnest([avg(rho), var_pop(rho)]) AS x FROM {source} GROUP BY dataset, crop_index))"


@query(
    "stat24_track_statistics",
    f"""{W}, gm AS {_by_track('t')}, t2 AS {_by_track('u')}, {_KDE.format(t='gm')}, n2 AS (SELECT dataset, count(DISTINCT crop_index) AS draws FROM gm GROUP BY 1),
    j AS (SELECT dataset, crop_index, row_number() OVER (PARTITION BY dataset ORDER BY crop_index) - 1 AS j, count(*) OVER (PARTITION BY dataset) AS n, draws AS m FROM (SELECT DISTINCT dataset, crop_index FROM t2) JOIN n2 USING (dataset)),
    {draws_sql(REPLICATES)},
    bh AS (SELECT dataset, replicate, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i0, sum(times) AS m0 FROM t2 JOIN y USING (dataset, crop_index) WHERE rho BETWEEN -1 AND 4 GROUP BY ALL),
    bs AS (SELECT dataset, replicate, i AS i0, sum(m0 * {_K}) AS m0 FROM bh, g GROUP BY ALL),
    bd AS (SELECT dataset, i0, m0 / sum(m0 * CASE WHEN i0 IN (0, 19) THEN 0.125 ELSE 0.25 END) OVER (PARTITION BY dataset, replicate) AS density FROM bs),
    band AS (SELECT dataset, i0, avg(density) AS mean, quantile_cont(density, 0.05) AS low, quantile_cont(density, 0.95) AS high FROM bd GROUP BY ALL)
    SELECT split_part(dataset, ':', 1) AS dataset, split_part(dataset, ':', 2) AS feature, i0, round(density, 6) AS density, round(mean, 6) AS tracked_mean, round(low, 6) AS tracked_low, round(high, 6) AS tracked_high FROM p JOIN band USING (dataset, i0)""",
)
def stat24(spark, sf):
    """Densities of each trajectory's mean and variance; the second table is drawn as often as the first has trajectories."""

    def by_track(t):
        per = t.groupBy("dataset", "crop_index").agg(F.avg("rho").alias("mean"), F.var_pop("rho").alias("variance"))
        return per.selectExpr("dataset", "crop_index", "stack(2, 'mean', mean, 'variance', variance) as (feature, x)")

    axis, keys = Axis("x", RHO.low, RHO.width, RHO.n), ["dataset", "feature"]
    first, second = (settled(by_track(trajectories(spark, sf, last))) for last in (False, True))
    draws = first.groupBy(*keys).agg(F.count("*").alias("__draws"))
    band = dyn.bootstrap_density(second, axis, KERNEL[0], keys, "crop_index", REPLICATES, draws)
    out = dyn.density_of(first, [axis], KERNEL, keys).join(band, [*keys, "i0"])
    return out.select(*keys, "i0", r("density", "density"), *(r(c, f"tracked_{c}") for c in ("mean", "low", "high")))


@query("stat25_density_comparison", f"{W}, x AS (SELECT 'grid_based' AS dataset, rho FROM t UNION ALL SELECT 'cell_centered', rho FROM u), {_KDE.format(t='x')} SELECT dataset AS patch_type, i0, round(density, 6) AS density FROM p")
def stat25(spark, sf):
    both = trajectories(spark, sf).select(F.lit("grid_based").alias("patch_type"), "rho").unionByName(trajectories(spark, sf, last=True).select(F.lit("cell_centered").alias("patch_type"), "rho"))
    return dyn.density_of(both, [RHO], KERNEL, ["patch_type"]).select("patch_type", "i0", r("density", "density"))


_BOXES = f"""{_H}, {_F}, {_ROOTS}, p AS (SELECT DISTINCT dataset, rho AS point, dataset || ':' || CAST(CAST(round(rho * 10000) AS BIGINT) AS VARCHAR) AS pt FROM z),
  bx AS (SELECT pt, crop_index * 1000 + frame_number AS row_id, value FROM t JOIN p USING (dataset) WHERE rho >= point - 0.05 AND rho < point + 0.05),
  j AS (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY row_id) - 1 AS j, count(*) OVER (PARTITION BY pt) AS n, count(*) OVER (PARTITION BY pt) AS m FROM bx), {draws_sql(REPLICATES, "pt", "row_id")},
  bm AS (SELECT pt, replicate, sum(value * times) / sum(times) AS m FROM bx JOIN y USING (pt, row_id) GROUP BY ALL),
  bi AS (SELECT pt, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM bm GROUP BY 1), bn AS (SELECT pt, count(*) AS n, avg(value) AS mean FROM bx GROUP BY 1)"""


@query("stat26_box_mean_interval", f"{W}, {_BOXES} SELECT dataset, point, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(CASE WHEN n >= 2 THEN low END, 6) AS low, round(CASE WHEN n >= 2 THEN high END, 6) AS high FROM p LEFT JOIN bn USING (pt) LEFT JOIN bi USING (pt)")
def stat26(spark, sf):
    name = F.concat_ws(":", "dataset", F.round(F.col("rho") * 10000).cast("long"))
    points = settled(roots(spark, sf).select("dataset", F.col("rho").alias("point"), name.alias("pt")).distinct())
    rows = trajectories(spark, sf).withColumn("row_id", F.col("crop_index") * 1000 + F.col("frame_number"))
    out = dyn.box_means(rows, "value", "row_id", points, ["dataset"], "pt", [("rho", "point")], [0.1], REPLICATES)
    return out.select("dataset", "point", "n", r("mean", "mean"), r("low", "low"), r("high", "high"))


_FIELD_T = _FIELD_2D[: _FIELD_2D.index(",\n  c2 AS")]
_FIELD_U = f"f2u AS (WITH {_FIELD_T.replace('FROM t)', 'FROM u)')} SELECT * FROM f2)"


@query(
    "stat33_field_deviation",
    f"{W}, {_FIELD_T}, {_FIELD_U}, b AS (SELECT a.dataset, a.i0, a.i1, a.p * b.p + a.q * b.q AS dot, sqrt(a.p ** 2 + a.q ** 2) * sqrt(b.p ** 2 + b.q ** 2) AS size FROM f2 a JOIN f2u b USING (dataset, i0, i1)) SELECT dataset, i0, i1, round(acos(least(1.0, greatest(-1.0, dot / nullif(size, 0)))), 4) AS angle, round(dot, 6) AS dot FROM b",
)
def stat33(spark, sf):
    fields = [field_2d(trajectories(spark, sf, last)).where("drift_0 is not null") for last in (False, True)]
    out = dyn.angle_between(*fields, ["dataset", "i0", "i1"], ["drift_0", "drift_1"])
    return out.select("dataset", "i0", "i1", r("angle", "angle", 4), r("dot", "dot"))


@query("stat41_marginal_density", f"{W}, h AS (SELECT dataset, k // 10 AS i0, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i1, CAST(count(*) AS DOUBLE) AS p FROM t WHERE rho BETWEEN -1 AND 4 GROUP BY ALL) SELECT dataset, i0, round(sum(p * CASE WHEN i1 IN (0, 19) THEN 0.125 ELSE 0.25 END), 6) AS p FROM h GROUP BY ALL")
def stat41(spark, sf):
    from driftloom.operators.grid import histogram

    axes = [Axis("k", 0.0, 10.0, 10), RHO]
    h = histogram(trajectories(spark, sf), axes, {"p": F.lit(1.0)}, ["dataset"])
    return marginal(h, axes, 1, "p", ["dataset"]).withColumn("p", F.round("p", 6))
