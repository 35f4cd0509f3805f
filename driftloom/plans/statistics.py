"""Queries of trajectory statistics (STAT-01 to STAT-07 and STAT-27 to STAT-34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import features as feat
from driftloom.operators import grid
from driftloom.operators import statistics as st
from driftloom.operators import windows as win
from driftloom.operators.aggregates import r_squared
from driftloom.registry import query
from driftloom.sources.scratch import settled
from driftloom.sources.tables import DATASETS, T_SQL, U_SQL, setting, table, trajectories

W = f"WITH {T_SQL}, {U_SQL}, ds AS ({DATASETS})"
OVER = "OVER (PARTITION BY crop_index ORDER BY frame_number)"
KEY = ["crop_index", "frame_number"]


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query("stat01_bins", f"{W}, m AS (SELECT min(value) - 1 AS a, max(value) + 1 AS z FROM t), n AS (SELECT a, z, ceil((z - a) / 50) AS n FROM m), b AS (SELECT *, unnest(generate_series(0, CAST(n AS INTEGER) - 1)) AS i FROM n) SELECT CAST(i AS INTEGER) AS i, round(a + i * (z - a) / n, 6) AS low, round(a + (i + 0.5) * (z - a) / n, 6) AS center FROM b")
def stat01(spark, sf):
    axis = grid.make_axis(trajectories(spark, sf), "value", 50.0, pad=1.0)
    return grid.axis_table(spark, axis).select("i", r("low", "low"), r("center", "center"))


@query("stat02_snapped_limits", f"{W} SELECT dataset, floor(min(rho) / 0.3) * 0.3 AS low, ceil(max(rho) / 0.3) * 0.3 AS high FROM t GROUP BY 1")
def stat02(spark, sf):
    low, high = grid.snapped_limits(F.col("a"), F.col("z"), 0.3)
    return trajectories(spark, sf).groupBy("dataset").agg(F.min("rho").alias("a"), F.max("rho").alias("z")).select("dataset", low.alias("low"), high.alias("high"))


@query("stat03_histogram", f"{W} SELECT CAST(floor(k / 10.0) AS INTEGER) AS i0, CAST(least(3, floor(rho + 1)) AS INTEGER) AS i1, count(*) AS n, round(sum(value), 6) AS total FROM t WHERE rho BETWEEN -1 AND 3 AND k <= 100 GROUP BY ALL")
def stat03(spark, sf):
    axes = [grid.Axis("k", 0.0, 10.0, 10), grid.Axis("rho", -1.0, 1.0, 4)]
    return grid.histogram(trajectories(spark, sf), axes, {"n": F.lit(1), "total": F.col("value")}).withColumn("total", F.round("total", 6))


@query("stat04_passage_bins", f"{W}, b AS (SELECT polar_r FROM t UNION ALL SELECT polar_r FROM u) SELECT CAST(i AS INTEGER) AS i, i * 0.25 AS low, (i + 0.5) * 0.25 AS center FROM (SELECT unnest(generate_series(0, CAST(ceil(max(polar_r) / 0.25) AS INTEGER) - 1)) AS i FROM b)")
def stat04(spark, sf):
    both = trajectories(spark, sf).unionByName(trajectories(spark, sf, last=True))
    high = both.agg((F.ceil(F.max("polar_r") / 0.25) * 0.25).cast("double")).first()[0]
    return grid.axis_table(spark, grid.make_axis(both, "polar_r", 0.25, (0.0, high)))


_ACF = f"""b AS (SELECT max(frame_number) - min(frame_number) + 1 AS n FROM t), c AS (SELECT dataset, crop_index, frame_number, rho - avg(rho) OVER (PARTITION BY crop_index) AS c, stddev_samp(rho) OVER (PARTITION BY crop_index) AS s FROM t),
l AS (SELECT CAST(unnest(generate_series(1, (SELECT n // 3 FROM b))) AS INTEGER) AS lag), x AS (SELECT DISTINCT dataset, crop_index, s, lag FROM c, l),
p AS (SELECT a.crop_index, z.frame_number - a.frame_number AS lag, sum(a.c * z.c) AS p FROM c a JOIN c z ON a.crop_index = z.crop_index AND z.frame_number > a.frame_number GROUP BY ALL),
acf AS (SELECT dataset, x.crop_index, x.lag, coalesce(p, 0) / (n * nullif(s * s, 0)) AS acf FROM x LEFT JOIN p ON x.crop_index = p.crop_index AND x.lag = p.lag, b),
ms AS (SELECT dataset, lag, avg(acf) AS mean, quantile_cont(acf, 0.05) AS lower, quantile_cont(acf, 0.95) AS upper FROM acf GROUP BY ALL)"""


def acf(spark, sf):
    return st.lag_summary(st.autocorrelation(trajectories(spark, sf), "rho", ["dataset", "crop_index"]), ["dataset"])


@query("stat05_autocorrelation", f"{W}, {_ACF} SELECT dataset, lag, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ms")
def stat05(spark, sf):
    return acf(spark, sf).select("dataset", "lag", r("mean", "mean"), r("lower", "lower"), r("upper", "upper"))


_CCF = f"""b AS (SELECT max(frame_number) - min(frame_number) + 1 AS n FROM t), c AS (SELECT dataset, crop_index, frame_number, rho - avg(rho) OVER w AS c1, polar_r - avg(polar_r) OVER w AS c2, stddev_samp(rho) OVER w AS s1, stddev_samp(polar_r) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY crop_index)),
l AS (SELECT CAST(unnest(generate_series(-(SELECT n // 3 FROM b), (SELECT n // 3 FROM b))) AS INTEGER) AS lag), x AS (SELECT DISTINCT dataset, crop_index, s1, s2, lag FROM c, l),
p AS (SELECT a.crop_index, z.frame_number - a.frame_number AS lag, sum(a.c1 * z.c2) AS p FROM c a JOIN c z ON a.crop_index = z.crop_index GROUP BY ALL),
ccf AS (SELECT dataset, x.crop_index, x.lag, coalesce(p, 0) / (n * nullif(s1 * s2, 0)) AS ccf FROM x LEFT JOIN p ON x.crop_index = p.crop_index AND x.lag = p.lag, b)"""


@query("stat05b_cross_correlation", f"{W}, {_CCF} SELECT dataset, lag, round(avg(ccf), 6) AS mean, round(quantile_cont(ccf, 0.05), 6) AS lower, round(quantile_cont(ccf, 0.95), 6) AS upper FROM ccf GROUP BY ALL")
def stat05b(spark, sf):
    found = st.cross_correlation(trajectories(spark, sf), "rho", "polar_r", ["dataset", "crop_index"])
    return st.lag_summary(found, ["dataset"], "ccf").select("dataset", "lag", r("mean", "mean"), r("lower", "lower"), r("upper", "upper"))


def decays(spark, sf):
    """The mean autocorrelation by lag, computed once, and the decay fitted to it."""
    means = settled(acf(spark, sf).select("dataset", "lag", F.col("mean").alias("y")))
    # A decay over more than 100 frames cannot be told from a line here, so b begins there.
    return means, st.fit_decay(means, ["dataset"], "lag", "y", 0.01, 5.0)


def _decay_sql(steps: int = 40, rounds: int = 3) -> str:
    """The fit of the means, as ``fit``: the grid search of the operator, round by round."""
    out = ["r0 AS (SELECT DISTINCT dataset, CAST(0.01 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi FROM ms)"]
    for k in range(rounds):
        out.append(f"e{k} AS (SELECT dataset, lo, hi, lo + i * (hi - lo) / {steps} AS b, lag, mean AS y FROM r{k} JOIN ms USING (dataset), (SELECT unnest(generate_series(0, {steps})) AS i))")
        out.append(f"f{k} AS (SELECT dataset, lo, hi, b, regr_slope(y, exp(-b * lag)) AS a, regr_intercept(y, exp(-b * lag)) AS c, regr_syy(y, exp(-b * lag)) - regr_slope(y, exp(-b * lag)) * regr_sxy(y, exp(-b * lag)) AS sse FROM e{k} GROUP BY ALL)")
        out.append(f"q{k} AS (SELECT * FROM f{k} WHERE a IS NOT NULL AND NOT isnan(a) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sse, b) = 1)")
        out.append(f"r{k + 1} AS (SELECT dataset, greatest(0.01, b - (hi - lo) / {steps}) AS lo, b + (hi - lo) / {steps} AS hi FROM q{k})")
    return ", ".join([*out, f"fit AS (SELECT dataset, a, b, c FROM q{rounds - 1})"])


@query("stat06_decay_fit", f"{W}, {_ACF}, {_decay_sql()} SELECT dataset, round(a, 3) AS a, round(b, 3) AS b, round(c, 3) AS c FROM fit")
def stat06(spark, sf):
    fit = decays(spark, sf)[1]
    return fit.select("dataset", r("a", "a", 3), r("b", "b", 3), r("c", "c", 3))


@query("stat07_decay_r2", f"{W}, {_ACF}, {_decay_sql()} SELECT dataset, round(1 - sum((mean - (a * exp(-b * lag) + c)) ** 2) / nullif(var_pop(mean) * count(mean), 0), 6) AS r2 FROM ms JOIN fit USING (dataset) GROUP BY 1")
def stat07(spark, sf):
    rows, fit = decays(spark, sf)
    both = rows.join(fit, "dataset").withColumn("fit", F.col("a") * F.exp(-F.col("b") * F.col("lag")) + F.col("c"))
    return both.groupBy("dataset").agg(r(r_squared(F.col("y"), F.col("fit")), "r2"))


def components(spark, sf, k=3):
    return feat.fit_pca(table(spark, sf, "embeddings"), "embedding", k)


@query("stat27_pca_fit")
def stat27(spark, sf):
    _, _, explained, _ = components(spark, sf, 8)
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n_rows"))
    return n.select("n_rows", F.posexplode(F.lit(explained)).alias("component", "explained"))


@query("stat28_projection")
def stat28(spark, sf):
    mean, loadings, _, _ = components(spark, sf)
    out = feat.project(table(spark, sf, "embeddings"), "embedding", mean, loadings)
    return out.select("vec_id", *(r(c, c) for c in ("polar_r", "polar_theta", "rho")))


@query("stat29_loadings")
def stat29(spark, sf):
    _, loadings, _, variances = components(spark, sf)
    return feat.loading_table(spark, loadings, variances, scaled=True, power=2)


@query(
    "stat30_walk",
    f"{W}, m AS (SELECT avg(rho) AS mr, stddev_samp(rho) AS sr, avg(polar_r) AS mp, stddev_samp(polar_r) AS sp FROM t), s AS (SELECT *, CAST(unnest(generate_series(-2, 2)) AS INTEGER) AS step FROM m) SELECT c AS \"column\", step, round(mr + CASE WHEN c = 'rho' THEN step * sr ELSE 0 END, 6) AS rho, round(mp + CASE WHEN c = 'polar_r' THEN step * sp ELSE 0 END, 6) AS polar_r FROM s, (SELECT unnest(['rho', 'polar_r']) AS c)",
)
def stat30(spark, sf):
    return feat.walk(trajectories(spark, sf), ["rho", "polar_r"], 2).select("column", "step", r("rho", "rho"), r("polar_r", "polar_r"))


@query(
    "stat31_point_summary",
    f"""{W}, c AS (SELECT dataset, position, avg(polar_theta) AS th, avg(rho) AS rho, avg((value < 60)::INT) AS rate FROM t GROUP BY ALL)
    SELECT dataset, position, round(cos(2 * th), 6) AS nematic, round(CASE WHEN th > 5 * 3.141592653589793 / 6 THEN th - 3.141592653589793 ELSE th END, 6) AS shown, round(rho, 6) AS rho, round(rate, 6) AS rate FROM c JOIN ds USING (dataset) WHERE rate >= 0.4 AND stability_category = 'stable'""",
)
def stat31(spark, sf):
    from driftloom.functions.angles import nematic_order, shown_angle

    points = trajectories(spark, sf).groupBy("dataset", "position").agg(F.avg("polar_theta").alias("th"), F.avg("rho").alias("rho"), F.avg((F.col("value") < 60).cast("int")).alias("rate"))
    rows = points.join(setting(spark, DATASETS), "dataset").where("rate >= 0.4 and stability_category = 'stable'")
    return rows.select("dataset", "position", r(nematic_order(F.col("th")), "nematic"), r(shown_angle(F.col("th")), "shown"), r("rho", "rho"), r("rate", "rate"))


@query("stat32_correlation_input", f"{W} SELECT t.dataset, round(corr(t.rho, u.rho), 6) AS rho__flow, round(corr(t.polar_r, t.k), 6) AS r__k, count(*) AS n FROM t JOIN u USING (dataset, position, crop_index, frame_number) GROUP BY 1")
def stat32(spark, sf):
    t = win.with_unwrapped(trajectories(spark, sf), "polar_theta", 3.141592653589793, "theta")
    flow = trajectories(spark, sf, last=True).select("dataset", "position", *KEY, F.col("rho").alias("flow"))
    return t.join(flow, ["dataset", "position", *KEY]).groupBy("dataset").agg(r(F.corr("rho", "flow"), "rho__flow"), r(F.corr("polar_r", "k"), "r__k"), F.count("*").alias("n"))


@query(
    "stat34_displacement_histogram",
    f"{W}, d AS (SELECT *, lead(rho) {OVER} - rho AS dx, lead(frame_number) {OVER} - frame_number AS gap FROM t), h AS (SELECT k // 10 AS i0, CAST(least(19, floor((rho + 1) / 0.25)) AS INTEGER) AS i1, sum(dx) AS w FROM d WHERE gap = 1 AND rho BETWEEN -1 AND 4 GROUP BY ALL) SELECT i0, i1, round(w, 6) AS w, w > q AS clipped FROM h, (SELECT quantile_cont(w, 0.99) AS q FROM h)",
)
def stat34(spark, sf):
    steps = win.forward_differences(trajectories(spark, sf), ["rho"])
    h = grid.histogram(steps, [grid.Axis("k", 0.0, 10.0, 10), grid.Axis("rho", -1.0, 0.25, 20)], {"w": F.col("d_rho")})
    # Cells of a fixed grid, so the group is bounded.
    limit = F.broadcast(h.agg(F.percentile("w", 0.99).alias("q")))
    return h.crossJoin(limit).select("i0", "i1", r("w", "w"), (F.col("w") > F.col("q")).alias("clipped"))
