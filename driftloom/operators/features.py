"""Principal components, loadings and walks."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import angles as A


def fit_pca(df: DataFrame, vector: str, k: int) -> tuple[list[float], list[list[float]], list[float], list[float]]:
    """(mean, loadings by component, explained share, explained variance) of array rows; variances are of samples.

    Signs are fixed: the loading of largest size is positive. The Gram matrix is summed on the executors; the result has
    k times the vector's length, not the rows'.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    size = rows.select(F.size("v")).first()
    if size is None:
        raise ValueError("no rows to fit")
    if not 1 <= k <= size[0]:
        raise ValueError(f"between 1 and {size[0]} components are possible")
    each = [F.col("v")[i] for i in range(size[0])]
    mean, total = rows.agg(F.array(*map(F.avg, each)), sum(map(F.var_samp, each), F.lit(0.0))).first()
    model = PCA(k=k, inputCol="x", outputCol="y").fit(rows.select(array_to_vector("v").alias("x")))
    loadings = model.pc.toArray().T.tolist()
    signed = [[-x for x in c] if c[max(range(len(c)), key=lambda i: abs(c[i]))] < 0 else c for c in loadings]
    share = [float(x) for x in model.explainedVariance.toArray()]
    return list(mean), signed, share, [x * total for x in share] if total is not None else [0.0] * k


def project(df: DataFrame, vector: str, mean: list[float], loadings: list[list[float]], polar: bool = True) -> DataFrame:
    """``pc``: centred rows on the components; with two or more also polar_r and polar_theta, with three rho (the third, negated)."""
    if polar and len(loadings) < 2:
        raise ValueError("polar features need two components")
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.lit(mean), lambda x, m: x - m)
    dot = lambda c: F.aggregate(F.zip_with("__c", F.lit(c), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    out = df.withColumn("__c", centred).withColumn("pc", F.array(*(dot(c) for c in loadings))).drop("__c")
    if polar:
        x, y = F.col("pc")[0], F.col("pc")[1]
        out = out.withColumns({"polar_r": A.polar_radius(x, y), "polar_theta": A.polar_angle(x, y)})
        if len(loadings) > 2:
            out = out.withColumn("rho", -F.col("pc")[2])
    return out


def loading_table(spark, loadings: list[list[float]], explained: list[float], scaled: bool = False, power: int = 1) -> DataFrame:
    """(component, feature, loading): optionally times the root of the explained variance, absolute (power 0) or squared (2)."""
    rows = []
    for k, (c, e) in enumerate(zip(loadings, explained, strict=True)):
        for i, x in enumerate(c):
            v = x * e**0.5 if scaled else x
            rows.append((k + 1, f"feat_{i}", float(abs(v) if power == 0 else v**power)))
    return spark.createDataFrame(rows, "component int, feature string, loading double")


def walk(df: DataFrame, columns: list[str], sigmas: int) -> DataFrame:
    """Rows (column, step, columns...): the means of all columns, and one of them moved by -sigmas to sigmas standard deviations."""
    aggs = [F.avg(c).alias("m_" + c) for c in columns] + [F.stddev_samp(c).alias("s_" + c) for c in columns]
    base = df.agg(*aggs).withColumn("step", F.explode(F.sequence(F.lit(-sigmas), F.lit(sigmas))))
    base = base.withColumn("column", F.explode(F.array(*map(F.lit, columns))))
    moved = {c: F.col("m_" + c) + F.when(F.col("column") == c, F.col("step") * F.col("s_" + c)).otherwise(0.0) for c in columns}
    return base.select("column", "step", *(v.alias(c) for c, v in moved.items()))
