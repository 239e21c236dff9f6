"""Metrics, calibration curves and calibrators over ``y`` (0 or 1) and ``p`` (probability)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15


def _clipped() -> Column:
    return F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))


def _ln(x: Column) -> Column:
    """The logarithm of a probability; minus infinity at 0, where Spark's own is null and would leave the row out of an average."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def metrics(df: DataFrame, groups: list[str] = (), clip: bool = True) -> DataFrame:
    """Rows, accuracy, log-loss, Brier score and AUC (null with one class only); null groups are groups.

    AUC comes from counts by distinct probability, so its window runs over distinct values, not rows. Log-loss is that of p kept
    ``EPS`` away from 0 and 1; without ``clip`` it is the bare formula: infinite once a sure row is wrong, NaN once one is right.
    """
    p, y = _clipped() if clip else F.col("p"), F.col("y").cast("double")
    plain = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y").cast("int")).cast("double")).alias("accuracy"),
        F.avg(-(y * _ln(p) + (1 - y) * _ln(1 - p))).alias("log_loss"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
    )
    by_value = df.groupBy(*groups, "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*groups).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = by_value.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).groupBy(*groups).agg(F.sum("wins").alias("w"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    auc = pairs.select(*groups, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("w") / (F.col("a") * F.col("b"))).alias("auc"))
    if not groups:
        return plain.withColumn("one", F.lit(1)).join(auc.withColumn("one", F.lit(1)), "one").drop("one")
    renamed = auc.select(*[F.col(g).alias(f"__{g}") for g in groups], "auc")
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return plain.join(renamed, on).drop(*[f"__{g}" for g in groups])


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins between the smallest and largest p, closed on the right; the lowest bin takes the smallest."""
    span = df.agg(F.min("p").alias("low"), F.max("p").alias("high")).withColumn("one", F.lit(1))
    rows = df.withColumn("one", F.lit(1)).join(F.broadcast(span), "one")  # one row
    at = F.ceil((F.col("p") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins) - 1
    number = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0)))).cast("int")
    return rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error; 0 without rows."""
    weighted = F.sum(F.col("rows") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("rows")
    return calibration_curve(df, bins).agg(F.coalesce(weighted, F.lit(0.0)).alias("ece"))


def source_gap(by_source: DataFrame, metric: str) -> DataFrame:
    return by_source.agg((F.max(metric) - F.min(metric)).alias("gap"))


def platt(df: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over p, by Newton steps whose sums are distributed aggregates."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("p") * a + b)))
        w, r, p = q * (1 - q), F.col("y").cast("double") - q, F.col("p")
        s = df.agg(*[F.sum(x).alias(n) for n, x in (("ga", r * p), ("gb", r), ("haa", w * p * p), ("hab", w * p), ("hbb", w))]).first()
        if s["gb"] is None:
            break
        step = np.linalg.solve([[s["haa"] + 1e-9, s["hab"]], [s["hab"], s["hbb"] + 1e-9]], [s["ga"], s["gb"]])
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-10:
            break
    return a, b


def apply_platt(df: DataFrame, curve: tuple[float, float]) -> DataFrame:
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.col("p") * curve[0] + curve[1]))))


def isotonic(df: DataFrame) -> tuple[list[float], list[float]]:
    """Thresholds and values of the isotonic fit of y on p (Spark's own parallel pool-adjacent-violators)."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(df.select(F.col("p").cast("double"), F.col("y").cast("double")))
    return [float(x) for x in model.boundaries], [float(x) for x in model.predictions]


def apply_isotonic(df: DataFrame, curve: tuple[list[float], list[float]]) -> DataFrame:
    """Linear between thresholds, clipped outside to the first and last value; a search in the thresholds, a batch at a time."""
    x, y = (np.array(v, float) for v in curve)

    @F.pandas_udf("double")
    def between(p: pd.Series) -> pd.Series:
        known = p.notna().to_numpy()
        return pd.Series(np.where(known, np.interp(p.fillna(0.0), x, y), np.nan)).where(known)

    return df.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), between(F.col("p").cast("double")))))


def boosted_trees(train: DataFrame, features: list[str], label: str = "target", trees: int = 20):
    """Gradient-boosted trees with an indicator for each feature that can be missing."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = [*features, *[f"{f}__missing" for f in features]]
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(labelCol="label", maxIter=trees, maxDepth=3, seed=7)]).fit(ready(train, features, label))


def ready(df: DataFrame, features: list[str], label: str = "target") -> DataFrame:
    made = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features} | {f"{f}__missing": F.col(f).isNull().cast("double") for f in features}
    df = df.withColumn("label", F.col(label).cast("double")) if label in df.columns else df
    return df.withColumns({k: v for k, v in made.items() if k.endswith("__missing")}).withColumns({k: v for k, v in made.items() if not k.endswith("__missing")})


def no_vig(df: DataFrame, group: str, raw: str) -> DataFrame:
    """A market's probabilities without its margin, and the model's edge over them."""
    fair = F.col(raw) / F.sum(raw).over(Window.partitionBy(group))
    return df.withColumn("no_vig", fair).withColumn("edge", F.col("p") - F.col("no_vig"))
