"""Scoring bouts and cards, benchmark suites over splits and folds, quality checks, and what is kept beside a model.

A *model* scores a frame of delta columns (first side minus second) by a function that adds the column ``p``; all else here is
frames in and frames out. Loops go over folds, feature groups or specifications, of which there are a few.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutframe.operators import audit, boosting, dataset, evaluate, history, service
from boutframe.schemas import CHECK
from boutframe.session import materialize

DELTAS = [f"delta_{f}" for f in history.FEATURES]
#: Groups of features that an ablation leaves out or keeps.
RATING = [f for f in history.FEATURES if "elo" in f or f == "glicko_like_rd"]
GROUPS = {
    "record": [f for f in history.FEATURES if f.startswith("prior_")],
    "activity_bio": ["days_since_last_fight", "age_years", "height_in", "reach_in"],
    "methods": [f for f in history.FEATURES if f.startswith("wins_by_")],
    "striking_grappling": [f for f in history.FEATURES if f.startswith("avg_") and "elo" not in f] + [f for f in history.FEATURES if "_per_" in f],
    "rating": RATING,
    "recent_form": ["recent_3_win_rate", "recent_5_win_rate"],
}
BALANCE, GAP, MISSING, WORSE = (0.4, 0.6), 0.05, 0.6, 0.03


@dataclass
class Model:
    """A version, the delta columns that it reads, and a function from a frame with them to the frame with ``p``."""

    version: str
    features: list[str]
    score: Callable[[DataFrame], DataFrame]
    notes: dict = field(default_factory=dict)


def expression_model(version: str, features: list[str], p: Column | str) -> Model:
    """A model that is an expression over its features (a column, or SQL text)."""
    return Model(version, features, lambda df: df.withColumn("p", F.expr(p) if isinstance(p, str) else p))


def tree_model(version: str, train: DataFrame, features: list[str], trees: int = 20) -> Model:
    """Boosted trees over ``features``, trained on rows with a target."""
    from pyspark.ml.functions import vector_to_array

    fitted = evaluate.boosted_trees(train, features, trees=trees)
    extra = ("features", "rawPrediction", "probability", "prediction", *(f"{f}__missing" for f in features))

    def score(df: DataFrame) -> DataFrame:
        kept = {f: f"{f}__given" for f in features}
        given = df.withColumns({new: F.col(old) for old, new in kept.items()})
        scored = fitted.transform(evaluate.ready(given, features)).withColumn("p", vector_to_array("probability")[1]).drop(*extra, "label", *features)
        return scored.withColumnsRenamed({new: old for old, new in kept.items()})

    return Model(version, features, score)


def booster_model(version: str, train: DataFrame, features: list[str], **options) -> Model:
    """Second-order boosted trees with a learned side for missing values; ``options`` as for :func:`boosting.fit`."""
    fitted = boosting.fit(train, features, **options)
    return Model(version, features, fitted.score, {"trees": len(fitted.trees), "base": fitted.base})


# serving


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Both sides' probabilities (within 0 and 1, adding up to 1) and which features were known."""
    known = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in model.features]))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    scored = model.score(rows.withColumn("missing_features", known)).withColumn("fighter_a_win_probability", p)
    return scored.drop("p").withColumns({
        "fighter_b_win_probability": 1.0 - F.col("fighter_a_win_probability"), "model_version": F.lit(model.version),
        "feature_count": F.lit(len(model.features)), "present_count": F.lit(len(model.features)) - F.size("missing_features"),
    })


def swap_gap(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with ``gap``: how far the probabilities of a bout and of the same bout with sides swapped are from adding up to 1."""
    first = model.score(rows).withColumnRenamed("p", "p_given")
    swapped = first.withColumns({f: -F.col(f) for f in model.features})
    both = model.score(swapped).withColumns({f: -F.col(f) for f in model.features})
    return both.withColumn("gap", F.abs(F.col("p_given") + F.col("p") - 1)).drop("p", "p_given")


def card_features(card: DataFrame, fighters: DataFrame, rows: DataFrame, rated: DataFrame, prefer: str) -> DataFrame:
    """Deltas (a minus b) of each bout of a card ``bout, fighter_a, fighter_b, event_date``; sides are ids or names.

    ``fighters``: fighter_id, full_name, source. An unknown or ambiguous side raises before anything is computed.
    """
    names = card.select(F.col("fighter_a").alias("query")).union(card.select("fighter_b")).distinct()
    known = materialize(service.resolve(names, fighters, prefer), "sides")
    wrong = known.where("matches <> 1").first()
    if wrong is not None:
        raise (service.Conflict if wrong["matches"] else service.NotFound)(wrong["query"])
    side = lambda s: known.select(F.col("query").alias(f"fighter_{s}"), F.col("fighter_id").alias(f"{s}_id"))
    kind = rows.schema["fighter_id"].dataType
    ids = materialize(card.join(side("a"), "fighter_a").join(side("b"), "fighter_b"), "card")
    future = ids.select(F.col("bout").alias("fight_id"), F.col("event_date").cast("date").alias("event_date"), F.col("a_id").cast(kind).alias("red_id"), F.col("b_id").cast(kind).alias("blue_id"))
    bio = [c for c in ("dob", "height_in", "reach_in") if c in fighters.columns]
    if bio:
        for s in ("red", "blue"):
            future = future.join(fighters.select(F.col("fighter_id").cast(kind).alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in bio]), f"{s}_id", "left")
    sides = materialize(history.future_features(rows, rated, future).select("fight_id", "event_date", "corner", "fighter_id", *history.FEATURES), "sides")
    wide = history.matchups(sides, history.FEATURES)
    return ids.join(wide.select(F.col("fight_id").alias("bout"), *DELTAS), "bout")


def predict_card(card: DataFrame, fighters: DataFrame, rows: DataFrame, rated: DataFrame, model: Model, prefer: str) -> DataFrame:
    """Each bout of the card with its resolved sides, probabilities, model version and feature coverage."""
    scored = predict(card_features(card, fighters, rows, rated, prefer), model)
    return scored.select(
        "bout", "event_date", "fighter_a", "fighter_b", F.col("a_id").alias("fighter_a_id"), F.col("b_id").alias("fighter_b_id"), "fighter_a_win_probability", "fighter_b_win_probability",
        "model_version", "feature_count", "present_count", "missing_features",
    )


# benchmarks


def scored(rows: DataFrame, model: Model, source: str | None = None) -> DataFrame:
    """``y, p`` (and ``source``) of labelled rows."""
    return model.score(rows).select(F.col("target").cast("int").alias("y"), "p", *([F.col(source).alias("source")] if source else []))


def benchmark(rows: DataFrame, specs: dict[str, list[str]], fit: Callable[[str, DataFrame, list[str]], Model] = tree_model, source: str | None = None) -> DataFrame:
    """Metrics on the test part of a temporal split, for each named list of features; by source too where there is one."""
    parts = dataset.temporal_split(rows)
    train, test, out = parts.where("split <> 'test'"), parts.where("split = 'test'"), []
    for name, features in specs.items():
        results = materialize(scored(test, fit(name, train, features), source), "scored")
        whole = evaluate.metrics(results).withColumn("source", F.lit(None).cast("string"))
        out.append((whole.unionByName(evaluate.metrics(results, ["source"])) if source else whole).withColumns({"model": F.lit(name), "feature_count": F.lit(len(features))}))
    return audit.union_all(out)


def ranked_report(results: DataFrame, metric: str = "auc") -> DataFrame:
    """Benchmark rows, the best first; rows without the metric are last."""
    return results.where("source is null").orderBy(F.desc_nulls_last(metric), "model")


def ablation(rows: DataFrame, groups: dict[str, list[str]] = GROUPS, fit: Callable[[str, DataFrame, list[str]], Model] = tree_model) -> DataFrame:
    """All features, and all but each group, with each metric's difference from all features."""
    every = [f for fs in groups.values() for f in fs]
    if len(set(every)) != len(every):
        raise ValueError("a feature is in two groups")
    if groups is GROUPS and set(every) != set(history.FEATURES):
        raise ValueError("the groups don't cover the features")
    specs = {"all": [f"delta_{f}" for f in every]} | {f"without_{g}": [f"delta_{f}" for f in every if f not in fs] for g, fs in groups.items()}
    results = benchmark(rows, specs, fit).drop("source").withColumn("one", F.lit(1))
    base = results.where("model = 'all'").select("one", *[F.col(c).alias(f"all_{c}") for c in ("accuracy", "log_loss", "brier", "auc")])
    return results.join(base, "one").select("model", "feature_count", "rows", *[c for m in ("accuracy", "log_loss", "brier", "auc") for c in (F.col(m), (F.col(m) - F.col(f"all_{m}")).alias(f"delta_{m}"))])


def walk_forward(rows: DataFrame, features: list[str], fit: Callable[[str, DataFrame, list[str]], Model] = tree_model, folds: int = 8, calibrate: bool = False) -> DataFrame:
    """Out-of-sample ``fold, y, p`` of every fold, from a model of all earlier dates.

    With ``calibrate`` the last 15 % of the training rows fit Platt's and the isotonic curve of a model of the rows before them;
    both curves are applied to the model of all of them, as ``platt`` and ``isotonic``.
    """
    marked, out = dataset.walk_forward(rows, folds), []
    for k in range(folds):
        test = marked.where(F.col("fold") == k)
        if test.isEmpty():
            break
        train = marked.where(F.col("fold").isNull() | (F.col("fold") < k)).drop("fold")
        results = scored(test, fit(f"fold_{k}", train, features))
        if calibrate:
            late = dataset.late_rows(train)
            early = fit(f"fold_{k}_early", late.where("not is_validation").drop("is_validation"), features)
            held = materialize(scored(late.where("is_validation").drop("is_validation"), early), "held")  # both curves read it again and again
            results = evaluate.apply_isotonic(results, evaluate.isotonic(held)).withColumnRenamed("calibrated", "isotonic")
            results = evaluate.apply_platt(results, evaluate.platt(held)).withColumnRenamed("calibrated", "platt")
        out.append(results.withColumn("fold", F.lit(k)))
    return audit.union_all(out)


# quality


def _row(frame: DataFrame, name: str, status: Column, value: Column, threshold: str, details: Column | None = None) -> DataFrame:
    columns = {"status": status, "table_name": F.lit("model_dataset"), "check_name": F.lit(name), "metric_value": value.cast("double"), "threshold": F.lit(threshold), "details": F.lit("") if details is None else details}
    return frame.select(*[columns[f.name].alias(f.name) for f in CHECK])


def quality_checks(data: DataFrame, features: list[str], pit_rows: DataFrame, by_source: DataFrame | None, artifact: tuple[str, str] | None = None) -> DataFrame:
    """The checks of a training set: names, orientation, balance, splits, folds, recounted priors, sources, missing values, artifact.

    ``data``: oriented rows (fighter_a, fighter_b, target, event_date, features); ``by_source``: source, auc, accuracy.
    """
    one = data.sparkSession.range(1)
    bad = dataset.forbidden_features(features)
    labels = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fighter_a") > F.col("fighter_b")).alias("turned"), F.count_if("target").alias("won"), *[F.count_if(F.col(f).isNull()).alias(f"missing_{k}") for k, f in enumerate(features)])
    rate = F.coalesce(F.col("won") / F.nullif("n", F.lit(0)), F.lit(0.0))
    even = rate.between(*BALANCE)
    ends = dataset.temporal_split(data).groupBy("split").agg(F.min("event_date").alias("low"), F.max("event_date").alias("high"))
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    ends = ends.agg(((at("train", "high") < at("validation", "low")) & (at("validation", "high") < at("test", "low"))).alias("ordered"))
    folds = dataset.walk_forward(data).groupBy("fold").agg(F.min("event_date").alias("low"), F.max("event_date").alias("high"))
    past = F.max("high").over(history.Window.orderBy(F.asc_nulls_first("fold")).rowsBetween(history.Window.unboundedPreceding, -1))  # over folds: a few
    folds = folds.withColumn("past", past).where("fold is not null").agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("past") >= F.col("low")).alias("v"))
    many = F.array_compact(F.array(*[F.when(F.col(f"missing_{k}") > MISSING * F.col("n"), F.lit(f)) for k, f in enumerate(features)]))
    checks = [
        _row(one, "no_forbidden_training_features", F.lit("fail" if bad else "pass"), F.lit(len(bad)), "0", F.lit(",".join(bad))),
        _row(one, "training_columns_keep_identifiers_out_of_feature_matrix", F.lit("fail" if set(features) & {"fight_id", "fighter_a", "fighter_b", "event_date", "target"} else "pass"), F.lit(len(features)), "0"),
        _row(labels, "deterministic_orientation_without_extreme_id_label_bias", F.when(F.col("turned") > 0, "fail").when(even, "pass").otherwise("warn"), F.col("turned"), "0"),
        _row(labels, "binary_label_balance", F.when(even, "pass").otherwise("warn"), F.round(rate, 6), "0.4..0.6"),
        _row(ends, "temporal_split_has_no_date_overlap", F.when(F.col("ordered"), "pass").otherwise("fail"), (~F.col("ordered")).cast("int"), "0"),
        _row(folds, "walk_forward_folds_are_expanding_and_chronological", F.when(F.col("v") == 0, "pass").otherwise("fail"), F.col("v"), "0", F.concat(F.lit("folds="), F.col("folds").cast("string"))),
        _row(audit.leakage(pit_rows), "pit_prior_counts_exclude_current_and_same_date_fights", F.when(F.col("leaks") == 0, "pass").otherwise("fail"), F.col("leaks"), "0"),
        _row(labels, "high_feature_missingness", F.when(F.size(many) == 0, "pass").otherwise("warn"), F.size(many), str(MISSING), F.array_join(many, ",")),
    ]
    if by_source is None:
        checks.append(_row(one, "source_split_performance_gap", F.lit("warn"), F.lit(None), str(GAP), F.lit("no benchmark")))
    else:
        gaps = by_source.agg(F.count("auc").alias("k"), (F.max("auc") - F.min("auc")).alias("auc_gap"), (F.max("accuracy") - F.min("accuracy")).alias("accuracy_gap"))
        close = (F.col("k") >= 2) & (F.col("auc_gap") <= GAP) & (F.col("accuracy_gap") <= GAP)
        checks.append(_row(gaps, "source_split_performance_gap", F.when(close, "pass").otherwise("warn"), F.round("auc_gap", 6), str(GAP)))
    if artifact is not None:
        checks.append(_row(one, "serving_model_artifact", F.lit(artifact[0]), F.lit(0 if artifact[0] == "pass" else 1), "0", F.lit(artifact[1])))
    return audit.standard(audit.union_all(checks))


# what is kept beside a model


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def model_card(model: Model, metrics: dict, coverage: dict[str, float], missing: dict[str, float], dates: tuple[str, str]) -> dict:
    """What a reader of the model should know; sources with under 0.7 of the largest coverage and features missing in over half the rows are caveats."""
    most = max(coverage.values(), default=0)
    caveats = [f"source {s} has {n / most:.2f} of the largest source's rows" for s, n in sorted(coverage.items()) if most and n < 0.7 * most]
    caveats += [f"{f} is missing in {share:.0%} of the rows" for f, share in sorted(missing.items()) if share > 0.5]
    return {"version": model.version, "features": model.features, "dates": list(dates), "metrics": metrics, "source_rows": coverage, "caveats": caveats, **model.notes}


def save_artifact(spark: SparkSession, folder: str, card: dict, metrics: dict, thresholds: tuple[list[float], list[float]] | None = None) -> None:
    """A model's card, metrics and isotonic thresholds as JSON texts in a folder that Spark can write."""
    _write_text(spark, f"{folder}/metadata.json", json.dumps(card))
    _write_text(spark, f"{folder}/metrics.json", json.dumps(metrics))
    if thresholds is not None:
        _write_text(spark, f"{folder}/isotonic_calibrator.json", json.dumps({"x": thresholds[0], "y": thresholds[1]}))


def load_thresholds(spark: SparkSession, folder: str) -> tuple[list[float], list[float]]:
    data = json.loads(_read_text(spark, f"{folder}/isotonic_calibrator.json") or "{}")
    return data["x"], data["y"]


def artifact_check(spark: SparkSession, folder: str, features: list[str]) -> tuple[str, str]:
    """Status and details: fail on missing parts or other features, warn when calibration makes log-loss worse by over ``WORSE``."""
    texts = {name: _read_text(spark, f"{folder}/{name}") for name in ("metadata.json", "metrics.json", "isotonic_calibrator.json")}
    if lacking := [name for name, text in texts.items() if text is None]:
        return "fail", f"missing: {','.join(lacking)}"
    try:
        card, metrics = json.loads(texts["metadata.json"]), json.loads(texts["metrics.json"])
    except ValueError as error:
        return "fail", str(error)
    if card.get("features") != features:
        return "fail", "other features"
    values = [v for part in ("raw", "isotonic") for v in metrics.get(part, {}).values()]
    if any(not isinstance(v, (int, float)) or v != v or v in (float("inf"), float("-inf")) for v in values):
        return "warn", "a metric is not finite"
    raw, calibrated = (metrics.get(part, {}).get("log_loss") for part in ("raw", "isotonic"))
    if raw is not None and calibrated is not None and calibrated - raw > WORSE:
        return "warn", f"calibration adds {calibrated - raw:.4f} to the log-loss"
    return "pass", ""


def registered(registry: list[dict], card: dict, stamp: str) -> list[dict]:
    """The registry with the card's version inserted or replaced; a replaced entry keeps its creation time and its place."""
    old = next((r for r in registry if r["version"] == card["version"]), None)
    entry = {"version": card["version"], "card": card, "created_at_utc": old["created_at_utc"] if old else stamp, "updated_at_utc": stamp}
    return [entry if r["version"] == card["version"] else r for r in registry] + ([] if old else [entry])


def markdown_report(results: DataFrame, title: str, columns: list[str]) -> str:
    """A table of benchmark rows (a few) as Markdown; missing values are dashes."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in results.select(*columns).collect()]) + "\n"
