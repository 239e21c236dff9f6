"""Serving, cards, benchmark suites, quality checks and what is kept beside a model."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from boutframe.operators import audit, dataset, evaluate, history, identity, models, ratings, service
from boutframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(3)
    rows = [(k, f"2020-{1 + k // 28:02}-{1 + k % 28:02}", k, k + 1, (x := rng.gauss(0, 1)) + rng.gauss(0, 0.5) > 0, x, rng.gauss(0, 1) if k % 3 else None, "AB"[k % 2]) for k in range(280)]
    df = spark.createDataFrame(rows, "fight_id long, event_date string, fighter_a long, fighter_b long, target boolean, delta_x double, delta_y double, source string")
    return df.withColumn("event_date", F.col("event_date").cast("date")).cache()


LINEAR = models.expression_model("v1", ["delta_x", "delta_y"], "1 / (1 + exp(-2 * delta_x - coalesce(delta_y, 0)))")
fit_x = lambda name, train, features: models.expression_model(name, features, 1 / (1 + F.exp(-sum((F.coalesce(F.col(f), F.lit(0.0)) for f in features), F.lit(0.0)))))


def test_prediction_complements_and_counts_features(training):
    for r in models.predict(training, LINEAR).limit(50).collect():
        assert math.isclose(r.fighter_a_win_probability + r.fighter_b_win_probability, 1) and r.present_count == 2 - (r.delta_y is None) and r.missing_features == ["delta_y"] * (r.delta_y is None)
    assert models.predict(training, models.expression_model("v", ["delta_x"], F.lit(1.7))).agg(F.max("fighter_a_win_probability")).first()[0] == 1.0


def test_swap_gap_is_zero_for_odd_models_only(training):
    assert models.swap_gap(training, LINEAR).agg(F.max("gap")).first()[0] < 1e-12
    shifted = models.expression_model("v", ["delta_x"], 1 / (1 + F.exp(-F.col("delta_x") - 1)))
    gaps = models.swap_gap(training, shifted)
    assert gaps.agg(F.min("gap")).first()[0] > 0 and gaps.columns == [*training.columns, "gap"] and gaps.select("delta_x").subtract(training.select("delta_x")).isEmpty()


def test_trees_score_with_missing_values(training):
    model = models.tree_model("trees", training, ["delta_x", "delta_y"], trees=3)
    got = models.predict(training, model)
    assert set(training.columns) < set(got.columns) and got.where("delta_y is null").count() > 0
    assert evaluate.metrics(models.scored(training, model)).first()["auc"] > 0.8
    assert 0 <= models.swap_gap(training, model).agg(F.avg("gap")).first()[0] < 0.5


def test_benchmark_ablation_and_report(training):
    results = models.benchmark(training, {"both": ["delta_x", "delta_y"], "noise": ["delta_y"]}, fit_x, "source")
    rows = results.collect()
    assert {(r.model, r.source) for r in rows} == {(m, s) for m in ("both", "noise") for s in (None, "A", "B")}
    ranked = [r.model for r in models.ranked_report(results).collect()]
    assert ranked[0] == "both" and "| both |" in models.markdown_report(models.ranked_report(results), "t", ["model", "auc", "source"])
    got = {r.model: r for r in models.ablation(training, {"first": ["x"], "second": ["y"]}, fit_x).collect()}
    assert got["all"].delta_auc == 0 and got["without_first"].delta_auc < got["without_second"].delta_auc and got["without_first"].feature_count == 1
    with pytest.raises(ValueError):
        models.ablation(training, {"a": ["x"], "b": ["x"]}, fit_x)
    assert sorted(f for fs in models.GROUPS.values() for f in fs) == sorted(history.FEATURES) and len(history.FEATURES) == 36


def test_walk_forward_is_out_of_sample_and_calibrated(training):
    seen = []

    def fit(name, train, features):
        seen.append((name, train.agg(F.max("event_date")).first()[0]))
        return fit_x(name, train, features)

    got = models.walk_forward(training, ["delta_x"], fit, folds=2, calibrate=True)
    assert {r.fold for r in got.select("fold").distinct().collect()} == {0, 1} and {"platt", "isotonic"} <= set(got.columns)
    first = dataset.walk_forward(training, 2).where("fold = 0").agg(F.min("event_date")).first()[0]
    assert [n for n, _ in seen] == ["fold_0", "fold_0_early", "fold_1", "fold_1_early"] and seen[0][1] < first and seen[1][1] < seen[0][1]


def test_quality_checks_notice_faults(spark, training):
    sides = [(k, f"2020-01-{k + 1:02}", 1, "red", True, "W") for k in range(5)]
    pit = history.prior_record(spark.createDataFrame(sides, "fight_id long, event_date string, fighter_id long, corner string, winner_flag boolean, outcome string").withColumn("event_date", F.col("event_date").cast("date")))
    status = lambda *a: {r.check_name: r.status for r in models.quality_checks(*a).collect()}
    fine = status(training, ["delta_x"], pit, None, ("pass", ""))
    assert fine.pop("source_split_performance_gap") == "warn" and set(fine.values()) == {"pass"} and len(fine) == 9
    far = spark.createDataFrame([("A", 0.7, 0.6), ("B", 0.6, 0.6)], "source string, auc double, accuracy double")
    turned = training.withColumns({"fighter_a": F.col("fighter_b"), "fighter_b": F.col("fighter_a"), "target": F.lit(True), "delta_z": F.when(F.col("fight_id") % 3 == 0, 1.0)})
    bad = status(turned, ["delta_x", "delta_z", "delta_source"][:2] + ["fight_id"], pit.withColumn("prior_fights", F.lit(7)), far, ("fail", "x"))
    assert bad == {
        "no_forbidden_training_features": "pass", "training_columns_keep_identifiers_out_of_feature_matrix": "fail", "deterministic_orientation_without_extreme_id_label_bias": "fail", "binary_label_balance": "warn",
        "temporal_split_has_no_date_overlap": "pass", "walk_forward_folds_are_expanding_and_chronological": "pass", "pit_prior_counts_exclude_current_and_same_date_fights": "fail",
        "high_feature_missingness": "warn", "source_split_performance_gap": "warn", "serving_model_artifact": "fail",
    }


def test_artifacts_cards_and_registry(spark, tmp_path):
    folder = f"file://{tmp_path}/model"
    assert models.artifact_check(spark, folder, ["a"])[0] == "fail"
    card = models.model_card(models.Model("v1", ["a"], None), {"auc": 0.6}, {"A": 100, "B": 60}, {"a": 0.7}, ("2020", "2021"))
    assert card["caveats"] == ["source B has 0.60 of the largest source's rows", "a is missing in 70% of the rows"]
    models.save_artifact(spark, folder, card, {"raw": {"log_loss": 0.6}, "isotonic": {"log_loss": 0.61}}, ([0.1, 0.9], [0.2, 0.8]))
    assert models.artifact_check(spark, folder, ["a"]) == ("pass", "") and models.artifact_check(spark, folder, ["b"])[0] == "fail" and models.load_thresholds(spark, folder) == ([0.1, 0.9], [0.2, 0.8])
    models.save_artifact(spark, folder, card, {"raw": {"log_loss": 0.6}, "isotonic": {"log_loss": 0.66}}, ([0.1], [0.2]))
    assert models.artifact_check(spark, folder, ["a"])[0] == "warn"
    models.save_artifact(spark, folder, card, json.loads('{"raw": {"log_loss": NaN}}'), ([0.1], [0.2]))
    assert models.artifact_check(spark, folder, ["a"])[0] == "warn"
    registry = models.registered(models.registered([], card, "t0"), card | {"metrics": {}}, "t1")
    assert [(r["created_at_utc"], r["updated_at_utc"], r["card"]["metrics"]) for r in registry] == [("t0", "t1", {})]
    assert len(models.registered(registry, {"version": "v2"}, "t2")) == 2


def test_cards_reject_unknown_and_ambiguous_sides(spark):
    rows = catalogue.bout_rows(spark, SF).limit(40).cache()
    people = spark.createDataFrame([("1", "Ann", "ufcstats"), ("2", "Bob", "ufcstats"), ("3", "Bob", "ufcstats")], "fighter_id string, full_name string, source string")
    card = lambda a, b: spark.createDataFrame([(1, a, b, "2030-01-01")], "bout int, fighter_a string, fighter_b string, event_date string")
    rated = ratings.rate(rows)
    assert models.predict_card(card("ann", "2"), people, rows, rated, models.expression_model("v", ["delta_prior_fights"], F.lit(0.5)), "ufcstats").first()["present_count"] == 1
    for name, error in (("nobody", service.NotFound), ("bob", service.Conflict)):
        with pytest.raises(error):
            models.predict_card(card("ann", name), people, rows, rated, LINEAR, "ufcstats")


def test_isotonic_curve_of_many_thresholds(spark):
    x = [k / 5000 for k in range(5001)]
    df = spark.createDataFrame([(0.0,), (0.33333,), (1.0,), (None,), (2.0,)], "p double")
    assert [None if r.calibrated is None else round(r.calibrated, 9) for r in evaluate.apply_isotonic(df, (x, [v * v for v in x])).collect()][0::2] == [0.0, 1.0, 1.0]


def test_review_status_of_near_links_is_strict_on_demand(spark):
    rows, decided = catalogue._rungs(spark, SF)
    links = identity.link(rows, identity.normalize_overrides(decided))
    loose = {r.review_status for r in identity.review(rows, links, decided).where("link_method like '%near'").collect()}
    strict = {r.review_status for r in identity.review(rows, links, decided, strict=True).where("link_method like '%near'").collect()}
    assert loose == {"unresolved"} and strict == {"linked_near"}
    assert audit.identity_checks(identity.review(rows, links, decided), decided.unionByName(decided.where("decision = 'approved'").withColumn("target_source_fighter_id", F.lit("2")))).where("status = 'fail'").count() == 1


def test_review_targets_are_suggested_searched_and_marked(spark):
    review = spark.createDataFrame([("9", "2, 3"), ("8", None)], "source_fighter_id string, candidate_source_fighter_ids string")
    people = spark.createDataFrame([(str(k), f"Name {k}%") for k in range(1, 30)], "fighter_id string, full_name string")
    no = spark.createDataFrame([("9", "5"), ("8", "6")], "source_fighter_id string, target_source_fighter_id string")
    got = service.decision_targets(review, people, no, "9", "name").collect()
    assert len(got) == 10 and [(r.fighter_id, r.suggested) for r in got[:3]] == [("2", True), ("3", True), ("1", False)]
    assert service.decision_targets(review, people, no, "9", "5%").where("is_rejected").count() == 1 and service.decision_targets(review, people, no, "8").count() == 0


def test_entry_imports_without_the_text_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "boutframe", tmp_path / "boutframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries() if k[2:3].isdigit() or k == 'pipeline')"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
