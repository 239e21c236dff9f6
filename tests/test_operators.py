import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutframe.functions import text as X
from boutframe.operators import audit, dataset, evaluate, history, identity, ratings, service, staging
from boutframe.schemas import STAGING, columns, conform, empty
from boutframe.sources import files, html
from boutframe.sources.store import Store


def day(n, month=1, year=2020):
    return dt.date(year, month, n)


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column).first()[0]


HISTORY = [  # three bouts of the same pair, two on one day; red wins all
    (f, d, c, o, 3 - o, c == "red", "W" if c == "red" else "L") for f, d in ((1, day(1)), (2, day(1)), (3, day(1, 2))) for c, o in (("red", 1), ("blue", 2))
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(HISTORY, "fight_id long, event_date date, corner string, fighter_id long, opponent_id long, winner_flag boolean, outcome string")


def test_same_day_bouts_do_not_see_each_other(rows):
    got = history.prior_record(rows).where("fighter_id = 1").orderBy("fight_id").collect()
    assert [(r.prior_fights, r.prior_wins, r.prior_losses) for r in got] == [(0, 0, 0), (0, 0, 0), (2, 2, 0)]


def test_recent_form_is_cut_before_filtering(spark):
    rows = [(n, day(n), "red", 1, 2, o == "W", o) for n, o in enumerate(["W", "L", "D", "D", "D", "W"], 1)]
    df = spark.createDataFrame(rows, "fight_id long, event_date date, corner string, fighter_id long, opponent_id long, winner_flag boolean, outcome string")
    got = {r.fight_id: r.x for r in history.recent_win_rate(df, 3, "x").collect()}
    assert got == {1: None, 2: 1.0, 3: 0.5, 4: 0.5, 5: 0.0, 6: None}


def test_elo_same_day_start_and_overwrite(rows):
    got = {(r.fight_id, r.fighter_id): r for r in ratings.rate(rows).collect()}
    assert got[1, 1].pre_fight_elo == got[2, 1].pre_fight_elo == 1500 and got[1, 1].elo_expected_win_prob == 0.5
    after = 1516.0  # the second bout of the day starts from the same rating and overwrites the first one's update
    assert got[3, 1].pre_fight_elo == after
    assert math.isclose(got[3, 1].time_decayed_elo, 1500 + 16 * 0.5 ** (31 / 730))


def test_snapshot_decays_to_its_date(rows):
    got = {r.fighter_id: r for r in ratings.snapshot(ratings.rate(rows), "2020-02-01").collect()}
    assert got[1].rating == 1516.0 and math.isclose(got[2].decayed_rating, 1500 - 16 * 0.5 ** (31 / 730))


@pytest.mark.parametrize("per_bin", [9, 60])
def test_ratings_in_bins_equal_the_plain_fold_and_take_any_ids(spark, per_bin):
    rng, out = random.Random(4), []
    for n in range(60):
        a, b = rng.sample(range(9), 2)
        won, draw = rng.random() < 0.5, rng.random() < 0.2
        for corner, own, other, w in (("blue", a, b, won), ("red", b, a, not won)):
            out.append((f"f{n:03}", day(n // 3 + 1), corner, f"s:{own}", f"s:{other}", not draw and w, "D" if draw else "W" if w else "L"))
    out += [("f900", None, corner, f"s:{k}", f"s:{1 - k}", k == 0, "W" if k == 0 else "L") for k, corner in enumerate(("blue", "red"))]  # without a date: not rated
    df = spark.createDataFrame(out, "fight_id string, event_date date, corner string, fighter_id string, opponent_id string, winner_flag boolean, outcome string").repartition(3)
    take = lambda rows: {(r["fight_id"], r["fighter_id"]): [None if r[c] != r[c] else r[c] for c in ratings.RATED] for r in rows}
    want = take(ratings.fold(ratings.bout_pairs(df).toPandas()).to_dict("records"))
    assert len(want) == 120 and take(ratings.rate(df, per_bin=per_bin).collect()) == want  # to the bit
    assert ratings.rate(df.where("false"), per_bin=per_bin).count() == 0


def test_ratings_skip_bouts_without_two_sides(spark, rows):
    odd = rows.where("not (fight_id = 1 and corner = 'blue')")
    assert {r.fight_id for r in ratings.rate(odd).collect()} == {2, 3}


def test_future_rows_take_the_same_path(spark, rows):
    future = spark.createDataFrame([(99, day(1, 3), 1, 2)], "fight_id long, event_date date, red_id long, blue_id long")
    both = history.prior_record(history.with_future(rows, future)).where("is_future")
    got = history.matchups(both, ["prior_fights", "prior_wins"]).first()
    assert (got.delta_prior_fights, got.delta_prior_wins) == (0, 3)
    assert history.missing_fighters(future, rows.select("fighter_id").where("fighter_id = 1")).collect()[0][0] == 2


@pytest.mark.parametrize(
    "a, b, status",
    [
        (day(25, 5, 1986), day(26, 5, 1986), "near"), (day(10, 4, 1980), day(4, 10, 1980), "month_day_swap"), (day(7, 4, 1982), day(17, 4, 1982), "same_year_close"),
        (day(13, 6, 1994), day(30, 8, 1994), "conflict"), (day(31, 12, 1990), day(1, 1, 1991), "conflict"), (day(1), day(1), "exact"), (None, day(1), "missing"),
    ],
)
def test_dob_status(spark, a, b, status):
    df = spark.createDataFrame([(a, b)], "a date, b date")
    assert df.select(X.dob_status(F.col("a"), F.col("b"))).first()[0] == status


def fighters(spark, *people):
    return spark.createDataFrame([(s, i, n, d) for s, i, n, d in people], "source string, source_fighter_id string, full_name string, dob date")


@pytest.mark.parametrize(
    "a, b, method, confidence",
    [
        (("Ann Lee", day(25, 5, 1986)), ('Ann "Ace" Lee', day(26, 5, 1986)), "cleaned_name_dob_near", 0.9),
        (("Ann Lee", day(10, 4, 1980)), ('Ann "Ace" Lee', day(4, 10, 1980)), "cleaned_name_dob_month_day_swap", 0.9),
        (("Ann Lee", day(7, 4, 1982)), ("Ann Lee", day(17, 4, 1982)), "exact_name_dob_same_year_close", 0.92),
        (("AJ Lee", day(1)), ("A.J. Lee", day(1)), "exact_name_dob", 1.0),
        (("Ann Lee", day(1)), ('Ann "Ace" Lee', day(1)), "cleaned_name_dob", 0.95),
        (("Ann Lee", day(1, 1, 1996)), ("Ann Lee", day(1, 1, 1977)), "source_self", 1.0),
    ],
)
def test_link_chain(spark, a, b, method, confidence):
    got = identity.link(fighters(spark, ("ufcstats", "u", *a), ("sherdog", "s", *b))).where("source = 'sherdog'").first()
    assert (got.link_method, got.confidence) == (method, confidence)
    assert got.canonical_fighter_id == ("sherdog:s" if method == "source_self" else "ufcstats:u")


def overrides(spark, *decisions):
    rows = [("sherdog", i, "ufcstats", t, d, "", "t", "t") for i, t, d in decisions]
    return spark.createDataFrame(rows, STAGING["fighter_identity_manual_overrides"])


def test_overrides_and_rejection_never_falls_through(spark):
    people = fighters(spark, ("ufcstats", "u", "Ann Lee", day(1)), ("ufcstats", "v", "Bo Xu", day(2)), ("sherdog", "s", "Ann Lee", day(1)), ("sherdog", "t", "Cy Oz", None))
    raw = overrides(spark, ("s", "u", "Rejected"), ("t", "v", "approved"), ("t", None, "approved"), ("x", "u", "nonsense"))
    normal = identity.normalize_overrides(raw)
    assert normal.count() == 2
    got = {r.source_fighter_id: (r.canonical_fighter_id, r.link_method) for r in identity.link(people, normal).where("source = 'sherdog'").collect()}
    assert got == {"s": ("sherdog:s", "source_self"), "t": ("ufcstats:v", "manual_override")}


@pytest.mark.parametrize("bad", [[("s", "u", "approved"), ("s", "v", "approved")], [("s", "u", "approved"), ("s", None, "accepted_unresolved")], [("s", "zz", "approved")]])
def test_contradicting_overrides_raise(spark, bad):
    known = spark.createDataFrame([("u",), ("v",)], "source_fighter_id string")
    with pytest.raises(identity.OverrideError):
        identity.check_overrides(identity.normalize_overrides(overrides(spark, *bad)), known)


def test_canonical_fighter_takes_first_known_value(spark):
    people = fighters(spark, ("ufcstats", "u", None, day(1)), ("sherdog", "s", "Ann", day(2)))
    links = spark.createDataFrame([("ufcstats", "u", "c"), ("sherdog", "s", "c")], "source string, source_fighter_id string, canonical_fighter_id string")
    got = identity.canonical_fighters(people, links).first()
    assert (got.full_name, got.dob) == ("Ann", day(1))
    with pytest.raises(KeyError):
        identity.resolve(people, links.where("source = 'sherdog'"), "source_fighter_id", "x", strict=True)


def test_text_functions(spark):
    cases = [
        (X.height_of(F.lit("5' 11\"")), 71), (X.seconds_of(F.lit("1:30")), 90), (X.seconds_of(F.lit("1:2:3")), None), (X.landed_of(F.lit("20 of 30"), 2), 30), (X.int_of(F.lit("a -1,234 b")), -1234),
        (X.date_of(F.lit("January 01, 2020")), day(1)), (X.date_of(F.lit("Apr 11 2014")), day(11, 4, 2014)), (X.date_of(F.lit("soon")), None), (X.name_key(F.lit("B. J. P. Penn X")), "bjp penn x"), (X.name_key(F.lit("Mr A 1 B")), "mr a 1 b"),
        (X.cleaned_name_key(F.lit('Al "Big" Ox Record: 8-1-0')), "al ox"), (X.none_if_blank(F.lit(" -- ")), None), (X.outcome_of(F.lit("Win")), "W"), (X.slug_id(F.lit("/x/ann-lee-12")), "12"), (X.entity_id(F.lit("/fight-details/ab12"), "fight"), "ab12"),
        (X.between(F.lit("Birth Date Jan 1 AGE 3"), "birth date", "age"), "Jan 1"), (X.clean_text(F.lit("  a \n b ")), "a b"), (X.canonical_id(F.lit("s"), F.lit(None).cast("string")), None),
    ]
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]
    assert value(spark, X.name_variants(F.col("n")), n="TJ Ox") == ["TJ Ox", "T.J. Ox", "T J Ox"]


def test_conform_and_empty(spark):
    got = conform(spark.createDataFrame([("x", "7")], "extra string, round string"), STAGING["fights"])
    assert got.columns == [f.name for f in STAGING["fights"]] and got.first()["round"] == 7
    assert empty(spark, STAGING["events"]).count() == 0


def test_audits_notice_corruption(spark, rows):
    clean = history.prior_record(rows)
    assert audit.leakage(clean).first()[0] == 0
    assert audit.leakage(clean.withColumn("prior_fights", F.lit(99))).first()[0] == 6
    assert audit.duplicates(rows.union(rows.limit(1)), ["fight_id", "corner"]).first()[0] == 1
    assert audit.orphans(rows, rows.where("fight_id > 1"), "fight_id").first()[0] == 2
    assert audit.bad_shapes(rows.where("not (fight_id = 2 and corner = 'red')")).first()[0] == 1
    assert audit.schema_mismatches(rows, columns("fight_id string, corner string, more int")) == ["fight_id", "more"]
    missing = audit.missingness(rows.withColumn("x", F.when(F.col("fight_id") > 1, 1)), "t", ["x", "corner"], [], ("x",)).collect()
    assert {(r.column_name, r.missing, r.missing_pct, r.status) for r in missing} == {("x", 2, 33.333, "fail"), ("corner", 0, 0.0, "pass")}
    checks = audit.union_all([audit.check(audit.same_day(rows), "t", "same_day", bad="warn"), audit.check(audit.leakage(clean), "t", "leak")])
    assert audit.tally(audit.standard(checks)).first().asDict() == {"pass": 1, "warn": 1, "fail": 0}


def test_quarantine(spark, rows):
    bad = rows.where("not (fight_id = 3 and corner = 'red')")
    good, out = staging.split_quarantine(bad, staging.shape_reason(bad), "fight_id")
    assert good.count() == 4 and [r.reason for r in out.collect()] == ["invalid_participant_shape"]
    reason = staging.domain_reason(F.col("p"), F.col("t"))
    assert value(spark, reason, p="ONE FC", t="Muay Thai") == "ambiguous_or_non_mma_one_bout" and value(spark, reason, p="UFC", t="Muay Thai") is None


def test_keep_first_and_replace(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "d", 2)], "k int, v string, o int")
    assert {r.v for r in staging.keep_first(df, ["k"], ["o"]).collect()} == {"a", "c"}
    assert {r.v for r in staging.keep_first(df, ["k"], ["o"], last=True).collect()} == {"b", "d"}
    better = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted(r.v for r in staging.replace_rows(df, better, "k").collect()) == ["c", "d", "z"]


def test_orientation(spark):
    rows = [(1, day(1), 9, 2, False, True, "L", "W", 3.0), (2, day(2), 1, 2, False, False, "D", "D", 1.0), (3, day(3), 1, 2, False, False, "F", "F", 1.0), (4, day(4), 1, 2, True, False, "W", "L", 0.0)]
    df = spark.createDataFrame(rows, "fight_id long, event_date date, red_fighter_id long, blue_fighter_id long, red_winner_flag boolean, blue_winner_flag boolean, red_outcome string, blue_outcome string, delta_x double")
    got = dataset.oriented(df, ["delta_x"]).orderBy("fight_id").collect()
    assert [(r.fight_id, r.fighter_a, r.target, r.delta_x) for r in got] == [(1, 2, True, -3.0), (4, 1, True, 0.0)]
    meta = dataset.metadata(df, dataset.oriented(df, ["delta_x"])).first()
    assert (meta.rows_in, meta.excluded_draw_nc, meta.excluded_invalid, meta.rows_kept) == (4, 1, 1, 2)


def test_splits_never_cut_a_date(spark):
    df = spark.createDataFrame([(n, day(n // 2 + 1)) for n in range(20)], "fight_id long, event_date date")
    parts = dataset.temporal_split(df, 0.6, 0.2).groupBy("split").agg(F.count_distinct("event_date").alias("n")).collect()
    assert {r.split: r.n for r in parts} == {"train": 6, "validation": 2, "test": 2}
    folds = dataset.walk_forward(df, 3).groupBy("fold").agg(F.count_distinct("event_date").alias("n")).collect()
    assert {r.fold: r.n for r in folds} == {None: 5, 0: 2, 1: 2, 2: 1}
    with pytest.raises(Exception, match="three dates"):
        dataset.temporal_split(df.where("fight_id < 4")).collect()
    assert dataset.forbidden_features(["delta_age", "delta_winner", "delta_avg_fight_time_sec", "red_x"]) == ["delta_winner", "red_x"]


def test_late_rows_are_counted_by_row(spark):
    df = spark.createDataFrame([(n, day(n // 8 + 1)) for n in range(20)], "fight_id long, event_date date")
    assert sorted(r.fight_id for r in dataset.late_rows(df).where("is_validation").collect()) == [17, 18, 19]


def test_metrics_and_calibration(spark):
    data = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)]
    df = spark.createDataFrame(data, "y int, p double")
    got = evaluate.metrics(df).first()
    assert got.accuracy == 0.75 and math.isclose(got.auc, 3.5 / 4) and math.isclose(got.brier, sum((p - y) ** 2 for y, p in data) / 4)
    assert evaluate.metrics(df.where("y = 1")).first().auc is None
    assert evaluate.ece(df.where("p > 2")).first().ece == 0.0
    assert [r.bin for r in evaluate.calibration_curve(df, 2).orderBy("bin").collect()] == [0, 1]
    x, y = evaluate.isotonic(df)
    assert y == sorted(y) and evaluate.apply_isotonic(df, (x, y)).where("calibrated between 0 and 1").count() == 4
    assert evaluate.platt(df)[0] > 0


def test_store_and_decisions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    name = "fighter_identity_manual_overrides"
    store.create(name, STAGING[name])
    row = {"source": "sherdog", "source_fighter_id": "s", "target_source": "ufcstats", "target_source_fighter_id": "u", "decision": "approved", "note": None}
    service.save_decision(store, row, "t0")
    service.save_decision(store, row | {"note": "again"}, "t1")
    assert [(r.note, r.created_at_utc, r.updated_at_utc) for r in store.read(name).collect()] == [("again", "t0", "t1")]
    with pytest.raises(service.Conflict):
        service.save_decision(store, row | {"target_source_fighter_id": "v"}, "t2")
    with pytest.raises(ValueError):
        service.save_decision(store, row | {"decision": "accepted_unresolved"}, "t2")
    assert store.tables() == [name] and store.counts().first()["rows"] == 1
    assert len(store.delete(name, {"source_fighter_id": "s"})) == 1
    with pytest.raises(KeyError):
        store.delete(name, {"source_fighter_id": "s"})


def test_pages_filters_and_names(spark):
    df = spark.createDataFrame([("1", "Bellator 5%", True), ("2", "bellator x", False), ("3", "UFC", None)], "id string, promotion string, has_anomaly boolean")
    ids = lambda **w: [r.id for r in service.page(df, w, 10, 0, ("id",)).collect()]
    assert ids(promotion="Bellator") == ["1", "2"] and ids(has_anomaly="true") == ["1"] and ids(promotion="5%") == ["1"] and ids(unknown="x", promotion="") == ["1", "2", "3"]
    people = spark.createDataFrame([("a", "Ann Lee", "ufcstats"), ("b", "ann lee", "sherdog"), ("c", "Bo", "sherdog"), ("d", "BO", "sherdog")], "fighter_id string, full_name string, source string")
    assert service.resolve_one("ANN LEE", people, "ufcstats") == "a" and service.resolve_one("c", people, "ufcstats") == "c"
    with pytest.raises(service.Conflict):
        service.resolve_one("bo", people, "ufcstats")
    with pytest.raises(service.NotFound):
        service.resolve_one("nobody", people, "ufcstats")
    assert [r.fighter_id for r in service.search(people, "ann l").collect()] == ["a", "b"]


def test_files(spark, tmp_path):
    (tmp_path / "card.csv").write_text("event_date,fighter_a,fighter_b\n2026-01-01,a,b\n")
    assert files.read_csv(spark, str(tmp_path / "card.csv")).first().event_date == day(1, 1, 2026)
    (tmp_path / "bad.csv").write_text("fighter_a\nx\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "k9.html").write_text("<title>t</title>")
    assert files.read_html_tree(spark, str(tmp_path / "pages")).first().entity_id == "k9"
    assert files.tree_sizes(spark, str(tmp_path / "pages")).first().files == 1
    assert files.read_parquet(spark, str(tmp_path / "none"), STAGING["events"]).count() == 0
    files.append_manifest(spark.createDataFrame([("event", "1")], "entity string, entity_id string"), str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).first().entity_id == "1"


def test_fold_is_a_plain_function():
    pdf = pd.DataFrame({"fight_id": [1], "event_date": [day(1)], "blue": [1], "red": [2], "blue_won": [False], "decided": [False]})
    assert ratings.fold(pdf)["post_elo"].isna().all()


def link(kind, name, number):
    return f"<a href='/{kind}/{name.replace(' ', '-')}-{number}'>{name}</a>"


def test_results_site(spark):
    def row(n, *people, extra=""):
        return f"<tr><td>{n}</td>" + "".join(f"<td>{link('fighter', p, i)} {o}</td>" for p, i, o in people) + f"<td>Submission {extra}</td><td>1</td><td>2:10</td></tr>"

    table = row(2, ("Al Ox", 1, "win"), ("Bo Xu", 2, "loss")) + row(1, ("Cy Oz", 3, "win"), ("Di Ko", 4, "loss")) + row(1, ("Ed Lo", 5, "win"), ("Fi Mo", 6, "loss"))
    pages = spark.createDataFrame([("77", "Some FC", f"<table>{table}</table>"), ("78", "ONE", f"<table>{row(1, ('Al Ox', 1, 'win'), ('Bo Xu', 2, 'loss'), extra='Muay Thai')}</table>")], "entity_id string, promotion string, html string")
    got = html.parse_results(pages).orderBy("fight_id", "fighter_id").collect()
    reasons = {r.fight_id: r.reason for r in got}
    assert reasons == {"77:1": "invalid_participant_shape", "77:2": None, "78:1": "ambiguous_or_non_mma_one_bout"}
    assert [(r.fighter_id, r.opponent_id, r.corner, r.outcome, r["round"], r.time) for r in got if r.fight_id == "77:2"] == [("1", "2", "red", "W", 1, "2:10"), ("2", "1", "blue", "L", 1, "2:10")]
    main = f"<h3>{link('fighter', 'Al Ox', 1)}</h3><p>win</p><h3>{link('fighter', 'Bo Xu', 2)}</h3><p>loss</p>"
    assert {r["fight_id"] for r in html.result_bouts(main, "9", "X")} == {"9:1"}
    events, older = html.organisation_events(f"<tr><td>Apr<br>11<br>2014</td><td>{link('events', 'Night One', 5)}</td><td>Here</td></tr><a href='/x/2'>Older Events</a>")
    assert [(e["event_id"], e["event_date_text"]) for e in events] == [("5", "Apr 11, 2014")] and older == "/x/2"
    bio = html.result_fighter("<h1>Al Ox</h1><p>Birthdate Jan 1, 1990 / AGE: 30</p><p>Height 5'11\" / 180 cm</p><p>Weight 170 lbs</p>", "1")
    assert (bio["full_name"], bio["height_text"], bio["weight_text"], bio["dob_text"]) == ("Al Ox", "5'11", "170", "Jan 1, 1990")
    assert html.exact_candidates(link("fighter", "AL OX", 1) + link("fighter", "Al Oxx", 2), "Al Ox") == [("1", "AL OX")]
