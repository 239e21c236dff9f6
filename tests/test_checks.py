"""The registry of checks, the fight view, and the parts of the review service that join and search."""

import re
from datetime import date

from pyspark.sql import functions as F

from boutframe.operators import checks, identity, service, trigrams
from boutframe.schemas import STAGING, empty


def found(df):
    return {(r.table_name, r.check_name, r.details if r.check_name.startswith("required") else ""): (r.status, r.metric_value) for r in df.collect()}


def test_every_check_of_small_tables(spark):
    events = spark.createDataFrame([("e1", "a", "x", "p", "Night", date(2020, 1, 1)), ("e1", "a", "x", "p", None, None), ("e2", None, "y", "q", "N", date(2020, 1, 2)), (None, "a", "z", "p", "N", None)], "event_id string, source string, source_event_id string, promotion string, name string, event_date date")
    fights = spark.createDataFrame([("f1", "e1"), ("f2", "e9"), ("f3", None), ("f3", "e2")], "fight_id string, event_id string").withColumns({"method": F.lit("KO"), "round": F.lit(1), "time": F.lit("1:00"), "source": F.lit("a"), "promotion": F.lit("p")})
    sides = spark.createDataFrame([("f1", "r", "b", "red"), ("f1", "b", "r", "blue"), ("f2", "r", "b", "red"), ("f2", "r", "b", "red"), ("f8", "zz", None, "blue"), (None, "b", "r", "red")], "fight_id string, fighter_id string, opponent_id string, corner string").withColumns({"full_name": F.lit("n"), "a": F.lit(1), "n": F.lit(2), "key": F.lit(3)})
    tables = {"events": events, "fights": fights, "fight_participants": sides, "fighters": spark.createDataFrame([("r", "R"), ("b", "B")], "fighter_id string, full_name string"), "parse_quarantine": empty(spark, STAGING["parse_quarantine"])}
    got = found(checks.run(tables))
    assert got["events", "unique_event_id", ""] == ("fail", 1) and got["fights", "unique_fight_id", ""] == ("fail", 1) and got["fight_participants", "unique_fight_id_fighter_id", ""] == ("fail", 1) and got["fighters", "unique_fighter_id", ""] == ("pass", 0)
    assert got["fights", "fight_event_fk", ""] == ("fail", 2) and got["fight_participants", "participant_fight_fk", ""] == ("fail", 2) and got["fight_participants", "participant_fighter_fk", ""] == ("fail", 1)
    assert got["fight_participants", "fight_corner_shape", ""] == ("fail", 3) and got["parse_quarantine", "quarantined_rows", ""] == ("pass", 0) and got["parse_quarantine", "schema_types_match", ""] == ("pass", 0)
    assert got["events", "required_name_not_null", "source=a promotion=p"] == ("fail", 1) and got["events", "required_name_not_null", "source= promotion=q"] == ("pass", 0) and got["events", "required_event_id_not_null", "source=a promotion=p"] == ("fail", 1)
    assert got["fighters", "required_full_name_not_null", "source=all promotion=all"] == ("pass", 0) and not any(t == "source_events" for t, *_ in got)
    more = found(checks.run({"parse_quarantine": spark.createDataFrame([("s",)], "source string"), "analysis_identity_review": spark.createDataFrame([("unresolved",)], "review_status string"), "fighter_identity_links": spark.createDataFrame([("a", "1"), ("a", None), (None, "a1")], "source string, source_fighter_id string")}))
    assert more["parse_quarantine", "quarantined_rows", ""] == ("warn", 1) and more["parse_quarantine", "schema_types_match", ""] == ("fail", 5) and more["fighter_identity_links", "unresolved_sherdog_identities", ""] == ("warn", 1) and more["fighter_identity_links", "unique_source_source_fighter_id", ""] == ("pass", 0)


def test_each_table_is_scanned_once(spark, tmp_path):
    tables = {}
    for name, schema in (("events", "event_id string, source string, source_event_id string, promotion string, name string, event_date date"), ("fights", "fight_id string, event_id string, method string, round int, time string"), ("fight_participants", "fight_id string, fighter_id string, opponent_id string, corner string, full_name string"), ("fighters", "fighter_id string, full_name string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    result = checks.run(tables)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == len(tables) and {s for s, _ in found(result).values()} == {"pass"}
    assert all(v == 0 for _, v in found(result).values()) and ("fights", "fight_event_fk", "") in found(result)


def test_fight_view_flags(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "fight_id int")
    fights = spark.createDataFrame([(1, "e"), (2, "e"), (3, "e"), (4, "none")], "fight_id int, event_id string").withColumn("method", F.lit("KO"))
    events = spark.createDataFrame([("e", "Night", date(2020, 1, 1))], "event_id string, name string, event_date date")
    sides = spark.createDataFrame([(1, "r", "red"), (1, "b", "blue"), (2, "r", "red"), (2, "s", "red")], "fight_id int, fighter_id string, corner string")
    rows = {r.fight_id: r for r in checks.fight_view(fights, events, sides, ids(1, 1), ids(1, 1, 2), ids(1, 2)).collect()}
    assert set(rows) == {1, 2, 3} and not rows[1].has_anomaly and rows[1].anomaly_flags == "" and (rows[1].red_fighter_id, rows[1].stats_row_count, rows[1].event_name) == ("r", 2, "Night")
    assert rows[2].anomaly_flags == "red_count;blue_count;pit_rows;matchup_rows" and rows[3].anomaly_flags == "participant_count;red_count;blue_count" and rows[3].participant_count == 0


def test_match_reasons(spark):
    methods = ["manual_override", "cleaned_name_dob_near", "exact_name_dob", "other", None]
    got = spark.createDataFrame([(m,) for m in methods], "m string").select(identity.match_reason(F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == ["manual override approval", "unique cleaned name + compatible dob (near)", "exact normalized full name + exact dob", None, None]


def test_trigram_search_equals_ilike(spark):
    words = ["", "a", "ab", "Abc", "aBcd", "100% sure", "under_score", "back\\slash", "ÉCOLE étude", "línea\nnueva", "x" * 300 + "needle", None, "Abc"]
    patterns = ["%", "", "_", "__", "%a%", "a%", "%b", "%bc%", "ab_", "%ABC%", "%école%", "%é%", "%\\%%", "%\\_s%", "%\\\\%", "100\\%%", "%needle", "%nope%", "%a%b%c%", "_b%", "%ea%ue%", "%\n%", None, "___%", "%x%dle"]
    names = spark.createDataFrame(list(enumerate(words)), "n int, w string")
    wanted = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = sorted((r.pattern, r.id) for r in trigrams.TrigramIndex.build(names, "n", "w").search(wanted.unionByName(wanted)).collect())
    assert got == sorted((r.pattern, r.n) for r in wanted.crossJoin(names).where(F.expr("w ilike pattern")).collect())
    none = trigrams.TrigramIndex.build(names.where("false"), "n", "w")
    assert none.search(wanted).count() == 0
    plan = trigrams.TrigramIndex.build(names, "n", "w").search(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_suggestions_are_two_joins_without_repeats(spark):
    day = date(1990, 1, 1)
    people = [("ufcstats", "1", "Ann Lee", day), ("ufcstats", "2", 'Ann "Ace" Lee', day), ("ufcstats", "3", "Bo", None), ("sherdog", "a", "Ann Lee", day), ("sherdog", "b", "Bo", None), ("sherdog", "c", 'Ann "X" Lee', day), ("sherdog", "d", None, day), ("ufcstats", "4", None, day)]
    fighters = spark.createDataFrame(people, "source string, source_fighter_id string, full_name string, dob date")
    links = fighters.select("source", "source_fighter_id", F.concat_ws(":", "source", "source_fighter_id").alias("canonical_fighter_id"))
    decided = spark.createDataFrame([("sherdog", "a", "ufcstats", "2", "rejected", None), ("sherdog", "c", "ufcstats", "1", "approved", "sure")], "source string, source_fighter_id string, target_source string, target_source_fighter_id string, decision string, note string")
    seen = spark.createDataFrame([("ufcstats:1", 3)], "fighter_id string, fight_count int")
    found = identity.suggestions(fighters, links, decided, seen)
    rows = sorted((r.source_fighter_id, r.target_source_fighter_id, r.candidate_reason, r.manual_decision, r.fight_count) for r in found.collect())
    assert rows == [("a", "1", "exact_name_dob", None, 3), ("c", "1", "cleaned_name_dob", "approved", 3), ("c", "2", "cleaned_name_dob", None, None)]
    assert [r.target_source_fighter_id for r in identity.ordered_suggestions(found, "c").collect()] == ["2", "1"]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_indexed_search_equals_a_scan(spark):
    people = spark.createDataFrame([("a", "Ann Lee"), ("b", "ann  LEEDS"), ("c", "B.J. Ox"), ("d", "100% \\ Real_Name"), ("e", None), ("f", "Éva")], "fighter_id string, full_name string")
    indexes = service.name_indexes(people)
    for text in ("ann l", "LEE", "bj ox", "b j", "0%", "l_n", "\\", "é", "x", "nobody", "a"):
        assert [r.fighter_id for r in service.search(people, text, 25, *indexes).collect()] == [r.fighter_id for r in service.search(people, text).collect()], text
