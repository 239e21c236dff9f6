"""Parsers of both sites over whole trees of pages: layouts, fallbacks, faults, precedence."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from boutframe.operators import staging
from boutframe.sources import bout_pages, result_pages
from boutframe.sources.tree import parsed

TODAY = "2021-06-01"
HEAD = "<h2 class='b-content__title'>EVENT DETAILS Night 1</h2><ul class='b-list__box-list'><li>DATE: January 02, 2021</li><li>LOCATION: Hall, Town ATTENDANCE: 5</li></ul>"
PAIR = "<td><a href='/fighter-details/r1'>Red Ox</a><a href='http://ufcstats.com/fighter-details/b1'>Blue Elk</a></td>"


def row(cells, own="f1", attrs="", status="<p>win</p><p>loss</p>"):
    return f"<tr {attrs}><td>{status}</td>{PAIR}{cells}<td><a href='https://ufcstats.com/fight-details/{own}'>view</a></td></tr>"


def first_fight(cells, **kwargs):
    return bout_pages.event_fight(bout_pages.fight_rows(parsed(f"<table>{row(cells, **kwargs)}</table>"))[0], "e1")


WIDE = "<td></td>" * 5 + "<td>{}</td><td>{}</td><td>{}</td>"


@pytest.mark.parametrize(
    ("cells", "values", "by"),
    [
        (WIDE.format("KO/TKO", "2", "4:10"), ("KO/TKO", 2, "4:10"), ("position",) * 3),
        (WIDE.format("--", "2", "4:10"), None, None),  # no neighbour says anything, nor does a cell look like a method
        ("<td>METHOD: Submission ROUND: 3 TIME: 0:59</td>", ("Submission", 3, "0:59"), ("label", "label", "pattern")),
        ("<td>U-DEC</td><td>3</td><td>5:00</td>", ("U-DEC", 3, "5:00"), ("neighbour", "pattern", "pattern")),
        ("<td></td><td>U-DEC</td><td>3</td><td>5:00</td>", ("U-DEC", 3, "5:00"), ("look",) * 3),  # the neighbour is blank
        ("<td></td><td>Won on points</td><td>3</td><td>5:00</td>", None, None),
    ],
)
def test_fields_of_event_rows_by_their_layout(cells, values, by):
    if values is None:
        with pytest.raises(bout_pages.BrokenPage, match="method, round or time"):
            first_fight(cells)
        return
    fight, sides = first_fight(cells)
    assert (fight["method"], fight["round"], fight["time"]) == values and tuple(fight[f"{f}_by"] for f in ("method", "round", "time")) == by
    assert (fight["fight_id"], fight["winner_id"], fight["url"]) == ("f1", "r1", "http://www.ufcstats.com/fight-details/f1")
    assert [(s["fighter_id"], s["opponent_id"], s["corner"], s["full_name"], s["winner_flag"], s["outcome"]) for s in sides] == [("r1", "b1", "red", "Red Ox", True, "W"), ("b1", "r1", "blue", "Blue Elk", False, "L")]


@pytest.mark.parametrize(
    ("status", "winner", "outcomes", "flags"),
    [("<p>L</p><p>W</p>", "b1", ("L", "W"), (False, True)), ("draw draw", None, ("D", "D"), (False, False)), ("nc nc", None, ("NC", "NC"), (False, False)), ("win", None, ("W", None), (False, False)), ("win win", None, ("W", "W"), (False, False))],
)
def test_winners_need_a_win_and_a_loss(status, winner, outcomes, flags):
    fight, sides = first_fight("<td>KO</td><td>1</td><td>1:00</td>", status=status)
    assert fight["winner_id"] == winner and tuple(s["outcome"] for s in sides) == outcomes and tuple(s["winner_flag"] for s in sides) == flags


def test_rows_of_fights_to_come_and_broken_rows():
    assert first_fight("", status="") is None
    with pytest.raises(bout_pages.BrokenPage, match="without two fighters"):
        bout_pages.event_fight(parsed("<table><tr data-link='/fight-details/f1'><td>win</td></tr></table>").first("tr"), "e1")
    with pytest.raises(bout_pages.BrokenPage, match="no number"):
        first_fight(WIDE.format("KO", "two", "4:10"))
    marked = parsed(f"<table>{row('<td>KO</td><td>1</td><td>1:00</td>')}{row('', own='f2', attrs='data-link=/fight-details/f2')}</table>")
    assert [r.attrs.get("data-link") for r in bout_pages.fight_rows(marked)] == ["/fight-details/f2"]  # marked rows only, where there are any


FIGHT_PAGE = """<div><i class='b-fight-details__person-status'>{0}</i><a href='/fighter-details/r1'>Red Ox</a></div><div><i data-status='x'>{1}</i><a href='/fighter-details/b1'>Blue Elk</a></div>
<table><thead><tr><th>KD</th><th>SIG. STR.</th><th>Sig. str. %</th><th>TOTAL STR.</th><th>TD</th><th>SUB. ATT</th><th>REV.</th><th>CTRL</th></tr></thead><tbody>
<tr><td><p>1</p><p>0</p></td><td><p>20 of 30</p><p>10 of 25</p></td><td><p>66</p><p>40</p></td><td><p>40 of 55</p><p>30 of 60</p></td><td><p>2 of 3</p><p>1 of 4</p></td><td><p>1</p><p>--</p></td><td><p>0</p><p>0</p></td><td><p>1:30</p><p>--</p></td></tr>
<tr><td><p>9</p><p>9</p></td></tr></tbody></table>"""


@pytest.mark.parametrize(("statuses", "want"), [(("W", "L"), [(True, "W"), (False, "L")]), (("D", "D"), [(False, "D"), (False, "D")]), (("NC", "NC"), [(False, "NC"), (False, "NC")]), (("W", "?"), [(False, None), (False, None)]), (("W", "W"), [(True, "W"), (True, "W")])])
def test_statuses_of_fight_pages(statuses, want):
    sides, stats = bout_pages.fight_page(FIGHT_PAGE.format(*statuses), "f1")
    assert [(s["winner_flag"], s["outcome"]) for s in sides] == want
    assert [(s["kd"], s["sig_str_landed"], s["total_str_attempted"], s["td_attempted"], s["sub_att"], s["rev"], s["ctrl_sec"]) for s in stats] == [(1, 20, 55, 3, 1, 0, 90), (0, 10, 60, 4, None, 0, None)]


def test_index_and_fighter_pages():
    events = bout_pages.index_events("<table><tr><td><a href='/event-details/a1'>Night</a> January 01, 2020</td><td>x</td><td>Hall</td></tr><tr><td><a href='/event-details/a2'>Soon</a></td></tr><tr><td><a href='/event-details/a3'>Two</a> March 05, 2020</td><td>y</td></tr><tr><td><a href='https://ufcstats.com/event-details/a1'>Again</a> May 01, 2020</td></tr></table>")
    assert [(e["event_id"], e["name"], e["event_date"], e["location"], e["url"]) for e in events] == [("a1", "Night", date(2020, 1, 1), "Hall", "http://www.ufcstats.com/event-details/a1"), ("a3", "Two", date(2020, 3, 5), None, "http://www.ufcstats.com/event-details/a3")]
    plain = bout_pages.fighter_record("<h2 class='b-content__title'>Ann Lee Record: 8-1-0</h2><li>Height: 5' 11\"</li><li>Reach: --</li><li>DOB: Jan 01, 1990</li><li>Age: 3</li>", "r1")
    assert (plain["full_name"], plain["height_in"], plain["reach_in"], plain["dob"], plain["stance"]) == ("Ann Lee", 71, None, date(1990, 1, 1), None)
    boxed = bout_pages.fighter_record("<h2><span class='b-content__title-highlight'>Ann</span><span class='b-content__title-highlight'>Li</span></h2><li><i class='b-list__box-item-title'>Weight:</i> 170 lbs.</li><li><i class='b-list__box-item-title'>STANCE:</i> Orthodox</li>", "r1")
    assert (boxed["full_name"], boxed["weight_lbs"], boxed["stance"], boxed["dob"]) == ("Ann Li", 170, "Orthodox", None)
    with pytest.raises(bout_pages.BrokenPage):
        bout_pages.fighter_record("", "r1")


def test_a_tree_of_pages(spark):
    good = "<td>KO</td><td>1</td><td>1:00</td>"
    pages = [
        ("events", "e1", HEAD + f"<table>{row(good)}{row(good, own='f2')}{row('<td></td>', own='f3')}</table>"), ("events", "e2", HEAD.replace("2021", "2031") + f"<table>{row(good, own='f4')}</table>"),
        ("events", "e3", HEAD.replace("January 02", "June 01") + f"<table>{row(good, own='f2')}</table>"), ("events", "e4", "<p>nothing"), ("events", "e5", None),
        ("fights", "f1", FIGHT_PAGE.format("NC", "NC")), ("fights", "f4", FIGHT_PAGE.format("W", "L")), ("fights", "f2", "<a href='/fighter-details/r1'>Red Ox</a>"), ("fights", "f9", ""),
        ("fighters", "r1", "<h2 class='b-content__title'>Red Ox</h2><li>DOB: Foo 41, 1990</li>"), ("fighters", "b1", "<h2>Blue Elk</h2>"), ("other", "x", "<p>"), (None, None, None),
    ]
    got = bout_pages.parse_all(spark.createDataFrame(pages, "kind string, entity_id string, html string").repartition(4), TODAY)
    take = lambda name, *columns: sorted(tuple(r[c] for c in columns) for r in got[name].collect())
    assert take("events", "event_id", "location") == [("e1", "Hall, Town"), ("e3", "Hall, Town")]  # today counts, later days don't
    assert take("fights", "fight_id", "event_id") == [("f1", "e1"), ("f2", "e1"), ("f2", "e3")]
    assert [(f, e, o) for f, e, c, o in take("fight_participants", "fight_id", "event_id", "corner", "outcome") if c == "red"] == [("f1", "e1", "NC"), ("f2", "e1", "W"), ("f2", "e3", "W")]
    assert take("fighter_fight_stats", "fight_id", "event_id", "corner") == [("f1", "e1", "blue"), ("f1", "e1", "red")]
    assert take("fighters", "fighter_id") == [("b1",)]
    assert take("quarantine", "kind", "entity_id", "reason") == [
        ("events", "e1", "fight f3 without a method, round or time"), ("events", "e4", "event without a name or a date"), ("events", "e5", "event without a name or a date"),
        ("fighters", "r1", "not a date: Foo 41, 1990"), ("fights", "f2", "fight f2 without two fighters"),
    ]
    none = bout_pages.parse_all(spark.createDataFrame([], "kind string, entity_id string, html string"), TODAY)
    assert all(df.count() == 0 for df in none.values())


def bout(number, left, right, method="<b>KO</b><span class='sub_line'>Ref A</span>", marks=("win", "loss"), weight="Light"):
    side = lambda who, mark: f"<td><a href='/fighter/{who}'>{who.rpartition('-')[0]}</a><span class='final_result'>{mark}</span></td>"
    return f"<tr><td>{number}</td>{side(left, marks[0])}<td><span class='weight_class'>{weight}</span></td>{side(right, marks[1])}<td>{method}</td><td>2</td><td>3:12</td></tr>"


def results(rows, name="Night", promotion="Arena", when="Mar 5, 2021", link="<link rel='canonical' href='/events/Night-7'>"):
    return f"{link}<div class='event_detail'><h1>{name}</h1><a href='/organizations/A-1'>{promotion}</a> {when} Hall, Town</div><table class='new_table result'><tr class='table_head'><td>x</td></tr>{rows}</table>"


def test_a_tree_of_result_pages(spark):
    pages = [
        ("events", "7", results(bout(2, "Al-1", "Bo-2") + bout(2, "Al-1", "Bo-2") + bout(1, "Cy-3", "Di-4", marks=("draw", "draw")) + bout(3, "Al-1", "Al-1"))),
        ("events", "8", results(bout(1, "Ally-1", "Ed-5", weight="Kickboxing"), promotion="ONE Arena", link="<meta property='og:url' content='https://www.sherdog.com/events/N-8'>")),
        ("events", "9", results(bout(1, "Late-9", "Ed-5"), when="Mar 5, 2031")), ("events", "6", "<h1>x</h1>"),
        ("fighters", "Al-One-1", "<title>Al One MMA Stats, Pictures</title><div class='fighter-data'>AGE 30 / Jan 1, 1990 HEIGHT 5'11\" / 180 cm WEIGHT 170 lbs ASSOCIATION Gym STYLE Boxing Wins 3</div>"),
        ("fighters", "Bo-2", "<title>Bo Two MMA Stats</title>"), ("fighters", "New-77", "<title></title><h1 class='fn'>New One</h1>"), ("fighters", "None-78", ""),
    ]
    frame = spark.createDataFrame([(k, i, None, h) for k, i, h in pages], "kind string, entity_id string, promotion string, html string").repartition(3)
    got = result_pages.parse_all(frame, TODAY)
    take = lambda name, *columns: sorted((tuple(r[c] for c in columns) for r in got[name].collect()), key=str)
    assert take("source_events", "source_event_id", "location", "url") == [("7", "Hall, Town", "https://www.sherdog.com/events/Night-7"), ("8", "Hall, Town", "https://www.sherdog.com/events/N-8")]
    assert take("source_fights", "source_fight_id", "winner_source_fighter_id", "method", "referee", "weight_class", "round") == [("7:1", None, "KO", "Ref A", "Light", 2), ("7:2", "1", "KO", "Ref A", "Light", 2), ("7:3", "1", "KO", "Ref A", "Light", 2)]
    assert len(take("source_fight_participants", "source_fight_id", "corner")) == 6
    people = {r.source_fighter_id: r for r in got["source_fighters"].collect()}
    assert {k: r.full_name for k, r in people.items()} == {"1": "Al One", "2": "Bo", "3": "Cy", "4": "Di", "5": "Ed", "77": "New One"}
    assert (people["1"].height_in, people["1"].weight_lbs, people["1"].stance, people["1"].dob) == (71, 170, "Boxing", date(1990, 1, 1))
    assert take("parse_quarantine", "entity_type", "source_entity_id", "reason", "url") == [
        ("event", "6", "event without a name, a promotion or a date", None), ("fight", "8:1", "ambiguous_or_non_mma_one_bout", "https://www.sherdog.com/events/N-8#match-1"), ("fighter", "None-78", "fighter 78 without a name", None),
    ]


def test_precedence_of_merged_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), (None, 1, "z"), (None, 2, "w")], "k string, n int, v string")
    assert sorted((r.k or "", r.n, r.v) for r in staging.merged(df, ["k"], F.col("n")).collect()) == [("", 2, "w"), ("a", 3, None)]
    days = spark.createDataFrame([(date(2021, 1, 1),), (date(2021, 1, 2),), (date(2021, 1, 3),), (None,)], "event_date date")
    assert sorted(str(r[0]) for r in staging.past(days, "2021-01-02").collect()) == ["2021-01-01", "2021-01-02", "None"]
