"""Trees of pages that Spark writes from the order tables: bouts as pages of the statistics site, to be read back into tables.

Neighbouring bouts make an event; the layout of a bout's row follows its number, and some rows and pages are broken on purpose.
A third of the bouts have a page of their own, whose sides and outcomes replace those of the event's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutframe.plans.bouts import BOUTS, bout_rows

TODAY = "1998-06-01"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _link(own: Column) -> Column:
    return _text('<a href="/fighter-details/', own, '">Fighter S', own, "</a>")


def stat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, entity_id, html``: a page for each 64 bout numbers, dated like the last of them, and pages of bouts."""
    bouts = bout_rows(spark, sf_dir).where("corner = 'blue'")
    n, layout = F.col("fight_id"), F.col("fight_id") % 8
    swapped = F.when(F.col("outcome") == "W", "L").when(F.col("outcome") == "L", "W").otherwise("D")
    marks = F.when(layout == 7, "").otherwise(_text("<p>", F.when(F.col("outcome") == "D", "draw").otherwise(F.col("outcome")), "</p><p>", F.when(F.col("outcome") == "D", "draw").otherwise(swapped), "</p>"))
    names = _text("<td><p>", _link(F.col("fighter_id")), "</p><p>", _link(F.col("opponent_id")), "</p></td>")
    round_, clock = 1 + n % 5, _text(F.floor(F.col("fight_sec").cast("long") % 300 / 60), ":", F.lpad((F.col("fight_sec").cast("long") % 60).cast("string"), 2, "0"))
    view = _text('<td><a href="/fight-details/', n, '">view</a></td>')
    wide = _text('<tr data-link="/fight-details/', n, '"><td>', marks, "</td>", names, "<td>a</td>" * 5, "<td><p>", F.col("method"), "</p></td><td>", round_, "</td><td>", clock, "</td></tr>")
    plain = _text("<tr class='js-fight-details-click'><td>", marks, "</td>", names, "<td>", F.col("method"), "</td><td>", round_, "</td><td>", clock, "</td>", view, "</tr>")
    labelled = _text("<tr class='x js-fight-details-click'><td>", marks, "</td>", names, "<td><p>METHOD: ", F.col("method"), " ROUND: ", round_, " TIME: ", clock, "</p></td>", view, "</tr>")
    broken = _text("<tr class='js-fight-details-click'><td>", marks, "</td>", names, view, "</tr>")
    row = F.when(layout % 4 == 0, wide).when(layout % 4 == 1, labelled).when(layout % 4 == 2, plain).otherwise(broken)
    events = bouts.groupBy(F.floor(n / 64).alias("event")).agg(F.max_by("event_date", "fight_id").alias("day"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fight_id", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    head = _text("<h2 class='b-content__title'>EVENT DETAILS Night ", F.col("event"), "</h2><ul class='b-list__box-list'><li>DATE: ", F.date_format("day", "MMMM dd, yyyy"), "</li><li>LOCATION: Hall ", F.col("event") % 9, "</li></ul>")
    event_pages = events.select(F.lit("events").alias("kind"), F.col("event").cast("string").alias("entity_id"), F.when(F.col("event") % 20 == 7, _text("<h2></h2><table>", F.col("rows"), "</table>")).otherwise(_text(head, "<table>", F.col("rows"), "</table>")).alias("html"))
    status = lambda own: F.when(n % 9 == 0, F.lit("NC")).otherwise(own)
    person = lambda own, mark: _text("<div><i class='b-fight-details__person-status'>", status(mark), "</i>", _link(own), "</div>")
    pair = lambda a, b: _text("<td><p>", a, "</p><p>", b, "</p></td>")
    landed = _text(F.col("td_landed").cast("int"), " of ", F.col("td_attempted").cast("int"))
    totals = _text("<table><thead><tr><th>Fighter</th><th>KD</th><th>Sig. str.</th><th>Td</th><th>Ctrl</th></tr></thead><tbody><tr><td></td>", pair(n % 3, n % 2), pair(landed, F.lit("--")), pair(F.lit("--"), landed), pair(clock, F.lit("0:05")), "</tr></tbody></table>")
    right = _text(person(F.col("fighter_id"), F.col("outcome")), person(F.col("opponent_id"), swapped), totals)
    fight_pages = bouts.where(n % 3 == 0).select(F.lit("fights").alias("kind"), n.cast("string").alias("entity_id"), F.when(n % 15 == 0, person(F.col("fighter_id"), F.col("outcome"))).otherwise(right).alias("html"))
    return event_pages.unionByName(fight_pages)


#: The tables that the pages hold, as DuckDB common table expressions: ``ev`` events, ``f`` bouts of events that are kept, ``known`` those that are read.
PAGES = f"""{BOUTS}, x AS (SELECT *, fight_id // 64 AS event, fight_id % 8 AS layout, CASE outcome WHEN 'W' THEN 'L' WHEN 'L' THEN 'W' ELSE 'D' END AS swapped,
        (fight_sec::BIGINT % 300 // 60) || ':' || lpad((fight_sec::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM b WHERE corner = 'blue'),
    ev AS (SELECT event, arg_max(event_date, fight_id) AS day FROM x GROUP BY event),
    f AS (SELECT x.*, ev.day FROM x JOIN ev USING (event) WHERE ev.day <= DATE '{TODAY}' AND event % 20 <> 7),
    known AS (SELECT *, fight_id::VARCHAR AS own, event::VARCHAR AS of FROM f WHERE layout NOT IN (3, 7))"""
