"""Pages of the results site as a tree: events with their bouts, and fighters' profiles, merged to the source tables.

Each page is read once by a Python UDTF. An event page gives the event, its good bouts with two sides, a stub of each fighter it
names, and the bouts that are quarantined. Tables are then merged by ranks, each in one aggregation: of events and bouts of one
id the last page wins, of sides the first, and a profile replaces stubs if it has a birth date; without one it only stands in
where there is no stub.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.operators.staging import merged, past
from boutframe.schemas import STAGING
from boutframe.session import materialize, ship
from boutframe.sources.bout_pages import BrokenPage, inches, whole
from boutframe.sources.html import OTHER_RULES, result_bouts
from boutframe.sources.tree import Node, parsed, squeezed

#: The source's name and site, its ids, dates, words for outcomes and the places of a result row's cells.
SOURCE, SITE = "sherdog", "https://www.sherdog.com"
FIGHTER = re.compile(r"/fighter/(?:[^/#?]+-)?(\d+)")
DATE = re.compile(r"\b([A-Z][a-z]{2,8}\s+\d{1,2},\s+\d{4})\b")
RESULTS = {"win": "W", "loss": "L", "draw": "D", "nc": "NC", "no contest": "NC"}
NUMBER, LEFT, WEIGHT, RIGHT, METHOD, ROUND, TIME = range(7)


def day(text: str) -> date:
    plain = squeezed(text.replace(",", ""))
    for form in ("%b %d %Y", "%B %d %Y"):
        try:
            return datetime.strptime(plain, form).date()
        except ValueError:
            continue
    raise BrokenPage(f"not a date: {plain}")


def canonical_url(page: Node) -> str | None:
    """The address that a page gives as its own."""
    for node, name in ((page.first("link", where=lambda n: n.attrs.get("rel") == "canonical"), "href"), (page.first("meta", where=lambda n: n.attrs.get("property") == "og:url"), "content")):
        if node is not None and node.attrs.get(name):
            return urljoin(SITE, node.attrs[name])
    return None


def place_after(text: str, when: str) -> str | None:
    """What follows the date, up to the first bout's names and records."""
    rest = re.sub(r"^Image:\s*[^ ]+\s*", "", text.split(when, 1)[-1]).strip()
    return squeezed(re.split(r"\b[A-Z][a-z]+ [A-Z][a-z]+ \d+-\d+-\d+\b", rest, maxsplit=1)[0]) or None


def event_record(page: Node, event_id: str, promotion: str | None = None) -> dict:
    detail = page.first(where=lambda n: n.has("event_detail")) or page
    heading, of, text = detail.first("h1", "h2"), detail.links("/organizations/"), detail.text
    when, name, promotion = DATE.search(text), heading.text if heading else "", (of[0].text if of else "") or promotion
    if not name or not promotion or not when:
        raise BrokenPage("event without a name, a promotion or a date")
    return {
        "source": SOURCE, "promotion": promotion, "source_event_id": event_id, "name": name, "event_date": day(when[1]),
        "location": place_after(text, when[1]), "url": canonical_url(page) or f"{SITE}/events/{event_id}",
    }


def table_bouts(page: Node) -> list[dict]:
    """Bouts of the results table: the sides as ``(id, name, url, outcome)``, and what stands in the other cells."""
    table, out = page.first("table", where=lambda n: n.has("new_table") and n.has("result")), []
    for row in table.all("tr", where=lambda n: not n.has("table_head")) if table else []:
        cells = row.all("td")
        links = [(cells[k].links("/fighter/") or [None])[0] for k in (LEFT, RIGHT)] if len(cells) > TIME else [None]
        if not all(links):
            continue
        marks = [cells[k].first(where=lambda n: n.has("final_result")) for k in (LEFT, RIGHT)]
        sides = []
        for link, mark in zip(links, marks, strict=True):
            url = urljoin(SITE, link.attrs["href"])
            if not (own := FIGHTER.search(url)):
                raise BrokenPage(f"no fighter id in {url}")
            sides.append((own[1], link.text, url, RESULTS.get(mark.text.lower()) if mark else None))
        bold, small, weight = cells[METHOD].first("b"), cells[METHOD].first(where=lambda n: n.has("sub_line")), cells[WEIGHT].first(where=lambda n: n.has("weight_class"))
        out.append({
            "number": cells[NUMBER].text, "sides": sides, "weight_class": (weight or cells[WEIGHT]).text or None, "method": (bold.text if bold else "") or cells[METHOD].text,
            "referee": (small.text if small else "") or None, "round": cells[ROUND].text, "time": cells[TIME].text,
        })
    return out


def main_event(html: str, event: dict) -> list[dict]:
    """The bout above the table, for pages without one."""
    rows = [r for r in result_bouts(html, event["source_event_id"], event["promotion"]) if r["corner"]]
    if len(rows) != 2:
        return []
    sides = [(r["fighter_id"], r["full_name"], f"{SITE}/fighter/{r['fighter_id']}", r["outcome"]) for r in sorted(rows, key=lambda r: r["corner"], reverse=True)]
    one = rows[0]
    return [{"number": str(one["match_number"]), "sides": sides, "weight_class": None, "method": one["method"], "referee": None, "round": str(one["round"] or ""), "time": one["time"]}]


def bout_records(bout: dict, event: dict) -> tuple[dict, list[dict], list[dict], str | None]:
    """Fight, sides, stubs and what is wrong with the bout, if anything."""
    own = {"source": SOURCE, "promotion": event["promotion"], "source_fight_id": f"{event['source_event_id']}:{bout['number']}", "source_event_id": event["source_event_id"]}
    winner = next((who for who, _, _, outcome in bout["sides"] if outcome == "W"), None)
    fight = own | {k: bout[k] for k in ("weight_class", "method", "time", "referee")} | {"winner_source_fighter_id": winner, "round": int(bout["round"]), "url": f"{event['url']}#match-{bout['number']}"}
    sides = [
        own | {"source_fighter_id": who, "opponent_source_fighter_id": bout["sides"][1 - k][0], "corner": ("red", "blue")[k], "full_name": name, "winner_flag": winner == who, "outcome": outcome}
        for k, (who, name, _, outcome) in enumerate(bout["sides"])
    ]
    stubs = [{"source": SOURCE, "source_fighter_id": who, "full_name": name, "url": url} for who, name, url, _ in bout["sides"]]
    words = " ".join([bout["weight_class"] or "", bout["method"], *(s["full_name"] for s in sides)]).lower()
    other = "one" in event["promotion"].lower() and any(rule in words for rule in OTHER_RULES)
    return fight, sides, stubs, "ambiguous_or_non_mma_one_bout" if other else None


def profile(html: str, fighter_id: str) -> dict:
    """A fighter's own page: the name from its title, the rest between labels."""
    page = parsed(html)
    title = page.first("title")
    name = re.sub(r"\s+MMA Stats.*$", "", title.text if title else "").strip()
    if not name:
        line = page.first(where=lambda n: n.has("fn")) or page.first("h1")
        name = line.text if line else ""
    if not name:
        raise BrokenPage(f"fighter {fighter_id} without a name")
    data = page.first(where=lambda n: n.has("fighter-data"))
    text = data.text if data else ""
    between = lambda left, right: (re.search(rf"{left}\s+(.+?)\s+{right}\b", text, re.IGNORECASE) or [None, None])[1]
    born = DATE.search(text)
    return {
        "source": SOURCE, "source_fighter_id": fighter_id, "full_name": name, "height_in": inches(between("HEIGHT", "WEIGHT")), "weight_lbs": whole(between("WEIGHT", "ASSOCIATION")),
        "reach_in": None, "stance": between("STYLE", "Wins"), "dob": day(born[1]) if born else None, "url": f"{SITE}/fighter/{fighter_id}",
    }


_TABLES = {"event": "source_events", "fight": "source_fights", "side": "source_fight_participants", "stub": "source_fighters", "profile": "source_fighters", "fault": "parse_quarantine"}
_FIELDS = {part: [f"{f.name} {f.dataType.simpleString()}" for f in STAGING[table]] for part, table in _TABLES.items()}
_PARSED = ", ".join(f"{part} struct<{','.join(f.replace(' ', ':') for f in fields)}>" for part, fields in _FIELDS.items())


class ResultRows:
    """UDTF of ``(kind, entity_id, promotion, html)``: a row for each record of a page, in the column of its table."""

    def eval(self, kind: str, entity_id: str, promotion: str, html: str):
        try:
            if kind == "events":
                yield from self.event(entity_id, promotion, html)
            elif kind == "fighters":
                yield self.row(profile=profile(html, (FIGHTER.search(f"/fighter/{entity_id}") or [None, entity_id])[1]))
        except BrokenPage as fault:
            yield self.fault(kind[:-1], entity_id, promotion, str(fault), None)

    def event(self, entity_id, promotion, html):
        page = parsed(html)
        event = event_record(page, entity_id, promotion)
        yield self.row(event=event)
        fights, sides, reasons = {}, {}, {}
        for bout in table_bouts(page) or main_event(html, event):
            if not bout["method"] or not bout["time"] or not bout["round"].isdigit():
                continue
            fight, both, stubs, reason = bout_records(bout, event)
            own = fight["source_fight_id"]
            if fights.setdefault(own, fight) is fight:
                reasons[own] = reason
            for side in both:
                sides.setdefault(own, {}).setdefault((side["source_fighter_id"], side["corner"]), side)
            yield from (self.row(stub=stub) for stub in stubs)
        for own, fight in fights.items():
            if sorted(s["corner"] for s in sides[own].values()) != ["blue", "red"]:
                reasons[own] = "invalid_participant_shape"
            if reasons[own]:
                yield self.fault("fight", own, event["promotion"], reasons[own], fight["url"])
                continue
            yield self.row(fight=fight)
            yield from (self.row(side=side) for side in sides[own].values())

    def fault(self, kind, own, promotion, reason, url):
        return self.row(fault={"source": SOURCE, "entity_type": kind, "source_entity_id": own, "promotion": promotion, "reason": reason, "url": url})

    @staticmethod
    def row(**parts):
        return tuple(tuple(parts[part].get(f.split()[0]) for f in _FIELDS[part]) if part in parts else None for part in _TABLES)


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages ``kind, entity_id, promotion, html`` to ``kind, entity_id`` and a column for each table, of which a row fills one."""
    ship(pages.sparkSession)
    columns = ("kind", "entity_id", "promotion", "html")
    return pages.select(*columns).lateralJoin(F.udtf(ResultRows, returnType=_PARSED)(*[F.col(c).outer() for c in columns])).drop("html", "promotion")


def parse_all(pages: DataFrame, today) -> dict[str, DataFrame]:
    """The source tables of a tree of pages; events after ``today`` are left out with all that they name."""
    found = materialize(read_pages(pages), "pages")
    future = found.where(F.col("event").isNotNull() & ~F.coalesce(F.col("event.event_date") <= F.lit(today).cast("date"), F.lit(True))).select("kind", "entity_id")
    found = found.join(future, ["kind", "entity_id"], "left_anti")
    part = lambda name: found.where(F.col(name).isNotNull()).select(f"{name}.*", F.col("entity_id").alias("page"))
    return merge_sources(part("event"), part("fight"), part("side"), part("stub"), part("profile"), today) | {"parse_quarantine": part("fault").drop("page")}


def merge_sources(events: DataFrame, fights: DataFrame, sides: DataFrame, stubs: DataFrame, profiles: DataFrame, today) -> dict[str, DataFrame]:
    """The precedence of the source tables; each frame has the columns of its table and ``page``, in whose order pages count."""
    in_order = lambda df, table: df.select(*STAGING[table].fieldNames())
    ranked = [df.withColumn("rank", F.struct(rank.alias("rank"), F.col("page"))) for df, rank in ((stubs, F.lit(1)), (profiles, F.when(F.col("dob").isNotNull(), 2).otherwise(0)))]
    first = sides.withColumn("place", F.struct("source", "source_fight_id", "source_fighter_id", "corner"))
    return {
        "source_events": in_order(merged(past(events, today), ["source_event_id"], F.col("page")), "source_events"),
        "source_fights": in_order(merged(fights, ["source_fight_id"], F.col("page")), "source_fights"),
        "source_fight_participants": in_order(first.groupBy("place").agg(F.min_by(F.struct(*sides.columns), F.col("page")).alias("first")).select("first.*"), "source_fight_participants"),
        "source_fighters": in_order(merged(ranked[0].unionByName(ranked[1], allowMissingColumns=True), ["source_fighter_id"], F.col("rank")), "source_fighters"),
    }
