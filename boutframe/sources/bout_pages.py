"""Pages of the bout statistics site: index, event, fight and fighter pages to rows, and a whole tree of them to tables.

A Python UDTF reads each page once and yields good rows and error rows alike, so a broken page or a broken row of a page ends
up in quarantine with its reason and everything else is kept. A field that pages give in several layouts has a list of
extractors in the order in which they are believed; the first that finds something wins, and its name is kept beside the value.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import lru_cache
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.operators.staging import past, replace_rows
from boutframe.schemas import STAGING
from boutframe.session import materialize, ship
from boutframe.sources.tree import Node, parsed, squeezed

#: The site, the form of its links, dates and labels, its words for outcomes, and the places of cells in a wide row.
SITE = "http://www.ufcstats.com"
LINK = {kind: re.compile(rf"{kind}-details/([A-Za-z0-9]+)") for kind in ("event", "fight", "fighter")}
DATE = re.compile(r"([A-Z][a-z]+ \d{1,2}, \d{4})")
LABELLED = r"{}:\s*([^:]+?)(?=\s+[A-Z][A-Z ]+:|$)"
ROW_OUTCOMES = {"win": "W", "loss": "L", "draw": "D", "nc": "NC", "w": "W", "l": "L"}
STATUSES = ("W", "L", "D", "NC")
WIDE, METHOD_AT, ROUND_AT, TIME_AT = 10, 7, 8, 9
METHOD_WORDS = ("dec", "sub", "ko", "tko")
BIO = ("height", "weight", "reach", "stance", "dob")


class BrokenPage(ValueError):
    """A page or row lacks what it has to have."""


@lru_cache(4096)
def absolute(url: str) -> str:
    for other in ("https://www.ufcstats.com", "https://ufcstats.com"):
        url = urljoin(SITE, url).replace(other, SITE)
    return url


def entity(url: str, kind: str) -> str:
    if not (m := LINK[kind].search(url)):
        raise BrokenPage(f"no {kind} id in {url}")
    return m[1]


def day(text: str) -> date:
    plain = squeezed(text.replace(",", ", "))
    for form in ("%B %d, %Y", "%b %d, %Y"):
        try:
            return datetime.strptime(plain, form).date()
        except ValueError:
            continue
    raise BrokenPage(f"not a date: {plain}")


def whole(text: str | None) -> int | None:
    found = re.search(r"-?\d+", (text or "").replace(",", ""))
    return int(found[0]) if found else None


def seconds(text: str) -> int | None:
    found = re.fullmatch(r"(\d+):(\d{2})", text)
    return 60 * int(found[1]) + int(found[2]) if found else None


def inches(text: str | None) -> int | None:
    found = re.search(r"(\d+)'\s*(\d+)", text or "")
    return 12 * int(found[1]) + int(found[2]) if found else None


def stated(text: str | None) -> str | None:
    """The text, unless it is blank or dashes."""
    return None if squeezed(text) in ("", "--") else squeezed(text)


def fighters_of(node: Node) -> list[tuple[str, str]]:
    """``(id, name)`` of the links to fighters that have a text, each target once."""
    named = {}
    for link in node.links("fighter-details/"):
        if link.text:
            named.setdefault(absolute(link.attrs["href"]), link.text)
    return [(entity(url, "fighter"), name) for url, name in named.items()]


def index_events(html: str) -> list[dict]:
    """Dated events of an index page, each once."""
    out: dict[str, dict] = {}
    page = parsed(html)
    rows = [(link, row) for row in page.all("tr") for link in row.links("event-details/")]
    for link, row in rows:
        url, found = absolute(link.attrs["href"]), DATE.search(row.text)
        own = entity(url, "event")
        if own not in out and found:
            cells = row.all("td")
            out[own] = {"event_id": own, "name": link.text, "event_date": day(found[1]), "location": cells[-1].text if len(cells) > 2 else None, "url": url}
    return list(out.values())


def event_record(page: Node, event_id: str, url: str | None = None) -> dict:
    heading = page.first(where=lambda n: n.has("b-content__title")) or page.first("h1", "h2")
    name = squeezed((heading.text if heading else "").replace("EVENT DETAILS", ""))
    info = (page.first(where=lambda n: n.has("b-list__box-list")) or page).text
    found = re.search(r"DATE:\s*" + DATE.pattern, info, re.IGNORECASE) or DATE.search(info)
    if not name or not found:
        raise BrokenPage("event without a name or a date")
    place = re.search(r"LOCATION:\s*(.+?)(?:ATTENDANCE:|$)", info, re.IGNORECASE)
    return {"event_id": event_id, "name": name, "event_date": day(found[1]), "location": squeezed(place[1]) if place else None, "url": url or f"{SITE}/event-details/{event_id}"}


class FightRow:
    """A row of an event page, and what its layouts say of a field."""

    def __init__(self, row: Node):
        self.cells, self.text, self.names = [c.text for c in row.all("td")], row.text, [name for _, name in fighters_of(row)[:2]]

    def placed(self, at: int) -> str | None:
        return self.cells[at] if len(self.cells) >= WIDE else None

    def labelled(self, label: str) -> str | None:
        found = re.search(LABELLED.format(label), self.text, re.IGNORECASE)
        return squeezed(found[1]) if found else None

    def after_name(self) -> str | None:
        at = next((k for k, cell in enumerate(self.cells[:-1]) if self.names[-1] in cell), None)
        return None if at is None else self.cells[at + 1]

    def seen(self, pattern: str) -> str | None:
        found = re.search(pattern, self.text)
        return found[0] if found else None

    def cell_like(self, test) -> str | None:
        return next((cell for cell in self.cells if test(cell)), None)


#: Extractors by field, the most believed first.
EXTRACTORS = {
    "method": (("position", lambda r: stated(r.placed(METHOD_AT))), ("label", lambda r: r.labelled("METHOD")), ("neighbour", FightRow.after_name)),
    "round": (("position", lambda r: r.placed(ROUND_AT)), ("label", lambda r: r.labelled("ROUND")), ("pattern", lambda r: r.seen(r"\b[1-5]\b"))),
    "time": (("position", lambda r: r.placed(TIME_AT)), ("label", lambda r: r.labelled("TIME")), ("pattern", lambda r: r.seen(r"\b\d{1,2}:\d{2}\b"))),
}
#: Where one of the three fields is missing, all three are read from cells by their look.
LOOKS = {
    "method": lambda r: r.cell_like(lambda c: any(w in c.lower() for w in METHOD_WORDS)),
    "round": lambda r: r.cell_like(lambda c: re.fullmatch("[1-5]", c)), "time": lambda r: r.cell_like(lambda c: re.fullmatch(r"\d{1,2}:\d{2}", c)),
}


def extract(row: FightRow) -> tuple[dict[str, str | None], dict[str, str | None]]:
    """The three fields, and by which extractor each was found."""
    values, by = {}, {}
    for field, ranked in EXTRACTORS.items():
        values[field], by[field] = next(((value, name) for name, find in ranked if (value := find(row))), (None, None))
    if not all(values.values()):
        values = {field: find(row) for field, find in LOOKS.items()}
        by = {field: "look" if value else None for field, value in values.items()}
    return values, by


def _sides(fight_id: str, event_id: str | None, pair: list[tuple[str, str]], outcomes: list[str | None], won: list[bool]) -> list[dict]:
    return [
        {"fight_id": fight_id, "event_id": event_id, "fighter_id": own, "opponent_id": pair[1 - k][0], "corner": ("red", "blue")[k], "full_name": name, "winner_flag": won[k], "outcome": outcomes[k]}
        for k, (own, name) in enumerate(pair)
    ]


def fight_rows(page: Node) -> list[Node]:
    """Rows that carry a fight's link themselves, or else those that hold one."""
    marked = page.all("tr", where=lambda n: "fight-details/" in n.attrs.get("data-link", "") or n.has("js-fight-details-click"))
    return marked or page.all("tr", where=lambda n: bool(n.links("fight-details/") or n.attrs.get("data-fight-id")))


def event_fight(row: Node, event_id: str) -> tuple[dict, list[dict]] | None:
    """A fight and its two sides; None for a fight to come. A winner is named only for outcomes W and L, in this order or the other."""
    held = row.links("fight-details/")
    url = absolute(row.attrs.get("data-link") or (held[0].attrs["href"] if held else ""))
    if "fight-details/" not in url:
        return None
    fight_id, pair = entity(url, "fight"), fighters_of(row)[:2]
    if len(pair) < 2:
        raise BrokenPage(f"fight {fight_id} without two fighters")
    read = FightRow(row)
    outcomes = [ROW_OUTCOMES[t] for t in (read.cells[0] if read.cells else read.text).lower().split() if t in ROW_OUTCOMES]
    values, by = extract(read)
    if not all(values.values()):
        if not outcomes:
            return None
        raise BrokenPage(f"fight {fight_id} without a method, round or time")
    if not re.fullmatch(r"\s*[+-]?\d+\s*", values["round"]):
        raise BrokenPage(f"fight {fight_id} with a round that is no number")
    won = [outcomes[:2] == ["W", "L"], outcomes[:2] == ["L", "W"]]
    winner = next((own for (own, _), w in zip(pair, won, strict=True) if w), None)
    fight = {"fight_id": fight_id, "event_id": event_id, "winner_id": winner, "method": values["method"], "round": int(values["round"]), "time": values["time"], "time_format": None, "referee": None, "url": url}
    return fight | {f"{f}_by": by[f] for f in EXTRACTORS}, _sides(fight_id, event_id, pair, (outcomes + [None, None])[:2], won)


def fight_page(html: str, fight_id: str) -> tuple[list[dict], list[dict]]:
    """Sides with their statuses (the winner is who has W, whatever the other has), and totals, of a fight's own page; events are not named there."""
    page = parsed(html)
    pair = fighters_of(page)[:2]
    if len(pair) < 2:
        raise BrokenPage(f"fight {fight_id} without two fighters")
    statuses = [n.text for n in page.all(where=lambda n: (n.has("b-fight-details__person-status") or "data-status" in n.attrs) and n.text in STATUSES)]
    if len(statuses) < 2:
        statuses = [None, None]
    return _sides(fight_id, None, pair, statuses[:2], [s == "W" for s in statuses[:2]]), _totals(page, fight_id, pair)


def _totals(page: Node, fight_id: str, pair: list[tuple[str, str]]) -> list[dict]:
    """The first row of the first table; a column is the first one whose heading holds its key and that has a value for the side."""
    table = page.first("table")
    body = table and table.first("tbody")
    row = body and body.first("tr")
    if not row:
        return []
    head = table.first("thead")
    names = [re.sub("_+", "_", n.text.lower().replace(" ", "_").replace(".", "")) for n in (head.all("th") if head else [])]
    columns = []
    for k, cell in enumerate(row.all("td")):
        values = [p.text for p in cell.all("p") if p.text]
        columns.append((names[k] if k < len(names) else f"col_{k}", (values if len(values) > 1 else [cell.text] if cell.text else [])[:2]))

    def value(key: str, side: int) -> str:
        return next((values[side] for name, values in columns if key in name and len(values) > side), "")

    def pair_of(key: str, side: int) -> tuple[int | None, int | None]:
        found = re.search(r"(\d+)\s+of\s+(\d+)", value(key, side).lower())
        return (int(found[1]), int(found[2])) if found else (None, None)

    out = []
    for side, (own, _) in enumerate(pair):
        pairs = {key: pair_of(column, side) for key, column in (("sig_str", "sig_str"), ("total_str", "total_str"), ("td", "td"))}
        out.append(
            {"fight_id": fight_id, "event_id": None, "fighter_id": own, "opponent_id": pair[1 - side][0], "corner": ("red", "blue")[side], "ctrl_sec": seconds(value("ctrl", side))}
            | {f"{key}_{what}": x for key, both in pairs.items() for what, x in zip(("landed", "attempted"), both, strict=True)}
            | {name: whole(value(key, side)) for name, key in (("kd", "kd"), ("sub_att", "sub"), ("rev", "rev"))}
        )
    return out


def fighter_record(html: str, fighter_id: str, url: str | None = None) -> dict:
    page = parsed(html)
    parts = page.all(where=lambda n: n.has("b-content__title-highlight"))
    heading = page.first(where=lambda n: n.has("b-content__title")) or page.first("h1", "h2")
    name = squeezed((heading.text if heading else "").replace("FIGHTER DETAILS", ""))
    name = " ".join(p.text for p in parts[:2]) if len(parts) > 1 and all(p.text for p in parts[:2]) else re.sub(r"\s+Record:\s+.+$", "", name, flags=re.IGNORECASE)
    if not name:
        raise BrokenPage(f"fighter {fighter_id} without a name")
    fields = {}
    for item in page.all("li"):
        title = item.first(where=lambda n: n.has("b-list__box-item-title"))
        key, _, value = item.text.partition(":")
        if title is not None:
            key, value = title.text.rstrip(":"), item.text.removeprefix(title.text)
        if key.strip().lower() in BIO:
            fields[key.strip().lower()] = stated(value)
    return {
        "fighter_id": fighter_id, "full_name": name, "height_in": inches(fields.get("height")), "weight_lbs": whole(fields.get("weight")), "reach_in": whole(fields.get("reach")),
        "stance": fields.get("stance"), "dob": day(fields["dob"]) if fields.get("dob") else None, "url": url or f"{SITE}/fighter-details/{fighter_id}",
    }


_BY = [f"{field}_by string" for field in EXTRACTORS]
_TABLES = {"event": "events", "fight": "fights", "side": "fight_participants", "stats": "fighter_fight_stats", "fighter": "fighters"}
_FIELDS = {part: [f"{f.name} {f.dataType.simpleString()}" for f in STAGING[table]] + (_BY if part == "fight" else []) for part, table in _TABLES.items()}
_PARSED = "reason string, " + ", ".join(f"{part} struct<{','.join(f.replace(' ', ':') for f in fields)}>" for part, fields in _FIELDS.items())


class PageRows:
    """UDTF of ``(kind, entity_id, html)``: a row for each record of a page, in the column of its table, and one for each fault."""

    def eval(self, kind: str, entity_id: str, html: str):
        if kind == "events":
            page = parsed(html)
            try:
                yield self.row(event=event_record(page, entity_id))
            except BrokenPage as fault:
                yield self.row(reason=str(fault))
                return
            for row in fight_rows(page):
                try:
                    found = event_fight(row, entity_id)
                except BrokenPage as fault:
                    yield self.row(reason=str(fault))
                    continue
                if found:
                    yield self.row(fight=found[0])
                    yield from (self.row(side=side) for side in found[1])
            return
        try:
            if kind == "fights":
                sides, totals = fight_page(html, entity_id)
                yield from (self.row(side=side) for side in sides)
                yield from (self.row(stats=row) for row in totals)
            elif kind == "fighters":
                yield self.row(fighter=fighter_record(html, entity_id))
        except BrokenPage as fault:
            yield self.row(reason=str(fault))

    @staticmethod
    def row(reason: str | None = None, **parts):
        return (reason, *(tuple(parts[part].get(f.split()[0]) for f in _FIELDS[part]) if part in parts else None for part in _TABLES))


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages ``kind, entity_id, html`` to ``kind, entity_id, reason`` and a column for each table, of which a row fills one."""
    ship(pages.sparkSession)
    rows = F.udtf(PageRows, returnType=_PARSED)
    return pages.select("kind", "entity_id", "html").lateralJoin(rows(*[F.col(c).outer() for c in ("kind", "entity_id", "html")])).drop("html")


def parse_all(pages: DataFrame, today) -> dict[str, DataFrame]:
    """The staging tables of a tree of pages, and ``quarantine``: ``kind, entity_id, reason`` of what is broken.

    Events after ``today`` are left out with their fights. A fight page counts if its fight is in an event (of several, the one
    with the largest id); its sides then replace those of the event's row. Every page is read once.
    """
    found = materialize(read_pages(pages), "pages")
    part = lambda name, kind: found.where((F.col("kind") == kind) & F.col(name).isNotNull()).select(f"{name}.*")
    events = past(part("event", "events"), today)
    kept = events.select("event_id").distinct()
    fights, rows = (part(name, "events").join(kept, "event_id", "left_semi") for name in ("fight", "side"))
    event_of = fights.groupBy("fight_id").agg(F.max("event_id").alias("event_id"))
    placed = lambda name: part(name, "fights").drop("event_id").join(event_of, "fight_id")
    in_order = lambda df, table: df.select(*[f.name for f in STAGING[table]])
    faults = found.where("reason is not null").select("kind", "entity_id", "reason")
    known = faults.where("kind = 'fights'").join(event_of.select(F.col("fight_id").alias("entity_id")), "entity_id", "left_semi")
    return {
        "events": events, "fights": fights.select(*[f.name for f in STAGING["fights"]], *[b.split()[0] for b in _BY]),
        "fight_participants": in_order(replace_rows(rows, placed("side"), "fight_id"), "fight_participants"),
        "fighters": part("fighter", "fighters"), "fighter_fight_stats": in_order(placed("stats"), "fighter_fight_stats"),
        "quarantine": faults.where("kind <> 'fights'").unionByName(known),
    }
