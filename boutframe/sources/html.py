"""HTML pages as rows: titles, links and table cells by built-in expressions, and pages of the results site by lines.

Simple extractions stay in the JVM. Pages that need their structure go through ``mapInPandas`` with the standard library's
parser, which turns a page into lines of text and links. Whole trees of pages are read in ``bout_pages`` and ``result_pages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.session import ship


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def links(html: Column) -> Column:
    """All link targets, first occurrence first, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))


def cells(html: Column, tag: str = "p") -> Column:
    return F.regexp_extract_all(html, F.lit(f"<{tag}>([^<]*)</{tag}>"), F.lit(1))


class Page(HTMLParser):
    """Rows of cells; a cell is its text with white space collapsed, and its links."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, list[str]]]] = []
        self.lines: list[str] = []
        self.links: list[tuple[str, str]] = []
        self._cell: list[str] | None = None
        self._hrefs: list[str] = []
        self._text: list[str] = []
        self._anchor: tuple[str, list[str]] | None = None
        self.feed(html or "")
        self.close()
        self._flush()

    def _flush(self) -> None:
        if line := " ".join("".join(self._text).split()):
            self.lines.append(line)
        self._text = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._cell, self._hrefs = [], []
        elif tag == "a":
            self._anchor = (dict(attrs).get("href") or "", [])
        if tag in ("tr", "td", "th", "p", "div", "li", "br", "h1", "h2", "h3", "span", "i", "b"):
            self._flush() if tag not in ("span", "i", "b") else None
            if self._cell is not None and tag in ("br", "p"):
                self._cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self._cell).split()), self._hrefs))
            self._cell = None
        elif tag == "a" and self._anchor:
            self.links.append((self._anchor[0], " ".join("".join(self._anchor[1]).split())))
            if self._cell is not None:
                self._hrefs.append(self._anchor[0])
            self._anchor = None
        if tag in ("tr", "td", "th", "p", "div", "li", "h1", "h2", "h3"):
            self._flush()

    def handle_data(self, data):
        self._text.append(data)
        if self._cell is not None:
            self._cell.append(data)
        if self._anchor:
            self._anchor[1].append(data)


_OUTCOMES = {"w": "W", "win": "W", "l": "L", "loss": "L", "d": "D", "draw": "D", "nc": "NC"}
# The results site: cards with a main event and a table of further bouts, organisation pages, fighter pages.

_SLUG = re.compile(r"-(\d+)/?$")
RESULTS = "promotion string, event_id string, fight_id string, match_number int, fighter_id string, opponent_id string, corner string, full_name string, outcome string, method string, round int, time string, reason string"
#: Other sports' names, which a card of a promotion named like ONE may hold.
OTHER_RULES = ("kickboxing", "muay thai", "submission grappling", "grappling")


def _slug(url: str, entity: str) -> str | None:
    return m[1] if f"/{entity}/" in url and (m := _SLUG.search(url)) else None


def organisation_events(html: str) -> tuple[list[dict], str | None]:
    """Events of an organisation's page, each once, and the address of the page with older ones."""
    page, out = Page(html), {}
    for row in page.rows:
        for text, hrefs in row:
            for href in hrefs:
                if (own := _slug(href, "events")) and own not in out:
                    date = re.search(r"([A-Z][a-z]{2}) ?(\d{1,2}),? ?(\d{4})", " ".join(t for t, _ in row))
                    out[own] = {"event_id": own, "name": text, "event_date_text": f"{date[1]} {int(date[2])}, {date[3]}" if date else None, "location": row[-1][0] if len(row) > 2 else None, "url": href}
    older = next((href for href, text in page.links if text.lower().startswith("older events")), None)
    return list(out.values()), older


def result_bouts(html: str, event_id: str, promotion: str) -> list[dict]:
    """Two rows a bout: the results table, and the main event where the table lacks it; what is wrong with a bout is its ``reason``.

    A bout's id is the event's with the match number. Bouts without two sides, one of each corner, and bouts under other
    rules at promotions named like ONE are quarantined.
    """
    page, bouts = Page(html), {}
    for row in page.rows:
        links = [(own, text) for text, hrefs in row for h in hrefs if (own := _slug(h, "fighter"))]
        texts = [t for t, _ in row]
        if not links or not texts or not texts[0].isdigit():
            continue
        outcomes = [_OUTCOMES[w.lower()] for t in texts for w in t.split() if w.lower() in _OUTCOMES]
        rest = [t for t in texts if t]
        clock = next((t for t in reversed(rest) if re.fullmatch(r"\d+:\d{2}", t)), None)
        round_ = next((int(t) for t in reversed(rest[:-1]) if t.isdigit()), None)
        method = rest[-3] if len(rest) >= 3 else None
        bouts.setdefault(int(texts[0]), []).append((links, outcomes, method, round_, clock, " ".join(texts)))
    main = [(own, text) for href, text in page.links if (own := _slug(href, "fighter")) and text]
    text = " ".join(page.lines)
    known = {own for group in bouts.values() for links, *_ in group for own, _ in links}
    pair = list(dict.fromkeys(own for own, _ in main))[:2]
    if len(pair) == 2 and not set(pair) & known:
        labels = {k: (re.search(rf"(?i)\b{k}\s*:?\s+(\S[^|]*?)(?=\s+(?:method|referee|round|time|match)\b|$)", text) or [None, None])[1] for k in ("match", "method", "round", "time")}
        outcomes = [_OUTCOMES[w.lower()] for w in text.split() if w.lower() in _OUTCOMES][:2]
        number = int(labels["match"]) if (labels["match"] or "").isdigit() else max(bouts, default=0) + 1
        bouts.setdefault(number, []).append(([(p, dict(main).get(p)) for p in pair], outcomes, labels["method"], int(labels["round"]) if (labels["round"] or "").isdigit() else None, labels["time"], text))
    out = []
    for number, group in sorted(bouts.items()):
        sides = list(dict.fromkeys(s for links, *_ in group for s in links))
        _, outcomes, method, round_, clock, line = group[0]
        other = "one" in promotion.lower() and any(r in line.lower() for r in OTHER_RULES)
        reason = "invalid_participant_shape" if len(sides) != 2 else "ambiguous_or_non_mma_one_bout" if other else None
        for k, (own, name) in enumerate(sides):
            out.append({
                "promotion": promotion, "event_id": event_id, "fight_id": f"{event_id}:{number}", "match_number": number, "fighter_id": own, "opponent_id": sides[1 - k][0] if len(sides) == 2 else None,
                "corner": ("red", "blue")[k] if k < 2 else None, "full_name": name, "outcome": outcomes[k] if k < len(outcomes) else None, "method": method, "round": round_, "time": clock, "reason": reason,
            })
    return out


def result_fighter(html: str, fighter_id: str) -> dict:
    """A fighter page of the results site: what stands between its labels."""
    page = Page(html)
    text = " ".join(page.lines)
    found = lambda pattern: (m[1].strip() if (m := re.search(pattern, text)) else None)
    return {
        "fighter_id": fighter_id, "full_name": page.lines[0] if page.lines else None, "height_text": found(r"(?i)height\s+(\d+'\s*\d+)"), "weight_text": found(r"(?i)weight\s+(\d+(?:\.\d+)?) ?lbs"),
        "reach_text": None, "stance": None, "dob_text": found(r"(?i)(?:birth ?date|age)\D*?([A-Z][a-z]{2} \d{1,2}, \d{4})"),
    }


def parse_results(pages: DataFrame) -> DataFrame:
    """Bouts of event pages ``entity_id, promotion, html`` with the reason that quarantines them, if any."""
    ship(pages.sparkSession)
    columns = [c.split()[0] for c in RESULTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for own, promotion, html in zip(pdf["entity_id"], pdf["promotion"], pdf["html"], strict=True) for r in result_bouts(html, own, promotion or "")]
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    return pages.select("entity_id", "promotion", "html").mapInPandas(run, RESULTS)


def exact_candidates(html: str, name: str) -> list[tuple[str, str]]:
    """Search results whose name reads like the one looked for: (id, name), each id once."""
    key = lambda x: " ".join(re.sub(r"[^a-z0-9]+", " ", x.lower()).split())
    return list({own: (own, text) for href, text in Page(html).links if (own := _slug(href, "fighter")) and key(text) == key(name)}.values())
