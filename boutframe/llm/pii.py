"""Personal data in texts by anchor expansion.

One Aho-Corasick automaton goes over each text (A-Z lower-cased) and finds anchors: at-signs, plus signs and digits, colons,
schemes (``://``) and identifier cues such as ``iban`` or ``account``. Around an anchor a deterministic local parser expands to
the boundaries of a candidate and validates it. A parser never looks back across what its kind has taken, so the work is linear
in the text, however it looks.

Base kinds, leftmost and without overlaps within a kind (the patterns are those of ``BASE``): ``email``, ``ip`` (parts at most
255), ``card`` (12 to 19 digits that pass Luhn's test), ``phone`` (plus sign, 9 to 15 digits). A match that fails is dropped
with all its characters. Kinds that the anchors add:

* ``mail``: an at-sign between a local part and dotted labels with letters beyond ASCII, or a quoted local part;
* ``login``: scheme, user and host of ``scheme://user[:password]@host``;
* ``ip6``: eight groups of up to four hex digits, or fewer with one ``::`` among at least three groups with a digit;
* ``mac``: six pairs of hex digits between colons;
* ``iban``: after its cue, 15 to 34 letters and digits (single spaces between) whose check digits are right;
* ``ssn``: after its cue, nine digits as 3-2-4, of an area and a group that are given out;
* ``account``: after a cue of an account, passport or licence, 6 to 20 letters, digits and inner hyphens with 5 digits or more;
* ``tel``: after a cue of a telephone, 7 to 15 digits with spaces, dots, hyphens and brackets.

An added span that lies inside a base span, or overlaps an added one that was taken before it (by start, then kind), is left
out; base spans all stay. Spans are in code points, end exclusive.

Cases: null and empty texts have no spans; repeated rows each give a row; a null doc_id passes through; empty tables and empty
partitions give no rows; of the documents only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import ship

KINDS = ("email", "ip", "card", "phone")
ADDED = ("mail", "login", "ip6", "mac", "iban", "ssn", "account", "tel")
#: The base patterns. The parsers below take the same spans from their anchors.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that announce an identifier.
CUES = {
    "iban": ("iban",), "ssn": ("ssn", "social security", "social-security"),
    "account": ("account", "acct", "a/c", "passport", "konto", "cuenta", "compte", "licence", "license", "ausweis", "pasaporte", "passeport"),
    "tel": ("tel", "phone", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
ROW = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_QUAD = re.compile(r"[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIAL = re.compile(r"[ ().0-9-]++")
_LABELS = re.compile(r"[\w-]++(?:\.[\w-]++)++")
_TOP = re.compile(r"[^\W\d_]{2,}")
_QUOTED = re.compile(r'"[^"\n]{1,64}"$')
_USER = re.compile(r"[^\s/?#@\"'<>]++@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|\[[0-9A-Fa-f:.]++\])(?::[0-9]++)?")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_LABEL_END = re.compile(r"(?:[ \t]*+(?:numbers?|nummer|num|nr|no|n[º°]|id|is|#|\(s\)))?[ \t]*+[.:=#]?+[ \t]*+", re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"([0-9]{3})([- ]?)([0-9]{2})\2([0-9]{4})(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+")
_TEL = re.compile(r"[(0-9][ ().0-9/-]*+")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def iban_valid(value: str) -> bool:
    value = value.upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def ip6_valid(value: str) -> bool:
    head, gap, tail = value.partition("::")
    groups = [g for side in (head, tail) for g in side.split(":") if side]
    if "::" in tail or tail.startswith(":") or any(not 1 <= len(g) <= 4 for g in groups):
        return False
    return len(groups) == 8 and not gap or bool(gap) and 3 <= len(groups) <= 7 and any(c.isdigit() for c in value)


@cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for anchor in ("@", "+", ":", "://", *"0123456789"):
        automaton.add_word(anchor, ("digit" if anchor.isdigit() else anchor, 1))
    for kind, words in CUES.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


class Scan:
    """The spans of one text; a method for each kind of anchor."""

    def __init__(self, text: str):
        self.text, self.base, self.more = text, [], []
        self.taken = dict.fromkeys((*KINDS, "hex", "number"), 0)
        lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z change, so places stay
        actions = {"@": self.at, "+": self.plus, "digit": self.digit, ":": self.colon, "://": self.scheme}
        for end, (kind, size) in _automaton().iter(lower):
            actions[kind](end) if kind in actions else self.cue(kind, end - size + 1, end + 1)

    def _back(self, at: int, floor: int, allowed) -> int:
        text = self.text
        while at > floor and text[at - 1] in allowed:
            at -= 1
        return at

    def at(self, k: int) -> None:
        text, floor = self.text, self.taken["email"]
        start = self._back(k, floor, _LOCAL)
        if start < k and (m := _DOMAIN.match(text, k + 1)):
            self.base.append((start, 0, m.end()))
            self.taken["email"] = m.end()
        m = _LABELS.match(text, k + 1)
        if m and _TOP.fullmatch(m[0].rpartition(".")[2]):  # the same with letters of any script, or a quoted local part
            low = k
            while low > floor and (text[low - 1] in _LOCAL or text[low - 1].isalnum()):
                low -= 1
            if text[k - 1 : k] == '"' and (quoted := _QUOTED.search(text, max(0, k - 66), k)):
                low = quoted.start()
            if low < k:
                self.more.append((low, 0, m.end()))

    def digit(self, i: int) -> None:
        text = self.text
        if i < self.taken["number"]:
            return
        stop = _DIGITS.match(text, i).end()
        self.taken["number"] = stop
        if i >= self.taken["ip"] and text[stop : stop + 1] == "." and (m := _QUAD.match(text, i)):
            self.taken["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (text[i:stop], *m.groups())):
                self.base.append((i, 1, m.end()))
        if i >= self.taken["card"] and (m := _CHAIN.match(text, i)):
            self.taken["card"] = m.end()
            if m.end() - i <= 37:  # 19 digits with what separates them
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self.base.append((i, 2, m.end()))

    def plus(self, k: int) -> None:
        text = self.text
        if k < self.taken["phone"] or not ("0" <= text[k + 1 : k + 2] <= "9") or not (m := _DIAL.match(text, k + 2)):
            return
        stop = k + 2 + len(m[0].rstrip(" ().-"))
        if stop > k + 3:
            self.taken["phone"] = stop
            if 9 <= sum("0" <= c <= "9" for c in text[k:stop]) <= 15:
                self.base.append((k, 3, stop))

    def colon(self, k: int) -> None:
        if k < self.taken["hex"]:
            return
        text, allowed = self.text, "0123456789abcdefABCDEF:"
        start, stop = self._back(k, self.taken["hex"], allowed), k + 1
        while stop < len(text) and text[stop] in allowed:
            stop += 1
        self.taken["hex"] = stop
        value, around = text[start:stop], text[max(0, start - 1) : start] + text[stop : stop + 1]
        if any(c.isalnum() or c == "_" for c in around):
            return
        if re.fullmatch(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}", value):
            self.more.append((start, 3, stop))
        elif value.count(":") > 1 and ip6_valid(value):
            self.more.append((start, 2, stop))

    def scheme(self, end: int) -> None:
        text, k = self.text, end - 2
        name = _SCHEME.search(text, max(0, k - 16), k)
        if name and (m := _USER.match(text, end + 1)):
            self.more.append((name.start(), 1, m.end()))

    def cue(self, kind: str, start: int, stop: int) -> None:
        text = self.text
        if text[start - 1 : start].isalnum() and start or text[stop : stop + 1].isalpha():
            return
        at = _LABEL_END.match(text, stop).end()
        if at == stop:
            return
        if kind == "iban" and (m := _IBAN.match(text, at)):
            value = m[0]
            for cut in range(len(value), 14, -1):  # trailing words may have been taken for groups
                if value[cut - 1] != " " and not text[at + cut : at + cut + 1].isalnum() and iban_valid(value[:cut].replace(" ", "")):
                    self.more.append((at, 4, at + cut))
                    break
        elif kind == "ssn" and (m := _SSN.match(text, at)):
            if m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000":
                self.more.append((at, 5, m.end()))
        elif kind == "account" and (m := _ACCOUNT.match(text, at)):
            if 6 <= len(m[0]) <= 20 and sum("0" <= c <= "9" for c in m[0]) >= 5:
                self.more.append((at, 6, m.end()))
        elif kind == "tel" and (m := _TEL.match(text, at)):
            value = m[0].rstrip(" ().-/")
            if 7 <= sum("0" <= c <= "9" for c in value) <= 15 and not text[at + len(value) : at + len(value) + 1].isalpha():
                self.more.append((at, 7, at + len(value)))

    def spans(self) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and all spans ``(start, end, kind)``, each by start, then kind."""
        base = [(start, end, KINDS[kind]) for start, kind, end in sorted(self.base)]
        if not self.more:
            return base, base
        taken, rest, at, inside, reach = sorted((start, end) for start, end, _ in base), [], 0, -1, -1
        for start, kind, end in sorted(self.more):
            while at < len(taken) and taken[at][0] <= start:  # how far base spans reach that begin no later than this one
                inside, at = max(inside, taken[at][1]), at + 1
            if end > inside and start >= reach:
                rest.append((start, end, ADDED[kind]))
                reach = end
        order = {k: n for n, k in enumerate((*KINDS, *ADDED))}
        return base, sorted(base + rest, key=lambda s: (s[0], order[s[2]]))


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base with added ones, as ``(start, end, kind)``."""
    return Scan(text).spans() if text else ([], [])


def _listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of the base spans, all spans."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for batch in batches:
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, spans = find_spans(text.as_py())
                found = [kind for _, _, kind in base]
                rows.append((own, *(found.count(k) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ROW)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; of overlapping spans, the first one's kind stands for all."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def mask(text):
        out, done = [], 0
        for start, end, kind in find_spans(text)[1]:
            if start >= done:
                out += [text[done:start], f"<{kind}>"]
            done = max(done, end)
        return "".join(out) + text[done:] if out else text

    def run(batches):
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([mask(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
