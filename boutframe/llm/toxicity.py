"""Toxicity scores from a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding takes marks off letters, lower-cases, maps look-alike letters of other scripts, digits that stand for letters and ``@``
or ``$`` between letters, drops characters without width, joins letters that dots, hyphens, stars or underscores keep apart, and
turns everything else into single spaces.

The lexicon is learned from labelled rows. A term is a whole word, or a beginning of words that aren't terms themselves. It is
tested against chance: of ``k`` documents that hold it, ``a`` are toxic, and the chance that so many are, if each were toxic
only as often as the words of toxic documents are among all, is at most ``exp(-k * KL(a / k, share))``. Terms are kept by the
Benjamini-Hochberg step at ``FALSE_TERMS`` over all terms that ``LEAST_HELD`` documents hold, whole words first; so the
lexicon grows with the evidence. A term's weight is the log of its odds between toxic and clean documents, with half a
document added to each. An exception phrase is a neighbouring pair of words with a lexicon term that occurs in clean documents
only; matches inside it don't count. The sum of the weights matched by the hundred words goes through a logistic curve fitted
to the same rows (with Platt's smoothed labels).

The lexicon is fitted on at most ``TRAIN_ROWS`` labelled rows (in order of a hash of their ids); every document is scored.

Cases: null and empty texts score as texts without a match; a null doc_id counts as an empty id in the fold, is never
labelled and passes through; an id with several labels is toxic if one of them says so, null labels are ignored; equal texts
with different labels are learned from once, with the label that most of them have (toxic if as many); without a toxic label
to learn from all scores are 0; repeated rows are each scored; empty tables and empty partitions give no rows; of the
documents only id and text are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.langid import fold
from boutframe.session import materialize, ship

TRAIN_ROWS = 10_000
CANDIDATES = 5_000
FALSE_TERMS = 0.1
LEAST_HELD = 4
MIN_CLEAN = 3
MAX_PHRASES = 5_000
STEM = range(4, 11)
#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ѐ": "e", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ꜱ": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}


class _Fold(dict):
    """Code point -> folded character, filled as characters turn up (there are at most 1.1 million)."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if 0xFF41 <= code <= 0xFF5A:  # full-width letters
            char = chr(code - 0xFF41 + 97)
        char = HOMOGLYPHS.get(char) or DIGITS.get(char) or (char if char.isalpha() else " ")
        self[code] = char
        return char


_FOLD = _Fold()
_INSIDE = re.compile(r"(?<=[^\W_])[@$](?=[^\W_])")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[.*_-][^\W_]){2,}(?![^\W_])")
_NO_WIDTH = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]|[\u0300-\u036f]")


def folded(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _NO_WIDTH.sub("", unicodedata.normalize("NFKD", text)).lower()
    if "@" in text or "$" in text:
        text = _INSIDE.sub(lambda m: "a" if m[0] == "@" else "s", text)
    text = _APART.sub(lambda m: re.sub("[.*_-]", "", m[0]), text)
    return text.translate(_FOLD)


def _words(text: str | None) -> list[str]:
    return folded(text).split()


def _stems(word: str) -> list[str]:
    return [word[:n] for n in STEM if n < len(word)]


class Lexicon:
    """Weighted terms, exception phrases and the logistic curve."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], slope: float, intercept: float):
        self.weights, self.exceptions, self.slope, self.intercept = weights, exceptions, slope, intercept
        self._automaton = None

    def __getstate__(self):
        return (self.weights, self.exceptions, self.slope, self.intercept)

    def __setstate__(self, state):
        self.__init__(*state)

    def _build(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            automaton.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(automaton):
            automaton.make_automaton()
        self._automaton = automaton

    def raw(self, text: str | None) -> float:
        """The weights matched outside exception phrases, by the hundred words, on a log scale."""
        if self._automaton is None:
            self._build()
        words = _words(text)
        if not words or not self.weights:
            return 0.0
        hits, spans = [], []
        for end, (size, weight) in self._automaton.iter(f" {' '.join(words)} "):
            (spans if weight is None else hits).append((end - size + 1, end, weight))
        covered = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spans)] if spans else hits
        return math.log1p(100 * sum(w for _, _, w in covered) / len(words))

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * raw)))) if self.weights else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of up to ``limit`` labelled rows outside the held-out fold, one for each text; kept, as it is read again and again."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id", 5) != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most `limit` pairs of numbers, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("share"))
    return materialize(rows.select("doc_id", "text", (F.col("share") >= 0.5).alias("toxic")), "labelled")


def _held(train: DataFrame, terms) -> DataFrame:
    """``term, toxic, clean``: in how many documents of either kind each of a text's ``terms`` is; the empty term counts terms."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = terms(text)
                (toxic if label else clean).update(found)
                (toxic if label else clean)[""] += len(found)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (toxic, clean))], names=["term", "toxic", "clean"])

    return train.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _found(held: DataFrame, documents: tuple[int, int]) -> dict[str, float]:
    """The terms that the Benjamini-Hochberg step keeps, the surest first, with their weights."""
    held = materialize(held.where("term = '' or toxic + clean >= " + str(LEAST_HELD)), "terms")
    total = held.where("term = ''").first()
    if total is None or not total["toxic"]:
        return {}
    share = total["toxic"] / max(1, total["toxic"] + total["clean"])
    k, part = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    other = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(F.lit(0.0)) if share < 1 else F.lit(0.0)
    tested = held.where("term <> ''")
    tests = tested.count()
    chance = tested.where(part > share).select("term", "toxic", "clean", (-k * (part * F.log(part / share) + other)).alias("log_p"))
    rows = chance.orderBy("log_p", "term").limit(CANDIDATES).collect()
    kept = max((n for n, r in enumerate(rows, 1) if r["log_p"] <= math.log(FALSE_TERMS * n / tests)), default=0)
    odds = lambda r: math.log((r["toxic"] + 0.5) / (documents[0] + 1)) - math.log((r["clean"] + 0.5) / (documents[1] + 1))
    return {r["term"]: odds(r) for r in rows[:kept] if odds(r) > 0}


def learn(train: DataFrame) -> Lexicon:
    """The lexicon from rows ``doc_id, text, toxic``."""
    ship(train.sparkSession)
    sides = train.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).first()
    documents = (sides["toxic"], sides["clean"])
    if not documents[0]:
        return Lexicon({}, [], 0.0, 0.0)
    words = _found(_held(train, lambda text: set(_words(text))), documents)
    stems = _found(_held(train, lambda text: {s for w in set(_words(text)) if w not in words for s in _stems(w)}), documents)
    weights = {w + " ": v for w, v in words.items()}
    for stem, weight in stems.items():  # of a beginning and longer ones of the same words, the surest; none that only repeats a word
        if not any(t.startswith(stem) or stem.startswith(t) for t in weights):
            weights[stem] = weight
    terms = set(weights)

    def occurrences(batches):
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = _words(text)
                hits = [k for k, w in enumerate(words) if w + " " in terms or any(s in terms for s in _stems(w))]
                rows += {(f"{words[a]} {words[a + 1]}", bool(label)) for k in hits for a in (k - 1, k) if 0 <= a < len(words) - 1}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.bool_())], names=["pair", "toxic"])

    pairs = train.mapInArrow(occurrences, "pair string, toxic boolean")
    benign = pairs.groupBy("pair").agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("bad")).where(f"clean >= {MIN_CLEAN} and bad = 0")
    exceptions = [r["pair"] for r in benign.orderBy(F.col("clean").desc(), "pair").limit(MAX_PHRASES).collect()]
    lexicon = Lexicon(weights, exceptions, 0.0, 0.0)
    raw = train.mapInArrow(_raw_scores(lexicon), "doc_id long, raw double, toxic boolean").orderBy("doc_id").toArrow()
    lexicon.slope, lexicon.intercept = _logistic(raw.column("raw").to_numpy(), raw.column("toxic").to_numpy().astype(float))
    return lexicon


def _raw_scores(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            raw = [lexicon.raw(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.float64()), batch.column("toxic").cast(pa.bool_())], names=["doc_id", "raw", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope (not negative) and intercept by Newton's method with a small ridge."""
    scale = x[x > 0].mean() if (x > 0).any() else 1.0
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    data, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -40, 40)))
        grad = data.T @ (y - p) - ridge * len(x) * beta * [1, 0]
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + np.eye(2) * max(1e-6, ridge * len(x)), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])) / scale, float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    lexicon = learn(training_rows(docs, labels, train_rows))

    def run(batches):
        for batch in batches:
            scores = [lexicon.score(lexicon.raw(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
