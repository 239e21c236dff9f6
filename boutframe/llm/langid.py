"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 in ``DIMENSIONS`` dimensions. An n-gram's vector binds (multiplies)
its letters' vectors, each rotated by its place; a document bundles (adds) the vectors of its n-grams; a language's
prototype bundles the unit vectors of its training documents. A document gets the language of the prototype with the
largest cosine. Bundling is linear, so a batch of documents is a matrix product of n-gram counts with the vectors of the
n-grams that the batch holds. It is made ``BLOCK_GRAMS`` n-grams and ``BLOCK_LETTERS`` letters at a time, so memory grows
with neither a text's length nor its number of different n-grams, but for the text's own letters.

Letters are lower-cased; a-z have vectors of their own, all other letters share ``LETTERS - 27`` slots by code point, and
any run of other characters is one separator. Training sums are integers (unit vectors times 2**20), so their order has
no effect.

Cases: text that is null or has no letter gets ``und`` with score 0, and so does every text when nothing can be learned
from; a null doc_id counts as an empty id in the fold and passes through; ties go to the first language in order; repeated
rows are each predicted (and each learned from); an empty table gives an empty result; of other columns only ``lang`` is
read, and only to learn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.session import ship

DIMENSIONS = 1024
GRAM = 3
LETTERS = 128
SEED = 20_11
BATCH_CHARS = 600_000
BLOCK_GRAMS = 8192
BLOCK_LETTERS = 2_000_000
MAX_LANGUAGES = 1_000
#: A cosine up to so many standard deviations of the cosine of unrelated vectors (1 / sqrt(DIMENSIONS)) tells no language.
CHANCE = 3.0
#: Texts of fewer letters are too short to be told from chance.
LEAST_LETTERS = 20
UNKNOWN = "und"


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


class Encoder:
    """Texts to bundled vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (LETTERS, dimensions), np.int8) * 2 - 1
        self.places = [np.roll(letters, GRAM - 1 - k, axis=1).astype(np.int8) for k in range(GRAM)]
        self.slot = np.zeros(0x110000, np.uint8)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.slot[alpha] = 27 + np.flatnonzero(alpha) % (LETTERS - 27)
        self.slot[97:123] = np.arange(1, 27)

    def letters(self, text: str) -> np.ndarray:
        """The text's letter slots with one 0 at each end and for each run of other characters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        slots = np.zeros(len(codes) + 2, np.uint8)
        slots[1:-1] = self.slot[codes]
        keep = np.ones(len(slots), bool)
        keep[1:] = (slots[1:] != 0) | (slots[:-1] != 0)
        return slots[keep]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and its number of letters."""
        parts = [self.letters(x) for x in texts]
        count = np.array([np.count_nonzero(p) for p in parts], np.int64)
        total = np.zeros((len(texts), self.places[0].shape[1]))
        flat, owner = np.concatenate(parts or [np.zeros(0, np.uint8)]), np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
        for a in range(0, len(flat), BLOCK_LETTERS):
            b = a + BLOCK_LETTERS + GRAM - 1
            self._bundle(total, flat[a:b].astype(np.int32), owner[a:b])
        return total, count

    def _bundle(self, total: np.ndarray, letters: np.ndarray, owner: np.ndarray) -> None:
        """Add the vectors of all n-grams of some letters to their texts' rows; sums are whole numbers, so their order has no effect."""
        gram = np.zeros(max(0, len(letters) - GRAM + 1), np.int32)
        for k in range(GRAM):
            gram = gram * LETTERS + letters[k : k + len(gram)]
        inside = owner[: len(gram)] == owner[GRAM - 1 :]
        gram, owner = gram[inside], owner[: len(gram)][inside]
        if not len(gram):
            return
        grams = np.flatnonzero(np.bincount(gram, minlength=LETTERS**GRAM))
        column = np.zeros(LETTERS**GRAM, np.int32)
        column[grams] = np.arange(len(grams))
        low, high = int(owner[0]), int(owner[-1]) + 1
        at, row = column[gram], owner - low
        if len(grams) > BLOCK_GRAMS:
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
        edges = np.searchsorted(at, np.arange(0, len(grams) + BLOCK_GRAMS, BLOCK_GRAMS)) if len(grams) > BLOCK_GRAMS else [0, len(at)]
        for first, a, b in zip(range(0, len(grams), BLOCK_GRAMS), edges, edges[1:], strict=False):
            block = grams[first : first + BLOCK_GRAMS]
            counts = np.bincount(row[a:b] * len(block) + (at[a:b] - first), minlength=(high - low) * len(block)).reshape(high - low, len(block))
            bound = np.ones((len(block), total.shape[1]), np.int8)
            for k in range(GRAM):
                bound *= self.places[k][block // LETTERS ** (GRAM - 1 - k) % LETTERS]
            total[low:high] += counts.astype(np.float32) @ bound.astype(np.float32)

    def unit(self, texts: list[str | None]):
        """Unit vectors and numbers of letters of all texts in order, about ``BATCH_CHARS`` characters at a time."""
        start = size = 0
        for stop, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= BATCH_CHARS or stop - start >= 512 or stop == len(texts):
                vectors, count = self.vectors([x or "" for x in texts[start:stop]])
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                yield (vectors / np.where(norm > 0, norm, 1)).astype(np.float32), count
                start, size = stop, 0


_encoders: dict[int, Encoder] = {}


def _encoder(dimensions: int) -> Encoder:
    if dimensions not in _encoders:
        _encoders[dimensions] = Encoder(dimensions)
    return _encoders[dimensions]


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from all rows ``text, lang``."""
    ship(labelled.sparkSession)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            at, langs = 0, np.array(batch.column(1).to_pylist(), object)
            for vectors, count in _encoder(dimensions).unit(batch.column(0).to_pylist()):
                has = count > 0
                whole = np.rint(vectors * (1 << 20)).astype(np.int64)
                own = langs[at : at + len(whole)]
                for lang in set(own[has]):
                    sums[lang] = sums.get(lang, 0) + whole[has & (own == lang)].sum(0)
                at += len(whole)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total], pa.list_(pa.int64()))], names=["lang", "total"])

    partial = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(bundle, "lang string, total array<long>")
    summed = partial.select("lang", F.posexplode("total").alias("at", "part")).groupBy("lang", "at").agg(F.sum("part").alias("part"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not rows:
        return [], np.zeros((0, dimensions), np.float32)
    matrix = np.array([[p["part"] for p in row["parts"]] for row in rows], np.float64)
    return [row["lang"] for row in rows], (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row, from its text alone."""
    ship(docs.sparkSession)
    dimensions = matrix.shape[1]

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for vectors, count in _encoder(dimensions).unit(batch.column(2).to_pylist()):
                cosine = vectors @ matrix.T if languages else np.zeros((len(vectors), 1))
                best = cosine.argmax(1)
                known = (count > 0) & bool(languages)
                names += [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores += np.where(known, np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1), 0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, dimensions: int = DIMENSIONS, chance: float = CHANCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input rows, with all their columns, whose language is identified.

    A row stays when its best cosine is above ``chance`` standard deviations of the cosine between unrelated vectors, or when
    it has letters but fewer than ``LEAST_LETTERS``. So text without letters, and text whose letters are in no known
    language's order, goes. Where nothing can be learned, no row stays.
    """
    ship(docs.sparkSession)
    learned = docs.where(fold(id_col, 3) != 1).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages, matrix = prototypes(learned, dimensions)
    place, least = docs.columns.index(text_col), chance / dimensions**0.5

    def run(batches):
        for batch in batches:
            kept = []
            for vectors, count in _encoder(dimensions).unit(batch.column(place).to_pylist()):
                near = (vectors @ matrix.T).max(1) > least if languages else np.zeros(len(count), bool)
                kept += (near | ((count > 0) & (count < LEAST_LETTERS) & bool(languages))).tolist()
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the rows outside the held-out fold (all of them) and predict every row."""
    learned = docs.where(fold("doc_id", 3) != 1).select(F.col("text").alias("text"), F.col("lang").alias("lang"))
    return predict(docs, *prototypes(learned, dimensions))
