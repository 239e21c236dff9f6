"""LM scoring: a log-bilinear neural model over words and word classes, trained in numpy with noise-contrastive estimation.

A text's probability is the product over its tokens (words, then one end) of P(class | context) and P(word | class). The
``FREQUENT`` most frequent training words and the end are classes of their own; all other words fall into 32 classes by
spelling (last letter's kind, letters beyond ASCII, length). The context is the class of the token before and the spelling of
the one before that. Each of these has a vector for its position; their sum is the prediction, and a target class's score is
its vector's product with the prediction plus a bias. The vectors are trained on the counts of *all* training documents'
contexts and targets, by telling each observed class from ``NOISE`` drawn ones; positives are drawn by their counts, as many
as ``EPOCHS`` times the number of different ones (and ``LEAST_STEPS`` batches at least), so training grows with what the
corpus holds. Batched matrix products of all contexts with all targets then give every context's normaliser, with which a
token's score is a log-probability.

P(word | class) comes from the counts of all words by absolute discounting (the discount from the numbers of words met once
and twice, class by class); what is taken off is the probability of a word that training lacks, one event of each class, so
the whole model is normalised.

Word counts are kept as a distributed table. The ``BROADCAST_WORDS`` most frequent words (a fixed bound) are looked up in
memory; all others meet their counts in a join. Word identity is a 64-bit hash.

Cases: a null text counts as empty and is one token, the end; a null doc_id counts as an empty id in the fold and passes
through; repeated rows are scored each and counted each in training; without training documents N and V are 0 and classes
are equally likely; empty tables and empty partitions give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.langid import fold
from boutframe.llm.words import hashes_of
from boutframe.session import materialize, ship

FREQUENT = 479
SPELLINGS = 32
END = SPELLINGS  # the end's spelling
BROADCAST_WORDS = 1 << 16
DIMENSIONS = 32
NOISE = 16
BATCH = 4096
EPOCHS = 2
LEAST_STEPS = 400
RATE = 0.2
SEED = 5
END_HASH = hashes_of([b"\n"])[0]
FLUSH = 2_000_000


def tokens_of(texts: list[str | None], chars: int = 2_000_000):
    """``hashes, spellings, first token of each text`` for about ``chars`` characters of texts at a time, with an end after each."""
    start = held = 0
    for stop, text in enumerate(texts, 1):
        held += len(text or "")
        if held < chars and stop < len(texts):
            continue
        low = [(x or "").encode().lower() for x in texts[start:stop]]
        words = [x.split() for x in low]
        counts = np.array([len(x) for x in words])
        buffer = np.frombuffer(b"\n".join([b"", *low, b""]), np.uint8)
        inside = ~((buffer == 32) | ((buffer >= 9) & (buffer <= 13)))
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edges[::2], edges[1::2] - 1
        length = last - first + 1
        beyond = np.add.reduceat((buffer >= 128).astype(np.int32), first) > 0 if len(first) else np.zeros(0, bool)
        tail = buffer[last]
        kind = np.select([(tail >= 128) | ((tail >= 97) & (tail <= 122)), tail == ord("."), tail == ord(",")], [0, 1, 2], 3)
        spelling = kind * 8 + beyond * 4 + np.digitize(length, [4, 7, 10])
        at = np.cumsum(counts)
        hashes = np.insert(hashes_of([w for x in words for w in x]), at, END_HASH)
        yield hashes, np.insert(spelling, at, END).astype(np.int64), np.cumsum(counts + 1) - counts - 1
        start, held = stop, 0


def word_counts(train: DataFrame) -> DataFrame:
    """``h, spelling, c``: every token of the training texts with its count."""

    def run(batches):
        hashes, spellings, counts, size = [], [], [], 0

        def merged():
            h, s, c = (np.concatenate(x) for x in (hashes, spellings, counts))
            values, first, where = np.unique(h, return_index=True, return_inverse=True)
            return values, s[first], np.bincount(where, c, len(values)).astype(np.int64)

        def rows(h, s, c):
            for a in range(0, len(h), 200_000):
                part = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(s[part].astype(np.int8)), pa.array(c[part])], names=["h", "spelling", "c"])

        for batch in batches:
            for h, s, _ in tokens_of(batch.column(0).to_pylist()):
                hashes.append(h)
                spellings.append(s)
                counts.append(np.ones(len(h), np.int64))
                size += len(h)
                if size > FLUSH:
                    h, s, c = merged()
                    if len(h) > FLUSH // 2:  # mostly words met once: pass them on
                        yield from rows(h, s, c)
                        h, s, c = h[:0], s[:0], c[:0]
                    hashes, spellings, counts, size = [h], [s], [c], len(h)
        if hashes:
            yield from rows(*merged())

    return train.select("text").mapInArrow(run, "h long, spelling byte, c long").groupBy("h").agg(F.first("spelling").alias("spelling"), F.sum("c").alias("c"))


class Classes:
    """Classes of hashed words: the frequent ones and the end have their own, others that of their spelling."""

    def __init__(self, frequent: list[int]):
        self.own_words = len(frequent)
        self.end, self.size = self.own_words, self.own_words + 1 + SPELLINGS
        own = np.array([*frequent, END_HASH.astype(np.int64)], np.int64).view(np.uint64)
        order = np.argsort(own)
        self.own, self.number = own[order], order

    def of(self, hashes: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, self.number[at], self.end + 1 + spelling)

    def contexts(self, classes: np.ndarray, spelling: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number of each token's context: spelling of the token two before, class of the one before; before a text there are ends."""
        two, one = np.full(len(classes), END), np.full(len(classes), self.end)
        one[1:], two[2:] = classes[:-1], spelling[:-2]
        one[first], two[first] = self.end, END
        second = first + 1
        two[second[second < len(classes)]] = END
        return two * self.size + one


def observed(train: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with targets (as one number) of all training texts with their counts; there are at most 33 * size**2."""
    cells = (SPELLINGS + 1) * classes.size**2

    def run(batches):
        total, parts, held = np.zeros(cells, np.int32), [], 0
        for batch in batches:
            for hashes, spelling, first in tokens_of(batch.column(0).to_pylist()):
                own = classes.of(hashes, spelling)
                parts.append(classes.contexts(own, spelling, first) * classes.size + own)
                held += len(own)
                if held > FLUSH:
                    total += np.bincount(np.concatenate(parts), minlength=cells).astype(np.int32)
                    parts, held = [], 0
        if parts:
            total += np.bincount(np.concatenate(parts), minlength=cells).astype(np.int32)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 200_000):
            part = at[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["cell", "n"])

    rows = train.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(at)
    return at[order], n[order]


class Bilinear:
    """Vectors of contexts and targets, biases, and each context's normaliser."""

    def __init__(self, size: int, before: np.ndarray, earlier: np.ndarray, target: np.ndarray, bias: np.ndarray):
        self.size, self.before, self.earlier, self.target, self.bias = size, before, earlier, target, bias
        self.normaliser = np.concatenate([self._rows(np.arange(a, min(a + 4096, (SPELLINGS + 1) * size)))[1] for a in range(0, (SPELLINGS + 1) * size, 4096)])

    def _rows(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all targets in some contexts, and the logarithms of their sums of exponentials."""
        scores = (self.before[contexts % self.size] + self.earlier[contexts // self.size]) @ self.target.T + self.bias
        top = scores.max(1, keepdims=True)
        return scores, (top + np.log(np.exp(scores - top).sum(1, keepdims=True)))[:, 0]

    def table(self, contexts: np.ndarray) -> np.ndarray:
        """log10 P(target | context), a row for each context."""
        scores, total = self._rows(contexts)
        return (scores - total[:, None]) / np.log(10)

    def log10(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 P(target | context) of each token."""
        out = np.empty(len(targets))
        for a in range(0, len(targets), 1 << 16):
            context, target = contexts[a : a + (1 << 16)], targets[a : a + (1 << 16)]
            guess = self.before[context % self.size] + self.earlier[context // self.size]
            out[a : a + (1 << 16)] = np.einsum("ij,ij->i", guess, self.target[target]) + self.bias[target] - self.normaliser[context]
        return out / np.log(10)


def train_nce(cell: np.ndarray, n: np.ndarray, size: int, steps: int | None = None, seed: int = SEED) -> Bilinear:
    """A log-bilinear model of ``size`` classes fitted to counted cells (context * size + target) by noise-contrastive estimation."""
    f = np.float32
    if not len(n):
        return Bilinear(size, np.zeros((size, 1), f), np.zeros((SPELLINGS + 1, 1), f), np.zeros((size, 1), f), np.zeros(size, f))
    rng = np.random.default_rng(seed)
    steps = steps or max(LEAST_STEPS, -(-EPOCHS * len(n) // BATCH))
    unigram = np.bincount(cell % size, n, size) + 0.5
    noise = unigram / unigram.sum()
    before, earlier, target = (rng.normal(0, 0.1, (k, DIMENSIONS)).astype(f) for k in (size, SPELLINGS + 1, size))
    bias = np.log(noise).astype(f)
    shift = np.log(NOISE * noise).astype(f)
    values = (before, earlier, target, bias)
    sums = [np.full_like(x, 1e-3) for x in values]
    reach, pull = np.cumsum(n) / n.sum(), np.cumsum(noise)
    at = np.arange(BATCH)[:, None]
    for step in range(steps):
        pick = np.minimum(np.searchsorted(reach, rng.random(BATCH)), len(cell) - 1)
        context, right = cell[pick] // size, cell[pick] % size
        one, two = context % size, context // size
        wanted = np.concatenate([right[:, None], np.minimum(np.searchsorted(pull, rng.random((BATCH, NOISE))), size - 1)], 1)
        guess = before[one] + earlier[two]
        scores = (guess @ target.T)[at, wanted] + bias[wanted] - shift[wanted]  # one product for all classes of the batch
        error = -1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        error[:, 0] += 1
        weights = (np.bincount((at * size + wanted).reshape(-1), error.reshape(-1), BATCH * size) / BATCH).astype(f).reshape(BATCH, size)
        back = weights @ target
        grads = []
        for index, length in ((one, size), (two, SPELLINGS + 1)):
            hot = np.zeros((length, BATCH), f)
            hot[index, np.arange(BATCH)] = 1
            grads.append(hot @ back)
        grads += [weights.T @ guess, weights.sum(0)]
        rate = f(RATE * (1 - 0.9 * step / steps))
        for value, grad, total in zip(values, grads, sums, strict=True):
            total += grad * grad
            value += rate * grad / np.sqrt(total)
    return Bilinear(size, *values)


PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, h long, tf long"


def score(docs: DataFrame, steps: int | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 7) == 2).alias("held_out"), F.col("text").alias("text"))
    train = rows.where("not held_out")
    vocabulary = materialize(word_counts(train), "vocabulary")
    spelt = vocabulary.groupBy("spelling").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()  # 33 rows
    top = vocabulary.orderBy(F.col("c").desc(), "h").limit(BROADCAST_WORDS).toArrow()
    top = {c: top.column(c).to_numpy() for c in ("h", "spelling", "c")}
    total, distinct = sum(r["n"] for r in spelt), sum(r["v"] for r in spelt)
    frequent = np.flatnonzero(top["spelling"] != END)[:FREQUENT]
    # tokens, words, words met once and twice of each spelling, without those that have a class of their own
    sizes = np.zeros((SPELLINGS + 1, 4))
    for r in spelt:
        sizes[r["spelling"]] = r["n"], r["v"], r["once"], r["twice"]
    for spelling, c in zip(top["spelling"][frequent], top["c"][frequent], strict=True):
        sizes[spelling] -= c, 1, c == 1, c == 2
    tokens, words, once, twice = sizes.T
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9)
    unseen = np.log10(np.where(tokens > 0, discount * words, 1.0).clip(1e-9))  # of the word that training lacks, before the division by tokens
    whole = np.log10(np.maximum(tokens, 1))
    classes = Classes(top["h"][frequent].tolist())
    order = np.argsort(top["h"].view(np.uint64))
    known, counts, spelling = top["h"].view(np.uint64)[order], top["c"][order].astype(float), top["spelling"][order]
    model = train_nce(*observed(train, classes), classes.size, steps)
    shared = spark.sparkContext.broadcast((classes, known, np.log10(counts + 1), np.log10(counts - discount[spelling]), model, unseen, whole))
    unit = float(np.log10(total + distinct + 1))

    def partial(batches):
        classes, known, base_logs, model_logs, model, unseen, whole = shared.value
        row = TaskContext.get().partitionId() << 40
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in PARTIAL.split(", ")]
        for batch in batches:
            ids, held, at = batch.column(0), batch.column(1), 0
            for hashes, spelling, first in tokens_of(batch.column(2).to_pylist()):
                own = classes.of(hashes, spelling)
                spot = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[spot] == hashes if len(known) else np.zeros(len(hashes), bool)
                base = (np.where(hit, base_logs[spot], 0.0) if len(known) else np.zeros(len(hashes))) - unit
                inside = (np.where(hit, model_logs[spot], unseen[spelling]) if len(known) else unseen[spelling]) - whole[spelling]
                scored = model.log10(classes.contexts(own, spelling, first), own) + np.where(own > classes.end, inside, 0.0)
                count = np.diff(np.append(first, len(hashes)))
                sums = [np.add.reduceat(x, first) for x in (hit.astype(np.int64), base, scored)]
                k = len(first)
                numbers = row + np.arange(k)
                columns = [numbers, ids.slice(at, k), held.slice(at, k), count, *sums, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)
                owner = np.repeat(numbers, count)[~hit]
                order = np.lexsort((hashes[~hit], owner))
                owner, rare = owner[order], hashes[~hit][order]
                new = np.ones(len(rare), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])
                tf = np.diff(np.append(np.flatnonzero(new), len(rare)))
                columns = [owner[new], *[pa.nulls(len(tf), t) for t in kinds[1:7]], rare[new].view(np.int64), tf]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)
                at += k
                row += k

    parts = materialize(rows.mapInArrow(partial, PARTIAL), "scores")
    rare = parts.where("h is not null").select("row", "h", "tf").join(vocabulary, "h")  # words that training lacks keep their event
    of_spelling = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("spelling").cast("int") + 1)
    better = F.log10(F.col("c") - of_spelling(discount)) - of_spelling(unseen)
    added = rare.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("more_known"), F.sum(F.when(F.col("spelling") < END, F.col("tf") * better)).alias("more_model")
    )
    more, more_known, more_model = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0)), F.coalesce("more_model", F.lit(0.0))
    return parts.where("h is null").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more_model).alias("score"),
    )


def base_oracle(table: str = "documents") -> str:
    """The columns but ``score`` as DuckDB SQL, to test against (crc32 has to be registered there)."""
    return f"""
        WITH t AS (SELECT doc_id, crc32(doc_id::VARCHAR) % 7 = 2 AS held_out,
            list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM {table}),
        u AS (SELECT doc_id, held_out, unnest(w) AS w FROM t), c AS (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY w),
        s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(s.n) AS train_tokens,
            sum(log10((coalesce(c.c, 0) + 1) / (s.n + s.v + 1))) AS base_score
        FROM u LEFT JOIN c USING (w), s GROUP BY doc_id"""
