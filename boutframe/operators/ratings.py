"""Time-decayed Elo ratings. Everything of a date depends only on what was known before it.

A rating depends on the fighter's earlier ratings and on those of all opponents, so a table folded in order of time is one chain.
A table of up to ``PER_BIN`` bouts is folded so. In a larger one every fighter's bouts are a chain of their own, which goes in order of
dates with the fighter's true ratings and takes the opponents' ratings from the round before (at first, the initial one). A bout is
right as soon as the bouts that it rests on are, so rounds end at the latest after as many as the longest chain of bouts; as an
opponent's error counts for less than a twentieth in a new rating, about twenty rounds do, whatever the number of dates. They end
when no rating differs by a bit from that of the round before. Then rounds would repeat for ever what they have, and as the first
bouts are right, then those that rest on them, and so on, all are: the rows equal those of the plain fold to the bit.

A round is one shuffle of blocks, as those of ALS are. Sides are numbered once in order of fighters, dates and bouts; ``BLOCK`` of them
that follow each other are a block, a row of packed columns, and a side knows its opponent's number. A round folds the blocks of a bin of
fighters one after the other and sends the opponents' blocks only those ratings that differ from the round before, so no row a side is
made, sorted or written. A task holds a block, two ratings and one block's changes, also for a fighter with a third of all
bouts, whose chain takes the time of these in each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boutframe.session import drop_scratch, materialize, ship

INITIAL, K, HALF_LIFE = 1500.0, 32.0, 730.0
PER_BIN = 50_000
BLOCK = 1 << 16
#: What a part of a block holds, in the order in which a task reads them.
NAMES, CHAIN, STATE, CHANGES = range(4)
PARTS = "bin int, block long, kind int, data binary"
#: A side's number has its bin in the bits from this one on, as ``monotonically_increasing_id`` gives it.
BIN_BIT = 33
RATED = ("pre_fight_elo", "time_decayed_elo", "elo_expected_win_prob", "opponent_pre_fight_elo", "post_elo")


def expected(own, other):
    return 1.0 / (1.0 + 10.0 ** ((other - own) / 400.0))


def decayed(rating: float, days: int | None) -> float:
    return rating if days is None else INITIAL + (rating - INITIAL) * 0.5 ** (max(0, days) / HALF_LIFE)


class Fold:
    """Ratings of fighters in order of time. Of several bouts of a fighter on one date all start from the rating before it; the
    later ones are not decayed again, and the last decided one sets the rating after it."""

    def __init__(self):
        self.rating: dict = {}
        self.seen: dict = {}
        self.after: dict = {}
        self.today = None

    def start(self, date) -> None:
        if date != self.today:
            self.rating.update(self.after)
            self.after, self.today = {}, date

    def before(self, fighter) -> tuple[float, float]:
        """The rating before today, as it was and decayed."""
        raw, last = self.rating.get(fighter, INITIAL), self.seen.get(fighter)
        return raw, decayed(raw, None if last is None else (self.today - last).days)

    def bout(self, date, blue, red, blue_won, decided):
        """Of blue and red: rating before, decayed, chance, opponent's, rating after (or None)."""
        self.start(date)
        raw, own = zip(*(self.before(f) for f in (blue, red)), strict=True)
        chance = expected(own[0], own[1])
        new = (own[0] + K * (float(blue_won) - chance), own[1] + K * (float(not blue_won) - (1 - chance))) if decided else (None, None)
        for fighter, rating in zip((blue, red), new, strict=True):
            self.seen[fighter] = date
            if rating is not None:
                self.after[fighter] = rating
        return (raw[0], own[0], chance, own[1], new[0]), (raw[1], own[1], 1 - chance, own[0], new[1])


def fold(bouts: pd.DataFrame) -> pd.DataFrame:
    """``fight_id, event_date, blue, red, blue_won, decided`` to a row a side, in order of dates: the plain fold of a small table."""
    state, out = Fold(), []
    bouts = bouts.sort_values(["event_date", "fight_id"], kind="stable")
    for fight, date, blue, red, won, decided in zip(*(bouts[c].tolist() for c in ("fight_id", "event_date", "blue", "red", "blue_won", "decided")), strict=True):
        sides = state.bout(date, blue, red, won, decided)
        out += [(fight, f, *side, date) for f, side in zip((blue, red), sides, strict=True)]
    return pd.DataFrame(out, columns=["fight_id", "fighter_id", *RATED, "event_date"])


def bout_pairs(rows: DataFrame) -> DataFrame:
    """One slim row for each dated bout with exactly two sides; blue is first."""
    side = lambda corner, c: F.max(F.when(F.col("corner") == corner, F.col(c)))
    pairs = rows.groupBy("fight_id").agg(
        F.count(F.lit(1)).alias("sides"), F.first("event_date").alias("event_date"), side("blue", "fighter_id").alias("blue"), side("red", "fighter_id").alias("red"),
        side("blue", "winner_flag").alias("blue_won"), side("red", "winner_flag").alias("red_won"), F.bool_or(F.col("outcome").isin("D", "NC")).alias("open"),
    )
    decided = ~F.coalesce("open", F.lit(False)) & F.coalesce(F.col("blue_won") != F.col("red_won"), F.lit(False))
    return pairs.where("sides = 2 and blue is not null and red is not null and event_date is not null").select("fight_id", "event_date", "blue", "red", F.coalesce("blue_won", F.lit(False)).alias("blue_won"), decided.alias("decided"))


def _schema(pairs: DataFrame) -> T.StructType:
    """Ids keep the types that they have in the input."""
    kinds = {f.name: f.dataType for f in pairs.schema}
    return T.StructType([T.StructField("fight_id", kinds["fight_id"]), T.StructField("fighter_id", kinds["blue"]), *[T.StructField(c, T.DoubleType()) for c in RATED], T.StructField("event_date", T.DateType())])


def _fold_all(schema: T.StructType):
    """Bouts in order of dates and ids to a row a side."""
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def run(batches):
        state = Fold()
        for batch in batches:
            rows = []
            for fight, date, blue, red, won, decided in zip(*(batch.column(c).to_pylist() for c in ("fight_id", "event_date", "blue", "red", "blue_won", "decided")), strict=True):
                rows += [(fight, f, *side, date) for f, side in zip((blue, red), state.bout(date, blue, red, won, decided), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    return run


def _placed(pairs: DataFrame, bins: int) -> DataFrame:
    """A row a side with its number (``place``). ``step``: 2 in a fighter's first bout, 1 in the first of a later date, else 0; ``result``: 1 won, 0 lost, -1 undecided."""
    side = lambda own, first: F.struct(F.col(own).alias("fighter_id"), F.lit(first).alias("first"), F.when(~F.col("decided"), -1).otherwise((F.col("blue_won") == F.lit(first)).cast("int")).alias("result"))
    own = pairs.select("fight_id", "event_date", F.explode(F.array(side("blue", True), side("red", False))).alias("x")).select("fight_id", "event_date", "x.*")
    by = ["event_date", "fight_id", F.desc("first")]
    order = Window.partitionBy("fighter_id").orderBy(*by)
    seen = F.lag("event_date").over(order)
    of_both = F.lag("fight_id").over(order) == F.col("fight_id")  # whoever meets themselves: both sides start from the bout before
    days = F.coalesce(F.datediff("event_date", F.when(of_both, F.lag("event_date", 2).over(order)).otherwise(seen)), F.lit(0))
    own = own.repartition(bins, "fighter_id").withColumns({"days": days, "step": F.when(seen.isNull(), 2).otherwise((seen != F.col("event_date")).cast("int"))})
    return own.sortWithinPartitions("fighter_id", *by).withColumn("place", F.monotonically_increasing_id())


def _by_bin(df: DataFrame, bins: int, *order: str) -> DataFrame:
    return df.repartitionById(bins, "bin").sortWithinPartitions(*order)


def _packed(columns: dict) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return {name: table.column(name).to_numpy() for name in table.column_names}


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = zip(("bin", "block", "kind", "data"), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)
    return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _pack(size: int):
    """Sides in order of their numbers to the blocks' names and chains."""

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        take = lambda *names: _packed({name: rows.column(name) for name in names})
        bin_ = block * size >> BIN_BIT
        return _parts([(bin_, block, NAMES, take("fight_id", "fighter_id", "event_date")), (bin_, block, CHAIN, take("days", "step", "first", "result", "other"))])

    def run(batches):
        at, held = None, []
        for batch in batches:
            blocks = batch.column("place").to_numpy() // size
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if held and at != blocks[start]:
                    yield packed(at, held)
                    held = []
                at = int(blocks[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield packed(at, held)

    return run


def _blocks(batches):
    """Parts in order of blocks and kinds to ``bin, block, names, chain, known, sent``: the opponents' ratings by the round before, and what was sent of the own ones."""
    at, names, chain, known, sent = None, None, None, None, None
    for batch in batches:
        for bin_, block, kind, data in zip(*(batch.column(c) for c in ("bin", "block", "kind", "data")), strict=True):
            if at is not None and at[1] != block.as_py():
                yield *at, names, chain, known, sent
            at = bin_.as_py(), block.as_py()
            if kind.as_py() == NAMES:
                names = pa.ipc.open_stream(data.as_buffer()).read_all()
                continue
            part = _unpacked(data.as_buffer())
            if kind.as_py() == CHAIN:
                chain = part
                known, sent = np.full(len(chain["days"]), INITIAL), np.full(len(chain["days"]), np.nan)
            elif kind.as_py() == STATE:
                known, sent = part["known"].copy(), part["sent"]
            else:
                known[part["at"]] = part["rating"]
    if at is not None:
        yield *at, names, chain, known, sent


def _fold_chains(size: int, schema: T.StructType | None):
    """A bin's blocks to what their next round starts from and the changes for the opponents' blocks, or with a schema to rated rows."""

    def run(batches):
        rating = after = INITIAL
        left: dict = {}
        for bin_, block, names, chain, known, sent in _blocks(batches):
            days = chain["days"].tolist()
            left.update((d, 0.5 ** (d / HALF_LIFE)) for d in set(days) - left.keys())
            raw, own, chances, new = [], [], [], []
            for d, step, blue, won, other in zip(days, *(chain[c].tolist() for c in ("step", "first", "result")), known.tolist(), strict=True):
                if step:
                    rating = after = INITIAL if step == 2 else after
                mine = INITIAL + (rating - INITIAL) * left[d]
                chance = expected(mine, other) if blue else 1 - expected(other, mine)
                if won >= 0:
                    after = mine + K * (won - chance)
                own.append(mine)
                if schema is not None:
                    raw.append(rating)
                    chances.append(chance)
                    new.append(after if won >= 0 else None)
            if schema is not None:
                made = {c: names.column(c).combine_chunks() for c in names.column_names} | {"opponent_pre_fight_elo": pa.array(known)}
                made |= dict(zip(("pre_fight_elo", "time_decayed_elo", "elo_expected_win_prob", "post_elo"), (pa.array(x, pa.float64()) for x in (raw, own, chances, new)), strict=True))
                yield pa.RecordBatch.from_arrays([made[name] for name in schema.names], names=schema.names)
                continue
            now = np.array(own, float)
            changed = np.flatnonzero(now != sent)
            changed = changed[np.argsort(chain["other"][changed] // size, kind="stable")]
            to = chain["other"][changed]
            cuts = [0, *(np.flatnonzero(np.diff(to // size)) + 1).tolist(), len(to)] if len(to) else [0]
            rows = [(bin_, block, STATE, _packed({"known": known, "sent": now}))]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(to[start]) >> BIN_BIT, int(to[start]) // size, CHANGES, _packed({"at": to[start:end] % size, "rating": now[changed[start:end]]})))
            yield _parts(rows)

    return run


def rate(rows: DataFrame, per_bin: int = PER_BIN, block: int = BLOCK) -> DataFrame:
    """Ratings before each bout, a row a side. A table of up to ``per_bin`` bouts is one stream; larger ones go in rounds, in blocks of ``block`` (a power of two) sides."""
    spark = rows.sparkSession
    ship(spark)
    pairs = materialize(bout_pairs(rows), "bouts")
    schema, bins = _schema(pairs), -(-pairs.count() // per_bin)
    if bins <= 1:
        return materialize(pairs.repartition(1).sortWithinPartitions("event_date", "fight_id").mapInArrow(_fold_all(schema), schema), "rated")
    bins = max(bins, spark.sparkContext.defaultParallelism)
    placed = materialize(_placed(pairs, bins), "sides")
    bin_ = F.shiftright("place", BIN_BIT).cast("int")
    met = materialize(placed.withColumns({"other": F.sum("place").over(Window.partitionBy("fight_id")) - F.col("place"), "bin": bin_}), "sides")
    blocks = materialize(_by_bin(met, bins, "place").mapInArrow(_pack(block), PARTS), "blocks")
    drop_scratch(placed)
    drop_scratch(met)
    chains, sent = blocks.where(F.col("kind") == CHAIN), None
    folded = lambda parts, form, kind: _by_bin(parts, bins, "block", "kind").mapInArrow(_fold_chains(block, form), kind)
    while True:
        following = materialize(folded(chains if sent is None else chains.unionByName(sent), None, PARTS), "round")
        if sent is not None:
            drop_scratch(sent)
        sent = following
        if sent.where(F.col("kind") == CHANGES).isEmpty():
            rated = materialize(folded(blocks.unionByName(sent), schema, schema), "rated")
            drop_scratch(sent)
            drop_scratch(blocks)
            return rated


def final_ratings(rated: DataFrame) -> DataFrame:
    """Each fighter's rating after the last decided bout, and the date of the last bout."""
    last = F.max(F.when(F.col("post_elo").isNotNull(), F.struct("event_date", "fight_id", "post_elo")))
    return rated.groupBy("fighter_id").agg(F.coalesce(last["post_elo"], F.lit(INITIAL)).alias("rating"), F.max("event_date").alias("last_date"))


def snapshot(rated: DataFrame, as_of) -> DataFrame:
    """Ratings as they stand before ``as_of`` (a date or a column), decayed to it."""
    when = F.lit(as_of).cast("date")
    state = final_ratings(rated.where(F.col("event_date") < when))
    left = F.pow(F.lit(0.5), F.greatest(F.datediff(when, "last_date"), F.lit(0)) / HALF_LIFE)
    return state.withColumn("decayed_rating", INITIAL + (F.col("rating") - INITIAL) * left)
