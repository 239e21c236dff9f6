"""As-of features: what was known strictly before a bout's date.

One RANGE window per fighter, ending the day before, gives every additive feature in a single sort; rows of the same date
never see each other. What the last N bouts tell is summed over N rows by rank first, and the as-of value is that of the last
row before the date, so no row carries a list of the rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(key: str = "fighter_id", date: str = "event_date"):
    """All rows of the same key on strictly earlier dates."""
    return Window.partitionBy(key).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)


#: A column of day numbers. Rows that have it are ordered by it in all windows, so that one sort serves them all; an expression would be sorted by anew in each.
DAY = "__day"


def _earlier(rows: DataFrame):
    """:func:`before` of a fighter's rows."""
    return Window.partitionBy("fighter_id").orderBy(DAY).rangeBetween(Window.unboundedPreceding, -1) if DAY in rows.columns else before()


def fight_seconds(round_: Column, seconds: Column) -> Column:
    return (round_ - 1) * 300 + seconds


def _won() -> Column:
    return F.coalesce(F.col("winner_flag"), F.lit(False))


def _record(rows: DataFrame) -> dict[str, Column]:
    h = _earlier(rows)
    count = lambda c: F.coalesce(F.sum(c.cast("long")).over(h), F.lit(0)).cast("long")
    return {
        "prior_fights": F.count(F.lit(1)).over(h), "prior_wins": count(_won()), "prior_losses": count(F.col("outcome") == "L"),
        "prior_draws": count(F.col("outcome") == "D"), "prior_nc": count(F.col("outcome") == "NC"),
    }


def prior_record(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_record(rows))


def _method_wins(rows: DataFrame) -> dict[str, Column]:
    h, method = _earlier(rows), F.upper(F.coalesce(F.col("method"), F.lit("")))
    tests = {"wins_by_ko_tko": method.contains("KO") | method.contains("TKO"), "wins_by_sub": method.contains("SUB"), "wins_by_dec": method.contains("DEC")}
    return {k: F.coalesce(F.sum((_won() & t).cast("long")).over(h), F.lit(0)) for k, t in tests.items()}


def method_wins(rows: DataFrame) -> DataFrame:
    """Wins by how the method's name reads; a bout may count in several."""
    return rows.withColumns(_method_wins(rows))


def _averages(rows: DataFrame, columns: dict[str, str]) -> dict[str, Column]:
    return {name: F.avg(c).over(_earlier(rows)) for name, c in columns.items()}


def averages(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Means of earlier values that are known; null if none is. ``columns``: feature name -> column."""
    return rows.withColumns(_averages(rows, columns))


def _rates(rows: DataFrame, columns: dict[str, tuple[str, int]]) -> dict[str, Column]:
    h = _earlier(rows)
    minutes = F.sum("fight_sec").over(h) / 60
    return {name: F.when(minutes > 0, F.sum(c).over(h) / minutes * by) for name, (c, by) in columns.items()}


def rates(rows: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Totals by time: feature name -> (column, minutes). The time is that of all earlier bouts, also those without the value."""
    return rows.withColumns(_rates(rows, columns))


def _recency(rows: DataFrame) -> dict[str, Column]:
    return {"days_since_last_fight": F.datediff("event_date", F.max("event_date").over(_earlier(rows)))}


def recency(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_recency(rows))


def age_years(dob: Column, date: Column) -> Column:
    return F.round(F.datediff(date, dob) / 365.25, 3)


def uncertainty(prior_fights: Column, days: Column) -> tuple[Column, Column]:
    """1/sqrt(n+1), and a deviation that shrinks with bouts and grows with years away, from 70 to 350."""
    root = F.sqrt(prior_fights + 1)
    years = F.least(F.coalesce(days, F.lit(0)) / 365.25, F.lit(3.0))
    return 1 / root, F.greatest(F.lit(70.0), F.least(F.lit(350.0), 350 / root + years * 20))


def _last(rows: DataFrame, values: dict[str, tuple[int, Column]], more: dict[str, Column] | None = None) -> DataFrame:
    """Means of values (where they are known) over the last n earlier bouts by date and bout; null if they are known in none. ``values``: name -> (n, value).

    ``more``: columns over :func:`_earlier`, made in the window that takes the means to the later rows.
    """
    order = Window.partitionBy("fighter_id").orderBy(DAY if DAY in rows.columns else "event_date", "fight_id")
    ending_here = lambda n, value: F.struct("event_date", "fight_id", F.avg(value).over(order.rowsBetween(1 - n, Window.currentRow)).alias("mean"))
    rows = rows.withColumns({name: ending_here(n, value) for name, (n, value) in values.items()})
    return rows.withColumns({name: F.max(name).over(_earlier(rows))["mean"] for name in values} | (more or {}))


def _decided_win() -> Column:
    return F.when(F.col("outcome").isin("W", "L"), _won().cast("double"))


def recent_win_rate(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Share of wins among those of the last n that were won or lost; null if none was."""
    return _last(rows, {name: (n, _decided_win())})


def recent_mean(rows: DataFrame, n: int, column: str, name: str) -> DataFrame:
    return _last(rows, {name: (n, F.col(column).cast("double"))})


def _quality(rows: DataFrame) -> dict[str, Column]:
    h, elo = _earlier(rows), F.col("opponent_pre_fight_elo")
    return {
        "avg_opponent_pre_fight_elo": F.avg(elo).over(h), "best_win_opponent_pre_fight_elo": F.max(F.when(_won(), elo)).over(h),
        "worst_loss_opponent_pre_fight_elo": F.min(F.when(F.col("outcome") == "L", elo)).over(h),
    }


def opponent_quality(rows: DataFrame) -> DataFrame:
    """From ``opponent_pre_fight_elo``: mean, mean of the last 3, best beaten, worst lost to."""
    return recent_mean(rows.withColumns(_quality(rows)), 3, "opponent_pre_fight_elo", "recent_3_opponent_pre_fight_elo")


#: Names of the features of one side, in their order.
FEATURES = (
    "prior_fights prior_wins prior_losses prior_draws prior_nc days_since_last_fight age_years height_in reach_in wins_by_ko_tko wins_by_sub wins_by_dec"
    " avg_fight_time_sec avg_sig_str_landed avg_sig_str_absorbed avg_td_landed avg_td_attempted avg_sub_attempts avg_ctrl_sec"
    " sig_str_landed_per_min sig_str_absorbed_per_min td_landed_per_15min td_attempted_per_15min sub_attempts_per_15min ctrl_sec_per_min"
    " pre_fight_elo time_decayed_elo elo_expected_win_prob elo_uncertainty glicko_like_rd"
    " avg_opponent_pre_fight_elo recent_3_opponent_pre_fight_elo best_win_opponent_pre_fight_elo worst_loss_opponent_pre_fight_elo recent_3_win_rate recent_5_win_rate"
).split()
AVERAGES = {
    "avg_fight_time_sec": "fight_sec", "avg_sig_str_landed": "sig_str_landed", "avg_sig_str_absorbed": "sig_str_absorbed", "avg_td_landed": "td_landed",
    "avg_td_attempted": "td_attempted", "avg_sub_attempts": "sub_att", "avg_ctrl_sec": "ctrl_sec",
}
RATES = {
    "sig_str_landed_per_min": ("sig_str_landed", 1), "sig_str_absorbed_per_min": ("sig_str_absorbed", 1), "td_landed_per_15min": ("td_landed", 15),
    "td_attempted_per_15min": ("td_attempted", 15), "sub_attempts_per_15min": ("sub_att", 15), "ctrl_sec_per_min": ("ctrl_sec", 1),
}


def features(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """All of ``FEATURES`` for every side: bout rows with bio columns (dob, height_in, reach_in), and their ratings before the bout.

    All windows partition by fighter and order by date, so the rows are shuffled once after the join.
    """
    rows = rows.join(rated.select("fight_id", "fighter_id", "pre_fight_elo", "time_decayed_elo", "elo_expected_win_prob", "opponent_pre_fight_elo"), ["fight_id", "fighter_id"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(1500.0)) for c in ("pre_fight_elo", "time_decayed_elo")})
    return _windows(rows).drop(DAY)


def _windows(rows: DataFrame) -> DataFrame:
    """Windows by rank come first: they sort by fighter, date and bout, which serves all others too, so a task holds one sort buffer. ``DAY`` stays for more windows.

    All columns over earlier dates are made at once, so that rows are copied from window to window as seldom as possible.
    """
    rows = rows.withColumn(DAY, F.unix_date("event_date"))
    last = {"recent_3_win_rate": (3, _decided_win()), "recent_5_win_rate": (5, _decided_win()), "recent_3_opponent_pre_fight_elo": (3, F.col("opponent_pre_fight_elo").cast("double"))}
    rows = _last(rows, last, _quality(rows) | _record(rows) | _recency(rows) | _method_wins(rows) | _averages(rows, AVERAGES) | _rates(rows, RATES))
    doubt, deviation = uncertainty(F.col("prior_fights"), F.col("days_since_last_fight"))
    return rows.withColumns({"elo_uncertainty": doubt, "glicko_like_rd": deviation, "age_years": age_years(F.col("dob"), F.col("event_date"))})


def future_features(rows: DataFrame, rated: DataFrame, future: DataFrame) -> DataFrame:
    """The features of both sides of bouts that are still to come (see :func:`with_future`), by the same windows.

    Ratings are those after the last decided bout, decayed to the date; bio columns come from ``future`` (red_dob and so on) if
    it has them.
    """
    both = with_future(rows, future)
    both = both.join(rated.select("fight_id", "fighter_id", "opponent_pre_fight_elo", "post_elo"), ["fight_id", "fighter_id"], "left")
    both = _windows(both)
    h = _earlier(both)
    last = F.max(F.when(F.col("post_elo").isNotNull(), F.struct("event_date", "fight_id", "post_elo"))).over(h)
    days = F.datediff("event_date", F.max("event_date").over(h))
    both = both.withColumn("pre_fight_elo", F.coalesce(last["post_elo"], F.lit(1500.0)))
    both = both.withColumn("time_decayed_elo", 1500.0 + (F.col("pre_fight_elo") - 1500.0) * F.pow(F.lit(0.5), F.coalesce(days, F.lit(0)) / 730.0)).drop(DAY).where("is_future")
    other = F.sum("time_decayed_elo").over(Window.partitionBy("fight_id")) - F.col("time_decayed_elo")
    return both.withColumn("elo_expected_win_prob", 1 / (1 + F.pow(F.lit(10.0), (other - F.col("time_decayed_elo")) / 400)))


def matchups(rows: DataFrame, features: list[str], keep: list[str] = ("event_date",), sides: list[str] = ()) -> DataFrame:
    """One row a bout: red and blue features and their difference, and both sides' ``sides``; one grouping instead of a self-join."""
    side = lambda corner, c: F.max(F.when(F.col("corner") == corner, F.col(c)))
    made = [side(s, c).alias(f"{s}_{c}") for s in ("red", "blue") for c in ("fighter_id", *sides, *features)]
    wide = rows.groupBy("fight_id").agg(*[F.first(c).alias(c) for c in keep], *made)
    return wide.withColumns({f"delta_{c}": F.col(f"red_{c}") - F.col(f"blue_{c}") for c in features})


def with_future(rows: DataFrame, future: DataFrame) -> DataFrame:
    """Base rows and two synthetic rows for each future bout (fight_id, event_date, red_id, blue_id), so both take one path."""
    sides = [
        future.select(
            F.col("fight_id"), F.col("event_date"), F.lit(c).alias("corner"), F.col(f"{c}_id").alias("fighter_id"), F.col(f"{o}_id").alias("opponent_id"), F.lit(True).alias("is_future"),
            *[F.col(f"{c}_{x}").alias(x) for x in ("dob", "height_in", "reach_in") if f"{c}_{x}" in future.columns],
        )
        for c, o in (("red", "blue"), ("blue", "red"))
    ]
    return rows.withColumn("is_future", F.lit(False)).unionByName(sides[0].unionByName(sides[1]), allowMissingColumns=True)


def missing_fighters(future: DataFrame, fighters: DataFrame) -> DataFrame:
    """Fighter ids of future bouts that no fighter has."""
    ids = future.select(F.col("red_id").alias("fighter_id")).union(future.select("blue_id")).distinct()
    return ids.join(fighters, "fighter_id", "left_anti")
