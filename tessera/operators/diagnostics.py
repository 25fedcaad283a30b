"""How a factor relates to a library of others, to market regimes, and to its own mechanism.

The library is long: book (trade_date, symbol, factor_id, value). Peers are a column, so one pass compares the
candidate with all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators.cross_section import daily_corr, paired
from tessera.operators.neutral import incremental_r2, residual_of_peers
from tessera.operators.panel import KEYS

CROWDED_ABOVE = 0.7


def _with_peers(candidate: DataFrame, book: DataFrame) -> DataFrame:
    left = candidate.select(*KEYS, expr.finite(F.col("value")).alias("value")).where("value is not null")
    right = book.select(*KEYS, "factor_id", expr.finite(F.col("value")).alias("peer")).where("peer is not null")
    return left.join(right, KEYS)


def similarity(candidate: DataFrame, book: DataFrame, min_stocks: int = 30) -> DataFrame:
    """factor_id, mean_abs, max_abs, n_obs of the daily absolute rank correlations; the most similar first."""
    daily = daily_corr(_with_peers(candidate, book), "factor_id", "value", "peer", "spearman", min_stocks, "rho").where("rho is not null")
    found = daily.groupBy("factor_id").agg(F.avg(F.abs("rho")).alias("mean_abs"), F.max(F.abs("rho")).alias("max_abs"), F.count("*").alias("n_obs"))
    return found.orderBy(F.desc("mean_abs"), "factor_id")


def top_overlap(candidate: DataFrame, book: DataFrame, k: int, min_stocks: int = 30) -> DataFrame:
    """factor_id, overlap, n_obs: the mean share that the k highest, and the k lowest, of either factor have in common."""
    parts = ["trade_date", "factor_id"]
    rows = _with_peers(candidate, book)
    place = lambda c, down: F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc(c) if down else F.col(c), "symbol"))
    rows = rows.withColumns({"n": F.count("*").over(Window.partitionBy(*parts)), "vt": place("value", True), "vb": place("value", False), "pt": place("peer", True), "pb": place("peer", False)})
    rows = rows.where(F.col("n") >= min_stocks).withColumn("k", F.least(F.lit(k), F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    both = lambda a, b: F.count_if((F.col(a) <= F.col("k")) & (F.col(b) <= F.col("k")))
    daily = rows.groupBy(*parts).agg(((both("vt", "pt") + both("vb", "pb")) / (2 * F.max("k"))).alias("overlap"))
    return daily.groupBy("factor_id").agg(F.avg("overlap").alias("overlap"), F.count("*").alias("n_obs"))


def observed_ic(factor: DataFrame, returns: DataFrame, min_stocks: int = 30) -> DataFrame:
    """trade_date, horizon, ic on the dates with enough symbols and variation only."""
    return daily_corr(paired(factor, returns), "horizon", "value", "ret", "spearman", min_stocks).where("ic is not null").select("trade_date", "horizon", "ic")


def mean_t(daily: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    n = F.count(value)
    return daily.groupBy(*keys).agg(F.avg(value).alias("mean"), expr.naive_t(F.avg(value), F.stddev_samp(value), n).alias("t_stat"), n.alias("n_obs"))


def spanning(candidate: DataFrame, book: DataFrame, returns: DataFrame, topk: int = 5, rounds: int = 3, min_stocks: int = 30, keep=None, most_like: int = 5) -> tuple[list[dict], DataFrame]:
    """Round by round: the peers most like what is left of the candidate, the rank IC of what they leave, by horizon;
    and what is left in the end. Of the first round also the most_like peers, with how like they are.

    keep(df) cuts a round's lineage (a written table, or checkpoint()); the default is checkpoint().
    """
    keep = keep or (lambda df: df.checkpoint())
    left, done, found = candidate.select(*KEYS, "value"), [], []
    for number in range(1, rounds + 1):
        rest = book.where(~F.col("factor_id").isin(done)) if done else book
        similar = similarity(left, rest, min_stocks).limit(max(topk, most_like)).collect()
        peers = [r["factor_id"] for r in similar[:topk]]
        if not peers:
            break
        left = keep(residual_of_peers(left, book, peers, min_stocks))
        done += peers
        ic = {r["horizon"]: r.asDict() for r in mean_t(observed_ic(left, returns, min_stocks), ["horizon"], "ic").collect()}
        found.append({"round": number, "peers": peers, "ic": ic, "most_like": [(r["factor_id"], r["mean_abs"]) for r in similar[:most_like]]})
    return found, left


def spanned_r2(candidate: DataFrame, book: DataFrame, returns: DataFrame, peers: Sequence[str], min_stocks: int = 30) -> DataFrame:
    return mean_t(incremental_r2(candidate, book, returns, peers, min_stocks), ["horizon"], "r2")


def monotonicity(by_group: DataFrame) -> DataFrame:
    """horizon, monotonicity: rank correlation of group number and mean return; null below three groups."""
    means = by_group.groupBy("horizon", "group").agg(F.avg("group_return").alias("r")).where("r is not null")
    ranked = means.select("horizon", expr.average_rank(F.col("group"), ["horizon"]).alias("a"), expr.average_rank(F.col("r"), ["horizon"]).alias("b"))
    found = ranked.groupBy("horizon").agg(expr.safe_corr(F.col("a"), F.col("b")).alias("m"), F.count("*").alias("n"))
    return found.select("horizon", F.when(F.col("n") >= 3, F.col("m")).alias("monotonicity"))


def regime_ic(ic: DataFrame, regimes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """regime, horizon, ic_mean, n_obs over the dates whose flag is set."""
    flags = F.array(*[F.struct(F.lit(x).alias("regime"), F.col(x).alias("on")) for x in labels])
    on = regimes.select("trade_date", F.explode(flags).alias("_f")).where("_f.on").select("trade_date", "_f.regime")
    return ic.join(F.broadcast(on), "trade_date").groupBy("regime", "horizon").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n_obs"))


def sign_matches(mean: float | None, direction: str) -> bool | None:
    """Whether a mean has the sign of a hypothesis (high_is_long or high_is_short); None where either is unknown."""
    if mean is None or mean != mean or direction not in ("high_is_long", "high_is_short"):
        return None
    return mean > 0 if direction == "high_is_long" else mean < 0


def trading_days(factors: Sequence[DataFrame]) -> DataFrame:
    """start, end, n: the first, last and number of the dates that any of the factors has."""
    dates = reduce(lambda a, b: a.union(b), [df.select("trade_date") for df in factors]).distinct()
    return dates.agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count("trade_date").alias("n"))
