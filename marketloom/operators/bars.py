"""Daily bars: scalers, look-back windows and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

SCALED = ["open", "high", "low", "close", "turnover"]
EPSILON = 1e-9


def _bounds(x: Column, fits: Column, name: str) -> list[Column]:
    value = F.when(fits, x)
    lo, hi = F.coalesce(F.min(value), F.lit(0.0)), F.coalesce(F.max(value), F.lit(1.0))
    return [lo.alias(f"{name}_lo"), F.when(hi <= lo, lo + EPSILON).otherwise(hi).alias(f"{name}_hi")]


def fit_scaler(bars: DataFrame, fits: Column) -> DataFrame:
    """One row a symbol: bounds of prices, turnover and log volume, mean and deviation of pct_change, n_fit.

    Only rows where ``fits`` holds count; symbols without any are left out.  One partial aggregation, so a symbol
    with many rows is combined before the shuffle.
    """
    columns = [c for f in SCALED for c in _bounds(F.col(f), fits, f)] + _bounds(S.log_volume(F.col("volume")), fits, "volume")
    change = F.when(fits, F.col("pct_change"))
    deviation = F.stddev_pop(change)
    columns += [F.coalesce(F.avg(change), F.lit(0.0)).alias("pct_mean"), F.when((F.count(change) < 2) | (deviation < 1e-12), F.lit(1.0)).otherwise(deviation).alias("pct_std")]
    return bars.groupBy("symbol").agg(*columns, F.count(F.when(fits, 1)).alias("n_fit")).filter("n_fit > 0")


def normalize(bars: DataFrame, scaler: DataFrame) -> DataFrame:
    """``bars`` with columns n_* scaled by their symbol's scaler (not clipped); symbols without scaler drop out."""
    out = {f"n_{f}": S.min_max(F.col(f), F.col(f"{f}_lo"), F.col(f"{f}_hi")) for f in SCALED}
    out["n_volume"] = S.min_max(S.log_volume(F.col("volume")), F.col("volume_lo"), F.col("volume_hi"))
    out["n_pct_change"] = (F.col("pct_change") - F.col("pct_mean")) / F.col("pct_std")
    return bars.join(scaler, "symbol").withColumns(out).drop(*[c for c in scaler.columns if c != "symbol"])


def ordered() -> Window:
    return Window.partitionBy("symbol").orderBy("trade_date")


def indexed(bars: DataFrame) -> DataFrame:
    """With k (row number from 1) and n (rows) of the symbol's series."""
    return bars.withColumns({"k": F.row_number().over(ordered()), "n": F.count("*").over(Window.partitionBy("symbol"))})


def look_back(bars: DataFrame, rows: int, with_anchor: bool, *fields: str, **made: Column) -> DataFrame:
    """With ``window``: the last ``rows`` rows (with or without the present one), oldest first, as structs.

    ``made`` names further arrays: of an expression of each row, computed once a row and not once a window.  It must not
    be null.  Expects ``indexed`` bars; rows with fewer rows behind them drop out.
    """
    frame = ordered().rowsBetween(-(rows - 1), 0) if with_anchor else ordered().rowsBetween(-rows, -1)
    least = rows if with_anchor else rows + 1
    collected = {"window": F.collect_list(F.struct(*fields)).over(frame)} | {n: F.collect_list(f"_{n}").over(frame) for n in made}
    return bars.withColumns({f"_{n}": c for n, c in made.items()}).withColumns(collected).drop(*[f"_{n}" for n in made]).filter(F.col("k") >= least)


def horizon_labels(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """With label_h for each horizon in rows: up if that later close isn't below the present one."""
    return bars.withColumns({f"label_{h}": S.direction_between(F.col("close"), F.lead("close", h).over(ordered())) for h in horizons})


def recent(bars: DataFrame, rows: int = 7) -> DataFrame:
    """The last ``rows`` rows of each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return bars.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= rows).drop("_r")


def _state(frame: Window | None) -> dict[str, Column]:
    """The scaler's sufficient statistics, of a group or over a window's frame."""
    over = (lambda c: c) if frame is None else (lambda c: c.over(frame))
    out = {"n_fit": over(F.count("*"))}
    for f in [*SCALED, "volume"]:
        x = S.log_volume(F.col("volume")) if f == "volume" else F.col(f)
        out |= {f"{f}_min": over(F.min(x)), f"{f}_max": over(F.max(x))}
    n = over(F.count("pct_change"))
    return out | {"moments": F.struct(n.alias("n"), F.coalesce(over(F.avg("pct_change")), F.lit(0.0)).alias("mean"), F.coalesce(over(F.var_pop("pct_change")) * n, F.lit(0.0)).alias("m2"))}


def merged_moments(a: Column, b: Column) -> Column:
    """Number, mean and sum of squared deviations of two sets of values together (Chan's rule)."""
    n = a["n"] + b["n"]
    share, apart = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0)), b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))


def expanding_scalers(bars: DataFrame) -> DataFrame:
    """For each row of ``bars`` the scaler fitted on its symbol's rows before it, as ``fit_scaler`` would (symbol,
    trade_date, ...); rows with none before them drop out.

    One pass over the bars: blocks (symbol, month) have mergeable statistics; a row's are those of the blocks before its
    own, merged along the symbol's months, and of the rows before it in its block.
    """
    blocked = bars.withColumn("_block", F.trunc("trade_date", "month"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    names = [f"{f}_{end}" for f in [*SCALED, "volume"] for end in ("min", "max")]

    totals = blocked.groupBy("symbol", "_block").agg(*[c.alias(n) for n, c in _state(None).items()])
    before = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: (F.min if n.endswith("_min") else F.max)(n).over(before) for n in names} | {"n_fit": F.coalesce(F.sum("n_fit").over(before), F.lit(0)), "_earlier": F.collect_list("moments").over(before)}
    carry = totals.select("symbol", "_block", *[c.alias(f"c_{n}") for n, c in carried.items()]).withColumn("c_moments", F.aggregate("c__earlier", none, merged_moments)).drop("c__earlier")

    within = Window.partitionBy("symbol", "_block").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.select("symbol", "_block", "trade_date", *[c.alias(n) for n, c in _state(within).items()])
    rows = own.join(carry, ["symbol", "_block"]).withColumns({"n_fit": F.col("n_fit") + F.col("c_n_fit"), "moments": merged_moments(F.col("c_moments"), F.col("moments"))}).filter("n_fit > 0")
    columns = []
    for f in [*SCALED, "volume"]:
        lo, hi = F.coalesce(F.least(f"{f}_min", f"c_{f}_min"), F.lit(0.0)), F.coalesce(F.greatest(f"{f}_max", f"c_{f}_max"), F.lit(1.0))
        columns += [lo.alias(f"{f}_lo"), F.when(hi <= lo, lo + EPSILON).otherwise(hi).alias(f"{f}_hi")]
    m = F.col("moments")
    deviation = F.sqrt(m["m2"] / m["n"])
    columns += [F.when(m["n"] > 0, m["mean"]).otherwise(F.lit(0.0)).alias("pct_mean"), F.when((m["n"] < 2) | (deviation < 1e-12), F.lit(1.0)).otherwise(deviation).alias("pct_std")]
    return rows.select("symbol", "trade_date", *columns, "n_fit")
