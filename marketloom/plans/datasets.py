"""The datasets: windows of bars with labels, joined to dated texts, with prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scalars as S
from ..operators import asof, bars as B

FIELDS = ["trade_date", "amplitude", *[f"n_{f}" for f in ("open", "high", "low", "close", "volume", "pct_change", "turnover")]]


def half_open(start: str, before: str) -> Column:
    day = F.col("trade_date")
    return (day >= F.to_date(F.lit(start))) & (day < F.to_date(F.lit(before)))


def closed(start: str, end: str) -> Column:
    return F.col("trade_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))


def scaled(bars: DataFrame, fits: Column) -> DataFrame:
    """Indexed bars with n_* columns, scaled over the rows where ``fits`` holds."""
    return B.indexed(B.normalize(bars, B.fit_scaler(bars, fits)))


def walk_forward(bars: DataFrame, start: str) -> Column:
    """For callers who want no later rows in the scaler: fit on rows before ``start``."""
    return F.col("trade_date") < F.to_date(F.lit(start))


def kline7(bars: DataFrame, start: str, before: str, kind: str = "train", fits: Column | None = None) -> DataFrame:
    """symbol, trade_date, window (7 rows before the label row), label and prompt; label days in [start, before)."""
    inside = half_open(start, before)
    rows = B.look_back(scaled(bars, inside if fits is None else fits), 7, False, *FIELDS, days=P.day_text()).filter(inside & (F.col("n") >= 8))
    out = rows.withColumn("label", S.direction(F.col("pct_change"))).filter("label is not null")
    return out.select("symbol", "trade_date", "window", "label", P.week_prompt(F.col("days"), kind).alias("prompt"))


def horizon_samples(bars: DataFrame, look_back: int, inside: Column, fits: Column, **made: Column) -> DataFrame:
    """Anchors with look_back rows up to and with them, 7 rows after them, and labels 1, 3 and 7 rows ahead."""
    labelled = B.horizon_labels(scaled(bars, fits))
    rows = B.look_back(labelled, look_back, True, *FIELDS, **made).filter((F.col("k") <= F.col("n") - 7) & inside)
    return rows.dropna(subset=["label_1", "label_3", "label_7"])


def kline7_horizons(bars: DataFrame, start: str, before: str) -> DataFrame:
    rows = horizon_samples(bars, 7, half_open(start, before), half_open(start, before), days=P.day_text())
    return rows.select("symbol", "trade_date", "window", P.week_prompt(F.col("days"), "horizons").alias("prompt"), F.concat_ws("，", "label_1", "label_3", "label_7").alias("future_1_3_7_trade_day_labels"))


def stored_bar() -> Column:
    """A normalised bar as it is stored: 4 places, 0 for missing values."""
    fields = [S.round4(F.col(f"n_{f}")).alias(f) for f in ("open", "high", "low", "close", "volume")]
    return F.struct("trade_date", *fields, S.round4(F.col("amplitude").try_cast("double")).alias("amplitude"), S.round4(F.col("n_pct_change")).alias("pct_change"), S.round4(F.col("n_turnover")).alias("turnover"))


def items_as(items: Column, text: str) -> Column:
    return F.transform(items, lambda x: F.struct(x["item_date"].alias("date"), x["title"].alias("title"), x["url"].alias("url"), x[text].alias(text)))


def kline5_text(bars: DataFrame, news: DataFrame, reports: DataFrame, start: str, end: str, n_news: int = 30, n_reports: int = 3, max_age_days: int = 30) -> DataFrame:
    """The multi-source set: five days, news and report summaries of the last 30 days, labels for three horizons."""
    rows = horizon_samples(bars, 5, closed(start, end), closed(start, end), kline_5d=stored_bar()).select("symbol", F.col("trade_date").alias("day"), "kline_5d", F.concat_ws("，", "label_1", "label_3", "label_7").alias("future_1_3_7_trade_day_labels"))
    with_news = asof.topk_asof(rows, news, n_news, max_age_days).withColumnRenamed("items", "news")
    both = asof.topk_asof(with_news, reports, n_reports, max_age_days)
    return both.select(F.col("day").alias("date"), F.col("symbol").alias("stock"), "kline_5d", items_as(F.col("news"), "summary").alias("news"), items_as(F.col("items"), "summary").alias("reports"), "future_1_3_7_trade_day_labels")


def daily_text(symbols: DataFrame, news: DataFrame, reports: DataFrame, start: str, end: str, n_news: int = 10, n_reports: int = 3) -> DataFrame:
    """The daily text set: every symbol and calendar day with its newest news and reports so far."""
    grid = asof.calendar_grid(symbols, start, end)
    both = asof.topk_asof(asof.topk_asof(grid, news, n_news).withColumnRenamed("items", "news"), reports, n_reports)
    return both.select(F.col("symbol").alias("stock"), F.col("day").alias("time"), items_as(F.col("news"), "content").alias("news"), items_as(F.col("items"), "content").alias("reports"))


def encoded(df: DataFrame) -> DataFrame:
    """Arrays as JSON text, for the CSV boundary."""
    return df.withColumns({n: F.to_json(n, {"ignoreNullFields": "false"}) for n, t in df.dtypes if t.startswith("array")})


def snapshot(comments: DataFrame, news: DataFrame, reports: DataFrame, quotes: DataFrame, results: DataFrame, symbol: str) -> DataFrame:
    """One row: a symbol's newest comments (50), news (10), reports (3), bars (7, oldest first) and search results
    (3 a query)."""
    own = lambda df: df.filter(F.col("symbol") == symbol)

    def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
        top = own(df).orderBy(*[F.desc(o) for o in order]).limit(n)
        fields = [F.col(o) for o in order] + [F.col(c) for c in df.columns if c not in order]
        return top.agg(F.reverse(F.array_sort(F.collect_list(F.struct(*fields)))).alias("x"))

    per_query = Window.partitionBy("query").orderBy("position")
    found = own(results).withColumn("_r", F.row_number().over(per_query)).filter("_r <= 3").drop("_r")
    parts = {
        "comments": newest(comments, 50, "publish_time", "url"),
        "news": newest(news, 10, "date", "url"),
        "reports": newest(reports, 3, "date", "url"),
        "kline": newest(quotes, 7, "trade_date").select(F.reverse("x").alias("x")),
        "serp": found.agg(F.array_sort(F.collect_list(F.struct("query", "position", *[c for c in results.columns if c not in ("query", "position")]))).alias("x")),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumnRenamed("x", name)
        out = part if out is None else out.join(part)  # one row each
    return out.select(F.lit(symbol).alias("stock"), *parts)
