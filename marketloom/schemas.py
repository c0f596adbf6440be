"""Table schemas, required columns and column aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text columns of the interchange files, in their order; all are read as strings.
QUOTES = ["symbol", "trade_date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change_amount", "turnover"]
NEWS = ["url", "symbol", "title", "date"]
REPORT = ["url", "symbol", "title", "date", "content"]
COMMENTS = ["url", "post_id", "symbol", "post_title", "publish_time", "click_count", "comment_count"]
TABLES = {"quotes": QUOTES, "news": NEWS, "report": REPORT, "comments": COMMENTS}
#: Keys on which rows of the tables are merged.
KEYS = {"quotes": ["symbol", "trade_date"], "news": ["url"], "report": ["url"], "comments": ["url"]}

#: Names under which vendors deliver the columns of quotes, best first.
QUOTE_ALIASES = {
    "trade_date": ["日期", "date", "trade_date"],
    "open": ["开盘", "open"],
    "close": ["收盘", "close"],
    "high": ["最高", "high"],
    "low": ["最低", "low"],
    "volume": ["成交量", "volume", "vol"],
    "amount": ["成交额", "amount"],
    "amplitude": ["振幅", "amplitude"],
    "pct_change": ["涨跌幅", "pct_change", "pct_chg"],
    "change_amount": ["涨跌额", "change_amount", "change"],
    "turnover": ["换手率", "turnover"],
}
QUOTES_REQUIRED = ["trade_date", "open", "close", "high", "low", "volume"]


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """``df`` itself, if it has all the columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def resolve_quotes(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """A vendor's frame as quotes: columns by alias, optional ones null, the symbol given or its column or empty."""
    found = {name: next((a for a in aliases if a in df.columns), None) for name, aliases in QUOTE_ALIASES.items()}
    missing = [n for n in QUOTES_REQUIRED if not found[n]]
    if missing:
        raise ValueError(f"vendor frame lacks columns: {', '.join(missing)}; it has {', '.join(df.columns)}")
    own = F.lit(symbol) if symbol is not None else F.col("symbol").cast("string") if "symbol" in df.columns else F.lit("")
    rest = [(F.col(f"`{found[n]}`") if found[n] else F.lit(None).cast("double")).alias(n) for n in QUOTES[1:]]
    return df.select(own.alias("symbol"), *rest)
