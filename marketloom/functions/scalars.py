"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UP, DOWN, FAILED = "涨", "跌", "提取失败"


def strip_u(x: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def number(x: Column) -> Column:
    """A double; empty, unreadable and NaN become null."""
    value = F.nullif(strip_u(x.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_date10(x: Column) -> Column:
    """The date in the first ten characters (or a compact yyyyMMdd), else null."""
    head = F.left(strip_u(x.cast("string")), F.lit(10))
    dashed = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("1"))
    compact = F.when(head.rlike(r"^\d{8}$"), F.expr("1"))
    return F.when(dashed.isNotNull(), F.try_to_date(head, "yyyy-MM-dd")).when(compact.isNotNull(), F.try_to_date(head, "yyyyMMdd"))


def calendar_day(x: Column) -> Column:
    """The calendar day of a timestamp's text as text; '' if it has none."""
    return F.coalesce(F.date_format(parse_date10(x), "yyyy-MM-dd"), F.lit(""))


def direction(change: Column) -> Column:
    """Up for a change of 0 or more, else down; null for null and NaN."""
    return F.when(change.isNull() | F.isnan(change), F.lit(None)).when(change >= 0, F.lit(UP)).otherwise(F.lit(DOWN))


def direction_between(now: Column, then: Column) -> Column:
    """Up if the later close isn't below the present one."""
    return F.when(now.isNotNull() & then.isNotNull(), F.when(then >= now, F.lit(UP)).otherwise(F.lit(DOWN)))


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    return (x - lo) / (hi - lo)


def log_volume(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def exact4(x: Column) -> Column:
    """The double nearest to x rounded to 4 places by its exact value, ties to even (Spark's own rounding goes by the
    shortest decimal, ties away from 0).  What the product loses is found by splitting x (Dekker)."""
    y = x * 1e4
    whole = F.floor(y).cast("double")
    split = x * 134217729.0
    high = split - (split - x)
    lost = (high * 1e4 - y) + (x - high) * 1e4
    part = y - whole
    up = F.when(part != 0.5, part > 0.5).when(lost != 0, lost > 0).otherwise(whole % 2 != 0)
    near = (whole + F.when(up, 1.0).otherwise(0.0)) / 1e4
    return F.when(F.abs(x) < 1e11, F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)).otherwise(x)


def near_tie(x: Column) -> Column:
    """Whether x lies so near the middle of two values of 4 places that Spark's own rounding may be off."""
    y = x * 1e4
    return F.abs(y - F.floor(y) - 0.5) < 1e-6 + F.abs(y) * 1e-15


def round4(x: Column) -> Column:
    """Rounded to 4 places, 0 for null."""
    return F.coalesce(F.when(near_tie(x), exact4(x) + F.lit(0.0)).otherwise(F.round(x, 4)), F.lit(0.0))


def fmt4(x: Column, form: str = "%.4f") -> Column:
    return F.when(x.isNull(), F.lit("N/A")).when(near_tie(x), F.format_string(form, exact4(x))).otherwise(F.format_string(form, x))


def fmt_signed4(x: Column) -> Column:
    return fmt4(x, "%+.4f")


def plain_decimal(x: Column) -> Column:
    """A number's text without exponent and trailing zeros ('' for zero is '0')."""
    text = F.when(x.rlike("[eE]"), x.try_cast("decimal(38,18)").cast("string")).otherwise(x)
    text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(text.isin("", "-", "-0"), F.lit("0")).otherwise(text)


def fmt_amplitude(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("N/A")).otherwise(plain_decimal(x.cast("string")))


def fmt_number(x: Column) -> Column:
    """Text of a number for interchange: integers under 1e12 without decimals, others with six, zeros stripped."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e12)
    return F.when(x.isNull(), F.lit("")).when(whole, x.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", ""))


def truncated_int(x: Column) -> Column:
    """int(float(x)); 0 if unreadable."""
    value = number(x)
    return F.coalesce(F.when(F.abs(value) < 9e18, value).cast("bigint"), F.lit(0).cast("bigint"))


def pages_of(n: Column, per_page: int = 80) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n / per_page))


def page_count(linked: Column, n: Column, per_page: int = 80) -> Column:
    """The number of pages of a list: the largest page it links to, else by its count of rows, else 1."""
    return F.coalesce(F.array_max(linked).cast("bigint"), pages_of(n, per_page), F.lit(1).cast("bigint"))


def ellipsis(x: Column, limit: int) -> Column:
    """Stripped text cut to ``limit`` characters, right-stripped and marked."""
    text = strip_u(F.coalesce(x, F.lit("")))
    cut = F.regexp_replace(F.left(text, F.lit(limit)), r"(?U)\s+$", "")
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("……")))


def preview(x: Column, head: int = 400, tail: int = 500) -> Column:
    return F.struct(F.left(x, F.lit(head)).alias("head"), F.right(x, F.lit(tail)).alias("tail"))


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def url_absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def url_date(url: Column, any_case: bool = True) -> Column:
    """Date in an article's URL (/a/yyyyMMdd....html), else null."""
    found = F.regexp_extract(url, ("(?i)" if any_case else "") + r"/a/(\d{8})\d*\.html", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "yyyyMMdd")


def is_mainland(symbol: Column, market: Column) -> Column:
    return (market == "a") & symbol.rlike("^[0-9]{6}$")


def exchange(symbol: Column) -> Column:
    return F.when(F.substring(symbol, 1, 1).isin("6", "9"), F.lit("SH")).otherwise(F.lit("SZ"))


def prefixed_symbol(symbol: Column) -> Column:
    return F.concat(F.lower(exchange(symbol)), symbol)


def suffixed_symbol(symbol: Column) -> Column:
    return F.concat(symbol, F.lit("."), exchange(symbol))


def vendor_symbol(symbol: Column, market: Column) -> Column:
    """The vendor's form of a mainland symbol; others are an error."""
    return F.when(is_mainland(symbol, market), prefixed_symbol(symbol)).otherwise(F.raise_error(F.concat(F.lit("no vendor form of "), F.coalesce(symbol, F.lit("null")))).cast("string"))


def endpoint(market: Column) -> Column:
    """The vendor's service for a market's daily bars (fixed values)."""
    return F.when(market == "a", F.lit("stock_zh_a_hist")).otherwise(F.lit("stock_hk_hist"))


def upper_symbol(symbol: Column) -> Column:
    return F.upper(strip_u(symbol))


def company_key(sector: Column, name: Column, symbol: Column, market: Column) -> Column:
    return F.concat(sector, F.lit("/"), name, F.lit("("), symbol, F.when(market == "hk", F.lit(".HK")).otherwise(F.lit("")), F.lit(")"))


def one_line(x: Column) -> Column:
    return strip_u(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " "))


def jsonp_body(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?s)var\s+\w+\s*=\s*(\{.*\})", 1), F.lit(""))


def content_kind(path: Column) -> Column:
    return F.when(path.startswith("news/"), F.lit("news")).otherwise(F.lit("report"))
