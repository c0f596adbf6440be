"""Scans of the interchange files.  All columns are read as text and typed by explicit expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.bars import recent
from ..operators.merge import filled, keep_first
from ..schemas import TABLES, resolve_quotes

UNIVERSE = "struct<sectors: map<string, array<struct<name: string, symbol: string, market: string>>>>"
RESULT = "struct<custom_id: string, error: string, response: struct<status_code: int, body: struct<choices: array<struct<message: struct<content: string>>>>>>"


def read_master(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A master table with its fixed fields, stripped: its current version, or a plain CSV file or folder at ``path``.

    Absent columns are '', an absent table is empty.
    """
    from .writers import master

    fields, known = TABLES[table], master(spark, path)
    raw = known.read()
    if raw is None and known.files.exists():
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    if raw is None:
        return spark.createDataFrame([], T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    return raw.select([(S.strip_u(F.coalesce(F.col(f"`{f}`"), F.lit(""))) if f in raw.columns else F.lit("")).alias(f) for f in fields])


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A training set from its CSV files (see ``writers.write_dataset``), typed by ``schema``; columns go by their names in
    the header.  Columns that the files lack, and values that don't fit, are null; a text that is null was written like one
    that is empty, so it is ''.  Line ends within values stay."""
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, emptyValue="", nullValue=None, lineSep="\r\n", enforceSchema=False)

    def typed(f: T.StructField) -> Column:
        if f.name not in raw.columns:
            return F.lit(None).cast(f.dataType)
        return F.coalesce(F.col(f"`{f.name}`"), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").try_cast(f.dataType)

    return raw.select([typed(f).alias(f.name) for f in wanted.fields])


def typed_quotes(raw: DataFrame, before: str | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Quotes with dates and doubles; blank keys and unreadable dates drop out.  ``before`` is exclusive."""
    numbers = [S.number(F.col(c)).alias(c) for c in ("open", "close", "high", "low", "volume", "amount", "pct_change", "change_amount", "turnover")]
    out = raw.select(F.col("symbol"), S.parse_date10(F.col("trade_date")).alias("trade_date"), F.nullif("amplitude", F.lit("")).alias("amplitude"), *numbers).filter((F.col("symbol") != "") & F.col("trade_date").isNotNull())
    if before:
        out = out.filter(F.col("trade_date") < F.to_date(F.lit(before)))
    return out.join(symbols, "symbol", "left_semi") if symbols is not None else out


def recent_quotes(vendor: DataFrame, today: str, rows: int = 7, days: int = 45, symbol: str | None = None) -> DataFrame:
    """The last ``rows`` bars of each symbol of a vendor's frame, of the ``days`` days up to the day before ``today``.

    Dates may be written with eight digits; what the vendor doesn't name is null.
    """
    bars = resolve_quotes(vendor, symbol)
    written = F.regexp_replace(F.col("trade_date").cast("string"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    last = F.date_sub(F.to_date(F.lit(today)), 1)
    dated = bars.withColumn("trade_date", S.parse_date10(written)).filter(F.col("trade_date").between(F.date_sub(last, days), last))
    return recent(dated, rows)


def listed_items(raw: DataFrame, symbols: DataFrame, since: str | None, keys: list[str] = ["url"]) -> DataFrame:
    """News or report rows of the symbols, dated ``since`` or later, the first of each key by (date, url).

    Without ``since`` rows without a date stay, sorted last.
    """
    rows = raw.filter(filled(["url"])).withColumn("item_date", S.parse_date10(F.col("date"))).join(symbols.select("symbol"), "symbol", "left_semi")
    if since:
        rows = rows.filter(F.col("item_date") >= F.to_date(F.lit(since)))
    return keep_first(rows, keys, F.asc_nulls_last("item_date"), "url", "symbol", "title")


def read_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(path, value): one row a file, folders below included."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def parse_content(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, metadata, body) of content files: KEY=VALUE lines, a line ---, the body after the first such line.

    Files without separator raise if ``strict``, else their body is null.  Of repeated keys the last counts.
    """
    parts = F.split("value", "\n---\n", 2)
    has = F.contains(F.col("value"), F.lit("\n---\n"))
    pair = lambda line: F.struct(S.strip_u(F.substring_index(line, "=", 1)).alias("k"), S.strip_u(F.substring(line, F.instr(line, "=") + 1, F.char_length(line))).alias("v"))
    pairs = F.transform(F.filter(F.split(parts[0], "\r?\n"), lambda s: F.contains(s, F.lit("="))), pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda q: q["k"] == p["k"]))
    body = F.when(has, S.strip_u(parts[1]))
    if strict:
        body = F.when(has, body).otherwise(F.raise_error(F.concat(F.lit("no separator in "), F.col("path"))).cast("string"))
    return files.select("path", F.map_from_entries(last).alias("metadata"), body.alias("body"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """(sector, name, symbol, market, sector_pos, pos) of the universe file; raises on malformed entries."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", UNIVERSE).alias("u"))
    sectors = parsed.select(F.posexplode(F.map_entries("u.sectors")).alias("sector_pos", "s"))
    rows = sectors.select(F.col("s.key").alias("sector"), "sector_pos", F.posexplode("s.value").alias("pos", "e"))
    strip = lambda c: S.strip_u(F.coalesce(F.col(f"e.{c}"), F.lit("")))
    out = rows.select("sector", strip("name").alias("name"), strip("symbol").alias("symbol"), F.coalesce(F.nullif(F.lower(strip("market")), F.lit("")), F.lit("a")).alias("market"), "sector_pos", "pos")
    fine = (F.col("name") != "") & (F.col("symbol") != "") & F.col("market").isin("a", "hk")
    return out.withColumn("symbol", F.when(fine, F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("malformed universe entry in "), F.col("sector"))).cast("string")))


def all_symbols(dim: DataFrame) -> DataFrame:
    """Each symbol once, where it first stands."""
    return keep_first(dim, ["symbol"], "sector_pos", "pos")


def symbols_of(dim: DataFrame, sector: str) -> DataFrame:
    own = dim.filter(F.col("sector") == sector)
    if own.isEmpty():
        raise ValueError(f"unknown sector {sector!r}")
    return own


def resolve_symbol(dim: DataFrame, symbol: str) -> dict:
    """The company of a symbol, upper or lower case."""
    row = dim.filter(F.upper("symbol") == symbol.strip().upper()).first()
    if row is None:
        raise ValueError(f"unknown symbol {symbol!r}")
    return row.asDict()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, completion) of batch result files: the last line of an id wins, failed calls are ''.

    Of several files the one whose name is last comes last; within a file lines go by their place in it, however Spark
    splits and packs the files.
    """
    return parse_results(ordered_lines(spark, path), "value", "_at")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _at) of the lines of text files; _at (file, start of the split, line) is their order.

    A task reads the lines of a split one after the other, so the row number within the task orders them; splits of one
    file are ordered by where they start.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", at.alias("_at"))


def parse_results(lines: DataFrame, value: str, order: str) -> DataFrame:
    r = F.from_json(value, RESULT)
    fine = r["error"].isNull() & (r["response"]["status_code"] == 200)
    text = F.when(fine, S.strip_u(F.try_element_at(r["response"]["body"]["choices"], F.lit(1))["message"]["content"]))
    read = lines.select(r["custom_id"].alias("custom_id"), F.coalesce(text, F.lit("")).alias("completion"), F.col(order).alias("_order")).filter("custom_id is not null")
    return read.groupBy("custom_id").agg(F.max_by("completion", "_order").alias("completion"))


def posts_of(api: Column) -> Column:
    """The records of a forum page (JSONP)."""
    return F.from_json(S.jsonp_body(api), "struct<count: bigint, re: array<struct<post_id: string, stockbar_code: string, post_title: string, post_publish_time: string, post_click_count: string, post_comment_count: string, art_unique_url: string>>>")


def comments_of(posts: DataFrame, base: str) -> DataFrame:
    """Comment rows of forum records; posts whose time can't be read drop out, a blank url is built from the ids."""
    fallback = F.concat(F.lit(base + "/news,"), F.col("stockbar_code"), F.lit(","), F.col("post_id"), F.lit(".html"))
    at = F.try_to_timestamp("post_publish_time", F.lit("yyyy-MM-dd HH:mm:ss"))
    return posts.select(
        F.coalesce(F.nullif(S.strip_u(F.col("art_unique_url")), F.lit("")), fallback).alias("url"), "post_id", F.col("stockbar_code").alias("symbol"), "post_title", at.alias("publish_time"),
        S.truncated_int(F.col("post_click_count")).alias("click_count"), S.truncated_int(F.col("post_comment_count")).alias("comment_count"),
    ).filter("publish_time is not null")
