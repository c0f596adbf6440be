"""Queries over the engine's operators, each with its twin in DuckDB's SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import html as H
from ..functions import prompts as P
from ..functions import scalars as S
from ..operators import asof, bars as B, consensus, content, merge as M, sampling, scoring, tokens
from ..session import ensure_checkpoint_dir
from ..sources import fetch, readers, text_files, writers
from ..sources.versions import Table
from ..streaming import incremental, marks, retention
from . import datasets as D
from .views import BARS_SQL, ITEMS_SQL, bars, items, table, universe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ALL = ("1900-01-01", "2100-01-01")
START, BEFORE = "2024-01-05", "2024-01-25"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(day: str):
    return F.date_format(day, "yyyy-MM-dd").alias(day)


def long(x, name: str):
    return x.cast("bigint").alias(name)


@query("""SELECT r_name AS sector, n_name AS name, CAST(n_nationkey AS VARCHAR) AS symbol, CASE WHEN n_nationkey % 7 = 0 THEN 'hk' ELSE 'a' END AS market,
  r_name || '/' || n_name || '(' || n_nationkey || CASE WHEN n_nationkey % 7 = 0 THEN '.HK' ELSE '' END || ')' AS company FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q01_universe_dim(spark, sf_dir):
    dim = readers.all_symbols(universe(spark, sf_dir))
    return dim.select("sector", "name", "symbol", "market", S.company_key(F.col("sector"), F.col("name"), F.col("symbol"), F.col("market")).alias("company"))


@query(f"""WITH {BARS_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, open, close, high, low, volume, round(amount, 6) AS amount, change_amount, pct_change, amplitude, turnover FROM bars""")
def q02_daily_bars(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", text("trade_date"), "open", "close", "high", "low", "volume", F.round("amount", 6).alias("amount"), "change_amount", "pct_change", "amplitude", "turnover")


def bounds_sql(field: str, value: str, fits: str) -> str:
    lo, hi = f"coalesce(min({value}) FILTER ({fits}), 0)", f"coalesce(max({value}) FILTER ({fits}), 1)"
    return f"{lo} AS {field}_lo, CASE WHEN {hi} <= {lo} THEN {lo} + 1e-9 ELSE {hi} END AS {field}_hi"


def scaler_sql(fits: str) -> str:
    prices = ", ".join(bounds_sql(f, f, fits) for f in B.SCALED)
    volume = bounds_sql("volume", "ln(1 + greatest(volume, 0))", fits)
    return f"""s AS (SELECT symbol, {prices}, {volume}, coalesce(avg(pct_change) FILTER ({fits}), 0) AS pct_mean,
  CASE WHEN count(pct_change) FILTER ({fits}) < 2 OR stddev_pop(pct_change) FILTER ({fits}) < 1e-12 THEN 1 ELSE stddev_pop(pct_change) FILTER ({fits}) END AS pct_std, count(*) FILTER ({fits}) AS n_fit FROM bars GROUP BY symbol HAVING count(*) FILTER ({fits}) > 0)"""


HALF_OPEN = f"trade_date >= DATE '{START}' AND trade_date < DATE '{BEFORE}'"
CLOSED = f"trade_date BETWEEN DATE '{START}' AND DATE '{BEFORE}'"
SCALER_OUT = [f"{f}_{e}" for f in [*B.SCALED, "volume"] for e in ("lo", "hi")] + ["pct_mean", "pct_std"]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in SCALER_OUT)


def scaler_row(scaler: DataFrame) -> DataFrame:
    return scaler.select("symbol", *[F.round(c, 6).alias(c) for c in SCALER_OUT], "n_fit")


@query(f"WITH {BARS_SQL}, {scaler_sql(HALF_OPEN)} SELECT symbol, {ROUNDED}, n_fit FROM s")
def q03_scaler_fit(spark, sf_dir):
    return scaler_row(B.fit_scaler(bars(spark, sf_dir), D.half_open(START, BEFORE)))


NORMAL_SQL = ", ".join([f"({f} - {f}_lo) / ({f}_hi - {f}_lo) AS n_{f}" for f in B.SCALED] + ["(ln(1 + greatest(volume, 0)) - volume_lo) / (volume_hi - volume_lo) AS n_volume", "(pct_change - pct_mean) / pct_std AS n_pct_change"])
NORMAL = ["n_open", "n_high", "n_low", "n_close", "n_turnover", "n_volume", "n_pct_change"]


@query(f"WITH {BARS_SQL}, {scaler_sql(HALF_OPEN)}, n AS (SELECT symbol, trade_date, {NORMAL_SQL} FROM bars JOIN s USING (symbol)) SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {', '.join(f'round({c}, 6) AS {c}' for c in NORMAL)} FROM n")
def q04_normalized_bars(spark, sf_dir):
    b = bars(spark, sf_dir)
    return B.normalize(b, B.fit_scaler(b, D.half_open(START, BEFORE))).select("symbol", text("trade_date"), *[F.round(c, 6).alias(c) for c in NORMAL])


EVERY = "trade_date >= DATE '1900-01-01' AND trade_date < DATE '2100-01-01'"
SERIES_SQL = f"""{BARS_SQL}, {scaler_sql(EVERY)}, n AS (SELECT symbol, trade_date, close, pct_change, {NORMAL_SQL} FROM bars JOIN s USING (symbol)),
k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n, {', '.join(f'lag(n_close, {i}) OVER w AS l{i}' for i in range(1, 8))}, {', '.join(f'lead(close, {h}) OVER w AS f{h}' for h in (1, 3, 7))} FROM n WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))"""


def four_places(x: str) -> str:
    return f"CAST(printf('%.4f', coalesce({x}, 0)) AS DOUBLE)"


AHEAD_SQL = ", ".join(f"CASE WHEN f{h} >= close THEN '涨' ELSE '跌' END AS label_{h}" for h in (1, 3, 7))


@query(f"WITH {SERIES_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN pct_change >= 0 THEN '涨' ELSE '跌' END AS label, {', '.join(f'round(l{8 - i}, 6) AS c{i}' for i in range(1, 8))} FROM k WHERE k >= 8 AND pct_change IS NOT NULL")
def q05_kline7_samples(spark, sf_dir):
    out = D.kline7(bars(spark, sf_dir), *ALL)
    return out.select("symbol", text("trade_date"), "label", *[F.round(F.col("window")[i - 1]["n_close"], 6).alias(f"c{i}") for i in range(1, 8)])


@query(f"WITH {SERIES_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {AHEAD_SQL}, round(l6, 6) AS first_close, round(n_close, 6) AS last_close FROM k WHERE k >= 7 AND k <= n - 7")
def q06_multi_horizon_labels(spark, sf_dir):
    rows = D.horizon_samples(bars(spark, sf_dir), 7, D.half_open(*ALL), D.half_open(*ALL))
    return rows.select("symbol", text("trade_date"), "label_1", "label_3", "label_7", F.round(F.col("window")[0]["n_close"], 6).alias("first_close"), F.round(F.col("window")[6]["n_close"], 6).alias("last_close"))


@query(f"WITH {SERIES_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {AHEAD_SQL}, {', '.join([four_places(f'l{5 - i}') + f' AS d{i}' for i in range(1, 5)])}, {four_places('n_close')} AS d5 FROM k WHERE k >= 5 AND k <= n - 7")
def q07_kline5_arrays(spark, sf_dir):
    rows = D.horizon_samples(bars(spark, sf_dir), 5, D.half_open(*ALL), D.half_open(*ALL), b=D.stored_bar())
    return rows.select("symbol", text("trade_date"), "label_1", "label_3", "label_7", *[F.col("b")[i - 1]["close"].alias(f"d{i}") for i in range(1, 6)])


@query(f"WITH {BARS_SQL}, {scaler_sql(CLOSED)} SELECT symbol, {ROUNDED}, n_fit FROM s")
def q08_fit_window_closed(spark, sf_dir):
    return scaler_row(B.fit_scaler(bars(spark, sf_dir), D.closed(START, BEFORE)))


GRID_SQL = "grid AS (SELECT CAST(n_nationkey AS VARCHAR) AS symbol, CAST(d AS DATE) AS day FROM nation, generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH) t(d))"


def month_grid(spark, sf_dir):
    months = F.sequence(F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-12-01")), F.expr("interval 1 month"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("symbol"), F.explode(months).alias("day"))


def ranked_items(found: DataFrame) -> DataFrame:
    flat = found.select("symbol", "day", F.posexplode("items").alias("i", "x"))
    return flat.select("symbol", text("day"), long(F.col("i") + 1, "rank"), F.col("x.url").alias("url"), F.date_format("x.item_date", "yyyy-MM-dd").alias("item_date"))


def ranked_sql(k: int, condition: str) -> str:
    return f"""WITH {ITEMS_SQL}, {GRID_SQL}, r AS (SELECT symbol, day, url, item_date, row_number() OVER (PARTITION BY symbol, day ORDER BY item_date DESC, url DESC) AS rank FROM grid JOIN items USING (symbol) WHERE {condition})
SELECT symbol, CAST(day AS VARCHAR) AS day, rank, url, CAST(item_date AS VARCHAR) AS item_date FROM r WHERE rank <= {k}"""


@query(ranked_sql(10, "item_date <= day"))
def q09_asof_topk(spark, sf_dir):
    return ranked_items(asof.topk_asof(month_grid(spark, sf_dir), items(spark, sf_dir), 10))


@query(ranked_sql(30, "item_date <= day AND item_date >= day - 30"))
def q10_interval_topk(spark, sf_dir):
    return ranked_items(asof.topk_asof(month_grid(spark, sf_dir), items(spark, sf_dir), 30, max_age_days=30))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS symbol, CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM nation, generate_series(TIMESTAMP '2026-01-01', TIMESTAMP '2026-04-01', INTERVAL 1 DAY) t(d)")
def q11_calendar_cross(spark, sf_dir):
    return asof.calendar_grid(universe(spark, sf_dir), "2026-01-01", "2026-04-01").select("symbol", text("day"))


@query(f"""WITH {ITEMS_SQL}, days AS (SELECT CAST(n_nationkey AS VARCHAR) AS symbol, CAST(d AS DATE) AS day FROM nation, generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-03-31', INTERVAL 1 DAY) t(d)),
c AS (SELECT days.symbol, day, count(url) AS n, max(CAST(item_date AS VARCHAR) || '|' || url) AS newest FROM days LEFT JOIN items ON items.symbol = days.symbol AND item_date <= day GROUP BY 1, 2)
SELECT symbol, CAST(day AS VARCHAR) AS day, least(n, 10) AS n_news, least(n, 3) AS n_reports, substr(newest, 12) AS newest FROM c""")
def q12_daily_text_counts(spark, sf_dir):
    it = items(spark, sf_dir).withColumn("content", F.col("summary"))
    out = D.daily_text(universe(spark, sf_dir), it, it, "1995-01-01", "1995-03-31")
    return out.select(F.col("stock").alias("symbol"), F.date_format("time", "yyyy-MM-dd").alias("day"), long(F.size("news"), "n_news"), long(F.size("reports"), "n_reports"), F.try_element_at("news", F.lit(1))["url"].alias("newest"))


@query("""SELECT url, symbol, day FROM (SELECT CAST(event_id AS VARCHAR) AS url, event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY CAST(trunc(value) AS BIGINT) DESC, CAST(event_id AS VARCHAR)) AS r FROM events) WHERE r <= 20""")
def q13_top_n_per_symbol_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    posts = e.select(F.col("event_id").cast("string").alias("url"), F.col("event_id").cast("string").alias("post_id"), F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("publish_time"), F.col("value").cast("string").alias("click_count"))
    return M.retain_comments(posts, 20).select("url", "symbol", S.calendar_day(F.col("publish_time")).alias("day"))


@query("SELECT o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM orders")
def q14_insert_if_absent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"))
    new = o.withColumn("origin", F.lit("new"))
    return M.insert_if_absent(o.filter("url % 2 = 0").withColumn("origin", F.lit("old")), new.unionByName(new), ["url"], "url")


@query(f"WITH {BARS_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN extract(day FROM trade_date) % 3 = 0 THEN close + 2 ELSE close END AS close FROM bars")
def q15_upsert_bars(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "trade_date", "close")
    some = b.filter("day(trade_date) % 3 = 0")
    new = some.withColumns({"_o": F.lit(1), "close": F.col("close") + 1}).unionByName(some.withColumns({"_o": F.lit(2), "close": F.col("close") + 2}))
    return M.upsert(b, new, ["symbol", "trade_date"], "_o").select("symbol", text("trade_date"), "close")


@query("SELECT count(*) AS n_before, count(*) FILTER (o_custkey % 7 <> 0) AS n_after, count(*) FILTER (o_custkey % 7 = 0) AS n_deleted FROM orders")
def q16_delete_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    left = M.delete_by_key(o, o.filter("o_custkey % 7 = 0"), ["o_orderkey"])
    return o.agg(F.count("*").alias("n_before")).join(left.agg(F.count("*").alias("n_after"))).withColumn("n_deleted", F.col("n_before") - F.col("n_after"))


@query("SELECT o_orderkey AS url, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) ELSE o_orderpriority END AS content FROM orders")
def q17_update_content(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderpriority").alias("content"), "o_orderstatus")
    some = o.filter("url % 5 = 0")
    last = some.select("url", F.when(F.col("url") % 10 == 0, "").otherwise(F.lower("o_orderstatus")).alias("content"), F.lit(2).alias("_o"))
    return M.update_from(o.drop("o_orderstatus"), some.select("url", F.lit("old").alias("content"), F.lit(1).alias("_o")).unionByName(last), ["url"], "content", "_o")


@query("SELECT c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AND c_acctbal > 0")
def q18_pending_work(spark, sf_dir):
    work = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("url"))
    return incremental.pending(work, table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("url")), ["url"])


@query("SELECT doc_id, sha256(source || '/' || doc_id) AS url_hash, length(text) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def q19_content_join_hash(spark, sf_dir):
    url = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents")
    cache = d.filter("text is not null").select(S.url_key(url).alias("url_hash"), F.col("text").alias("body"))
    return d.select("doc_id", S.url_key(url).alias("url_hash")).join(cache, "url_hash").select("doc_id", "url_hash", long(F.char_length("body"), "n"))


@query("""WITH l AS (SELECT o_custkey AS url, first(o_orderpriority ORDER BY o_orderkey) AS symbol FROM orders GROUP BY 1) SELECT c_custkey AS url, c_name AS title, symbol FROM customer JOIN l ON url = c_custkey""")
def q20_summary_symbol_lookup(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderpriority").alias("symbol"), "o_orderkey")
    first = M.keep_first(listed.filter(M.filled(["symbol"])), ["url"], "o_orderkey").select("url", "symbol")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.col("c_name").alias("title")).join(first, "url")


@query("""SELECT u.conv_id || '-' || u.turn AS custom_id, length(u.text) AS n_prompt, md5(coalesce(a.text, '')) AS completion FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def q21_batch_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string")).alias("custom_id")
    asked = c.filter("role = 'user'").select(key(F.col("turn")), F.col("text").alias("prompt"))
    done = c.filter("role = 'assistant'").select(key(F.col("turn") - 1), F.col("text").alias("completion"))
    return asked.join(done, "custom_id", "left").select("custom_id", long(F.char_length("prompt"), "n_prompt"), F.md5(F.coalesce("completion", F.lit(""))).alias("completion"))


@query("SELECT o_custkey AS url, arg_min(o_orderkey, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def q22_dedupe_keep_first(spark, sf_dir):
    return M.keep_first(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), "o_orderkey", "o_orderdate"), ["url"], "o_orderdate", "o_orderkey").drop("o_orderdate")


def streak_sql(source: str, streak: int) -> str:
    return f"""WITH s AS ({source}), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY page) AS island FROM s),
r AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY page) AS run FROM i), e AS (SELECT symbol, min(page) AS stop FROM r WHERE run >= {streak} GROUP BY symbol)
SELECT symbol, count(*) AS n_kept, max(page) AS last_page FROM r LEFT JOIN e USING (symbol) WHERE stop IS NULL OR page <= stop GROUP BY symbol"""


def streak_counts(df: DataFrame, streak: int) -> DataFrame:
    kept = M.stop_after_streak(df, ["symbol"], "page", F.col("hit"), streak)
    return kept.groupBy("symbol").agg(F.count("*").alias("n_kept"), F.max("page").alias("last_page"))


@query(streak_sql("SELECT user_id AS symbol, event_id AS page, value < 20 AS hit FROM events", 5))
def q23_zero_streak_stop(spark, sf_dir):
    return streak_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("page"), (F.col("value") < 20).alias("hit")), 5)


@query(streak_sql("SELECT o_custkey AS symbol, o_orderkey AS page, extract(year FROM o_orderdate) <= 1996 AS hit FROM orders", 3))
def q24_old_year_stop(spark, sf_dir):
    return streak_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("page"), (F.year("o_orderdate") <= 1996).alias("hit")), 3)


@query("""WITH a AS (SELECT s_nationkey AS query, s_name AS link, 0 AS src, s_suppkey AS id FROM supplier UNION ALL SELECT c_nationkey, c_name, 1, c_custkey FROM customer UNION ALL SELECT s_nationkey, s_name, 1, s_suppkey FROM supplier),
d AS (SELECT *, row_number() OVER (PARTITION BY query, link ORDER BY src, id) AS f FROM a), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY src, id, link) AS r FROM d WHERE f = 1) SELECT query, link FROM t WHERE r <= 8""")
def q25_union_capped(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query"), F.col("s_name").alias("link"), F.col("s_suppkey").alias("id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_name").alias("link"), F.col("c_custkey").alias("id"))
    return M.union_capped([s, c.unionByName(s)], "link", 8, ["query"], "id").select("query", "link")


@query(f"WITH {BARS_SQL} SELECT symbol, CAST(max(trade_date) + 1 AS VARCHAR) AS \"start\", '2024-01-31' AS \"end\" FROM bars GROUP BY symbol HAVING max(trade_date) + 1 <= DATE '2024-01-31'")
def q26_high_watermark(spark, sf_dir):
    b = bars(spark, sf_dir)
    return incremental.fetch_plan(b.select("symbol").distinct(), incremental.high_water(b), "2023-01-01", "2024-01-31").select("symbol", text("start"), text("end"))


@query(f"WITH {BARS_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 7")
def q27_recent_bars(spark, sf_dir):
    return B.recent(bars(spark, sf_dir), 7).select("symbol", text("trade_date"), "close")


@query("""WITH a AS (SELECT CASE WHEN quality = 1 THEN '涨' ELSE '跌' END AS r, CASE WHEN doc_id % 10 = 0 THEN '提取失败' WHEN toxic = 1 THEN '涨' ELSE '跌' END AS p FROM labels)
SELECT count(*) FILTER (r = p) AS correct, count(*) AS total, round(count(*) FILTER (r = p) / count(*), 6) AS accuracy, count(*) FILTER (p <> '提取失败') AS total_read, round(count(*) FILTER (r = p) / count(*) FILTER (p <> '提取失败'), 6) AS accuracy_read, count(*) FILTER (p = '提取失败') AS failures FROM a""")
def q28_accuracy_binary(spark, sf_dir):
    answers = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, S.UP).otherwise(S.DOWN).alias("reference"), F.when(F.col("doc_id") % 10 == 0, S.FAILED).when(F.col("toxic") == 1, S.UP).otherwise(S.DOWN).alias("predicted"))
    return scoring.binary_accuracy(answers).withColumns({c: F.round(c, 6) for c in ("accuracy", "accuracy_read")})


def mark(condition):
    return F.when(condition, S.UP).otherwise(S.DOWN)


def answered(spark, sf_dir) -> DataFrame:
    """Labels as references and answers: by doc_id % 4 three lines, three bare lines, nonsense, or a partial answer."""
    i = F.col("doc_id")
    gold = [mark(F.col("quality") == 1), mark(F.col("toxic") == 1), mark(i % 2 == 0)]
    said = [mark(F.col("quality") == 1), mark((i / 2).cast("bigint") % 2 == 0), mark(F.col("toxic") == 1)]
    line = lambda h, x: F.concat(F.lit(f"未来{h}个交易日："), F.when(x == S.UP, "上涨").otherwise(x))
    full = F.concat_ws("\n", F.lit("推理过程……"), *[line(h, x) for h, x in zip(A.HORIZONS, said)])
    completion = F.when(i % 4 == 0, full).when(i % 4 == 1, F.concat_ws("\n", F.lit("理由"), *said)).when(i % 4 == 2, "不确定").otherwise(F.concat_ws("\n", line(1, said[0]), line(7, said[2])))
    return table(spark, sf_dir, "labels").select("doc_id", F.concat_ws("，", *gold).alias("reference"), F.concat_ws("，", *said).alias("said"), completion.alias("completion"))


ANSWERED_SQL = """a AS (SELECT doc_id, doc_id % 4 AS m, [quality = 1, toxic = 1, doc_id % 2 = 0] AS g, [quality = 1, (doc_id // 2) % 2 = 0, toxic = 1] AS s FROM labels),
h AS (SELECT *, CAST(g[1] = s[1] AS INT) AS h1, CAST(g[2] = s[2] AS INT) AS h3, CAST(g[3] = s[3] AS INT) AS h7 FROM a)"""


@query(f"""WITH {ANSWERED_SQL}, s AS (SELECT m, CASE WHEN m = 2 THEN 0 ELSE (h1 + h3 + h7) / 3.0 END AS score FROM h)
SELECT round(sum(score), 6) AS score_sum, count(*) AS total, round(avg(score), 6) AS accuracy, round(sum(score) FILTER (m <> 2), 6) AS score_sum_read, count(*) FILTER (m <> 2) AS total_read, round(avg(score) FILTER (m <> 2), 6) AS accuracy_read FROM s""")
def q29_accuracy_triplet(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("predicted", F.when(F.col("doc_id") % 4 == 2, S.FAILED).otherwise(F.col("said")))
    out = scoring.triplet_accuracy(rows)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if not c.startswith("total")})


@query(f"""WITH {ANSWERED_SQL}, p AS (SELECT CAST(m IN (0, 1) AS INT) AS ok, h1, h3, h7 FROM h) SELECT round(avg(ok * (h1 + h3 + h7) / 3.0), 6) AS reward, round(avg(ok), 6) AS parse_rate, round(avg(ok * h1 * h3 * h7), 6) AS full_match_rate,
  round(avg(ok * h1), 6) AS hit_rate_1, round(avg(ok * h3), 6) AS hit_rate_3, round(avg(ok * h7), 6) AS hit_rate_7 FROM p""")
def q30_reward_equal(spark, sf_dir):
    out = scoring.equal_reward_rates(scoring.equal_reward(answered(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {ANSWERED_SQL}, p AS (SELECT CAST(m IN (0, 3) AS INT) AS a, CAST(m = 0 AS INT) AS b, h1, h3, h7 FROM h) SELECT round(avg(0.5 * a * h1 + 0.3 * b * h3 + 0.2 * a * h7), 6) AS reward,
  round(sum(a * h1) / greatest(1, sum(a)), 6) AS hit_rate_1, round(sum(b * h3) / greatest(1, sum(b)), 6) AS hit_rate_3, round(sum(a * h7) / greatest(1, sum(a)), 6) AS hit_rate_7 FROM p""")
def q31_reward_weighted(spark, sf_dir):
    out = scoring.weighted_reward_rates(scoring.weighted_reward(answered(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {ANSWERED_SQL}, t AS (SELECT doc_id, doc_id % 3 AS f, list_transform(g, lambda x: CASE WHEN x THEN '涨' ELSE '跌' END) AS l FROM h)
SELECT doc_id, CASE WHEN f < 2 THEN l[1] END AS n1, CASE WHEN f < 2 THEN l[3] END AS n3, l[1] AS w1, l[2] AS w2 FROM t""")
def q32_label_triplet_parse(spark, sf_dir):
    i, raw = F.col("doc_id"), F.col("reference")
    shape = F.when(i % 3 == 0, raw).when(i % 3 == 1, F.replace(raw, F.lit("，"), F.lit(" , "))).otherwise(F.replace(raw, F.lit("，"), F.lit(" / ")))
    rows = answered(spark, sf_dir).select("doc_id", A.label_triplet(shape).alias("n"), A.label_triplet(shape, wide=True).alias("w"))
    return rows.select("doc_id", F.col("n")[0].alias("n1"), F.col("n")[2].alias("n3"), F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"))


@query(f"""WITH {ANSWERED_SQL}, t AS (SELECT doc_id, m, list_transform(s, lambda x: CASE WHEN x THEN '涨' ELSE '跌' END) AS l FROM h)
SELECT doc_id, CASE WHEN m = 3 THEN '提取失败' ELSE l[1] || '，' || l[2] || '，' || l[3] END AS triplet, CASE m WHEN 0 THEN l[1] WHEN 1 THEN l[2] WHEN 2 THEN l[3] ELSE '提取失败' END AS single,
  CASE WHEN m = 0 THEN l[1] END AS reference FROM t""")
def q33_answer_parse(spark, sf_dir):
    m, said = F.col("doc_id") % 4, F.split("said", "，")
    spaced = F.concat_ws(" , ", said)
    three = F.when(m == 0, F.concat(F.lit("理由\n"), F.col("said"))).when(m == 1, F.concat(F.lit("涨跌难料\n　"), spaced, F.lit("\n以上"))).when(m == 2, F.concat(F.lit("最终答案："), F.concat_ws("/", said), F.lit("。"))).otherwise("不确定")
    one = F.when(m == 0, F.concat(F.lit("分析\n"), said[0])).when(m == 1, F.concat(F.lit("说明\n最终答案是"), said[1], F.lit("。"))).when(m == 2, F.concat(F.lit("因此判断为"), said[2], F.lit("势"))).otherwise("不确定")
    return answered(spark, sf_dir).select("doc_id", A.one_line_triplet(three).alias("triplet"), A.single_label(one).alias("single"), A.reference_label(one).alias("reference"))


@query("SELECT o_orderkey, 'https://news.example.com' || CASE WHEN o_orderkey % 2 = 0 THEN '/A/' ELSE '/a/' END || strftime(o_orderdate, '%Y%m%d') || o_orderkey || '.html' AS url, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS any_case, CASE WHEN o_orderkey % 2 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS exact_case FROM orders")
def q34_url_date(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 3 == 0, "//news.example.com").when(k % 3 == 1, "").otherwise("https://news.example.com"), F.when(k % 2 == 0, "/A/").otherwise("/a/"), F.date_format("o_orderdate", "yyyyMMdd"), k.cast("string"), F.lit(".html"))
    url = S.url_absolute(raw, "https://news.example.com")
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"), F.date_format(S.url_date(url), "yyyy-MM-dd").alias("any_case"), F.date_format(S.url_date(url, any_case=False), "yyyy-MM-dd").alias("exact_case"))


@query("""WITH p AS (SELECT p_partkey, lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS s, CASE WHEN p_partkey % 9 = 0 THEN 'hk' ELSE 'a' END AS m FROM part)
SELECT p_partkey, CASE WHEN s[1] IN ('6', '9') THEN 'sh' ELSE 'sz' END || s AS prefixed, s || CASE WHEN s[1] IN ('6', '9') THEN '.SH' ELSE '.SZ' END AS suffixed, m = 'a' AS mainland FROM p""")
def q35_vendor_symbol(spark, sf_dir):
    s, m = F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0"), F.when(F.col("p_partkey") % 9 == 0, "hk").otherwise("a")
    return table(spark, sf_dir, "part").select("p_partkey", S.prefixed_symbol(s).alias("prefixed"), S.suffixed_symbol(s).alias("suffixed"), S.is_mainland(s, m).alias("mainland"))


@query("SELECT count(*) AS n_rows, CAST(min(length(coalesce(text, ''))) AS BIGINT) AS min_text, CAST(max(length(coalesce(text, ''))) AS BIGINT) AS max_text, CAST(min(length(coalesce(source, ''))) AS BIGINT) AS min_source, CAST(max(length(coalesce(source, ''))) AS BIGINT) AS max_source FROM documents")
def q36_text_profile(spark, sf_dir):
    return scoring.text_profile(table(spark, sf_dir, "documents"), "text", "source")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 100 THEN s ELSE regexp_replace(substr(s, 1, 100), '\s+$', '') || '……' END AS cut, left(text, 400) AS head, right(text, 500) AS tail FROM t""")
def q37_truncate_preview(spark, sf_dir):
    shown = S.preview(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", S.ellipsis(F.col("text"), 100).alias("cut"), shown["head"].alias("head"), shown["tail"].alias("tail"))


@query("SELECT *, '已过滤掉 ' || removed || ' 条 PDF 链接，保留 ' || kept || ' / ' || (kept + removed) || ' 条普通网页结果。' AS note FROM (SELECT count(*) FILTER (page_id % 5 <> 0) AS kept, count(*) FILTER (page_id % 5 = 0) AS removed FROM pages)")
def q38_pdf_filter(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 5 == 0, ".PDF").otherwise(".html"))
    return content.pdf_note(table(spark, sf_dir, "pages").select(url.alias("url")))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def q39_status_tally(spark, sf_dir):
    return content.tally(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT doc_id FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id OFFSET 50) WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def q40_offset_limit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.numbered(d, "doc_id", 50, 100, F.col("lang") == "en").select("doc_id")


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'https://forum.example.com/news,' || event_type || ',' || event_id || '.html' ELSE 'https://x.example.com/' || event_id END AS url, CAST(event_id AS VARCHAR) AS post_id, event_type AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS publish_time, CAST(trunc(value) AS BIGINT) AS click_count, CAST(0 AS BIGINT) AS comment_count FROM events WHERE event_id % 11 <> 0""")
def q41_forum_projection(spark, sf_dir):
    i = F.col("event_id")
    posts = table(spark, sf_dir, "events").select(
        i.cast("string").alias("post_id"), F.col("event_type").alias("stockbar_code"), F.lit("t").alias("post_title"), F.when(i % 11 == 0, "2026-02-30 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("post_publish_time"),
        F.col("value").cast("string").alias("post_click_count"), F.lit("abc").alias("post_comment_count"), F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("https://x.example.com/"), i.cast("string"))).alias("art_unique_url"),
    )
    rows = readers.comments_of(posts, "https://forum.example.com")
    return rows.select("url", "post_id", "symbol", F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss").alias("publish_time"), "click_count", "comment_count")


def quoted(text: str) -> str:
    """A literal in DuckDB's SQL."""
    return "'" + text.replace("'", "''") + "'"


def four(x: str, sign: str = "") -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE printf('%{sign}.4f', {x}) END"


PLAIN_SQL = "CASE WHEN amplitude IS NULL THEN 'N/A' WHEN amplitude = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(amplitude AS VARCHAR), '0+$', ''), '\\.$', '') END"
DAY_SQL = " || ', ".join(["'open=' || " + four("n_open"), "high=' || " + four("n_high"), "low=' || " + four("n_low"), "close=' || " + four("n_close"), "volume=' || " + four("n_volume"), f"amplitude=' || {PLAIN_SQL}", "pct_change=' || " + four("n_pct_change", "+"), "turnover=' || " + four("n_turnover")])
WEEK_SQL = f"""{BARS_SQL}, {scaler_sql(EVERY)}, n AS (SELECT symbol, trade_date, pct_change, amplitude, {NORMAL_SQL} FROM bars JOIN s USING (symbol)),
d AS (SELECT symbol, trade_date, pct_change, {DAY_SQL} AS day FROM n),
w AS (SELECT *, CASE WHEN pct_change >= 0 THEN '涨' ELSE '跌' END AS label, row_number() OVER o AS k, {" || chr(10) || ".join(f"'Day{i}: ' || lag(day, {8 - i}) OVER o" for i in range(1, 8))} AS days FROM d WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
p AS (SELECT *, {quoted(P.WEEK_HEADER)} || chr(10) || days || chr(10) || chr(10) || {quoted(P.NEXT_DAY_TAIL)} AS short, {quoted(P.WEEK_HEADER + chr(10) + P.FIELD_NOTE)} || chr(10) || days || chr(10) || chr(10) || {quoted(P.NEXT_DAY_THINK_TAIL)} AS prompt FROM w WHERE k >= 8 AND pct_change IS NOT NULL)"""


@query(f"WITH {WEEK_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, prompt, label AS completion FROM p")
def q42_prompt_render(spark, sf_dir):
    out = D.kline7(bars(spark, sf_dir), *ALL, kind="eval")
    return out.select("symbol", text("trade_date"), "prompt", F.col("label").alias("completion"))


@query(f"""WITH {WEEK_SQL}, i AS (SELECT symbol || '-' || strftime(trade_date, '%Y%m%d') AS custom_id, {quoted(P.KNOWN_ANSWER_HEAD)} || label || {quoted(P.KNOWN_ANSWER_TASK)} || short || {quoted(P.KNOWN_ANSWER_TAIL)} AS content FROM p)
SELECT custom_id, CAST(json_object('custom_id', custom_id, 'method', 'POST', 'url', '/v1/chat/completions', 'body', json_object('model', 'model', 'messages', json_array(json_object('role', 'user', 'content', content)))) AS VARCHAR) AS value FROM i""")
def q43_batch_jsonl(spark, sf_dir):
    out = D.kline7(bars(spark, sf_dir), *ALL)
    custom_id = F.concat("symbol", F.lit("-"), F.date_format("trade_date", "yyyyMMdd"))
    return out.select(custom_id.alias("custom_id"), writers.request_line(custom_id, "model", P.known_answer_message(F.col("prompt"), F.col("label"))).alias("value"))


@query()
def q44_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", H.extractor("generic")("html").alias("generic"), H.extractor("news")("html").alias("news"), H.extractor("report")("html").alias("report"), F.size(H.link_extractor()("html")).alias("n_links"))


@query()
def q45_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    comments = e.select(F.col("user_id").cast("string").alias("symbol"), F.col("event_id").cast("string").alias("url"), F.col("ts").alias("publish_time"), F.col("event_type").alias("title"))
    it = items(spark, sf_dir).select("symbol", F.col("item_date").alias("date"), "url", "title")
    results = it.select("symbol", F.col("title").alias("query"), F.col("url").cast("long").alias("position"), "url")
    return D.snapshot(comments, it, it, bars(spark, sf_dir), results, "7")


@query()
def q46_hash_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    train, held = sampling.split(d, "doc_id", 0.1)
    picked = sampling.sample(train, "doc_id", 50).withColumn("part", F.lit("sample"))
    return picked.unionByName(sampling.step_sample(held, "doc_id", 10, step=3).withColumn("part", F.lit("step")))


@query(r"""WITH t AS (SELECT u.conv_id, u.turn, len(regexp_extract_all(u.text, '[^ \n]+')) AS p, len(regexp_extract_all(a.text, '[^ \n]+')) AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT conv_id, turn, CAST(least(p, 64 - least(r, 63)) + least(r, 63) AS BIGINT) AS n_input, CAST(least(p, 64 - least(r, 63)) AS BIGINT) AS n_ignored FROM t""")
def q47_token_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ids = lambda x: F.transform(F.filter(F.split(x, "[ \n]+"), lambda w: w != ""), lambda w: F.pmod(F.hash(w), F.lit(50_000)))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    rows = c.filter("role = 'user'").join(a, ["conv_id", "turn"]).select("conv_id", "turn", tokens.training_window(ids(F.col("text")), ids(F.col("said")), 64).alias("w"))
    return rows.select("conv_id", "turn", long(F.size("w.input_ids"), "n_input"), long(F.size(F.filter("w.labels", lambda x: x == tokens.IGNORED)), "n_ignored"))


@query(f"WITH {WEEK_SQL} SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, label AS reference, CASE WHEN length(prompt) % 2 = 1 THEN '涨' ELSE '跌' END AS predicted FROM p")
def q48_offline_predictions(spark, sf_dir):
    """The evaluation loop: samples, prompts, a stand-in for the model, parsed answers."""
    out = D.kline7(bars(spark, sf_dir), *ALL, kind="eval").select("symbol", text("trade_date"), "prompt", F.col("label").alias("reference"))
    said = fetch.generate(out, fetch.offline_client)
    return said.select("symbol", "trade_date", "reference", A.single_label(F.col("raw_output")).alias("predicted"))


STORED = {"open": "n_open", "high": "n_high", "low": "n_low", "close": "n_close", "volume": "n_volume", "amplitude": "amplitude", "pct_change": "n_pct_change", "turnover": "n_turnover"}
#: A double's text as Spark writes it, for values of four places.
STORED_SQL = {name: f"(SELECT CASE WHEN v <> 0 AND abs(v) < 0.001 THEN printf('%.1fE-4', v * 10000) ELSE CAST(v AS VARCHAR) END FROM (SELECT coalesce(CAST(printf('%.4f', {x}) AS DOUBLE), 0) + 0.0 AS v))" for name, x in STORED.items()}


def recent_sql(name: str, k: int) -> str:
    block = "rank || '. 日期=' || CAST(item_date AS VARCHAR) || chr(10) || '标题=' || title || chr(10) || summary"
    return f"""{name} AS (SELECT symbol, trade_date, '[' || string_agg(CAST(json_object('date', CAST(item_date AS VARCHAR), 'title', title, 'url', url, 'summary', summary) AS VARCHAR), ',' ORDER BY rank) || ']' AS items, string_agg({block}, chr(10) || chr(10) ORDER BY rank) AS told
  FROM (SELECT a.symbol, a.trade_date, m.*, row_number() OVER (PARTITION BY a.symbol, a.trade_date ORDER BY item_date DESC, url DESC) AS rank FROM anchors a JOIN moved m ON m.symbol = a.symbol AND item_date <= trade_date AND item_date >= trade_date - 30) WHERE rank <= {k} GROUP BY 1, 2)"""


MULTI_SQL = f"""WITH {BARS_SQL}, {ITEMS_SQL}, {scaler_sql(CLOSED.replace(START, ALL[0]).replace(BEFORE, ALL[1]))}, n AS (SELECT symbol, trade_date, close, amplitude, {NORMAL_SQL} FROM bars JOIN s USING (symbol)),
stored AS (SELECT symbol, trade_date, close, {", ".join(f"{x} AS t_{name}" for name, x in STORED_SQL.items())} FROM n),
told AS (SELECT symbol, trade_date, close, '{{"trade_date":"' || trade_date || '"' || {" || ".join(f"',\"{f}\":' || t_{f}" for f in ("open", "high", "low", "close", "volume", "amplitude", "pct_change", "turnover"))} || '}}' AS bar,
  'trade_date=' || trade_date || {" || ".join(f"', {f}=' || t_{f}" for f in ("open", "high", "low", "close", "volume", "amplitude", "pct_change", "turnover"))} AS day FROM stored),
anchors AS (SELECT * FROM (SELECT symbol, trade_date, row_number() OVER o AS k, count(*) OVER (PARTITION BY symbol) AS n, '[' || {" || ',' || ".join(f"lag(bar, {i}) OVER o" for i in (4, 3, 2, 1, 0))} || ']' AS kline_5d, {" || chr(10) || ".join(f"'Day{5 - i}: ' || lag(day, {i}) OVER o" for i in (4, 3, 2, 1, 0))} AS days,
  {" || '，' || ".join(f"CASE WHEN lead(close, {h}) OVER o >= close THEN '涨' ELSE '跌' END" for h in (1, 3, 7))} AS labels FROM told WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)) WHERE k >= 5 AND k <= n - 7),
moved AS (SELECT symbol, CAST(item_date + INTERVAL 312 MONTH AS DATE) AS item_date, url, title, summary FROM items), {recent_sql("news", 30)}, {recent_sql("reports", 3)}
SELECT CAST(a.trade_date AS VARCHAR) AS date, a.symbol AS stock, kline_5d, coalesce(news.items, '[]') AS news, coalesce(reports.items, '[]') AS reports, labels AS future_1_3_7_trade_day_labels,
  '分析日期：' || a.trade_date || chr(10) || '股票代码：' || a.symbol || chr(10) || chr(10) || '过去5个交易日的归一化K线数据如下：' || chr(10) || {quoted(P.FIELD_NOTE)} || chr(10) || days || chr(10) || chr(10) || '近期新闻摘要如下：' || chr(10) || coalesce(news.told, '无') || chr(10) || chr(10) || '近期研报摘要如下：' || chr(10) || coalesce(reports.told, '无') || chr(10) || chr(10) || {quoted(P.TRAINING_TAIL)} AS prompt
FROM anchors a LEFT JOIN news ON news.symbol = a.symbol AND news.trade_date = a.trade_date LEFT JOIN reports ON reports.symbol = a.symbol AND reports.trade_date = a.trade_date"""


@query(MULTI_SQL)
def q49_multi_source_samples(spark, sf_dir):
    """The multi-source set over the driver's tables, with the trainer's prompt."""
    b, it = bars(spark, sf_dir), items(spark, sf_dir)
    shifted = it.withColumn("item_date", F.add_months("item_date", 12 * 26))
    out = D.kline5_text(b, shifted, shifted, *ALL)
    asked = out.withColumn("prompt", P.training_prompt(F.col("date"), F.col("stock"), F.col("kline_5d"), F.col("news"), F.col("reports")))
    return D.encoded(asked).select(text("date"), "stock", "kline_5d", "news", "reports", "future_1_3_7_trade_day_labels", "prompt")


DOC_URL = "'https://s.example.com/' || coalesce(source, '') || '/' || doc_id"


def document_files(spark, sf_dir) -> DataFrame:
    """Documents as summary files: every eleventh without symbol, every thirteenth with a date that can't be read."""
    i, url = F.col("doc_id"), F.concat(F.lit("https://s.example.com/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    day = F.when(i % 13 == 0, "2026-02-30").otherwise(F.date_format(F.date_add(F.to_date(F.lit("2025-01-01")), (i % 300).cast("int")), "yyyy-MM-dd"))
    body = F.when(i % 17 == 0, " ").otherwise(F.coalesce("text", F.lit("")))
    value = writers.content_text(url, F.concat(F.lit(" t\n"), i.cast("string")), day, body, F.when(i % 11 == 0, "").otherwise(F.coalesce("source", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", url.alias("url"), "source", F.concat(F.lit("news/"), i.cast("string"), F.lit(".txt")).alias("path"), value.alias("value"))


STRIPPED = r"regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x1c-\x1f\x85\xa0]+', ''), '[\s\x1c-\x1f\x85\xa0]+$', '')"
FINE_SQL = "doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND trim(text) <> ''"


@query(f"SELECT source AS symbol, CAST(DATE '2025-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) AS item_date, {DOC_URL} AS url, 't ' || doc_id AS title, length({STRIPPED}) AS n FROM documents WHERE {FINE_SQL} AND doc_id % 11 <> 0 AND source <> 'src3' AND source <> ''")
def q50_news_summaries(spark, sf_dir):
    symbols = table(spark, sf_dir, "documents").filter("source <> 'src3'").select(F.col("source").alias("symbol")).distinct()
    out = content.summary_items(document_files(spark, sf_dir), symbols)
    return out.select("symbol", text("item_date"), "url", "title", long(F.char_length("summary"), "n"))


@query(f"SELECT 'r' || doc_id % 7 AS symbol, CAST(DATE '2025-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) AS item_date, {DOC_URL} AS url, length({STRIPPED}) AS n FROM documents WHERE {FINE_SQL} AND doc_id % 7 <> 0")
def q51_report_summaries(spark, sf_dir):
    files = document_files(spark, sf_dir)
    named = files.select("url", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string"))).alias("symbol"), F.lit(1).alias("pos"))
    later = named.select("url", F.lit("late").alias("symbol"), F.lit(2).alias("pos")).filter(F.col("symbol") != "late")
    symbols = spark.range(7).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("symbol"))
    out = content.summary_items(files, symbols, named.unionByName(later))
    return out.select("symbol", text("item_date"), "url", long(F.char_length("summary"), "n"))


@query(f"""SELECT 'news/' || doc_id || '.txt' AS path, 'URL=' || {DOC_URL} || chr(10) || CASE WHEN doc_id % 11 = 0 OR coalesce(source, '') = '' THEN '' ELSE 'SYMBOL=' || source || chr(10) END || 'TITLE=t ' || doc_id || chr(10) || 'DATE=' || day || chr(10) || '---' || chr(10)
  || '时间：' || day || chr(10) || '标题：t ' || doc_id || chr(10) || '主要观点：' || chr(10) || 'summary ' || doc_id || chr(10) AS value FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN '2026-02-30' ELSE CAST(DATE '2025-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) END AS day FROM documents) WHERE doc_id % 5 <> 0""")
def q52_summary_files(spark, sf_dir):
    files = document_files(spark, sf_dir).select("path", "value", "doc_id")
    said = files.select(F.col("path").alias("custom_id"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" summary "), F.col("doc_id").cast("string"), F.lit("\n"))).alias("completion"))
    lost = said.select(F.concat(F.lit("gone/"), F.col("custom_id")).alias("custom_id"), "completion")
    return content.summary_files(said.unionByName(lost), files.select("path", "value"))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CAST(row_number() OVER (ORDER BY o_orderkey) + 99 AS VARCHAR) AS custom_id, o_orderkey, CASE WHEN (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 = 0 THEN '' ELSE 'a' || (row_number() OVER (ORDER BY o_orderkey) + 99) END AS completion FROM orders""")
def q53_batch_completions(spark, sf_dir):
    rows = sampling.ordinal(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "i")
    done = rows.filter("i % 3 <> 0").select((F.col("i") + 100).cast("string").alias("custom_id"), F.concat(F.lit("a"), (F.col("i") + 100).cast("string")).alias("completion"))
    return content.with_completions(rows, done, 100).select("i", "custom_id", "o_orderkey", "completion")


@query("""WITH l AS (SELECT doc_id, 'https://n.example.com/' || (doc_id // 3) AS url, DATE '2025-01-01' + CAST(doc_id % 2 AS INT) AS item_date, source, text FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY url, item_date ORDER BY source, doc_id) AS r FROM l WHERE source <> ''), c AS (SELECT url, item_date, min(doc_id) AS doc_id FROM l GROUP BY 1, 2)
SELECT o.source AS symbol, o.url, CAST(o.item_date AS VARCHAR) AS item_date, md5('body ' || o.url) AS body FROM o JOIN c USING (url, item_date) WHERE r = 1 AND c.doc_id % 5 <> 0""")
def q54_items_with_bodies(spark, sf_dir):
    i = F.col("doc_id")
    listed = table(spark, sf_dir, "documents").select(i, F.col("source").alias("symbol"), F.concat(F.lit("https://n.example.com/"), F.floor(i / 3).cast("string")).alias("url"), F.lpad(i.cast("string"), 12, "0").alias("title"), F.date_add(F.to_date(F.lit("2025-01-01")), (i % 2).cast("int")).alias("item_date"))
    # One cached file for a url and month; here a day stands for the month, so that the key's second part matters.
    months = listed.withColumn("item_date", F.add_months(F.to_date(F.lit("2025-01-01")), (i % 2).cast("int")))
    cache = months.groupBy("url", "item_date").agg(F.min("doc_id").alias("doc_id")).select(S.url_key(F.col("url")).alias("url_hash"), F.date_format("item_date", "yyyy-MM").alias("ym"), F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("body "), F.col("url"))).alias("body"))
    out = content.with_bodies(months, cache)
    day = F.date_add(F.to_date(F.lit("2025-01-01")), F.month("item_date") - 1)
    return out.select("symbol", "url", F.date_format(day, "yyyy-MM-dd").alias("item_date"), F.md5("content").alias("body"))


@query("SELECT o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0")
def q55_unfetched_content(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 4 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("url"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "　\n").alias("content"))
    return content.unfetched(rows).select(F.col("url").cast("bigint").alias("url"))


@query("""SELECT doc_id, CASE WHEN m < 3 THEN l[1] || l[2] || l[3] END AS triplet FROM (SELECT doc_id, doc_id % 4 AS m, [CASE WHEN quality = 1 THEN '涨' ELSE '跌' END, CASE WHEN toxic = 1 THEN '涨' ELSE '跌' END, CASE WHEN doc_id % 2 = 0 THEN '涨' ELSE '跌' END] AS l FROM labels)""")
def q56_reference_of_label_or_completion(spark, sf_dir):
    m, gold = F.col("doc_id") % 4, F.split("reference", "，")
    said = F.array(F.struct(F.concat_ws("\n", *[F.concat(F.lit(f"未来{h}个交易日："), gold[k]) for k, h in enumerate(A.HORIZONS)]).alias("content")))
    rows = answered(spark, sf_dir).select("doc_id", F.when(m == 0, F.col("reference")).when(m == 3, "涨，跌").otherwise(" ").alias("label"), said.alias("completion"))
    return rows.select("doc_id", F.array_join(A.reference_triplet(F.col("label"), A.completion_text(F.col("completion"), rows.schema["completion"].dataType)), "").alias("triplet"))


@query("SELECT event_type AS symbol, CAST(event_id AS VARCHAR) AS url FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CAST(trunc(value) AS BIGINT) + event_id % 7 DESC, CAST(event_id AS VARCHAR)) AS r FROM events) WHERE r <= 200")
def q57_consensus_comments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    posts = e.select(F.col("event_type").alias("symbol"), F.col("event_id").cast("string").alias("url"), F.col("value").cast("string").alias("click_count"), (F.col("event_id") % 7).cast("string").alias("comment_count"))
    return content.consensus_comments(posts).select("symbol", "url")


@query("""WITH m AS (SELECT o_custkey AS company, count(*) AS total, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS done FROM orders GROUP BY 1) SELECT company, p AS page FROM m, unnest(generate_series(CAST(done AS BIGINT) + 1, total)) t(p) WHERE company % 10 <> 0""")
def q58_pages_to_fetch(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("done"))
    pages = F.when(F.col("done") > 0, F.sequence(F.lit(1), F.col("done").cast("int"))).otherwise(F.array().cast("array<int>"))
    state = F.when(F.col("company") % 3 == 0, F.col("done").cast("string")).when(F.col("company") % 3 == 1, F.to_json(pages)).otherwise(F.to_json(F.struct(F.col("total").alias("total_pages"), pages.alias("completed"))))
    saved = m.select("company", F.when(F.col("company") % 10 == 0, 10_000).otherwise(9_999).alias("n_rows"))
    return marks.pages_to_fetch(m.select("company", "total", state.alias("state")), saved).select("company", long(F.col("page"), "page"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster's machines share for checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


EXPANDING_SQL = ", ".join(f"coalesce(min({x}) OVER w, 0) AS {f}_lo, CASE WHEN coalesce(max({x}) OVER w, 1) <= coalesce(min({x}) OVER w, 0) THEN coalesce(min({x}) OVER w, 0) + 1e-9 ELSE coalesce(max({x}) OVER w, 1) END AS {f}_hi" for f, x in [*((f, f) for f in B.SCALED), ("volume", "ln(1 + greatest(volume, 0))")])


@query(f"""WITH {BARS_SQL} SELECT * EXCLUDE (deviation, n_pct), CASE WHEN n_pct < 2 OR deviation < 1e-12 THEN 1 ELSE deviation END AS pct_std FROM (SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {EXPANDING_SQL}, coalesce(avg(pct_change) OVER w, 0) AS pct_mean, count(pct_change) OVER w AS n_pct, stddev_pop(pct_change) OVER w AS deviation, count(*) OVER w AS n_fit
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n_fit > 0""")
def q59_expanding_scalers(spark, sf_dir):
    return B.expanding_scalers(bars(spark, sf_dir)).withColumn("trade_date", text("trade_date"))


@query("""WITH u AS (SELECT o_orderkey AS k, CAST(o_orderdate AS VARCHAR)[1:7] AS month, o_totalprice AS v FROM orders)
SELECT k, month, CASE WHEN k % 4 = 0 THEN 2 * v ELSE v END AS v FROM u""")
def q60_versioned_upserts(spark, sf_dir):
    """Orders in a table split by month; every fourth is upserted by a second batch, and both batches come twice."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("v"))
    target = Table(spark, shared_folder(spark, "orders"), split="month")
    for batch in (0, 0, 1, 1):
        part = rows if batch == 0 else rows.filter("k % 4 = 0").withColumn("v", 2 * F.col("v"))
        incremental.merge_batch(target, part, batch, "orders", ["k", "month"], mode="upsert")
    return target.read()


@query(f"SELECT 'news/' || doc_id || '.txt' AS path, sha256(CASE WHEN doc_id % 6 = 0 THEN 'new ' || doc_id WHEN doc_id % 9 = 0 THEN '' ELSE coalesce(text, '') END) AS digest FROM documents")
def q61_committed_files(spark, sf_dir):
    """Texts of documents as files, some of them empty; every sixth is written again by a later commit."""
    d, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "files")
    path = F.concat(F.lit("news/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    text_files.write(d.select(path, F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.coalesce("text", F.lit(""))).alias("value")), folder)
    text_files.write(d.filter("doc_id % 6 = 0").select(path, F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("value")), folder)
    return text_files.read(spark, folder).select("path", F.sha2("value", 256).alias("digest"))


@query("""SELECT url, symbol, day, clicks FROM (SELECT CAST(event_id AS VARCHAR) AS url, event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(trunc(value) AS BIGINT) AS clicks, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY CAST(trunc(value) AS BIGINT) DESC, CAST(event_id AS VARCHAR)) AS r FROM events) WHERE r <= 20""")
def q62_retention_by_batches(spark, sf_dir):
    """Events as comments, merged in three batches against the floors of full days: equal to one trim of all."""
    e = table(spark, sf_dir, "events")
    posts = e.select(F.col("event_id").cast("string").alias("url"), F.col("event_id").cast("string").alias("post_id"), F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("publish_time"), F.col("value").cast("string").alias("click_count"))
    kept, floors = retention.tables(spark, shared_folder(spark, "comments"))
    for batch in range(3):
        retention.retain_batch(kept, floors, posts.filter(F.pmod(F.col("url").cast("bigint"), F.lit(3)) == batch), batch, "events", 20)
    return kept.read().select("url", "symbol", "day", S.truncated_int(F.col("click_count")).alias("clicks"))


CONSENSUS_SQL = """WITH c AS (SELECT source AS symbol, doc_id AS url, split_part(text, chr(10), 1) AS title FROM documents WHERE source IS NOT NULL),
w AS (SELECT symbol, url, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1))) AS word FROM c),
n AS (SELECT symbol, count(*) AS total FROM c GROUP BY 1), k AS (SELECT symbol, word, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT symbol, url, first(word ORDER BY n DESC, word) AS topic FROM w JOIN k USING (symbol, word) JOIN n USING (symbol) WHERE n < total GROUP BY 1, 2)
SELECT c.symbol, c.url, coalesce(topic, '') AS topic FROM c LEFT JOIN b ON b.symbol = c.symbol AND b.url = c.url"""


@query(CONSENSUS_SQL)
def q63_comment_clusters(spark, sf_dir):
    """Documents' first lines as comments of their source, by the topic that names their cluster."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    posts = d.select(F.col("source").alias("symbol"), F.col("doc_id").alias("url"), F.substring_index("text", "\n", 1).alias("post_title"))
    return consensus.clustered(posts).select("symbol", "url", "topic")
