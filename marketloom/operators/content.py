"""Dated texts: list rows with their bodies, summary files, batch results, and what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scalars as S
from ..sources.readers import parse_content
from ..sources.versions import Table
from .merge import filled, keep_first

#: Requests that a dry run shows, and comments that a consensus is asked of.
SHOWN, CONSENSUS = 50, 200


def dated(rows: DataFrame, date: str = "date") -> DataFrame:
    """Rows that have a date, as they go into a master table."""
    return rows.filter(F.col(date).isNotNull() & (F.trim(F.col(date).cast("string")) != ""))


def with_bodies(listed: DataFrame, content: DataFrame, by_month: bool = True) -> DataFrame:
    """List rows (symbol, url, title, item_date) with the body of the cached content (url_hash, body and, for news, ym).

    News are kept once a url and day and looked up by the url's hash and month; reports once a url and by hash.  Rows
    without symbol, url or date drop out, as do those without a body.  Of equal keys the first by symbol and title stays.
    """
    fine = listed.filter(filled(["symbol", "url"]) & F.col("item_date").isNotNull())
    once = keep_first(fine, ["url", "item_date"] if by_month else ["url"], "item_date", "symbol", "title").withColumn("url_hash", S.url_key(F.col("url")))
    if by_month:
        once = once.withColumn("ym", F.date_format("item_date", "yyyy-MM"))
    keys = ["url_hash", "ym"] if by_month else ["url_hash"]
    bodies = content.filter(filled(["body"])).select(*keys, S.strip_u(F.col("body")).alias("content"))
    return once.join(bodies, keys).select("symbol", "item_date", "url", "title", "content")


def summary_items(files: DataFrame, symbols: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(symbol, item_date, url, title, summary) of summary files (path, value); a file without separator is an error.

    The symbol is in the header; for reports it is that of the first row of ``listed`` (url, symbol, and pos, its order)
    with the url.  Files without a known symbol, url, date or body drop out.
    """
    parsed = parse_content(files, strict=True)
    of = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    rows = parsed.select(of("SYMBOL").alias("symbol"), of("URL").alias("url"), of("TITLE").alias("title"), S.parse_date10(of("DATE")).alias("item_date"), F.col("body").alias("summary"))
    if listed is not None:
        first = keep_first(listed.filter(filled(["url", "symbol"])), ["url"], "pos").select("url", "symbol")
        rows = rows.drop("symbol").join(first, "url")
    fine = rows.filter(filled(["symbol", "url", "summary"]) & F.col("item_date").isNotNull())
    return fine.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "item_date", "url", "title", "summary")


def summary_files(results: DataFrame, files: DataFrame) -> DataFrame:
    """(path, value) of the summary files that batch results (custom_id: a content file's path, completion) make of the
    content files (path, value).  Blank results and results without a file make none."""
    said = results.filter(filled(["completion"])).select(F.col("custom_id").alias("path"), "completion")
    of = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    from ..sources.writers import summary_text

    text = summary_text(F.col("metadata"), P.summary_body(of("DATE"), of("TITLE"), F.col("completion")))
    return parse_content(files).join(said, "path").select("path", text.alias("value"))


def with_completions(rows: DataFrame, results: DataFrame, offset: int = 0, number: str = "i") -> DataFrame:
    """``rows`` with the completion of the batch result whose custom_id is offset plus the row's number; '' without one."""
    own = F.coalesce("completion", F.lit(""))
    keyed = rows.withColumn("custom_id", (F.col(number) + offset).cast("string"))
    return keyed.join(results.select("custom_id", "completion"), "custom_id", "left").select("custom_id", *rows.columns, own.alias("completion"))


def reasoning_set(rows: DataFrame, results: DataFrame, offset: int = 0) -> DataFrame:
    """prompt and completion: a prompt set's rows (i, prompt), asked for their reasoning, with the batch's answers."""
    return with_completions(rows, results, offset).select("i", P.think_prompt(F.col("prompt")).alias("prompt"), "completion")


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(S.strip_u(url)).endswith(".pdf"), F.lit(False))


def without_pdfs(results: DataFrame, url: str = "url") -> DataFrame:
    return results.filter(~is_pdf(F.col(url)))


def pdf_note(results: DataFrame, url: str = "url") -> DataFrame:
    """One row: kept, removed and the note that tells of it."""
    pdf = is_pdf(F.col(url))
    n = results.agg(F.count_if(~pdf).alias("kept"), F.count_if(pdf).alias("removed"))
    total = F.col("kept") + F.col("removed")
    return n.withColumn("note", F.concat(F.lit("已过滤掉 "), F.col("removed").cast("string"), F.lit(" 条 PDF 链接，保留 "), F.col("kept").cast("string"), F.lit(" / "), total.cast("string"), F.lit(" 条普通网页结果。")))


def tally(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def unfetched(rows: DataFrame) -> DataFrame:
    """Rows with a url and a blank content, whose bodies are still to be fetched."""
    return rows.filter(filled(["url"]) & (S.strip_u(F.coalesce("content", F.lit(""))) == ""))


def fetched_updates(fetched: DataFrame) -> DataFrame:
    """(url, content) to be written: what couldn't be fetched for now (null) isn't, what is gone for good ('') is."""
    return fetched.filter(F.col("content").isNotNull()).select("url", "content")


def from_offset(dim: DataFrame, offset: int, *order: str) -> DataFrame:
    """Companies of a universe from the ``offset``-th (from 1) on.  A universe is small, its order one window."""
    from pyspark.sql import Window

    return dim.withColumn("_n", F.row_number().over(Window.orderBy(*order))).filter(F.col("_n") >= offset).drop("_n")


def dry_run(requests: DataFrame, *order: str) -> DataFrame:
    """What a run would fetch first."""
    return requests.orderBy(*order).limit(SHOWN)


def consensus_comments(comments: DataFrame, n: int = CONSENSUS) -> DataFrame:
    """The comments of each symbol that a consensus is asked of: the most engaging (clicks and replies), at most n."""
    from .merge import top_per_group

    engagement = S.truncated_int(F.col("click_count")) + S.truncated_int(F.col("comment_count"))
    return top_per_group(comments, ["symbol"], n, engagement.desc(), "url")


def chosen_bodies(chosen: DataFrame, listed: DataFrame, content: DataFrame, most: int = 10) -> DataFrame:
    """Second stage of the news: bodies of the first ``most`` urls that the first stage named (symbol, ids) for a symbol."""
    ids = chosen.select("symbol", F.posexplode(F.slice("ids", 1, most)).alias("place", "url"))
    return ids.join(with_bodies(listed, content).drop("symbol"), "url").select("symbol", "place", "url", "item_date", "title", "content")


def feedback(predictions: DataFrame, realised: DataFrame) -> DataFrame:
    """Rows for the feedback log: predictions (symbol, day, snapshot, output) with the label that came true, if known."""
    return predictions.join(realised.select("symbol", "day", "label"), ["symbol", "day"], "left")


def append_feedback(log: Table, predictions: DataFrame, realised: DataFrame, batch: int, source: str = "feedback") -> bool:
    """Append the rows of a batch to the feedback log; False if the log holds the batch already."""
    now = log.current()
    if now and now.ledger.get(source, -1) >= batch:
        return False
    log.append(feedback(predictions, realised), {source: batch})
    return True
