"""Live views of companies: newest comments, summaries of their sections, predictions by a text model.

The model is a client as in ``sources.fetch.generate``; what it is told besides the data is the caller's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scalars as S
from ..operators.merge import keep_first, top_per_group
from ..sources.fetch import Fetcher, fetch, generate

Client = Callable[[list[str]], list[str]]
#: The sections that can be summarised, and what stands for a summary that isn't there.
SECTIONS, MISSING = ("comments", "news", "reports", "serp"), "未提供"


def needed(value: Column, fine: Column, message: str) -> Column:
    """``value`` where it is fine, else an error."""
    return F.when(fine, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def answers(asked: DataFrame, client: Client, name: str) -> DataFrame:
    said = S.strip_u(F.coalesce("raw_output", F.lit("")))
    return generate(asked, client).select(*[c for c in asked.columns if c != "prompt"], needed(said, said != "", "the model gave no answer").alias(name))


def section_summaries(companies: DataFrame, section: str, client: Client, instructions: str = "") -> DataFrame:
    """(symbol, summary) of a section's items (symbol, name, items); a company without items is an error."""
    kind = (section or "").strip().lower()
    if kind not in SECTIONS:
        raise ValueError(f"no section {section!r}; there are {', '.join(SECTIONS)}")
    head = F.concat(F.lit("股票："), F.col("name"), F.lit("（"), F.col("symbol"), F.lit("）\n" + instructions + "\n"))
    prompt = F.concat(head, P.section_items(F.col("items"), kind))
    asked = companies.select("symbol", needed(prompt, F.coalesce(F.size("items"), F.lit(0)) > 0, "nothing to summarise").alias("prompt"))
    return answers(asked, client, "summary")


def trend_predictions(companies: DataFrame, client: Client, instructions: str = "") -> DataFrame:
    """(symbol, prediction) from bars and summaries (symbol, name, kline, news_summary, reports_summary, serp_summary);
    a company without bars is an error, missing summaries are named as such."""
    told = lambda label, c: F.concat(F.lit(f"{label} Summary：\n"), F.coalesce(F.nullif(S.strip_u(F.col(c)), F.lit("")), F.lit(MISSING)))
    parts = [F.concat(F.lit("股票："), F.col("name"), F.lit("（"), F.col("symbol"), F.lit("）")), F.lit(""), F.lit("最近 7 个交易日 K 线："), P.live_days(F.col("kline")), F.lit("")]
    parts += [told("新闻", "news_summary"), F.lit(""), told("研报", "reports_summary"), F.lit(""), told("SerpAPI", "serp_summary"), F.lit(""), F.lit(instructions)]
    asked = companies.select("symbol", needed(F.concat_ws("\n", *parts), F.coalesce(F.size("kline"), F.lit(0)) > 0, "no bars to predict from").alias("prompt"))
    return answers(asked, client, "prediction")


JUDGEMENT = "direction string, horizon int, confidence double, evidence array<string>, conflicts array<string>"
#: Horizons in trading days, and the form in which a judgement is asked for.
HORIZONS = (1, 3, 7)
JUDGED = '\n请综合以上各方信息，只输出一个 JSON 数组，每个元素对应一个时间尺度（1、3、7 个交易日）：[{"direction": "涨或跌", "horizon": 1, "confidence": 0到1的小数, "evidence": ["主要依据"], "conflicts": ["冲突点"]}]'


def judged_predictions(companies: DataFrame, client: Client, instructions: str = "") -> DataFrame:
    """(symbol, direction, horizon, confidence, evidence, conflicts): what the model judges of each horizon, from the same
    inputs as ``trend_predictions``.

    A judgement counts if its direction is one of the two, its horizon one of HORIZONS and its confidence from 0 to 1; of
    several for a horizon the most confident.  A company of which no judgement can be read has one row with the failure's
    mark and no horizon.
    """
    said = trend_predictions(companies, client, instructions + JUDGED)
    text = F.regexp_extract("prediction", r"(?s)\[.*\]", 0)
    fine = lambda j: j["direction"].isin(S.UP, S.DOWN) & j["horizon"].isin(*HORIZONS) & j["confidence"].between(0.0, 1.0)
    read = said.select("symbol", F.filter(F.coalesce(F.from_json(text, f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in JUDGEMENT.split(', '))}>>"), F.array()), fine).alias("j"))
    failed = F.array(F.from_json(F.lit(f'{{"direction": "{S.FAILED}"}}'), JUDGEMENT))
    each = read.select("symbol", F.explode(F.when(F.size("j") > 0, F.col("j")).otherwise(failed)).alias("j")).select("symbol", "j.*")
    return keep_first(each, ["symbol", "horizon"], F.desc_nulls_last("confidence"), "direction")


def newest_comments(posts: DataFrame, limit: int = 10, max_pages: int = 3) -> DataFrame:
    """The first ``limit`` different posts of each symbol in page order (page, pos), numbered by time, newest first.

    The limit goes by page order, the number by time: what is newer but stands later isn't taken.
    """
    from pyspark.sql import Window

    listed = posts.filter((F.col("page") <= max_pages) & (F.coalesce(F.trim("url"), F.lit("")) != ""))
    taken = top_per_group(keep_first(listed, ["symbol", "url"], "page", "pos"), ["symbol"], limit, "page", "pos")
    return taken.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("publish_time"), "page", "pos")))


def article_bodies(wanted: DataFrame, fetcher: Fetcher, kind: str = "generic") -> DataFrame:
    """(url, content) of pages: fetched (url, html) and read by the extractor of their kind; '' where nothing is found."""
    from ..functions.html import extractor

    pages = fetch(wanted.select("url").distinct(), fetcher, "url string, html string")
    return pages.select("url", F.coalesce(extractor(kind)("html"), F.lit("")).alias("content"))


def with_contents(results: DataFrame, fetcher: Fetcher) -> DataFrame:
    """Search results (url, ...) with the text of their pages."""
    bodies = article_bodies(results, fetcher)
    return results.join(bodies, "url", "left").withColumn("content", F.coalesce("content", F.lit("")))
