"""What a symbol's comments agree on: clusters of comments about the same thing, and how they feel.

A comment belongs to the most discussed of its words: words are ranked by how many of the symbol's comments hold them (two
at least), and a comment's word of the best rank names its cluster.  Comments without such a word are a cluster of their
own ('').  A comment feels positive or negative by whether it has more rising or more falling words, else neutral.

All of it is grouping and joining by symbol and word; counts are combined within tasks before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moods, and words that tell of them.
MOODS = ("positive", "neutral", "negative")
RISING, FALLING = ("涨", "利好", "买入", "看多"), ("跌", "利空", "卖出", "看空")


def words(title: Column) -> Column:
    """Different words of a title: runs of letters and digits, in lower case; of text without blanks, pairs of signs."""
    runs = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))
    han = lambda w: F.regexp_like(w, F.lit(r"\p{IsHan}"))
    pairs = F.flatten(F.transform(F.filter(runs, han), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.filter(runs, lambda w: ~han(w)), pairs))


def mood(title: Column, rising: tuple[str, ...] = RISING, falling: tuple[str, ...] = FALLING) -> Column:
    held = lambda names: sum((F.contains(F.coalesce(title, F.lit("")), F.lit(n)).cast("int") for n in names), F.lit(0))
    up, down = held(rising), held(falling)
    return F.when(up > down, MOODS[0]).when(up < down, MOODS[2]).otherwise(MOODS[1])


def clustered(comments: DataFrame, least: int = 2) -> DataFrame:
    """``comments`` (symbol, url, post_title, ...) with ``topic`` (the cluster's word) and ``mood``.

    Each (symbol, url) is one comment.  Words that every comment of a symbol holds say nothing and are left out, unless
    it has but one.
    """
    held = comments.select("symbol", "url", F.explode(words(F.col("post_title"))).alias("word"))
    n = comments.groupBy("symbol").agg(F.count("*").alias("_all"))
    counts = held.groupBy("symbol", "word").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).join(n, "symbol").filter(F.col("_n") < F.col("_all")).drop("_all")
    best = held.join(counts, ["symbol", "word"]).groupBy("symbol", "url").agg(F.min(F.struct((-F.col("_n")).alias("n"), "word"))["word"].alias("topic"))
    return comments.join(best, ["symbol", "url"], "left").withColumns({"topic": F.coalesce("topic", F.lit("")), "mood": mood(F.col("post_title"))})


def consensus(comments: DataFrame, weight: Column | None = None, topics: int = 10) -> DataFrame:
    """A row a symbol: n, distribution (JSON of mood to share, of six places) and clusters: the ``topics`` largest as JSON
    of topic, n, shares and the comment of most ``weight`` (the first url of equal ones)."""
    placed = clustered(comments).withColumn("_w", F.lit(0) if weight is None else weight)
    counts = [F.count_if(F.col("mood") == m).alias(m) for m in MOODS]
    share = lambda m: F.round(F.col(m) / F.col("n"), 6).alias(m)
    shares = F.struct(*[share(m) for m in MOODS])
    first = F.min_by("url", F.struct(-F.col("_w"), "url")).alias("example")
    own = placed.groupBy("symbol", "topic").agg(F.count("*").alias("n"), first, *counts)
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "topic"))).filter(F.col("_r") <= topics)
    told = ranked.groupBy("symbol").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct("topic", "n", "example", shares.alias("mood")).alias("c")))), lambda x: x["c"])).alias("clusters"))
    whole = own.groupBy("symbol").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in MOODS]).select("symbol", "n", F.to_json(shares).alias("distribution"))
    return whole.join(told, "symbol")
