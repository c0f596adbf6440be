"""Boilerplate lines by how many of a site's pages hold them.

For each host the pages that hold a line are counted (a page counts once) and divided by the host's pages; lines
over ``ratio`` that at least ``min_pages`` pages hold (two: a line of one page repeats nowhere) are dropped from all
pages of that host, however few it has.  Only built-in functions are used.  Counting is by (host, line hash), so a hot host
spreads over all tasks and repeated lines are counted before they are shuffled; texts are shuffled once, by page.  The
lines to drop are copied to SALT parts of a host's pages, so that a line of very many pages meets them in many tasks.

A null host is the site ''; null and empty texts have no lines and stay as they are; repeated rows count as pages of
their own and get the same result.  Blank lines are never dropped from texts.  Extra columns of the input stay, but
for ``kept`` and ``n_dropped``, which are replaced.

A text that many pages of a host repeat is no boilerplate, though its lines are frequent: with ``distinct`` pages of a
host with equal lines count once, as one page, so that copies make no line frequent.  With ``groups`` (text_hash, grp) so
do pages of one group, such as near copies; a text in no group is one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

RATIO, MIN_PAGES = 0.1, 2
#: Parts of the pages of a host that hold one line to drop.
SALT = 16

UNSEEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|br|tr|td|th|table|title|body|html|head|main|aside)([ /][^>]*)?>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Trimmed lines of a page that aren't empty: text between block tags, other tags removed."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAKS, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of the lines to drop.  ``pages`` has host and hashes (of its lines); if it
    has grp as well, pages with one value of it count as one.

    A page's own row, without a line, is counted along with its lines, so pages are read once; what is counted more than
    once is checkpointed.
    """
    grp = ["grp"] if "grp" in pages.columns else []
    own = F.array_append(F.array_distinct(F.coalesce("hashes", F.array().cast("array<bigint>"))), F.lit(None).cast("bigint"))
    lines = pages.select("host", *grp, F.explode(own).alias("line_hash"))
    counts = (lines.distinct() if grp else lines).groupBy("host", "line_hash").agg(F.count("*").alias("n_pages"))
    counted = cut(counts.filter((F.col("n_pages") >= min_pages) | F.col("line_hash").isNull()))
    hosts = counted.filter("line_hash is null").select("host", F.col("n_pages").alias("host_pages"))
    return counted.filter("line_hash is not null").join(hosts, "host").filter(F.col("n_pages") > ratio * F.col("host_pages"))


def text_hash(lines: str) -> Column:
    return F.xxhash64(lines)


def line_dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """``pages`` (key, host, lines) with the columns kept (its lines without boilerplate) and n_dropped.

    Blank lines stay.  ``key`` identifies a page; null keys are allowed.  ``distinct`` and ``groups``: see above.
    """
    hashes = F.filter(F.transform("lines", lambda x: F.when(F.trim(x) != "", F.xxhash64(x))), lambda h: h.isNotNull())
    pages, site = pages.drop("kept", "n_dropped"), F.coalesce("host", F.lit(""))
    hashed = pages.select("key", site.alias("host"), hashes.alias("hashes"))
    counted = hashed.select("host", "hashes")
    if distinct or groups is not None:
        counted = pages.select(site.alias("host"), hashes.alias("hashes"), text_hash("lines").alias("text_hash")).dropDuplicates(["host", "text_hash"])
        if groups is None:
            counted = counted.drop("text_hash")
        else:
            counted = counted.join(groups.select("text_hash", "grp"), "text_hash", "left").select("host", "hashes", F.coalesce("grp", "text_hash").alias("grp"))
    gone = boilerplate(counted, ratio, min_pages).select("host", "line_hash", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    dropped = (
        hashed.select("key", "host", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt"), F.explode(F.array_distinct("hashes")).alias("line_hash"))
        .join(gone, ["host", "line_hash", "salt"])
        .groupBy("key", "host")
        .agg(F.collect_set("line_hash").alias("dropped"))
    )
    joined = pages.alias("p").join(dropped.alias("d"), F.col("p.key").eqNullSafe(F.col("d.key")) & (F.coalesce("p.host", F.lit("")) == F.col("d.host")), "left")
    kept = F.when(F.col("d.dropped").isNull(), F.col("p.lines")).otherwise(F.filter("p.lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("d.dropped"), F.xxhash64(x))))
    out = joined.select("p.*", kept.alias("kept"))
    return out.withColumn("n_dropped", F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(key, host, lines) of raw web pages (page_id, url, html)."""
    lines = F.coalesce(html_lines(F.col("html").cast("string")), F.array().cast("array<string>"))
    return spread(pages.select("page_id", "url", "html")).select(F.col("page_id").cast("long").alias("key"), host_of(F.col("url").cast("string")).alias("host"), lines.alias("lines"))


def document_lines(documents: DataFrame) -> DataFrame:
    """(key, host, lines) of documents, whose source is the site."""
    return documents.select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("")).alias("host"), F.split("text", "\n").alias("lines"))
