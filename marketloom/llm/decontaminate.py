"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index holds postings (document, term, position) of training tokens.  Each test window (``width`` consecutive
words of an item; a shorter item is one window) is searched from its rarest terms: first the postings lists of all
test terms are measured over the whole training text; then the lists of each window's ``n_rarest`` rarest terms are
shifted by the terms' offsets and intersected by (document, window, start); starts that all of them share are
confirmed.  ``proximity_matches`` finds the windows whose rarest terms lie close together.

``StoredIndex`` searches postings that ``write_postings`` has stored once for a training text; it confirms on the
lists of the other terms.  ``Index`` is for one search of a training text: it takes the postings of the rarest terms
while the tokens stream by, each with the ``width - 1`` words before and after it, on which it confirms.

If the test texts are within ``BROADCAST_BYTES`` the windows are broadcast.  Beyond that tokens are held against a
bitmap of the wanted terms (``BITMAP`` bits, broadcast), and those that pass are shuffled by term: counts are summed
before, postings travel with their few words, and each term's list is dealt over ``SALT`` parts, so a term that is
everywhere is in no single task.  Word arrays are never shuffled.

Null and empty texts have no words: they are never hit.  Items with no words have no windows.  Repeated rows of a
document get the same result each; rows with one id and different texts are told apart by the text's hash.  Extra
columns of either side are not used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain_ids

WIDTH, N_RAREST = 10, 2
#: Bits of the bitmap of wanted terms (a multiple of 64), and parts of a term's list, where the windows aren't broadcast.
BITMAP, SALT = 1 << 20, 8
#: Test texts up to this many bytes are broadcast; their windows take some fifteen times as much.
BROADCAST_BYTES = 4_000_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order, with only A-Z lower-cased."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, win_id, item_ids): each distinct window of words with the items that hold it."""
    worded = items.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))
    cut = worded.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item_id").alias("item_ids")).withColumn("win_id", F.md5(F.array_join("window", " ")))


def bitmap(terms: DataFrame) -> DataFrame:
    """One row: bits, BITMAP of them in longs, set at the places of the terms."""
    place = F.pmod(F.xxhash64("term"), F.lit(BITMAP))
    held = terms.groupBy(F.floor(place / 64).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(term), {BITMAP}), 64) as int))")).alias("word"))
    held = held.unionByName(terms.sparkSession.range(BITMAP // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("word"))).groupBy("i").agg(F.max_by("word", F.col("word") != 0).alias("word"))
    return held.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("bits"))


class Index:
    """Postings of the training text for the terms of a set of test items."""

    def __init__(self, documents: DataFrame, items: DataFrame, width: int = WIDTH, n_rarest: int = N_RAREST):
        self.tokens = plain_ids(documents, "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
        n_bytes = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        self.is_small = n_bytes <= BROADCAST_BYTES
        self.windows, self.width, self.n_rarest = windows_of(items, width), width, n_rarest

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.is_small else df

    def may_be(self, tokens: DataFrame, terms: DataFrame) -> DataFrame:
        """Rows of ``tokens`` whose term may be one of ``terms``."""
        hit = F.expr(f"shiftright(bits[cast(pmod(xxhash64(term), {BITMAP}) div 64 as int)], cast(pmod(pmod(xxhash64(term), {BITMAP}), 64) as int)) & 1L = 1L")
        return tokens.join(F.broadcast(bitmap(terms))).filter(hit).drop("bits")

    def list_lengths(self) -> DataFrame:
        """(term, n) over the whole training text, for all test terms; n is 0 where a term doesn't occur."""
        terms = self.windows.select(F.explode("window").alias("term")).distinct()
        tokens = self.tokens.select(F.explode("words").alias("term"))
        if self.is_small:
            met = tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
        else:
            met = self.may_be(tokens, terms).groupBy("term").agg(F.count("*").alias("n"))
        return terms.join(met, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))

    def rarest(self) -> DataFrame:
        return rarest_of(self.windows, self.list_lengths(), self.n_rarest)

    def postings(self, terms: DataFrame) -> DataFrame:
        """Columns of ``terms`` (one row a term and use) with doc_id, text_hash, pos (from 0), n_words, and context:
        words around the posting, ``before`` of them before it (all words where they needn't be shuffled)."""
        placed = self.tokens.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "term")).withColumn("n_words", F.size("words"))
        if self.is_small:
            return placed.join(F.broadcast(terms), "term").withColumn("before", F.col("pos")).withColumnRenamed("words", "context")
        before = F.least(F.col("pos"), F.lit(self.width - 1))
        near = self.may_be(placed, terms).withColumns({"before": before, "context": F.slice("words", F.col("pos") - before + 1, before + self.width)}).drop("words")
        salt = F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(SALT)).cast("int")
        dealt = terms.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
        return near.withColumn("salt", salt).join(dealt, ["term", "salt"]).drop("salt")

    def phrase_matches(self) -> DataFrame:
        """(doc_id, text_hash, start, n, win_id): every occurrence of a window in the training text."""
        n = F.size("window")
        start = F.col("pos") - F.col("shift")
        shifted = self.postings(self.rarest()).filter((start >= 0) & (start + n <= F.col("n_words")))
        same = F.slice("context", F.col("before") - F.col("shift") + 1, n) == F.col("window")
        lists = shifted.select("doc_id", "text_hash", "win_id", start.alias("start"), n.alias("n"), "n_slots", "slot", same.alias("same"))
        met = lists.groupBy("doc_id", "text_hash", "win_id", "start", "n", "n_slots").agg(F.count_distinct("slot").alias("met"), F.bool_and("same").alias("same"))
        return met.filter((F.col("met") == F.col("n_slots")) & F.col("same")).select("doc_id", "text_hash", "start", "n", "win_id")

    def proximity_matches(self, slop: int = 20) -> DataFrame:
        """(doc_id, text_hash, win_id, first, last): places where a window's rarest terms, in any order, lie within
        ``slop`` words: for each posting of the rarest, the nearest of each other list."""
        lists = self.postings(self.rarest()).select("doc_id", "text_hash", "win_id", "slot", "n_slots", "pos")
        keys = ["doc_id", "text_hash", "win_id"]
        by_pos = Window.partitionBy(*keys).orderBy("pos").rangeBetween(-slop, slop)
        near = lists.withColumn("slots", F.size(F.collect_set("slot").over(by_pos))).withColumn("first", F.min("pos").over(by_pos)).withColumn("last", F.max("pos").over(by_pos))
        return near.filter((F.col("slot") == 1) & (F.col("slots") == F.col("n_slots"))).select(*keys, "first", "last").distinct()


def rarest_of(windows: DataFrame, lengths: DataFrame, n_rarest: int) -> DataFrame:
    """(win_id, window, term, shift, slot, n_slots): the rarest terms of each window and their offsets.
    Windows with a term that occurs nowhere can't be found and are left out."""
    placed = windows.select("win_id", "window", F.posexplode("window").alias("shift", "term"))
    order = Window.partitionBy("win_id").orderBy("n", "term", "shift")
    ranked = placed.join(lengths, "term").withColumn("slot", F.row_number().over(order))
    ranked = ranked.withColumn("least", F.min("n").over(Window.partitionBy("win_id"))).filter("least > 0")
    n_slots = F.least(F.size("window"), F.lit(n_rarest))
    return ranked.filter(F.col("slot") <= n_slots).select("win_id", "window", "term", "shift", "slot", n_slots.alias("n_slots"))


def write_postings(documents: DataFrame, path: str) -> None:
    """Store (term, doc_id, text_hash, pos) of the whole training text in ``path`` as Parquet, in ranges of term and
    document: row groups that lack the wanted terms are skipped, and a frequent term's list is many files."""
    text = F.col("text").cast("string")
    tokens = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words")).dropDuplicates(["doc_id", "text_hash"])
    rows = tokens.select(F.posexplode("words").alias("pos", "term"), "doc_id", "text_hash").select("term", "doc_id", "text_hash", "pos")
    rows.repartitionByRange("term", "doc_id", "text_hash").sortWithinPartitions("term", "doc_id", "text_hash", "pos").write.parquet(path)


class StoredIndex:
    """Search of stored postings, without the texts."""

    def __init__(self, postings: DataFrame, items: DataFrame, width: int = WIDTH, n_rarest: int = N_RAREST):
        self.windows, self.n_rarest = windows_of(items, width), n_rarest
        self.lists = postings.join(self.windows.select(F.explode("window").alias("term")).distinct(), "term", "left_semi")

    def phrase_matches(self) -> DataFrame:
        """(doc_id, text_hash, start, n, win_id): every occurrence of a window in the training text."""
        terms = self.windows.select(F.explode("window").alias("term")).distinct()
        lengths = terms.join(self.lists.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
        keys = ["doc_id", "text_hash", "win_id", "start"]
        met = self.lists.join(rarest_of(self.windows, lengths, self.n_rarest), "term").withColumn("start", F.col("pos") - F.col("shift")).groupBy(*keys, "n_slots").agg(F.count_distinct("slot").alias("met"))
        starts = met.filter("met = n_slots and start >= 0").select(*keys).join(self.windows.select("win_id", "window"), "win_id")
        wanted = starts.select(*keys, F.size("window").alias("n"), F.posexplode("window").alias("shift", "term")).withColumn("pos", F.col("start") + F.col("shift"))
        lists = self.lists.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
        found = wanted.join(lists, (wanted["doc_id"].eqNullSafe(lists["d"])) & (wanted["text_hash"] == lists["h"]) & (wanted["term"] == lists["term"]) & (wanted["pos"] == lists["pos"]))
        return found.groupBy(*keys, "n").agg(F.count("*").alias("met")).filter("met = n").select("doc_id", "text_hash", "start", "n", "win_id")


def decontaminate(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), n_items and item_ids (items with occurring
    windows, sorted as strings), a row for each row of ``documents``."""
    index = Index(documents, items, width)
    found = index.phrase_matches().join(index.small(index.windows.select("win_id", "item_ids")), "win_id")
    covered = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"),
        F.collect_set("win_id").alias("win_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    # Spans come sorted by start: each adds what lies beyond the furthest end so far.
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("hit"),
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        ),
        lambda a: a["hit"],
    )
    hits = covered.select("doc_id", "text_hash", union.cast("long").alias("n_hit"), F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))).alias("item_ids"))
    sized = index.tokens.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    same = sized["doc_id"].eqNullSafe(hits["doc_id"]) & sized["text_hash"].eqNullSafe(hits["text_hash"])
    return sized.join(hits, same, "left").select(
        sized["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )
