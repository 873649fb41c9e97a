"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed is a hash of the words at a fixed mask's selected places; the places between are ignored, so a substituted word there
doesn't break it. Seeds of all benchmark items meet those at each place of all documents in an equi-join. A hit fixes how
document and item lie side by side; around it the best overlap is found with one point for each equal word and one off for
each different one, which bears substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import small_enough, stored

#: Fixed masks; 1 marks a word that counts. Each has a gap at some phase of substitutions at every fifth word.
MASKS = ("11101011", "1101100011", "1010011011")
#: Points of an overlap that make a leak, or half of an item's words where that is less.
MIN_SCORE = 8
#: Hits of a text that are looked at in one row.
HITS = 1024
#: What lies between words.
BREAK = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(text)), BREAK), lambda w: w != "")


def seed(mask: str, array: str, place: str) -> Column:
    """The hash of the words that ``mask`` selects from ``place`` on."""
    chosen = [F.get(F.col(array), F.col(place) + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(mask), *chosen)


def seeds(table: DataFrame, masks: tuple[str, ...], array: str, keep: list[str], whole: bool) -> DataFrame:
    """(keep..., place, seed) at each place of the array ``array``; with ``whole`` only where the mask fits in."""
    at = table.select(*keep, array, F.explode(F.sequence(F.lit(0), F.size(array) - 1)).alias("place"))
    made = [F.when(F.col("place") + len(m) <= F.size(array), seed(m, array, "place")) if whole else seed(m, array, "place") for m in masks]
    out = at.select(*keep, "place", F.explode(F.array(*made)).alias("seed"))
    return out.filter("seed is not null") if whole else out


def leaks(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, n_matched, item_words) of each document and benchmark item that overlap.

    ``docs`` has doc_id and text, ``items`` item_id and text. score is the overlap's, n_matched the equal words in it. Items
    shorter than the shortest mask must occur whole. Texts without words, and nulls, overlap with nothing. Very long texts are
    searched whole; a hit there takes as many words along as its item has. Rows of one doc_id, or of one item_id, are told
    apart by nothing and count together; null ids are ids like others. Other columns are not read; empty tables give an
    empty result.
    """
    items = stored(items.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("item")).filter("size(item) > 0").distinct(), "items")
    shortest = min(map(len, masks))
    short = [r[0] for r in items.filter(F.size("item") < shortest).select(F.size("item")).distinct().collect()]
    own = seeds(items, masks, "item", ["item_id", "item"], True)
    whole = items.filter(F.size("item") < shortest).withColumn("place", F.lit(0))
    for n in short:
        own = own.unionByName(whole.filter(F.size("item") == n).select("item_id", "item", "place", seed("1" * n, "item", "place").alias("seed")))
    own = stored(own.select("item_id", F.xxhash64("item").alias("version"), "place", "seed").distinct(), "seeds")
    right = own.withColumnRenamed("place", "from")
    if small_enough(own.count(), 40):
        right = F.broadcast(right)

    # The text's hash tells rows of one id, or of none, apart; rows that are equal in both have the same overlaps.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    placed = seeds(texts.select("doc_id", "row", words("text").alias("doc")).filter("size(doc) > 0"), masks + tuple("1" * n for n in short), "doc", ["doc_id", "row"], False)
    met = placed.join(right, "seed").select("doc_id", "row", "item_id", "version", (F.col("place") - F.col("from")).alias("shift"))
    hits = stored(met.distinct(), "hits")

    # A document's words are made once, and of them a hit takes only what lies beside its item.
    sizes = items.select(F.col("item_id").alias("__item"), F.xxhash64("item").alias("__version"), F.size("item").alias("item_words"))
    same_item = F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("version") == F.col("__version"))
    # A text with many hits has them in several rows, of about HITS each.
    many = stored(hits.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.ceil(F.count("*") / HITS).alias("parts")).filter("parts > 1"), "many")
    if small_enough(many.count(), 64):
        many = F.broadcast(many)
    part = F.pmod(F.xxhash64("item_id", "version", "shift"), F.coalesce("parts", F.lit(1).cast("long")))
    dealt = hits.join(many, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("part", part).drop("__id", "__row")
    by_id = dealt.join(sizes, same_item).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "part").agg(F.collect_list(F.struct("item_id", "version", "shift", "item_words")).alias("hits"))
    by_id = stored(by_id.drop("part"), "found")
    if small_enough(hits.count(), 64):
        by_id = F.broadcast(by_id)
    pairs = texts.join(by_id, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", words("text").alias("doc"), "hits")

    def beside(doc: Column, h: Column) -> Column:
        first = F.greatest(F.lit(0), h["shift"])
        last = F.least(F.size(doc), h["shift"] + h["item_words"])
        window = F.slice(doc, first + 1, F.greatest(last - first, F.lit(0)))
        return F.struct(h["item_id"].alias("item_id"), h["version"].alias("version"), (first - h["shift"]).alias("from"), window.alias("window"))

    cut = F.get(F.transform(F.array(F.struct("doc", "hits")), lambda s: F.transform(s["hits"], lambda h: beside(s["doc"], h))), F.lit(0))
    pairs = pairs.select("doc_id", F.explode(cut).alias("h")).select("doc_id", "h.*").filter("size(window) > 0").distinct()
    named = items.select(F.col("item_id").alias("__item"), F.xxhash64("item").alias("__version"), "item")
    if small_enough(items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0], 32):
        named = F.broadcast(named)
    pairs = pairs.join(named, same_item)
    equal = F.zip_with("window", F.slice("item", F.col("from") + 1, F.size("window")), lambda a, b: F.when(a == b, 1).otherwise(-1))
    zero = F.struct(*(F.lit(0).alias(x) for x in ("now", "equal", "best", "matched")))

    def step(s: Column, x: Column) -> Column:
        now, same = F.greatest(s.now, F.lit(0)) + x, F.when(s.now > 0, s.equal).otherwise(0) + F.when(x > 0, 1).otherwise(0)
        better = now > s.best
        return F.struct(now.alias("now"), same.alias("equal"), F.when(better, now).otherwise(s.best).alias("best"), F.when(better, same).otherwise(s.matched).alias("matched"))

    best = F.aggregate(equal, zero, step, lambda s: F.struct(s.best.alias("score"), s.matched.alias("matched")))
    scored = pairs.select("doc_id", "item_id", F.size("item").cast("long").alias("item_words"), best.alias("o"))
    needed = F.least(F.lit(min_score), F.when(F.col("item_words") < shortest, F.col("item_words")).otherwise(F.ceil(F.col("item_words") / 2)))
    found = scored.filter(F.col("o.score") >= needed).groupBy("doc_id", "item_id").agg(F.max(F.struct("o.score", "o.matched", "item_words")).alias("m"))
    return found.select("doc_id", "item_id", F.col("m.score").cast("long").alias("score"), F.col("m.matched").cast("long").alias("n_matched"), "m.item_words")
