"""Phrases whose words stand together more often than chance, from position bitmaps.

A task's texts become shards: the words of two megabytes of one group's text at numbered positions, with an empty position between
two pieces. In a shard each word has a bitmap of its positions, of which only the bytes that aren't zero are kept. A phrase
is extended by shifting its bitmap by one and intersecting it with the bitmaps of all words: bits of its bytes meet those of
the words in the same byte, and the population counts say how often each longer phrase occurs. An empty position stops the
shift at a piece's end. Extension goes depth first over blocks of first words, so a task holds one block's bitmaps.

Counts of shards are summed by Spark. A phrase is only extended if it may be frequent everywhere: the frequent phrases of
each length go to all tasks as a bit filter of a bounded size. It has no false negatives, and false positives only cost
counts that the exact sum drops, so the result doesn't depend on the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ship, small_enough, stored, text_slices
from quarryline.llm.linedup import BLOCK, MOST_BITS, cut_by, hashed, held, part_of, positions
from quarryline.llm.units import spread

#: What ends a piece and what separates words (fixed values).
BREAKS, SPACES = ".,;:!?\n\x0b\x0c\r", " \t"
#: Bytes of text of a shard, and of all shards that a task has begun.
SHARD, BEGUN = 2 << 20, 8 << 20
#: Bytes of bitmaps of a block of first words; one word's may be more.
ENTRIES = 1 << 16
#: Tasks over which a frequent part's phrases are spread where counts are too large to be sent to all tasks.
SALT = 32

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in SPACES]] = 1
_KIND[[ord(c) for c in BREAKS]] = 2


def sections(text: str, most: int = SHARD) -> Iterator[str]:
    """A text cut at ends of pieces into sections of up to ``most`` characters; a longer piece stays whole."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at + 1, at + most) for c in BREAKS)
        if cut < 0:
            cut = min((i for c in BREAKS if (i := text.find(c, at + most)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def shard(texts: list[str]) -> tuple[pa.Array, np.ndarray, int]:
    """The distinct words of texts, the word's number at each position or -1, and the number of words."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    kind = _KIND[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kind == 0, [0]])))
    starts, ends = edges[::2], edges[1::2]
    letters = pa.py_buffer(data[kind == 0])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), letters).dictionary_encode()
    piece = np.cumsum(kind == 2)[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])[: len(starts)]
    codes = np.full(int(place[-1]) + 1 if len(place) else 0, -1, np.int32)
    codes[place] = words.indices.to_numpy(zero_copy_only=False)
    return words.dictionary, codes, len(starts)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, int]]:
    """The shards of a task's rows (grp, text), with their group's name."""
    begun: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}

    def done(name: str) -> tuple[str, pa.Array, np.ndarray, int]:
        del sizes[name]
        return name, *shard(begun.pop(name))

    for batch in text_slices(batches, most=SHARD):
        for name, whole in zip(batch.column("grp"), batch.column("text"), strict=True):
            name = name.as_py()
            for part in sections(whole.as_py()):
                if name in sizes and sizes[name] + len(part) > SHARD:
                    yield done(name)
                begun.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + len(part) + 1
                if sum(sizes.values()) > BEGUN:
                    yield done(max(sizes, key=sizes.__getitem__))
    for name in list(begun):
        yield done(name)


def mixed(words: np.ndarray, start: np.uint64) -> np.ndarray:
    """A hash of each row of words' hashes, begun with the group's."""
    with np.errstate(over="ignore"):
        h = np.full(len(words), start, np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def group_hash(name: str) -> np.uint64:
    return hashed(pa.array([name]))[0]


class Filter:
    """Whether a phrase may be among the frequent ones."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return held(self.data, hashes, part_of(hashes, self.bits))


def filter_of(frequent: DataFrame, size: int) -> Filter:
    """The filter of the phrases of ``size`` words (grp, phrase): 16 bits a phrase, MOST_BITS at most."""
    bits = BLOCK
    n = frequent.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            names = np.array(batch.column("grp").to_pylist(), object)
            for name in set(names.tolist()):
                phrases = batch.column("phrase").filter(pa.array(names == name))
                words = pc.list_flatten(pc.split_pattern(phrases, " "))
                hashes = mixed(hashed(words).reshape(-1, size), group_hash(name))
                found.append((positions(hashes) + part_of(hashes, bits) * BLOCK).ravel())
            at = np.unique(np.concatenate(found))
            blocks, values = cut_by(at // BLOCK, (at % BLOCK).astype(np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(values, pa.binary())], ["block", "at"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(BLOCK, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, own = block, np.zeros(BLOCK, bool)
                own[np.frombuffer(at, np.uint16)] = True
        if now is not None:
            yield done()

    parts = frequent.select("grp", "phrase").mapInArrow(places, "block long, at binary").repartition("block").sortWithinPartitions("block")
    data = np.zeros(bits // 8, np.uint8)
    # Blocks of 8 KB, of a filter of MOST_BITS at most.
    for row in parts.mapInArrow(joined, "block long, bits binary").toLocalIterator():
        data[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, data)


class Bitmaps:
    """The position bitmaps of a shard's words: for each word the bytes that aren't zero and their places, and for each place
    the words with such a byte."""

    def __init__(self, codes: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        order = order[np.searchsorted(codes[order], 0) :]
        word, byte = codes[order], order >> 3
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (byte[1:] != byte[:-1])])) if len(order) else np.zeros(0, np.int64)
        bit = (np.uint8(1) << (order & 7).astype(np.uint8)).astype(np.uint8)
        self.word, self.byte = word[first].astype(np.int64), byte[first]
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        by_place = np.argsort(self.byte, kind="stable")
        self.place_word, self.place_bits = self.word[by_place], self.bits[by_place]
        self.place_start = np.concatenate([[0], np.cumsum(np.bincount(self.byte, minlength=(len(codes) >> 3) + 2))])

    def blocks(self, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of entries of whole words, of ``most`` entries or of one word."""
        ends = np.flatnonzero(np.concatenate([self.word[1:] != self.word[:-1], [True]])) + 1 if len(self.word) else np.zeros(0, np.int64)
        begin = 0
        while begin < len(self.word):
            k = max(int(np.searchsorted(ends, begin + most, side="right")) - 1, int(np.searchsorted(ends, begin, side="right")))
            yield begin, int(ends[k])
            begin = int(ends[k])

    def extended(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps of all phrases one word longer: the number of the shorter phrase, the word, the bytes' places and the bytes."""
        inside, over = bits << 1, bits >> 7
        phrase, byte = np.concatenate([phrase, phrase[over > 0]]), np.concatenate([byte, byte[over > 0] + 1])
        bits = np.concatenate([inside, over[over > 0]])
        counts = self.place_start[byte + 1] - self.place_start[byte]
        at = spread(self.place_start[byte], counts)
        both = self.place_bits[at] & np.repeat(bits, counts)
        there = np.flatnonzero(both)
        own = np.repeat(np.arange(len(byte)), counts)[there]
        return phrase[own], self.place_word[at[there]], byte[own], both[there]


def mine(words: pa.Array, codes: np.ndarray, name: str, filters: list[Filter], sizes: range, entries: int = ENTRIES) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of words' numbers and counts of the phrases of ``sizes`` words in a shard, whose parts the filters may hold.

    ``filters`` are those of 1, 2, ... words, of all sizes below the least of ``sizes`` at least.
    """
    start, own = group_hash(name), hashed(words)
    usable = filters[0](mixed(own[:, None], start)) if len(words) else np.zeros(0, bool)
    codes = np.where((codes >= 0) & usable[codes], codes, -1) if len(codes) else codes
    maps, many = Bitmaps(codes), len(words)

    def deeper(path: np.ndarray, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        size = path.shape[1] + 1
        shorter, word, byte, bits = maps.extended(phrase, byte, bits)
        keys, number = np.unique(shorter * many + word, return_inverse=True)
        path = np.concatenate([path[keys // many], (keys % many)[:, None]], axis=1)
        keep = np.ones(len(path), bool)
        if 2 < size <= len(filters) + 1:
            keep = filters[size - 2](mixed(own[path[:, 1:]], start))
        if size in sizes:
            counts = np.bincount(number, np.bitwise_count(bits), len(path)).astype(np.int64)
            yield list(path[keep].T), counts[keep]
        if size < sizes[-1]:
            if size <= len(filters):
                keep &= filters[size - 1](mixed(own[path], start))
            renumbered = np.cumsum(keep) - 1
            there = keep[number]
            if there.any():
                yield from deeper(path[keep], renumbered[number[there]], byte[there], bits[there])

    for begin, end in maps.blocks(entries):
        first, phrase = np.unique(maps.word[begin:end], return_inverse=True)
        yield from deeper(first[:, None], phrase, maps.byte[begin:end], maps.bits[begin:end])


def counted(texts: DataFrame, filters: list[Filter], sizes: range, min_count: int, label: str) -> DataFrame:
    """(grp, phrase, size, f) of the phrases of ``sizes`` words with ``min_count`` or more occurrences in ``texts`` (grp, text),
    stored. Words come with the number of all words of their group, as a phrase of no words."""
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, codes, n in shards(batches):
            if sizes[0] == 1:
                found = [([], np.array([n])), ([np.arange(len(words))], np.bincount(codes[codes >= 0], minlength=len(words)))]
            else:
                found = mine(words, codes, name, sent.value, sizes)
            for path, counts in found:
                for k in range(0, len(counts), 10_000):
                    parts = [words.take(pa.array(p[k : k + 10_000])) for p in path] or [pa.array([""], pa.large_string())]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    size = len(phrase)
                    columns = [pa.array([name] * size, pa.string()), phrase, pa.array(np.full(size, len(path), np.int32)), pa.array(counts[k : k + size], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["grp", "phrase", "size", "n"])

    rows = texts.mapInArrow(run, "grp string, phrase string, size int, n long")
    return stored(rows.groupBy("grp", "phrase", "size").agg(F.sum("n").alias("f")).filter((F.col("f") >= min_count) | (F.col("size") == 0)), label)


def with_counts(rows: DataFrame, counts: DataFrame, part: str, name: str, small: bool) -> DataFrame:
    """``rows`` with the count of their column ``part`` as ``name``."""
    own = counts.select(F.col("grp").alias("own_grp"), F.col("phrase").alias("own_phrase"), F.col("f").alias(name))
    on = (F.col("grp") == F.col("own_grp")) & (F.col(part) == F.col("own_phrase"))
    if small:
        return rows.join(F.broadcast(own), on).drop("own_grp", "own_phrase")
    own = own.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("grp", "phrase"), F.lit(SALT)).cast("int"))
    return salted.join(own, on & (F.col("salt") == F.col("own_salt"))).drop("own_grp", "own_phrase", "own_salt", "salt")


def scored(counts: DataFrame, totals: DataFrame, small: bool) -> DataFrame:
    """(grp, phrase, size, a, l, r, n, score) of phrases of two words or more: the cut with the least score, the first of
    equal ones. Products are decimals of 38 digits."""
    words = F.split("phrase", " ", -1)
    cuts = counts.filter("size > 1").select("grp", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("grp", "phrase", "size", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size), ' ')").alias("rest"))
    cuts = with_counts(with_counts(cuts, counts, "first", "l", small), counts, "rest", "r", small)
    least = cuts.groupBy("grp", "phrase", "size", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    n = totals.select(F.col("grp").alias("n_grp"), "n")
    least = least.join(F.broadcast(n) if small_enough(totals.count(), 128) else n, F.col("grp") == F.col("n_grp")).drop("n_grp")
    score = "(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(c.l as decimal(38,0)) * cast(c.r as decimal(38,0)))"
    best = least.withColumn("best", F.expr(f"array_min(transform(cuts, c -> named_struct('score', {score}, 'k', c.k, 'l', c.l, 'r', c.r)))"))
    return best.select("grp", "phrase", "size", "a", "best.l", "best.r", "n", "best.score")


def absorbed(counts: DataFrame, percent: int) -> DataFrame:
    """(grp, phrase): phrases within a longer one that has ``percent`` of their occurrences or more.

    A phrase between such two has as many occurrences as the longer one at least, so one word more is as far as one need look.
    """
    longer = counts.filter("size > 2").select("grp", F.split("phrase", " ", -1).alias("words"), "size", "f")
    parts = longer.select("grp", "f", F.explode(F.expr("array(slice(words, 1, size - 1), slice(words, 2, size - 1))")).alias("part"))
    most = parts.groupBy("grp", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    found = most.join(counts, ["grp", "phrase"]).filter(F.expr(f"100 * cast(longer as decimal(38,0)) >= {int(percent)} * cast(f as decimal(38,0))"))
    return found.select("grp", "phrase")


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each group with their rank: first among the rows of each of SALT parts, then among these."""
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).drop("salt")


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", no_group: str = "und", max_words: int = 5, min_count: int = 100, absorb: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``max_words`` words of each group of texts.

    A null group is ``no_group``; a null or empty text has no words. Other columns are not read. Rows count as often as they
    stand in the table. A long text is cut at ends of pieces; a piece is in one task, whatever its length. ``docs`` is read once
    for each of the four counts. Ties of score and
    count go by the phrase's bytes. An empty table, or one without a frequent phrase, gives an empty result.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(no_group)).alias("grp"), F.col(text_col).cast("string").alias("text"))
    words = counted(texts, [], range(1, 2), min_count, "words")
    totals = words.filter("size = 0").select("grp", F.col("f").alias("n"))
    found = [words.filter("size = 1")]
    filters = [filter_of(found[0], 1)]
    sizes = [range(k, k + 1) for k in range(2, min(max_words, 3) + 1)] + ([range(4, max_words + 1)] if max_words > 3 else [])
    for own in sizes:
        found.append(counted(texts, filters, own, min_count, f"phrases-{own[0]}"))
        if own is not sizes[-1]:
            filters.append(filter_of(found[-1], own[0]))
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    weight = counts.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("grp") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    rows = scored(counts, totals, small_enough(weight, 1))
    kept = rows.join(absorbed(counts, absorb), ["grp", "phrase"], "left_anti")
    return best_of(kept, top).select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
