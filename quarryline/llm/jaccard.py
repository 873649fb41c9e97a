"""N-gram Jaccard join by chosen paths.

Texts with equal shingle sets are one class. Classes are split recursively: in each node of a run several sampled sets of
minhash positions, each position a sampled token of the set, send a class to the children named by its tokens there, so two
sets follow the same path as long as they share the sampled tokens. Buckets of at most ``SMALL`` classes are compared by
brute force on minhash sketches. In a larger bucket every class is compared with the bucket's pivot; what is similar to it
hangs on the pivot, and the rest is split again, unless pivots connect it by then: whole, or all but a few classes, which are
compared with all of the rest instead. What is large after the last level goes whole to the exact comparison.
Runs repeat, each on minhashes of its own, until a pair at the threshold is found with the target probability.

What these candidates connect is compared exactly: each task takes a block of a component's sets and streams the others
past it, counting links in an inverted list. A link is never emitted as a pair; each class gets its number of links and the
root of its linked component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import small_enough, stored, text_slices
from quarryline.llm.components import connected_components
from quarryline.llm.shingles import WIDTH, minhashes, shingles

#: Minhashes of each run; those that brute force compares; classes of a bucket that is compared by brute force.
SKETCH, GATE, SMALL = 64, 128, 512
#: Of each level: children of a class, and sampled tokens that name each. Pairs at 0.8 go on more often than they end, those
#: below 0.6 end more often.
LEVELS = ((3, 2), (5, 4), (5, 4), (5, 4))
#: Probability that a pair at the threshold is found, and what a sketch's estimate may be below a similarity.
RECALL, SLACK = 0.9999, 0.2
#: Sets of a component that a task holds at once, and their bytes.
BLOCK, BLOCK_BYTES = 1024, 8 << 20


def survival(similarity: float) -> float:
    """Probability that two sets share a path of a run down to the last level, if their minhashes agree that often."""
    alive = 1.0
    for branches, tokens in reversed(LEVELS):
        alive = 1 - (1 - similarity**tokens * alive) ** branches
    return alive


def agreement(similarity: float, size: int) -> list[float]:
    """Probabilities that two sets agree on 0, 1, ... of ``size`` minhashes."""
    return [math.comb(size, k) * similarity**k * (1 - similarity) ** (size - k) for k in range(size + 1)]


def missed(similarity: float, runs: int, slack: float = SLACK) -> float:
    """Bound of the probability that a pair at the threshold is not found by ``runs`` runs.

    A run's paths and pivots draw on the same minhashes, so they are taken together; runs share none, and the gate of brute
    force is one for all runs.
    """
    gate = similarity - slack
    found = sum(p * survival(k / SKETCH) for k, p in enumerate(agreement(similarity, SKETCH)) if k >= gate * SKETCH)
    return (1 - found) ** runs + sum(p for k, p in enumerate(agreement(similarity, GATE)) if k < gate * GATE)


def runs_needed(similarity: float, recall: float = RECALL) -> int:
    """The least runs that reach the recall, counted for pairs at ``similarity``; two at least, whose minhashes the gate takes."""
    runs = GATE // SKETCH
    while missed(similarity, runs) > 1 - recall and missed(similarity, runs + 1) < missed(similarity, runs):
        runs += 1
    return runs


def sketched(docs: DataFrame, width: int = WIDTH, runs: int = 2) -> DataFrame:
    """(doc_id, row, key, size, sketch) of each row; row is the text's hash, key a digest of the set of shingles, size its
    number of shingles at most, and the sketch has the low 16 bits of each minhash of all runs."""
    size = runs * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = shingles(batch.column("text"), width)
            found = minhashes(hashes, offsets, size).astype(np.uint16).view(np.int16)
            ends = offsets.tolist()
            keys = [hashlib.blake2b(np.unique(hashes[a:b]).tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * size, pa.int32()), pa.array(found.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.binary()), pa.array(np.diff(offsets), pa.int64()), lists], ["doc_id", "row", "key", "size", "sketch"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) row", "text").mapInArrow(run, "doc_id long, row long, key binary, size long, sketch array<short>")


def children(rows: DataFrame, level: int) -> DataFrame:
    """The rows (run, node, key, sketch) with the buckets of the node's children: (run, node, key)."""
    branches, tokens = LEVELS[level]
    names = []
    for k in range(branches):
        at = [F.pmod(F.xxhash64("node", F.lit(k), F.lit(j)), F.lit(SKETCH)).cast("int") + 1 for j in range(tokens)]
        names.append(F.xxhash64("node", F.lit(k), *(F.element_at("sketch", a) for a in at)))
    return rows.select("run", F.explode(F.array(*names)).alias("node"), "key")


def similarity(a: str, b: str) -> Column:
    """The sketches' estimate of the Jaccard similarity."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(SKETCH))


def grouped_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``names``, cut into one table for each of their values."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        keys = [part.column(n).to_numpy() for n in names]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        begin = 0
        for end in cuts.tolist():
            yield part.slice(begin, end - begin)
            begin = end
        rest = part.slice(begin)
    if rest is not None:
        yield rest


def roots_of(n: int, pairs: Iterator[tuple[int, int]]) -> np.ndarray:
    """The smallest member of each of n elements' component."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], np.int64)


def small_buckets(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect what is similar inside each bucket (node, key, root, main, sketch) of few classes, beyond what
    equal roots connect. Classes of the main root aren't compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in grouped_batches(batches, ["node"]):
            keys, first = bucket.column("key").to_pylist(), {}
            known = [first.setdefault(r, i) for i, r in enumerate(bucket.column("root").to_pylist())]
            sketches = bucket.column("sketch").combine_chunks().values.to_numpy().reshape(len(keys), GATE)
            links = []
            for i in range(len(keys) - pc.sum(bucket.column("main")).as_py()):
                near = np.flatnonzero((sketches[i + 1 :] == sketches[i]).sum(axis=1) >= least * GATE)
                links += [(i, i + 1 + j) for j in near.tolist()]
            if links:
                before = [(i, r) for i, r in enumerate(known) if i != r]
                roots = roots_of(len(keys), iter(before + links))
                # One edge for each known component that moves.
                moved = [i for i in first.values() if roots[i] != i]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in moved], pa.binary()), pa.array([keys[roots[i]] for i in moved], pa.binary())], ["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node", "main", "key").mapInArrow(run, "a binary, b binary")


def part(run: Column) -> Column:
    """A run's own minhashes of a sketch."""
    return F.slice("sketch", run * SKETCH + 1, SKETCH).alias("sketch")


def with_sketches(rows: DataFrame, classes: DataFrame, sketch: Column) -> DataFrame:
    """``rows`` (key, ...), a stored table, with ``sketch`` of ``classes``: only where it is small is it sent to all tasks."""
    small = small_enough(rows.count(), 64)
    return classes.select("key", "sketch").join(F.broadcast(rows) if small else rows, "key").select(*rows.columns, sketch)


def with_roots(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (node, key) with the root that ``known`` (key, root) gives the class."""
    return rows.select("node", "key").join(known, "key", "left").select("node", "key", F.coalesce("root", "key").alias("root"))


def apart(rooted: DataFrame) -> DataFrame:
    """(node, n, top, loose) of the nodes of ``rooted`` (node, root) with several roots: the number of classes, the root that
    most of them have, and how many have another."""
    sizes = rooted.groupBy("node", "root").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most"))
    return sizes.select("node", "n", F.col("most.root").alias("top"), (F.col("n") - F.col("most.m")).alias("loose")).filter("loose > 0")


def costly() -> Column:
    """Whether brute force compares a class of a node of ``apart`` with more others than in a bucket of SMALL classes."""
    return (F.col("n") > SMALL) & (F.col("loose") > SMALL // 2)


def in_pieces(rooted: DataFrame) -> DataFrame:
    """(node, key, root, main) of the nodes of ``rooted`` (node, key, root) with several roots that aren't costly. Classes of the
    root that most of a node's classes have are main; beyond SMALL they are dealt to several nodes, each with all other classes."""
    rows = rooted.join(apart(rooted).filter(~costly()), "node").withColumn("main", F.col("root") == F.col("top")).withColumn("pieces", F.ceil(F.col("n") / F.lit(SMALL)))
    places = F.when(F.col("main"), F.array(F.pmod(F.xxhash64("key"), "pieces"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    rows = rows.select("node", "key", "root", "main", "pieces", F.explode(places).alias("piece"))
    return rows.select(F.when(F.col("pieces") > 1, F.xxhash64("node", "piece")).otherwise(F.col("node")).alias("node"), "key", "root", "main")


def candidates(classes: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between keys of ``classes`` (key, sketch) that connect all pairs at the threshold, but for 1 - recall."""
    least = threshold - SLACK
    runs = F.array(*[F.lit(r) for r in range(runs_needed(threshold, recall))])
    begun = classes.select(F.explode(runs).alias("run"), "key", "sketch").select("run", F.col("run").cast("long").alias("node"), "key", part(F.col("run")))
    now = children(begun, 0)
    known, buckets, rests = None, [], []
    for level in range(len(LEVELS)):
        counts = stored(now.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
        pairs = now.join(counts, "node")
        few = pairs.filter(F.col("n") <= SMALL).groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        # Other runs find the same bucket again and again.
        buckets.append(stored(few.groupBy("keys").agg(F.min("node").alias("node")), "buckets"))
        if counts.filter(F.col("n") > SMALL).isEmpty():
            break
        many = stored(pairs.filter(F.col("n") > SMALL).select("run", "node", "key"), "many")
        many = stored(with_sketches(many, classes, part(F.col("run"))), "many")
        pivots = many.groupBy("node").agg(F.min(F.struct("key", "sketch")).alias("p"))
        compared = many.join(pivots, "node").select("run", "node", "key", "sketch", F.col("p.key").alias("pivot"), similarity("sketch", "p.sketch").alias("s"))
        compared = stored(compared, "pivots")
        last = level == len(LEVELS) - 1
        hung = compared.filter(F.col("key") != F.col("pivot"))
        edges = (hung if last else hung.filter(F.col("s") >= least - SLACK)).select(F.col("key").alias("a"), F.col("pivot").alias("b"))
        if known is not None:
            edges = edges.unionByName(known.select(F.col("key").alias("a"), F.col("root").alias("b")))
        known = stored(connected_components(edges).filter("node <> root").select(F.col("node").alias("key"), "root"), "known")
        if not last:
            # Two classes that aren't connected yet and pass the gate are both in the rest: one at least doesn't hang on the pivot.
            # What is connected already is compared exactly anyway, so only classes of other roots must meet.
            rest = compared.filter(F.col("s") < threshold)
            rests.append(rest.select("node", "key"))
            split = stored(apart(with_roots(rest, known)).filter(costly()).select("node"), "split")
            now = stored(children(rest.join(split, "node"), level + 1), "nodes")
    small = buckets[0]
    for b in buckets[1:]:
        small = small.unionByName(b)
    members = small.groupBy("keys").agg(F.min("node").alias("node")).select("node", F.explode("keys").alias("key"))
    for r in rests:
        members = members.unionByName(r)
    members = members.select("node", "key", F.col("key").alias("root"), F.lit(False).alias("main")) if known is None else in_pieces(with_roots(members, known))
    members = stored(members, "members")
    found = small_buckets(with_sketches(members, classes, F.slice("sketch", 1, GATE).alias("sketch")), least)
    return found if known is None else found.unionByName(known.select(F.col("key").alias("a"), F.col("root").alias("b")))


class Posted:
    """A block of sets with the places where each shingle occurs, to count what another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingle = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingle, kind="stable")
        shingle, self.owner = shingle[order], owner[order]
        self.names, first = np.unique(shingle, return_index=True)
        self.first = np.append(first, len(shingle))
        # Of shingles that more than half of the sets have, those without it are listed instead.
        self.common = np.diff(self.first) * 2 > len(sets)
        self.absent: dict[int, np.ndarray] = {}
        everyone = np.arange(len(sets))
        for k in np.flatnonzero(self.common).tolist():
            self.absent[k] = np.setdiff1d(everyone, self.owner[self.first[k] : self.first[k + 1]], assume_unique=True)

    def shared(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, own)
        at = at[at < len(self.names)][self.names[at[at < len(self.names)]] == own[at < len(self.names)]]
        common = self.common[at]
        out = np.full(len(self.sizes), int(common.sum()), np.int64)
        if common.any():
            out -= np.bincount(np.concatenate([self.absent[k] for k in at[common].tolist()]), minlength=len(out))
        rare = at[~common]
        if len(rare):
            counts = self.first[rare + 1] - self.first[rare]
            places = np.repeat(self.first[rare] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            out += np.bincount(self.owner[places], minlength=len(out))
        return out


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, copies, links, root) of each class of each block of ``rows`` (component, block, other, key, copies, set, blocks).

    Rows of a block with other = 0 are its classes; those with other = 1 are all classes of a component of several blocks.
    The classes of a component of one block are compared among themselves.
    links counts rows of other classes that are linked; root connects a class, of either kind, with a linked one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def finish() -> pa.RecordBatch:
            if held[7] == 1:
                compare(held, held[1], held[2], held[3], threshold)
            _, keys, copies, _, links, _, edges, _ = held
            rows = [(k, c, n, k) for k, c, n in zip(keys, copies, links.tolist(), strict=True)] + [(a, 0, 0, b) for a, b in edges]
            a, b, c, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["key", "copies", "links", "root"])

        for batch in batches:
            for group in grouped_batches(iter([batch]), ["component", "block", "other"]):
                component, block, other = (group.column(n)[0].as_py() for n in ("component", "block", "other"))
                keys, copies = group.column("key").to_pylist(), group.column("copies").to_pylist()
                sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
                if held is None or held[0] != (component, block):
                    if held is not None:
                        yield finish()
                    held = [(component, block), [], [], [], np.zeros(0, np.int64), None, [], group.column("blocks")[0].as_py()]
                if not other:
                    # A block's own classes may come in two batches, but are a block's worth together.
                    held[1] += keys
                    held[2] += copies
                    held[3] += sets
                    held[4] = np.zeros(len(held[1]), np.int64)
                else:
                    compare(held, keys, copies, sets, threshold)
        if held is not None:
            yield finish()

    return rows.repartition("component", "block").sortWithinPartitions("component", "block", "other").mapInArrow(run, "key binary, copies long, links long, root binary")


def compare(held: list, keys: list[bytes], copies: list[int], sets: list[np.ndarray], threshold: float) -> None:
    """Adds the links between a block's classes and others, and an edge from each other class to the first linked one."""
    if held[5] is None:
        held[5] = (Posted(held[3]), {k: i for i, k in enumerate(held[1])}, {})
    posted, places, parent = held[5]

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for key, n, own in zip(keys, copies, sets, strict=True):
        both = posted.shared(own)
        linked = both * (1 + threshold) >= threshold * (posted.sizes + len(own)) - 1e-9
        if key in places:
            linked[places[key]] = False
        held[4][linked] += n
        for i in np.flatnonzero(linked).tolist():
            a, b = root(held[1][i]), root(key)
            if a != b:
                parent[max(a, b)] = min(a, b)
                held[6].append((key, held[1][i]))


def shingle_sets(docs: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """``members`` (first, key, copies, component, block, blocks) with their sets, made again from the first text of each."""
    right = members.withColumn("first_row", F.col("first.row")).withColumn("first_id", F.col("first.doc_id")).drop("first")
    right = F.broadcast(right) if small_enough(members.count(), 128) else right
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) row", "text")
    own = texts.join(right, (F.col("row") == F.col("first_row")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    names = ["key", "copies", "component", "block", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = shingles(batch.column("text"), width)
            ends = offsets.tolist()
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            right = [hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)]
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"])
            yield whole.filter(pa.array(right))

    sets = own.select("text", *names).mapInArrow(run, "key binary, copies long, component binary, block int, blocks int, set binary")
    return sets


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of ``docs`` (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of word shingles is ``threshold`` or more; equal sets are
    linked always, also those of texts without a word (null and empty ones included). class_id is the smallest doc_id of
    all rows that links connect with this one; n_links is the number of rows it is linked to itself. Rows of a class that has
    no id at all get null. Repeated rows count one by one; very long texts are compared whole; other columns are not read; an
    empty table gives an empty result.
    """
    rows = stored(sketched(docs, width, runs_needed(threshold, recall)), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = stored(rows.groupBy("key").agg(F.first("sketch").alias("sketch"), F.count("*").alias("copies"), first.alias("first"), F.max("size").alias("size")), "classes")
    found = connected_components(candidates(classes.select("key", "sketch"), threshold, recall))
    members = found.withColumnRenamed("node", "key").join(classes.select("key", "copies", "first", "size"), "key")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), 8 * F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    sizes = sizes.withColumn("blocks", F.greatest("blocks", F.lit(1)))
    members = members.drop("size").join(sizes, "root").withColumnRenamed("root", "component")
    members = stored(members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "members")
    sets = stored(shingle_sets(docs, members, width).dropDuplicates(["key"]), "sets")
    own = sets.withColumn("other", F.lit(0))
    others = sets.filter("blocks > 1").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("other", F.lit(1))
    checked = stored(verified(own.unionByName(others), threshold), "verified")
    linked = connected_components(checked.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = checked.filter("copies > 0").groupBy("key").agg(F.sum("links").alias("links"))
    every = classes.select("key", "copies", F.col("first.doc_id").alias("first_id")).join(links, "key", "left").join(linked.withColumnRenamed("node", "key"), "key", "left")
    every = every.withColumn("root", F.coalesce("root", "key"))
    ids = every.groupBy("root").agg(F.min("first_id").alias("class_id"))
    every = every.join(ids, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "key").join(every, "key").select("doc_id", "class_id", "n_links")
