"""Vectors as short codes: each part of a vector becomes the number of the nearest entry of that part's codebook.

All arithmetic is on whole numbers, so results don't depend on how rows are spread. In each round the codebooks go to all
tasks as kd-trees; tasks find the nearest entry of every part, add up the parts of each entry, and Spark adds these sums. A
search first goes down to the leaf that a part falls to; then it passes all nodes and enters those whose box isn't farther
than the best entry so far. A box at the same distance is entered too, so of equally near entries the first one is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import ship, small_enough, stored

#: Entries of a leaf at most.
LEAF = 16
#: Whole numbers of up to so many bits make distances that doubles hold exactly, in parts of up to 2**10 components.
EXACT_BITS = 20
#: Tasks that a label's rows are spread over where labels are too many to be sent to all tasks.
SALT = 64


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    axis: int = -1
    value: object = 0
    left: Node | None = None
    right: Node | None = None
    entries: np.ndarray | None = None


def grow(entries: np.ndarray, numbers: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """The kd-tree of ``entries``: a node is cut in the middle of its widest axis, and has the box of its entries."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    own = entries[numbers]
    node = Node(own.min(axis=0), own.max(axis=0))
    width = node.high - node.low
    axis = int(np.argmax(width))
    if len(numbers) <= leaf or not width[axis]:
        node.entries = numbers
        return node
    order = np.argsort(own[:, axis], kind="stable")
    half = len(order) // 2
    node.axis, node.value = axis, own[order[half], axis]
    node.left, node.right = grow(entries, np.sort(numbers[order[:half]]), leaf), grow(entries, np.sort(numbers[order[half:]]), leaf)
    return node


def nearest(points: np.ndarray, entries: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest entry, the lowest of equally near ones, and its squared distance."""
    best = np.full(len(points), -1, dtype=points.dtype)
    found, home = np.zeros(len(points), np.int64), np.full(len(points), -1, np.int64)

    def look(node: Node, rows: np.ndarray) -> None:
        own, part = entries[node.entries], points[rows]
        far = (part * part).sum(axis=1)[:, None] - 2 * part.dot(own.T) + (own * own).sum(axis=1)
        at = far.argmin(axis=1)
        far, number = far[np.arange(len(rows)), at], node.entries[at]
        better = (best[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (number < found[rows]))
        best[rows[better]], found[rows[better]] = far[better], number[better]

    def descend(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.entries is not None:
            home[rows] = node.entries[0]
            look(node, rows)
            return
        less = points[rows, node.axis] < node.value
        descend(node.left, rows[less])
        descend(node.right, rows[~less])

    def bound(node: Node, rows: np.ndarray) -> None:
        part = points[rows]
        out = np.maximum(np.maximum(node.low - part, part - node.high), 0)
        rows = rows[(out * out).sum(axis=1) <= best[rows]]
        if node.entries is not None:
            rows = rows[home[rows] != node.entries[0]]
        if not len(rows):
            return
        if node.entries is not None:
            look(node, rows)
            return
        bound(node.left, rows)
        bound(node.right, rows)

    descend(tree, np.arange(len(points)))
    bound(tree, np.arange(len(points)))
    return found, best


def as_points(parts: np.ndarray, codebooks: list[np.ndarray]) -> np.ndarray:
    """Whole numbers as doubles where all distances to the codebooks are exact in doubles, else as Python's numbers."""
    most = max([abs(int(x)) for a in (parts, *codebooks) if a.size for x in (a.min(), a.max())], default=0)
    return parts.astype(np.float64 if most < 1 << EXACT_BITS and parts.shape[-1] <= 1 << 10 else object)


def together(batches: Iterator[pa.RecordBatch], most: int = 8192, cells: int = 1 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows by up to ``most``, or of ``cells`` whole numbers, and these numbers, a row a vector."""
    held: list[pa.RecordBatch] = []

    def ready() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        lists = [c for c in table.column("whole").chunks if len(c)]
        return table, np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in lists])

    for batch in batches:
        if not batch.num_rows:
            continue
        width = len(batch.column("whole")[0])
        if held and sum(b.num_rows for b in held) + batch.num_rows > max(1, min(most, cells // max(width, 1))):
            yield ready()
            held = []
        held.append(batch)
    if held:
        yield ready()


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, dim: int, scale: int) -> DataFrame:
    """(id, label, whole): vectors of ``dim`` finite components, each as floor(``scale`` * x)."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    too_large = F.raise_error(F.lit("a scaled component passes 62 bits")).cast("long")
    whole = F.transform("vector", lambda v: F.when(F.abs(v * F.lit(float(scale))) < float(1 << 62), F.floor(v * F.lit(float(scale)))).otherwise(too_large))
    return kept.filter((F.size("vector") == dim) & finite("vector")).select("id", "label", whole.alias("whole"))


def finite(vector: str) -> Column:
    return F.forall(F.col(vector).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def sent(whole: DataFrame, codebooks: list[np.ndarray]) -> Broadcast:
    """The broadcast of the codebooks and their trees: parts x entries x (dim / parts) whole numbers, known beforehand."""
    exact = [as_points(c, codebooks) for c in codebooks]
    return whole.sparkSession.sparkContext.broadcast([(c, e, grow(e)) for c, e in zip(codebooks, exact, strict=True)])


def part_search(whole: np.ndarray, books: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its whole numbers, the nearest entries, and the squared distances."""
    width = whole.shape[1] // len(books)
    for k, (codebook, exact, tree) in enumerate(books):
        part = whole[:, k * width : (k + 1) * width]
        points = as_points(part, [codebook])
        if points.dtype != exact.dtype:
            points, exact = part.astype(object), codebook.astype(object)
            tree = grow(exact)
        yield part, *nearest(points, exact, tree)


def moved(whole: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose used entries are the floor of the mean of their parts."""
    books, width = sent(whole, codebooks), codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, totals = [np.zeros(s[0], np.int64) for s in shapes], [np.zeros(s, object) for s in shapes]
        for _, whole in together(batches):
            for k, (part, found, _) in enumerate(part_search(whole, books.value)):
                order = np.argsort(found, kind="stable")
                entries, begins, counts = np.unique(found[order], return_index=True, return_counts=True)
                sizes[k][entries] += counts
                # So many numbers of 40 bits have sums below 64 bits.
                small = max(abs(int(part.min())), abs(int(part.max()))) < 1 << 40
                totals[k][entries] += np.add.reduceat(part[order] if small else part[order].astype(object), begins, axis=0).astype(object)
        used = [(k, i) for k, s in enumerate(sizes) for i in np.flatnonzero(s).tolist()]
        rows = [[Decimal(int(v)) for v in totals[k][i]] for k, i in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([i for _, i in used], pa.int32()), pa.array([int(sizes[k][i]) for k, i in used], pa.int64())]
            + [pa.array([r[j] for r in rows], pa.decimal128(38, 0)) for j in range(width)],
            ["part", "entry", "n", *(f"s{j}" for j in range(width))],
        )

    shapes = [c.shape for c in codebooks]
    schema = "part int, entry int, n long, " + ", ".join(f"s{j} decimal(38,0)" for j in range(width))
    sums = whole.select("whole").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(width)))
    out = [c.astype(object) for c in codebooks]
    # One row for each entry of each codebook at most.
    for row in sums.collect():
        out[row["part"]][row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(width)]
    books.destroy()
    return [narrow(c) for c in out]


def narrow(codebook: np.ndarray) -> np.ndarray:
    """Whole numbers in 64 bits where these hold them."""
    return codebook.astype(np.int64) if all(abs(int(v)) < 1 << 62 for v in codebook.ravel()) else codebook


def spell(codebooks: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for c in codebooks for v in c.ravel())


def coded(whole: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every row; an error beyond 64 bits is null."""
    books = sent(whole, codebooks)
    types = {f.name: f.dataType for f in whole.schema}
    schema = T.StructType([T.StructField("id", types["id"]), T.StructField("label", types["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole in together(batches):
            errors, codes = 0, []
            for _, found, far in part_search(whole, books.value):
                errors = errors + far.astype(object)
                codes.append(found)
            digits = ["".join(f"{i:02x}" for i in row) for row in zip(*(c.tolist() for c in codes), strict=True)]
            error = pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())
            table = pa.table([rows.column("id"), rows.column("label"), pa.array(digits, pa.string()), error], ["id", "label", "code", "error"])
            yield from table.combine_chunks().to_batches()

    return whole.mapInArrow(run, schema)


def product_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks, codebooks_sha256) of every vector with finite components alone.

    The id and label columns keep their types and come out under these names; other columns are not read. Rows with a null
    vector or a null or non-finite component go, as do those whose length isn't that of the first kept vector by id. The
    codebooks start from the parts of the first ``entries`` kept vectors by id, null ids last and equal ids by their
    components; fewer vectors make smaller codebooks. Repeated rows stay rows. Null labels are one label. An error or a sum
    of errors beyond 64 bits is null; a scaled component beyond 62 bits is an error. A length that ``parts`` doesn't divide, or more than 256 entries, is a ValueError. An
    empty table, or one without a kept vector, gives an empty result.
    """
    ship(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    filled = vectors.filter(F.col(vector_col).isNotNull() & finite(vector_col) & (F.size(vector_col) > 0))
    first = filled.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector_col)).select(F.size(vector_col).alias("dim")).limit(1).collect()
    dim = first[0]["dim"] if first else parts
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {dim} components")
    whole = stored(whole_vectors(vectors, id_col, vector_col, label_col, dim, scale), "whole")
    start = whole.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    if not start:
        empty = whole.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return named(empty.limit(0).withColumn("label_error", F.lit(0).cast("long")), "")
    whole_start = np.array([[int(v) for v in r["whole"]] for r in start], object)
    width = dim // parts
    codebooks = [narrow(whole_start[:, k * width : (k + 1) * width]) for k in range(parts)]
    for _ in range(rounds):
        codebooks = moved(whole, codebooks)
    rows = stored(coded(whole, codebooks), "codes")
    totals = rows.groupBy(F.col("label").alias("own")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"))
    totals = stored(totals, "labels")
    if small_enough(totals.count(), 64):
        found = rows.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("own")))
    else:
        # A frequent label's rows are spread over SALT tasks; its total goes to each.
        spread = totals.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = rows.withColumn("salt", (F.monotonically_increasing_id() % SALT).cast("int"))
        found = salted.join(spread, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("own_salt")))
    return named(found, spell(codebooks))


def named(rows: DataFrame, spelt: str) -> DataFrame:
    digest = hashlib.sha256(spelt.encode()).hexdigest()
    return rows.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(spelt).alias("codebooks"), F.lit(digest).alias("codebooks_sha256"))
