"""Line deduplication with two Bloom filters.

The filters are cut into parts by ranges of the keys' hashes; a part has 16 bits for each line that falls to it, at any size
of the table. Each task turns the line keys of its documents into positions in the parts: those of keys it saw once, and
those of keys it saw in two documents. In a reducer, a bit that comes from two tasks, or from one task's twice-seen keys, is
set in the part's twice-seen filter. It has no false negatives: a key of two documents has all its bits set twice. Only keys
that the filter holds are shuffled, as text, to be counted exactly.

A twice-seen filter of up to ``MOST_BITS`` goes to all tasks. Of a larger one each part stays in its reducer, and hashes go
there to be looked up; what comes back are the suspected hashes, sent to all tasks or joined with the lines' places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import BROADCAST_BYTES, flat, stored, text_slices

#: Filter bits for each line, positions of a key, and bits of a part.
BITS_PER_LINE, POSITIONS, BLOCK = 16, 3, 1 << 16
#: Hashes that a task holds before it sends their positions.
HELD = 1 << 21
#: Bits of a twice-seen filter that goes to all tasks: 64 MB.
MOST_BITS = 1 << 29


def line_keys(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Lines of all texts in sequence, their keys, and the rows' offsets."""
    lines, offsets = flat(pc.split_pattern(text, "\n"))
    return lines, pc.ascii_lower(pc.ascii_trim_whitespace(lines)), offsets


def distinct_keys(text: pa.Array, least: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each row and each distinct key of it with ``least`` code points or more: the row, and the key's number among the
    distinct keys that come second; third, the number of the key's first line in the row."""
    _, keys, offsets = line_keys(text)
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(text)), np.diff(offsets))
    usable = pc.greater_equal(pc.utf8_length(coded.dictionary), least).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(usable[codes]) if len(codes) else np.zeros(0, np.int64)
    many = len(coded.dictionary) + 1
    pairs, first = np.unique(rows[there] * many + codes[there], return_index=True)
    return np.stack([pairs // many, pairs % many]), coded.dictionary, there[first] - offsets[pairs // many]


def hashed(keys: pa.Array) -> np.ndarray:
    return pd.util.hash_array(keys.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(keys) else np.zeros(0, np.uint64)


def part_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(34)) & np.uint64(bits // BLOCK - 1)).astype(np.int64)


def positions(hashes: np.ndarray) -> np.ndarray:
    """POSITIONS positions of each hash inside its part, by double hashing."""
    low, high = hashes & np.uint64(0xFFFF), (hashes >> np.uint64(16)) & np.uint64(0xFFFF) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * high) & np.uint64(BLOCK - 1)).astype(np.int64) for i in range(POSITIONS)])


def held(filters: np.ndarray, hashes: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether each hash has all its bits in ``filters``, whose part ``part`` it falls to."""
    at = positions(hashes) + part * BLOCK
    return (filters[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def cut_by(part: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct parts, and the bytes of each one's values."""
    order = np.argsort(part, kind="stable")
    parts, begins = np.unique(part[order], return_index=True)
    return parts, [x.tobytes() for x in np.split(values[order], begins[1:])] if len(parts) else []


def twice_filter(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(block, bits): the parts of the twice-seen filter of all line keys that aren't empty."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held_now = 0

        def sent() -> Iterator[pa.RecordBatch]:
            hashes, counts = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            for twice in (False, True):
                chosen = hashes[counts > 1] if twice else hashes
                at = np.unique(positions(chosen) + part_of(chosen, bits) * BLOCK)
                blocks, values = cut_by(at // BLOCK, (at % BLOCK).astype(np.uint16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array([twice] * len(blocks), pa.bool_()), pa.array(values, pa.binary())], ["block", "twice", "at"]
                )

        # What a task sends at two times counts like what two tasks send: a document's keys are sent at one time.
        for batch in text_slices(batches):
            (_, codes), keys, _ = distinct_keys(batch.column("text"), least)
            parts.append(hashed(keys)[codes])
            held_now += len(codes)
            if held_now >= HELD:
                yield from sent()
                parts, held_now = [], 0
        yield from sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by part: 64 KB of counters at a time.
        now, counts = None, np.zeros(BLOCK, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, twice, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None and (counts > 1).any():
                        yield done()
                    now, counts = block, np.zeros(BLOCK, np.uint8)
                where = np.frombuffer(at, np.uint16)
                counts[where] = 2 if twice else np.minimum(counts[where] + 1, 2)
        if now is not None and (counts > 1).any():
            yield done()

    parts = docs.select("text").mapInArrow(seen, "block long, twice boolean, at binary").repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(merged, "block long, bits binary")


def suspected_hashes(docs: DataFrame, filters: DataFrame, bits: int, least: int) -> DataFrame:
    """(hash): the distinct hashes of line keys that ``filters`` holds, looked up where each part is."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes = np.unique(hashed(distinct_keys(batch.column("text"), least)[1]))
            blocks, values = cut_by(part_of(hashes, bits), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(values, pa.binary()), pa.array([True] * len(blocks), pa.bool_())], ["block", "data", "asked"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint8)
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for block, data, question in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not question:
                    now, own = block, np.frombuffer(data, np.uint8)
                elif block == now:
                    hashes = np.frombuffer(data, np.uint64)
                    found.append(hashes[held(own, hashes, np.zeros(len(hashes), np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["hash"])

    questions = docs.select("text").mapInArrow(asked, "block long, data binary, asked boolean")
    both = filters.select("block", F.col("bits").alias("data"), F.lit(False).alias("asked")).unionByName(questions)
    return both.repartition("block").sortWithinPartitions("block", "asked").mapInArrow(answered, "hash long").distinct()


FOUND = "doc_id long, row long, line long, key string"


def with_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); with the text's hash, rows of one id, or of none, are told apart unless they are equal."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def chosen_lines(batch: pa.RecordBatch, rows: np.ndarray, lines: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(lines, pa.int64()), keys.cast(pa.string())], ["doc_id", "row", "line", "key"])


def suspects(docs: DataFrame, least: int, filters: np.ndarray | None = None, hashes: np.ndarray | None = None) -> DataFrame:
    """FOUND: the first line of each key of each row that the twice-seen filter holds, or whose hash is among the sorted
    ``hashes``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters if hashes is None else hashes)
    by_filter = hashes is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_slices(batches):
            (rows, codes), keys, first = distinct_keys(batch.column("text"), least)
            own = hashed(keys)
            if by_filter:
                maybe = held(known, own, part_of(own, 8 * len(known)))
            else:
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                maybe = known[at] == own if len(known) else np.zeros(len(own), bool)
            chosen = np.flatnonzero(maybe[codes]) if len(codes) else np.zeros(0, np.int64)
            yield chosen_lines(batch, rows[chosen], first[chosen], keys.take(pa.array(codes[chosen])))

    return with_rows(docs).mapInArrow(run, FOUND)


def joined_suspects(docs: DataFrame, hashes: DataFrame, least: int) -> DataFrame:
    """The same for suspected hashes that are too many to send: places of lines are shuffled by hash, texts once by row."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            (rows, codes), keys, first = distinct_keys(batch.column("text"), least)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(first, pa.int64()), pa.array(hashed(keys)[codes].view(np.int64))], ["doc_id", "row", "line", "hash"]
            )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, keys, offsets = line_keys(batch.column("text"))
            wanted, ends = flat(batch.column("lines"))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            lines = wanted.to_numpy(zero_copy_only=False)
            yield chosen_lines(batch, rows, lines, keys.take(pa.array(offsets[rows] + lines)))

    rows = with_rows(docs)
    own = rows.mapInArrow(places, "doc_id long, row long, line long, hash long").join(hashes, "hash", "left_semi")
    own = own.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines")).withColumnsRenamed({"doc_id": "other_id", "row": "other_row"})
    met = rows.join(own, (F.col("row") == F.col("other_row")) & F.col("doc_id").eqNullSafe(F.col("other_id")))
    return met.select("doc_id", "row", "text", "lines").mapInArrow(fetch, FOUND)


def suspected(docs: DataFrame, total: int, least: int, most_bits: int = MOST_BITS) -> DataFrame:
    """FOUND of a table of ``total`` lines."""
    bits = BLOCK
    while bits < BITS_PER_LINE * total:
        bits *= 2
    filters = stored(twice_filter(docs, bits, least), "filter")
    if bits <= most_bits:
        whole = np.zeros(bits // 8, np.uint8)
        for row in filters.collect():
            whole[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
        return suspects(docs, least, filters=whole)
    hashes = stored(suspected_hashes(docs, filters, bits, least), "hashes")
    if 64 * hashes.count() <= most_bits:
        return suspects(docs, least, hashes=np.sort(hashes.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)))
    return joined_suspects(docs, hashes, least)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_bytes: int = BROADCAST_BYTES, most_bits: int = MOST_BITS
) -> DataFrame:
    """``docs`` without the lines whose key is found in ``min_docs`` rows or more; adds n_lines and n_dropped.

    A key is a line without ASCII white space at its ends and with A-Z in lower case. With ``keep_first`` the line of the
    smallest (doc_id, line number) stays. A null text is one empty line and becomes an empty text; a very long text is cut
    whole. Repeated rows, and rows of one id, count as documents of their own; rows with a null doc_id are handled like
    others. Columns called n_lines or n_dropped are replaced, all others stay, under whatever names. An empty table gives an
    empty result. ``most_bits`` and ``broadcast_bytes`` set what goes to all tasks, not the result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    at = names.index("text")
    total = docs.select(F.sum(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0
    found = suspected(docs, total, min_chars, most_bits)
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
    repeated = stored(counted.filter(F.col("n") >= max(min_docs, 1)).select("key", "first.doc_id", "first.line"), "lines")
    rows, size = repeated.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
    schema = T.StructType(list(docs.schema) + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def drop(batch: pa.RecordBatch, text: pa.Array, is_bad) -> pa.RecordBatch:
        lines, keys, offsets = line_keys(text)
        bad = is_bad(keys, offsets)
        lost = np.concatenate([[0], np.cumsum(bad)])
        n_dropped = lost[offsets[1:]] - lost[offsets[:-1]]
        changed = np.flatnonzero(n_dropped)
        if len(changed):
            new = text.to_pylist()
            for i in changed.tolist():
                a, b = offsets[i], offsets[i + 1]
                new[i] = "\n".join(lines.slice(a, b - a).filter(pa.array(~bad[a:b])).to_pylist())
            text = pa.array(new, pa.large_string())
        columns = [text.cast(pa.string()) if n == at else batch.column(c) for n, c in enumerate(names)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets), pa.int64()), pa.array(n_dropped, pa.int64())], schema.names)

    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([tuple(r) for r in repeated.collect()] if rows else [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = pa.array([k for k, _, _ in shared.value], pa.large_string())
            firsts = {k: (d, n) for k, d, n in shared.value} if keep_first else {}
            for batch in text_slices(batches):

                def is_bad(keys: pa.Array, offsets: np.ndarray, batch=batch) -> np.ndarray:
                    coded = keys.cast(pa.large_string()).dictionary_encode()
                    bad = pc.is_in(coded.dictionary, values).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
                    bad = bad.astype(bool)
                    if keep_first:
                        ids = batch.column("doc_id").to_pylist()
                        rows_of = np.repeat(np.arange(len(ids)), np.diff(offsets))
                        for i in np.flatnonzero(bad).tolist():
                            row = int(rows_of[i])
                            bad[i] = firsts[keys[i].as_py()] != (ids[row], i - int(offsets[row]))
                    return bad

                yield drop(batch, batch.column("text"), is_bad)

        return docs.mapInArrow(run, schema)

    # Too many keys to send: each row meets its own, so the texts are shuffled once.
    own_keys, own_id, own_row = (next(n + "_" * k for k in range(len(names) + 1) if n + "_" * k not in names) for n in ("__keys", "__id", "__row"))
    own = found.join(repeated.select("key", F.col("doc_id").alias("d"), F.col("line").alias("l")), "key")
    own = own.groupBy(F.col("doc_id").alias(own_id), F.col("row").alias(own_row)).agg(F.collect_set(F.struct("key", "d", "l")).alias(own_keys))
    joined = docs.join(own, (F.xxhash64("text") == F.col(own_row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left").drop(own_id, own_row)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bad_keys = batch.column(own_keys).to_pylist()
            ids = batch.column("doc_id").to_pylist()

            def is_bad(keys: pa.Array, offsets: np.ndarray, bad_keys=bad_keys, ids=ids) -> np.ndarray:
                bad = np.zeros(len(keys), bool)
                for row, found in enumerate(bad_keys):
                    if found:
                        firsts = {k["key"]: (k["d"], k["l"]) for k in found}
                        for i in range(offsets[row], offsets[row + 1]):
                            first = firsts.get(keys[i].as_py())
                            bad[i] = first is not None and not (keep_first and first == (ids[row], i - int(offsets[row])))
                return bad

            yield drop(batch, batch.column("text"), is_bad)

    return joined.mapInArrow(run_joined, schema)
