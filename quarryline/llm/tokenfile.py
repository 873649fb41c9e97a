"""Token ids in patched frame-of-reference files.

A file holds the ids of a contiguous range of documents in ascending doc_id order, in blocks of 128. Of a block the
minimum is subtracted, and the differences are packed at the width that suffices for 90 % of them; the upper parts of
the others follow in an exception list. An index has each block's start, so any range can be read by itself. Shards are
written to temporary names and renamed; a manifest, written last and renamed, names the shards that count.

Layout, little-endian: MAGIC; blocks; block starts (u64 each); documents (i64 id, u8 null flag, u64 number of ids);
footer (u64 ids, u64 documents, u64 blocks, u64 place of the block starts, u32 crc32 of the blocks, MAGIC).
Block: u32 minimum, u8 width, u8 number of exceptions, 16 * width bytes, then u8 places and u32 upper parts of exceptions.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import fresh_path, text_slices
from quarryline.llm.units import UnitEncoder, spread

MAGIC = b"QLPFOR01"
BLOCK = 128
#: Of a block's differences so many are packed without an exception at least, of 128.
PACKED = 116
FOOTER = struct.Struct("<QQQQI8s")


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids, which fill whole blocks, and the bytes of each block."""
    rows = ids.astype(np.int64).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    over = rows - least[:, None]
    usual = np.partition(over, PACKED - 1, axis=1)[:, PACKED - 1]
    width = np.frexp(usual.astype(float))[1].astype(np.int64)
    outside = over >> width[:, None]
    n_out = (outside > 0).sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_out
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((len(rows), 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, n_out
    out[starts[:, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = (over[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4))
        bits = np.unpackbits(bits, axis=2, bitorder="little", count=w)
        out[starts[own][:, None] + 6 + np.arange(16 * w)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    row, place = np.nonzero(outside)
    nth = np.arange(len(row)) - (np.cumsum(n_out) - n_out)[row]
    lists = starts[row] + 6 + 16 * width[row]
    out[lists + nth] = place
    out[(lists + n_out[row] + 4 * nth)[:, None] + np.arange(4)] = outside[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), sizes


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(6)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.int64)
    width, n_out = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[starts[own][:, None] + 6 + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        whole = np.zeros((len(own), BLOCK, 4), np.uint8)
        packed = np.packbits(bits, axis=2, bitorder="little")
        whole[:, :, : packed.shape[2]] = packed
        out[own] = whole.view("<u4").reshape(len(own), BLOCK)
    row = np.repeat(np.arange(len(starts)), n_out)
    nth = np.arange(len(row)) - (np.cumsum(n_out) - n_out)[row]
    lists = starts[row] + 6 + 16 * width[row]
    upper = np.ascontiguousarray(raw[(lists + n_out[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)
    out[row, raw[lists + nth]] |= upper << width[row]
    return (out + least[:, None]).ravel()


class ShardWriter:
    """Takes documents in order and writes one shard; memory is a few thousand ids plus 25 bytes a document."""

    def __init__(self, sink) -> None:
        self.sink, self.rest, self.at, self.crc = sink, np.zeros(0, np.int32), len(MAGIC), 0
        self.starts: list[np.ndarray] = []
        self.docs: list[bytes] = []
        self.n_ids = self.n_docs = 0
        sink.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        data, sizes = pack(ids)
        self.starts.append(self.at + np.cumsum(sizes) - sizes)
        self.at += len(data)
        self.crc = zlib.crc32(data, self.crc)
        self.sink.write(data)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs += [struct.pack("<qBQ", d or 0, d is None, n) for d, n in zip(doc_ids, counts.tolist(), strict=True)]
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(doc_ids)
        ids = np.concatenate([self.rest, ids])
        for begin in range(0, len(ids) - BLOCK + 1, 1 << 18):
            end = min(begin + (1 << 18), len(ids) // BLOCK * BLOCK)
            self._blocks(ids[begin:end])
        self.rest = ids[len(ids) // BLOCK * BLOCK :]

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest[-1], np.int32)]))
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)]).astype("<u8")
        self.sink.write(starts.tobytes() + b"".join(self.docs))
        self.sink.write(FOOTER.pack(self.n_ids, self.n_docs, len(starts), self.at, self.crc, MAGIC))


class ShardReader:
    """Reads a shard from a random-access file."""

    def __init__(self, file, check: bool = True) -> None:
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        self.n_ids, self.n_docs, n_blocks, self.end, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        file.seek(self.end)
        self.starts = np.append(np.frombuffer(file.read(8 * n_blocks), "<u8").astype(np.int64), self.end)
        table = np.frombuffer(file.read(17 * self.n_docs), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]))
        self.doc_ids, self.nulls, self.counts = table["id"], table["null"].astype(bool), table["n"].astype(np.int64)
        if check:
            file.seek(len(MAGIC))
            have, left = 0, self.end - len(MAGIC)
            while left:
                part = file.read(min(left, 1 << 22))
                have, left = zlib.crc32(part, have), left - len(part)
            if magic != MAGIC or have != crc:
                raise ValueError("damaged token file")

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from number ``begin`` to before number ``end`` of the shard; only their blocks are read."""
        if begin >= end:
            return np.zeros(0, np.int64)
        first, last = begin // BLOCK, -(-end // BLOCK)
        starts = self.starts[first : last + 1]
        self.file.seek(int(starts[0]))
        data = self.file.read(int(starts[-1] - starts[0]))
        return unpack(data, starts[:-1] - starts[0])[begin - first * BLOCK : end - first * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, ids) of runs of documents with about ``most`` ids together."""
        ends = np.cumsum(self.counts)
        i, at = 0, 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(ends, at + most, side="right")))
            yield i, j, self.ids(at, int(ends[j - 1]))
            i, at = j, int(ends[j - 1])


#: White space as the byte-level pattern sees it.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class ByteLevelTokens:
    """Ids of a tokenizer file of the tokenizers library, the same as its encode() of each whole text.

    The pattern of byte-level tokenizers always starts a new word at a space or a line feed that something other than white
    space follows, so the library encodes each distinct stretch between such places once. Texts with other spaces or with an
    added token's string go to the library whole, and so does everything if the file isn't of this kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_unit = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_unit = self.by_unit and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in kind["added_tokens"])
        added = [t["content"] for t in kind["added_tokens"]]
        self.whole = "|".join([f" [{SPACES}]", f"[{SPACES}] $", *(rf"\Q{t}\E" for t in added)])
        self.tab = self._one("\t")
        self.units = UnitEncoder(self._units, "", " ", slots=1 << 20, most_ids=6 << 20)

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _units(self, units: list[str], most: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in sequence, and the number of each.

        The pattern makes a tab between two units a word of its own, so units without white space are encoded in one string
        and told apart by the tab's id, which no other text has.
        """
        units = [u[1:] if u.startswith(" \n") else u for u in units]
        plain = pc.match_substring_regex(pa.array(units, pa.large_string()), f"^[ \n]?[^{SPACES}]+$").to_numpy(zero_copy_only=False).astype(bool)
        if len(self.tab) != 1:
            plain[:] = False
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        parts, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, n, most):
            ids = np.array(self._one("\t".join([units[i] for i in order[k : min(k + most, n)].tolist()])), np.int32)
            tabs = np.flatnonzero(ids == self.tab[0])
            lengths.append(np.diff(np.concatenate([[-1], tabs, [len(ids)]])) - 1)
            parts.append(np.delete(ids, tabs))
        for i in order[n:].tolist():
            parts.append(np.array(self._one(units[i]), np.int32))
            lengths.append(np.array([len(parts[-1])]))
        counts, starts, every = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.concatenate(lengths)
        counts[order], starts[order] = every, np.cumsum(every) - every
        return np.concatenate(parts)[spread(starts, counts)], counts

    def _cut(self, text: pa.Array) -> pa.Array:
        """A space before each line feed that something other than white space follows: the pattern starts a word there too."""
        return pc.replace_substring_regex(text, f"\n([^{SPACES}])", " \n\\1")

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(text, self.whole).to_numpy(zero_copy_only=False) if self.by_unit else np.ones(len(text), bool)
        if not odd.any():
            return self.units(self._cut(text))
        ids, offsets = self.units(self._cut(text.filter(pa.array(~odd))))
        parts: list[np.ndarray] = [None] * len(text)  # type: ignore[list-item]
        for k, i in enumerate(np.flatnonzero(~odd).tolist()):
            parts[i] = ids[offsets[k] : offsets[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(self._one(text[i].as_py()), np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=1)
def load(path: str) -> ByteLevelTokens:
    """The encoder of a file, which a Python worker keeps with its pool from task to task."""
    return ByteLevelTokens(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> list[dict]:
    """Encodes ``docs`` (doc_id, text), ends each with ``end_id``, and writes shards below ``folder``; returns the manifest.

    Shards follow ascending doc_id; rows of the same doc_id are in the order of their texts. The manifest has a row for
    each shard that isn't empty: path, first id's number in the whole, ids and documents; an empty table gives none. A null
    text is an empty one. A long text is encoded whole, in a batch of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        temporary, final = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.pfor"
        store.create_dir(root)
        with store.open_output_stream(temporary) as sink:
            writer = ShardWriter(sink)
            for batch in text_slices(batches, most=4 << 20):
                ids, offsets = encode(batch.column("text"))
                ended = np.full(len(ids) + batch.num_rows, end_id, np.int32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(offsets))] = ids
                writer.add(batch.column("doc_id").to_pylist(), np.diff(offsets) + 1, ended)
            writer.close()
        if writer.n_docs:
            store.move(temporary, final)
            yield pa.RecordBatch.from_pylist([{"part": part, "path": final, "n_ids": writer.n_ids, "n_docs": writer.n_docs}])
        else:
            store.delete_file(temporary)

    spread = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    shards = sorted(spread.mapInArrow(run, "part long, path string, n_ids long, n_docs long").collect(), key=lambda r: r.part)
    starts = np.concatenate([[0], np.cumsum([s.n_ids for s in shards])]).astype(int).tolist()
    manifest = [{"path": s.path, "start": start, "n_ids": s.n_ids, "n_docs": s.n_docs} for s, start in zip(shards, starts, strict=False)]
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/.manifest") as sink:
        sink.write("".join(json.dumps(m) + "\n" for m in manifest).encode())
    store.move(f"{root}/.manifest", f"{root}/manifest.jsonl")
    return manifest


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards that the manifest below ``folder`` names."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.jsonl") as source:
        manifest = [json.loads(x) for x in source.read().decode().splitlines()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with store.open_input_file(manifest[k]["path"]) as file:
                    reader, at = ShardReader(file), manifest[k]["start"]
                    for i, j, ids in reader.documents():
                        counts = reader.counts[i:j]
                        ends = np.cumsum(counts)
                        data = memoryview(ids.astype("<u4").tobytes())
                        crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.doc_ids[i:j], pa.int64(), mask=reader.nulls[i:j]), pa.array(at + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at += int(ends[-1])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(run, schema)


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to a fresh folder of the shared storage and returns what is read back.

    A null or empty text is the end id alone. Rows are kept one by one, also with equal or null doc_ids (nulls come
    first). A long text is encoded whole. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    folder = folder if "://" in folder else f"file://{folder}"
    write_tokens(docs, tokenizer, end_id, folder)
    return read_tokens(spark, folder)
