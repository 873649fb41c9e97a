"""Byte-pair encoding by speculation: a greedy proposal, a check of all adjacent pairs at once, exact merging of what fails.

A word is proposed as the longest vocabulary entries from left to right. Such a cutting is the one that merging in the order
of ranks gives if each two neighbours, taken alone, would come out as these two: no merge across their boundary has its
turn before both of them are complete. That is checked for all pairs of a batch together: of a pair the part that was
completed last is taken apart again and again, and a merge across the boundary with an earlier turn refutes it. Words with a
refuted pair are merged exactly, lowest rank first and the leftmost of equal ranks.

Texts are cut into units before a space or line feed that something other than white space follows, where the pattern
always starts a word; ids of a unit are found once and kept in a pool of a fixed number of bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quarryline.llm.common import text_slices
from quarryline.llm.units import Pool, digests, spread

#: White space, and the endings that are words of their own, of byte-level patterns (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: No merge has this rank.
NEVER = np.int64(1) << 40
#: Positions that are matched with the vocabulary at once.
AT_ONCE = 1 << 19

#: Whether a byte may begin a character of white space.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary spells each byte: itself if it is printable Latin-1, else the next one from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    others = (chr(0x100 + i) for i in range(256))
    return [letters[b] if b in letters else next(others) for b in range(256)]


class Words:
    """Cuts texts as the tokenizers library does: after an optional space letters, digits or other characters, or white space.

    What is a letter or a digit depends on the library's Unicode version. Runs of characters of one class by our tables are
    given to the library, and the characters of runs that it doesn't keep together one by one; texts with exceptions have a
    pattern of their own.
    """

    def __init__(self, run: int = 256) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
        members, examples = {"L": r"\p{L}", "N": r"\p{N}", "O": rf"[^{SPACE}\p{{L}}\p{{N}}]"}, {"L": "a", "N": "1", "O": "!"}
        other: dict[str, list[str]] = {"L": [], "N": [], "O": []}
        for kind, member in members.items():
            chars = "".join(regex.findall(f"{member}+", every)).replace("'", "")
            for k in range(0, len(chars), run):
                part = chars[k : k + run]
                if len(cut(examples[kind] + part)) > 1:
                    for c in part:
                        now = next((n for n, example in examples.items() if len(cut(example + c)) == 1), kind)
                        if now != kind:
                            other[kind].append(c)
                            other[now].append(c)
        self.exceptions = frozenset(c for chars in other.values() for c in chars)
        self.plain = self._pattern(r"\p{L}", r"\p{N}").findall
        letter, digit = (rf"[\p{{{k}}}~~[{''.join(map(regex.escape, other[k]))}]]" if other[k] else rf"\p{{{k}}}" for k in "LN")
        self.exact = self._pattern(letter, digit).findall

    @staticmethod
    def _pattern(letter: str, digit: str) -> regex.Pattern:
        return regex.compile(rf"(?V1){ENDINGS}| ?{letter}+| ?{digit}+| ?[^{SPACE}{letter}{digit}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if self.exceptions.isdisjoint(text) else self.exact(text)


class ByteBpe:
    """The merges of a tokenizer file, by turn: the single bytes are 0 to 255, the result of merge number m is 256 + m."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        model, pre = kind["model"], kind.get("pre_tokenizer") or {}
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
        odd += [k for k in ("ignore_merges", "byte_fallback") if model.get(k)] + (["normalizer"] if kind.get("normalizer") else [])
        odd += [t["content"] for t in kind["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path} {odd}")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        turns = {c: b for b, c in enumerate(letters)}
        ids, left, right = [vocab[c] for c in letters], list(range(256)), list(range(256))
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in turns:
                raise ValueError(f"two merges of {path} give {a + b}")
            turns[a + b] = len(ids)
            ids.append(vocab[a + b])
            left.append(turns[a])
            right.append(turns[b])
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.ids = np.array(ids, np.int32)
        pairs = (self.left[256:] << 32) | self.right[256:]
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_turns = pairs[order], order + 256
        self.merges = dict(zip(pairs.tolist(), range(256, len(ids)), strict=True))
        # What comes out as itself when merged alone; only such entries can be trusted in a proposal.
        alone = np.ones(len(ids), bool)
        alone[256:] = self.compatible(self.left[256:], self.right[256:], np.arange(256, len(ids)))
        whole = alone.tolist()
        for t in range(256, len(ids)):
            whole[t] = whole[t] and whole[left[t]] and whole[right[t]]
        self.whole = np.array(whole)
        self._grow_trie(turns, byte_of)
        self._spell(vocab, kind["added_tokens"], byte_of)
        self.added = {t["content"]: t["id"] for t in kind["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = Words()

    def _grow_trie(self, turns: dict[str, int], byte_of: dict[str, int]) -> None:
        """Steps from node to node by a byte, as a sorted table, and the entry that ends at each node."""
        steps: dict[int, int] = {}
        ends = [-1]
        for spelt, turn in turns.items():
            node = 0
            for c in spelt:
                key = node << 8 | byte_of[c]
                node = steps.get(key, 0)
                if not node:
                    node = steps[key] = len(ends)
                    ends.append(-1)
            ends[node] = turn
        keys, nodes = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps))
        order = np.argsort(keys)
        self.step_keys, self.step_nodes, self.ends = keys[order], nodes[order], np.array(ends, np.int64)
        # A match's first byte is looked up directly.
        self.first = np.zeros(256, np.int64)
        self.first[self.step_keys[self.step_keys < 256]] = self.step_nodes[self.step_keys < 256]

    def _spell(self, vocab: dict[str, int], added: list[dict], byte_of: dict[str, int]) -> None:
        """The bytes of every id. An entry with letters that spell no byte stands for its own text."""
        spelt = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        values = [b""] * (max(spelt) + 1)
        self.known = np.zeros(len(values), bool)
        for i, s in spelt.items():
            self.known[i] = True
            values[i] = bytes(map(byte_of.__getitem__, s)) if all(c in byte_of for c in s) else s.encode()
        self.value_bytes = np.frombuffer(b"".join(values), np.uint8)
        self.value_starts = np.concatenate([[0], np.cumsum([len(v) for v in values])])

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the boundary of each pair has its turn before both sides are complete (before ``limit``)."""
        out = np.zeros(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        while len(at):
            key = (a << 32) | b
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            across = np.where(self.pairs[place] == key, self.pair_turns[place], NEVER) if len(self.pairs) else np.full(len(key), NEVER)
            fine = across >= limit
            single = np.maximum(a, b) < 256
            out[at[fine & single]] = True
            go = fine & ~single
            at, a, b, limit = at[go], a[go], b[go], limit[go]
            # The left side is taken apart if it was completed later; a merge of the same turn further left comes first.
            side = a > b
            limit = np.minimum(limit, np.where(side, a, b + 1))
            a, b = np.where(side, self.right[a], a), np.where(side, b, self.left[b])
        return out

    def longest(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest entry that begins at each byte and ends by the byte's ``ends``: its turn and its number of bytes."""
        turn, length = np.zeros(len(data), np.int32), np.ones(len(data), np.int32)
        for begin in range(0, len(data), AT_ONCE):
            at = np.arange(begin, min(begin + AT_ONCE, len(data)))
            node = self.first[data[at]]
            turn[at] = self.ends[node]
            depth = 1
            while len(at):
                go = at + depth < ends[at]
                at, node = at[go], node[go]
                key = node << 8 | data[at + depth]
                place = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                go = self.step_keys[place] == key
                at, node = at[go], self.step_nodes[place[go]]
                depth += 1
                entry = self.ends[node]
                there = entry >= 0
                turn[at[there]], length[at[there]] = entry[there], depth
        return turn, length

    def merged(self, word: bytes) -> list[int]:
        """The turns of a word by exact merging; memory is some 60 bytes for each byte of the word."""
        parts, merges = array("i", list(word)), self.merges
        after, before = array("i", range(1, len(word) + 1)), array("i", range(-1, len(word) - 1))
        waiting = [(t << 32) | i for i in range(len(word) - 1) if (t := merges.get((parts[i] << 32) | parts[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            turn, i = divmod(heapq.heappop(waiting), 1 << 32)
            j = after[i]
            if parts[i] < 0 or j >= len(word) or merges.get((parts[i] << 32) | parts[j]) != turn:
                continue
            parts[i], parts[j] = turn, -1
            after[i] = k = after[j]
            if k < len(word):
                before[k] = i
                if (t := merges.get((turn << 32) | parts[k])) is not None:
                    heapq.heappush(waiting, (t << 32) | i)
            if (h := before[i]) >= 0 and (t := merges.get((parts[h] << 32) | turn)) is not None:
                heapq.heappush(waiting, (t << 32) | h)
        return [t for t in parts if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in sequence, the number of each, and how many words had to be merged exactly."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        turn, length = self.longest(data, np.repeat(ends, sizes))
        # The greedy walk: from each entry's first byte to the next one's.
        step, places, at = length.tolist(), [], 0
        while at < len(step):
            places.append(at)
            at += step[at]
        starts = np.array(places, np.int64)
        turns = turn[starts].astype(np.int64)
        own = np.searchsorted(ends, starts, side="right")
        wrong = np.zeros(len(words), bool)
        wrong[own[~self.whole[turns]]] = True
        inner = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
        pairs, back = np.unique((turns[inner] << 32) | turns[inner + 1], return_inverse=True)
        wrong[own[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        counts = np.bincount(own, minlength=len(words))
        if not wrong.any():
            return self.ids[turns], counts, 0
        exact = [self.merged(words[i]) for i in np.flatnonzero(wrong).tolist()]
        kept = turns[~wrong[own]]
        counts[wrong] = [len(x) for x in exact]
        out = np.zeros(int(counts.sum()), np.int64)
        of_wrong = np.repeat(wrong, counts)
        out[~of_wrong], out[of_wrong] = kept, np.concatenate([np.array(x, np.int64) for x in exact])
        return self.ids[out], counts, len(exact)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Ids that the vocabulary hasn't are passed over; bytes that aren't UTF-8 become U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        ids = ids[self.known[ids]]
        starts = self.value_starts[ids]
        return self.value_bytes[spread(starts, self.value_starts[ids + 1] - starts)].tobytes().decode("utf-8", "replace")


class BpeEncoder:
    """Ids of whole texts, unit by unit, with a pool of units that were seen before."""

    def __init__(self, path: str, slots: int = 1 << 19, most_ids: int = 3 << 20) -> None:
        self.model, self.pool = ByteBpe(path), Pool(slots, most_ids)
        self.n_words = self.n_exact = 0

    def _new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in sequence, and the number of each; every distinct word of them is encoded once."""
        find, number, words, counts = self.model.words, {}, [], []
        for unit in units:
            found = find(unit)
            words += [number.setdefault(w, len(number)) for w in found]
            counts.append(len(found))
        ids, sizes, exact = self.model.encode_words([w.encode() for w in number])
        self.n_words, self.n_exact = self.n_words + len(number), self.n_exact + exact
        every = np.array(words, np.int64)
        begins = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[every])])
        edges = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        return ids[spread(begins[every], sizes[every])], np.diff(ends[edges])

    def plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens in sequence, and the texts' offsets among them."""
        bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        begins = np.zeros(len(data) + 1, bool)
        gap = (data[:-1] == 0x20) | (data[:-1] == 0x0A)
        begins[: len(data) - 1] = gap & ~_MAY_BE_SPACE[data[1:]] if len(data) else False
        begins[bounds[1:] - 1] = False
        begins[bounds] = True
        cuts = np.flatnonzero(begins)
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
        coded = units.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        one, two = digests(names)
        place = self.pool.find(one, two)
        known, missing = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        new, new_counts = self._new(names[missing].tolist())
        starts = self.pool.starts[place[known]].astype(np.int64)
        old_counts = self.pool.starts[place[known] + 1] - starts
        ids, counts = np.concatenate([self.pool.ids[spread(starts, old_counts)], new]), np.concatenate([old_counts, new_counts])
        self.pool.add(one[missing], two[missing], new_counts, new)
        number = np.zeros(len(names), np.int64)
        number[known], number[missing] = np.arange(len(known)), len(known) + np.arange(len(missing))
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        begin = np.cumsum(counts) - counts
        offsets = np.concatenate([[0], np.cumsum(counts[at])])
        return ids[spread(begin[at], counts[at])], offsets[np.searchsorted(cuts, bounds)]

    def __call__(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in sequence, and the texts' offsets among them. An added token's string is its id wherever it
        stands; what lies between such strings is encoded by itself."""
        added = self.model.added
        marked = np.zeros(len(text), bool)
        for token in added:
            marked |= pc.match_substring(text, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.plain(text)
        pieces, owners, tokens = [], [], []
        for i, t in enumerate(text.to_pylist()):
            at = 0
            for found in self.model.cut.finditer(t) if marked[i] else ():
                pieces.append(t[at : found.start()])
                tokens.append(added[found.group()])
                owners.append(i)
                at = found.end()
            pieces.append(t[at:])
            tokens.append(-1)
            owners.append(i)
        ids, offsets = self.plain(pa.array(pieces, pa.large_string()))
        tokens, owners = np.array(tokens, np.int32), np.array(owners)
        out = np.insert(ids, offsets[1:][tokens >= 0], tokens[tokens >= 0])
        counts = np.bincount(owners, np.diff(offsets) + (tokens >= 0), len(text)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=1)
def load(path: str) -> BpeEncoder:
    """The encoder of a file, which a Python worker keeps with its pool from task to task."""
    return BpeEncoder(path)


def bpe_encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row's whole text, as the file ``tokenizer`` says, without tokens added around it.

    A null or empty text has no ids. Ids come out for every row, repeated and null doc_ids included; other columns are not
    read; an empty table gives an empty result. A long text is one value in a task. Files other than byte-level BPE without
    prefix space, normaliser or stripping tokens raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer)
        for batch in text_slices(batches):
            ids, offsets = encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), lists], ["doc_id", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text, decoded_sha256) of rows with ids: the text, special tokens included, and digests.

    Null ids give null; ids that the vocabulary hasn't are passed over in the text; a null among ids is such an id. Rows stay
    rows, whatever their doc_id; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer).model
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = [x.values for x in part.column("ids")]
                arrays = [None if x is None else x.fill_null(-1).to_numpy(zero_copy_only=False) for x in lists]
                texts = [None if a is None else model.decode(a) for a in arrays]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([None if a is None else len(a) for a in arrays], pa.int64()),
                    "ids_sha256": pa.array([None if a is None else hashlib.sha256(a.astype("<u4").tobytes()).hexdigest() for a in arrays], pa.string()),
                    "text": pa.array(texts, pa.string()),
                    "decoded_sha256": pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    rows = encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, text string, decoded_sha256 string")
