"""Encoding of whole texts by the distinct units between spaces, each encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from quarryline.llm.common import flat

#: Slots of a pool's table, and ids that it holds at most: with what it needs for each unit, about 25 MB.
SLOTS, MOST_IDS = 1 << 19, 3 << 20
#: Units fill this share of the slots at most.
FULL = 0.6


def digests(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each string, in two halves."""
    if not len(names):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(pd.util.hash_array(names, categorize=False, hash_key=key) for key in ("quarryline-first", "quarryline-other"))


class Pool:
    """Ids by the digest of a unit, in flat arrays of a fixed size, so memory has a bound in bytes.

    A full pool keeps the units that were asked for again since they came, or nothing if these are more than half of it.
    """

    def __init__(self, slots: int = SLOTS, most_ids: int = MOST_IDS) -> None:
        self.slots, self.most_ids = slots, most_ids
        self.clear()

    def clear(self) -> None:
        self.first, self.other = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.place = np.full(self.slots, -1, np.int32)
        self.starts, self.ids = np.zeros(int(self.slots * FULL) + 2, np.int32), np.zeros(self.most_ids, np.int32)
        self.again = np.zeros(len(self.starts), bool)
        self.units = self.used = 0

    def make_room(self) -> None:
        slots = np.flatnonzero(self.place >= 0)
        slots = slots[self.again[self.place[slots]]]
        place = self.place[slots]
        first, other, starts = self.first[slots], self.other[slots], self.starts[place].astype(np.int64)
        counts = self.starts[place + 1] - starts
        few = 2 * len(slots) <= self.slots * FULL and 2 * counts.sum() <= self.most_ids
        ids = self.ids[spread(starts, counts)] if few else None
        self.clear()
        if few:
            self.add(first, other, counts, ids)

    def find(self, first: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Each digest's unit number, or -1."""
        out = np.full(len(first), -1, np.int64)
        left, at = np.arange(len(first)), (first & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            place = self.place[at]
            there = place >= 0
            left, at, place = left[there], at[there], place[there]
            same = (self.first[at] == first[left]) & (self.other[at] == other[left])
            out[left[same]] = place[same]
            self.again[place[same]] = True
            left, at = left[~same], (at[~same] + 1) & (self.slots - 1)
        return out

    def add(self, first: np.ndarray, other: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Takes in new units; makes room before if they don't fit, and leaves them out if they still don't."""
        if self.units + len(first) > self.slots * FULL or self.used + len(ids) > self.most_ids:
            self.make_room()
        if self.units + len(first) > self.slots * FULL or self.used + len(ids) > self.most_ids:
            return
        n = self.units
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(first)] = self.used + np.cumsum(counts)
        self.units, self.used = n + len(first), self.used + len(ids)
        left, at = np.arange(len(first)), (first & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.place[at] < 0)
            # Of several units at one free slot the first takes it.
            slots, winners = np.unique(at[free], return_index=True)
            winners = free[winners]
            won = left[winners]
            self.place[slots], self.first[slots], self.other[slots] = n + won, first[won], other[won]
            stay = np.ones(len(left), bool)
            stay[winners] = False
            left, at = left[stay], (at[stay] + 1) & (self.slots - 1)


class UnitEncoder:
    """Turns texts into ids where a text's ids are those of its units in sequence.

    A unit is what lies between two spaces, with ``prefix`` before it; the first unit of a text has ``first`` before it.
    ``encode`` gives the ids of distinct units in sequence and the number of each. Units that were seen before come from a
    pool.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], first: str, prefix: str, slots: int = SLOTS, most_ids: int = MOST_IDS) -> None:
        self.encode, self.first, self.prefix = encode, first, prefix
        self.pool = Pool(slots, most_ids)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in sequence, and the texts' offsets among them."""
        pieces, offsets = flat(pc.split_pattern(text, " "))
        coded = pieces.dictionary_encode()
        codes = 2 * coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.first != self.prefix:
            codes[offsets[:-1]] += 1
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        used = np.zeros(2 * len(names), bool)
        used[codes] = True
        distinct = np.flatnonzero(used)
        one, two = digests(names)
        one, two = one[distinct >> 1] ^ (distinct & 1).astype(np.uint64), two[distinct >> 1]
        place = self.pool.find(one, two)
        known, missing = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        units = [(self.first if c & 1 else self.prefix) + names[c >> 1] for c in distinct[missing].tolist()]
        new, new_counts = self.encode(units)
        # The slice's own units: those of the pool, then the new ones.
        starts = self.pool.starts[place[known]].astype(np.int64)
        old_counts = self.pool.starts[place[known] + 1] - starts
        old = self.pool.ids[spread(starts, old_counts)]
        self.pool.add(one[missing], two[missing], new_counts, new)
        ids, counts = np.concatenate([old, new]), np.concatenate([old_counts, new_counts])
        begins = np.cumsum(counts) - counts
        number = np.zeros(len(used), np.int64)
        number[distinct[known]], number[distinct[missing]] = np.arange(len(known)), len(known) + np.arange(len(missing))
        at = number[codes]
        ends = np.cumsum(counts[at])
        return ids[spread(begins[at], counts[at])], np.concatenate([[0], ends])[offsets]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all members of runs."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
