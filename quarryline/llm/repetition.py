"""Quality rules on repetition inside a document, found with a suffix array.

All documents of an Arrow slice share one suffix array over word numbers, in which words of different documents never
compare equal. Prefix doubling sorts it; only suffixes whose place is still open are sorted again in later rounds. The
ranks of every round stay, so the longest common prefix of neighbours comes from binary lifting. Intervals of the
longest-common-prefix table give the maximal repeated substrings; their spans are united, and a document whose covered
share or longest repeat passes its limit is not kept. Memory is bounded by a slice (2 MB of text, or one document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarryline.llm.common import flat, sums, text_slices, words_of

#: Words that a repeated substring has at least to count as covered text.
MIN_REPEAT = 8
#: Share of a document's words that such substrings may cover.
MAX_COVERED = 0.3
#: Words that the longest repeated substring may have.
MAX_LONGEST = 100

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, covered_words long, longest_repeat long, n_maximal_repeats long"
)


def suffix_array(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes of the documents' ``keys``, and for each power of two the classes of equal substrings.

    ``docs`` is the ascending document number of each position; a suffix ends with its document.
    """
    n = len(keys)
    order = np.lexsort((keys, docs)) if n else np.zeros(0, np.int64)
    k, d = keys[order], docs[order]
    first = np.ones(n, bool)
    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = starts
    levels, width = [rank], 1
    while True:
        # Places whose class has several members, in the present order.
        alone = first & np.append(first[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order, levels
        at = order[open_at]
        after = at + width
        inside = after < n
        after[~inside] = 0
        inside &= docs[after] == docs[at]
        second = np.where(inside, rank[after].astype(np.int64) + 1, 0)
        both = rank[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[open_at] = at
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        first = first.copy()
        first[open_at] = new
        rank = rank.copy()
        rank[at] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order, 0 for the first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if n else np.zeros(0, np.int64)
    a, b = order[pairs - 1], order[pairs]
    got = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = levels[level][x[inside]] == levels[level][y[inside]]
        got[same] += 1 << level
    out[pairs] = got
    return out


def intervals(prefixes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of each interval of the prefix table with a length of ``least`` or more."""
    found = []
    stack: list[tuple[int, int]] = []
    n = len(prefixes)
    before = -2
    for i in np.flatnonzero(prefixes >= least).tolist():
        if i != before + 1:
            found += [(begin, before, length) for begin, length in stack]
            stack = []
        length, begin = int(prefixes[i]), i - 1
        while stack and stack[-1][1] > length:
            begin, other = stack.pop()
            found.append((begin, i - 1, other))
        if not stack or stack[-1][1] < length:
            stack.append((begin, length))
        before = i
    assert before < n
    return found + [(begin, before, length) for begin, length in stack]


def maximal_repeats(
    order: np.ndarray, prefixes: np.ndarray, keys: np.ndarray, docs: np.ndarray, least: int, every: list[tuple[int, int, int]] | None = None
) -> list[tuple[int, int, int]]:
    """The intervals whose occurrences aren't all preceded by the same word: repeats that can't be made longer."""
    before = np.full(len(keys), -1, np.int64)
    same_doc = docs[1:] == docs[:-1]
    before[1:][same_doc] = keys[:-1][same_doc]
    left = before[order]
    # A document's first word has nothing before it, which differs from everything.
    differs = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))])
    return [(a, b, length) for a, b, length in (intervals(prefixes, least) if every is None else every) if differs[b] > differs[a]]


def repeat_spans(order: np.ndarray, prefixes: np.ndarray, keys: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Begins and lengths of spans whose union is that of all occurrences of all maximal repeats, and these repeats.

    At each word the deepest interval counts, since shorter repeats from there lie inside its span. Where that interval isn't
    maximal, the same repeat begins a word earlier and covers this one.
    """
    every = intervals(prefixes, least)
    maximal = maximal_repeats(order, prefixes, keys, docs, least, every)
    if not maximal:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    n = len(order) + 1
    begin, end, length = np.array(every, np.int64).T
    by = np.argsort(length * n + begin)
    begin, end, length = begin[by], end[by], length[by]
    known = np.sort(np.array(maximal, np.int64)[:, 2] * n + np.array(maximal, np.int64)[:, 0])
    tall = np.maximum(prefixes, np.append(prefixes[1:], 0))
    places = np.flatnonzero(tall >= least)
    own = np.searchsorted(length * n + begin, tall[places] * n + places, side="right") - 1
    name = length[own] * n + begin[own]
    at = np.minimum(np.searchsorted(known, name), len(known) - 1)
    kept = known[at] == name
    return order[places[kept]], length[own[kept]], maximal


def covered(begins: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of all texts of an array without nulls."""
    words, offsets = words_of(text)
    n, rows = len(words), len(text)
    docs = np.repeat(np.arange(rows), np.diff(offsets))
    keys = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order, levels = suffix_array(keys, docs)
    prefixes = common_prefixes(order, levels)
    # Windows of three words that occur again are those inside repeats of three words or more.
    begins, lengths, maximal = repeat_spans(order, prefixes, keys, docs, min(3, min_repeat))
    long = lengths >= min_repeat
    repeated = lengths >= 3
    tops, many = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for a, _, length in maximal:
        own = docs[order[a]]
        tops[own] = max(tops[own], length if length >= 3 else 0)
        many[own] += length >= min_repeat
    lines, ends = flat(pc.split_pattern(text, "\n"))
    spoken = np.flatnonzero(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False))
    of = np.repeat(np.arange(rows), np.diff(ends))[spoken]
    same = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[spoken]
    distinct = np.unique(of * (len(lines) + 1) + same) // (len(lines) + 1)
    return {
        "n_words": np.diff(offsets),
        "word_chars": sums(pc.utf8_length(words).to_numpy(zero_copy_only=False), offsets),
        "n_symbols": pc.count_substring_regex(text, "[#*$%&|<>]").to_numpy(zero_copy_only=False),
        "n_dup_lines": np.bincount(of, minlength=rows) - np.bincount(distinct, minlength=rows),
        "n_repeat_words": sums(covered(begins[repeated], lengths[repeated], n), offsets),
        "covered_words": sums(covered(begins[long], lengths[long], n), offsets),
        "longest_repeat": tops,
        "n_maximal_repeats": many,
    }


def repetition_rules(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): word and line counts, the base rules' verdict and the method's.

    A null or empty text has no words and fails the base rules. A very long text is measured whole, in an array of its own:
    4 bytes a word for each doubling up to its longest repeat. Null ids and repeated rows are measured as they come; other
    columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            m = measure(batch.column("text"), min_repeat)
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            columns = {"doc_id": batch.column("doc_id"), **m, "base_failed": failed, "kept": kept}
            names = [x.split()[0] for x in SCHEMA.split(", ") for x in x.split(",")]
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := columns[c], pa.Array) else pa.array(x, pa.bool_() if x.dtype == bool else pa.int64()) for c in names], names
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
