"""Phrase mining against plain code."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import phrases
from quarryline.llm.phrases import Filter, collocations, mine, sections, shard


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain(rows, max_words, min_count, absorb, top):
    """(lang, text) -> the same in loops."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in split(text):
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        frequent = {p: f for p, f in own.items() if len(p) > 1 and f >= min_count}
        scored = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * f >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(frame, **how):
    return sorted(tuple(r) for r in collocations(frame, **how).collect())


SCHEMA = "lang string, text string, grp string, phrase string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "C", "dé", "e'", "f-g", "x\x00y", "漢"]
    gap = lambda: r.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "!? ", "\r\n"])
    line = lambda: "".join(r.choice(words) + gap() for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "fr", None, "und", ""]), line()) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " . "), ("en", "new york city and " * 40), rows[0], rows[0]]


def test_collocations_equal_plain_code(spark):
    rows = texts(1, 120)
    how = {"max_words": 5, "min_count": 6, "absorb": 100, "top": 40}
    assert got(frame(spark, rows).repartition(5), **how) == plain(rows, **how)


@pytest.mark.parametrize("how", [{"max_words": 2}, {"max_words": 3, "absorb": 60}, {"max_words": 7, "absorb": 80, "min_count": 3}])
def test_collocations_with_other_parameters(spark, how):
    rows = texts(2, 60)
    how = {"min_count": 5, "absorb": 100, "top": 1000} | how
    assert got(frame(spark, rows), **how) == plain(rows, **how)


def test_collocations_where_counts_are_joined_with_salt(spark, monkeypatch):
    monkeypatch.setattr(phrases, "small_enough", lambda *a: False)
    rows = texts(3, 60)
    how = {"max_words": 4, "min_count": 5, "absorb": 100, "top": 30}
    assert got(frame(spark, rows), **how) == plain(rows, **how)


def test_collocations_of_nothing(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [("en", "a b c"), (None, None)])) == []


class Any(Filter):
    """A filter with false positives only."""

    def __init__(self):
        pass

    def __call__(self, hashes):
        return np.ones(len(hashes), bool)


@pytest.mark.parametrize("entries", [1, 7, 1 << 17])
def test_bitmaps_count_all_phrases_of_a_shard(entries):
    r = random.Random(4)
    text = "".join(r.choice("abc") + r.choice([" ", " ", " ", ". "]) for _ in range(700))
    words, codes, n = shard([text, "", "a b"])
    assert n == 702
    want = Counter()
    for w in [*split(text), ["a", "b"]]:
        for k in range(2, 5):
            want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    found = Counter()
    names = words.to_pylist()
    for path, counts in mine(words, codes, "en", [Any()] * 3, range(2, 5), entries):
        for p, c in zip(zip(*(x.tolist() for x in path), strict=True), counts.tolist(), strict=True):
            assert tuple(names[i] for i in p) not in found
            found[tuple(names[i] for i in p)] = c
    assert found == want


def test_sections_are_cut_at_ends_of_pieces():
    text = "ab cd. ef gh, " * 50 + "z" * 500 + "! q"
    parts = list(sections(text, 40))
    assert "".join(parts) == text
    assert [w for p in parts for w in split(p) if w] == [w for w in split(text) if w]
    assert all(len(p) <= 40 or "z" * 30 in p for p in parts)
    assert list(sections("", 4)) == [""]


def test_shard_of_no_words():
    words, codes, n = shard([" ., ", ""])
    assert (len(words), len(codes), n) == (0, 0, 0)
    assert list(mine(words, codes, "en", [Any()], range(2, 3))) == []
    assert pa.types.is_large_string(words.type)
