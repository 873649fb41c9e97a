"""The operators on documents against plain code, with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import decontamination, jaccard, linedup, pii, repetition, tokenfile, toxicity, viterbi
from quarryline.llm.components import connected_components
from quarryline.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_lines long, key string, seed string"


def frame(spark, texts):
    """Documents with ids, columns whose names the operators use themselves, a null id and a repeated row."""
    rows = [(i, t, "en", 7, "k", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, texts[0], None, None, None, None)], SCHEMA)


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    line = "this very line comes again in many documents"
    out = [None, "", " \n\t ", "word", "a b a b a b a b", "é ñ 　x\x0b y", "x" * 20_000, prose(rng, 6000), "\n".join([line] * 40)]
    for i in range(30):
        body = prose(rng, rng.randrange(5, 300))
        out.append(f"{body}\n  {line.upper() if i % 3 else line} \n{body if i % 4 == 0 else prose(rng, 20)}\n#*$%")
    return [*out, out[-1], out[-2]]


# Repetition.


def longest_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def covered(spans, n):
    hit = [False] * n
    for a, k in spans:
        hit[a : a + k] = [True] * k
    return sum(hit)


def test_repetition_counts(spark):
    some = [t for t in texts() if t is None or len(t) < 3000]
    got = {r.doc_id: r for r in repetition.repetition_rules(frame(spark, some), min_repeat=4, max_covered=0.3, max_longest=20).collect()}
    for i, t in enumerate(some):
        w = WORD.findall(t or "")
        longest = longest_repeats(w)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        repeat = covered([(p, 3) for p, k in enumerate(longest) if k >= 3], len(w))
        cover = covered([(p, k) for p, k in enumerate(longest) if k >= 4], len(w))
        top = max((k for k in longest if k >= 3), default=0)
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, failed, not failed and cover <= 0.3 * len(w) and top <= 20, cover, top)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.covered_words, r.longest_repeat) == want


def test_maximal_repeats_are_the_intervals():
    rng = np.random.default_rng(3)
    for _ in range(20):
        keys, docs = rng.integers(0, 3, 60), np.sort(rng.integers(0, 3, 60))
        order, levels = repetition.suffix_array(keys, docs)
        prefixes = repetition.common_prefixes(order, levels)
        got = set()
        for a, b, k in repetition.maximal_repeats(order, prefixes, keys, docs, 2):
            got.add((docs[order[a]], tuple(keys[order[a] : order[a] + k]), b - a + 1))
        want = set()
        for d in set(docs.tolist()):
            own = keys[docs == d].tolist()
            places = collections.defaultdict(list)
            for i in range(len(own)):
                for j in range(i + 2, len(own) + 1):
                    places[tuple(own[i:j])].append(i)
            for s, at in places.items():
                ends = {own[i + len(s)] if i + len(s) < len(own) else ("end", i) for i in at}
                begins = {own[i - 1] if i else ("begin", i) for i in at}
                if len(at) > 1 and len(ends) > 1 and len(begins) > 1:
                    want.add((d, s, len(at)))
        assert got == want


# Line deduplication.


def deduplicated(rows, least, keep_first):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    counts, firsts = collections.Counter(), {}
    for d, t in rows:
        counts.update({k for k in keys(t) if k})
        for n, k in enumerate(keys(t)):
            at = (d is not None, d if d is not None else 0, n)
            firsts[k] = min(firsts.get(k, at), at)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for n, (x, k) in enumerate(zip(lines, keys(t), strict=True)) if counts[k] < least or not k or keep_first and firsts[k] == (d is not None, d if d is not None else 0, n)]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "bits"), [(1 << 20, 1 << 29), (-1, 1 << 29), (1 << 20, 1 << 14), (-1, 0)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, size, bits, keep_first):
    some = [(i, t) for i, t in enumerate(texts())] + [(None, "alone\nthis very line comes again in many documents"), (None, "another\nx"), (None, None), (9, "x\nthis very line comes again in many documents")]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("n_lines", F.lit(-1)).withColumn("key", F.lit("clash")).withColumn("__keys", F.lit("c")).withColumn("__id", F.lit(1))
    got = linedup.dedup_lines(df, min_docs=10, keep_first=keep_first, broadcast_bytes=size, most_bits=bits)
    assert got.columns == ["doc_id", "text", "key", "__keys", "__id", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == deduplicated(some, 10, keep_first)


def test_line_dedup_in_a_task_that_sends_often(spark, monkeypatch):
    monkeypatch.setattr(linedup, "HELD", 5)
    some = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
    got = linedup.dedup_lines(df, min_docs=2, keep_first=False)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == deduplicated(some, 2, False)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 21, 0])
def test_few_lines_are_suspected_at_any_size(spark, bits):
    """20,000 lines that occur once and 300 that occur twice: all of these are found, and few others, whatever may be sent."""
    rng = random.Random(7)
    lines = [f"line {i} {rng.random()}" for i in range(20_000)] + 2 * [f"twice {i}" for i in range(300)]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[100 * i : 100 * i + 100])) for i in range(206)], "doc_id long, text string").repartition(4)
    found = [r.key for r in linedup.suspected(docs, len(lines), 1, most_bits=bits).collect()]
    both = collections.Counter(k for i in range(206) for k in set(lines[100 * i : 100 * i + 100]))
    assert {k for k, n in both.items() if n > 1} <= set(found)
    assert sum(both[k] == 1 for k in set(found)) < 0.05 * 20_000


# Toxicity.


def test_segments_are_maximal():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 25)
        hits = sorted((p, rng.choice([1.0, 2.0, 0.5])) for p in rng.sample(range(n), rng.randrange(1, n + 1)))
        rest = -rng.choice([0.3, 1.0, 2.0])
        scores = [rest] * n
        for p, s in hits:
            scores[p] = s

        def split(a, b, scores=scores):
            best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[3:]
            return [*split(a, i), (round(best[0], 6), i, j - 1), *split(j, b)]

        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits, rest)]
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in split(0, n)))
        assert max(got) [0] == max(split(0, n))[0]


def split_segments(scores, a, b):
    """All maximal segments by definition: the highest one, and those of what lies before and behind it."""
    best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
    if best[0] <= 0:
        return []
    return [*split_segments(scores, a, best[1]), (best[0], best[1], best[2] - 1), *split_segments(scores, best[2], b)]


def test_segments_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 25)
        hits = sorted((p, rng.uniform(0.1, 3)) for p in rng.sample(range(n), rng.randrange(1, n + 1)))
        rest = -rng.uniform(0.1, 2)
        scores = [dict(hits).get(i, rest) for i in range(n)]
        got = [(round(s, 9), a, b) for s, a, b in toxicity.segments(hits, rest)]
        assert got == [(round(s, 9), a, b) for s, a, b in split_segments(scores, 0, n)]


def toxic_rows(rng):
    rows = []
    for i in range(500):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))]
        if i % 5 == 0:
            words[3:3] = [rng.choice(["vile", "vileness", "scornful"]) for _ in range(rng.randrange(1, 5))]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_against_plain_code(spark):
    """Counts, log-odds, the extreme-value law, the curve and every score, made again without the operator's code."""
    rows = toxic_rows(random.Random(12))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows if i % 4]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    # Texts of fewer than five words may be equal; of equal texts one of each class counts.
    train = sorted({(t, y) for i, t, y in rows if i % 4})
    n = [sum(y == c for _, y in train) for c in (0, 1)]
    total = [sum(len(t.split()) for t, y in train if y == c) for c in (0, 1)]
    counts = [collections.Counter(), collections.Counter()]
    for t, y in train:
        counts[y].update({f for w in t.split() for f in [f"={w}", *(f"{k}{w[:k]}" for k in (4, 5) if len(w) >= k)]})
    weights, null = {}, []
    for f in counts[1]:
        a, b = counts[1][f], counts[0][f]
        prior = 0.05 * (a + b)
        value = math.log((a + prior) / (n[1] + 0.05 * sum(n) - a - prior)) - math.log((b + prior) / (n[0] + 0.05 * sum(n) - b - prior))
        if a >= 3 and value >= toxicity.MIN_LOG_ODDS and value / math.sqrt(1 / (a + prior) + 1 / (b + prior)) >= toxicity.MIN_Z:
            weights[f] = value
            null.append(((b + prior) / total[0], value))
    assert weights and model.weights == pytest.approx(weights)
    inside = sum(counts[1][f] for f in weights if f[0] == "=") / total[1]
    rest = min(math.log1p(-min(inside, 0.5)) - math.log1p(-min(sum(p for p, _ in null), 0.4)), -1e-3)
    assert model.rest == pytest.approx(rest)
    # Karlin and Altschul's law: the mean of exp(scale * score) is 1 over clean words.
    assert sum(p * math.exp(model.scale * s) for p, s in null) + (1 - sum(p for p, _ in null)) * math.exp(model.scale * rest) == pytest.approx(1)

    def evidence(text):
        words = text.split()
        scores = []
        for w in words:
            known = [weights[f] for f in (f"={w}", f"4{w[:4]}", f"5{w[:5]}") if f in weights]
            scores.append(max(known, default=rest))
        found = [(model.scale * s - math.log(max(len(words), 1)), a, b) for s, a, b in split_segments(scores, 0, len(words))]
        high = [x for x in found if x[0] >= -math.log(toxicity.SIGNIFICANCE)]
        return min(sum(x[0] for x in high) if high else max([0.0, *(x[0] for x in found)]), 100.0), high

    x = np.array([evidence(t)[0] for t, _ in train] + [0.0, 0.0, 10.0, 10.0]) / 10
    y = np.array([y for _, y in train] + [0, 1, 0, 1], float)
    weight = np.array([1.0] * len(train) + [0.9, 0.1, 0.1, 0.9])
    p = 1 / (1 + np.exp(-(model.intercept + 10 * model.slope * x)))
    # Where the curve is steepest in likelihood its derivatives are 0, but for the light pull to 0.
    assert abs((weight * (y - p)).sum() - 1e-3 * model.intercept) < 1e-3
    assert model.slope > 0 and abs((weight * (y - p) * x).sum() - 1e-3 * 10 * model.slope) < 1e-3
    for r in toxicity.score(docs, model).collect():
        value, high = evidence(rows[r.doc_id][1])
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * value))))
        assert [(s.first, s.last) for s in r.passages] == [(a, b) for _, a, b in high]


def test_a_shared_passage_does_not_make_texts_a_family(spark):
    """Texts that share one passage, which may have their least shingle, all count; copies with a changed word count once."""
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(i, f"{shared} {prose(rng, 30, 9000)} foul{i % 3}", int(i % 3 == 0)) for i in range(300)]
    copies = [(1000 + i, " ".join([f"y{i}" if k == 100 else f"c{k}" for k in range(200)] + ["copied"]), 1) for i in range(50)]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows + copies], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows + copies], "doc_id long, toxic int"))
    assert "=foul0" in model.weights
    assert "=copied" not in model.weights


def test_clean_rows_keep_all_columns(spark):
    rows = toxic_rows(random.Random(4))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    df = spark.createDataFrame([(i if i % 7 else None, t, "x", i) for i, t, _ in rows] + [(None, None, None, -1), (1, "", "e", -2), (1, "", "e", -2)], "doc_id long, text string, __nth string, at long")
    model = toxicity.fit(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), labels)
    scores = {r.doc_id: r.score for r in toxicity.score(df.selectExpr("at as doc_id", "text"), model).collect()}
    got = toxicity.clean_rows(df, model)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if scores[r.at] < 0.5)


def test_toxicity_learns_and_bears_odd_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 150))]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vileness", "vilenesses", "scorn"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (601, ""), (0, rows[0][1])], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame([*labels[:450], (None, 1), (9999, 1), (3, None), (4, 2), (5, -1)], "doc_id long, toxic int"))
    got = collections.defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r)
    assert [(r.score >= 0.5) == bool(y) for i, y in labels[450:] for r in got[i]].count(False) <= 3
    assert len(got[0]) == 2 and len(got[None]) == 1 and got[601][0].score < 0.5
    assert all(0 <= r.score <= 1 for g in got.values() for r in g)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.01}
    assert toxicity.score(docs.limit(0), model).collect() == []


# Near duplicates.


def linked_rows(rows, threshold=0.8):
    """(id, group, links) of each row by comparing all with all."""

    def shingles(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= threshold * union:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(d, root(i), links[i]) for i, (d, _) in enumerate(rows)]


def linked(rows, threshold=0.8):
    """Rows with the least id of their group instead of its number."""
    found, groups = linked_rows(rows, threshold), collections.defaultdict(list)
    for d, group, _ in found:
        groups[group].append(d)
    ids = {g: min((d for d in v if d is not None), default=None) for g, v in groups.items()}
    return sorted(((d, ids[g], n) for d, g, n in found), key=str)


def near_rows():
    rng = random.Random(6)
    rows = []
    for f in range(12):
        base = prose(rng, rng.choice([8, 60, 200]), 5000).split()
        for c in range(rng.choice([1, 2, 6, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4]) if c else 0):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", "one two", "one  two", "one", rows[0][1]])]
    return [*rows, rows[0], (None, rows[1][1]), (None, "lonely words without an id")]


@pytest.mark.parametrize("small", [512, 4])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 1024 if small == 512 else 8)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("node", F.lit(1))
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str) == linked(rows)


def test_pairs_just_above_the_threshold_are_found_in_large_buckets(spark, monkeypatch):
    """400 pairs of different texts at 0.80 to 0.86 that all share a passage, so that buckets pass SMALL at the first levels."""
    monkeypatch.setattr(jaccard, "SMALL", 16)
    rng, rows, pairs = random.Random(31), [], []
    passage = [f"p{i}" for i in range(90)]
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(pairs) < 400:
        one = passage + [f"a{rng.randrange(10**6)}" for _ in range(60)]
        two = list(one)
        for at in rng.sample(range(95, 145), rng.randrange(1, 5)):
            two[at] = f"b{rng.randrange(10**6)}"
        share = len(cut(one) & cut(two)) / len(cut(one) | cut(two))
        if 0.8 <= share <= 0.86:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a].class_id == got[b].class_id == a and got[a].n_links == got[b].n_links == 1 for a, b in pairs)


def test_a_large_group_of_near_copies_is_not_connected_again_and_again(spark, monkeypatch):
    """Pivots connect the group; buckets of it alone bring no more edges, and one with another text brings one."""
    monkeypatch.setattr(jaccard, "SMALL", 16)
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(120)]
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(120), 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = jaccard.sketched(df, runs=jaccard.runs_needed(0.8)).select("key", "sketch").localCheckpoint()
    made = jaccard.candidates(classes, 0.8).localCheckpoint()
    assert made.count() < 2 * 300
    assert [r["count"] for r in jaccard.connected_components(made).groupBy("root").count().collect()] == [300]
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str) == linked(rows)


def test_a_bucket_that_is_connected_but_for_a_few_is_not_split(spark, monkeypatch):
    """Near copies in a chain of three kinds, each linked to the next alone, and pairs of texts that share a passage with them."""
    monkeypatch.setattr(jaccard, "SMALL", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    split, real = [], jaccard.stored

    def watched(df, label, *args):
        out = real(df, label, *args)
        split.extend([out.count()] if label == "nodes" else [])
        return out

    monkeypatch.setattr(jaccard, "stored", watched)
    rng, rows = random.Random(9), []
    for i in range(180):
        words = [f"k{j}" if j < 10 * (i % 3) else f"w{j}" for j in range(120)]
        words[rng.randrange(40, 120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for _ in range(3):
        words = [f"w{j}" for j in range(50, 120)] + [f"y{rng.randrange(10**6)}" for _ in range(70)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-1]))]
    assert sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == linked(rows)
    # Each split makes five rows of one.
    assert sum(split) < 180, split


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame([(4, "a")], "doc_id long, text string")).collect()] == [(4, 4, 0)]


def test_recall_by_runs():
    assert 0.8 < jaccard.survival(0.8) < 1
    assert (1 - jaccard.survival(0.8)) ** jaccard.runs_needed(0.8) <= 1 - jaccard.RECALL


@pytest.mark.parametrize("similarity", [0.8, 0.82])
def test_recall_where_paths_and_gate_share_minhashes(similarity):
    """Runs are drawn: a pair's minhashes, the positions of its paths through all levels, and the gate."""
    rng = np.random.default_rng(4)
    n, runs = 40_000, jaccard.runs_needed(0.8)
    same = rng.random((n, runs * jaccard.SKETCH)) < similarity
    found = np.zeros(n, bool)
    for r in range(runs):
        own = same[:, r * jaccard.SKETCH : (r + 1) * jaccard.SKETCH]
        share = own.mean(axis=1)
        alive = np.ones(n, int)
        for branches, tokens in jaccard.LEVELS:
            alive = rng.binomial(alive * branches, share**tokens)
        found |= (alive > 0) & (share >= 0.6)
    found &= same[:, : jaccard.GATE].sum(axis=1) >= 0.6 * jaccard.GATE
    assert (~found).sum() <= 4
    assert jaccard.missed(0.8, runs) <= 1 - jaccard.RECALL


def test_runs_have_minhashes_of_their_own(spark, monkeypatch):
    """A pair that one run's minhashes tell apart is found by the others, in small buckets and in large ones."""
    rng = np.random.default_rng(5)
    runs = jaccard.runs_needed(0.8)
    a = rng.integers(-30000, 30000, runs * jaccard.SKETCH)
    b = np.where(rng.random(len(a)) < 0.82, a, a + 1)
    b[: jaccard.SKETCH] = np.where(np.arange(jaccard.SKETCH) < 35, a[: jaccard.SKETCH], a[: jaccard.SKETCH] + 1)
    classes = spark.createDataFrame([(b"a", a.tolist()), (b"b", b.tolist())], "key binary, sketch array<short>")
    for small in (512, 1):
        monkeypatch.setattr(jaccard, "SMALL", small)
        assert {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in jaccard.candidates(classes, 0.8).collect()} == {(b"a", b"b")}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 200), (None, 1)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: root(i) for i in parent}


# Decontamination.


def test_leaks_with_substitutions(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([30, 40, 15, 9, 5, 3])] + [(10, None), (11, ""), (0, "another item of the same number here it is")]
    docs = []
    for i, (_, t) in enumerate(items[:6]):
        w = t.split()
        changed = [x if k % 5 != 4 else f"y{k}" for k, x in enumerate(w)]
        pre, post = prose(rng, 50, 3000), prose(rng, 50, 3000)
        docs += [(10 * i, f"{pre} {t} {post}"), (10 * i + 1, f"{pre} {' '.join(changed)} {post}"), (10 * i + 2, f"{pre} {t.upper().replace(' ', ', ')}. {post}"), (10 * i + 3, pre)]
    docs += [(100, None), (101, ""), (102, "..."), (None, items[1][1]), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("seed", F.lit(1))
    found = decontamination.leaks(df, spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit("x"))).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    exact = {(10 * i + k, i) for i in range(6) for k in (0, 2)} | {(None, 1)}
    spoilt = {(10 * i + 1, i) for i in range(3)}
    assert exact | spoilt <= got
    assert got <= exact | spoilt | {(10 * i + 1, i) for i in range(3, 6)}
    assert len(found) == len(got)
    whole = {r.doc_id: r for r in found if r.item_id == 1}
    assert (whole[10].score, whole[10].n_matched, whole[10].item_words) == (40, 40, 40)


def plain_leaks(docs, items, masks=decontamination.MASKS):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shortest, out = min(map(len, masks)), {}
    for d, text in docs:
        doc = cut(text)
        for i, item_text in items:
            item = cut(item_text)
            if not item:
                continue
            shifts = set()
            for mask in masks if len(item) >= shortest else ["1" * len(item)]:
                for a in range(len(doc)):
                    for b in range(len(item) - len(mask) + 1):
                        if all(m == "0" or a + k < len(doc) and doc[a + k] == item[b + k] for k, m in enumerate(mask)):
                            shifts.add(a - b)
            best = (0, 0)
            for shift in shifts:
                now = equal = 0
                top = (0, 0)
                for k in range(len(item)):
                    if 0 <= shift + k < len(doc):
                        same = doc[shift + k] == item[k]
                        equal = (equal if now > 0 else 0) + same
                        now = max(now, 0) + (1 if same else -1)
                        if now > top[0]:
                            top = (now, equal)
                best = max(best, top)
            if best[0] >= min(8, len(item) if len(item) < shortest else math.ceil(len(item) / 2)):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (*best, len(item)))
    return out


def test_leaks_against_plain_code(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, n, 60)) for i, n in enumerate([25, 14, 9, 8, 6, 3, 1])] + [(None, prose(rng, 12, 60)), (2, prose(rng, 11, 60)), (8, None)]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 40), 60).split()
        for _ in range(rng.randrange(3)):
            own = (items[rng.randrange(len(items) - 1)][1] or "").split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[rng.randrange(3) :]
        docs.append((i, " ".join(words)))
    # Rows without an id count together as rows of one id do.
    docs += [(None, docs[3][1]), (None, docs[4][1]), (None, docs[4][1]), (5, docs[9][1]), (70, None), (71, items[0][1].upper().replace(" ", "-"))]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.score, r.n_matched, r.item_words) for r in got} == plain_leaks(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_leaks_of_a_long_repetitive_text(spark):
    """Each of 60,000 words hits; a hit takes 40 words along, not the text."""
    text = " ".join(f"a{i % 12}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"a{i % 12}" for i in range(40)))], "item_id long, text string")
    assert [tuple(r) for r in decontamination.leaks(docs, items).collect()] == [(1, 1, 40, 40, 40)]


def test_leaks_of_texts_with_hits_in_several_rows(spark, monkeypatch):
    rng = random.Random(22)
    items = [(i, prose(rng, 12, 30)) for i in range(5)]
    docs = [(i if i % 4 else None, " ".join(prose(rng, 9, 30) + " " + items[rng.randrange(5)][1] for _ in range(rng.randrange(1, 9)))) for i in range(20)]
    want = plain_leaks(docs, items)
    monkeypatch.setattr(decontamination, "HITS", 2)
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.score, r.n_matched, r.item_words) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15, 0.2, 0.25])
def test_recall_by_rate_of_substitution(spark, rate):
    """Items of 40 words among others, with each word replaced at the rate; what is found at least is stated."""
    rng = random.Random(23)
    items = [(i, prose(rng, 40, 20_000)) for i in range(150)]
    docs = []
    for i, text in items:
        own = [f"x{rng.randrange(20_000)}" if rng.random() < rate else w for w in text.split()]
        docs.append((i, " ".join([prose(rng, 60, 20_000), *own, prose(rng, 60, 20_000)])))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(a == b for a, b in got)
    least = {0.0: 1.0, 0.05: 1.0, 0.1: 0.98, 0.15: 0.93, 0.2: 0.75, 0.25: 0.5}[rate]
    print(f"rate {rate}: recall {len(got) / len(items):.3f}")
    assert len(got) >= least * len(items)


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontamination.leaks(docs.limit(0), items).collect() == []
    assert decontamination.leaks(docs, items.limit(0)).collect() == []


# Personal data.

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_personal_data_spans(spark):
    rng = random.Random(9)
    parts = ["a", "@", ".", "1", "4111111111111111", " ", "-", "+", "é", "b.c", "0", "(", ")", "192.168.", "7", "_", "\n", "+49 30 1234 5678"]
    some = [None, "", "a@b.c@d.e x.y@z.w_q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "9" * 5000, "a" * 5000 + "@" + "b" * 5000]
    some += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    rows = [*enumerate(some), (None, some[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("email", F.lit(1)).withColumn("spans", F.lit("clash"))
    got = {(r.doc_id): r for r in pii.digest(pii.personal_data(df)).collect()}
    for i, t in rows:
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if valid(kind, m.group()))
        text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_account_numbers_and_context(spark):
    some = [(1, "my iban DE89 3704 0044 0532 0130 00 is"), (2, "DE88370400440532013000"), (3, "GB82WEST12345698765432"), (4, "call +49 30 1234 5678"), (5, "order +49 30 1234 5678")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1] if s.kind == "iban"] == [("iban", 8, 35)]
    assert not got[2] and got[3][0].kind == "iban"
    assert got[4][0].score > got[5][0].score


# Encoding.


def whole_viterbi(model, text):
    best, back = [0.0] + [-math.inf] * len(text), [None] * (len(text) + 1)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + model.longest) + 1):
            found = model.pieces.get(text[a:b])
            if found and best[a] + found[1] > best[b]:
                best[b], back[b] = best[a] + found[1], (a, [found[0]])
        if text[a] not in model.pieces and best[a] + model.fallback > best[a + 1]:
            best[a + 1], back[a + 1] = best[a] + model.fallback, (a, model.spelt(text[a]))
    out, at = [], len(text)
    while at:
        out, at = back[at][1] + out, back[at][0]
    return out


def test_streaming_viterbi_equals_the_whole_search(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model, rng = viterbi.load(path), random.Random(4)
    some = [t for t in texts() if t is None or len(t) < 25_000] + ["".join(rng.choice("theranoi☃\n") for _ in range(3000)), "a▁b ▁▁ c▁", "  two  spaces ", "퟿\U0001f600"]
    encoded = {r.doc_id: r for r in viterbi.sp_encode(frame(spark, some), path).collect() if r.doc_id is not None}
    decoded = {r.doc_id: r for r in viterbi.sp_decode(viterbi.sp_encode(frame(spark, some), path), path).collect()}
    for i, t in enumerate(some):
        assert decoded[i].text == (t or "")
        assert decoded[i].ids_crc32 == zlib.crc32(np.array(encoded[i].ids, "<u4").tobytes())
        if "▁" not in (t or ""):
            assert encoded[i].ids == [x for u in (t or "").split(" ") for x in whole_viterbi(model, "▁" + u)]
    from sentencepiece import SentencePieceProcessor

    assert SentencePieceProcessor(model_file=path).decode(encoded[7].ids) == some[7]
    assert viterbi.sp_encode(frame(spark, some).limit(0), path).collect() == []


def test_streaming_viterbi_window_stays_small():
    model = viterbi.load(tokenizer_path("piece_bpe_32k.model"))
    search, out, rng = viterbi.StreamingViterbi(model), [], random.Random(4)
    text = "▁" + "".join(rng.choice("theranois") for _ in range(20_000))
    for i in range(0, len(text), 100):
        out += search.feed(text[i : i + 100])
        assert len(search.text) <= 100 + 8 * model.longest
    assert out + search.close() == whole_viterbi(model, text)


# Token files.


def test_token_files_give_the_ids_back(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    some = [*texts(), " a  b", "a \n b", "x<|endoftext|>y", " ", "  ", "a　 b", "foo 's bar", "tab\t x ", "a\n\n b \n"]
    df = frame(spark, some)
    got = [tuple(r) for r in tokenfile.token_file(df, path).orderBy("start").collect()]
    at, want = 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokenfile.token_file(df.limit(0), path).collect() == []


def test_packing_and_random_access(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**31, 1000), np.full(300, 7), np.arange(120), [2**31 - 1] * 8, rng.integers(0, 3, 777)]).astype(np.int64)
    whole = ids[: len(ids) // 128 * 128]
    data, sizes = tokenfile.pack(whole)
    assert (tokenfile.unpack(data, np.cumsum(sizes) - sizes) == whole).all()
    store, path = fs.FileSystem.from_uri(f"file://{tmp_path}/x")
    with store.open_output_stream(path) as sink:
        writer = tokenfile.ShardWriter(sink)
        writer.add([1, None], np.array([1500, 5]), ids[:1505])
        writer.add([3], np.array([len(ids) - 1505]), ids[1505:])
        writer.close()
    with store.open_input_file(path) as file:
        reader = tokenfile.ShardReader(file)
        assert (reader.ids(0, len(ids)) == ids).all()
        assert (reader.ids(1300, 1311) == ids[1300:1311]).all()
        assert [(i, j) for i, j, _ in reader.documents(most=100)] == [(0, 1), (1, 2), (2, 3)]
    spoilt = bytearray((tmp_path / "x").read_bytes())
    spoilt[20] ^= 1
    (tmp_path / "x").write_bytes(bytes(spoilt))
    with store.open_input_file(path) as file, pytest.raises(ValueError):
        tokenfile.ShardReader(file)


def lengths(units):
    return np.array([len(u) for u in units for _ in range(len(u))], np.int32), np.array([len(u) for u in units], np.int64)


def test_arrow_types_of_units():
    from quarryline.llm.units import UnitEncoder

    encoder = UnitEncoder(lengths, "<", "_", slots=4, most_ids=8)
    for _ in range(3):
        ids, offsets = encoder(pa.array(["a bb", "", "ccc"], pa.large_string()))
        assert ids.tolist() == [2, 2, 3, 3, 3, 1, 4, 4, 4, 4]
        assert offsets.tolist() == [0, 5, 6, 10]


@pytest.mark.parametrize(("slots", "most_ids"), [(1 << 14, 1 << 16), (1 << 12, 1 << 16), (1 << 14, 1 << 12), (16, 64)])
def test_a_pool_of_any_size_gives_the_same_ids(slots, most_ids):
    from quarryline.llm.units import UnitEncoder

    rng = random.Random(6)
    encoder = UnitEncoder(lengths, "<", "_", slots=slots, most_ids=most_ids)
    for _ in range(12):
        some = [" ".join("x" * rng.randrange(1, 9) + str(rng.randrange(1500)) for _ in range(rng.randrange(0, 150))) for _ in range(20)]
        ids, offsets = encoder(pa.array(some, pa.large_string()))
        for i, t in enumerate(some):
            units = [("_" if k else "<") + u for k, u in enumerate(t.split(" "))]
            assert ids[offsets[i] : offsets[i + 1]].tolist() == lengths(units)[0].tolist()
        assert encoder.pool.units <= 0.6 * slots and encoder.pool.used <= most_ids
