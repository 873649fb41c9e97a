"""Byte-pair encoding against the tokenizers library, and vector codes against plain code."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm.bpe import BpeEncoder, bpe_decode, bpe_encode
from quarryline.llm.queries import QUERIES, tokenizer_path
from quarryline.llm.vectorcodes import grow, nearest, product_codes

BYTES = tokenizer_path("byte_bpe_50k.json")
ALPHABETS = ["ab", "thering \n", "'stremdl ", "éàñ漢字😀 a", "0123456789.,-", " \t\n\r\x0b\x1c\x85\xa0   　a1.'"]


@pytest.fixture(scope="module")
def encoder():
    return BpeEncoder(BYTES)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def compare(encoder, library, texts):
    ids, offsets = encoder(pa.array(texts, pa.large_string()))
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want.ids, text
        assert encoder.model.decode(np.array(want.ids, int)) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_equals_the_library_on_random_texts(encoder, library):
    r = random.Random(3)
    compare(encoder, library, ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for a in ALPHABETS for _ in range(800)])
    assert 0 < encoder.n_exact < encoder.n_words


def test_bpe_equals_the_library_on_odd_texts(encoder, library):
    token = "<|endoftext|>"
    compare(encoder, library, ["", " ", "  ", "a  b", "\n\na\n b", f" {token} x", token, f"a{token}{token}b  {token}  c", f"{token[:-1]} {token}>", "a\x00b", "a" * 5000, "the" * 4000, "- " * 3000])


def test_bpe_cuts_words_as_the_library_at_any_character(encoder, library):
    every = [chr(c) for c in range(1, 0x110000, 3) if not 0xD800 <= c <= 0xDFFF]
    for kind in ("a", "1", "!"):
        text = " ".join(kind + c for c in every)
        assert encoder.model.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_bpe_full_pool_changes_nothing(library):
    small = BpeEncoder(BYTES, slots=64, most_ids=200)
    compare(small, library, [" ".join(f"w{(i * i) % 97}" for i in range(k, k + 50)) for k in range(40)])


def test_bpe_every_entry_comes_out_as_itself(encoder):
    assert encoder.model.whole.all()


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        BpeEncoder(tokenizer_path("word_bpe_49k.json"))


def test_bpe_rows_stay_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (None, "one two", "x"), (2, "é" * 300_000 + " end", "x"), (2, "one two", "x"), (2, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe_encode(docs, BYTES)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.text, r.decoded_sha256) for r in bpe_decode(encoded, BYTES).collect())
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text or "", hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_decode(bpe_encode(docs.limit(0), BYTES), BYTES).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [72, None, 99_999_999, 73]), (3, [])], "doc_id int, ids array<bigint>")
    assert {r.doc_id: (r.text, r.n_tokens) for r in bpe_decode(odd, BYTES).collect()} == {1: (None, None), 2: ("ij", 4), 3: ("", 0)}


def test_op12_on_the_smallest_tables(spark, library):
    from conftest import DATA

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op12_speculative_bpe"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("kind", [np.float64, object])
@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_nearest_keeps_the_lowest_of_equal_entries(kind, leaf):
    r = np.random.default_rng(5)
    for _ in range(20):
        entries = r.integers(-3, 3, (r.integers(1, 60), 3)).astype(kind)
        points = r.integers(-4, 4, (200, 3)).astype(kind)
        found, far = nearest(points, entries, grow(entries, leaf=leaf))
        want = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).astype(float)
        assert (found == want.argmin(axis=1)).all() and (far.astype(float) == want.min(axis=1)).all()


def plain_codes(rows, parts, entries, rounds, scale):
    """vec_id, label, components -> the same in loops."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, k) for _, _, v in first] for k in range(parts)]
    near = lambda v, k: min((sum((a - b) ** 2 for a, b in zip(cut(v, k), e, strict=True)), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        members = [[[] for _ in b] for b in books]
        for _, _, v in kept:
            for k in range(parts):
                members[k][near(v, k)[1]].append(cut(v, k))
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(members[k], books[k], strict=True)] for k in range(parts)]
    coded = [(i, label, "".join(f"{near(v, k)[1]:02x}" for k in range(parts)), sum(near(v, k)[0] for k in range(parts))) for i, label, v in kept]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), code, error, sum(x[3] for x in coded if x[1] == label), digest) for i, label, code, error in coded)


def got_codes(frame, **how):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in product_codes(frame, **how).collect())


SCHEMA = "vec_id long, label int, embedding array<double>, code string, whole int"


def test_vector_codes_equal_plain_code(spark, monkeypatch):
    r = random.Random(7)
    rows = [(r.randint(0, 200) if i % 9 else None, r.choice([1, 2, None]), [r.choice([-1, 1]) * r.choice([0.25, 0.5, 1.0, r.random()]) for _ in range(6)]) for i in range(300)]
    rows += [rows[5], rows[5], (3, 1, None), (3, 1, [None] * 6), (4, 1, [float("nan")] * 6), (4, 1, [float("-inf"), *[0.0] * 5])]
    frame = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA)
    how = {"parts": 3, "entries": 16, "rounds": 3, "scale": 8}
    want = plain_codes(rows, **how)
    assert got_codes(frame, **how) == want
    # Labels that are too many to be sent to all tasks.
    monkeypatch.setattr("quarryline.llm.vectorcodes.small_enough", lambda *a: False)
    assert got_codes(frame, **how) == want


def test_vector_codes_are_exact_with_large_numbers(spark):
    r = random.Random(8)
    rows = [(i, 0, [r.uniform(-1, 1) * 10.0 ** r.randint(0, 5) for _ in range(4)]) for i in range(80)]
    how = {"parts": 2, "entries": 9, "rounds": 2, "scale": 1024}
    assert got_codes(spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA), **how) == plain_codes(rows, **how)


def test_vector_codes_of_few_or_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert product_codes(empty).collect() == []
    assert product_codes(spark.createDataFrame([(1, 1, None, "c", 1), (2, 1, [], "c", 1)], SCHEMA)).collect() == []
    rows = [(1, None, [0.5, 1.0]), (2, None, [1.0, 2.0, 3.0]), (3, None, [0.0, 2.0])]
    got = product_codes(spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA), parts=2).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "0000", 0, 0), (3, "0101", 0, 0)]
    with pytest.raises(ValueError):
        product_codes(spark.createDataFrame([(1, 1, [1.0], "c", 1)], SCHEMA), parts=2)
