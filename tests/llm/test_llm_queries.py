"""The queries against their SQL, and the pipeline's stages against what its operators say."""

import random
import zlib

import pyarrow as pa
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from test_documents import deduplicated, linked_rows, plain_leaks, prose, toxic_rows, whole_viterbi

import corpus_pipeline
from quarryline.llm import toxicity, viterbi
from quarryline.llm.decontamination import leaks
from quarryline.llm.jaccard import near_duplicates
from quarryline.llm.queries import QUERIES, SQL, held_out, tokenizer_path


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


def test_toxicity_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op3_toxic_segments"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)


def odd_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.filter("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, "x " * 3000, "en", "s", 6000)], docs.schema)
    return some.unionByName(odd).unionByName(some.filter("doc_id = 5"))


def test_stages(spark):
    docs = odd_documents(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert out.count() == docs.count() and out.filter("size(ids) <> n_tokens").isEmpty()
            break
        assert sorted(out.columns) == sorted(columns)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic").filter(~held_out()))
            assert ids == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
        if name == "line_dedup":
            assert ids == before and out.count() == docs.count()
        if name == "jaccard_join":
            found = near_duplicates(docs).collect()
            assert ids == {r.class_id for r in found}
            assert out.count() == len({r.class_id for r in found})
        if name == "decontamination":
            gone = {r.doc_id for r in leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert ids == before - gone
        docs = out.select(columns).cache()


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_rows_of_null_and_repeated_ids_stay_or_go_by_themselves(spark, tmp_path):
    """Each stage on rows without an id, and on different texts under one id, against plain code."""
    rng = random.Random(17)
    body = [prose(rng, 60, 4000) for _ in range(8)]
    item = prose(rng, 30, 4000)
    shared = "a line that comes again and again"
    rows = [(1, body[0]), (None, body[0]), (None, body[1]), (3, body[2]), (5, body[2]), (5, body[3]), (7, body[3]), (7, body[4] + " " + item), (7, body[5]), (None, body[6] + " " + item), (None, body[7]), (9, None), (None, ""), (9, " ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row long, row string, key int"
    frame = lambda some: spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, "r", 2) for k, (i, t) in enumerate(some)], schema)
    stages = dict(corpus_pipeline.STAGES)

    near = stages["jaccard_join"](spark, frame(rows), DATA)
    assert near.columns == frame(rows).columns
    # One row of each group of linked texts, that of the least id, null last.
    want = [(1, body[0]), (None, body[1]), (3, body[2]), (5, body[3]), (7, rows[7][1]), (7, body[5]), (None, rows[9][1]), (None, body[7])]
    got = rows_of(near)
    assert [r for r in got if (r[1] or "").strip()] == sorted(want, key=str)
    assert [r[0] for r in got if not (r[1] or "").strip()] == [9]

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = stages["decontamination"](spark, frame(rows), str(tmp_path))
    assert rows_of(clean) == sorted([r for r in rows if item not in (r[1] or "")], key=str)

    lines = [(i, f"{t}\n{shared}" if t else t) for i, t in rows]
    done = stages["line_dedup"](spark, frame(lines), DATA)
    assert done.columns == frame(rows).columns
    assert rows_of(done) == sorted([(i, t) for i, t, _, _ in deduplicated(lines, 10, False)], key=str)
    assert all(r.n_chars == len(r.text) for r in done.collect())

    ids = stages["sentencepiece"](spark, frame(rows), DATA).collect()
    model = viterbi.load(tokenizer_path("piece_bpe_32k.model"))
    plain = [(i, [x for u in (t or "").split(" ") for x in whole_viterbi(model, "\u2581" + u)]) for i, t in rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in ids), key=str) == sorted(plain, key=str)


def test_toxic_rows_go_by_themselves(spark, tmp_path):
    rows = toxic_rows(random.Random(5))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = [(i, t) for i, t, _ in rows] + [(None, t) for _, t, _ in rows[:40]] + [(1, t) for _, t, _ in rows[40:80]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    model = toxicity.fit(df, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~held_out()))
    score = {k: r.score for k, r in enumerate(toxicity.score(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string"), model).orderBy("doc_id").collect())}
    assert rows_of(kept) == sorted([d for k, d in enumerate(docs) if score[k] < 0.5], key=str)
    assert 0 < kept.filter("doc_id is null").count() < 40


def test_pipeline_against_plain_code(spark, tmp_path):
    """All stages in a row over documents whose groups are known, against each method in plain code."""
    rng = random.Random(23)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(70).collect()
    columns = docs[0].asDict().keys()
    rows = [tuple(r) for r in docs]
    line = "every document has this line"
    rows = [(i, t + f"\n{line}" if k % 3 == 0 else t, lang, source, len(t)) for k, (i, t, lang, source, _) in enumerate(rows)]
    rows += [(900 + k, r[1], *r[2:]) for k, r in enumerate(rows[:5])] + [(None, rows[6][1], "en", "s", 1), (None, None, None, None, None)]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(8).collect()
    rows.append((990, prose(rng, 20) + " " + items[0].text, "en", "s", 9))
    for name in ("labels", "benchmark"):
        frame = spark.createDataFrame(items) if name == "benchmark" else spark.read.parquet(f"{DATA}/labels.parquet")
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    whole = spark.createDataFrame(rows, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    assert list(columns) == whole.columns
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    model = toxicity.fit(whole, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~held_out()))
    scan = toxicity.Scanner(model)
    left = []
    for i, t in [(r[0], r[1]) for r in rows]:
        (n, found), = scan(pa.array([t or ""], pa.large_string()))
        if model.probability(toxicity.evidence(found, n, model.scale)[0]) < 0.5:
            left.append((i, t))
    left = [(i, t) for i, t, _, _ in deduplicated(left, 10, False)]
    groups = {}
    for k, (_, group, _) in enumerate(linked_rows(left)):
        groups.setdefault(group, []).append(left[k])
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    bad = plain_leaks([(k, t) for k, (_, t) in enumerate(left)], [(r.item_id, r.text) for r in items])
    left = [r for k, r in enumerate(left) if k not in {d for d, _ in bad}]
    pieces = viterbi.load(tokenizer_path("piece_bpe_32k.model"))
    assert got == sorted([(i, [x for u in t.split(" ") for x in whole_viterbi(pieces, "\u2581" + u)]) for i, t in left], key=str)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).collect() == []


def test_run_ends_in_ids(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert out.count() > 0
