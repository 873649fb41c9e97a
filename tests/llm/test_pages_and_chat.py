"""WARC shards and tool links."""

import base64
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import chat, warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ é", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "u", "long" * 50_000), (2, "http://b/ é", "<p>x</p>"), (2, "http://0/", "<p>x</p>"), (None, "n", "<p>x</p>")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("sha1", F.lit(1))
    got = warc.warc_round_trip(df, roll=200).collect()
    assert len(got) == len(PAGES)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, _, html in PAGES:
        assert {(r.payload_bytes, r.payload_digest) for r in by[page]} == {(len((html or "").encode()), digest(html))}
    kinds = {p: sorted((r.record_type, r.refers_to) for r in v) for p, v in by.items()}
    assert kinds[1] == kinds[None] == [("revisit", 2)]
    assert [k for k, _ in kinds[2]] == ["response", "revisit", "revisit"]
    assert kinds[3] == [("revisit", 4)] and kinds[4] == [("response", None)] and kinds[5] == [("response", None)]
    short = warc.warc_round_trip(df, min_bytes=100).collect()
    assert {r.record_type for r in short} == {"response"}
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_warc_files_are_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifests = [warc.write_warc(df.repartition(n), f"file://{tmp_path}/{n}", roll=200) for n in (1, 3)]
    files = [sorted(p.read_bytes() for p in (tmp_path / str(n)).glob("*.gz")) for n in (1, 3)]
    assert b"".join(gzip.decompress(f) for f in files[0]) and sorted(f["sha256"] for f in manifests[0]) == sorted(hashlib.sha256(f).hexdigest() for f in files[0])
    again = warc.write_warc(df, f"file://{tmp_path}/again", roll=200)
    assert [f["sha256"] for f in again] == [f["sha256"] for f in manifests[0]]
    assert not list(tmp_path.rglob(".*.tmp"))


FUNCTIONS = "name string, parameters array<struct<name:string,type:string,required:boolean>>"
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"


def test_tool_links(spark):
    functions = spark.createDataFrame([("add", [("a", "integer", True), ("b", "number", False), ("o", "object", False)]), ("any", [])], FUNCTIONS)
    calls = [
        (1, 1, "x", "add", '{"b": 1.50, "a": 2, "o": {"z": [1, 2], "y": null}}', None),
        (1, 5, "y", "add", '{"a": "two", "c": 1}', ["x", "late"]),
        (1, 9, "late", "any", "{}", ["unknown", None]),
        (1, 3, "n", "none", "{}", []),
        (1, 4, "j", "any", "[1", None),
        (2, 1, "x", "any", "{}", ["z"]),
        (2, 2, "z", "any", "{}", ["x"]),
        (None, 1, None, "any", "{}", None),
        (1, 7, "x", "add", "{}", None),
    ]
    results = [(1, 2, "x", "é\n"), (1, 8, "x", "second"), (1, 6, "y", None), (3, 1, "q", "alone"), (None, 2, None, "found")]
    got = chat.link_calls(spark.createDataFrame(calls, CALLS).withColumn("rank", F.lit(3)), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), functions).collect()
    more = [r for r in got if r.status == "duplicate"]
    assert sorted((r.conv_id, r.call_id, r.call_turn, r.result_turn, r.rank, json.loads(r.record)["content"]) for r in more if r.call_turn is None) == [(1, "x", None, 8, None, "second")]
    assert [(r.conv_id, r.call_id, r.call_turn, r.result_turn) for r in more if r.call_turn] == [(1, "x", 7, None)]
    by = {(r.conv_id, r.call_id): r for r in got if r.status != "duplicate"}
    assert len(by) == len(got) - 2 == 9
    assert by[1, "x"].status == "ok" and by[1, "x"].result_turn == 2
    assert by[1, "x"].record == '{"arguments":{"a":2,"b":1.5,"o":{"y":null,"z":[1,2]}},"content":"é\\n","id":"x","name":"add"}'
    assert (by[1, "y"].status, by[1, "y"].problems) == ("invalid", "type:a,unknown:c")
    assert by[1, "y"].rank > by[1, "late"].rank >= 9
    assert by[1, "late"].status == "unanswered"
    assert by[1, "n"].problems == "function" and by[1, "j"].problems == "json"
    assert by[2, "x"].status == by[2, "z"].status == "circular"
    assert by[3, "q"].status == "orphan"
    assert (by[None, None].status, by[None, None].result_turn) == ("ok", 2)
    assert all(json.loads(r.record) for r in got)
    empty = chat.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), functions)
    assert empty.collect() == []


def test_repeated_calls_and_results_are_all_kept(spark):
    functions = spark.createDataFrame([("any", [])], FUNCTIONS)
    calls = [(1, 1, "x", "any", "{}", None)] * 3 + [(None, None, None, None, None, None)] * 4 + [(1, 2, "x", "any", "{}", None)]
    results = [(1, 3, "x", "a")] * 2 + [(None, None, None, None)] * 3 + [(5, 1, "lone", "b")] * 2
    got = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), functions).collect()
    assert len(got) == len(calls) + len(results) - 2
    assert sorted((str(r.conv_id), r.status) for r in got if r.status != "duplicate") == [("1", "ok"), ("5", "orphan"), ("None", "invalid")]


def test_order_of_calls_is_that_of_plain_code(spark):
    rng = random.Random(11)
    calls = []
    for conv in range(40):
        n = rng.randrange(1, 12)
        turns = list(range(n)) if conv % 3 else [rng.randrange(6) for _ in range(n)]
        for i in range(n):
            on = [f"c{rng.randrange(n + 1)}" for _ in range(rng.randrange(3))] if conv % 3 != 1 else ([f"c{i - 1}"] if i else [])
            calls.append((conv, turns[i], f"c{i}", "any", "{}", on))
    want = {}
    for conv in range(40):
        own = {c[2]: (c[1], set(c[5])) for c in calls if c[0] == conv}
        ranks = {}
        while True:
            ready = {k: max([t, *(ranks[d] + 1 for d in on if d in own)]) for k, (t, on) in own.items() if k not in ranks and all(d in ranks for d in on if d in own)}
            if not ready:
                break
            ranks |= ready
        want |= {(conv, k): ranks.get(k) for k in own}
    got = chat.ranked(spark.createDataFrame(calls, CALLS))
    assert {(r.conv_id, r.call_id): r.rank for r in got.collect()} == want


def test_many_circles_take_few_rounds(spark, monkeypatch):
    calls = [(i, 1, "a", "any", "{}", ["a"]) for i in range(1000)] + [(i, k, f"b{k}", "any", "{}", [f"b{(k + 1) % 5}"]) for i in range(200) for k in range(5)]
    tables = []
    monkeypatch.setattr(chat, "stored", lambda df, label: tables.append(label) or df.cache())
    got = chat.ranked(spark.createDataFrame(calls, CALLS)).collect()
    assert len(got) == len(calls) and all(r.rank is None for r in got)
    assert len(tables) <= 8


def written(monkeypatch):
    tables = []
    real = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, label: tables.append(label) or real(df, label))
    return tables


def test_calls_without_an_identifier_end_the_order_too(spark, monkeypatch):
    tables = written(monkeypatch)
    calls = [(1, 1, "a", "any", "{}", ["b"]), (1, 2, "b", "any", "{}", []), (1, 3, None, "any", "{}", ["a"]), (None, 4, "a", "any", "{}", ["b"]), (1, None, "n", "any", "{}", ["a"])]
    got = {(r.conv_id, r.call_id): r.rank for r in chat.ranked(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 2, (1, None): 3, (None, "a"): 4, (1, "n"): 4}
    results = spark.createDataFrame([(1, 9, None, "x")], "conv_id long, turn long, call_id string, content string")
    linked = chat.link_calls(spark.createDataFrame(calls, CALLS), results, spark.createDataFrame([("any", [])], FUNCTIONS)).collect()
    assert len(linked) == 5 and {r.call_id: r.result_turn for r in linked if r.conv_id == 1}[None] == 9
    assert len(tables) < 30


@pytest.mark.parametrize("behind", [1, 2])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, behind):
    tables = written(monkeypatch)
    n = 2000
    calls = [(1, i, f"c{i}", "any", "{}", [f"c{i - k}" for k in range(1, behind + 1)] if i else ["late"]) for i in range(n)] + [(1, 10 * n, "late", "any", "{}", None)]
    got = {r.call_id: r.rank for r in chat.ranked(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {"late": 10 * n} | {f"c{i}": 10 * n + 1 + i for i in range(n)}
    assert len(tables) < 30
