"""Byte shards, source mixing and chat formatting."""

import json
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import chat, mixing, sharding


# -- sharding -------------------------------------------------------------------

def check_shards(frame, n):
    rows = sharding.shard_by_bytes(frame, n).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                   for r in frame.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        target, largest = sum(sizes.values()) / n, max(r["size"] for r in rows)
        assert all(abs(sizes[k] - target) <= largest for k in range(n) if sizes[k] or largest < target)
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in ordered]
    assert ids == sorted(ids)  # contiguous


def test_shards(documents, odd, empty):
    check_shards(documents, 24)
    check_shards(documents, 1)
    check_shards(odd, 3)
    check_shards(empty, 24)


def test_one_repeated_row(spark):
    frame = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    check_shards(frame, 5)


def test_written_shards(documents, spark, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("_shard").count().count() == 4
    assert sorted(back.drop("_shard").select(documents.columns).collect(), key=str) == sorted(documents.collect(), key=str)


def test_written_shards_of_repeated_and_null_ids(odd, spark, tmp_path):
    for k, frame in enumerate((odd, odd.withColumns({"_slot": F.lit(1), "_size": F.lit("x"), "_row": F.lit(2)}))):
        sharding.write_shards(frame, str(tmp_path / f"{k}"), 3)
        back = spark.read.parquet(str(tmp_path / f"{k}")).select(frame.columns)
        assert sorted(back.collect(), key=str) == sorted(frame.collect(), key=str)


# -- mixing -----------------------------------------------------------------------

def test_margins_are_met(spark, documents):
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.3), ("fr", 0.2), ("xx", 9.0)], "value string, share double")}
    rows = mixing.weigh(documents, budget=0.3, targets=targets).collect()
    n = sum(r["n_tokens"] for r in rows)
    expected = sum(r["n_tokens"] * r["probability"] for r in rows)
    assert abs(expected - 0.3 * n) < 1e-6 * n
    if max(r["probability"] for r in rows) < 1:
        by_lang = Counter()
        for r in rows:
            by_lang[r["lang"]] += r["n_tokens"] * r["probability"] / expected
        assert by_lang["es"] == 0
        assert abs(by_lang["en"] - 0.5) < 0.02 and abs(by_lang["de"] - 0.3) < 0.02
    assert all(r["probability"] == 0 for r in rows if r["lang"] == "es")


def test_sampling_takes_effect_and_repeats(documents):
    marked = mixing.weigh(documents).where("selected").select("doc_id").collect()
    kept = mixing.sample_documents(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in marked)


def test_shuffled_join_gives_the_same(documents, monkeypatch):
    want = sorted(mixing.sample_documents(documents).collect(), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", -1)
    assert sorted(mixing.sample_documents(documents).collect(), key=str) == want


def test_odd_mixing(odd, empty):
    rows = mixing.weigh(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["probability"] <= 1 and r["selected"] is not None for r in rows)
    assert mixing.weigh(empty).count() == 0
    assert mixing.sample_documents(odd).columns == odd.columns
    clash = odd.withColumn("weight", F.lit(1)).withColumn("probability", F.lit(2)).withColumn("topic", F.lit("t"))
    assert mixing.sample_documents(clash).columns == clash.columns


# -- chats ------------------------------------------------------------------------

SCHEMA = ("name string, param string, type string, required boolean, minimum double, maximum double")


@pytest.fixture
def schemas(spark):
    return spark.createDataFrame(chat.TOOL_ROWS, SCHEMA)


def formatted(spark, schemas, messages=(), calls=(), results=()):
    rows = chat.format_chats(
        spark.createDataFrame(list(messages), "conv_id long, turn long, role string, text string"),
        spark.createDataFrame(list(calls), "conv_id long, turn long, call_no int, call_id string, name string, arguments string"),
        spark.createDataFrame(list(results), "conv_id long, turn long, call_id string, content string"), schemas).collect()
    return sorted(rows, key=lambda r: (-1 if r["conv_id"] is None else r["conv_id"], r["seq"]))


def test_calls_are_linked_ordered_and_checked(spark, schemas):
    rows = formatted(
        spark, schemas, [(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", None), (1, 2, "user", "ok")],
        [(1, 1, 0, "b", "summarise", '{"text": "$a"}'), (1, 1, 1, "a", "search", '{"query":"x","limit": 5, "exact":true}')],
        [(1, 2, "b", "short"), (1, 2, "a", "long"), (1, 0, "c", "lost")])
    assert [(r["kind"], r["call_id"], r["problems"]) for r in rows] == [
        ("message", None, ""), ("result", "c", "orphan result"), ("message", None, ""), ("call", "a", ""), ("result", "a", ""),
        ("call", "b", ""), ("result", "b", ""), ("message", None, "")]
    assert [r["seq"] for r in rows] == list(range(8))
    assert rows[0]["json"] == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert rows[2]["json"] == '{"content":null,"role":"assistant"}'
    assert rows[3]["json"] == ('{"arguments":{"exact":true,"limit":5,"query":"x"},"id":"a","name":"search",'
                               '"type":"function"}')


@pytest.mark.parametrize("name,arguments,problems", [
    ("search", '{"query":"x","limit":0}', "range limit"), ("search", '{"query":"x","limit":"a"}', "type limit"),
    ("search", '{"limit":3}', "missing query"), ("search", '{"query":null,"limit":3}', "missing query"),
    ("search", '{"query":"x","limit":3,"more":1}', "unknown more"), ("nothing", '{}', "unknown tool"),
    ("search", "[1", "missing limit; missing query; not an object"), ("lookup", '{"query":""}', ""),
    ("search", '{"query":"x","limit":3,"exact":"perhaps"}', "type exact")])
def test_arguments(spark, schemas, name, arguments, problems):
    row = formatted(spark, schemas, calls=[(1, 1, 0, "a", name, arguments)], results=[(1, 1, "a", "r")])[0]
    assert row["problems"] == problems and row["valid"] == (not problems)
    json.loads(row["json"])


@pytest.mark.parametrize("arguments,canonical,problems", [
    ('{"opts":{"b":[1, 2],"a":null},"n":1.50,"query":"x","limit":2}',
     {"limit": 2, "n": 1.5, "opts": {"a": None, "b": [1, 2]}, "query": "x"}, "unknown n; unknown opts"),
    ('{"query":"x","limit":"2"}', {"limit": "2", "query": "x"}, "type limit"),
    ('{"query":5,"limit":2}', {"limit": 2, "query": 5}, "type query"),
    ('{"query":"a","query":"b","limit":2}', '{"query":"a","query":"b","limit":2}', "duplicate key"),
    ('{"query":"x","limit":2,"deep":{"a":1,"a":2}}', '{"query":"x","limit":2,"deep":{"a":1,"a":2}}', "duplicate key")])
def test_arguments_keep_their_types(spark, schemas, arguments, canonical, problems):
    row = formatted(spark, schemas, calls=[(1, 1, 0, "a", "search", arguments)], results=[(1, 1, "a", "r")])[0]
    assert row["problems"] == problems and json.loads(row["json"])["arguments"] == canonical
    if isinstance(canonical, dict):  # keys in order, no white space
        assert json.dumps(canonical, separators=(",", ":"), sort_keys=True) in row["json"]


def test_repeated_and_null_schema_rows(spark):
    rows = [*chat.TOOL_ROWS, *chat.TOOL_ROWS[:2], ("search", None, "string", True, None, None), (None, "x", "string", True, None, None),
            ("search", "limit", "integer", True, 1.0, 5000.0), ("search", "query", None, None, None, None)]
    schemas = spark.createDataFrame(rows, SCHEMA)
    row = formatted(spark, schemas, calls=[(1, 1, 0, "a", "search", '{"query":"x","limit":1000}')], results=[(1, 1, "a", "r")])[0]
    assert row["problems"] == "range limit"  # the least of the rows for limit


def test_cycles_duplicates_nulls_and_empty(spark, schemas):
    rows = formatted(spark, schemas, calls=[
        (1, 1, 0, "a", "summarise", '{"text":"$b"}'), (1, 1, 1, "b", "summarise", '{"text":"$a"}'),
        (1, 2, 0, "c", "summarise", '{"text":"x"}'), (1, 3, 0, "c", "summarise", '{"text":"y"}'),
        (1, 4, 0, None, None, None), (None, None, None, "d", "summarise", '{"text":"x"}')],
        results=[(1, 9, "c", "r"), (1, 10, "c", "s"), (1, 11, None, None)])
    problems = Counter(r["problems"] for r in rows)
    assert problems["cycle; unanswered"] == 2
    assert problems["duplicate"] == 2  # the second call and the second result of c
    assert len(rows) == 9 and all(json.loads(r["json"]) is not None for r in rows)
    assert formatted(spark, schemas) == []


def test_one_long_conversation(spark, schemas):
    messages = [(1, t, "user", f"m{t}") for t in range(3000)] + [(2, 0, "user", "x")] * 5
    rows = formatted(spark, schemas, messages)
    assert [r["seq"] for r in rows if r["conv_id"] == 1] == list(range(3000))
    assert [json.loads(r["json"])["content"] for r in rows[:3000]] == [f"m{t}" for t in range(3000)]
    assert [r["seq"] for r in rows if r["conv_id"] == 2] == list(range(5))
