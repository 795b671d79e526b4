"""Token counts and the BPE codec against the library itself."""

import hashlib
import os
import random

import pytest

from pyspark.sql import functions as F

from parlance.llm import bpe, tokens

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(3)
    parts = list("abcdeThe'sSt.!é ÉßΣςİıſ̱́ \u0085\x1c\x00\x0b\n\t123٣日本🙂<|>²½") + [
        "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'VE", "​", "　", " ", "ﬁ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)] + [
        "x" * 5000, "abcde" * 300 + " " + "é" * 500, "", "the " * 1000, "H̱ ẖ ẖ"]


def test_codec_equals_library_on_odd_texts(library):
    coder = bpe.WordBpe(PATH)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        packed = coder.encode([text.encode()])[0]
        got = [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)]
        assert got == want, repr(text)
        assert coder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_and_short_words_merge_alike():
    coder = bpe.WordBpe(PATH)
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choices("abcdehilnorst", k=rng.randint(1, 60))).encode()
        assert coder.merge_rows([word])[0] == coder.merge_long(word)


def test_word_counts_equal_library(library):
    counter = tokens.WordCounter(PATH)
    texts = odd_texts()
    assert counter.counts([t.encode() for t in texts]) == [
        len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_canonical_texts_have_the_same_tokens(spark, library):
    texts = odd_texts()
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", tokens.canonical(F.col("text")).alias("c"))
    for r in rows.collect():
        assert library.encode(r["text"], add_special_tokens=False).ids == library.encode(
            r["c"], add_special_tokens=False).ids, repr(r["text"])


def test_memo_keeps_words_in_use():
    memo = tokens.Memo(limit=10)
    for k in range(30):
        words = {b"often", b"w%d" % k}
        new = memo.missing(words)
        assert (b"often" in new) == (k == 0)
        memo.young.update((w, 1) for w in new)
    assert len(memo.young) + len(memo.old) <= 24


def test_cache_is_used_and_appended(spark, documents, library, tmp_path):
    path = str(tmp_path / "cache")
    first = tokens.count_tokens(documents, PATH, path).collect()
    entries = spark.read.parquet(path)
    n = entries.count()
    assert n == entries.select("content").distinct().count()
    again = tokens.count_tokens(documents, PATH, path).collect()
    assert spark.read.parquet(path).count() == n
    assert sorted(first) == sorted(again)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in first:
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_a_doubled_cache_row_counts_once(spark, documents, tmp_path):
    path = str(tmp_path / "cache")
    first = sorted(map(tuple, tokens.count_tokens(documents, PATH, path).collect()))
    spark.read.parquet(path).limit(50).write.mode("append").parquet(path)
    assert sorted(map(tuple, tokens.count_tokens(documents, PATH, path).collect())) == first


def test_long_words_are_not_remembered():
    memo = tokens.Memo(10)
    for k in range(50):
        words = {f"{k}" * 100, f"{k}"}
        new = memo.missing(words)
        memo.young.update((w, 1) for w in new)
        assert all(memo.young[w] == 1 for w in words)
        assert sum(len(w) > memo.LONG_WORD for w in (*memo.young, *memo.old)) <= 1


def test_odd_and_empty_tables(odd, empty, library, tmp_path):
    rows = tokens.count_tokens(odd, PATH, str(tmp_path / "c")).collect()
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert tokens.count_tokens(empty, PATH, str(tmp_path / "d")).count() == 0
    coded = bpe.digests(bpe.encode_documents(odd, PATH)).collect()
    assert len(coded) == odd.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["ids_sha256"] == r["decoded_sha256"] == nothing for r in coded if r["doc_id"] in (2, 3, 4))
    assert bpe.encode_documents(empty, PATH).count() == 0


def test_encode_and_decode_apart(documents):
    from pyspark.sql import functions as F

    both = bpe.encode_documents(documents, PATH)
    apart = documents.select("doc_id", bpe.bpe_encode(F.col("text"), PATH).alias("token_ids")).withColumn(
        "decoded", bpe.bpe_decode(F.col("token_ids"), PATH))
    assert sorted(both.collect(), key=str) == sorted(apart.collect(), key=str)
