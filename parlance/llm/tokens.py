"""Operator 1, token counts through a digest cache.

A count depends only on the normalised text and the tokenizer, so it is
stored under (digest of the one, digest of the other). A run joins its
documents with the stored counts, encodes each distinct text that has none,
appends those, and reads all counts from the cache."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Scratch, table

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"
# Bytes of text that a Python worker splits into words at a time; it only
# bounds memory.
SLICE_BYTES = 1 << 20


def canonical(text: Column) -> Column:
    """A text with the same tokens, shared by as many texts as can be shown
    safe: white space runs become one space, and a text of ASCII only is
    lower-cased (the tokenizer's own normaliser does both). A text with
    ``<|`` may hold a special token, which is matched before normalising;
    it is kept as it is, and no other text can equal it."""
    text = F.coalesce(text, F.lit(""))
    collapsed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return (F.when(text.contains("<|"), text)
             .when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(collapsed))
             .otherwise(collapsed))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Memo:
    """Results by word, in two generations: when the young one is full it
    becomes the old one, and old results in use move up. Words that keep
    coming stay, and at most twice ``limit`` plus one slice's words are held.
    Words over ``LONG_WORD`` bytes or letters go with the next slice, so that
    the memory is bounded whatever the texts hold."""

    LONG_WORD = 64

    def __init__(self, limit: int = 150_000):
        self.limit, self.young, self.old, self.long = limit, {}, {}, []

    def missing(self, words: set) -> set:
        """The words without a result; all others are in ``young`` after."""
        for w in self.long:
            self.young.pop(w, None)
        if len(self.young) + len(words) > self.limit:
            self.old, self.young = self.young, {}
        new = words.difference(self.young)
        held = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in held)
        self.long = [w for w in new if len(w) > self.LONG_WORD]
        return new - held


class WordCounter:
    """Token counts of texts by the library, word by word: this tokenizer
    never joins characters across ASCII white space, so a text's count is
    the sum over its words, and each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo()

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.memo.young.update(zip(part, map(len, found)))

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # bytes split on ASCII white space only
        self.learn(list(self.memo.missing(set().union(*split))))
        count = self.memo.young.__getitem__
        return [sum(map(count, words)) for words in split]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Lists of the column's texts as bytes (null: empty), each of about
    ``limit`` bytes or of one longer text."""
    part, held = [], 0
    for i in range(len(column)):
        text = column[i].as_buffer()
        text = b"" if text is None else text.to_pybytes()
        part.append(text)
        held += len(text)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


_counters: dict[str, WordCounter] = {}


def count_column(path: str):
    @F.arrow_udf(LongType())
    def n_tokens(column: pa.Array) -> pa.Array:
        if path not in _counters:
            _counters[path] = WordCounter(path)
        out: list[int] = []
        for part in byte_slices(column):
            out += _counters[path].counts(part)
        return pa.array(out, pa.int64())
    return n_tokens


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row (``id_col``, n_bytes, n_tokens) per row of ``docs``.

    ``cache_path`` is a folder in a shared store, made when missing; one
    writer at a time, since a text is appended only if it is not there. A
    null text counts as empty (0 bytes, 0 tokens). Repeated rows and null
    ids come back as they are; other columns are not read."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        # A text that two writers added at once, or a writer that was run
        # again, is there more than once.
        return cache.where(F.col("tokenizer") == version).groupBy(F.col("content").alias("_key")) \
            .agg(F.max("n_tokens").alias("n_tokens"))

    text = F.col(text_col)
    key = F.unhex(F.sha2(canonical(text), 256)).alias("_key")
    # Each distinct text once: combined before the shuffle, so a text that a
    # third of the rows share arrives once per task.
    distinct = docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).dropDuplicates(["_key"])
    misses = distinct.join(stored().select("_key"), "_key", "left_anti")
    misses.select(F.col("_key").alias("content"), F.lit(version).alias("tokenizer"),
                  count_column(tokenizer_path)("_text").alias("n_tokens")) \
        .write.mode("append").parquet(cache_path)
    keyed = docs.select(F.col(id_col).alias("_id"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), key)
    return keyed.join(stored(), "_key", "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")


def op1(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """The cache is a new one unless its path is given, so that a run shows
    the work of all misses."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                           cache_path or Scratch(spark, "token-counts").path("cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
