"""From raw documents to token ids: toxic documents go, one document of each
group of near duplicates stays, secrets are masked, the sources are mixed to
their target weights, and what is left is encoded.

Each stage takes the documents that its predecessor kept, whole rows, and
its result is written to the shared folder and read again as the next one's
input. Null texts pass the filters as empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, mixing, ngram_join, secrets, toxicity
from parlance.llm.common import Scratch, table

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of Jaccard 0.75 the smallest id stays."""
    return ngram_join.keep_one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets are masked and n_chars counted again."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the raked weights of their cells."""
    return mixing.sample_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text
    that they decode to."""
    import public_tokenizers

    found = bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    joined = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return found.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
                        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

# The network, the scan and the sampling have no SQL; tests hold the stages
# against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k > 1:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
