"""Base pipeline (entry 1 of the reference, "A"): one corpus.

    corpus -> vocabulary report (G1, G2, U2) -> fold vowels (T1)
           -> speaker counts, summary, histogram (G3-G5)
           -> keep speakers with 100..400 rows (F6/J1) -> summary (G6)
           -> encode characters (T13) -> fewer than 300 tokens (F7)
           -> split, 10 % test, seed drawn and recorded (R1)
           -> padded batches, labels cut for reduction factor 2 (K1, K2)

Model loading, spectrograms, speaker-embedding inference and training are
not built; labels are whatever frame column the caller supplies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import token_len_below
from ..functions.text import fold_vowels
from ..operators import batches as KB
from ..operators import encode as EN
from ..operators import speakers as SP
from ..operators import split as SPL
from ..session import stable

SPEAKER_MIN, SPEAKER_MAX = 100, 400
MAX_TOKENS = 300
TEST_FRACTION = 0.1
REDUCTION = 2


@dataclass
class BaseResult:
    vocab_sizes: DataFrame
    missing_chars: DataFrame
    speaker_counts: DataFrame
    speaker_summary: DataFrame
    histogram: DataFrame
    kept_summary: DataFrame
    batches: DataFrame | None
    seed: int


def run(corpus: DataFrame, reference_vocab: DataFrame, key: str, labels: Column | None = None,
        seed: int | None = None, batch_size: int = 8, speaker_min: int = SPEAKER_MIN,
        speaker_max: int = SPEAKER_MAX, with_batches: bool = True) -> BaseResult:
    """``corpus`` has text, speaker_id, ``key`` (unique) and source_no/pos;
    ``reference_vocab`` is a one-column ``ch`` table; ``labels`` builds
    label frames from the encoded row (``input_ids``)."""
    vocab = SP.char_vocab(corpus)
    sizes = SP.vocab_sizes(vocab, reference_vocab)
    missing = SP.missing_chars(vocab, reference_vocab)

    folded = corpus.withColumn("text", fold_vowels("text"))
    counts = SP.speaker_counts(folded)
    summary = SP.speaker_summary(counts)
    hist = SP.count_histogram(counts, 20)
    # stage boundary (the reference caches the band-filtered set): later
    # steps read the checkpoint instead of re-running fold + band
    kept = stable(SP.speaker_band(folded, speaker_min, speaker_max))
    kept_summary = SP.band_summary(kept)

    ids = EN.vocab_ids(reference_vocab)
    enc = EN.encode_chars(kept, "text", ids).where(token_len_below("input_ids", MAX_TOKENS))
    if labels is not None:
        enc = enc.withColumn("labels", labels)
    marked, seed = SPL.assign_split(enc, TEST_FRACTION, key, seed)
    if not with_batches:
        return BaseResult(sizes, missing, counts, summary, hist, kept_summary, None, seed)
    cols = [key, "speaker_id", "input_ids"] + (["labels"] if labels is not None else [])
    sided = marked.select(*cols, F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train")).alias("split"))
    batches = KB.pad_batches(sided, batch_size, [key], labels_col="labels" if labels is not None else None,
                             reduction=REDUCTION, groups=["split"])
    return BaseResult(sizes, missing, counts, summary, hist, kept_summary, batches, seed)
