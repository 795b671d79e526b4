"""Operator 3, quality rules as weak supervision.

Each rule votes good or bad on a document, or abstains. How often a rule is
right when it votes is estimated from the votes alone by
expectation-maximisation, and the posterior probability of good takes the
place of "all rules must pass".

Native: DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ABSTAIN, GOOD, BAD = 0, 1, 2
MIN_WORDS = 50
MAX_ROUNDS, TOLERANCE = 40, 1e-6
# A rule starts with this accuracy and this many votes that bear it out, and
# is never held to be worse than chance or beyond doubt.
FIRST_ACCURACY, FIRST_VOTES, LEAST, MOST = 0.9, 10.0, 0.55, 0.99

# A long array is named by a lambda over a one-element array, so that it is
# made once and not again for each element of an inner lambda.
_REPEATS = """
transform(array(
  transform(if(size(w) >= 3, sequence(0, size(w) - 3), cast(array() as array<int>)),
            i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | i)),
  k -> transform(array(sort_array(k)),
    s -> size(array_distinct(flatten(transform(
      filter(if(size(s) >= 2, sequence(1, size(s) - 1), cast(array() as array<int>)),
             j -> shiftrightunsigned(s[j], bits) = shiftrightunsigned(s[j - 1], bits)),
      j -> transform(array(s[j - 1] & mask, s[j] & mask, (s[j - 1] & mask) + 1, (s[j] & mask) + 1,
                           (s[j - 1] & mask) + 2, (s[j] & mask) + 2), p -> cast(p as int))))))
  )[0])[0]"""

_STATS = rf"""
transform(array(array_remove(split(_text, '[\\x20\\x09-\\x0D]+'), '')), w ->
  transform(array(cast(ceil(log2(size(w) + 2)) as int)), bits ->
    transform(array(shiftleft(1L, bits) - 1), mask ->
      struct(cast(size(w) as bigint) as n_words,
             aggregate(w, 0L, (total, x) -> total + char_length(x)) as word_chars,
             cast({_REPEATS} as bigint) as n_repeat_words,
             cast(size(array_distinct(w)) as bigint) as n_distinct_words)
    )[0])[0])[0]"""

_LINES = r"""
transform(array(filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), x ->
  struct(cast(size(x) as bigint) as n_lines,
         cast(size(x) - size(array_distinct(x)) as bigint) as n_dup_lines))[0]"""


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the rules look at, for each row. n_repeat_words counts the words
    that lie in a window of three found at least twice: the windows' hashes
    are sorted with their places in the low bits, and neighbours with the
    same hash bits (over 44 of them for any text under a million words) give
    the places. The work is in proportion to n log n for a text of n words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select(
        "_id", F.expr(_STATS).alias("_stats"), F.expr(_LINES).alias("_lines"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_shouts"),
    ).select("_id", "_stats.*", "_lines.*", "n_symbols", "n_capitals", "n_shouts")


def rules() -> dict[str, Column]:
    """Votes by rule. The absence of one fault is no sign of quality, so a
    rule that looks for a fault votes bad or abstains; the last looks for
    prose, moderate in all but its lines, and votes good or abstains. A text
    without words gets no votes."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    symbols, capitals = share("n_symbols", "n_words"), share("n_capitals", "word_chars")
    shouts, repeats = share("n_shouts", "n_words"), share("n_repeat_words", "n_words")
    lines, length = share("n_dup_lines", "n_lines"), share("word_chars", "n_words")
    variety = share("n_distinct_words", "n_words")
    prose = ((symbols < 0.02) & (capitals < 0.1) & (shouts < 0.02) & (repeats < 0.1) & (variety > 0.2)
             & length.between(3.5, 12))
    fault = {"symbols": symbols > 0.1, "capitals": capitals > 0.3, "shouts": shouts > 0.2, "repeats": repeats > 0.3,
             "lines": lines > 0.5, "length": ~length.between(2.5, 15), "variety": variety < 0.15}
    return ({k: F.when(v, BAD).otherwise(ABSTAIN) for k, v in fault.items()}
            | {"prose": F.when(prose, GOOD).otherwise(ABSTAIN)})


def posterior(accuracy: dict[str, float]) -> Column:
    """Probability of good from the votes that were cast, at even odds
    before them."""
    logit = F.lit(0.0)
    for name, a in accuracy.items():
        weight = math.log(a / (1 - a))
        logit = logit + F.when(F.col(name) == GOOD, weight).when(F.col(name) == BAD, -weight).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def estimate(votes: DataFrame, names: list[str]) -> dict[str, float]:
    """Accuracy of every rule: how probable its votes are under the
    posterior that all rules make together, in rounds until nothing moves.
    The documents are first counted by their votes, which leaves at most
    2**rules rows, and each round is one aggregate over those. A rule that
    never votes keeps its first accuracy, as all do without rows."""
    patterns = votes.groupBy(*names).agg(F.count("*").alias("_n")).coalesce(1).persist()
    accuracy = dict.fromkeys(names, FIRST_ACCURACY)
    try:
        for _ in range(MAX_ROUNDS):
            row = patterns.withColumn("_good", posterior(accuracy)).agg(*[
                x for name in names for x in (
                    F.sum(F.when(F.col(name) != ABSTAIN, F.col("_n"))).alias(f"{name}_n"),
                    F.sum(F.when(F.col(name) == GOOD, F.col("_n") * F.col("_good"))
                           .when(F.col(name) == BAD, F.col("_n") * (1 - F.col("_good")))).alias(f"{name}_right"))
            ]).first()
            now = {}
            for name in names:
                right = (row[f"{name}_right"] or 0.0) + FIRST_VOTES * FIRST_ACCURACY
                now[name] = min(MOST, max(LEAST, right / ((row[f"{name}_n"] or 0) + FIRST_VOTES)))
            moved = max(abs(now[name] - accuracy[name]) for name in names)
            accuracy = now
            if moved < TOLERANCE:
                break
        return accuracy
    finally:
        patterns.unpersist()


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the counts, base_failed,
    quality (posterior of good), one vote column per rule, and kept.

    A null text has no words, fails the base test and is not kept. Repeated
    rows and null ids come back as they are and count in the estimate as
    often as they occur; an empty table gives no rows; other columns are not
    read."""
    scratch = Scratch(docs.sparkSession, "quality")
    voted = rules()
    names = [f"vote_{name}" for name in voted]
    stats = measured(docs, id_col, text_col).withColumns({f"vote_{k}": v.cast("int") for k, v in voted.items()})
    stats = scratch.write(stats, "stats")
    accuracy = estimate(stats, names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("quality", posterior(accuracy)).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", *names)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
