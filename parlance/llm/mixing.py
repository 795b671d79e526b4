"""Operator 10, mixing sources to target weights.

The tokens of each (source, language, topic) cell are raked by iterative
proportional fitting: scaled to the source targets, then to the language
targets, then to the topic targets, and again. A cell's weight over its
tokens is how much more or less of it is wanted; documents are sampled with
probabilities in that proportion, calibrated to a budget of tokens.

Native: DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

ROUNDS, CAP_ROUNDS = 12, 8
# Rounds that are planned at a time before the cells are written.
ROUNDS_AT_A_TIME = 2
# Exponents that temper the shares of each margin into its targets.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET, SEED = 0.7, 11
# With more cells than this the documents meet them by a shuffled join.
BROADCAST_CELLS = 50_000


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text; the first that fits."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.contains("Licensed under"), "licence")
             .when(text.contains(" | "), "table")
             .when(text.contains("@"), "contact")
             .when(text.contains("!!"), "shout")
             .otherwise("prose"))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that a document keeps whatever the layout: the
    first 52 bits of a digest of seed and id (null: as empty)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def with_targets(cells: DataFrame, temper: dict[str, float], targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with the target share of every margin's value: given as
    (value, share), where values that are missing are unwanted, or else the
    value's share of tokens to the power ``temper``; made to sum to one over
    the values that occur."""
    given = cells
    for margin, power in temper.items():
        of_value = given.groupBy(F.col(margin).alias("_value")).agg(F.sum("tokens").alias("_tokens"))
        if margin in targets:
            wanted = targets[margin].select(F.col("value").alias("_v"), F.col("share").alias("_share"))
            of_value = of_value.join(wanted, F.col("_value").eqNullSafe(F.col("_v")), "left").drop("_v") \
                .withColumn("_share", F.when(F.col("_tokens") > 0, F.coalesce("_share", F.lit(0.0))).otherwise(0.0))
        else:
            of_value = of_value.withColumn("_share", F.pow(F.col("_tokens").cast("double"), F.lit(power)))
        # One row: the sum over the margin's values.
        of_all = of_value.agg(F.sum("_share").alias("_all"))
        of_value = of_value.crossJoin(F.broadcast(of_all)).select(
            F.col("_value"), F.when(F.col("_all") > 0, F.col("_share") / F.col("_all")).otherwise(0.0)
            .alias(f"_to_{margin}"))
        cells = cells.join(of_value, cells[margin].eqNullSafe(of_value["_value"])).drop("_value")
    return cells


def raked(scratch: Scratch, cells: DataFrame, margins: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Column ``raked``: the cells' tokens scaled to every margin in turn,
    ``rounds`` times. The cells are one row for each combination that occurs,
    summed up before, so their number does not follow the documents'."""
    cells = cells.withColumn("raked", F.col("tokens").cast("double"))
    for at in range(rounds):
        for margin in margins:
            total = F.sum("raked").over(Window.partitionBy(margin))
            cells = cells.withColumn("raked", F.when(
                total > 0, F.col("raked") * F.col(f"_to_{margin}") / total).otherwise(0.0))
        if at % ROUNDS_AT_A_TIME == ROUNDS_AT_A_TIME - 1 or at == rounds - 1:
            cells = scratch.write(cells, f"raked-{at}")
    return cells


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """Columns ``weight`` (raked share over the cell's share of tokens) and
    ``probability``: the weight times one factor, at most 1, so that the
    expected tokens are ``budget`` of all. Cells that would pass 1 are fixed
    there and the factor is found again for the rest; each round is one
    aggregate."""
    total = cells.agg(F.sum("tokens").alias("t"), F.sum("raked").alias("r")).first()
    tokens, mass = float(total["t"] or 0), float(total["r"] or 0)
    if tokens <= 0 or mass <= 0:
        return cells.withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0)})
    own = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    cells = cells.withColumn("_ratio", own)
    factor = budget * tokens / mass
    for _ in range(CAP_ROUNDS):
        row = cells.agg(F.sum(F.when(F.col("_ratio") * factor >= 1, F.col("tokens"))).alias("fixed"),
                        F.sum(F.when(F.col("_ratio") * factor < 1, F.col("raked"))).alias("free")).first()
        fixed, free = float(row["fixed"] or 0), float(row["free"] or 0)
        if free <= 0:
            break
        factor = max(factor, (budget * tokens - fixed) / free)
    return cells.withColumns({"weight": F.col("_ratio") * (tokens / mass),
                              "probability": F.least(F.lit(1.0), F.col("_ratio") * factor)}).drop("_ratio")


def cell_probabilities(scratch: Scratch, weighed: DataFrame, budget: float = BUDGET,
                       temper: dict[str, float] | None = None,
                       targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, weight, probability) from rows (source, lang,
    topic, n_tokens)."""
    temper = temper or TEMPER
    cells = weighed.groupBy(*temper).agg(F.sum("n_tokens").alias("tokens"))
    cells = scratch.write(with_targets(scratch.write(cells, "cells"), temper, targets or {}), "targets")
    cells = raked(scratch, cells, list(temper))
    return scratch.write(calibrated(cells, budget).select(*temper, "weight", "probability"), "probabilities")


def meet(docs: DataFrame, cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """``docs`` with ``_weight`` and ``_probability`` of their cell; ``names``
    maps a margin to its column in ``docs``."""
    cells = cells.select(*[F.col(m).alias(f"_cell_{m}") for m in names],
                         F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    on = None
    for margin, column in names.items():
        same = docs[column].eqNullSafe(cells[f"_cell_{margin}"])
        on = same if on is None else on & same
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return docs.join(cells, on, "left").drop(*[f"_cell_{m}" for m in names])


def weigh(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          lang_col: str = "lang", budget: float = BUDGET, seed: int = SEED,
          targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row (``id_col``, source, lang, topic, n_tokens, weight,
    probability, selected) per row of ``docs``.

    A null source or language is a value of its own. A document without
    words adds nothing to its cell and is sampled like the cell; a cell
    without any words has weight and probability 0. Rows with the same id
    are sampled together; an empty table gives no rows; other columns are
    not read."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_col)
    weighed = scratch.write(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
        topic_of(text).alias("topic"), words_in(text).alias("n_tokens")), "weighed")
    cells = cell_probabilities(scratch, weighed, budget, targets=targets)
    return meet(weighed, cells, {m: m for m in TEMPER}).select(
        F.col("_id").alias(id_col), "source", "lang", "topic", "n_tokens", F.col("_weight").alias("weight"),
        F.col("_probability").alias("probability"),
        (uniform(F.col("_id"), seed) < F.col("_probability")).alias("selected"))


def sample_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     lang_col: str = "lang", budget: float = BUDGET, seed: int = SEED,
                     targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The selected rows of ``docs``, all columns, as ``weigh`` has them."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_col)
    weighed = docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
                          topic_of(text).alias("topic"), words_in(text).alias("n_tokens"))
    cells = cell_probabilities(scratch, weighed, budget, targets=targets)
    # The row as one value, so that no column of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"), topic_of(text).alias("topic"))
    kept = meet(rows, cells, {m: m for m in TEMPER})
    return kept.where(uniform(F.col("id"), seed) < F.col("_probability")).select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and probabilities are rounded: sums of doubles differ in the
    last bits with the order they are added in."""
    found = weigh(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})
