"""Character vocabulary ids and text encoding.

The reference hands text to a tokenizer whose vocabulary it treats as a
set of characters. Ours: a vocabulary table ``(ch, id)`` with ids in code
point order after the reserved ids, and unknown characters mapped to
``UNK_ID``. A character vocabulary is bounded by the Unicode range
(1,114,112 code points), so the table is collected once and looked up in a
dense array by code point, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reserved ids (our choice; the reference's tokenizer ids are not visible).
PAD_ID, UNK_ID, FIRST_ID = 0, 1, 2


def vocab_ids(vocab: DataFrame, ch_col: str = "ch") -> DataFrame:
    """(ch, id): ids from ``FIRST_ID`` in code-point order. The vocabulary
    is small (characters), so one ordered window over it is cheap."""
    w = Window.orderBy(F.col(ch_col))
    return vocab.select(F.col(ch_col).alias("ch")).distinct() \
        .withColumn("id", (F.row_number().over(w) + F.lit(FIRST_ID - 1)).cast("int"))


def chars(c: Column | str) -> Column:
    """Code points of a string as an array (empty for "" and null)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.coalesce(col, F.lit("")), ""), lambda s: s != F.lit(""))


def encode_chars(df: DataFrame, text_col: str, ids: DataFrame, out_col: str = "input_ids") -> DataFrame:
    """``out_col`` = id of every character of ``text_col``; empty for
    null text. ``ids`` has one row per character; an entry that is null or
    not one character matches nothing."""
    rows = ids.where(F.char_length("ch") == 1).select("ch", "id").collect()  # at most one per code point
    known = {ord(r["ch"]): int(r["id"]) for r in rows}
    dense = [UNK_ID] * (max(known, default=-1) + 1)
    for code, i in known.items():
        dense[code] = i
    if not dense:
        return df.withColumn(out_col, F.transform(chars(text_col), lambda ch: F.lit(UNK_ID)))
    # one string literal, split once by constant folding
    table = F.split(F.lit(",".join(map(str, dense))), ",").cast("array<int>")
    return df.withColumn(out_col, F.transform(chars(text_col), lambda ch: F.coalesce(
        F.try_element_at(table, F.ascii(ch) + 1), F.lit(UNK_ID))))
