"""Row predicates (F1-F4, F7, F8). Bounds are inclusive unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, special_count


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_len_between(c: Column | str, lo: int, hi: int) -> Column:
    """length in code points within ``lo..hi``."""
    return F.length(_c(c)).between(lo, hi)


def duration_between(c: Column | str, lo: float, hi: float) -> Column:
    """duration in seconds within ``lo..hi``."""
    return _c(c).between(lo, hi)


def not_blank(c: Column | str) -> Column:
    """text holds something other than white space (of any kind that
    Unicode knows)."""
    return _c(c).rlike(f"[^{WHITESPACE}]")


def special_at_most(c: Column | str, r: float = 0.3) -> Column:
    """special-character ratio at most ``r`` (rejects only ``> r``).
    Same double division as the reference, so 0.3 exactly passes."""
    n = F.length(_c(c))
    return (n > 0) & ~((special_count(c) / n) > F.lit(r))


def token_len_below(c: Column | str, n: int) -> Column:
    """fewer than ``n`` tokens (use ``n + 1`` for "at most n")."""
    return F.size(_c(c)) < n


def min_samples(c: Column | str, n: int) -> Column:
    """F8: a signal with at least ``n`` samples."""
    return F.size(_c(c)) >= n
