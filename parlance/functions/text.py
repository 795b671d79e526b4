"""Transcript normalisation as Spark column expressions.

Everything here is a built-in JVM expression (``translate``,
``regexp_replace``, ``replace``), so it stays inside whole-stage codegen
and can be pushed below Python stages by Catalyst.

Regex classes are spelled out so that Spark (Java regex) and DuckDB (RE2)
agree with Python's Unicode ``\\w`` and ``\\s``:

* a word character is ``[\\p{L}\\p{N}_]`` (Java's ``\\w`` is ASCII only and
  ``(?U)\\w`` also keeps combining marks);
* white space is the 29 code points Python's ``str.isspace`` accepts, which
  include U+001C-U+001F, U+0085 and U+00A0 that Java's ``\\s`` lacks.

Decomposed accents (letter + combining mark) are not folded: the mark is
not a word character, so the character filters turn it into a space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's tables for equal results.
# ---------------------------------------------------------------------------

# Base pipeline (A): lower-case vowels folded to ASCII, in this order.
FOLD_VOWELS = [
    ("à", "a"), ("è", "e"), ("í", "i"), ("ì", "i"),
    ("ò", "o"), ("ó", "o"), ("ù", "u"), ("ú", "u"),
]

# Enhanced pipeline (B): letters folded to ASCII, each also in upper case.
FOLD_LETTERS = [
    ("à", "a"), ("è", "e"), ("é", "e"), ("í", "i"), ("ì", "i"),
    ("ò", "o"), ("ó", "o"), ("ù", "u"), ("ú", "u"), ("ü", "u"),
    ("ç", "c"), ("ñ", "n"),
]

# Enhanced pipeline (B): abbreviations expanded in this order, as plain
# substrings; each is also applied in capitalised form.
ABBREVIATIONS_B = [
    ("dott.", "dottor"), ("dr.", "dottor"),
    ("prof.", "professor"), ("ing.", "ingegner"),
    ("sig.", "signor"), ("sig.ra", "signora"),
    ("avv.", "avvocato"), ("on.", "onorevole"),
]

# Voices pipeline (C): abbreviations expanded in this order, lower case only.
ABBREVIATIONS_C = [
    ("dott.", "dottore"), ("dr.", "dottore"),
    ("prof.", "professore"), ("ing.", "ingegnere"),
    ("sig.", "signore"), ("sig.ra", "signora"),
    ("avv.", "avvocato"), ("on.", "onorevole"),
    ("vs.", "versus"), ("etc.", "eccetera"),
]

# Python's str.isspace() set, as a regex class body (Java and RE2 syntax).
WHITESPACE = (r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# Punctuation kept by the enhanced pipeline's character filter (B).
PUNCT_B = r""".,!?;:\-'" """.strip()
# Letters and punctuation kept by the voices pipeline's filter (C).
LETTERS_C = "a-zA-Zàèéìíîòóùú"
PUNCT_C = r".,!?;:\-'"

# ---------------------------------------------------------------------------

WORD = r"\p{L}\p{N}_"
ALNUM = r"\p{L}\p{N}"

#: regex patterns, shared with the DuckDB oracle SQL
RE_NOT_WORD_B = f"[^{WORD}{WHITESPACE}{PUNCT_B}]"
RE_NOT_KEPT_C = f"[^{LETTERS_C}{WHITESPACE}{PUNCT_C}]"
RE_WS_RUN = f"[{WHITESPACE}]+"
RE_ALNUM_OR_WS = f"[{ALNUM}{WHITESPACE}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _capitalize(s: str) -> str:
    return s[:1].upper() + s[1:].lower()


def _replace_chain(col: Column, pairs) -> Column:
    for src, dst in pairs:
        col = F.replace(col, F.lit(src), F.lit(dst))
    return col


def _replace_words(col: Column, pairs) -> Column:
    """Every leftmost and longest of the abbreviations that begins a word
    replaced, in one pass: what is put in is not looked at again, and a word
    that merely ends like an abbreviation is left alone."""
    found = sorted((a for a, _ in pairs), key=len, reverse=True)
    pattern = f"(?<![{WORD}])(?:" + "|".join(a.replace(".", r"\.") for a in found) + ")"
    full = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    between = F.split(col, pattern, -1)
    put_in = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), lambda a: full[a])
    # One more stretch between than matches.
    parts = F.zip_with(between, put_in, lambda b, p: F.concat(b, F.coalesce(p, F.lit(""))))
    return F.array_join(parts, "")


def empty_if_null(c: Column | str) -> Column:
    """Null (or missing) text becomes the empty string."""
    return F.coalesce(_c(c), F.lit(""))


def fold_vowels(c: Column | str) -> Column:
    """Fold the 8 lower-case accented vowels of the base pipeline."""
    src = "".join(a for a, _ in FOLD_VOWELS)
    dst = "".join(b for _, b in FOLD_VOWELS)
    return F.translate(_c(c), src, dst)


def fold_letters(c: Column | str) -> Column:
    """Fold 12 accented letters, lower and upper case. The targets are
    ASCII, so one simultaneous ``translate`` equals the sequential replaces."""
    pairs = FOLD_LETTERS + [(a.upper(), b.upper()) for a, b in FOLD_LETTERS]
    return F.translate(_c(c), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def keep_word_chars(c: Column | str) -> Column:
    """Anything but word chars, white space and ``.,!?;:-'"`` -> space."""
    return F.regexp_replace(_c(c), RE_NOT_WORD_B, " ")


def keep_italian_chars(c: Column | str) -> Column:
    """T4: anything but ASCII letters, the accented letters of the voices
    pipeline, white space and ``.,!?;:-'`` -> space (digits and ``"`` go)."""
    return F.regexp_replace(_c(c), RE_NOT_KEPT_C, " ")


def squeeze_ws(c: Column | str) -> Column:
    """T5: white-space runs -> one space, then trim."""
    return F.trim(F.regexp_replace(_c(c), RE_WS_RUN, " "))


def expand_abbr_b(c: Column | str, strict: bool = False) -> Column:
    """Expand abbreviations in table order, each as written and then
    capitalised; plain substring matches (``sig.ra`` therefore becomes
    ``signorra``). ``strict`` takes the longest first and only where a word
    begins: ``sig.ra`` is ``signora``, and ``ragion.`` stays."""
    pairs = []
    for abbr, full in ABBREVIATIONS_B:
        pairs.append((abbr, full))
        pairs.append((_capitalize(abbr), _capitalize(full)))
    return _replace_words(_c(c), pairs) if strict else _replace_chain(_c(c), pairs)


def expand_abbr_c(c: Column | str, strict: bool = False) -> Column:
    """Expand the voices pipeline's abbreviations (lower case only);
    ``strict`` as in :func:`expand_abbr_b`."""
    return _replace_words(_c(c), ABBREVIATIONS_C) if strict else _replace_chain(_c(c), ABBREVIATIONS_C)


def normalize_text_b(c: Column | str, strict: bool = False) -> Column:
    """Null -> "", fold letters, filter characters, squeeze spaces,
    expand abbreviations (after trimming)."""
    return expand_abbr_b(squeeze_ws(keep_word_chars(fold_letters(empty_if_null(c)))), strict)


def normalize_text_c(c: Column | str, strict: bool = False) -> Column:
    """Null -> "", lower-case, filter characters, squeeze spaces,
    expand abbreviations. (The voices pipeline defines an accent table but
    never applies it.)"""
    return expand_abbr_c(squeeze_ws(keep_italian_chars(F.lower(empty_if_null(c)))), strict)


def special_count(c: Column | str) -> Column:
    """Characters that are neither alphanumeric nor white space (``_`` counts)."""
    return F.length(F.regexp_replace(_c(c), RE_ALNUM_OR_WS, ""))


def special_ratio(c: Column | str) -> Column:
    """Special characters / length; null for the empty string."""
    n = F.length(_c(c))
    return F.when(n > 0, special_count(c) / n)


def text_length(c: Column | str) -> Column:
    """Length in code points (as Python's ``len``)."""
    return F.length(_c(c))
