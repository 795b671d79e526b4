"""DuckDB spellings of the text functions, for the oracle SQL in
``__spark_entry__.py``. Built from the same fixed tables and regex classes
as ``functions.text`` so both sides say the same thing."""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _replace_chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def squeeze_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(T.RE_WS_RUN)}, ' ', 'g'))"


def fold_vowels(x: str) -> str:
    src = "".join(a for a, _ in T.FOLD_VOWELS)
    dst = "".join(b for _, b in T.FOLD_VOWELS)
    return f"translate({x}, {q(src)}, {q(dst)})"


def fold_letters(x: str) -> str:
    pairs = T.FOLD_LETTERS + [(a.upper(), b.upper()) for a, b in T.FOLD_LETTERS]
    return f"translate({x}, {q(''.join(a for a, _ in pairs))}, {q(''.join(b for _, b in pairs))})"


def keep_word_chars(x: str) -> str:
    return f"regexp_replace({x}, {q(T.RE_NOT_WORD_B)}, ' ', 'g')"


def keep_italian_chars(x: str) -> str:
    return f"regexp_replace({x}, {q(T.RE_NOT_KEPT_C)}, ' ', 'g')"


def expand_abbr_b(x: str) -> str:
    pairs = []
    for a, b in T.ABBREVIATIONS_B:
        pairs += [(a, b), (T._capitalize(a), T._capitalize(b))]
    return _replace_chain(x, pairs)


def expand_abbr_c(x: str) -> str:
    return _replace_chain(x, T.ABBREVIATIONS_C)


def _expand_words(x: str, pairs) -> str:
    """Abbreviations where a word begins, the longest first: each word is
    marked in front, so that what is put in does not count as a word."""
    mark = "\x01"
    marked = f"regexp_replace({x}, '([{T.WORD}]+)', '{mark}\\1', 'g')"
    in_front = [(mark + a.replace(".", "." + mark).removesuffix(mark), b) for a, b in sorted(pairs, key=lambda p: -len(p[0]))]
    return f"replace({_replace_chain(marked, in_front)}, '{mark}', '')"


def expand_words_b(x: str) -> str:
    return _expand_words(x, [p for a, b in T.ABBREVIATIONS_B for p in ((a, b), (T._capitalize(a), T._capitalize(b)))])


def expand_words_c(x: str) -> str:
    return _expand_words(x, T.ABBREVIATIONS_C)


def normalize_text_b(col: str) -> str:
    return expand_abbr_b(squeeze_ws(keep_word_chars(fold_letters(f"coalesce({col}, '')"))))


def normalize_text_c(col: str) -> str:
    return expand_abbr_c(squeeze_ws(keep_italian_chars(f"lower(coalesce({col}, ''))")))


def special_count(x: str) -> str:
    return f"length(regexp_replace({x}, {q(T.RE_ALNUM_OR_WS)}, '', 'g'))"


def special_ratio(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN {special_count(x)} / length({x}) END"


# --- signals (DuckDB list functions) -------------------------------------

def peak(x: str) -> str:
    return f"list_max(list_transform({x}, lambda v: abs(v)))"


def peak_normalize(x: str, gain: float | None = None) -> str:
    pk = peak(x)
    body = f"v / {pk}" if gain is None else f"v / {pk} * {gain!r}"
    return f"CASE WHEN {pk} > 0 THEN list_transform({x}, lambda v: {body}) ELSE {x} END"


def _first_loud(x: str, th: float) -> str:
    return f"coalesce(list_position(list_transform({x}, lambda v: abs(v) > {th!r}), true), 0)"


def _last_loud(x: str, th: float) -> str:
    return f"(len({x}) - coalesce(list_position(list_reverse(list_transform({x}, lambda v: abs(v) > {th!r})), true), 0) + 1)"


def sql_slice(x: str, start: str, length: str) -> str:
    """Spark's ``slice(x, start, length)`` (1-based) in DuckDB."""
    return f"list_slice({x}, {start}, ({start}) + ({length}) - 1)"


def trim_silence_b(x: str, th: float) -> str:
    f, l = _first_loud(x, th), _last_loud(x, th)
    return f"CASE WHEN {f} > 0 THEN {sql_slice(x, f, f'{l} - {f} + 1')} ELSE {x} END"


def trim_silence_c(x: str, th: float, pad: int) -> str:
    f, l = _first_loud(x, th), _last_loud(x, th)
    s, e, n = f"({f} - 1)", f"({l} - 1)", f"len({x})"
    p = f"least({pad}, {s}, {n} - {e} - 1)"
    start, end = f"({s} - {p})", f"least({n}, {e} + {p})"
    return f"CASE WHEN {f} > 0 THEN {sql_slice(x, f'{start} + 1', f'{end} - {start}')} ELSE {x} END"


def clamp_len(x: str, n: int) -> str:
    return f"list_slice({x}, 1, {n})"


def min_len_or_null(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN {x} END"


def resample(x: str, r_in: int, r_out: int) -> str:
    n = f"len({x})"
    m = f"CAST(floor({n} * {r_out} / {r_in}) AS INTEGER)"
    k = f"CAST((i * {r_in}) // {r_out} AS INTEGER)"
    a = f"{x}[least({k} + 1, {n})]"
    b = f"{x}[least({k} + 2, {n})]"
    frac = f"CAST((i * {r_in}) % {r_out} AS DOUBLE) / {r_out}::DOUBLE"
    return f"list_transform(range(0, {m}), lambda i: {a} + {frac} * ({b} - {a}))"


def l2_normalize(v: str) -> str:
    d = f"CAST({v} AS DOUBLE[])"
    norm = f"sqrt(list_reduce(list_transform({d}, lambda y: y * y), lambda a, b: a + b, 0.0::DOUBLE))"
    return f"CASE WHEN {norm} > 0 THEN list_transform({d}, lambda y: y / {norm}) ELSE {d} END"


def downmix(xs: str) -> str:
    n = f"len({xs}[1])"
    return (f"CASE WHEN len({xs}) = 0 OR {n} = 0 THEN []::DOUBLE[] ELSE list_transform(range(1, {n} + 1), "
            f"lambda i: list_reduce(list_transform({xs}, lambda ch: ch[i]), lambda a, b: a + b, 0.0::DOUBLE) / len({xs})) END")


def not_blank(t: str) -> str:
    return f"regexp_matches({t}, '[^{T.WHITESPACE}]')"


def highpass_samples(clips: str, fc: float, fs: float) -> str:
    """(speaker_id, clip_no, i, y) for each sample of the clips (speaker_id,
    clip_no, x) after a 4th-order Butterworth high-pass from rest: two
    second-order sections run as a recursive query, rounded to single
    precision like the column function."""
    def section(angle: str) -> str:
        k, q = f"tan(pi() * {fc!r}::DOUBLE / {fs!r}::DOUBLE)", f"(2 * cos({angle}))"
        d = f"(1 + {k} * {q} + {k} * {k})"
        return f"1 / {d} AS b, 2 * ({k} * {k} - 1) / {d} AS a1, (1 - {k} * {q} + {k} * {k}) / {d} AS a2"
    return f"""(WITH RECURSIVE clips AS ({clips}),
p AS (SELECT {section('pi() / 8')}), q AS (SELECT {section('3 * pi() / 8')}),
step AS (
  SELECT speaker_id, clip_no, x, 1 AS i, x[1]::DOUBLE AS u, 0::DOUBLE AS u1, p.b * x[1] AS v, 0::DOUBLE AS v1,
         q.b * p.b * x[1] AS w, 0::DOUBLE AS w1 FROM clips, p, q WHERE len(x) > 0
  UNION ALL
  SELECT speaker_id, clip_no, x, i + 1, x[i + 1], u,
         p.b * (x[i + 1] - 2 * u + u1) - p.a1 * v - p.a2 * v1, v,
         q.b * (p.b * (x[i + 1] - 2 * u + u1) - p.a1 * v - p.a2 * v1 - 2 * v + v1) - q.a1 * w - q.a2 * w1, w
  FROM step, p, q WHERE i < len(x))
SELECT speaker_id, clip_no, i, CAST(CAST(w AS FLOAT) AS DOUBLE) AS y FROM step)"""


def highpass_clips(clips: str, fc: float, fs: float) -> str:
    """(speaker_id, clip_no, y) with the filtered samples as a list; clips
    without samples stay empty, null clips null."""
    return (f"(SELECT c.speaker_id, c.clip_no, CASE WHEN c.x IS NULL THEN NULL ELSE coalesce(h.y, []::DOUBLE[]) END AS y"
            f" FROM ({clips}) c LEFT JOIN (SELECT speaker_id, clip_no, list(y ORDER BY i) AS y FROM"
            f" {highpass_samples(clips, fc, fs)} GROUP BY ALL) h USING (speaker_id, clip_no))")
