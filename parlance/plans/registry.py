"""
DataFrame result) and their DuckDB oracle SQL.

Every query reads the driver's tables at ``sf_dir`` (or frames Spark derives
from them), runs over whole tables and whole texts, and aliases every
computed column identically on both sides. Double aggregates are rounded
(sums of doubles differ in the last bits with partitioning).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import proxies as px
from . import sqltext as S
from . import voices as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- shared SQL fragments -----------------------------------------------------

CONV_SQL = ("SELECT text, role AS speaker_id, length(text) / 15.0::DOUBLE AS duration, conv_id, turn,"
            " 0 AS source_no, (row_number() OVER (ORDER BY conv_id, turn) - 1) AS pos FROM conversations")
DOCS_SQL = ("SELECT text, lang AS speaker_id, doc_id, source, n_chars, 0 AS source_no,"
            " (row_number() OVER (ORDER BY doc_id) - 1) AS pos FROM documents")


def _voices_prepared_sql() -> str:
    return (f"SELECT {S.normalize_text_c('text')} AS text, speaker_id, duration, source_no, pos"
            f" FROM ({CONV_SQL})")


def _filtered_c_sql() -> str:
    return (f"SELECT * FROM ({_voices_prepared_sql()}) WHERE length(text) BETWEEN 10 AND 200"
            f" AND duration BETWEEN 2.0 AND 15.0")


# -- flagship: voices pipeline without signals -------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = C.prepare_text(px.conversations_corpus(spark, sf_dir))
    out = C.conditioning_clips(prepared)
    return out.select("speaker_id", "clip_rank", "text", "duration",
                      F.round("total_duration", 6).alias("total_duration"))


register("voices_conditioning", f"""
WITH f AS ({_filtered_c_sql()}),
good AS (SELECT speaker_id FROM f GROUP BY speaker_id HAVING count(*) >= 5),
g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM good WHERE good.speaker_id IS NOT DISTINCT FROM f.speaker_id)),
tot AS (SELECT speaker_id, sum(duration) AS total_duration FROM g GROUP BY speaker_id),
r AS (SELECT g.*, row_number() OVER (PARTITION BY speaker_id ORDER BY length(text) * duration DESC, source_no, pos) AS clip_rank FROM g)
SELECT r.speaker_id, CAST(r.clip_rank AS BIGINT) AS clip_rank, r.text, r.duration, round(tot.total_duration, 6) AS total_duration
FROM r JOIN tot ON r.speaker_id IS NOT DISTINCT FROM tot.speaker_id WHERE r.clip_rank <= 5
""")(flagship)


# -- signals (N1-N10, P5, F8, F9) --------------------------------------------

from ..functions import signal as N  # noqa: E402
from ..operators import segments as SEG  # noqa: E402
from ..sources import signals as SG  # noqa: E402

#: proxy sample rate of event signals: 45-99 samples become 5.6-12.4 s, so
#: the pipelines' second-based bounds are not vacuous
EVENT_RATE = 8
#: threshold used on event signals: driver values are all >= 0.01 before
#: peak normalisation, so 0.05 is the one that finds quiet edges
EVENT_SILENCE = 0.05


def _clips(spark, sf_dir):
    return SG.event_signals(spark, sf_dir, rate=EVENT_RATE)


def _clips_sql() -> str:
    return SG.signals_sql(rate=EVENT_RATE)


@register("signal_clips", f"SELECT speaker_id, clip_no, x, rate, n_samples FROM ({_clips_sql()})")
def q_signal_clips(spark, sf_dir):
    return _clips(spark, sf_dir)


@register("signal_duration",
          f"SELECT speaker_id, clip_no, len(x) / rate::DOUBLE AS duration FROM ({_clips_sql()})")
def q_signal_duration(spark, sf_dir):
    return _clips(spark, sf_dir).select("speaker_id", "clip_no", N.duration("x", "rate").alias("duration"))


@register("signal_peak_normalize",
          f"SELECT speaker_id, clip_no, {S.peak_normalize('x')} AS y, {S.peak_normalize('x', N.GAIN_C)} AS y_c"
          f" FROM ({_clips_sql()})")
def q_peak_normalize(spark, sf_dir):
    c = _clips(spark, sf_dir)
    return c.select("speaker_id", "clip_no", N.peak_normalize("x").alias("y"),
                    N.peak_normalize("x", N.GAIN_C).alias("y_c"))


@register("signal_trim_silence_b",
          f"SELECT speaker_id, clip_no, {S.trim_silence_b('p', EVENT_SILENCE)} AS y FROM"
          f" (SELECT speaker_id, clip_no, {S.peak_normalize('x')} AS p FROM ({_clips_sql()}))")
def q_trim_b(spark, sf_dir):
    c = _clips(spark, sf_dir).select("speaker_id", "clip_no", N.peak_normalize("x").alias("p"))
    return c.select("speaker_id", "clip_no", N.trim_silence_b("p", EVENT_SILENCE).alias("y"))


@register("signal_trim_silence_c",
          f"SELECT speaker_id, clip_no, {S.trim_silence_c('p', EVENT_SILENCE, 3)} AS y,"
          f" {S.trim_silence_c('p', EVENT_SILENCE, 1000)} AS y1000 FROM"
          f" (SELECT speaker_id, clip_no, {S.peak_normalize('x', N.GAIN_C)} AS p FROM ({_clips_sql()}))")
def q_trim_c(spark, sf_dir):
    c = _clips(spark, sf_dir).select("speaker_id", "clip_no", N.peak_normalize("x", N.GAIN_C).alias("p"))
    return c.select("speaker_id", "clip_no", N.trim_silence_c("p", EVENT_SILENCE, 3).alias("y"),
                    N.trim_silence_c("p", EVENT_SILENCE, 1000).alias("y1000"))


@register("signal_clamp_and_min_len",
          f"SELECT speaker_id, clip_no, {S.clamp_len('x', 64)} AS cut, {S.min_len_or_null('x', 70)} AS long_only"
          f" FROM ({_clips_sql()})")
def q_clamp(spark, sf_dir):
    c = _clips(spark, sf_dir)
    return c.select("speaker_id", "clip_no", N.clamp_len("x", 64).alias("cut"),
                    N.min_len_or_null("x", 70).alias("long_only"))


@register("signal_resample",
          f"SELECT speaker_id, clip_no, {S.resample('x', 8, 11)} AS up, {S.resample('x', 8, 5)} AS down"
          f" FROM ({_clips_sql()})")
def q_resample(spark, sf_dir):
    c = _clips(spark, sf_dir)
    return c.select("speaker_id", "clip_no", N.resample("x", 8, 11).alias("up"),
                    N.resample("x", 8, 5).alias("down"))


@register("signal_downmix",
          f"SELECT speaker_id, clip_no, {S.downmix('[x, list_reverse(x)]')} AS mono FROM ({_clips_sql()})")
def q_downmix(spark, sf_dir):
    c = _clips(spark, sf_dir)
    return c.select("speaker_id", "clip_no", N.downmix(F.array(F.col("x"), F.reverse("x"))).alias("mono"))


@register("embedding_l2_normalize",
          f"SELECT vec_id, label, {S.l2_normalize('list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 3)')} AS speaker_embedding"
          f" FROM embeddings")
def q_l2(spark, sf_dir):
    e = px.embeddings_table(spark, sf_dir)
    tripled = F.transform("embedding", lambda v: v.cast("double") * 3)
    return e.select("vec_id", "label", N.l2_normalize(tripled).alias("speaker_embedding"))


_MIN_B = N.MIN_SAMPLES_B * EVENT_RATE // N.RATE_B
FC_B, FC_C = (N.HIGHPASS_B / N.RATE_B * EVENT_RATE, N.HIGHPASS_C / N.RATE_C * EVENT_RATE)


def _chain_b_sql(clips: str, rate: int) -> str:
    """(speaker_id, clip_no, y): the enhanced chain on clips (.., x)."""
    trimmed = (f"SELECT speaker_id, clip_no, {S.trim_silence_b(S.peak_normalize('x'), N.SILENCE_B)} AS x"
               f" FROM ({clips})")
    return (f"SELECT speaker_id, clip_no, {S.clamp_len('y', N.MAX_SECONDS_B * rate)} AS y"
            f" FROM {S.highpass_clips(trimmed, FC_B, float(rate))}")


def _chain_c_sql(clips: str, rate: int, fc: float | None = None) -> str:
    """(speaker_id, clip_no, y): the voices chain on clips (.., x)."""
    trimmed = (f"SELECT speaker_id, clip_no, {S.trim_silence_c(S.peak_normalize('x', N.GAIN_C), N.SILENCE_C, N.PAD_C)} AS x"
               f" FROM ({clips})")
    kept = S.clamp_len(S.min_len_or_null('y', N.MIN_SECONDS_C * rate), N.MAX_SECONDS_C * rate)
    return f"SELECT speaker_id, clip_no, {kept} AS y FROM {S.highpass_clips(trimmed, fc or FC_C, float(rate))}"


def _clean_both(spark, sf_dir) -> DataFrame:
    c = _clips(spark, sf_dir)
    c = N.with_clean_signal_b(c, "x", "clean_b", EVENT_RATE, fc=FC_B)
    return N.with_clean_signal_c(c, "x", "clean_c", EVENT_RATE, fc=FC_C)


@register("signal_clean_chains",
          f"SELECT speaker_id, clip_no, b.y AS clean_b, c.y AS clean_c FROM ({_chain_b_sql(_clips_sql(), EVENT_RATE)}) b"
          f" JOIN ({_chain_c_sql(_clips_sql(), EVENT_RATE)}) c USING (speaker_id, clip_no)")
def q_chains(spark, sf_dir):
    """N8, every step on; the cut-off frequencies are scaled to the rate."""
    return _clean_both(spark, sf_dir).select("speaker_id", "clip_no", "clean_b", "clean_c")


@register("signal_highpass", f"SELECT speaker_id, clip_no, CAST(i - 1 AS INTEGER) AS i, y FROM"
                             f" {S.highpass_samples(_clips_sql(), FC_B, float(EVENT_RATE))}")
def q_highpass(spark, sf_dir):
    """N5, one row per sample."""
    c = _clips(spark, sf_dir)
    return c.select("speaker_id", "clip_no", F.posexplode(N.highpass("x", FC_B, EVENT_RATE)).alias("i", "y"))


#: the events' signals cut into segments of so many samples
SEGMENT_SAMPLES = 16


def _event_segments(spark, sf_dir) -> DataFrame:
    return SG.event_signals(spark, sf_dir, SEGMENT_SAMPLES, EVENT_RATE).select("speaker_id", "clip_no", "x")


@register("signal_segments_highpass", f"SELECT speaker_id, CAST(i - 1 AS INTEGER) AS i, y FROM"
                                      f" {S.highpass_samples(_clips_sql(), FC_B, float(EVENT_RATE))}")
def q_segments_highpass(spark, sf_dir):
    """N5 over signals in segments, one row per sample of the whole."""
    y = SEG.highpass_segments(_event_segments(spark, sf_dir), ["speaker_id"], FC_B, EVENT_RATE)
    return y.select("speaker_id", "clip_no", F.posexplode("y").alias("i", "y")) \
            .select("speaker_id", (F.col("clip_no") * SEGMENT_SAMPLES + F.col("i")).cast("int").alias("i"), "y")


@register("signal_segments_clean",
          f"SELECT speaker_id, b.y AS clean_b, c.y AS clean_c FROM ({_chain_b_sql(_clips_sql(), EVENT_RATE)}) b"
          f" JOIN ({_chain_c_sql(_clips_sql(), EVENT_RATE)}) c USING (speaker_id, clip_no)")
def q_segments_clean(spark, sf_dir):
    """N8 over signals in segments, each cleaned as one."""
    seg = _event_segments(spark, sf_dir)
    b = SEG.clean_segments(seg, ["speaker_id"], SEG.chain_b(EVENT_RATE, FC_B)).withColumnRenamed("signal", "clean_b")
    c = SEG.clean_segments(seg, ["speaker_id"], SEG.chain_c(EVENT_RATE, FC_C)).withColumnRenamed("signal", "clean_c")
    return b.join(c, "speaker_id")


@register("signal_segments_resample",
          f"SELECT speaker_id, CAST(i AS INTEGER) AS i, y[i + 1] AS x FROM (SELECT speaker_id, {S.resample('x', 8, 11)} AS y"
          f" FROM ({_clips_sql()})), range(0, len(y)) t(i)")
def q_segments_resample(spark, sf_dir):
    """N9 over signals in segments, one row per sample of the whole."""
    out = SEG.resample_segments(_event_segments(spark, sf_dir), ["speaker_id"], 8, 11)
    first = F.ceil(F.col("clip_no") * SEGMENT_SAMPLES * 11 / 8)
    return out.select("speaker_id", first.alias("first"), F.posexplode("x").alias("i", "x")) \
              .select("speaker_id", (F.col("first") + F.col("i")).cast("int").alias("i"), "x")


@register("signal_rates",
          f"SELECT speaker_id, CASE WHEN CAST(speaker_id AS BIGINT) % 2 = 0 THEN {S.resample('x', 8, 11)}"
          f" ELSE {S.resample('x', 5, 11)} END AS x, 11 AS rate, CAST(CAST(speaker_id AS BIGINT) % 2 AS INTEGER) AS source_no"
          f" FROM ({_clips_sql()})")
def q_rates(spark, sf_dir):
    """N9 with U1: two sources of different rates become one of one rate."""
    c = _clips(spark, sf_dir).select("speaker_id", "x")
    odd = F.col("speaker_id").cast("long") % 2
    both = SC.concat_sources([c.where(odd == k).withColumn("rate", F.lit(r)).withColumn("source_no", F.lit(k))
                              for k, r in ((0, 8), (1, 5))])
    return both.withColumn("x", N.resample("x", "rate", 11)).withColumn("rate", F.lit(11))


# -- text functions on whole documents (T1-T12) -------------------------------

from ..functions import text as T  # noqa: E402
from ..functions import predicates as P  # noqa: E402


def _docs(spark, sf_dir):
    return px.table(spark, sf_dir, "documents")


def _text_query(name: str, spark_expr, sql_expr: str):
    register(name, f"SELECT doc_id, {sql_expr} AS out FROM documents")(
        lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", spark_expr().alias("out")))


_text_query("text_fold_vowels", lambda: T.fold_vowels("text"), S.fold_vowels("text"))
_text_query("text_fold_letters", lambda: T.fold_letters("text"), S.fold_letters("text"))
_text_query("text_keep_word_chars", lambda: T.keep_word_chars("text"), S.keep_word_chars("text"))
_text_query("text_keep_italian_chars", lambda: T.keep_italian_chars(F.lower("text")),
            S.keep_italian_chars("lower(text)"))
_text_query("text_squeeze_ws", lambda: T.squeeze_ws("text"), S.squeeze_ws("text"))
_text_query("text_expand_abbr_b", lambda: T.expand_abbr_b("text"), S.expand_abbr_b("text"))
_text_query("text_expand_abbr_c", lambda: T.expand_abbr_c(F.lower("text")), S.expand_abbr_c("lower(text)"))
_text_query("text_expand_words_b", lambda: T.expand_abbr_b("text", strict=True), S.expand_words_b("text"))
_text_query("text_expand_words_c", lambda: T.expand_abbr_c(F.lower("text"), strict=True), S.expand_words_c("lower(text)"))
_text_query("text_lower_or_empty", lambda: F.lower(T.empty_if_null("text")), "lower(coalesce(text, ''))")
_text_query("text_normalize_b", lambda: T.normalize_text_b("text"), S.normalize_text_b("text"))
_text_query("text_normalize_c", lambda: T.normalize_text_c("text"), S.normalize_text_c("text"))


@register("text_special_ratio",
          f"SELECT doc_id, CAST({S.special_count('text')} AS BIGINT) AS n_special, {S.special_ratio('text')} AS ratio,"
          f" (length(text) > 0 AND NOT ({S.special_count('text')} / length(text) > 0.3)) AS ok_03"
          f" FROM documents")
def q_special(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.special_count("text").cast("long").alias("n_special"),
                    T.special_ratio("text").alias("ratio"), P.special_at_most("text", 0.3).alias("ok_03"))


# -- sources and projections (S1-S3, P1, P2, P4, P6, U1) -----------------------

from ..sources import corpus as SC  # noqa: E402


@register("corpus_scan", "SELECT doc_id, lang, source, n_chars, 0 AS source_no,"
                        " CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM documents")
def q_scan(spark, sf_dir):
    d = SC.read_corpus(spark, px.table_path(sf_dir, "documents"))
    return d.select("doc_id", "lang", "source", "n_chars", "source_no", "pos")


@register("corpus_head", f"SELECT doc_id, text, CAST(pos AS BIGINT) AS pos FROM ({DOCS_SQL}) WHERE pos < 250")
def q_head(spark, sf_dir):
    return SC.read_head(spark, px.table_path(sf_dir, "documents"), 250).select("doc_id", "text", "pos")


def _b_specs(sf_dir: str):
    """Two sources as the enhanced pipeline adapts them, plus a missing one."""
    return [
        SC.SourceSpec(px.table_path(sf_dir, "documents"), rename={"lang": "speaker_id"}),
        SC.SourceSpec(px.table_path(sf_dir, "conversations"), rename={"role": "speaker_id"},
                      keep=["text", "speaker_id"]),
        SC.SourceSpec(px.table_path(sf_dir, "no_such_table"), rename={"sentence": "text"}),
    ]


@register("load_sources", f"""
SELECT text, speaker_id, 0 AS source_no, CAST(pos AS BIGINT) AS pos, doc_id FROM ({DOCS_SQL})
UNION ALL
SELECT text, speaker_id, 1 AS source_no, CAST(pos AS BIGINT) AS pos, NULL::BIGINT AS doc_id FROM ({CONV_SQL})
""")
def q_load_sources(spark, sf_dir):
    df, _skipped = SC.load_sources(spark, _b_specs(sf_dir))
    return df.select("text", "speaker_id", "source_no", "pos", "doc_id")


@register("rename_keep", "SELECT text AS sentence, role AS client_id FROM conversations")
def q_rename_keep(spark, sf_dir):
    c = SC.read_corpus(spark, px.table_path(sf_dir, "conversations"), position=False)
    c = SC.rename(c, {"text": "sentence", "role": "client_id", "absent_col": "x"})
    return SC.keep(c, ["sentence", "client_id"], always=())


@register("default_speaker",
          f"SELECT doc_id, 'speaker_' || CAST(pos AS VARCHAR) AS speaker_id FROM ({DOCS_SQL})")
def q_default_speaker(spark, sf_dir):
    d = SC.read_corpus(spark, px.table_path(sf_dir, "documents"))
    return SC.default_speaker(d.select("doc_id", "pos")).select("doc_id", "speaker_id")


@register("utterance_record",
          f"SELECT conv_id, turn, {{'text': {S.normalize_text_c('text')}, 'speaker_id': role,"
          f" 'duration': length(text) / 15.0::DOUBLE, 'sample_rate': 22050}} AS record FROM conversations")
def q_record(spark, sf_dir):
    c = px.conversations_corpus(spark, sf_dir)
    return c.select("conv_id", "turn", F.struct(T.normalize_text_c("text").alias("text"), "speaker_id", "duration",
                                                F.lit(22050).alias("sample_rate")).alias("record"))


@register("concat_sources", f"""
SELECT text, speaker_id, source_no, CAST(pos AS BIGINT) AS pos, doc_id, NULL::BIGINT AS conv_id FROM
  (SELECT text, speaker_id, 0 AS source_no, pos, doc_id FROM ({DOCS_SQL}))
UNION ALL
SELECT text, speaker_id, 1, CAST(pos AS BIGINT), NULL, conv_id FROM ({CONV_SQL})
""")
def q_concat(spark, sf_dir):
    d = px.documents_corpus(spark, sf_dir, 0).select("text", "speaker_id", "source_no", "pos", "doc_id")
    c = px.conversations_corpus(spark, sf_dir, 1).select("text", "speaker_id", "source_no", "pos", "conv_id")
    return SC.concat_sources([d, c]).select("text", "speaker_id", "source_no", "pos", "doc_id", "conv_id")


# -- filters, funnel, gates (F1-F5, F9, G10, G11) ------------------------------

from ..operators import quality as Q  # noqa: E402


def _conv_b(spark, sf_dir):
    c = px.conversations_corpus(spark, sf_dir)
    return c.withColumn("text", T.normalize_text_b("text"))


def _conv_b_sql() -> str:
    return (f"SELECT {S.normalize_text_b('text')} AS text, speaker_id, duration, conv_id, turn, source_no, pos"
            f" FROM ({CONV_SQL})")


def _reason_sql(t: str = "text", d: str = "duration", r: float = 0.3) -> str:
    return (f"CASE WHEN NOT coalesce(length({t}) BETWEEN 10 AND 300, false) THEN 'text_length'"
            f" WHEN NOT coalesce({d} BETWEEN 1.0 AND 10.0, false) THEN 'duration'"
            f" WHEN NOT {S.not_blank(t)} THEN 'blank'"
            f" WHEN NOT (length({t}) > 0 AND NOT ({S.special_count(t)} / length({t}) > {r})) THEN 'special_chars'"
            f" END")


@register("quality_filter_b",
          f"SELECT conv_id, turn, text, duration FROM ({_conv_b_sql()}) WHERE {_reason_sql()} IS NULL")
def q_quality(spark, sf_dir):
    return Q.quality_filter_b(_conv_b(spark, sf_dir)).select("conv_id", "turn", "text", "duration")


@register("quality_reasons", f"SELECT conv_id, turn, {_reason_sql()} AS reject_reason FROM ({_conv_b_sql()})")
def q_reasons(spark, sf_dir):
    return Q.with_reject_reason(_conv_b(spark, sf_dir)).select("conv_id", "turn", "reject_reason")


@register("quality_reasons_raw_documents",
          "SELECT doc_id, " + _reason_sql("text", "length(text) / 1500.0::DOUBLE", 0.3)
          + " AS reject_reason FROM documents")
def q_reasons_docs(spark, sf_dir):
    """F4 on raw text (normalised text rarely exceeds 0.3), duration :=
    length / 1500 so that the length tests are reached."""
    d = _docs(spark, sf_dir).withColumn("duration", F.length("text") / F.lit(1500.0))
    return Q.with_reject_reason(d).select("doc_id", "reject_reason")


@register("text_duration_filter_c",
          f"SELECT conv_id, turn, text, duration FROM ({_voices_prepared_sql().replace('source_no, pos', 'source_no, pos, conv_id, turn').replace('SELECT text, role', 'SELECT text, role')})"
          f" WHERE length(text) BETWEEN 10 AND 200 AND duration BETWEEN 2.0 AND 15.0")
def q_filter_c(spark, sf_dir):
    return C.prepare_text(px.conversations_corpus(spark, sf_dir)).select("conv_id", "turn", "text", "duration")


_FUNNEL_B = [("text_length", "length(text) BETWEEN 10 AND 300"),
             ("duration", "duration BETWEEN 1.0 AND 10.0"),
             ("not_blank", S.not_blank("text"))]


@register("funnel_b", "SELECT * FROM (VALUES " + ", ".join(
    ["(0, 'input', (SELECT count(*) FROM conversations))"]
    + [f"({i}, '{n}', (SELECT count(*) FROM ({_conv_b_sql()}) WHERE "
       + " AND ".join(f"coalesce({c}, false)" for _, c in _FUNNEL_B[:i]) + "))"
       for i, (n, _) in enumerate(_FUNNEL_B, start=1)]
    + [f"(4, 'special_chars', (SELECT count(*) FROM ({_conv_b_sql()}) WHERE {_reason_sql()} IS NULL))"])
    + ") AS t(stage_no, stage, n_rows)")
def q_funnel(spark, sf_dir):
    d = _conv_b(spark, sf_dir)
    stages = [("text_length", P.text_len_between("text", 10, 300)),
              ("duration", P.duration_between("duration", 1.0, 10.0)),
              ("not_blank", P.not_blank("text")),
              ("special_chars", P.special_at_most("text", 0.3))]
    return Q.funnel(d, stages)


@register("gates_c", f"""
WITH f AS ({_filtered_c_sql()}),
good AS (SELECT speaker_id FROM f GROUP BY speaker_id HAVING count(*) >= 5)
SELECT 'samples' AS "check", CAST((SELECT count(*) FROM f) AS BIGINT) AS value, CAST(100 AS BIGINT) AS threshold,
       (SELECT count(*) FROM f) >= 100 AS ok
UNION ALL
SELECT 'speakers', CAST((SELECT count(*) FROM good) AS BIGINT), CAST(5 AS BIGINT), (SELECT count(*) FROM good) >= 5
""")
def q_gates(spark, sf_dir):
    prepared = C.prepare_text(px.conversations_corpus(spark, sf_dir))
    return C.gates(prepared)


# -- speakers (G1-G9, J1/F6, W1-W3, U2) ----------------------------------------

from ..operators import speakers as SP  # noqa: E402


def _vocab_sql(table: str) -> str:
    return (f"SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM {table}) WHERE ch <> ''"
            f" UNION SELECT ' ' WHERE (SELECT count(*) FROM {table}) >= 2")


def _conv_text(spark, sf_dir):
    return px.table(spark, sf_dir, "conversations")


@register("char_vocab", _vocab_sql("documents"))
def q_vocab(spark, sf_dir):
    return SP.char_vocab(_docs(spark, sf_dir))


@register("vocab_sizes", f"SELECT CAST((SELECT count(*) FROM ({_vocab_sql('documents')})) AS BIGINT) AS dataset_vocab_size,"
                         f" CAST((SELECT count(*) FROM ({_vocab_sql('conversations')})) AS BIGINT) AS reference_vocab_size")
def q_vocab_sizes(spark, sf_dir):
    return SP.vocab_sizes(SP.char_vocab(_docs(spark, sf_dir)), SP.char_vocab(_conv_text(spark, sf_dir)))


@register("missing_chars", f"SELECT ch FROM ({_vocab_sql('documents')}) EXCEPT SELECT ch FROM ({_vocab_sql('conversations')})")
def q_missing(spark, sf_dir):
    return SP.missing_chars(SP.char_vocab(_docs(spark, sf_dir)), SP.char_vocab(_conv_text(spark, sf_dir)))


def _events_spk(spark, sf_dir):
    e = px.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("speaker_id"), "event_id", "ts")


@register("speaker_counts_events", "SELECT user_id AS speaker_id, count(*) AS n FROM events GROUP BY user_id")
def q_counts_events(spark, sf_dir):
    return SP.speaker_counts(_events_spk(spark, sf_dir))


@register("speaker_counts_documents", "SELECT lang AS speaker_id, count(*) AS n FROM documents GROUP BY lang")
def q_counts_docs(spark, sf_dir):
    return SP.speaker_counts(px.documents_corpus(spark, sf_dir))


@register("speaker_summary", "SELECT count(*) AS n_speakers, sum(n)::BIGINT AS n_rows, sum(n) / count(*) AS mean_rows_per_speaker"
                             " FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def q_summary(spark, sf_dir):
    return SP.speaker_summary(SP.speaker_counts(_events_spk(spark, sf_dir)))


@register("speaker_histogram", """
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
r0 AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM c),
r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
w AS (SELECT lo, hi, (hi - lo) / 20 AS width FROM r),
b AS (SELECT least(CAST(floor((c.n - w.lo) / w.width) AS INTEGER) + 1, 20) AS bin FROM c, w),
f AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(s.bin AS INTEGER) AS bin, w.lo + (s.bin - 1) * w.width AS lower, w.lo + s.bin * w.width AS upper,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_speakers
FROM (SELECT unnest(range(1, 21)) AS bin) s CROSS JOIN w LEFT JOIN f ON f.bin = s.bin
""")
def q_hist(spark, sf_dir):
    return SP.count_histogram(SP.speaker_counts(_events_spk(spark, sf_dir)), 20)


@register("speaker_band_documents", """
SELECT doc_id, lang AS speaker_id FROM documents d
WHERE EXISTS (SELECT 1 FROM (SELECT lang FROM documents GROUP BY lang HAVING count(*) BETWEEN 100 AND 400) g
              WHERE g.lang IS NOT DISTINCT FROM d.lang)""")
def q_band_docs(spark, sf_dir):
    return SP.speaker_band(px.documents_corpus(spark, sf_dir), 100, 400).select("doc_id", "speaker_id")


@register("speaker_band_events", """
SELECT event_id, user_id AS speaker_id FROM events e
WHERE EXISTS (SELECT 1 FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) BETWEEN 60 AND 70) g
              WHERE g.user_id IS NOT DISTINCT FROM e.user_id)""")
def q_band_events(spark, sf_dir):
    return SP.speaker_band(_events_spk(spark, sf_dir), 60, 70).select("event_id", "speaker_id")


@register("band_summary", """
WITH k AS (SELECT * FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT user_id FROM events GROUP BY user_id
           HAVING count(*) BETWEEN 60 AND 70) g WHERE g.user_id IS NOT DISTINCT FROM e.user_id))
SELECT count(*) AS n_rows, CAST(count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS BIGINT) AS n_speakers FROM k""")
def q_band_summary(spark, sf_dir):
    return SP.band_summary(SP.speaker_band(_events_spk(spark, sf_dir), 60, 70))


@register("min_rows_per_speaker", """
SELECT conv_id, turn FROM conversations c
WHERE EXISTS (SELECT 1 FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 5) g
              WHERE g.conv_id IS NOT DISTINCT FROM c.conv_id)""")
def q_min_rows(spark, sf_dir):
    c = _conv_text(spark, sf_dir).withColumnRenamed("conv_id", "speaker_id")
    return SP.min_rows_per_speaker(c, 5).select(F.col("speaker_id").alias("conv_id"), "turn")


@register("total_duration", "SELECT role AS speaker_id, round(sum(length(text) / 15.0::DOUBLE), 6) AS total_duration"
                            " FROM conversations GROUP BY role")
def q_total(spark, sf_dir):
    t = SP.total_duration(px.conversations_corpus(spark, sf_dir))
    return t.select("speaker_id", F.round("total_duration", 6).alias("total_duration"))


@register("voice_table", f"""
WITH f AS ({_filtered_c_sql()}),
g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM (SELECT speaker_id FROM f GROUP BY speaker_id HAVING count(*) >= 5) k
      WHERE k.speaker_id IS NOT DISTINCT FROM f.speaker_id)),
tot AS (SELECT speaker_id, sum(duration) AS total_duration FROM g GROUP BY speaker_id),
r AS (SELECT g.*, row_number() OVER (PARTITION BY speaker_id ORDER BY length(text) * duration DESC, source_no, pos) AS clip_rank FROM g)
SELECT r.speaker_id, CAST(r.clip_rank AS BIGINT) AS clip_rank, r.text, r.duration, r.clip_rank <= 5 AS is_conditioning,
       round(tot.total_duration, 6) AS total_duration
FROM r JOIN tot ON r.speaker_id IS NOT DISTINCT FROM tot.speaker_id""")
def q_voice_table(spark, sf_dir):
    v = C.voice_table(C.prepare_text(px.conversations_corpus(spark, sf_dir)))
    return v.select("speaker_id", "clip_rank", "text", "duration", "is_conditioning",
                    F.round("total_duration", 6).alias("total_duration"))


@register("top_clips_documents", f"""
SELECT speaker_id, doc_id, CAST(clip_rank AS BIGINT) AS clip_rank FROM (
  SELECT speaker_id, doc_id, row_number() OVER (PARTITION BY speaker_id ORDER BY length(text) * (n_chars / 15.0::DOUBLE) DESC, source_no, pos) AS clip_rank
  FROM ({DOCS_SQL})) WHERE clip_rank <= 5""")
def q_top_docs(spark, sf_dir):
    d = px.documents_corpus(spark, sf_dir).withColumn("duration", F.col("n_chars") / F.lit(15.0))
    return SP.top_clips(d, 5).select("speaker_id", "doc_id", "clip_rank")


@register("first_speakers", f"""
SELECT source AS speaker_id, min(pos) AS first_pos FROM ({DOCS_SQL}) GROUP BY source ORDER BY first_pos LIMIT 3""")
def q_first(spark, sf_dir):
    d = px.documents_corpus(spark, sf_dir).select(F.col("source").alias("speaker_id"), "source_no", "pos")
    return SP.first_speakers(d, 3).select("speaker_id", F.col("first_pos"))


# -- split, encoding, batches (R1, R2, T13, F7, K1, K2) ------------------------

from ..operators import batches as KB  # noqa: E402
from ..operators import encode as EN  # noqa: E402
from ..operators import split as SPL  # noqa: E402


@register("split_hash", "SELECT doc_id, CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT)"
                        " < 0.15 * 4294967296 AS is_test FROM documents")
def q_split_hash(spark, sf_dir):
    d, _ = SPL.assign_split(_docs(spark, sf_dir).select("doc_id"), 0.15, "doc_id", 42, exact=False)
    return d


@register("split_exact", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)"
                         " <= ceil((SELECT count(*) FROM documents) * 0.15) AS is_test FROM documents")
def q_split_exact(spark, sf_dir):
    d, _ = SPL.assign_split(_docs(spark, sf_dir).select("doc_id"), 0.15, "doc_id", 42, exact=True)
    return d


@register("split_unseeded", "SELECT doc_id, true AS consistent, true AS share_near_tenth FROM documents")
def q_split_unseeded(spark, sf_dir):
    """The seed is drawn, so no side can be foretold; that the recorded
    seed gives the same sides again, and that the test share lies within six
    standard deviations of a tenth, can."""
    docs = _docs(spark, sf_dir).select("doc_id")
    d, seed = SPL.assign_split(docs, 0.10, "doc_id", None, exact=False)
    again, _ = SPL.assign_split(d, 0.10, "doc_id", seed, exact=False, name="_again")
    share = d.agg((F.abs(F.avg(F.col("is_test").cast("int")) - 0.1)
                   <= 6 * F.sqrt(F.lit(0.09) / F.count("*"))).alias("share_near_tenth"))
    # one row
    return again.select("doc_id", (F.col("is_test") == F.col("_again")).alias("consistent")).crossJoin(
        F.broadcast(share))


def _vocab_ids_sql(table: str) -> str:
    return f"SELECT ch, CAST(row_number() OVER (ORDER BY ch) + 1 AS INTEGER) AS id FROM ({_vocab_sql(table)})"


def _encoded_sql(table: str, key: str, vocab_table: str) -> str:
    return f"""SELECT t.{key}, coalesce(e.input_ids, []::INTEGER[]) AS input_ids FROM {table} t LEFT JOIN (
  SELECT {key}, list(coalesce(v.id, 1) ORDER BY i) AS input_ids FROM (
    SELECT {key}, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM {table}) c
  LEFT JOIN ({_vocab_ids_sql(vocab_table)}) v ON v.ch = c.ch WHERE c.ch <> '' GROUP BY {key}) e ON e.{key} = t.{key}"""


def _encode(spark, sf_dir, frame, vocab_source):
    ids = EN.vocab_ids(SP.char_vocab(vocab_source))
    return EN.encode_chars(frame, "text", ids)


@register("encode_chars", f"SELECT doc_id, input_ids FROM ({_encoded_sql('documents', 'doc_id', 'conversations')})")
def q_encode(spark, sf_dir):
    return _encode(spark, sf_dir, _docs(spark, sf_dir), _conv_text(spark, sf_dir)).select("doc_id", "input_ids")


def _conv_keyed_sql() -> str:
    return "(SELECT conv_id * 100000 + turn AS ck, * FROM conversations)"


@register("token_len_filter", f"""
SELECT ck, len(input_ids) < 300 AS below_300, len(input_ids) <= 250 AS at_most_250
FROM ({_encoded_sql(_conv_keyed_sql(), 'ck', 'conversations')})""")
def q_token_len(spark, sf_dir):
    c = _conv_text(spark, sf_dir).withColumn("ck", F.col("conv_id") * 100000 + F.col("turn"))
    e = _encode(spark, sf_dir, c, _conv_text(spark, sf_dir))
    return e.select("ck", P.token_len_below("input_ids", 300).alias("below_300"),
                    P.token_len_below("input_ids", 251).alias("at_most_250"))


def _frames(ids: str = "input_ids"):
    """Label frames derived from the ids: pairs (ids[2i], ids[2i+1])."""
    n = F.floor(F.size(ids) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(
        F.element_at(ids, 2 * i + 1).cast("float"), F.element_at(ids, 2 * i + 2).cast("float")))) \
        .otherwise(F.array().cast("array<array<float>>"))


def _frames_sql(ids: str = "input_ids") -> str:
    return (f"CASE WHEN len({ids}) // 2 > 0 THEN list_transform(range(0, len({ids}) // 2), lambda i: "
            f"[CAST({ids}[2 * i + 1] AS FLOAT), CAST({ids}[2 * i + 2] AS FLOAT)]) ELSE []::FLOAT[][] END")


def _batches_sql(reduction: int) -> str:
    lab = "concat(labels, list_transform(range(0, mx_lab - len(labels)), lambda j: list_transform(range(0, width), lambda q: CAST(-100.0 AS FLOAT))))"
    if reduction > 1:
        lab = f"list_slice({lab}, 1, mx_lab_r)"
    return f"""
WITH e AS (SELECT ck, input_ids FROM ({_encoded_sql(_conv_keyed_sql(), 'ck', 'conversations')}) WHERE len(input_ids) < 300),
n AS (SELECT ck, input_ids, {_frames_sql()} AS labels, row_number() OVER (ORDER BY ck) AS rn FROM e),
b AS (SELECT *, CAST((rn - 1) // 8 AS BIGINT) AS batch_no, CAST((rn - 1) % 8 AS INTEGER) AS batch_pos FROM n),
m AS (SELECT batch_no, max(len(input_ids)) AS mx_ids, max(len(labels)) AS mx_lab,
             max(len(labels) - len(labels) % {reduction}) AS mx_lab_r, coalesce(max(len(labels[1])), 0) AS width FROM b GROUP BY batch_no)
SELECT ck, b.batch_no, batch_pos,
       concat(input_ids, list_transform(range(0, mx_ids - len(input_ids)), lambda j: 0)) AS input_ids,
       {lab} AS labels
FROM b JOIN m ON b.batch_no = m.batch_no"""


def _batches(spark, sf_dir, reduction: int):
    c = _conv_text(spark, sf_dir).withColumn("ck", F.col("conv_id") * 100000 + F.col("turn"))
    e = _encode(spark, sf_dir, c, _conv_text(spark, sf_dir)).where(P.token_len_below("input_ids", 300))
    e = e.select("ck", "input_ids").withColumn("labels", _frames())
    b = KB.pad_batches(e, 8, ["ck"], reduction=reduction)
    return b.select("ck", "batch_no", "batch_pos", "input_ids", "labels")


@register("pad_batches", _batches_sql(1))
def q_batches(spark, sf_dir):
    return _batches(spark, sf_dir, 1)


@register("pad_batches_reduction", _batches_sql(2))
def q_batches_r(spark, sf_dir):
    return _batches(spark, sf_dir, 2)


# -- stages, export, pipelines (S4, S5, entries 1-3) ---------------------------

import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir, stable  # noqa: E402
from ..sources import export as EX  # noqa: E402
from ..sources import stages as ST  # noqa: E402
from . import base as A  # noqa: E402
from . import enhanced as B  # noqa: E402


def _scratch(spark, what: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


@register("stage_roundtrip", f"SELECT doc_id, {S.normalize_text_b('text')} AS text FROM documents")
def q_stage(spark, sf_dir):
    root = _scratch(spark, "stages")
    build = lambda: _docs(spark, sf_dir).select("doc_id", T.normalize_text_b("text").alias("text"))
    first = ST.stage(spark, "normalized", build, root, {"normalizer": "b", "sf": sf_dir})
    again = ST.stage(spark, "normalized", build, root, {"normalizer": "b", "sf": sf_dir})
    assert not first.reused and again.reused and again.path == first.path
    return again.df


@register("voices_export", f"""
WITH f AS ({_filtered_c_sql()}),
g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM (SELECT speaker_id FROM f GROUP BY speaker_id HAVING count(*) >= 5) k
      WHERE k.speaker_id IS NOT DISTINCT FROM f.speaker_id)),
r AS (SELECT g.*, row_number() OVER (PARTITION BY speaker_id ORDER BY length(text) * duration DESC, source_no, pos) AS clip_rank FROM g)
SELECT speaker_id, CAST(clip_rank - 1 AS INTEGER) AS clip_no, text FROM r WHERE clip_rank <= 5""")
def q_export(spark, sf_dir):
    prepared = C.prepare_text(px.conversations_corpus(spark, sf_dir))
    cond = C.conditioning_clips(prepared)
    path = _scratch(spark, "voices")
    EX.write_voices(cond, path)
    back = EX.read_voices(spark, path)
    return back.select("speaker_id", "clip_no", "text")


def _uid(df):
    return df.withColumn("uid", F.col("source_no").cast("long") * F.lit(10 ** 12) + F.col("pos"))


def _voices(spark, sf_dir) -> DataFrame:
    """The events' signals in segments, by ``voice`` (the user's id)."""
    return _event_segments(spark, sf_dir).select(F.col("speaker_id").cast("long").alias("voice"), "clip_no", "x")


def _segments(spark, sf_dir) -> SEG.Segments:
    # Put together from single samples, so kept for the several reads.
    return SEG.Segments(functools.cache(lambda: stable(_voices(spark, sf_dir))), "voice",
                        reads=(px.table_path(sf_dir, "events"),))


def _voiced(spark, sf_dir, key: str):
    """Adapter that gives a text row a voice and a vector. With n users the
    voice is ``key`` modulo n + n / 10: one in eleven rows has the voice of
    no user, so no signal, and is rejected for that."""
    def adapt(df):
        users = px.table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("_n"))  # one row
        vectors = px.embeddings_table(spark, sf_dir).select(
            F.col("vec_id").alias("_vec"), F.transform("embedding", lambda v: v.cast("double") * 3).alias("vector"))
        out = df.crossJoin(F.broadcast(users)).withColumn("voice", F.expr(f"{key} % (_n + _n div 10)")).drop("_n")
        return _uid(out.join(vectors, F.col(key) == F.col("_vec"), "left").drop("_vec"))
    return adapt


VOICED_SQL = f"""
clips AS (SELECT CAST(speaker_id AS BIGINT) AS _user, x FROM ({_clips_sql()}) WHERE clip_no = 0),
users AS (SELECT count(DISTINCT user_id) AS n FROM events),
raw AS (SELECT text, lang AS speaker_id, 0 AS source_no, row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id AS k FROM documents
        UNION ALL SELECT text, role, 1, row_number() OVER (ORDER BY conv_id, turn) - 1, conv_id FROM conversations),
u AS (SELECT raw.*, x, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 3) AS vector,
             source_no * 1000000000000 + pos AS uid
      FROM raw CROSS JOIN users LEFT JOIN clips ON k % (n + n // 10) = _user LEFT JOIN embeddings ON vec_id = k)"""


def _voiced_sources(spark, sf_dir: str):
    """The two sources of the pipelines, with signals: the first kept whole
    (as the reference does), the second renamed and pruned."""
    keep = ["text", "speaker_id", "uid", "voice", "vector"]
    reads = [px.table_path(sf_dir, "events"), px.table_path(sf_dir, "embeddings")]
    return [
        SC.SourceSpec(px.table_path(sf_dir, "documents"), rename={"lang": "speaker_id"},
                      prepare=_voiced(spark, sf_dir, "doc_id"), reads=reads),
        SC.SourceSpec(px.table_path(sf_dir, "conversations"), rename={"role": "speaker_id"}, keep=keep,
                      prepare=_voiced(spark, sf_dir, "conv_id"), reads=reads),
    ]


def _pad_sql(src: str, order: str, reduction: int, key: str) -> str:
    """Batches of 8 per split side over ``src`` (key, split, input_ids)."""
    lab = ("concat(labels, list_transform(range(0, mx_lab - len(labels)), lambda j: "
           "list_transform(range(0, width), lambda q: CAST(-100.0 AS FLOAT))))")
    if reduction > 1:
        lab = f"list_slice({lab}, 1, mx_lab_r)"
    return f"""
n AS (SELECT *, {_frames_sql()} AS labels, row_number() OVER (PARTITION BY split ORDER BY {order}) AS rn FROM {src}),
b AS (SELECT *, CAST((rn - 1) // 8 AS BIGINT) AS batch_no, CAST((rn - 1) % 8 AS INTEGER) AS batch_pos FROM n),
m AS (SELECT split AS m_split, batch_no AS m_batch, max(len(input_ids)) AS mx_ids, max(len(labels)) AS mx_lab,
             max(len(labels) - len(labels) % {reduction}) AS mx_lab_r, coalesce(max(len(labels[1])), 0) AS width
      FROM b GROUP BY split, batch_no)
SELECT {key}, split, batch_no, batch_pos,
       concat(input_ids, list_transform(range(0, mx_ids - len(input_ids)), lambda j: 0)) AS input_ids,
       {lab} AS labels
FROM b JOIN m ON b.split = m.m_split AND b.batch_no = m.m_batch"""


def _split_side_sql(key: str, seed: int, fraction: float) -> str:
    return (f"CASE WHEN CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"
            f" < {fraction!r} * 4294967296 THEN 'test' ELSE 'train' END")


# A row that is long enough but has no signal is "no_result".
_B_REASON_SQL = _reason_sql().replace("THEN 'text_length'", "THEN 'text_length' WHEN x IS NULL THEN 'no_result'", 1)
_B_TEXT_SQL = f"""{VOICED_SQL},
nb AS (SELECT uid, source_no, pos, speaker_id, {S.normalize_text_b('text')} AS text, len(x) / {EVENT_RATE}::DOUBLE AS duration,
              x, vector FROM u)"""
_PIPELINE_B_SQL = f"""
WITH {_B_TEXT_SQL},
k0 AS (SELECT * FROM nb WHERE {_reason_sql()} IS NULL),
k AS (SELECT k0.*, c.y AS signal FROM k0 JOIN ({_chain_b_sql('SELECT CAST(uid AS VARCHAR) AS speaker_id, 0 AS clip_no, x FROM k0', EVENT_RATE)}) c
      ON c.speaker_id = CAST(uid AS VARCHAR) WHERE len(c.y) >= {_MIN_B}),
enc AS ({_encoded_sql('k', 'uid', 'conversations')}),
s AS (SELECT k.uid, k.source_no, k.pos, enc.input_ids, signal, {S.l2_normalize('vector')} AS speaker_embedding,
             {_split_side_sql('k.uid', 42, 0.15)} AS split
      FROM k JOIN enc ON k.uid = enc.uid WHERE len(enc.input_ids) <= 250 AND len(enc.input_ids) < 300),
{_pad_sql('s', 'source_no, pos', 1, 'uid, signal, speaker_embedding')}"""


def _signal_b(spark, sf_dir) -> B.SignalSpec:
    return B.SignalSpec(None, EVENT_RATE, FC_B, _MIN_B, _segments(spark, sf_dir))


def _run_b(spark, sf_dir, **more):
    return B.run(spark, _voiced_sources(spark, sf_dir), SP.char_vocab(_conv_text(spark, sf_dir)), "uid",
                 signal=_signal_b(spark, sf_dir), **more)


@register("pipeline_enhanced", _PIPELINE_B_SQL)
def q_pipeline_b(spark, sf_dir):
    """Entry 2 end to end, signals cleaned, through stages."""
    res = _run_b(spark, sf_dir, labels=_frames(), vector_col="vector", stage_root=_scratch(spark, "enhanced"))
    return res.batches.select("uid", "split", "batch_no", "batch_pos", "input_ids", "labels", "signal",
                              "speaker_embedding")


def _funnel_b_sql(conditions: list[tuple[str, str]], source: str) -> str:
    rows = [f"(0, 'input', (SELECT count(*) FROM {source}))"]
    for i, (name, _) in enumerate(conditions, start=1):
        where = " AND ".join(f"coalesce({c}, false)" for _, c in conditions[:i])
        rows.append(f"({i}, '{name}', (SELECT count(*) FROM {source} WHERE {where}))")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(stage_no, stage, n_rows)"


@register("pipeline_enhanced_funnel",
          f"WITH {_B_TEXT_SQL} " + _funnel_b_sql([*_FUNNEL_B, ("special_chars", f"{_reason_sql()} IS NULL")], "nb"))
def q_pipeline_b_funnel(spark, sf_dir):
    return _run_b(spark, sf_dir, with_batches=False).funnel


@register("pipeline_enhanced_rejects", f"""
WITH {_B_TEXT_SQL},
k0 AS (SELECT *, {_B_REASON_SQL} AS reason FROM nb)
SELECT uid, reason AS reject_reason FROM k0 WHERE reason IS NOT NULL
UNION ALL
SELECT uid, CASE WHEN c.y IS NULL THEN 'no_result' ELSE 'too_short' END FROM k0
JOIN ({_chain_b_sql('SELECT CAST(uid AS VARCHAR) AS speaker_id, 0 AS clip_no, x FROM k0 WHERE reason IS NULL', EVENT_RATE)}) c
ON c.speaker_id = CAST(uid AS VARCHAR) WHERE c.y IS NULL OR len(c.y) < {_MIN_B}""")
def q_pipeline_b_rejects(spark, sf_dir):
    return _run_b(spark, sf_dir, with_batches=False).rejects


_PIPELINE_A_SQL = f"""
WITH f AS (SELECT doc_id, lang AS speaker_id, {S.fold_vowels('text')} AS text FROM documents),
k AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM (SELECT speaker_id FROM f GROUP BY speaker_id
      HAVING count(*) BETWEEN 100 AND 400) g WHERE g.speaker_id IS NOT DISTINCT FROM f.speaker_id)),
enc AS ({_encoded_sql('k', 'doc_id', 'conversations')}),
s AS (SELECT k.doc_id, k.speaker_id, enc.input_ids, {_split_side_sql('k.doc_id', 7, 0.1)} AS split
      FROM k JOIN enc ON k.doc_id = enc.doc_id WHERE len(enc.input_ids) < 300),
{_pad_sql('s', 'doc_id', 2, 'doc_id, speaker_id')}"""


@register("pipeline_base", _PIPELINE_A_SQL)
def q_pipeline_a(spark, sf_dir):
    """Entry 1 end to end on documents (speaker = lang), reference
    vocabulary from conversations; fixed seed so reruns agree."""
    corpus = px.documents_corpus(spark, sf_dir)
    res = A.run(corpus, SP.char_vocab(_conv_text(spark, sf_dir)), "doc_id", labels=_frames(), seed=7)
    return res.batches.select("doc_id", "speaker_id", "split", "batch_no", "batch_pos", "input_ids", "labels")


@register("pipeline_base_report", f"""
SELECT CAST((SELECT count(*) FROM ({_vocab_sql('documents')})) AS BIGINT) AS dataset_vocab_size,
       CAST((SELECT count(*) FROM ({_vocab_sql('conversations')})) AS BIGINT) AS reference_vocab_size,
       (SELECT count(*) FROM (SELECT lang FROM documents GROUP BY lang)) AS n_speakers,
       (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM (SELECT lang FROM documents GROUP BY lang
          HAVING count(*) BETWEEN 100 AND 400) g WHERE g.lang IS NOT DISTINCT FROM d.lang)) AS kept_rows""")
def q_pipeline_a_report(spark, sf_dir):
    corpus = px.documents_corpus(spark, sf_dir)
    res = A.run(corpus, SP.char_vocab(_conv_text(spark, sf_dir)), "doc_id", seed=7, with_batches=False)
    a = res.vocab_sizes
    b = res.speaker_summary.select("n_speakers")
    c = res.kept_summary.select(F.col("n_rows").alias("kept_rows"))
    return a.crossJoin(b).crossJoin(c)  # one row each


#: the voices pipeline's rate on the proxy signals, at the reference's ratio
RATE_C_PROXY = 11
FC_C_PROXY = N.HIGHPASS_C / N.RATE_C * RATE_C_PROXY


def _signal_c(spark, sf_dir) -> C.SignalSpec:
    return C.SignalSpec(None, EVENT_RATE, RATE_C_PROXY, FC_C_PROXY, _segments(spark, sf_dir))


_VOICES_SQL = f"""{VOICED_SQL},
t AS (SELECT * FROM (SELECT uid, {S.normalize_text_c('text')} AS text, speaker_id, source_no, pos, x FROM u)
      WHERE length(text) BETWEEN 10 AND 200),
p AS (SELECT t.* EXCLUDE (x), c.y AS signal, len(c.y) / {RATE_C_PROXY}::DOUBLE AS duration FROM t JOIN (
      {_chain_c_sql(f"SELECT CAST(uid AS VARCHAR) AS speaker_id, 0 AS clip_no, {S.resample('x', EVENT_RATE, RATE_C_PROXY)} AS x FROM t", RATE_C_PROXY, FC_C_PROXY)}) c
      ON c.speaker_id = CAST(uid AS VARCHAR)),
f AS (SELECT * FROM p WHERE duration BETWEEN 2.0 AND 15.0)"""


@register("utterance_record_audio", f"""
WITH {_VOICES_SQL}
SELECT uid, {{'text': text, 'audio': signal, 'speaker_id': speaker_id, 'duration': duration, 'sample_rate': {RATE_C_PROXY}}} AS record
FROM f""")
def q_record_audio(spark, sf_dir):
    """P6 with its audio: the cleaned signal, its rate and its duration."""
    prepared = C.run(spark, _voiced_sources(spark, sf_dir), signal=_signal_c(spark, sf_dir)).prepared
    return prepared.select("uid", C.utterance_record().alias("record"))


@register("pipeline_voices", f"""
WITH {_VOICES_SQL},
g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM (SELECT speaker_id FROM f GROUP BY speaker_id HAVING count(*) >= 5) k
      WHERE k.speaker_id IS NOT DISTINCT FROM f.speaker_id)),
tot AS (SELECT speaker_id, sum(duration) AS total_duration FROM g GROUP BY speaker_id),
r AS (SELECT g.*, row_number() OVER (PARTITION BY speaker_id ORDER BY length(text) * duration DESC, source_no, pos) AS clip_rank FROM g)
SELECT r.speaker_id, CAST(clip_rank - 1 AS INTEGER) AS clip_no, text, duration, signal, {RATE_C_PROXY} AS sample_rate
FROM r WHERE clip_rank <= 5""")
def q_pipeline_c(spark, sf_dir):
    """Entry 3 end to end, signals resampled and cleaned; the rows are read
    back from the per-speaker export."""
    path = _scratch(spark, "voices")
    C.run(spark, _voiced_sources(spark, sf_dir), export_path=path, signal=_signal_c(spark, sf_dir),
          stage_root=_scratch(spark, "voices-stages"))
    return EX.read_voices(spark, path).select("speaker_id", "clip_no", "text", "duration", "signal", "sample_rate")


@register("signal_prepare", f"""
SELECT speaker_id, clip_no, c.y AS prep_c,
  CASE WHEN c.y IS NULL THEN 'no_result' WHEN NOT (len(c.y) / {EVENT_RATE}::DOUBLE BETWEEN 2.0 AND 15.0) THEN 'duration' END AS reason_c,
  CASE WHEN b.y IS NULL THEN 'no_result' WHEN NOT (len(b.y) >= {_MIN_B}) THEN 'too_short' END AS reason_b
FROM ({_chain_b_sql(_clips_sql(), EVENT_RATE)}) b JOIN ({_chain_c_sql(_clips_sql(), EVENT_RATE)}) c
USING (speaker_id, clip_no)""")
def q_signal_prepare(spark, sf_dir):
    """Clean both ways, then the reject reasons: C drops a null
    result or a duration outside 2..15 s; B needs 0.5 s."""
    c = _clean_both(spark, sf_dir)
    c = Q.prepare_or_reject(c, F.col("clean_b"), [(~P.min_samples("prep_b", _MIN_B), "too_short")], out_col="prep_b") \
        .withColumnRenamed("reject_reason", "reason_b")
    c = Q.prepare_or_reject(c, F.col("clean_c"), [
        (~P.duration_between(N.duration("prep_c", EVENT_RATE), 2.0, 15.0), "duration")], out_col="prep_c")
    return c.select("speaker_id", "clip_no", "prep_c", F.col("reject_reason").alias("reason_c"), "reason_b")


@register("voice_conditioning_nested", f"""
WITH f AS ({_filtered_c_sql()}),
g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM (SELECT speaker_id FROM f GROUP BY speaker_id HAVING count(*) >= 5) k
      WHERE k.speaker_id IS NOT DISTINCT FROM f.speaker_id)),
r AS (SELECT g.*, row_number() OVER (PARTITION BY speaker_id ORDER BY length(text) * duration DESC, source_no, pos) AS clip_rank FROM g),
st AS (SELECT speaker_id, count(*) AS n_clips, round(sum(duration), 6) AS total_duration FROM g GROUP BY speaker_id),
nest AS (SELECT speaker_id, list({{'clip_rank': CAST(clip_rank AS BIGINT), 'text': text, 'duration': duration}} ORDER BY clip_rank)
         AS conditioning_samples FROM r WHERE clip_rank <= 5 GROUP BY speaker_id)
SELECT nest.speaker_id, conditioning_samples, n_clips, total_duration
FROM nest JOIN st ON nest.speaker_id IS NOT DISTINCT FROM st.speaker_id""")
def q_nested(spark, sf_dir):
    """G9 nested form: only the best 5 clips per speaker are gathered."""
    prepared = C.prepare_text(px.conversations_corpus(spark, sf_dir))
    good = SP.min_rows_per_speaker(prepared, 5)
    t = SP.conditioning_table(good, 5)
    return t.select("speaker_id", "conditioning_samples", "n_clips",
                    F.round("total_duration", 6).alias("total_duration"))
