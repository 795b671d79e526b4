"""Operator 12, information-theoretic sanitisation of personal data.

Rules find the entities to protect: addresses, network addresses, card and
telephone numbers. Masking them is not enough where the words beside them
give them away. The corpus says which words do: the information that a term
t gives about an entity c, ln(P(t, c) / (P(t) P(c))), is set against the
information that c itself holds, ln(1 / P(c)). With document counts,

    disclosure(t, c) = 1 - ln(n_t / n_tc) / ln(N / n_c)

where n_tc counts documents with t within ``WINDOW`` terms of c, n_t and n_c
documents with t and with c at all, N all documents. It is 1 where t never
comes without c, and 0 where the two are independent. Terms of at least
``DISCLOSURE`` that stand beside c in at least ``SUPPORT`` documents give
the entity away. Such a term is generalised: cut to its first half, else to
its first letter, whichever first falls below the threshold (counting all
terms that the cut form stands for); if neither does, it is removed.

A term is a run of letters and digits, in lower case, outside the spans of
the rules; of one longer than ``LONGEST`` the rest is told apart by a
digest. Counts are over all rows, copies included.

Defined results: null texts count as empty; repeated rows and null ids are
rows of their own; an entity that is in every document cannot be given
away; an empty table gives no rows; other columns are not read, or come back
as they are."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, table, with_lookup
from .tokens import byte_slices

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
WINDOW, SUPPORT, DISCLOSURE = 8, 3, 0.95
LONGEST = 48
# Terms that a task counts before it hands the counts on; it bounds memory.
HELD_TERMS = 200_000

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
# Runs of number groups, longer than an address or a card where they go on.
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W_]+")

FOUND = ("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,"
         "spans:array<struct<kind:string,start:int,end:int>>,entities:array<binary>,"
         "contexts:array<struct<entity:binary,term:string,start:int,end:int,first:boolean>>>")
FOUND_ARROW = pa.struct([
    ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ("entities", pa.list_(pa.binary())),
    ("contexts", pa.list_(pa.struct([("entity", pa.binary()), ("term", pa.string()), ("start", pa.int32()),
                                     ("end", pa.int32()), ("first", pa.bool_())])))])


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Around every @: the run of letters before it and the domain after."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            yield start, last, text[start:last].lower()
        at = text.find("@", last)


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Every four groups of a dotted run, if none is above 255."""
    for m in DOTTED.finditer(text):
        groups, at = m.group().split("."), m.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k:k + 4]
            end = at + sum(map(len, four)) + 3
            values = [g.lstrip("0") or "0" for g in four]
            if all(len(v) <= 3 and int(v) <= 255 for v in values):
                yield at, end, ".".join(values)
            at = end + 1


def passes_luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int, str]]:
    for m in DIGITS.finditer(text):
        digits = NOT_DIGITS.sub("", m.group())
        if len(digits) <= 19 and passes_luhn(digits):
            yield m.start(), m.end(), digits


def phones(text: str) -> Iterator[tuple[int, int, str]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = NOT_DIGITS.sub("", m.group())
            if 9 <= len(digits) <= 15:
                yield m.start(), m.end(), digits


RULES = (emails, addresses, cards, phones)


def term_key(term: str) -> str:
    term = term.lower()
    if len(term) <= LONGEST:
        return term
    return f"{term[:LONGEST]}#{blake2b(term.encode(), digest_size=8).hexdigest()}"


def entities_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, entity) of the rules' matches, in order. Entities
    are digests, so that no table of counts holds personal data."""
    return sorted((start, kind, end, blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=16).digest())
                  for kind, rule in enumerate(RULES) for start, end, value in rule(text))


def terms_outside(text: str, spans: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the terms that overlap none of ``spans``."""
    at = reach = 0
    for m in TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if m.start() >= reach:
            yield m.start(), m.end(), term_key(m.group())


def contexts_of(text: str, spans: list[tuple[int, int, int, bytes]], window: int) -> list[tuple]:
    """(entity, term, start, end, first) for the terms within ``window`` of
    each entity; ``first`` marks the first of a text with the same entity
    and term."""
    starts, ends, keys = zip(*found) if (found := list(terms_outside(text, spans))) else ((), (), ())
    near, seen = {}, set()
    for start, _, end, entity in spans:
        left, right = bisect_left(starts, start), bisect_left(starts, end)
        for i in [*range(max(left - window, 0), left), *range(right, min(right + window, len(starts)))]:
            near.setdefault((entity, i))
    out = []
    for entity, i in near:
        pair = entity, keys[i]
        out.append((entity, keys[i], starts[i], ends[i], pair not in seen))
        seen.add(pair)
    return out


def found_in(text: Column, window: int = WINDOW) -> Column:
    @F.arrow_udf(FOUND)
    def found(column: pa.Array) -> pa.Array:
        parts = [pa.array([], FOUND_ARROW)]
        for part in byte_slices(column):
            rows = []
            for raw in part:
                text = raw.decode()
                spans = entities_of(text)
                n = Counter(kind for _, kind, _, _ in spans)
                rows.append({"n_email": n[0], "n_ip": n[1], "n_card": n[2], "n_phone": n[3],
                             "spans": [{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in spans],
                             "entities": list({entity for _, _, _, entity in spans}),
                             "contexts": [dict(zip(("entity", "term", "start", "end", "first"), c))
                                          for c in contexts_of(text, spans, window)] if spans else []})
            parts.append(pa.array(rows, FOUND_ARROW))
        return pa.concat_arrays(parts)
    return found(text)


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many rows each term is, outside the rules' spans."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in byte_slices(batch.column(0)):
                for raw in part:
                    text = raw.decode()
                    if spans := entities_of(text):
                        held.update({term for _, _, term in terms_outside(text, spans)})
                        continue
                    terms = map(str.lower, set(TERM.findall(text)))
                    held.update({t if len(t) <= LONGEST else term_key(t) for t in terms})
                if len(held) >= HELD_TERMS:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    def counted(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                          ["term", "n"])

    return docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _looked_up(scratch: Scratch, rows: DataFrame, values: DataFrame, keys: list[str], spread_by: str, name: str) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per ``keys``), of
    which only the keys in use are kept."""
    used = scratch.write(values.join(rows.select(*keys).distinct(), keys, "left_semi"), name)
    return with_lookup(rows, used, keys, F.col(spread_by))


def cut_forms(term: Column) -> list[Column]:
    """The forms that a term is generalised to, the closest first."""
    return [F.concat(F.substring(term, F.lit(1), F.ceil(F.length(term) / 2).cast("int")), F.lit("*")),
            F.concat(F.substring(term, 1, 1), F.lit("*"))]


def disclosing_terms(scratch: Scratch, found: DataFrame, terms: DataFrame, support: int = SUPPORT,
                     threshold: float = DISCLOSURE) -> DataFrame:
    """(entity, term, replacement): the terms of ``found`` (written) that
    give an entity away, and the form that does not; "" where none."""
    total = found.count()
    holders = scratch.write(found.select(F.explode("entities").alias("entity")).groupBy("entity")
                            .agg(F.count(F.lit(1)).alias("n_entity")), "entities")
    near = found.select(F.explode("contexts").alias("_c")).where("_c.first").select("_c.entity", "_c.term")
    joint = scratch.write(near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")), "joint")

    def disclosure(n: str, both: str) -> Column:
        held = F.log(F.lit(float(total)) / F.col("n_entity"))
        return F.when(held > 0, 1 - F.log(F.col(n) / F.col(both)) / held).otherwise(F.lit(0.0))

    likely = scratch.write(joint.where(F.col("n_both") >= support), "likely")
    likely = _looked_up(scratch, likely, holders, ["entity"], "term", "entities-used")
    likely = _looked_up(scratch, likely, terms, ["term"], "entity", "terms-used")
    chosen = scratch.write(likely.where(disclosure("n", "n_both") >= threshold), "disclosing")
    replacement = F.lit("")
    for level in reversed(range(len(cut_forms(F.col("term"))))):
        def formed(df: DataFrame) -> DataFrame:
            return df.withColumn("form", cut_forms(F.col("term"))[level])
        apart = formed(terms).groupBy("form").agg(F.sum("n").alias(f"_n{level}"))
        both = formed(joint).groupBy("entity", "form").agg(F.sum("n_both").alias(f"_both{level}"))
        chosen = _looked_up(scratch, formed(chosen), apart, ["form"], "entity", f"forms-{level}")
        chosen = _looked_up(scratch, chosen, both, ["entity", "form"], "term", f"forms-joint-{level}")
        replacement = F.when(disclosure(f"_n{level}", f"_both{level}") < threshold, cut_forms(F.col("term"))[level]) \
            .otherwise(replacement)
    out = scratch.write(chosen.select("entity", "term", replacement.alias("replacement")), "replacements")
    scratch.drop("entities", "joint", "likely", "entities-used", "terms-used", "disclosing",
                 *[f"forms-{x}{level}" for x in ("", "joint-") for level in range(len(cut_forms(F.col("term"))))])
    return out


def protected(scratch: Scratch, docs: DataFrame, carried: list[str], text_col: str = "text", window: int = WINDOW,
              support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """(_doc, n_email, n_ip, n_card, n_phone, spans) per row of ``docs``:
    the columns ``carried`` as a struct, the counts of the rules, and all
    spans by start and kind, with what replaces them; ``base`` marks those
    of the rules."""
    base = docs.select(F.struct(*carried).alias("_doc"), found_in(F.col(text_col), window).alias("_found"))
    base = scratch.write(base.select(F.monotonically_increasing_id().alias("_row"), "_doc", "_found.*"), "found")
    terms = scratch.write(vocabulary(docs, text_col), "vocabulary")
    replacements = disclosing_terms(scratch, base.select("entities", "contexts"), terms, support, threshold)
    scratch.drop("vocabulary")
    beside = base.select("_row", F.explode("contexts").alias("_c")).select("_row", "_c.entity", "_c.term", "_c.start", "_c.end")
    # One word may give several entities away: the shortest form stays.
    added = with_lookup(beside, replacements, ["entity", "term"], F.col("_row"), "inner") \
        .groupBy("_row", "start", "end").agg(F.min(F.struct(F.length("replacement"), "replacement"))["replacement"].alias("replacement"))
    added = added.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("_added"))

    def span(kind: Column, rank: Column, s: Column, replacement: Column, base: bool) -> Column:
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), kind.alias("kind"),
                        replacement.alias("replacement"), F.lit(base).alias("base"))

    kinds = F.array(*[F.lit(k) for k in KINDS])
    rules = F.transform("spans", lambda s: span(s["kind"], F.array_position(kinds, s["kind"]).cast("int"), s,
                                                F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")), True))
    learned = F.transform("_added", lambda s: span(
        F.when(s["replacement"] == "", REMOVED).otherwise(GENERALISED),
        F.when(s["replacement"] == "", len(KINDS) + 2).otherwise(len(KINDS) + 1), s, s["replacement"], False))
    spans = F.array_sort(F.concat(rules, F.coalesce(learned, F.array())))
    return base.join(added, "_row", "left").select(
        "_doc", *[f"n_{k}" for k in KINDS],
        F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                              s["replacement"].alias("replacement"), s["base"].alias("base"))).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    @F.arrow_udf(StringType())
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for i in range(len(texts)):
            text = texts[i].as_py()
            if text is None or not len(spans[i].values):
                out.append(text)
                continue
            parts, last = [], 0
            for s in spans[i].as_py():
                if s["start"] >= last:
                    parts += [text[last:s["start"]], s["replacement"]]
                last = max(last, s["end"])
            out.append("".join([*parts, text[last:]]))
        return pa.array(out, pa.string())
    return run(text, spans)


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the same rows and columns and sanitised texts: spans of
    the rules become their kind, terms that give entities away their general
    form or nothing. Null texts stay null."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    found = protected(scratch, docs, docs.columns, text_col, **options)
    doc = F.col("_doc").withField(text_col, _replaced(F.col("_doc")[text_col], F.col("spans")))
    return found.select(doc.alias("_doc")).select("_doc.*")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row (``id_col``, n_email, n_ip, n_card, n_phone, spans) per row of
    ``docs``; spans are in code points, ends exclusive."""
    found = protected(Scratch(docs.sparkSession, "private-spans"), docs, [id_col], text_col, **options)
    return found.select(F.col("_doc")[id_col].alias(id_col), *[f"n_{k}" for k in KINDS], "spans")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(private_spans(table(spark, sf_dir, "documents")))
