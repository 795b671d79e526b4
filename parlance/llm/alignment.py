"""Operator 11, alignment of two tokenizers over the same bytes.

A text is encoded by both. Where a token of the one and a token of the other
end at the same byte, the text can be cut; the pieces between two cuts are
groups of tokens that stand for each other. The cuts are found by divide and
conquer: in every open interval the end nearest its middle is looked for that
both share, by bisection in the other tokenizer's ends; the interval falls
into the halves beside it, which are searched in turn, and an interval
without a shared end is one group. Ends known not to be shared are not looked
at again, so each is tried once. All intervals of a slice of texts are
searched side by side.

Two tokens are linked when their byte ranges overlap: the ends of both cut a
text into segments, and each segment lies in one token of either. For every
pair of ids the documents that link it are counted over the whole corpus, and
each document's links are looked up in the counts. The pairs with most
documents, at most ``HOT_PAIRS``, hold most links; they are broadcast. Each
of the others is in few documents by then (below the count of the last hot
pair), so shuffling them by pair fills no task.

Defined results: texts that are null or empty, and those whose tokens of
either kind do not join to the space and the text, have no tokens: zeros and
an empty ``groups``. Repeated rows and null ids are rows of their own."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .tokens import Memo, byte_slices

# Most pairs that are broadcast, some 6 MB.
HOT_PAIRS = 1 << 18
# Words kept in memory by a worker, twice over: some 180 MB at most.
WORDS = 300_000
# Words encoded in one run.
RUN_WORDS = 256
# Probes beside the middle before the rest of an interval is tried at once.
PROBES = 32

INNER_SPACE = re.compile(r"\S ")
SPACE_AFTER_SPACE = re.compile(r"\s ")
WORD_BREAK = re.compile(r"(?<=\S)(?= +[^ ])")

ALIGNED = ("n_a long, n_b long, n_groups long, n_links long, groups string,"
           " pair_a array<int>, pair_b array<int>, pair_links array<int>")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable bytes stand for themselves, the others, in order, for the
    letters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Pieces:
    """One tokenizer: ``encode`` gives the ids of texts that begin with a
    space, ``of[id]`` the id's bytes. ``apart`` tells that no token joins a
    letter to a space after it, so that a text can be encoded word by word."""
    encode: Callable[[list[str]], list[list[int]]]
    of: list[bytes]
    apart: bool = True

    def __post_init__(self):
        self.sizes = np.array([len(p) for p in self.of], np.int64)
        self.apart = self.apart and not any(INNER_SPACE.search(p.decode(errors="replace")) for p in self.of)

    def alone(self, text: str) -> bytes | None:
        """The packed ids of a text and a space before it; None where they
        do not join to it."""
        ids = self.encode([" " + text])[0]
        return array("I", ids).tobytes() if b"".join(map(self.of.__getitem__, ids)) == (" " + text).encode() else None

    def words(self, words: list[str]) -> list[bytes | None]:
        """:meth:`alone` for many words: those that end in a letter are
        encoded one behind the other, since nothing joins them, and the ids
        cut where the words end."""
        out: dict[int, bytes | None] = {i: self.alone(w) for i, w in enumerate(words) if not w or w[-1].isspace()}
        rest = [i for i in range(len(words)) if i not in out]
        runs = [rest[at:at + RUN_WORDS] for at in range(0, len(rest), RUN_WORDS)]
        texts = ["".join(" " + words[i] for i in run) for run in runs]
        for run, text, ids in zip(runs, texts, self.encode(texts)):
            ends = np.cumsum(self.sizes[ids])
            want = np.cumsum([len(words[i].encode()) + 1 for i in run])
            stop = np.searchsorted(ends, want)
            if b"".join(map(self.of.__getitem__, ids)) != text.encode() or not np.array_equal(ends[stop], want):
                out.update((i, self.alone(words[i])) for i in run)
                continue
            packed, at = array("I", ids).tobytes(), 0
            for i, end in zip(run, (4 * (stop + 1)).tolist()):
                out[i] = packed[at:end]
                at = end
        return [out[i] for i in range(len(words))]


def byte_level(path: str) -> Pieces:
    """A byte-level tokenizer of the tokenizers library; special tokens in a
    text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    byte = _byte_of_letter()
    of = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for piece, i in tokenizer.get_vocab().items():
        of[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return Pieces(encode, of, tokenizer.normalizer is None)


def sentence_pieces(path: str) -> Pieces:
    """A sentencepiece model, which puts a space before each text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    of = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        of.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Pieces(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), of)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places in ``ends_a``, ascending, of the ends that ``ends_b`` has
    too. Interval i holds the ends ``low[i]:high[i]`` and its last one,
    ``high[i]``, which is shared. Ends ascend."""
    def shared(places: np.ndarray) -> np.ndarray:
        wanted = ends_a[places]
        return ends_b[np.searchsorted(ends_b, wanted)] == wanted

    found = [high]
    while len(low):
        open_ = low < high
        low, high = low[open_], high[open_]
        middle = (low + high) // 2
        left, right = middle, middle + 1  # the next places to try on either side
        born_low, born_high = [], []
        for _ in range(PROBES):
            if not len(low):
                break
            hit_left = np.zeros(len(low), bool)
            can = left >= low
            hit_left[can] = shared(left[can])
            hit_right = np.zeros(len(low), bool)
            can = ~hit_left & (right < high)
            hit_right[can] = shared(right[can])
            # What lies between left and right has been tried: the halves
            # beside a cut keep what has not.
            if hit_left.any():
                found.append(left[hit_left])
                born_low += [low[hit_left], right[hit_left]]
                born_high += [left[hit_left], high[hit_left]]
            if hit_right.any():
                found.append(right[hit_right])
                born_low += [low[hit_right], right[hit_right] + 1]
                born_high += [left[hit_right], high[hit_right]]
            rest = ~(hit_left | hit_right)
            low, high, left, right = low[rest], high[rest], left[rest] - 1, right[rest] + 1
            rest = (left >= low) | (right < high)  # the others are leaves
            low, high, left, right = low[rest], high[rest], left[rest], right[rest]
        for lo, hi, le, ri in zip(low.tolist(), high.tolist(), left.tolist(), right.tolist()):
            # A long stretch without a shared end: what is left of it at once.
            places = np.concatenate([np.arange(lo, le + 1), np.arange(ri, hi)])
            found.append(places[shared(places)])
        low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (born_low, born_high))
    return np.sort(np.concatenate(found))


def words_of(text: str) -> list[str]:
    """A text that begins with a space, cut before each space that follows
    another kind of letter, without the spaces cut at. White space stays
    together, as do the spaces that end a text."""
    if SPACE_AFTER_SPACE.search(text, 1) is None and text[-1] != " ":
        return text[1:].split(" ")
    return [w[1:] for w in WORD_BREAK.split(text)]


def _id_letters(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids as rows of letters with room for a separator, and their lengths."""
    width = len(str(max(n - 1, 0)))
    rows = np.arange(n).astype(f"S{width + 1}")
    size = np.char.str_len(rows)
    return np.frombuffer(rows.tobytes(), np.uint8).reshape(n, width + 1), size


class Aligner:
    def __init__(self, a: Pieces, b: Pieces):
        self.a, self.b = a, b
        self.letters = _id_letters(max(len(a.of), len(b.of)))
        # word -> packed ids of both kinds with the space before it, or two
        # None where they do not join to it
        self.memo = Memo(WORDS)

    def learn(self, words: list[str]) -> None:
        both = zip(*(kind.words(words) for kind in (self.a, self.b)))
        self.memo.young.update((w, ids if None not in ids else (None, None)) for w, ids in zip(words, both))

    def tokens(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of both kinds; none for texts that do not come back."""
        words = [words_of(" " + t) if t and self.a.apart and self.b.apart else [t] if t else [] for t in texts]
        self.learn(list(self.memo.missing(set().union(*words))))
        known = self.memo.young.__getitem__
        out = [], []
        for text, own in zip(texts, words):
            ids_a, ids_b = zip(*map(known, own)) if own else ((), ())
            if None in ids_a:  # one word alone did not: the whole text decides
                whole = [kind.alone(text) for kind in (self.a, self.b)]
                ids_a, ids_b = ((), ()) if None in whole else ([ids] for ids in whole)
            out[0].append(b"".join(ids_a))
            out[1].append(b"".join(ids_b))
        return out

    def align(self, texts: list[bytes]) -> list[pa.Array]:
        """The columns of ``ALIGNED`` for a slice of texts."""
        ids_a, ids_b = self.tokens([t.decode() for t in texts])
        n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        flat_a, flat_b = (np.frombuffer(b"".join(ids), np.uint32).astype(np.int64) for ids in (ids_a, ids_b))
        # Offsets run on from text to text, so the last end of each is shared.
        ends_a, ends_b = np.cumsum(self.a.sizes[flat_a]), np.cumsum(self.b.sizes[flat_b])
        some = n_a > 0
        cuts = shared_cuts(ends_a, ends_b, first_a[:-1][some], first_a[1:][some] - 1)
        cut_a, cut_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        cut_a[cuts] = True
        cut_b[np.searchsorted(ends_b, ends_a[cuts])] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_groups = np.diff(np.searchsorted(cuts, first_a))

        # Segments end at the ends of a and at those ends of b that a lacks;
        # each of the latter lies inside one token of a.
        inside = np.searchsorted(ends_a, ends_b[~cut_b])
        place_a = np.arange(len(flat_a)) + np.cumsum(np.bincount(inside, minlength=len(flat_a)))
        of_a = np.empty(len(flat_a) + len(inside), np.int64)
        of_a[place_a] = np.arange(len(flat_a))
        of_a[inside + np.arange(len(inside))] = inside
        ends_a_b = np.ones(len(of_a), bool)  # where a token of b ends, too
        ends_a_b[place_a[~cut_a]] = False
        of_b = np.cumsum(ends_a_b) - ends_a_b
        text = np.repeat(np.arange(len(texts)), n_a)[of_a]
        n_links = np.bincount(text, minlength=len(texts)).astype(np.int64)
        size_b = len(self.b.of)
        pair, links = np.unique((text * len(self.a.of) + flat_a[of_a]) * size_b + flat_b[of_b], return_counts=True)
        rest, pair_b = np.divmod(pair, size_b)
        text, pair_a = np.divmod(rest, len(self.a.of))
        at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
        return [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                self.written(flat_a, flat_b, group_a, group_b, first_a + first_b),
                *(pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (pair_a, pair_b, links))]

    def written(self, flat_a: np.ndarray, flat_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray,
                first: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` per text: the tokens of a group stand side
        by side, each followed by its separator, but for a text's last."""
        n = len(flat_a) + len(flat_b)
        groups = int(group_a[-1]) + 1 if n else 0
        per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        at_a = np.arange(len(flat_a)) + (np.cumsum(per_b) - per_b)[group_a]
        at_b = np.arange(len(flat_b)) + np.cumsum(per_a)[group_b]
        ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = flat_a, flat_b
        if n:
            after[at_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
            after[at_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
        letters, size = self.letters
        rows, long = letters[ids], size[ids]
        rows[np.arange(n), long] = after
        last = first[1:][np.diff(first) > 0] - 1
        long = long + 1
        long[last] -= 1
        flat = rows[np.arange(rows.shape[1]) < long[:, None]]
        offsets = np.concatenate([[0], np.cumsum(long)])[first]
        return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)),
                                                pa.py_buffer(flat)).cast(pa.string())


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligning(path_a: str, path_b: str):
    """(id, text) -> (id, ``ALIGNED``), a slice of texts at a time, so that
    no more than a slice's tokens are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path_a, path_b)
        if key not in _aligners:
            _aligners[key] = Aligner(byte_level(path_a), sentence_pieces(path_b))
        names = ["_id", *(f.split()[0] for f in ALIGNED.split(", "))]
        for batch in batches:
            at = 0
            for part in byte_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *_aligners[key].align(part)], names)
                at += len(part)
    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col`` and the columns of ``ALIGNED``: counts of tokens,
    groups and links, the groups written out, and per distinct pair of ids
    how many links the text has. Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_aligning(path_a, path_b), f"_id {kind}, {ALIGNED}") \
        .withColumnRenamed("_id", id_col)


def _occurrences(found: DataFrame, *keys: str) -> DataFrame:
    """One row per document and pair of ids."""
    return found.select(*keys, F.explode(F.arrays_zip("pair_a", "pair_b", "pair_links")).alias("_p")) \
        .select(*keys, F.col("_p.pair_a").alias("a"), F.col("_p.pair_b").alias("b"), F.col("_p.pair_links").alias("links"))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): in how many rows of ``found`` two ids are
    linked, and whether no other partner of a has more. A window holds one
    id's partners, no more than the other vocabulary."""
    counts = _occurrences(found).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def score_links(scratch: Scratch, found: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(_row, n_best, count_sum) for the rows of ``found`` (written, with a
    unique ``_row``) that have links: over each row's links, how many are
    their a's best, and the sum of their counts."""
    counts = scratch.write(pair_counts(found), "pairs")
    hot = scratch.write(counts.orderBy(F.desc("n_docs"), "a", "b").limit(hot_pairs), "hot-pairs")
    links = _occurrences(found, "_row")
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).cast("long").alias("n_best"),
            F.sum(F.col("links") * F.col("n_docs")).cast("long").alias("count_sum")]
    # At most hot_pairs rows of four numbers.
    joined = links.join(F.broadcast(hot.withColumnRenamed("a", "_a").withColumnRenamed("b", "_b")),
                        (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    if counts.count() > hot_pairs:
        cold = counts.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
        known = joined.where(F.col("n_docs").isNotNull()).groupBy("_row").agg(*sums)
        other = joined.where(F.col("n_docs").isNull()).select("_row", "a", "b", "links") \
            .join(cold.hint("shuffle_hash"), ["a", "b"]).groupBy("_row").agg(*sums)
        return known.unionByName(other).groupBy("_row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return joined.groupBy("_row").agg(*sums)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "alignment")
    path_a, path_b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    found = align_documents(table(spark, sf_dir, "documents"), path_a, path_b)
    found = scratch.write(found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_a", "n_b", "n_groups",
                                       "n_links", digest, "pair_a", "pair_b", "pair_links"), "aligned")
    none = F.lit(0).cast("long")
    return found.drop("pair_a", "pair_b", "pair_links").join(score_links(scratch, found), "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
