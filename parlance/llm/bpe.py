"""Operator 6, BPE encoding and decoding with a contiguous rank array.

A short word is a row of part ids next to a row of the ranks of its
adjacent pairs. Until no pair has a rank, the lowest one is taken, the
boundary between its parts is deleted and the ranks to the left and right
of it are looked up again. Words of one length are rows of one matrix, so a
batch of words takes these steps together; a long word keeps its parts in a
linked list and its pairs in a heap instead."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import release_memory, table
from .tokens import Memo, byte_slices

# A word of more bytes takes the heap; the matrix would cost its square.
SHORT_WORD = 64
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it prints, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file of this kind: NFC, white
    space runs and case dropped, words cut by a pattern, then byte-level
    merges in which the last symbol of a word carries a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = sorted((vocab[a] << 32 | vocab[b], rank, vocab[a + b])
                       for rank, (a, b) in enumerate(model["merges"]))
        self.pair = np.array([p[0] for p in pairs], np.int64)
        self.rank = np.array([p[1] for p in pairs], np.int32)
        self.merged = np.array([p[2] for p in pairs], np.int32)
        self.by_rank = np.empty(len(pairs), np.int32)
        self.by_rank[self.rank] = self.merged
        self.by_pair = {p: (r, m) for p, r, m in pairs}
        self.memo = Memo()

    # -- words ---------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NO_RANK)

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """The ids of words of one length, each as packed int32."""
        n, length = len(rows), len(rows[0])
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(n, length)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * n
        names = np.arange(n)

        def settle(which: np.ndarray) -> None:
            packed, width = ids[which].tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(names[which].tolist()):
                out[i] = packed[k * width:(k + 1) * width]

        while len(names):
            if ids.shape[1] == 1:
                settle(np.arange(len(names)))
                break
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(names)), best]
            going = lowest != NO_RANK
            if not going.all():
                settle(np.flatnonzero(~going))
                ids, ranks, names, best, lowest = (x[going] for x in (ids, ranks, names, best, lowest))
                if not len(names):
                    break
            m, width = ids.shape
            row = np.arange(m)
            # Delete the boundary after part ``best``: its neighbour goes.
            kept = np.ones((m, width), bool)
            kept[row, best + 1] = False
            ids[row, best] = self.by_rank[lowest]
            ids = ids[kept].reshape(m, width - 1)
            kept = np.ones((m, width - 1), bool)
            kept[row, best] = False
            ranks = ranks[kept].reshape(m, width - 2)
            # Refresh the ranks on both sides of the new part.
            for at, inside in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = row[inside], at[inside]
                ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.by_pair.get
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (found := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two parts has been merged since
            ids[i], ids[j] = get(a << 32 | b)[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (found := get(ids[left] << 32 | ids[right])):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def merge_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        found: dict[bytes, bytes] = {}
        for length, rows in by_length.items():
            done = map(self.merge_long, rows) if length > SHORT_WORD else self.merge_rows(rows)
            found.update(zip(rows, done))
        return found

    # -- texts ---------------------------------------------------------------

    def cut(self, chunk: bytes) -> list[bytes | int]:
        """The words (as bytes) and special ids of a run of a text between
        ASCII white space, across which nothing is ever joined."""
        if chunk.isalpha():  # ASCII letters only
            return [chunk.lower()]
        if chunk[:-1].isalpha() and chunk[-1:] in b".,;:!?":
            return [chunk[:-1].lower(), chunk[-1:]]
        text = chunk.decode()
        if "<|" in text:
            parts = self.special_cut.split(text)
            return [w for k, part in enumerate(parts)
                    for w in ([self.special[part]] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            # The capital sigma is lowered by itself, not by its place.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return [text.encode()]
        return [w.encode() for w in self.pattern.findall(text)]

    def learn(self, chunks: set[bytes]) -> None:
        cuts = [(c, self.cut(c)) for c in chunks]
        found = self.merge_words({w for _, words in cuts for w in words if isinstance(w, bytes)})
        young = self.memo.young
        for chunk, words in cuts:
            young[chunk] = found[words[0]] if len(words) == 1 and words[0] in found else b"".join(
                [found[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in words])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed little-endian int32 ids of each text (UTF-8)."""
        split = [t.split() for t in texts]
        self.learn(self.memo.missing(set().union(*split)))
        ids = self.memo.young.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file names no decoder, and special
        tokens are kept."""
        return " ".join(map(self.tokens.__getitem__, ids))


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def id_arrays(column: pa.Array, path: str) -> pa.ListArray:
    size, joined = [np.zeros(1, np.int64)], []
    for part in byte_slices(column):
        packed = coder(path).encode(part)
        size.append(np.array([len(p) // 4 for p in packed], np.int64))
        joined.append(b"".join(packed))
    offsets = np.cumsum(np.concatenate(size)).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(joined), "<i4")))
    release_memory()
    return ids


def id_texts(column: pa.ListArray, path: str) -> pa.Array:
    decode, ids = coder(path).decode, column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_pylist()
    ends = column.offsets.to_pylist()
    out = pa.array([decode(ids[a:b].tolist()) if v else None for a, b, v in zip(ends, ends[1:], valid)], pa.string())
    release_memory()
    return out


def bpe_encode(text: Column, path: str) -> Column:
    """Token ids of a text column, special strings included, nothing added,
    cut or padded. Null and empty texts give an empty array."""
    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(column: pa.Array) -> pa.Array:
        return id_arrays(column, path)
    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of an id array; null stays null, an id outside the
    vocabulary raises."""
    @F.arrow_udf(StringType())
    def decode(column: pa.Array) -> pa.Array:
        return id_texts(column, path)
    return decode(ids)


def bpe_recode(text: Column, path: str) -> Column:
    """Struct of the token ids of a text column and the text decoded from
    them, in one pass (chained, the encoder would run twice)."""
    kind = StructType([StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    @F.arrow_udf(kind)
    def recode(column: pa.Array) -> pa.Array:
        ids = id_arrays(column, path)
        return pa.StructArray.from_arrays([ids, id_texts(ids, path)], ["token_ids", "decoded"])
    return recode(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, token_ids, decoded) per row of ``docs``; the text
    is decoded from the ids. Repeated rows and null ids come back as they
    are, an empty table gives no rows, other columns are not read."""
    return docs.select(F.col(id_col), bpe_recode(F.col(text_col), path).alias("_both")).select(id_col, "_both.*")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    joined = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return encoded.select(id_col, F.size("token_ids").cast("long").alias("n_tokens"),
                          F.sha2(joined, 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_documents(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json")))
