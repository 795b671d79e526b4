"""Alignment of two tokenizers against a plain byte-by-byte version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from parlance.llm import alignment
from parlance.llm.common import Scratch

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def plain():
    """text -> (ids, end of each token) of both, by the libraries alone."""
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    decoder = tokenizers.decoders.ByteLevel()
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    # One byte-level letter may be part of a character: bytes by the vocabulary's own alphabet.
    letters = {c: i for i, c in enumerate(sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet(), key=ord))}
    low = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255)]
    byte = {c: ord(c) if ord(c) < 256 else low[ord(c) - 256] for c in letters}
    assert decoder.decode(["Ġx"]) == " x"

    def encode(text):
        if not text:
            return None
        want = b" " + text.encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids
        pa = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        ib = b.encode(text)
        pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(pa) != want or b"".join(pb) != want:
            return None
        return ia, np.cumsum([len(x) for x in pa]).tolist(), ib, np.cumsum([len(x) for x in pb]).tolist()
    return encode


def brute(rows, plain):
    """rows: (id, text) -> one tuple as op11 returns it per row."""
    out, docs = [], Counter()
    for _, text in rows:
        found = plain(text)
        if found is None:
            out.append(None)
            continue
        ia, ea, ib, eb = found
        groups, x, y = [], [], []
        links, i, j = [], 0, 0
        while i < len(ia):
            links.append((ia[i], ib[j]))
            if ea[i] == eb[j]:
                groups.append(",".join(map(str, x + [ia[i]])) + "|" + ",".join(map(str, y + [ib[j]])))
                x, y, i, j = [], [], i + 1, j + 1
            elif ea[i] < eb[j]:
                x, i = x + [ia[i]], i + 1
            else:
                y, j = y + [ib[j]], j + 1
        docs.update(set(links))
        out.append((len(ia), len(ib), groups, links))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(n, best.get(a, 0))
    return [(i, 0, 0, 0, 0, 0, 0, "") if o is None else
            (i, o[0], o[1], len(o[2]), len(o[3]), sum(docs[k] == best[k[0]] for k in o[3]), sum(docs[k] for k in o[3]),
             hashlib.sha256(";".join(o[2]).encode()).hexdigest()) for (i, _), o in zip(rows, out)]


def through(spark, docs, hot_pairs):
    """As op11, with another limit of hot pairs."""
    scratch = Scratch(spark, "test-alignment")
    found = alignment.align_documents(docs, *PATHS)
    found = scratch.write(found.withColumn("_row", F.monotonically_increasing_id()), "found")
    scored = {r["_row"]: (r["n_best"], r["count_sum"]) for r in alignment.score_links(scratch, found, hot_pairs).collect()}
    return [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *scored.get(r["_row"], (0, 0)),
             hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in found.collect()]


def test_the_query_equals_brute_force(spark, documents, plain):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = [tuple(r) for r in alignment.op11(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(brute(rows, plain))


@pytest.mark.parametrize("hot_pairs", [1, 40, 1 << 18])
def test_counts_of_hot_and_other_pairs(spark, documents, plain, hot_pairs):
    rows = [(r["doc_id"], (r["text"] or "")[:300]) for r in documents.limit(60).collect()] + [(1, "the the"), (1, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(through(spark, docs, hot_pairs)) == sorted(brute(rows, plain))


def test_odd_texts(spark, plain):
    texts = ["", None, " ", "\n\n\t x", "a\0b", "<s> </s> <|endoftext|>", "▁ y ▁▁z", "naïve café — 東京 🙂🙃 ﬀ", "x" * 3000,
             "é" * 500 + "a  b   c", " ﻿‍", "<0x41> <0xFF>", "  a", "a  ", "\r\n\r\n", "12345678901234567890", "\U0010ffff"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, None), (3, "\n\n\t x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _row2 int, groups int")
    key = str
    assert sorted(through(spark, docs, 100), key=key) == sorted(brute(rows, plain), key=key)


def test_empty_table(spark):
    assert through(spark, spark.createDataFrame([], "doc_id long, text string"), 10) == []


@pytest.mark.parametrize("probes", [0, 1, 32])
def test_shared_cuts(monkeypatch, probes):
    monkeypatch.setattr(alignment, "PROBES", probes)
    rng = np.random.default_rng(probes)
    for _ in range(150):
        n = int(rng.integers(1, 300))
        a, b = (np.unique(np.append(rng.choice(np.arange(1, n + 1), int(rng.integers(1, n + 1))), n)) for _ in "ab")
        # Two texts: any shared end may be where the first one stops.
        both = np.intersect1d(a, b)
        stop = int(np.searchsorted(a, rng.choice(both)))
        low, high = np.array([0, stop + 1]), np.array([stop, len(a) - 1])
        some = low <= high
        got = alignment.shared_cuts(a, b, low[some], high[some])
        assert got.tolist() == np.flatnonzero(np.isin(a, both)).tolist()


def test_a_long_stretch_without_shared_ends():
    a, b = np.append(np.arange(2, 200_000, 2), 200_000), np.append(np.arange(1, 199_999, 2), 200_000)
    assert alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1])).tolist() == [len(a) - 1]
