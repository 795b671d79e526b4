"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np

from parlance.llm import ngram_join
from parlance.llm.bytewords import shingles, words_of


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset(
        [tuple(words)] if words else [])


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def family(rng, n, length=60, edits=4):
    """Texts that each change some words of the one before: a chain."""
    words = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(words)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        out.append(" ".join(words))
    return out


def test_equals_brute_force(spark, documents):
    rng = random.Random(4)
    texts = [t for k in range(8) for t in family(rng, 25, rng.choice([8, 20, 60, 200]), rng.choice([2, 4, 9]))]
    line = " ".join(f"common{i}" for i in range(12))
    texts += [f"{line} {' '.join(f'own{rng.randrange(9999)}' for _ in range(12))}" for _ in range(60)]
    texts += ["", None, " \n", "a", "a b", "A  b", "a b c d e", "a b c d e", "x " * 400]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    got = ngram_join.components_by_ngrams(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    given = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted((tuple(r) for r in ngram_join.components_by_ngrams(documents).collect()), key=str) == brute(given)


def test_large_cells_and_tiles(spark, monkeypatch):
    """The ways for large cells and for many documents of a cell agree with
    brute force, too."""
    monkeypatch.setattr(ngram_join, "LARGE_CELL", 4)
    monkeypatch.setattr(ngram_join, "TILE", 5)
    rng = random.Random(8)
    rows = list(enumerate([t for _ in range(4) for t in family(rng, 30, 40, 6)]))
    got = ngram_join.components_by_ngrams(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [tuple(r) for r in ngram_join.components_by_ngrams(odd).collect()]
    assert len(got) == len(rows)
    assert sorted(got, key=str)[:2] == sorted(got, key=str)[:2]
    assert {c for d, n, c in got if n == 2 and d in (1, 6)} <= {1}
    assert ngram_join.components_by_ngrams(empty).count() == 0
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 6 not in ids and {2, 3, 4, 5, 7} <= set(ids)


def test_one_row_of_each_component_whatever_the_ids(spark):
    """Null and repeated ids name several rows; components decide."""
    own = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcdefg"]
    rows = [(None, own[0]), (None, own[1]), (None, own[1].upper()), (None, own[2]), (5, own[2]), (7, own[3]), (7, own[4]),
            (7, own[4] + " "), (9, own[4]), (9, own[5]), (11, own[6]), (None, ""), (None, None)]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], r["text"] and r["text"].strip().lower()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([
        (None, own[0]), (None, own[1]), (5, own[2]), (7, own[3]), (7, own[4]), (9, own[5]), (11, own[6]),
        (None, ""), (None, None)], key=str)
    unique = spark.createDataFrame([(1, own[0]), (2, own[0]), (3, own[1])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(unique).collect()) == [1, 3]


def test_shingle_hashes_name_shingles():
    texts = ["", "a", "a b c", "a b c d e", "a b c d e f", "e d c b a", "é ü a b c", "a\tb\x0bc d e", "a b c d ef"]
    flat, first = shingles(words_of([t.encode() for t in texts]))
    names = {}
    for i, text in enumerate(texts):
        own = flat[first[i]:first[i + 1]].tolist()
        words = text.split()
        want = [tuple(words[k:k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
        assert len(own) == len(want)
        for a, b in zip(own, want):
            assert names.setdefault(b, a) == a
    assert len(set(names.values())) == len(names)


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 900)))
        b = np.unique(rng.choice(pool, rng.integers(1, 900)))
        flat, begin = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        x, y = ngram_join.points_of(ngram_join.group_counts(flat, begin), np.diff(begin))
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))
    many = np.zeros(5000, np.uint64)
    assert ngram_join.group_counts(many, np.array([0, 5000])) == [b""]
