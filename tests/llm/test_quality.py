"""Quality counts by brute force; votes against the labels."""

import re
from collections import Counter

from parlance.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(frame):
    rows = quality.judge_quality(frame).collect()
    texts = Counter((r["doc_id"], plain(r["text"] or "")) for r in frame.collect())
    got = Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]))
                  for r in rows)
    assert got == texts
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    return rows


def test_counts_and_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(docs)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(label[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in label and not r["base_failed"]]
    good = [kept for y, kept in judged if y == 1]
    bad = [kept for y, kept in judged if y == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_overlapping_windows_and_odd_rows(spark, odd, empty):
    rows = [(1, "a a a a"), (2, "a b a b a b c"), (3, "x\nx\n \n \nx"), (4, "ä|ö ü ß")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check(odd)
    assert quality.judge_quality(empty).count() == 0


def test_a_rule_that_errs_counts_less(spark):
    """Three rules agree on 900 documents; a fourth votes against them."""
    rows = [(2, 2, 2, 0)] * 300 + [(1, 1, 1, 0)] * 500 + [(1, 1, 1, 2)] * 100
    votes = spark.createDataFrame(rows, "a int, b int, c int, d int")
    accuracy = quality.estimate(votes, ["a", "b", "c", "d"])
    assert min(accuracy[k] for k in "abc") > 0.95
    assert accuracy["d"] < 0.6
