"""The toxicity network: gradients, held-out accuracy, odd rows."""

import numpy as np
import pytest

from parlance.llm import toxicity


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, net = trained
    scored = toxicity.score_toxicity(docs, net).where("held_out").join(labels, "doc_id") \
        .select("toxic", "score", "predicted").collect()
    y = np.array([r["toxic"] for r in scored])
    p = np.array([r["predicted"] for r in scored])
    s = np.array([r["score"] for r in scored])
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.3)).all()
    assert p[y == 1].mean() >= 0.85
    assert p[y == 0].mean() <= 0.04


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts = [b"one two three four", b"five six", b"seven one two eight nine ten"]
    batch = toxicity.batch_of(texts)
    begin, length, _ = toxicity.windows_of(batch.first)
    index, mask = toxicity.steps_of(batch, begin, length)
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = net.forward(net.vectors(batch), index, mask)
        return (np.log1p(np.exp(logit)) - target * logit).sum()

    vectors = net.vectors(batch)
    logit, cache = net.forward(vectors, index, mask, keep=True)
    grads, _ = net.backward(vectors, index, mask, cache, toxicity.sigmoid(logit) - target)
    for name, g in grads.items():
        w = net.weights[name]
        at = tuple(rng.integers(0, s) for s in w.shape)
        old, step = w[at], 1e-3
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) <= 0.02 * abs(g[at]) + 2e-3, name


def plain_score(net, text):
    """The score word by word and window by window, in double precision."""
    import re

    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    if not words:
        return net.prior
    inputs = [net.vectors(toxicity.batch_of([x]))[0].astype(np.float64) for x in words]
    n, logits = toxicity.HIDDEN, []
    for at in range(0, len(words), toxicity.STRIDE):
        states = []
        for way in ("f", "b"):
            h, own = np.zeros(n), {}
            window = list(enumerate(inputs[at:at + toxicity.WINDOW]))
            for t, x in window if way == "f" else window[::-1]:
                a, u = x @ w[f"in_{way}"] + w[f"bias_{way}"], h @ w[f"re_{way}"]
                z, r = (1 / (1 + np.exp(-(a[k:k + n] + u[k:k + n]))) for k in (0, n))
                h = h + z * (np.tanh(a[2 * n:] + r * u[2 * n:]) - h)
                own[t] = h
            states.append([own[t] for t in range(len(window))])
        both = [np.concatenate(pair) for pair in zip(*states)]
        focus = np.array([np.exp(np.tanh(h @ w["att"] + w["att_bias"]) @ w["query"]) for h in both])
        logits.append(sum(f * h for f, h in zip(focus / focus.sum(), both)) @ w["out"] + w["out_bias"][0])
        if at + toxicity.WINDOW >= len(words):
            break
    return 1 / (1 + np.exp(-(max(logits) + net.shift)))


def test_scores_equal_a_plain_scorer(trained):
    docs, _, net = trained
    texts = [r["text"].encode() for r in docs.orderBy("doc_id").limit(60).collect()]
    texts += [b"", b" .,!", "straße ÉTÉ x1".encode(), b"word " * 48, b"word " * 49, b"a b c " * 27]
    got = net.scores(texts)
    for t, s in zip(texts, got):
        assert abs(s - plain_score(net, t)) < 1e-4


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 5 + 48, 53 + 49, 102 + 500])
    begin, length, text = toxicity.windows_of(first)
    assert 0 not in text
    for t in range(1, 5):
        covered = set()
        for b, n in zip(begin[text == t], length[text == t]):
            assert n <= toxicity.WINDOW
            covered |= set(range(b, b + n))
        assert covered == set(range(first[t], first[t + 1]))


def test_a_single_bad_window_decides(trained):
    docs, labels, net = trained
    clean = docs.where("length(text) > 8000").join(labels.where("toxic = 0"), "doc_id").select("text").limit(5).collect()
    for r in clean:
        words = r["text"].split(" ")
        bad = " ".join([*words, "You stupid worthless idiot, disgusting pathetic moron, trash scum."])
        scores = net.scores([r["text"].encode(), bad.encode()])
        assert scores[1] > scores[0]


def test_odd_rows_and_no_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (5, 1), (7, 0), (1, 1)], "doc_id long, toxic int")
    net = toxicity.fit(odd, labels)
    rows = toxicity.score_toxicity(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(empty, net).count() == 0
    none = toxicity.fit(odd, labels.where("false"))
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} <= {0.0, none.prior} | {
        r["score"] for r in toxicity.score_toxicity(odd, none).collect() if r["score"] < 1e-3}
    kept = toxicity.drop_toxic(odd, labels.where("false"))
    assert kept.columns == odd.columns and kept.count() == odd.count()
