"""Operator 9, toxicity by a bidirectional gated recurrent network with
attention pooling.

A word enters as the sum of its own vector and the vectors of its character
runs, both in hashed tables. All overlapping windows of a text are scored
and the text takes its highest window. The network is trained here in numpy
on a bounded sample of labelled rows, in turns: the best window of each
text is picked under the current network, then the network learns from the
picked windows. Texts are scored in Arrow batches, row by row of the table,
so scoring needs no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .bytewords import Words, mix, words_of
from .common import release_memory, table
from .tokens import byte_slices

# Bounds of the sample that is learnt from: rows of each label, and the
# bytes of the longest text in it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 3000, 200_000
WINDOW, STRIDE = 48, 32
HIDDEN, WIDTH, ATTENTION = 8, 8, 8
TABLE_BITS = 16
GRAM = 6
# A table row is learnt if it occurs in so many sampled texts; the share of
# texts by which log-odds are drawn to zero; how much slower the tables
# learn; the share of inputs left out at a time; the doubt in a label.
MIN_TEXTS, SHRINK, TABLE_RATE, DROPOUT, DOUBT = 3, 0.01, 0.05, 0.2, 0.02
PARTS = 4
# How much more a missed toxic text counts than a clean one rejected; the
# scores of a small sample are shy of languages with few toxic texts.
LEAN = 2.0
BLOCK = 1024
FOLDS, HELD_OUT = 4, 2

_BREAKS = np.zeros(256, bool)
_BREAKS[:0x80] = True
for _kept in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
    _BREAKS[list(_kept)] = False


# -- features -----------------------------------------------------------------

@dataclass
class Batch:
    """The distinct words of some texts and where they stand. ``word`` and
    ``gram`` are rows of the hashed tables; ``gram_first`` is where the
    grams of a distinct word begin; ``place`` names the distinct word at each
    place and ``first`` the places of each text."""
    word: np.ndarray
    gram: np.ndarray
    gram_first: np.ndarray
    place: np.ndarray
    first: np.ndarray


def batch_of(texts: list[bytes], slice_bytes: int = 1 << 20) -> Batch:
    """The batch of ``texts``, made from slices of about ``slice_bytes``
    whose distinct words are then joined; a slice bounds the memory."""
    parts, at = [], 0
    while at < len(texts) or not parts:
        to, held = at, 0
        while to < len(texts) and held < slice_bytes:
            held += len(texts[to])
            to += 1
        words = words_of(texts[at:to], breaks=_BREAKS)
        hashes, seen, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
        gram, gram_first = grams(words, seen)
        parts.append((hashes, gram, np.diff(gram_first), place, np.diff(words.first)))
        at = to
    hashes, seen, name = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    offset = np.cumsum([0, *(len(p[0]) for p in parts)])
    place = np.concatenate([name[o + p[3]] for o, p in zip(offset, parts)]).astype(np.int32)
    gram, number = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    begin, own = (np.cumsum(number) - number)[seen], number[seen]
    gram_first = np.concatenate(([0], np.cumsum(own)))
    inside = np.arange(gram_first[-1]) - np.repeat(gram_first[:-1], own)
    return Batch((hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int32), gram[np.repeat(begin, own) + inside], gram_first,
                 place, np.concatenate(([0], np.cumsum(np.concatenate([p[4] for p in parts])))))


def grams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the byte runs of the words ``which``: the first bytes
    of the word under a mark, then every run of ``GRAM`` bytes."""
    start, length = words.start[which], (words.end - words.start)[which]
    number = np.maximum(1, length - GRAM + 2)
    first = np.zeros(len(which) + 1, np.int64)
    np.cumsum(number, out=first[1:])
    padded = np.concatenate((words.buffer, np.zeros(GRAM, np.uint8))).astype(np.uint64)
    runs = sum((padded[k:len(padded) - GRAM + k] << np.uint64(8 * k) for k in range(GRAM)),
               np.zeros(len(words.buffer), np.uint64))
    inside = np.arange(first[-1]) - np.repeat(first[:-1], number)
    values = runs[np.repeat(start, number) + np.maximum(inside - 1, 0)] if len(which) else np.zeros(0, np.uint64)
    keep = np.uint64(8) * np.minimum(length, GRAM - 1).astype(np.uint64)
    if len(which):
        mask = (np.uint64(1) << keep) - np.uint64(1)
        values[first[:-1]] = (values[first[:-1]] & mask) | np.uint64(0xFF << 56)
    return (mix(values) >> np.uint64(64 - TABLE_BITS)).astype(np.int32), first


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and number of places of every window, and the text of each:
    every ``STRIDE`` places until the end of the text is covered. A text
    without words has none."""
    n = np.diff(first)
    number = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), number)
    before = np.cumsum(number) - number
    offset = (np.arange(len(text)) - before[text]) * STRIDE
    return first[:-1][text] + offset, np.minimum(WINDOW, n[text] - offset), text


# -- network ------------------------------------------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """All parameters by name; ``shift`` corrects the sample's share of
    toxic rows to the share among all labels, ``prior`` is that share."""
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0
    prior: float = 0.0

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {"word": normal(1 << TABLE_BITS, WIDTH, scale=0.02), "gram": normal(1 << TABLE_BITS, WIDTH, scale=0.02)}
        for way in ("f", "b"):
            w |= {f"in_{way}": normal(WIDTH, 3 * HIDDEN, scale=WIDTH ** -0.5),
                  f"re_{way}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5),
                  f"bias_{way}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"att": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5),
              "att_bias": np.zeros(ATTENTION, np.float32), "query": normal(ATTENTION, scale=ATTENTION ** -0.5),
              "out": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "out_bias": np.zeros(1, np.float32)}
        return cls(w)

    def vectors(self, batch: Batch) -> np.ndarray:
        """Input vector of each distinct word."""
        own = self.weights["word"][batch.word]
        if len(own):
            own = own + np.add.reduceat(self.weights["gram"][batch.gram], batch.gram_first[:-1], axis=0)
        return own

    def run(self, source: np.ndarray, index: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States (steps, windows, HIDDEN) of one direction; ``source`` has
        the projected input of each distinct word. ``keep``: also what the
        backward pass needs."""
        steps, n = index.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        kept = [None] * steps
        recur = self.weights[f"re_{way}"]
        for t in range(steps) if way == "f" else reversed(range(steps)):
            x, u = source[index[t]], h @ recur
            gates = sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN] * mask[t][:, None], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            if keep:
                kept[t] = (h, u, gates, new)
            h = h + z * (new - h)
            states[t] = h
        return states, kept

    def forward(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; ``index`` (steps, windows) has distinct
        words, ``mask`` 1 where there is one."""
        w = self.weights
        both, kept = [], {}
        for way in ("f", "b"):
            states, kept[way] = self.run(vectors @ w[f"in_{way}"] + w[f"bias_{way}"], index, mask, way, keep)
            both.append(states)
        h = np.concatenate(both, axis=2)
        hidden = np.tanh(h @ w["att"] + w["att_bias"])
        weight = np.where(mask > 0, hidden @ w["query"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (h * weight[:, :, None]).sum(axis=0)
        logit = pooled @ w["out"] + w["out_bias"][0]
        return (logit, (kept, h, hidden, weight, pooled)) if keep else logit

    def backward(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, cache, d_logit: np.ndarray):
        """Gradients of all but the tables, and of each place's input."""
        w, (kept, h, hidden, weight, pooled) = self.weights, cache
        g = {"out": d_logit @ pooled, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * w["out"]
        d_h = weight[:, :, None] * d_pooled
        d_weight = (h * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_score[:, :, None] * w["query"] * (1 - hidden ** 2)
        g["query"] = np.tensordot(d_score, hidden, axes=([0, 1], [0, 1]))
        g["att"] = np.tensordot(h, d_hidden, axes=([0, 1], [0, 1]))
        g["att_bias"] = d_hidden.sum(axis=(0, 1))
        d_h = d_h + d_hidden @ w["att"].T
        d_input = np.zeros((*index.shape, WIDTH), np.float32)
        for k, way in enumerate(("f", "b")):
            recur, enter = w[f"re_{way}"], w[f"in_{way}"]
            g[f"re_{way}"], g[f"in_{way}"] = np.zeros_like(recur), np.zeros_like(enter)
            g[f"bias_{way}"] = np.zeros(3 * HIDDEN, np.float32)
            carried = np.zeros((index.shape[1], HIDDEN), np.float32)
            for t in reversed(range(len(index))) if way == "f" else range(len(index)):
                before, u, gates, new = kept[way][t]
                z, r, m = gates[:, :HIDDEN], gates[:, HIDDEN:], mask[t][:, None]
                d = carried + d_h[t][:, k * HIDDEN:(k + 1) * HIDDEN]
                d_new = d * z * m * (1 - new ** 2)
                d_z = d * (new - before) * m * z * (1 - z)
                d_r = d_new * u[:, 2 * HIDDEN:] * r * (1 - r)
                d_x = np.concatenate((d_z, d_r, d_new), axis=1)
                d_u = np.concatenate((d_z, d_r, d_new * r), axis=1)
                carried = d * (1 - z * m) + d_u @ recur.T
                g[f"re_{way}"] += before.T @ d_u
                g[f"in_{way}"] += vectors[index[t]].T @ d_x
                g[f"bias_{way}"] += d_x.sum(axis=0)
                d_input[t] += d_x @ enter.T
        return g, d_input

    def window_logits(self, batch: Batch, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        vectors = self.vectors(batch)
        out = np.empty(len(begin), np.float32)
        for at in range(0, len(begin), BLOCK):
            index, mask = steps_of(batch, begin[at:at + BLOCK], length[at:at + BLOCK])
            out[at:at + BLOCK] = self.forward(vectors, index, mask)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text: its highest window; the prior without words."""
        batch = batch_of(texts)
        begin, length, text = windows_of(batch.first)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, self.window_logits(batch, begin, length))
        return np.where(np.isfinite(best), sigmoid(best + self.shift), self.prior)


def steps_of(batch: Batch, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)[:, None]
    mask = step < length
    at = np.where(mask, begin + step, begin)
    return batch.place[at], mask.astype(np.float32)


# -- training -----------------------------------------------------------------

def occurrences(batch: Batch, kind: str) -> np.ndarray:
    """(text, table row) pairs that occur, each once, as text << TABLE_BITS |
    row. Some texts at a time, so that only distinct pairs are held."""
    kind_of = np.int32 if len(batch.first) <= 1 << (31 - TABLE_BITS) else np.int64
    out = [np.zeros(0, kind_of)]
    n_texts = len(batch.first) - 1
    for at in range(0, n_texts, 100):
        edge = batch.first[at:min(at + 100, n_texts) + 1]
        text = at + np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        distinct = np.unique(text.astype(np.int64) << 32 | batch.place[edge[0]:edge[-1]])
        text, word = distinct >> 32, distinct & (2**32 - 1)
        rows = batch.word[word]
        if kind == "gram":
            number = np.diff(batch.gram_first)[word]
            inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            rows = batch.gram[np.repeat(batch.gram_first[:-1][word], number) + inside]
            text = np.repeat(text, number)
        out.append(np.unique(text << TABLE_BITS | rows).astype(kind_of))
    return np.concatenate(out)


def log_odds(pairs: np.ndarray, label: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunken log-odds of each table row, from the texts it occurs in
    (``among`` marks those that count at all), and whether it occurs in
    enough of them to be learnt at all: a row of one or two texts would only
    name those texts."""
    size = 1 << TABLE_BITS
    number = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    for at in range(0, len(pairs), 1 << 20):
        text, row = pairs[at:at + (1 << 20)] >> TABLE_BITS, pairs[at:at + (1 << 20)] & (size - 1)
        for y in (0, 1):
            number[y] += np.bincount(row[among[text] & (label[text] == y)], minlength=size)
    good, bad = number
    n_bad, n_good = max(1, label[among].sum()), max(1, (1 - label[among]).sum())
    odds = np.log((bad / n_bad + SHRINK) / (good / n_good + SHRINK)).astype(np.float32)
    common = bad + good >= MIN_TEXTS
    return np.where(common, odds, 0), common


def train(texts: list[bytes], label: np.ndarray, share: float, epochs: int = 6, updates: int = 150, rate: float = 0.01,
          batch_size: int = 128, seed: int = 9) -> Network:
    """A network for ``texts`` and their 0/1 ``label``; ``share`` is the
    share of label 1 among all rows that may be learnt from. Without both
    labels, or any words, the network stays untrained and scores the share."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    net.prior = float(share)
    batch = batch_of(texts)
    begin, length, text = windows_of(batch.first)
    if not 0 < label.sum() < len(label) or not len(begin):
        net.weights["out"][:] = 0
        net.shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return net
    sampled = label.mean()
    net.shift = float(np.log(LEAN * share / (1 - share) * (1 - sampled) / sampled))
    w = net.weights
    per_word = np.diff(batch.gram_first)
    # The first column of the tables is log-odds. A text must not see its own
    # label in them, so while learning each part of the sample reads those
    # of the other parts.
    part = rng.integers(0, PARTS, len(texts))
    pairs = {k: occurrences(batch, k) for k in ("word", "gram")}
    odds = {k: [log_odds(v, label, part != f)[0] for f in range(PARTS)] for k, v in pairs.items()}
    full = {k: log_odds(v, label, part >= 0) for k, v in pairs.items()}
    del pairs
    for k, (_, common) in full.items():
        w[k][~common] = 0

    def column(k: str, values: np.ndarray) -> None:
        w[k][:, 0] = 0.5 * values

    def each_part(per_window) -> np.ndarray:
        """``per_window`` of the windows of each part under its log-odds."""
        out = np.empty(len(begin), np.float32)
        for f in range(PARTS):
            for k in odds:
                column(k, odds[k][f])
            own = np.flatnonzero(part[text] == f)
            out[own] = per_window(own)
        return out

    def first_value(own: np.ndarray) -> np.ndarray:
        level = np.concatenate(([0], np.cumsum(np.maximum(0, net.vectors(batch)[batch.place, 0] - 1))))
        return level[begin[own] + length[own]] - level[begin[own]]

    value = each_part(first_value)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    # A small sample takes more rounds to come to as many updates.
    epochs = max(epochs, -(-updates * batch_size // (2 * len(texts))))
    for epoch in range(epochs):
        order = np.lexsort((value, text))
        last = np.flatnonzero(np.diff(np.append(text[order], -1)))
        picked = order[last]
        # Clean texts also learn from a window at random.
        extra = rng.integers(0, len(begin), len(picked))
        picked = np.concatenate((picked, extra[label[text[extra]] == 0]))
        rng.shuffle(picked)
        by_part = [picked[part[text[picked]] == f] for f in range(PARTS)]
        turns = [own for x in by_part if len(x) for own in np.array_split(x, max(1, len(x) // batch_size))]
        for turn in rng.permutation(len(turns)):
            own = turns[turn]
            for k in odds:
                column(k, odds[k][part[text[own[0]]]])
            index, mask = steps_of(batch, begin[own], length[own])
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(mask.shape)
            number = per_word[used]
            gram_rows = np.repeat(batch.gram_first[:-1][used], number)
            gram_rows += np.arange(len(gram_rows)) - np.repeat(np.cumsum(number) - number, number)
            gram_rows = batch.gram[gram_rows]
            own_kept = (rng.random((len(used), 1), np.float32) >= DROPOUT) / np.float32(1 - DROPOUT)
            gram_kept = (rng.random((len(gram_rows), 1), np.float32) >= DROPOUT) / np.float32(1 - DROPOUT)
            vectors = own_kept * w["word"][batch.word[used]] + np.add.reduceat(
                gram_kept * w["gram"][gram_rows], np.cumsum(number) - number, axis=0)
            logit, cache = net.forward(vectors, index, mask, keep=True)
            target = DOUBT + (1 - 2 * DOUBT) * label[text[own]]
            d_logit = ((sigmoid(logit) - target) / len(own)).astype(np.float32)
            grads, d_input = net.backward(vectors, index, mask, cache, d_logit)
            d_word = np.zeros((len(used), WIDTH), np.float32)
            np.add.at(d_word, index.ravel(), d_input.reshape(-1, WIDTH))
            grads["word"], grads["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
            np.add.at(grads["word"], batch.word[used], own_kept * d_word)
            np.add.at(grads["gram"], gram_rows, gram_kept * np.repeat(d_word, number, axis=0))
            for k, (_, common) in full.items():
                grads[k][~common] = 0
                grads[k][:, 0] = 0
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= rate * (TABLE_RATE if k in ("word", "gram") else 1) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        if epoch + 1 < epochs:
            value = each_part(lambda own: net.window_logits(batch, begin[own], length[own]))
    for k, (values, _) in full.items():
        column(k, values)
    return net


# -- Spark --------------------------------------------------------------------

def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN,
        max_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold:
    the first ``n_toxic`` and ``n_clean`` ids of each label by hash, without
    texts over ``max_bytes``. Rows with a null id or label teach nothing; a
    repeated id counts once."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)
                          & (fold(F.col(id_col)) != HELD_OUT)) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    share = usable.agg(F.avg("_label")).first()[0]
    if share is None:
        return train([], np.zeros(0), 0.0)
    by_hash = F.xxhash64("_id")
    sample = usable.where("_label = 1").orderBy(by_hash, "_id").limit(n_toxic).union(
        usable.where("_label = 0").orderBy(by_hash, "_id").limit(n_clean))
    # At most n_toxic + n_clean narrow rows.
    chosen = docs.sparkSession.createDataFrame(sample.collect(), "_id bigint, _label int") \
        if sample.schema["_id"].dataType.simpleString() == "bigint" else sample
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) \
        .where(F.octet_length("_text") <= max_bytes).join(F.broadcast(chosen), "_id")
    rows = read.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")) \
        .orderBy("_id").collect()
    texts, label = [r["_text"].encode() for r in rows], np.array([r["_label"] for r in rows], np.int64)
    del rows
    return train(texts, label, share)


def toxicity(text: Column, spark: SparkSession, net: Network) -> Column:
    """Score column of a text column. The network is a few MB whatever the
    input, and travels as a broadcast variable."""
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf(DoubleType())
    def score(column: pa.Array) -> pa.Array:
        parts = [sent.value.scores(part) for part in byte_slices(column)]
        release_memory()
        return pa.array(np.concatenate([*parts, np.zeros(0)]).astype(np.float64))
    return score(text)


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3) -> DataFrame:
    """One row (``id_col``, held_out, score, predicted) per row of ``docs``.
    A text without words (null, empty, signs only) scores the share of toxic
    rows among the labels. Repeated rows and null ids (held_out null) come
    back as they are; other columns are not read."""
    return docs.select(F.col(id_col), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"),
                       toxicity(F.col(text_col), docs.sparkSession, net).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    net = fit(docs, labels, id_col, text_col)
    # The row as one value, so that no column of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    scored = rows.withColumn("score", toxicity(F.col("text"), docs.sparkSession, net))
    return scored.where(F.col("score") < threshold).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
