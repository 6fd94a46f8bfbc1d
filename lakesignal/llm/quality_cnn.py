"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over every byte of a text. Overlapping chunks of
2 * SEGMENT bytes, a new one each SEGMENT, cover the whole document; each keeps
its filters' maxima. The mean, the lowest and the highest of these over all chunks and
the logarithm of the length go through one hidden layer to one probability. As inputs are bytes, a filter is a
table of one row a byte value and place, so a convolution is WIDTH look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, labelled

WIDTH, FILTERS, HIDDEN, SEGMENT = 6, 24, 24, 256
#: Bytes convolved at a time.
BLOCK = SEGMENT * 256
PAD = 256
#: Labelled documents of each class that the network is trained on, at most.
CLASS_ROWS = 2000
STEPS, BATCH, RATE = 900, 32, 0.01
THRESHOLD = 0.3
FOLDS = 5


def to_bytes(text: str | None) -> np.ndarray:
    """The text's UTF-8 bytes, padded to whole segments and a filter's overhang."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(SEGMENT, -(-len(raw) // SEGMENT) * SEGMENT)
    out = np.full(n + WIDTH - 1, PAD, np.int16)
    out[: len(raw)] = raw
    return out


def length_feature(data: np.ndarray) -> np.ndarray:
    return np.log2([1 + np.count_nonzero(data != PAD)]).astype(np.float32) / 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    table: np.ndarray  # WIDTH, 257, FILTERS
    bias: np.ndarray  # FILTERS
    hidden: np.ndarray  # 3 * FILTERS + 1, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        table[:, PAD] = 0
        return cls(
            table,
            np.zeros(FILTERS, np.float32),
            rng.normal(0, (1 / FILTERS) ** 0.5, (3 * FILTERS + 1, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            np.zeros(1, np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def segments(self, data: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each segment's filter maxima, and where they are if asked for."""
        n, tops, at = len(data) - WIDTH + 1, [], []
        for s in range(0, n, BLOCK):
            size = min(BLOCK, n - s)
            acc = self.table[0].take(data[s : s + size], axis=0)
            for j in range(1, WIDTH):
                acc += self.table[j].take(data[s + j : s + j + size], axis=0)
            acc = acc.reshape(-1, SEGMENT, FILTERS)
            if places:
                best = acc.argmax(axis=1)
                at.append(best + s + SEGMENT * np.arange(len(best))[:, None])
                tops.append(np.take_along_axis(acc, best[:, None], axis=1)[:, 0])
            else:
                tops.append(acc.max(axis=1))
        return np.concatenate(tops), np.concatenate(at) if places else None

    def chunks(self, tops: np.ndarray) -> np.ndarray:
        """Maxima over chunks of two neighbouring segments, through the rectifier."""
        pooled = np.maximum(tops[:-1], tops[1:]) if len(tops) > 1 else tops
        return np.maximum(pooled + self.bias, 0)

    def probability(self, features: np.ndarray) -> np.ndarray:
        h = np.maximum(features @ self.hidden + self.hidden_bias, 0)
        return _sigmoid(h @ self.out + self.out_bias)

    def features(self, text: str | None) -> np.ndarray:
        data = to_bytes(text)
        c = self.chunks(self.segments(data)[0])
        return np.concatenate([c.mean(axis=0), c.min(axis=0), c.max(axis=0), length_feature(data)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.probability(np.stack([self.features(t) for t in texts])).astype(float)

    def gradient(self, batch: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        grads = [np.zeros_like(p) for p in self.params()]
        kept, feats = [], []
        for data in batch:
            tops, at = self.segments(data, places=True)
            if len(tops) > 1:
                second = tops[1:] > tops[:-1]
                pooled, where = np.maximum(tops[:-1], tops[1:]), np.where(second, at[1:], at[:-1])
            else:
                pooled, where = tops, at
            act = np.maximum(pooled + self.bias, 0)
            kept.append((act, where))
            feats.append(np.concatenate([act.mean(axis=0), act.min(axis=0), act.max(axis=0), length_feature(data)]))
        x = np.stack(feats)
        pre = x @ self.hidden + self.hidden_bias
        h = np.maximum(pre, 0)
        d_out = (_sigmoid(h @ self.out + self.out_bias) - labels) / len(batch)
        grads[4][:], grads[5][:] = h.T @ d_out, d_out.sum()
        d_h = np.outer(d_out, self.out) * (pre > 0)
        grads[2][:], grads[3][:] = x.T @ d_h, d_h.sum(axis=0)
        d_x = d_h @ self.hidden.T
        filters = np.arange(FILTERS)
        for data, (act, where), d in zip(batch, kept, d_x, strict=True):
            d_act = np.repeat(d[None, :FILTERS] / len(act), len(act), axis=0)
            d_act[act.argmin(axis=0), filters] += d[FILTERS : 2 * FILTERS]
            d_act[act.argmax(axis=0), filters] += d[2 * FILTERS : 3 * FILTERS]
            d_act *= act > 0
            grads[1] += d_act.sum(axis=0)
            for j in range(WIDTH):
                np.add.at(grads[0][j], (data[where + j], filters[None, :]), d_act)
        grads[0][:, PAD] = 0
        return grads


def train(texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on batches that draw both classes alike; with one class only the network leans to it."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    data, y = [to_bytes(t) for t in texts], np.array(labels, np.float32)
    classes = [c for c in (np.nonzero(y == 0)[0], np.nonzero(y == 1)[0]) if len(c)]
    if not classes:
        return net
    first, second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(c, BATCH // len(classes)) for c in classes])
        grads = net.gradient([data[i] for i in chosen], y[chosen])
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-4
        for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on at most CLASS_ROWS labelled documents of each class that are not held out, whole texts alone.

    The rows of a class are drawn among the labels of docs, so labels of other documents take no place.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    usable = labels.where(~is_held_out(F.col("doc_id"))).join(texts.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    parts = [labelled(usable.where(F.col("quality") == c), CLASS_ROWS) for c in (0, 1)]
    sample = parts[0].union(parts[1])
    rows = texts.join(F.broadcast(sample), "id").select("id", "text", "label")
    got = sorted((r.id, r.text, r.label) for r in rows.dropDuplicates(["id"]).collect())
    return train([t for _, t, _ in got], [y for _, _, y in got])


def score(docs: DataFrame, net: Network, text_col: str = "text") -> Column:
    """Probability that each whole text is of label 1; null and empty texts score as a chunk of padding."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(shared.value.scores(b.to_pylist()), pa.float64())

    return run(F.col(text_col))


def keep_good(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The documents that the network trained on labels scores THRESHOLD or more, with their own columns.

    The network is fitted on the labelled documents of source, or of docs without one. Where an earlier
    filter has taken bad documents out of docs, source is the table before it.
    Rows are judged one by one; columns of any name pass through.
    """
    name = fresh(docs, "score")
    net = fit(docs if source is None else source, labels)
    return docs.withColumn(name, score(docs, net)).where(F.col(name) >= THRESHOLD).drop(name)


def op9_quality_cnn(spark, sf_dir: str) -> DataFrame:
    """Score every document; rows whose crc32(doc_id) is divisible by five are never trained on."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(docs, net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
