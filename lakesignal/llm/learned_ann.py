"""Approximate nearest neighbours by cosine, with learned partitions.

On a bounded sample the exact neighbour graph is built and cut into partitions
of nearly equal size that few of its edges cross. A small network learns, from a
vector alone, how its neighbours are spread over the partitions. It puts every
row of the table into the partition it thinks likeliest and sends a query to its
likeliest partitions, until their probabilities add up to a mass that was
calibrated on sampled rows the network has not seen. All rows of the partitions
asked are compared exactly, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Rows that partitions and network are fitted on, at most; rows that carry vectors over BYTES count for more.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 64 << 20
#: Partitions at most (a power of two), sampled rows in each at least.
PARTITIONS, PARTITION_ROWS = 64, 128
#: Neighbours of a row in the graph.
DEGREE = 10
#: A partition may be larger than the mean by this share.
SLACK = 0.05
HIDDEN, EPOCHS, BATCH, RATE = 128, 24, 256, 3e-3
#: Share of the sample kept from the network, and of those rows' neighbours that the calibrated mass must reach.
HELD, TARGET = 0.125, 0.97
#: Rows in one block, queries in one group, at most on average; queries scored at a time.
BLOCK_ROWS, GROUP_ROWS, SLICE = 8192, 8192, 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec holds the components as little-endian doubles."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("raw"))

    def pack(batches):
        for b in batches:
            flat = b.column("raw").flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.cumsum([0, *b.column("raw").value_lengths().to_pylist()])
            packed = [flat[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary())], ["id", "vec"])

    return rows.mapInArrow(pack, "id long, vec binary")


def _matrix(packed, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are padded with zeros, which leaves cosines alone."""
    out = np.zeros((len(packed), dim))
    for i, b in enumerate(packed):
        row = np.frombuffer(b, "<f8")
        out[i, : len(row)] = row
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by their largest component first, so no square leaves the doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, queries: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Places in x of the k rows of largest cosine for each query, all unit vectors; own: query i is row i itself and left out."""
    out = []
    for s in range(0, len(queries), 512):
        score = queries[s : s + 512] @ x.T
        if own:
            score[np.arange(len(score)), np.arange(s, s + len(score))] = -np.inf
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1))
    return np.vstack(out) if out else np.empty((0, k), int)


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """First labels: halves along the direction of most spread, again and again."""
    label = np.zeros(len(x), int)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        split = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            v = y[np.argmax((y * y).sum(axis=1))]
            for _ in range(12):
                v = y.T @ (y @ v)
                v = v / max(np.sqrt(v @ v), 1e-300)
            order = g[np.argsort(y @ v, kind="stable")]
            split += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = split
    for i, g in enumerate(groups):
        label[g] = i
    return label


def balanced(graph: np.ndarray, label: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Labels moved to where most neighbours are, greatest gain first, as long as no partition outgrows its share.

    graph has each row's neighbours; edges count in both directions. A row that
    can't move for a full partition changes places with one that wants the other way.
    """
    n = len(graph)
    label, most = label.copy(), int(np.ceil((1 + SLACK) * n / parts))
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        near = np.zeros((n, parts))
        np.add.at(near, (a, label[b]), 1)
        np.add.at(near, (b, label[a]), 1)
        gain = near - near[np.arange(n), label][:, None]
        to = gain.argmax(axis=1)
        size, waiting, moved = np.bincount(label, minlength=parts), {}, 0
        for i in np.argsort(-gain[np.arange(n), to], kind="stable"):
            here, there = label[i], to[i]
            if gain[i, there] <= 0:
                break
            if size[there] < most:
                size[here], size[there] = size[here] - 1, size[there] + 1
                label[i], moved = there, moved + 1
            elif back := waiting.get((there, here)):
                j = back.pop()
                label[i], label[j], moved = there, here, moved + 2
            else:
                waiting.setdefault((here, there), []).append(i)
        if moved <= n // 500:
            break
    return label


class Router:
    """One hidden layer and a softmax over the partitions; mass is how much of it a query's partitions must hold."""

    def __init__(self, dim: int, parts: int):
        rng = np.random.default_rng(20_260_103)
        self.parts, self.mass = parts, 1.0
        self.w = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, parts)), np.zeros(parts)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x * np.sqrt(x.shape[1]))[1]

    def train(self, x: np.ndarray, target: np.ndarray) -> None:
        """Cross-entropy with shares of neighbours, by Adam."""
        x, rng = x * np.sqrt(x.shape[1]), np.random.default_rng(20_260_104)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order, rate = rng.permutation(len(x)), RATE * (1 - epoch / EPOCHS)
            for s in range(0, len(x), BATCH):
                rows = order[s : s + BATCH]
                h, p = self._forward(x[rows])
                dz = (p - target[rows]) / len(rows)
                dh = (dz @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def before(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions by falling probability, and the mass of those before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        return order, np.cumsum(ranked, axis=1) - ranked

    def calibrate(self, queries: np.ndarray, rows: np.ndarray, k: int) -> None:
        """The least mass with which TARGET of the queries' k nearest rows lie in the partitions asked, and two standard errors more."""
        if not len(queries):
            return
        home = self.probabilities(rows).argmax(axis=1)
        order, before = self.before(queries)
        at = np.argsort(order, axis=1)
        needed = np.take_along_axis(before, np.take_along_axis(at, home[nearest(rows, queries, k)], 1), 1)
        share = TARGET + 2 * np.sqrt(TARGET * (1 - TARGET) / len(queries))
        self.mass = float(np.quantile(needed, min(1.0, share), method="higher"))

    def route(self, x: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
        """Which partitions each query asks: up to the mass, and on until they hold `least` rows; empty ones never."""
        order, before = self.before(x)
        rows = np.cumsum(count[order], axis=1) - count[order]
        asked = np.zeros(order.shape, bool)
        np.put_along_axis(asked, order, (before <= self.mass) | (rows < least), axis=1)
        return asked & (count > 0)


def fit(sample: np.ndarray, k: int) -> Router:
    """Graph, partitions, network and mass from different unit vectors; few of them make one partition."""
    n = len(sample)
    parts = 1 << max(0, min(PARTITIONS.bit_length() - 1, (n // PARTITION_ROWS).bit_length() - 1))
    router = Router(sample.shape[1], parts)
    if parts == 1:
        return router
    held = np.random.default_rng(20_260_105).random(n) < HELD
    rows, queries = sample[~held], sample[held]
    graph = nearest(rows, rows, DEGREE, own=True)
    label = balanced(graph, halved(rows, parts), parts)
    target = np.zeros((len(rows), parts))
    np.add.at(target, (np.repeat(np.arange(len(rows)), DEGREE), label[graph].ravel()), 1 / (DEGREE + 1))
    np.add.at(target, (np.arange(len(rows)), label), 1 / (DEGREE + 1))
    router.train(rows, target)
    router.calibrate(queries, rows, k)
    return router


def learned_ann(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None
) -> DataFrame:
    """Each query's k nearest rows found by cosine: (query_id, rank, id, score).

    is_query is a condition on the column ``id``. Ties go to the smaller id.
    score is the cosine of the two rows' own components in doubles. Vectors that
    are null, zero or empty or hold null, NaN or infinite components take no
    part, nor do rows without an id. Vectors of unequal length compare as if
    padded with zeros. Rows that repeat an id are queries and candidates each;
    only a query's own row is none of its candidates. Every row is indexed, and a
    query asks on until its partitions hold k others, so fewer than k results
    mean fewer than k candidates. Extra columns are ignored, an empty table gives
    an empty one. A report, if given, gets the partitions, the mass and the
    share of (query, row) pairs that are compared.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()), "ann-rows")
    n, bytes_most = rows.agg(F.count("*"), F.max(F.length("vec"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dim = bytes_most // 8
    drawn = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // bytes_most))).collect()
    router = fit(np.unique(unit(_matrix([r.vec for r in drawn], dim)), axis=0), k)

    def place(batches):
        for b in batches:
            home = router.probabilities(unit(_matrix(b.column("vec").to_pylist(), dim))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype("int32"))], ["id", "vec", "uid", "part"])

    placed = settle(rows.mapInArrow(place, "id long, vec binary, uid long, part int"), "ann-placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()
    count, asking = np.zeros(router.parts, int), np.zeros(router.parts, int)
    for r in sizes:
        count[r.part], asking[r.part] = r.n, r.q
    blocks, groups = np.maximum(1, -(-count // BLOCK_ROWS)), np.maximum(1, -(-asking // GROUP_ROWS))
    # Query groups: partitions side by side up to GROUP_ROWS; one with more is split by hash.
    first, at, filled = np.zeros(router.parts, int), -1, GROUP_ROWS
    for c in np.flatnonzero(asking):
        if filled + asking[c] > GROUP_ROWS:
            at, filled = at + 1, 0
        first[c], filled = at, filled + asking[c]
        if groups[c] > 1:
            at, filled = at + int(groups[c]) - 1, GROUP_ROWS
    if report is not None:
        report |= {"partitions": router.parts, "mass": router.mass}

    def spread(batches):
        """A query for each block of the partitions it asks; a group has queries of few partitions."""
        for whole in batches:
            for s in range(0, len(whole), SLICE):
                b = whole.slice(s, SLICE)
                asked = router.route(unit(_matrix(b.column("vec").to_pylist(), dim)), count, k + 1)
                q_at, part = np.nonzero(asked)
                times = blocks[part]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q_at, part = np.repeat(q_at, times), np.repeat(part, times)
                home = b.column("part").to_numpy()[q_at]
                grp = first[home] + b.column("uid").to_numpy()[q_at] % groups[home]
                columns = [pa.array(x.astype("int32")) for x in (grp, part, block)]
                columns += [b.column(c).take(pa.array(q_at)) for c in ("uid", "id", "vec")]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "part", "block", "uid", "id", "vec"])

    ddl = "grp int, part int, block int, uid long, id long, vec binary"
    asked = settle(placed.where(is_query).select("uid", "id", "vec", "part").mapInArrow(spread, ddl), "ann-asked")
    n_blocks = F.element_at(F.lit([int(x) for x in blocks]), F.col("part") + 1)
    held = placed.select("part", F.pmod(F.xxhash64("uid"), n_blocks).cast("int").alias("block"), "uid", "id", "vec")
    if report is not None:
        compared = asked.groupBy("part", "block").count().join(held.groupBy("part", "block").agg(F.count("*").alias("rows")), ["part", "block"])
        report["compared"] = (compared.agg(F.sum(F.col("count") * F.col("rows"))).first()[0] or 0) / max(1, n * int(asking.sum()))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["id", "uid"])
            right = right[right.groupby("vec").cumcount() <= k]  # of equal vectors only the first can be among the nearest
            x = _matrix(right["vec"].tolist(), dim)
            x_unit, x_id, x_uid = unit(x), right["id"].to_numpy(), right["uid"].to_numpy()
            for s in range(0, len(left), SLICE):
                part = left.iloc[s : s + SLICE]
                q = _matrix(part["vec"].tolist(), dim)
                rough = unit(q) @ x_unit.T
                for uid, q_id, row, near in zip(part["uid"], part["id"], q, rough, strict=True):
                    other = np.nonzero(x_uid != uid)[0]
                    if len(other) > k:
                        other = other[near[other] >= np.partition(near[other], len(other) - k)[len(other) - k] - 1e-9]
                    score = cosine(row, x[other])
                    best = np.lexsort((other, -score))[:k]  # equal scores in the order of ids
                    out += [(uid, q_id, x_id[other[j]], x_uid[other[j]], score[j]) for j in best]
        return pd.DataFrame(out, columns=["uid", "query_id", "id", "other", "score"]).astype({"uid": "int64", "query_id": "int64", "id": "int64", "other": "int64", "score": "float64"})

    keys = ["grp", "part", "block"]
    pairs = asked.select(*(F.col(c).alias(c) for c in keys)).distinct()
    sent = held.join(pairs, ["part", "block"]).select(*keys, "uid", "id", "vec")
    found = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "uid long, query_id long, id long, other long, score double")
    best_first = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of x, added up in the same order for every row; components are scaled where squares could leave the doubles."""
    top_q, top_x = np.abs(q).max(), np.abs(x).max(axis=1, keepdims=True)
    if not (1e-120 < top_q < 1e120):
        q = q / top_q
    x = np.where((top_x > 1e-120) & (top_x < 1e120), x, x / top_x)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def op11_learned_ann(spark, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 50; the five nearest rows found by cosine among all others.

    Nulls, zero vectors, ties, repeated ids, unequal lengths and empty tables: see learned_ann().
    """
    found = learned_ann(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
