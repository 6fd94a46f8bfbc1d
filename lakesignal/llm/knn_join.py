"""Exact top-k search by inner product as a Voronoi kNN join.

With M the greatest norm, a vector x gets the coordinate sqrt(M^2 - |x|^2) and a
query the coordinate 0: their squared distance is then |q|^2 + M^2 - 2 q.x, so
the highest products are the nearest neighbours. A bounded sample of vectors
serves as pivots; every vector goes to the cell of its nearest pivot. A summary
of each cell (size, least and greatest distance from the pivot) bounds its
distance from a query: by the ring that holds its members, by the plane half way
to the query's nearest pivot, and the products directly by |q| times the radius.

A query is solved first in the cells of highest bounds that hold enough rows. Its
k-th score there rules out every cell whose bound stays below it; the others
are solved in a second round. Queries are grouped by cell, cells are cut into
blocks of bounded size, and a block is sent only to the query groups that need
its cell. Each (query group, block) pair is solved by one matrix product; a
ranking over the few rows that come out gives the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

MAX_PIVOTS = 256
#: Vectors for one pivot at least.
CELL_ROWS = 1024
#: Candidates in one block, queries in one group, at most on average.
BLOCK_ROWS = 8192
GROUP_ROWS = 8192
#: Queries that are spread or scored at a time.
SLICE = 512
#: Integers up to here are exact in a double.
EXACT = 2.0**53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, vec, square) of the rows that take part; vec holds floor(scale * x) as little-endian doubles, square its squared norm."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("raw"))

    def pack(batches):
        for b in batches:
            raw = b.column("raw")
            flat = np.floor(scale * raw.flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            ends = np.cumsum([0, *raw.value_lengths().to_pylist()])
            parts = [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            packed, squares = pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([float(x @ x) for x in parts], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("id"), packed, squares], ["id", "vec", "square"])

    return rows.mapInArrow(pack, "id long, vec binary, square double")


def _matrix(packed, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are padded with zeros, which leaves inner products alone."""
    out = np.zeros((len(packed), dim))
    for i, b in enumerate(packed):
        row = np.frombuffer(b, "<f8")
        out[i, : len(row)] = row
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; beyond a long they end at its limits."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(x).T, LONG_MIN, LONG_MAX).astype(np.int64)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None, :], 0)
    cell = gap.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


class Cells:
    """Pivots (with the added coordinate) and summaries of their cells; at most MAX_PIVOTS of each."""

    def __init__(self, pivots: np.ndarray, square: float, count: np.ndarray, nearest: np.ndarray, radius: np.ndarray):
        self.pivots, self.square, self.count, self.nearest, self.radius = pivots, square, count, nearest, radius
        self.apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(2))

    def highest(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell a product that no member exceeds, -inf for an empty cell; rounding's share is added."""
        q = np.hstack([q, np.zeros((len(q), 1))])
        norm = (q**2).sum(1)[:, None]
        away = np.sqrt(((q[:, None] - self.pivots[None]) ** 2).sum(2)) if len(q) else np.zeros((0, len(self.pivots)))
        own = away.argmin(1) if len(q) else np.zeros(0, int)
        near = away[np.arange(len(q)), own][:, None]
        apart = self.apart[own]
        plane = np.divide(away**2 - near**2, 2 * apart, out=np.zeros_like(away), where=apart > 0)
        least = np.maximum.reduce([away - self.radius, self.nearest - away, plane, np.zeros_like(away)])
        by_distance = (norm + self.square - least**2) / 2
        by_radius = q @ self.pivots.T + np.sqrt(norm) * self.radius
        slack = 1e-9 * (norm + self.square + 1)
        bound = np.minimum(by_distance, by_radius) + slack
        return np.where(self.count > 0, np.where(np.isnan(bound), np.inf, bound), -np.inf)  # beyond doubles nothing is ruled out

    def first_round(self, highest: np.ndarray, least: int) -> np.ndarray:
        """The cells of highest bounds that together hold `least` rows, or all."""
        order = np.argsort(-highest, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        taken = np.zeros(highest.shape, bool)
        np.put_along_axis(taken, order, before < least, axis=1)
        return taken & (self.count > 0)


def knn_join(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 256.0,
    report: dict | None = None,
) -> DataFrame:
    """Each query's k highest inner products over all other rows, exactly.

    is_query is a condition on the column ``id``. Returns query_id, rank (from
    1), id and score; ties go to the smaller id. Vectors that are null or hold
    null, NaN or infinite components take no part, nor do rows without an id.
    Vectors of unequal length compare as if padded with zeros; an empty vector
    scores 0. Rows that repeat an id are queries and candidates each; only a
    query's own row is none of its candidates. Fewer than k candidates give
    fewer rows. Scores beyond a long end at its limits. Extra columns are
    ignored. An empty table gives an empty table. A report, if given, gets the
    share of (query, row) pairs that were scored.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, id_col, vec_col, scale).withColumn("uid", F.monotonically_increasing_id()), "knn-rows")

    n, bytes_most, square = rows.agg(F.count("*"), F.max(F.length("vec")), F.max("square")).first()
    schema = "query_id long, rank int, id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    dim = bytes_most // 8

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(square - (x**2).sum(1), 0))[:, None]])

    n_pivots = int(min(MAX_PIVOTS, max(1, round(n / CELL_ROWS))))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(n_pivots).collect()
    pivots = np.unique(lifted(_matrix([r.vec for r in sample], dim)), axis=0)

    def assign(batches):
        for b in batches:
            cell, gap = _nearest(lifted(_matrix(b.column("vec").to_pylist(), dim)), pivots)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype("int32")), pa.array(gap)], ["id", "vec", "uid", "cell", "gap"]
            )

    placed = settle(rows.drop("square").mapInArrow(assign, "id long, vec binary, uid long, cell int, gap double"), "knn-placed")
    n_cells = len(pivots)
    count, nearest, radius = np.zeros(n_cells, int), np.zeros(n_cells), np.full(n_cells, -1.0)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect():
        count[r.cell], nearest[r.cell], radius[r.cell] = r.n, r.low, r.high
    cells = Cells(pivots, square, count, nearest, radius)

    # Query groups: whole cells side by side up to GROUP_ROWS; a cell with more is split by hash.
    queries = placed.where(is_query).select("uid", "id", "vec", "cell")
    q_sizes = dict(queries.groupBy("cell").count().collect())
    first, parts, at, filled = np.zeros(n_cells, int), np.ones(n_cells, int), -1, GROUP_ROWS
    for c in sorted(q_sizes):
        if q_sizes[c] > GROUP_ROWS:
            parts[c] = -(-q_sizes[c] // GROUP_ROWS)
            first[c], at, filled = at + 1, at + int(parts[c]), GROUP_ROWS
            continue
        if filled + q_sizes[c] > GROUP_ROWS:
            at, filled = at + 1, 0
        first[c], filled = at, filled + q_sizes[c]
    blocks = np.maximum(1, -(-count // BLOCK_ROWS))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["grp", "cell", "block", "uid", "id", "vec"]

    def spread(batches, second: bool):
        """A query goes to the blocks of the first round's cells, or of the others that its k-th score does not rule out."""
        for whole in batches:
            for s in range(0, len(whole), SLICE):
                b = whole.slice(s, SLICE)
                highest = cells.highest(_matrix(b.column("vec").to_pylist(), dim))
                taken = cells.first_round(highest, 2 * k + 1)
                if second:
                    kth = np.array([-np.inf if x is None else float(x) for x in b.column("kth").to_pylist()])
                    taken = ~taken & (highest >= kth[:, None]) & (count > 0)
                q_at, c_at = np.nonzero(taken)
                times = blocks[c_at]
                blk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q_at, c_at = np.repeat(q_at, times), np.repeat(c_at, times)
                uid, home = b.column("uid").to_numpy(), b.column("cell").to_numpy()[q_at]
                grp = first[home] + uid[q_at] % parts[home]
                picked = pa.array(q_at)
                columns = [pa.array(grp), pa.array(c_at), pa.array(blk), *(b.column(x).take(picked) for x in ("uid", "id", "vec"))]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns, types, strict=True)], names)

    n_blocks = F.element_at(F.lit([int(x) for x in blocks]), F.col("cell") + 1)
    held = placed.select("cell", F.pmod(F.xxhash64("uid"), n_blocks).cast("int").alias("block"), "uid", "id", "vec")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["id", "uid"])
            x, x_id, x_uid = _matrix(right["vec"].tolist(), dim), right["id"].to_numpy(), right["uid"].to_numpy()
            for s in range(0, len(left), SLICE):
                part = left.iloc[s : s + SLICE]
                score = _scores(_matrix(part["vec"].tolist(), dim), x)
                for uid, q, row in zip(part["uid"], part["id"], score, strict=True):
                    other = np.nonzero(x_uid != uid)[0]
                    if len(other) > k:
                        cut = np.partition(row[other], len(other) - k)[len(other) - k]
                        other = other[row[other] >= cut]
                    best = other[np.lexsort((other, -row[other].astype(object)))][:k]  # equal scores in the order of ids
                    out += [(uid, q, x_id[j], x_uid[j], row[j]) for j in best]
        return pd.DataFrame(out, columns=["uid", "query_id", "id", "other", "score"]).astype("int64")

    def solved(asked: DataFrame) -> DataFrame:
        keys = ["grp", "cell", "block"]
        pairs = asked.select(*(F.col(c).alias(c) for c in keys)).distinct()
        sent = held.join(pairs, ["cell", "block"]).select(*names)
        ddl = "uid long, query_id long, id long, other long, score long"
        return asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, ddl)

    ddl = "grp long, cell int, block int, uid long, id long, vec binary"
    asked = settle(queries.mapInArrow(lambda b: spread(b, False), ddl), "knn-asked")
    found = settle(solved(asked), "knn-first")
    scores = F.reverse(F.array_sort(F.collect_list("score")))
    kth = found.groupBy("uid").agg(F.try_element_at(scores, F.lit(k)).alias("kth"))
    rest = queries.join(kth, "uid", "left").mapInArrow(lambda b: spread(b, True), ddl)
    rest = settle(rest, "knn-rest")
    if report is not None:
        sizes = held.groupBy("cell", "block").agg(F.count("*").alias("rows"))
        scored = asked.union(rest).join(F.broadcast(sizes), ["cell", "block"]).agg(F.sum("rows")).first()[0]
        report["scored"] = (scored or 0) / max(1, n * sum(q_sizes.values()))
    best_first = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")
    return (
        found.union(solved(rest))
        .withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    )


def op3_knn_join(spark, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 50; the five highest integer inner products over all other rows."""
    from .common import table

    found = knn_join(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS q, c.row AS c, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
