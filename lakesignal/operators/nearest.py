"""The best rows for each query among all rows, exactly, block by block.

Queries and rows are cut into blocks; each block of queries meets each block of
rows in one group, which scores slices of rows in numpy and keeps k rows a query. A
slice is scored at matrix speed first; only pairs that may still enter the
best k are scored again in the documented order of additions, so that results do not
depend on blocks. Rows go by id, so ties never displace what is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows of a block at most, rows of the first slice and of all others, rows that are worth a group of their own.
BLOCK_QUERIES, BLOCK_ROWS, FIRST_SLICE, SLICE, LEAST_ROWS = 8_192, 65_536, 64, 512, 2_048
#: Pairs scored exactly at a time.
PAIRS = 1 << 18
#: Error that matrix products may have, for values about 1.
SLACK = 1e-11


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as rows of doubles."""
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(values), -1)


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added from left to right."""
    return np.cumsum(a * b, axis=1)[:, -1]


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as decimal text is, halves away from zero."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x)
    unsure = np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)[0]
    unit = Decimal(1).scaleb(-digits)
    for i in unsure:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return out + 0.0


class Vectors:
    """Inner products, clamped to 0..1, or cosines of vector columns q and e."""

    digits, most = 6, 1.0

    def __init__(self, left: pa.Table, right: pa.Table, cosine: bool):
        self.q, self.e, self.cosine = matrix(left["q"]), matrix(right["e"]), cosine
        self.q_norm, self.e_norm = (np.sqrt(row_dots(x, x)) for x in (self.q, self.e))
        if not cosine:
            self.slack = SLACK * (1 + self.q_norm * self.e_norm.max(initial=0.0))
        else:
            self.most, self.slack = np.inf, np.full(len(self.q), SLACK)

    def rough(self, s: int, e: int) -> np.ndarray:
        dots = self.q @ self.e[s:e].T
        return dots / (np.outer(self.q_norm, self.e_norm[s:e]) + 1e-8) if self.cosine else dots

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dots = row_dots(self.q[i], self.e[j])
        return dots / (self.q_norm[i] * self.e_norm[j] + 1e-8) if self.cosine else np.clip(dots, 0.0, 1.0)


def _merge(ids: np.ndarray, scores: np.ndarray, i: np.ndarray, new_ids: np.ndarray, new: np.ndarray, at: np.ndarray, new_at: np.ndarray) -> None:
    """Put found rows (query i, id, score, place) among the best so far, in place."""
    k = scores.shape[1]
    order = np.lexsort((new_ids, -new, i))
    i, new_ids, new, new_at = i[order], new_ids[order], new[order], new_at[order]
    asked, start, n = np.unique(i, return_index=True, return_counts=True)
    place = np.arange(len(i)) - np.repeat(start, n)
    first = place < k
    line = np.repeat(np.arange(len(asked)), n)[first]
    width = min(k, int(n.max()))
    wide = (np.full((len(asked), width), -np.inf), np.full((len(asked), width), np.iinfo(np.int64).max), np.full((len(asked), width), -1, np.int64))
    for w, x in zip(wide, (new, new_ids, new_at), strict=True):
        w[line, place[first]] = x[first]
    all_scores, all_ids, all_at = (np.hstack([old[asked], w]) for old, w in zip((scores, ids, at), wide, strict=True))
    best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    for old, x in ((scores, all_scores), (ids, all_ids), (at, all_at)):
        old[asked] = np.take_along_axis(x, best, 1)


def _search(k: int, own: bool, scorer: Callable, id_types: tuple[pa.DataType, pa.DataType]):
    """The function of two Arrow tables: each query's k best of the block's rows."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("chunk_id")
        asked, rows = (t[c].to_numpy().astype(np.int64) for t, c in ((left, "query_id"), (right, "chunk_id")))
        ids = np.full((len(asked), k), np.iinfo(np.int64).max)
        scores, at = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1, np.int64)
        if len(asked) and len(rows):
            score = scorer(left, right)
            half, s, size = 0.5 / 10**score.digits, 0, FIRST_SLICE
            while s < len(rows):
                e = min(len(rows), s + size)
                worst = scores[:, -1]
                least = np.where(worst >= score.most, np.inf, worst + half) - score.slack
                i, j = np.nonzero(score.rough(s, e) >= least[:, None])
                j += s
                if not own:
                    other = asked[i] != rows[j]
                    i, j = i[other], j[other]
                if len(i):
                    parts = [score.exact(i[p : p + PAIRS], j[p : p + PAIRS]) for p in range(0, len(i), PAIRS)]
                    _merge(ids, scores, i, rows[j], half_up(np.concatenate(parts), score.digits), at, j)
                s, size = e, SLICE
        line, place = np.nonzero(at >= 0)
        got = at[line, place]
        return pa.table({
            "query_id": pa.array(asked[line]).cast(id_types[0]), "chunk_id": pa.array(rows[got]).cast(id_types[1]),
            "score": pa.array(scores[line, place]), "ok": right["ok"].combine_chunks().take(pa.array(got)),
        })

    return search


def best_rows(queries: DataFrame, rows: DataFrame, sizes: tuple[int, int], k: int, own: bool, scorer: Callable) -> DataFrame:
    """(query_id, chunk_id, score, ok): each query's k best rows of each block, by score and then id; readers keep k of them.

    queries have query_id, rows have chunk_id and ok (boolean); ids are integers
    and not null. sizes are their (upper) numbers. scorer makes of a block of each what
    Vectors is. own tells whether a query may find the row of its own id.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q = max(1, -(-sizes[0] // BLOCK_QUERIES))
    n_r = max(1, -(-sizes[1] // BLOCK_ROWS), min(-(-parts // n_q), sizes[1] // LEAST_ROWS))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("_q", of("query_id", n_q)).withColumn("_r", upto(n_r))
    right = rows.withColumn("_r", of("chunk_id", n_r)).withColumn("_q", upto(n_q))
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((queries, "query_id"), (rows, "chunk_id"))]
    types = tuple({"bigint": pa.int64(), "int": pa.int32()}[x] for x in kinds)
    keys = ["_q", "_r"]
    out = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, ok boolean"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, own, scorer, types), out)
