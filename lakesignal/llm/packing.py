"""Best-fit packing of documents into sequences of several permitted lengths.

A sequence costs its length, a share that grows with the length's square (as
attention does) and a fixed overhead, so long ones pay for themselves only
where they are filled better. Long documents are cut into full pieces of the
longest length and a rest. Rests are packed best fit, longest first: each goes
to the open bin that it fills best; if none has room, every permitted length is
tried on the rests still to come, and the one of least cost for each token that
it can hold of them is opened. Finally each bin is cut down to the shortest
length that holds its contents. Documents are dealt to shards of bounded size
by hash, so bins fill side by side on all executors; a shard's loss is at most
its few last bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (1024, 2048, 4096, 8192)
#: Tokens that a new sequence costs besides its length; a length of so many tokens costs twice its tokens.
OVERHEAD, DOUBLE_AT = 32, 32_768
#: Documents in a shard, about; each sends its number of full pieces and its rest there, one row.
SHARD_DOCS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def cost(length: int, overhead: int = OVERHEAD, double_at: int = DOUBLE_AT) -> float:
    return overhead + length + length * length / double_at


def best_fit(sizes: list[int], opened: Callable[[int], int]) -> tuple[list[int], list[int], list[int]]:
    """Each piece's bin and offset, and each bin's contents; opened(i) is the length of a bin opened for piece i.

    A piece goes to the fullest bin with room, the earliest of equals.
    """
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    bins, offsets, used = [], [], []
    for i, size in enumerate(sizes):
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = opened(i), len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            insort(open_bins, (room - size, b))
    return bins, offsets, used


def pack(
    sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, double_at: int = DOUBLE_AT
) -> tuple[list[int], list[int], list[int]]:
    """Bins of pieces (longest first): each piece's bin and offset, each bin's length.

    A new bin gets the length of least cost for each token of what it would
    hold if it took the largest of the pieces still to come again and again, the
    shorter of equals. Should bins of one length alone (or the next that holds
    the piece) cost less in the end, they are taken.
    """
    lengths = tuple(sorted(lengths))
    falling = [-x for x in sizes]
    price = {n: cost(n, overhead, double_at) for n in lengths}

    def held(i: int, length: int) -> int:
        room, at = length - sizes[i], i + 1
        while (at := bisect_left(falling, -room, at)) < len(sizes):
            room -= sizes[at]
            at += 1
        return length - room

    def jointly(i: int) -> int:
        return min((n for n in lengths if n >= sizes[i]), key=lambda n: (price[n] / held(i, n), n))

    best, least = None, 0.0
    for way in (jointly, *(lambda i, n=n: next(x for x in lengths if x >= max(n, sizes[i])) for n in lengths)):
        bins, offsets, used = best_fit(sizes, way)
        cut = [next(n for n in lengths if n >= u) for u in used]
        total = sum(price[n] for n in cut)
        if best is None or total < least:
            best, least = (bins, offsets, cut), total
    return best


def best_fit_packing(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = OVERHEAD,
    double_at: int = DOUBLE_AT,
) -> DataFrame:
    """One row for each piece of each document: its place in a sequence.

    Returns doc_id, piece (from 0), start and n_tokens (within the document;
    tokens are runs without ASCII white space), seq_id, seq_offset and seq_len.
    A document without tokens, or a null text, gives one piece of 0 tokens with
    no sequence. Every row is packed by itself, rows that repeat an id too;
    equal sizes are placed in the order of doc_id, nulls first. Documents of any
    length are packed whole: their full pieces take no part in the search.
    Extra columns, whatever their names, are ignored. An empty table gives an
    empty table.
    """
    longest = max(lengths)
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.array(n)).alias("n"))
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    # equal rows are counted first, then dealt out by their number, so no shard gets more than its share
    copies = rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    rows = copies.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "nth"), F.lit(shards)).cast("int"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(rest=part["n"] % longest)
        part = part.sort_values(["rest", "doc_id", "n"], ascending=[False, True, True], kind="stable", na_position="first")
        rests = part["rest"].to_numpy()
        packed = int(np.count_nonzero(rests))
        bins, offsets, seq_len = pack([int(x) for x in rests[:packed]], lengths, overhead, double_at)
        none, base = [None] * (len(part) - packed), int(part["shard"].iloc[0]) << 32
        full = (part["n"] // longest).to_numpy()
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"],
                "n": part["n"],
                "full_id": base + len(seq_len) + np.cumsum(full) - full,  # sequences of full pieces follow the bins
                "rest_id": pd.array([base + b for b in bins] + none, "Int64"),
                "rest_offset": pd.array(offsets + none, "Int64"),
                "rest_len": pd.array([seq_len[b] for b in bins] + none, "Int32"),
            }
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n long, full_id long, rest_id long, rest_offset long, rest_len int"
    placed = rows.select("doc_id", "n", "shard").groupBy("shard").applyInPandas(fill, ddl)
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")
    pieces = placed.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    full = F.col("n") - start >= longest
    return pieces.select(
        "doc_id",
        "piece",
        start.alias("start"),
        F.least(F.col("n") - start, F.lit(longest)).alias("n_tokens"),
        F.when(full, F.col("full_id") + F.col("piece")).otherwise(F.col("rest_id")).alias("seq_id"),
        F.when(full, F.lit(0).cast("long")).otherwise(F.col("rest_offset")).alias("seq_offset"),
        F.when(full, F.lit(longest)).otherwise(F.col("rest_len")).alias("seq_len"),
    )


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every document, packed into sequences of 1,024 to 8,192 tokens."""
    from .common import table

    return best_fit_packing(table(spark, sf_dir, "documents"))
