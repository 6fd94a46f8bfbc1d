"""Near-duplicate documents by an LSH forest over word shingles.

Every distinct shingle set gets minhash signatures for several trees; a tree's
key is its signature, read from the first value on. Sorting a tree by key puts
sets with long common prefixes side by side. Neighbours in that order that share
MIN_DEPTH values at least are candidates: all pairs of a region of up to
NEIGHBOURS + 1 sets, in a crowded region those next to each other, which are the
ones that share the deepest prefix there. Signatures rule out most chance
candidates, the full sets confirm the rest.

Direct neighbours in a few trees join most copies into classes; from then on only
candidates of different classes count. A crowded region that still holds
several classes may hide links between distant members. These are found exactly:
with shingles ordered from rare to frequent, linked sets share one among the first
ones of both. Members that share such a shingle and a region meet, few of them as
pairs, many in blocks, which count the shingles that two sets share for all pairs
at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

TREES, DEPTH, MIN_DEPTH = 16, 8, 3
NEIGHBOURS = 8
#: Trees whose direct neighbours the first round confirms.
FIRST_TREES = 3
#: Candidates whose signatures agree in less than this share are ruled out: at a similarity of 0.8
#: (128 values) one in 10^8 is.
LEAST_AGREEMENT = 0.6
#: Sets of crowded regions, about, whose shingles are counted to tell frequent ones, and how many shingles are known
#: as frequent at most. Both only order the shingles; any order finds the same links.
ORDER_SETS, ORDER_VALUES = 8192, 200_000
#: Members that share a shingle are listed as pairs, if there are so many at most, else they meet in blocks.
FEW_PAIRS = 256
#: Sizes that differ by this factor at most are of one class of size, or of two.
SIZE_STEP = 1.05
#: Members in one block: outside the largest class, and of all classes.
OUTSIDE_ROWS, ALL_ROWS = 512, 1024
#: Of two blocks, a shingle that more than one in DENSE_SHARE pairs hold goes through matrix products, DENSE_VALUES
#: at a time; the pairs of the others are added up about PAIR_CELLS at a time.
DENSE_SHARE, DENSE_VALUES, PAIR_CELLS = 128, 1024, 2_000_000
SIGNATURE = np.dtype(">u2")


@lru_cache(maxsize=4)
def _tables(n: int):
    """Random byte values, powers of an odd number and of its inverse (modulo 2^64) for texts of n bytes."""
    rng = np.random.default_rng(20_240_101)
    values = rng.integers(1, 2**63, 256, np.uint64)
    base = 0x9E3779B97F4A7C15
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes of their bytes.

    Words are runs without ASCII white space, A-Z lower-cased; with fewer words
    than width the whole sequence is one shingle, without words there is none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    values, up, down = _tables(1 << max(16, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    if len(words) < width:
        starts, ends = np.zeros(1, np.int64), ends[-1:]
    else:
        starts, ends = (ends - sizes)[: len(words) - width + 1], ends[width - 1 :]
    spans = (sums[ends] - sums[starts]) * down[starts]
    return np.unique(_mix(spans ^ (ends - starts).astype(np.uint64)))


@lru_cache(maxsize=1)
def _permutations():
    rng = np.random.default_rng(20_240_102)
    n = TREES * DEPTH
    return rng.integers(0, 2**31, n, np.uint32)[:, None] * 2 + 1, rng.integers(0, 2**32, n, np.uint32)[:, None]


def signature(hashes: np.ndarray) -> bytes:
    """TREES * DEPTH minhash values, 16 bits of each, tree by tree."""
    a, b = _permutations()
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), None
    for s in range(0, len(low), 4096):
        part = (low[None, s : s + 4096] * a + b).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return (_mix(least.astype(np.uint64)) >> np.uint64(48)).astype(SIGNATURE).tobytes()


def fingerprints(texts: DataFrame, width: int) -> DataFrame:
    """(id, text_hash, n, digest, sig) of texts (id, text); digest names the shingle set and is null for none."""

    def sketch(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, width)
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sig.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["id", "text_hash", "n", "digest", "sig"],
            )

    rows = texts.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sketch, "id long, text_hash long, n long, digest binary, sig binary")


# --- components -----------------------------------------------------------------------------------------------


def _local_roots(batches):
    """Union-find over a task's edges: (node, least node that the task connects it with)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"]
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the least node of its component.

    Each task contracts its own edges first. Nodes with several roots then link
    those roots, a far smaller graph, which is solved the same way.
    """
    local = settle(edges.mapInArrow(_local_roots, "node long, root long"), "cc-local")
    least = local.groupBy("node").agg(F.min("root").alias("label"))
    between = local.join(least, "node").where(F.col("root") != F.col("label"))
    between = settle(between.select(F.col("root").alias("a"), F.col("label").alias("b")).distinct(), "cc-edges")
    if between.isEmpty():
        return least
    above = components(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return least.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


# --- candidates -----------------------------------------------------------------------------------------------


def forest(reps: DataFrame) -> DataFrame:
    """(tree, key, id, label): every set of reps (id, sig, label) once for each tree."""
    size = DEPTH * SIGNATURE.itemsize
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = reps.select("id", "sig", "label", tree.alias("tree"))
    return rows.select("tree", F.substring("sig", F.col("tree") * size + 1, F.lit(size)).alias("key"), "id", "label")


PREFIX = MIN_DEPTH * SIGNATURE.itemsize
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("label", pa.int64())])
PAIR_DDL = "a long, b long, tree int, key binary, label long"


def _neighbours(batches, reach: int):
    """Pairs (a, b, tree) of different labels in sorted rows; then the task's first and last rows, with their keys."""
    recent: list[tuple] = []
    head: list[tuple] = []
    place = 0
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "key", "id", "label")), strict=True):
            if len(head) < reach:
                head.append(row)
            tree, key, i, label = row
            place = place + 1 if recent and recent[-1][0] == tree and recent[-1][1][:PREFIX] == key[:PREFIX] else 0
            for t, _, j, other in recent[-min(place, reach if place <= reach else 1) :] if place else ():
                if other != label:
                    out.append((min(i, j), max(i, j), t, None, None))
            recent = [*recent[-(reach - 1) :], row] if reach > 1 else [row]
        yield _pair_batch(out)
    yield _pair_batch([(i, i, t, k, label) for t, k, i, label in [*head, *recent]])


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(PAIR)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, PAIR, strict=True)], schema=PAIR)


def neighbours(trees: DataFrame, reach: int) -> DataFrame:
    """(a, b, tree): candidates of different labels, at most `reach` apart in a tree's order.

    The order is cut into ranges, so a crowded region spreads over tasks; the
    rows at the cuts meet in a second pass over those alone.
    """
    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = trees.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = settle(run.mapInArrow(lambda b: _neighbours(b, reach), PAIR_DDL), "nd-pairs")
    cuts = found.where("key is not null").select("tree", "key", F.col("a").alias("id"), "label").distinct()
    cuts = cuts.repartitionByRange(1, "tree").sortWithinPartitions("tree", "key", "id")
    across = cuts.mapInArrow(lambda b: _neighbours(b, reach), PAIR_DDL)
    return found.where("key is null").union(across.where("key is null")).select("a", "b", "tree")


# --- confirmation ---------------------------------------------------------------------------------------------


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in LEAST_AGREEMENT of their values."""
    sig = reps.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), SIGNATURE) for c in ("sig_a", "sig_b"))
            share = (x == y).reshape(-1, TREES * DEPTH).mean(axis=1) if len(x) else np.empty(0)
            good = pa.array(share >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return both.mapInArrow(agree, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A & B| >= percent * |A | B| on their full shingle sets."""
    second = pairs.join(texts.toDF("b", "text_b"), "b")
    both = second.join(texts.toDF("a", "text_a"), "a")

    def check(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            cols = (batch.column(c) for c in ("a", "text_a", "text_b"))
            for a, text_a, text_b in zip(*(c.to_pylist() for c in cols), strict=True):
                if a != last:
                    last, own = a, shingles(text_a, width)
                other = shingles(text_b, width)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            good = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of left (sorted, distinct) shares with each of right.

    Values that few pairs share are added pair by pair, the others by matrix product, both in bounded parts.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    shared, sides = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right))), []
    for sets in (left, right):
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        known = np.isin(values, shared)
        at, rows = np.searchsorted(shared, values[known]), rows[known]
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(shared))
        sides.append((rows[order], counts, np.cumsum(counts) - counts))
    (a, n_a, from_a), (b, n_b, from_b) = sides
    often = n_a * n_b > out.size // DENSE_SHARE
    few, many = np.nonzero(~often)[0], np.nonzero(often)[0]
    for part in _parts(few, n_a[few] * n_b[few], PAIR_CELLS):
        size = n_a[part] * n_b[part]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x = a[np.repeat(from_a[part], size) + k // np.repeat(n_b[part], size)]
        y = b[np.repeat(from_b[part], size) + k % np.repeat(n_b[part], size)]
        out += np.bincount(x * len(right) + y, minlength=out.size).reshape(out.shape)
    for s in range(0, len(many), DENSE_VALUES):
        part = many[s : s + DENSE_VALUES]
        both = []
        for n, rows, counts, start in ((len(left), a, n_a[part], from_a[part]), (len(right), b, n_b[part], from_b[part])):
            k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            cells = np.zeros((n, len(part)), np.float32)
            cells[rows[np.repeat(start, counts) + k], np.repeat(np.arange(len(part)), counts)] = 1
            both.append(cells)
        out += both[0] @ both[1].T
    return out.astype(np.int64)


def _parts(items: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """items cut where the sum of sizes passes a multiple of most."""
    return np.split(items, np.nonzero(np.diff(np.cumsum(sizes) // most))[0] + 1) if len(items) else []


def block_links(
    left: list, left_labels: np.ndarray, right: list, right_labels: np.ndarray, percent: int, meet: Callable | None = None
) -> list[tuple[int, int]]:
    """Places (in left, in right) of one linked pair for each two labels that have any; meet tells which pairs count."""
    common = common_counts(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    i, j = np.nonzero((100 * common >= percent * (sizes - common)) & (left_labels[:, None] != right_labels[None, :]))
    if meet:
        good = meet(i, j)
        i, j = i[good], j[good]
    two = np.stack([np.minimum(left_labels[i], right_labels[j]), np.maximum(left_labels[i], right_labels[j])], axis=1)
    first = np.unique(two, axis=0, return_index=True)[1]
    return list(zip(i[first].tolist(), j[first].tolist(), strict=True))


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many of texts (id, text) hold, and how often a sample of ORDER_SETS texts holds them."""

    def split(batches):
        for b in batches:
            for text in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, width).view(np.int64))], ["h"])

    share = -(-texts.count() // ORDER_SETS)
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, share))) == 0).select("text")
    counts = sample.mapInArrow(split, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(ORDER_VALUES).collect()
    values, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(values)
    return values[order], n[order]


def rarest(hashes: np.ndarray, values: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, rare ones first. Sets with a similarity of percent / 100 share one of these.

    As they share percent of the larger set at least, only the rest of it can precede the first shared one.
    """
    often = np.zeros(len(hashes), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        often = np.where(values[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: len(hashes) + percent * len(hashes) // -100 + 1]]


def crowded_links(trees: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of crowded regions, one for each two classes, whatever lies between them in the order.

    Of the regions of several classes, members that share one of their rarest
    shingles are compared on full sets, if they share a region, too: those
    outside the largest class of a shingle with all its members. The place of the
    first shared shingle also bounds the size of a linked set (reach), as what
    precedes it isn't shared; every link is found at its first shared shingle.
    Rows get their texts after they are dealt out.
    """
    rows = trees.withColumn("part", F.substring("key", 1, PREFIX)).select("tree", "part", "id", "label")
    classes = rows.groupBy("tree", "part", "label").agg(F.count("*").alias("n"))
    regions = classes.groupBy("tree", "part").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    mixed = regions.where((F.col("n") > NEIGHBOURS + 1) & (F.col("n") > F.col("most"))).select("tree", "part")
    members = rows.join(mixed, ["tree", "part"]).groupBy("id", "label").agg(F.collect_list(F.xxhash64("tree", "part")).alias("regions"))
    members = settle(members, "nd-crowded")
    bodies = settle(texts.join(members.select("id", "label"), "id").select("id", "label", "text"), "nd-bodies")
    order = texts.sparkSession.sparkContext.broadcast(frequent(bodies, width))

    def first(batches):
        for b in batches:
            ids, labels, sizes, reach, values = [], [], [], [], []
            for i, label, text in zip(*(b.column(c).to_pylist() for c in ("id", "label", "text")), strict=True):
                own = shingles(text, width)
                values.append(rarest(own, *order.value, percent).view(np.int64))
                k = len(values[-1])
                ids.append(np.full(k, i))
                labels.append(np.full(k, label))
                sizes.append(np.full(k, len(own)))
                reach.append(((100 + percent) * (len(own) - np.arange(k))) // percent - len(own))
            cols = [np.concatenate([np.empty(0, np.int64), *x]) for x in (values, ids, labels, sizes, reach)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "id", "label", "size", "reach"])

    held = settle(bodies.mapInArrow(first, "h long, id long, label long, size long, reach long"), "nd-first")
    groups = held.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h")
    groups = groups.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"))
    inside = settle(held.join(groups.where("n > most").select("h", "main"), "h"), "nd-shared")

    # Those outside the main class go to the classes of size that they can be linked with, all members to their own.
    step = lambda c: F.floor(F.log(c) / log(SIZE_STEP)).cast("int")
    low, high = F.ceil(percent * F.col("size") / 100), F.least("reach", F.floor(100 * F.col("size") / percent))
    asked = inside.where("label <> main").select("*", F.explode(F.sequence(step(low), step(high))).alias("step"))
    wanted = asked.groupBy("h", "step").agg(F.count("*").alias("n_asked"), F.min("size").alias("least"))
    there = inside.withColumn("step", step(F.col("size"))).join(wanted, ["h", "step"]).where("reach >= least")
    cells = there.groupBy("h", "step").agg(F.count("*").alias("n"), F.max("n_asked").alias("n_asked"), F.max("least").alias("least"))
    cells = settle(cells.select(
        "h", "step", "least",
        (F.col("n_asked") * F.col("n") <= FEW_PAIRS).alias("few"),
        F.ceil(F.col("n") / ALL_ROWS).cast("int").alias("n_all"),
        F.ceil(F.col("n_asked") / OUTSIDE_ROWS).cast("int").alias("n_out"),
    ), "nd-cells")
    asked = asked.join(cells, ["h", "step"])
    there = inside.withColumn("step", step(F.col("size"))).join(cells, ["h", "step"]).where("reach >= least")

    columns = ["id", "label", "size", "reach"]
    other = there.where("few").select("h", "step", *(F.col(c).alias(f"{c}_b") for c in columns))
    pairs = asked.where("few").select("h", "step", *columns).join(other, ["h", "step"]).where(
        (F.col("label") != F.col("label_b"))
        & (F.col("size_b") <= F.col("reach"))
        & (F.col("size") <= F.col("reach_b"))
        & (100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b"))
    )
    pairs = pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()
    of = members.select("id", "regions")
    pairs = pairs.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b")
    pairs = pairs.where(F.arrays_overlap("of_a", "of_b")).select("a", "b")
    links = confirmed(pairs, bodies.select("id", "text"), width, percent)
    links = links.union(_block_search(asked.where("not few"), there.where("not few"), bodies, of, width, percent))

    labels = members.select("id", "label")
    links = links.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b")
    two = links.groupBy(F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high"))
    return two.agg(F.min(F.struct("a", "b")).alias("link")).select("link.a", "link.b")


def _filled(lists: pd.Series) -> np.ndarray:
    """A row for each list, filled up with its first value."""
    most = max(map(len, lists))
    return np.array([[*x, *[x[0]] * (most - len(x))] for x in lists], np.int64)


def _block_search(asked: DataFrame, there: DataFrame, bodies: DataFrame, of: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of asked and there of one cell (h, step) and a region; their cells have n_all, n_out blocks."""
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    keys = ["h", "step", "blk", "out_blk"]
    known = bodies.select("id", "text").join(of, "id")

    def dealt(df: DataFrame, blk, out_blk) -> DataFrame:
        out = df.select("h", "step", blk.alias("blk"), out_blk.alias("out_blk"), "id", "label").join(known, "id")
        return out.toDF(*out.columns)  # columns of its own, as both sides come from the same table

    everyone = dealt(there, spread("n_all"), F.explode(upto("n_out")))
    outside = dealt(asked, F.explode(upto("n_all")), spread("n_out"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            asked, sets = ([shingles(t, width) for t in x["text"]] for x in (left, right))
            mine, theirs = (_filled(x["regions"]) for x in (left, right))

            def meet(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return np.logical_or.reduce([(mine[i] == theirs[j, k][:, None]).any(axis=1) for k in range(theirs.shape[1])])

            pairs = block_links(asked, left["label"].to_numpy(), sets, right["label"].to_numpy(), percent, meet)
            found = [(left["id"].iat[i], right["id"].iat[j]) for i, j in pairs]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return outside.groupBy(*keys).cogroup(everyone.groupBy(*keys)).applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if their sets of word shingles reach a Jaccard
    similarity of percent / 100; component_id is the smallest id that links
    reach, kept tells whether it is the row's own. Ids are integers. Null and
    empty texts, texts without words and rows without an id have no links
    (n_shingles 0; the component is the own id). Rows with equal sets are one
    class from the start, so repeated rows cost nothing; rows that share an id
    are one document, with the links of all their texts. Texts of any length
    are read whole; a task holds one at a time, about 40 bytes for each of its
    bytes. Extra columns are ignored. An empty table gives none.

    Candidates come from signatures, so a link can be missed with the small
    probability that the module's constants allow; none is reported wrongly.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = settle(fingerprints(texts, width), "nd-prints")
    classed = prints.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    # A set is named by a number of its own, as an id may have several sets.
    reps = classed.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("doc"), F.min("sig").alias("sig"))
    reps = settle(reps.select("digest", F.monotonically_increasing_id().alias("id"), F.col("doc.id").alias("doc_id"), "doc.text_hash", "sig"), "nd-reps")

    # Sets with a neighbour in any tree; the others take no further part.
    near = settle(neighbours(forest(reps.withColumn("label", F.col("id"))), reach=1), "nd-near")
    known = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = settle(reps.join(known, "id", "left_semi").select("id", "doc_id", "text_hash", "sig"), "nd-held")
    own = texts.select(F.col("id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    own = own.join(held.select("doc_id", "text_hash", "id"), ["doc_id", "text_hash"])
    bodies = settle(own.select("id", "text").dropDuplicates(["id"]), "nd-texts")  # rows of an id here are equal

    def check(pairs: DataFrame) -> DataFrame:
        return settle(confirmed(plausible(pairs, held), bodies, width, percent), "nd-links")

    def grow(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        labels = components(links).toDF("id", "label")
        labels = settle(labels, "nd-labels")
        return labels, forest(held.join(labels, "id", "left").select("id", "sig", F.coalesce("label", "id").alias("label")))

    links = check(near.where(F.col("tree") < FIRST_TREES).select("a", "b").distinct())
    labels, trees = grow(links)
    links = links.union(check(neighbours(trees, NEIGHBOURS).select("a", "b").distinct()))
    labels, trees = grow(links)
    far = settle(crowded_links(trees, bodies, width, percent), "nd-far")
    if not far.isEmpty():
        labels, _ = grow(links.union(far))

    # Documents with several sets link them.
    several = classed.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id", "low")
    named = reps.select("digest", F.col("id").alias("node"))
    twins = classed.join(several, "id").select("low", "digest").where("low <> digest").distinct()
    twins = twins.join(named, "digest").select("low", F.col("node").alias("a")).join(named.toDF("low", "b"), "low").select("a", "b")
    twins = settle(twins, "nd-twins")
    if not twins.isEmpty():
        labels, _ = grow(links.union(far).union(twins))

    classes = reps.select("digest", "id", "doc_id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "label").select("digest", "component_id")
    out = prints.select("id", "n", "digest").join(classes, "digest", "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id"))
    return out.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are their component's smallest id, with their own columns; rows without an id stay.

    Of rows that repeat a kept id, all stay that repeat its text, too.
    """
    dropped = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.8."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), width=4).withColumnRenamed("id", "doc_id")


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM s JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON doc_id = x
"""
