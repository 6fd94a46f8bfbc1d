"""Retrieval over chunks: vector and lexical search, rank fusion, reranking, grounding, feedback."""

from __future__ import annotations

from functools import partial, reduce
from operator import and_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.math import clamp01, cosine, dot, sigmoid
from .nearest import Vectors, best_rows

RRF_K = 60
#: Query sets up to here, in rows and bytes, are broadcast; larger ones meet the chunks block by block.
BROADCAST_QUERIES, BROADCAST_BYTES = 2_000, 64 * 2**20
#: Repeated keys up to here are broadcast.
BROADCAST_KEYS = 100_000
#: Queries of lexical search that one pass over the chunks looks for; chunks scored at a time.
PASS_QUERIES, SLICE = 2_000, 256


def candidate_k(top_k: int) -> int:
    """Hits that each list brings to fusion and reranking."""
    return max(3 * top_k, 10)


def meet(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every query with every chunk: a stated query set against all rows."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if n <= BROADCAST_QUERIES and size <= BROADCAST_BYTES:
        return chunks.join(F.broadcast(queries))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return chunks.withColumn("_block", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")).join(spread, "_block").drop("_block")


def _searched(queries: DataFrame, chunks: DataFrame, k: int, cosines: bool, own: bool, ok: Column) -> DataFrame:
    """(query_id, rank, chunk_id, score, ok): the k best chunks of each query, ties by chunk_id.

    Finite vectors of the commonest length are searched block by block (nearest);
    any others meet all rows in Spark's own arithmetic.
    """
    chunks = chunks.select("chunk_id", "e", F.coalesce(ok, F.lit(False)).alias("ok"))
    length = chunks.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").first()
    d = length["d"] if length else 0
    whole = lambda i, v: F.coalesce((F.size(v) == d) & F.col(i).isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False))
    plain_q, plain_e = whole("query_id", "q"), whole("chunk_id", "e")
    (n_q, odd_q), (n_e, odd_e) = (df.agg(F.count("*"), F.count_if(~p)).first() for df, p in ((queries, plain_q), (chunks, plain_e)))
    found = best_rows(queries.where(plain_q), chunks.where(plain_e), (n_q, n_e), k, own, partial(Vectors, cosine=cosines))
    for asked, rows in ((queries.where(~plain_q), chunks),) * bool(odd_q) + ((queries.where(plain_q), chunks.where(~plain_e)),) * bool(odd_e):
        pairs = meet(asked, rows)
        pairs = pairs if own else pairs.where(~F.col("query_id").eqNullSafe(F.col("chunk_id")))
        score = cosine(F.col("q"), F.col("e")) if cosines else clamp01(dot(F.col("q"), F.col("e")))
        found = found.unionByName(pairs.select("query_id", "chunk_id", F.round(score, 6).alias("score"), "ok"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similarity_search(queries: DataFrame, chunks: DataFrame, k: int, condition: Column | None = None, post_filter: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k chunks of greatest inner product, clamped to 0..1, ties by chunk_id.

    queries (query_id, q) is a stated query set that meets all chunks (chunk_id,
    e) block by block; each block keeps k rows a query before the shuffle. Ids are
    integers. The filter holds before the search, or, with post_filter, on its first 2k hits.
    """
    if condition is not None and not post_filter:
        chunks = chunks.where(condition)
    if condition is None or not post_filter:
        return _searched(queries, chunks, k, False, False, F.lit(True)).select("query_id", "rank", "chunk_id", "score")
    order = Window.partitionBy("query_id").orderBy("rank")
    top = _searched(queries, chunks, 2 * k, False, False, condition).where("ok").withColumn("rank", F.row_number().over(order))
    return top.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def cosine_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, cosine): the k chunks of greatest cosine, the query's own among them, ties by chunk_id."""
    found = _searched(queries, chunks, k, True, True, F.lit(True)).where("score is not null")
    return found.select("query_id", "rank", "chunk_id", F.col("score").alias("cosine"))


def cosine_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return meet(queries, chunks).select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("e")), 6).alias("cosine"))


def lexical_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): share of a query's tokens that stand in the chunk's lower-cased text.

    queries: query_id, tokens (array of distinct tokens); chunks: chunk_id
    (integer), text. Queries come in blocks of PASS_QUERIES at most. For a block a
    task finds all its tokens in one pass over each text, adds one to the queries
    of each token found (a sparse index) and passes on k rows a query.
    """
    queries = queries.where(F.size("tokens") > 0)
    blocks = max(1, -(-queries.count() // PASS_QUERIES))
    low = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").alias("low")).where("low is not null")
    kind, found = queries.schema["query_id"].dataType.simpleString(), None
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        search = _token_hits([(r.query_id, r.tokens) for r in asked], to_arrow_type(queries.schema["query_id"].dataType), k)
        part = low.mapInArrow(search, f"query_id {kind}, chunk_id long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _token_hits(queries: list[tuple], id_type: pa.DataType, k: int):
    """The Arrow function (chunk_id, low) -> the task's k best (query_id, chunk_id, score) of each query."""

    def search(batches):
        asking: dict[str, list[int]] = {}  # the queries of each token
        for q, (_, ts) in enumerate(queries):
            for t in ts:
                asking.setdefault(t, []).append(q)
        find = ahocorasick.Automaton()
        for t, qs in asking.items():
            find.add_word(t, np.array(qs, np.int32))
        find.make_automaton()
        counts = np.zeros((len(queries), 0), np.int32)
        ids = np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            for s in range(0, len(batch), SLICE):
                part = batch.slice(s, SLICE)
                here = np.zeros((len(queries), len(part)), np.int32)
                for row, text in enumerate(part.column("low").to_pylist()):
                    hits = {id(qs): qs for _, qs in find.iter(text)}  # each token once, with its own array
                    if hits:
                        here[:, row] = np.bincount(np.concatenate(list(hits.values())), minlength=len(queries))
                counts = np.hstack([counts, here])
                ids = np.hstack([ids, np.broadcast_to(part.column("chunk_id").to_numpy(), (len(queries), len(part)))])
                best = np.lexsort((ids, -counts), axis=1)[:, :k]
                counts, ids = np.take_along_axis(counts, best, 1), np.take_along_axis(ids, best, 1)
        q_at, at = np.nonzero(counts)
        sizes = np.array([len(ts) for _, ts in queries])
        names = pa.array([queries[q][0] for q in q_at], id_type)
        score = pa.array(np.round(counts[q_at, at].astype(float) / sizes[q_at], 6))
        yield pa.RecordBatch.from_arrays([names, pa.array(ids[q_at, at]), score], ["query_id", "chunk_id", "score"])

    return search if queries else lambda batches: iter(())


def fuse(*lists: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, rank, chunk_id) lists."""
    rows = lists[0].select("query_id", "rank", "chunk_id")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "rank", "chunk_id"))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 8).alias("rrf"))


def with_page_hits(fused: DataFrame, pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the pages that queries name, ahead of the fused hits, each once."""
    hits = wanted.join(pages, "page").select("query_id", "chunk_id", F.lit(1.0).alias("rrf"))
    named = fused.select("query_id", "chunk_id").join(wanted, "query_id").join(pages, ["chunk_id", "page"])  # hits that are fused, too
    rest = fused.join(named.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    return hits.unionByName(rest)


def feedback_weight(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (chunk_id, doc) with weight: the chunk's, else (also where that is 0) the document's, else 0."""
    w = weights.select(F.col("key").alias("_k"), F.col("weight").alias("_w"))
    d = weights.select(F.col("key").alias("_d"), F.col("weight").alias("_v"))
    out = rows.join(w, F.col("chunk_id").cast("string") == F.col("_k"), "left").join(d, F.col("doc") == F.col("_d"), "left")
    weight = F.when(F.coalesce("_w", F.lit(0.0)) != 0, F.col("_w")).otherwise(F.coalesce("_v", F.lit(0.0)))
    return out.withColumn("weight", weight).drop("_k", "_w", "_d", "_v")


def rerank_score(cos: Column, hits: Column, history: Column, figure: Column, weight: Column, on_page: Column) -> Column:
    """Composite: .65 cosine, word hits, history hits, figures, feedback; below .35 with hits it rises to .70; a named page adds 2; from 0 to 1."""
    base = 0.65 * cos + F.least(0.08 * hits, F.lit(0.25)) + F.least(0.04 * history, F.lit(0.10)) + F.when(figure, 0.05).otherwise(0.0) + weight
    lifted = F.when((base < 0.35) & (hits > 0), F.lit(0.70)).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(on_page, lifted + 2.0).otherwise(lifted)))


def best_of(rows: DataFrame, score: str, top_k: int, least: float = 0.0) -> DataFrame:
    """(query_id, rank, ...) of the top_k rows of each query that score `least` or more, ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return rows.where(F.col(score) >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


#: Passages in an answer made of what was found, and characters of each.
ANSWER_PASSAGES, PASSAGE_CHARS = 3, 500
ANSWER_HEAD = "Relevant passages from your local documents:\n\n"  # fixed value


def word_hits(text: Column, *tokens: Column, least: int = 3) -> list[Column]:
    """For each array of tokens how many of `least` characters or more stand in the text; the text is lower-cased once for all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = lambda ts, x: F.coalesce(F.size(F.filter(ts, lambda t: (F.length(t) >= least) & x.contains(t))), F.lit(0))
    both = F.transform(F.array(low), lambda x: F.array(*(held(ts, x) for ts in tokens)))
    return [F.greatest(F.element_at(both, 1)[i], F.lit(0)) for i in range(len(tokens))]


def extractive_answer(passages: Column) -> Column:
    """The first passages (array of texts, best first), numbered so that they cite themselves; no passages give no answer."""
    first = F.slice(passages, 1, ANSWER_PASSAGES)
    lines = F.transform(first, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(F.coalesce(t, F.lit("")), 1, PASSAGE_CHARS)))
    return F.when(F.size(first) > 0, F.concat(F.lit(ANSWER_HEAD), F.array_join(lines, "\n\n")))


def token_overlap(tokens: Column, others: Column) -> Column:
    """Share of distinct tokens that are among others; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.array_intersect(tokens, others)) / F.size(F.array_distinct(tokens))).otherwise(0.0)


def calibrated_confidence(mean_top3: Column, overlap: Column) -> Column:
    return F.round(sigmoid(9 * (0.75 * mean_top3 + 0.25 * overlap - 0.45)), 4)


def grounded_confidence(conf: Column, refusal: Column) -> Column:
    """A refusal's confidence is .25 at most."""
    return F.when(refusal, F.least(conf, F.lit(0.25))).otherwise(conf)


def grounding_status(answer: Column, refusal: Column, conf: Column, cited: Column) -> Column:
    return (
        F.when(F.length(F.coalesce(answer, F.lit(""))) == 0, "empty_response")
        .when(refusal, "refusal_not_in_context")
        .when(conf < 0.40, "low_confidence")
        .when(F.size(cited) > 0, "verified_with_citations")
        .otherwise("grounded")
    )


def net_weights(ratings: DataFrame, up: float = 0.12, down: float = 0.15) -> DataFrame:
    """(key, weight) of ratings (keys: array, positive: boolean), rounded to three digits."""
    rows = ratings.select(F.explode("keys").alias("key"), F.when(F.col("positive"), up).otherwise(-down).alias("d"))
    return rows.groupBy("key").agg(F.round(F.sum("d"), 3).alias("weight"))


def last_constraints(ratings: DataFrame, most: int = 10) -> DataFrame:
    """(comment, first_at): the latest of the distinct comments on negative ratings, by when each came first; readers take three."""
    rows = ratings.where(~F.col("positive") & (F.length(F.trim("comment")) > 0))
    return rows.groupBy("comment").agg(F.min("at").alias("first_at")).orderBy(F.desc("first_at"), "comment").limit(most)


def last_turns(turns: DataFrame, n: int = 4, assistant_chars: int = 350) -> DataFrame:
    """(conv_id, history): the last n turns, 'role: text' lines, assistant texts cut."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.withColumn("_n", newest).where(F.col("_n") <= n)
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, assistant_chars)).otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), text).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("vectors"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("org_id").alias("orgs"))


def metadata_filter(rows: DataFrame, equal: dict | None = None, within: dict | None = None) -> DataFrame:
    """Rows whose metadata map holds all given values; a missing key is no match."""
    for k, v in (equal or {}).items():
        rows = rows.where(F.col("metadata")[k].eqNullSafe(F.lit(str(v))))
    for k, vs in (within or {}).items():
        rows = rows.where(F.coalesce(F.col("metadata")[k].isin(*map(str, vs)), F.lit(False)))
    return rows


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_buckets(text: str, size: int) -> Column:
    """The text's words by bucket: structs (bucket, n), none for a text without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    bucket = lambda w: (F.conv(F.substring(F.md5(F.encode(w, "UTF-8")), 1, 8), 16, 10).cast("long") % size).cast("int")

    def counted(b: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | (F.get(b, i) != F.get(b, i - 1)))
        n = lambda at, i, k: (F.coalesce(F.get(at, k + 1), F.size(b)) - i).cast("long")
        return _let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(b, i).alias("bucket"), n(at, i, k).alias("n"))))

    return _let(F.sort_array(F.transform(words, bucket)), lambda b: F.when(F.size(b) > 0, counted(b)))


def _weighed(cells: Column) -> Column:
    """Structs (bucket, weight) of structs (bucket, n), L2-normalised."""
    length = F.sqrt(F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"] * c["n"]))
    return _let(length, lambda x: F.transform(cells, lambda c: F.struct(c["bucket"].alias("bucket"), (c["n"] / x).alias("weight"))))


def hashed_embeddings(rows: DataFrame, key: list[str], text: str, size: int = 384) -> DataFrame:
    """(key..., bucket, weight): bag of hashed lower-case words of two characters or more, L2-normalised, in sparse form.

    Words are counted by bucket within each row, so a task holds one text at a
    time. Only rows whose key repeats are put together, by key and bucket.
    Texts without such words give no rows.
    """
    keys = [f"_key{i}" for i in range(len(key))]
    rows = rows.select(*(F.col(k).alias(n) for k, n in zip(key, keys, strict=True)), F.col(text).alias("_text"))
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"{k}_") for k in keys))
    n = repeated.limit(BROADCAST_KEYS + 1).count()
    single = several = rows
    if n:  # else no text is shuffled
        repeated = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
        single, several = (rows.join(repeated, same, how) for how in ("left_anti", "left_semi"))
    single = single.select(*keys, F.explode(F.array(_word_buckets("_text", size))).alias("_cells"))
    single = single.select(*keys, F.inline(_weighed(F.col("_cells")))).toDF(*key, "bucket", "weight")
    if not n:
        return single
    several = several.select(*keys, F.inline(_word_buckets("_text", size))).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return single.union(several.select(*keys, "bucket", F.col("n") / length))


def cached_embeddings(rows: DataFrame, key: list[str], text: str, size: int = 384) -> DataFrame:
    """hashed_embeddings of texts compared trimmed and in lower case: each distinct one is embedded once and joined back."""
    rows = rows.select(*key, F.lower(F.trim(text)).alias("_text"))
    once = rows.select("_text").distinct().select("_text", F.explode(F.array(_word_buckets("_text", size))).alias("_cells"))
    return rows.join(once, "_text").select(*key, F.inline(_weighed(F.col("_cells"))))
