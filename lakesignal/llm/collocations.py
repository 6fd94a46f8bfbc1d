"""Collocations: phrases whose words stand together more often than their parts would by chance.

Words are counted first, then pairs of frequent words, then triples of frequent
pairs. A rare word, pair or triple can't be part of a phrase that occurs LEAST
times, so texts are cut there, which loses nothing; frequent ones are known in
the tasks as tables of bits, whose size is a parameter (a wrong bit only leaves
a phrase for the final count to rule out). The rest goes into generalised suffix
automata, one a shard of bounded size: each state stands for the phrases with
one set of end positions, its count is that set's size, summed along the suffix
links. Phrases of two to MOST_WORDS words are read off the states, and their
counts are added up over all shards: a shard sends them packed, a row for each
bucket of hashes, and a bucket of bounded size adds up its blocks. Along the suffix links a state whose count
is that of a longer one has a single word before it everywhere in its shard; a
phrase for which all shards name the same word is covered by the longer phrase.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table

LEAST = 100
MOST_WORDS = 5
TOP = 2000
#: Bytes of text that a task looks at together, words that one automaton takes, words of one slice of a long run.
CHUNK_BYTES, SHARD_WORDS, SLICE_WORDS = 8 << 20, 150_000, 64
#: Distinct words that a task counts before it passes them on.
FLUSH_WORDS = 400_000
#: Bits of a table for each frequent item, and at most (8 MB).
BITS_EACH, MOST_BITS = 16, 1 << 26
BITS_BLOCK = 1 << 15

#: Bytes that end a piece become a line feed.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
WORDS_DDL = "lang string, phrase string, n long"
PHRASES_DDL = "lang string, bucket long, phrases binary, n binary, before binary"
FOUND_DDL = "lang string, phrase string, size int, a long, covered boolean"
HASHES_DDL = "bucket long, h binary, n binary"
#: Words of all texts for one bucket.
BUCKET_WORDS = 500_000


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _chunks(batches, most: int = CHUNK_BYTES) -> Iterator[dict[str, list[bytes]]]:
    """Normal texts by language, about `most` bytes together; a longer text comes in parts that end with a piece."""
    held, size = defaultdict(list), 0
    for b in batches:
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            raw, at = raw.lower().translate(ENDS), 0
            while at < len(raw):
                end = raw.find(b"\n", at + most) if len(raw) - at > most else -1
                end = len(raw) if end < 0 else end
                held[lang].append(raw[at:end])
                size, at = size + end - at, end
                if size >= most:
                    yield held
                    held, size = defaultdict(list), 0
    if held:
        yield held


def _word_counts(batches):
    """(lang, word, count) of a task, in several parts where it has many words."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def rows():
        lang = [x for x, c in counts.items() for _ in c]
        word = pa.array([w for c in counts.values() for w in c], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), word, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "phrase", "n"])

    for held in _chunks(batches):
        for lang, parts in held.items():
            for raw in parts:
                counts[lang].update(raw.split())
        if sum(map(len, counts.values())) > FLUSH_WORDS:
            yield rows()
            counts.clear()
    yield rows()


class Bits:
    """Which hashes may be among the frequent ones; no frequent one is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits_of(hashes: DataFrame) -> Bits:
    """The table of a settled column of hashes; blocks of it are put together in Spark, the driver gets MOST_BITS / 8 bytes at most."""
    n = hashes.count()
    size = min(MOST_BITS, max(BITS_BLOCK, 1 << (BITS_EACH * n).bit_length()))
    at = hashes.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("at")).distinct()
    at = at.select(F.shiftright("at", BITS_BLOCK.bit_length() - 1).alias("block"), F.col("at").bitwiseAND(F.lit(BITS_BLOCK - 1)).alias("at"))

    def packed(pdf):
        bits = np.zeros(BITS_BLOCK, np.uint8)
        bits[pdf["at"].to_numpy()] = 1
        return pdf[["block"]].head(1).assign(bits=[np.packbits(bits, bitorder="little").tobytes()])

    out = np.zeros(size // 8, np.uint8)
    for r in at.groupBy("block").applyInPandas(packed, "block long, bits binary").collect():
        out[r.block * BITS_BLOCK // 8 :][: BITS_BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return Bits(out)


def _word_hashes(batches):
    for b in batches:
        h = [xxhash.xxh3_64_intdigest(w, _seed(x)) for x, w in zip(b.column("lang").to_pylist(), b.column("phrase").cast(pa.binary()).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], ["h"])


def _coded(parts: list[bytes], lang: str, words: Bits):
    """(distinct words, their place for each position, word hashes, pair hashes, which neighbours are both frequent); pieces end with a line feed."""
    flat: list[bytes] = []
    for raw in parts:
        for piece in raw.split(b"\n"):
            flat += piece.split()
            flat.append(b"\n")
    code = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
    seed = _seed(lang)
    h = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in code], np.uint64)
    frequent = words.has(h)
    frequent[code[b"\n"]] = False
    ok, h = frequent[ids], h[ids]
    pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return list(code), ids, h, pair, ok[:-1] & ok[1:]


def _triples(h: np.ndarray, pair: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of three words in a row, and which of them hold frequent pairs only."""
    return _mix(pair[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]), ok[:-1] & ok[1:]


def _bounds(buckets: int) -> np.ndarray:
    """First hash of every bucket but the first: equal ranges of 64 bits."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def _counts(batches, buckets: int, words: Bits, pairs: Bits | None = None):
    """Hashes and counts, packed by bucket, of pairs of frequent words, or of triples of frequent pairs, in each chunk."""
    bounds = _bounds(buckets)
    for held in _chunks(batches):
        for lang, parts in held.items():
            _, _, h, keys, ok = _coded(parts, lang, words)
            if pairs is not None:
                keys, ok = _triples(h, keys, ok & pairs.has(keys))
            keys, n = np.unique(keys[ok], return_counts=True)
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            rows = [(k, keys[s:e].tobytes(), n[s:e].tobytes()) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["bucket", "h", "n"])


def _frequent(least: int):
    """Adds up a bucket: the hashes with `least` occurrences."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, place = np.unique(np.frombuffer(b"".join(pdf["h"]), np.int64), return_inverse=True)
        n = np.bincount(place, np.frombuffer(b"".join(pdf["n"]), np.int64).astype(float), len(keys))  # exact below 2^53
        return pd.DataFrame({"h": keys[n >= least]})

    return add


class Automaton:
    """Generalised suffix automaton of word sequences, with weighted end positions."""

    def __init__(self):
        self.words: list = []
        self.next: list[dict] = [{}]
        self.link, self.length, self.count, self.end = [-1], [0], [0], [-1]

    def _state(self, length: int, moves: dict, link: int, end: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        self.end.append(end)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of p's longest phrase and word, taken out of q where q's phrases are longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words, context: int = 0, weight: int = 1) -> None:
        """A sequence; ends within its first `context` words don't count."""
        last = 0
        for i, word in enumerate(words):
            self.words.append(word)
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0, len(self.words) - 1), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            if i >= context:
                self.count[last] += weight

    def phrases(self, most: int):
        """(words, count, word before or None) of each distinct phrase of two to `most` words; the word stands before every occurrence."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        count, sole = list(self.count), [None] * len(self.link)
        for v in order:
            count[self.link[v]] += count[v]
        for v in order:
            up = self.link[v]
            if up and count[v] and count[v] == count[up]:
                sole[up] = self.words[self.end[v] - self.length[up]]
        for v in order:
            if not count[v]:
                continue
            end, longest = self.end[v], self.length[v]
            for size in range(max(2, self.length[self.link[v]] + 1), min(most, longest) + 1):
                before = self.words[end - size] if size < longest else sole[v]
                yield self.words[end - size + 1 : end + 1], count[v], before


def _slices(words: list[bytes], ids: np.ndarray, pair_ok: np.ndarray, triple_ok: np.ndarray, most: int):
    """(words, context) of every maximal run of frequent pairs and triples.

    Runs that meet in a rare triple share the word in its middle, so each pair is
    in one run. A long run is cut, each part after the first begins with its context.
    """
    starts, stops = pair_ok.copy(), pair_ok.copy()  # pairs that a run begins and ends with
    starts[1:] &= ~triple_ok
    stops[:-1] &= ~triple_ok
    for start, stop in zip(np.flatnonzero(starts).tolist(), np.flatnonzero(stops).tolist(), strict=True):
        run = [words[i] for i in ids[start : stop + 2].tolist()]
        for s in range(0, len(run), SLICE_WORDS):
            context = min(s, most - 1)
            yield tuple(run[s - context : s + SLICE_WORDS]), context


def _phrase_counts(batches, buckets: int, words: Bits, pairs: Bits, triples: Bits, most: int):
    """Phrases of each shard, packed by bucket: texts, counts, and the hash of the word that precedes every occurrence there (0: none)."""
    bounds = _bounds(buckets)

    def shard(lang: str, held: Counter):
        automaton = Automaton()
        for (run, context), weight in held.items():
            automaton.add(run, context, weight)
        found = [(b" ".join(p), n, None if len(p) == most else before) for p, n, before in automaton.phrases(most)]
        at = np.searchsorted(bounds, np.array([xxhash.xxh3_64_intdigest(p) for p, _, _ in found], np.uint64), side="right")
        code = {None: 0} | {w: (xxhash.xxh3_64_intdigest(w) >> 1) | 1 for w in {b for _, _, b in found} - {None}}
        n, before = np.array([x[1] for x in found], np.int64), np.array([code[x[2]] for x in found], np.int64)
        order = np.argsort(at, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(at[order])) + 1).tolist(), len(order)] if found else [0]
        parts = [order[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
        blocks = [[b"\n".join([found[i][0] for i in x.tolist()]), n[x].tobytes(), before[x].tobytes()] for x in parts]
        columns = [[lang] * len(parts), [int(at[x[0]]) for x in parts], *([b[i] for b in blocks] for i in range(3))]
        types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "bucket", "phrases", "n", "before"])

    held: dict[str, Counter] = defaultdict(Counter)
    sizes: Counter = Counter()
    for chunk in _chunks(batches):
        for lang, parts in chunk.items():
            distinct, ids, h, pair, ok = _coded(parts, lang, words)
            ok &= pairs.has(pair)
            triple, all_ok = _triples(h, pair, ok)
            for run in _slices(distinct, ids, ok, all_ok & triples.has(triple), most):
                if run not in held[lang]:
                    sizes[lang] += len(run[0])
                held[lang][run] += 1
                if sizes[lang] >= SHARD_WORDS:
                    yield shard(lang, held.pop(lang))
                    del sizes[lang]
    for lang, runs in held.items():
        yield shard(lang, runs)


def _added(least: int):
    """Adds up a language's bucket: phrases with `least` occurrences; covered if all shards name the same word before."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame({
            "phrase": [p for b in pdf["phrases"] for p in b.split(b"\n")],
            "n": np.frombuffer(b"".join(pdf["n"]), np.int64),
            "before": np.frombuffer(b"".join(pdf["before"]), np.int64),
        })
        sums = rows.groupby("phrase", sort=False).agg(a=("n", "sum"), low=("before", "min"), high=("before", "max"))
        sums = sums[sums["a"] >= least]
        return pd.DataFrame({
            "lang": pdf["lang"].iloc[0], "phrase": [p.decode() for p in sums.index], "size": [p.count(b" ") + 1 for p in sums.index],
            "a": sums["a"].to_numpy(), "covered": ((sums["low"] > 0) & (sums["low"] == sums["high"])).to_numpy(),
        }).astype({"lang": object, "phrase": object, "size": "int32", "a": "int64", "covered": bool})

    return add


def collocations(
    docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Each language's best `top` phrases: (lang, rank, phrase, a, l, r, n, score).

    a, l, r are the occurrences of the phrase and of its parts at the cut of
    lowest score (ties: the earliest), n those of all words; score is
    floor(1000 a n / (l r)) in decimals of 38 digits, exact for counts up to
    10^16. Phrases within a longer one that occurs as often are left out. Order:
    score, a, phrase (bytes). Null texts are empty, a null language is "und";
    texts without words give nothing, an empty table gives an empty one, every
    repeated row counts, and other columns are ignored. Very long texts are
    worked on in parts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("text").isNotNull())

    counted = texts.mapInArrow(_word_counts, WORDS_DDL).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = settle(counted, "collocation-words")
    frequent = counted.where(F.col("n") >= least)
    words = bits_of(settle(frequent.mapInArrow(_word_hashes, "h long"), "collocation-word-hashes"))
    sieves, buckets = [words], max(16, (counted.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    for name in ("pair", "triple"):
        sent = spark.sparkContext.broadcast(tuple(sieves))
        blocks = texts.mapInArrow(lambda b, sent=sent: _counts(b, buckets, *sent.value), HASHES_DDL)
        sieves.append(bits_of(settle(blocks.groupBy("bucket").applyInPandas(_frequent(least), "h long"), f"collocation-{name}-hashes")))
    sent = spark.sparkContext.broadcast(tuple(sieves))
    blocks = texts.mapInArrow(lambda b: _phrase_counts(b, buckets, *sent.value, most_words), PHRASES_DDL)
    found = settle(blocks.groupBy("lang", "bucket").applyInPandas(_added(least), FOUND_DDL), "collocation-phrases")

    # The other side: a phrase that occurs as often as one with a word more behind it.
    longer = found.where(F.col("size") > 2).select("lang", F.expr("substring_index(phrase, ' ', size - 1)").alias("phrase"), "a").distinct()
    kept = found.where(~F.col("covered")).join(longer, ["lang", "phrase", "a"], "left_anti")

    known = frequent.select("lang", "phrase", "n").union(found.select("lang", "phrase", "a"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("first", first).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counted.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    exact = "(1000 * cast(a as decimal(16)) * cast(n as decimal(16))) div (cast(l as decimal(16)) * cast(r as decimal(16)))"
    cuts = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    best_first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = cuts.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r").withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Phrases of two to five words with 100 occurrences at least, the best 2,000 of each language of all documents.

    Null texts, languages, ties, repeated rows, long texts and empty tables: see collocations().
    """
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), total AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))
), f AS (
  SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), inside AS (
  SELECT DISTINCT lang, g[i:i + m - 1] AS g, f AS most
  FROM (SELECT lang, g, f, k, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 5) t(m) WHERE m < k)
), kept AS (
  SELECT lang, k, g, f AS a FROM f
  WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.g = f.g AND 100 * i.most >= 100 * f.f)
), cuts AS (
  SELECT c.lang, c.g, c.a, t.n, s AS cut, x.f AS l, y.f AS r, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS s FROM kept) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:s] JOIN f y ON y.lang = c.lang AND y.g = c.g[s + 1:] JOIN total t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM lowest
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
