"""Byte-pair encoding and decoding through a table of distinct words.

Tasks split texts into words and number each block's distinct words by first
occurrence. The words of all blocks meet in one shuffle by word: there each
distinct word is encoded once, and its ids go back to every (block, number)
that holds it. A second pass writes each block's texts as word numbers; joined
with the block's table by the block's name, positions turn into ids. No word
goes another way, and no table passes through the driver.

A block is named by a hash of its words in order. So should the two passes ever
cut texts differently, a block finds no table and the job fails; it can't give
wrong ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

#: A block ends at so many distinct words or characters, at the end of a text.
BLOCK_WORDS, BLOCK_CHARS = 300_000, 16_000_000
#: Encoded words that a task gathers before it packs them by block.
TASK_WORDS = 500_000
#: Bytes of output that a task gathers.
OUT_BYTES = 8_000_000
#: Fixed values of the public byte-level format: white space (Unicode's), contractions, the order of alternatives.
WHITE = "\t-\r \x85\xa0  -     　"
#: Letters and numbers below U+02B0, for a faster pattern on the texts that hold nothing above.
LOW_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
LOW_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(letters: str, numbers: str) -> str:
    return (
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+"
        f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


LOW_WORDS = re.compile(_pattern(LOW_LETTERS, LOW_NUMBERS))
ALL_WORDS = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
ABOVE_LOW = re.compile("[^\x00-ʯ]")


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """pieces: bytes of each id; joins: (id, id) -> (rank, id); specials: text -> id."""

    pieces: list[bytes]
    byte_ids: list[int]
    joins: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizers file of a byte-level BPE model; the driver reads it, tasks get a broadcast."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, chars = spec["model"]["vocab"], byte_of_char()
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = [b""] * (max([*ids.values(), *specials.values()]) + 1)
        for piece, i in ids.items():
            pieces[i] = bytes(chars[c] for c in piece)
        for text, i in specials.items():
            pieces[i] = text.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        joins = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        by_byte = {b: ids[c] for c, b in chars.items()}
        return cls(pieces, [by_byte[b] for b in range(256)], joins, specials)

    def encode_word(self, word: bytes) -> list[int]:
        """Join the pair of lowest rank, the leftmost first, until no pair can be joined."""
        ids, joins = [self.byte_ids[b] for b in word], self.joins
        n = len(ids)
        if n > 64:
            return self._encode_long(ids)
        while n > 1:
            best = None
            for i in range(n - 1):
                j = joins.get((ids[i], ids[i + 1]))
                if j and (best is None or j[0] < best[0]):
                    best, at = j, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
            n -= 1
        return ids

    def encode_packed(self, word: str) -> bytes:
        """Ids of a word, or of a special token's text, as little-endian unsigned 32-bit integers."""
        special = self.specials.get(word)
        return np.array(self.encode_word(word.encode()) if special is None else [special], "<u4").tobytes()

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, n log n for words of any length."""
        n, joins = len(ids), self.joins
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours still in the list
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (found := joins.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]


def split_words(text: str) -> list[str]:
    return (ALL_WORDS if ABOVE_LOW.search(text) else LOW_WORDS).findall(text)


def _splitter(specials: dict[str, int]):
    """text -> words; a special token's text is a word of its own."""
    if not specials:
        return split_words
    cut = re.compile("(" + "|".join(sorted(map(re.escape, specials), key=len, reverse=True)) + ")")

    def split(text: str) -> list[str]:
        parts = cut.split(text)
        if len(parts) == 1:
            return split_words(text)
        return [w for p in parts if p for w in ([p] if p in specials else split_words(p))]

    return split


class Numbers(dict):
    """Numbers words by first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def blocks(batches, split, positions: bool) -> Iterator[tuple[Numbers, list, list[np.ndarray]]]:
    """(numbers of the words, keys, each text's word numbers) of each block; without positions only the numbers are kept."""
    numbers, keys, codes, chars = Numbers(), [], [], 0
    for b in batches:
        names = b.column("key").to_pylist() if positions else None
        for row, text in enumerate(b.column("text").to_pylist()):
            words = split(text) if text else []
            if positions:
                keys.append(names[row])
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            else:
                numbers.update(zip(words, words, strict=True))  # a word seen before keeps its place
            chars += len(text or "")
            if len(numbers) >= BLOCK_WORDS or chars >= BLOCK_CHARS:
                yield numbers, keys, codes
                numbers, keys, codes, chars = Numbers(), [], [], 0
    if numbers or keys:
        yield numbers, keys, codes


def name_of(words) -> int:
    """A block's name: 64 bits of a hash of its words in order."""
    lengths = np.fromiter(map(len, words), np.uint32, len(words)).tobytes()
    named = hashlib.blake2b("".join(words).encode("utf-8", "surrogatepass") + lengths, digest_size=8)
    return int.from_bytes(named.digest(), "little", signed=True)


def pack_codes(codes: list[np.ndarray]) -> bytes:
    """Numbers as four planes of bytes, lowest first, compressed: high planes are nearly empty."""
    flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    return zlib.compress(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_codes(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def block_words(texts: DataFrame, specials: dict[str, int]) -> DataFrame:
    """(block, number, word): every distinct word of every block, once."""

    def run(batches):
        for numbers, _, _ in blocks(batches, _splitter(specials), positions=False):
            name = name_of(numbers)
            in_order = sorted((w, i) for i, w in enumerate(numbers))  # neighbours share beginnings, so they compress
            for s in range(0, len(in_order), 50_000):
                part = in_order[s : s + 50_000]
                words, places = pa.array([w for w, _ in part], pa.string()), pa.array([i for _, i in part], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), places, words], ["block", "number", "word"])

    return texts.select("text").mapInArrow(run, "block long, number int, word string")


def block_texts(texts: DataFrame, specials: dict[str, int]) -> DataFrame:
    """(block, keys, sizes, codes): every block's texts as word numbers, a row a block."""
    kind, arrow = texts.schema["key"].dataType.simpleString(), pa.list_(to_arrow_type(texts.schema["key"].dataType))

    def run(batches):
        for numbers, keys, codes in blocks(batches, _splitter(specials), positions=True):
            sizes = pa.array([[len(c) for c in codes]], pa.list_(pa.int32()))
            row = [pa.array([name_of(numbers)]), pa.array([keys], arrow), sizes, pa.array([pack_codes(codes)], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["block", "keys", "sizes", "codes"])

    return texts.select("key", "text").mapInArrow(run, f"block long, keys array<{kind}>, sizes array<int>, codes binary")


WORD_IDS = ["block", "numbers", "counts", "ids"]


def encoded_words(words: DataFrame, vocabulary) -> DataFrame:
    """(block, numbers, counts, ids) of (block, number, word): equal words meet in one partition side by side and are encoded once.

    A row holds a task's words of a block, packed: the gaps of their rising numbers, how many ids each has, and the ids.
    """

    def run(batches):
        v, last, packed, held = vocabulary.value, None, b"", 0
        block, number, ids = [], [], []

        def flush():
            at, num = np.concatenate(block), np.concatenate(number)
            order = np.lexsort((num, at))
            at, num, by_word = at[order], num[order], [ids[i] for i in order.tolist()]
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                gaps, counts = np.diff(num[s:e], prepend=0), np.fromiter((len(x) // 4 for x in by_word[s:e]), np.uint32, e - s)
                parts = [pack_codes([x]) for x in (gaps, counts, np.frombuffer(b"".join(by_word[s:e]), "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([at[s]], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], WORD_IDS)
            for x in (block, number, ids):
                x.clear()

        for b in batches:
            block.append(b.column("block").to_numpy())
            number.append(b.column("number").to_numpy())
            for w in b.column("word").to_pylist():
                if w != last:
                    last, packed = w, v.encode_packed(w)
                ids.append(packed)
                held += len(packed)
            if len(ids) > TASK_WORDS or held > 8 * OUT_BYTES:
                yield from flush()
                held = 0
        if ids:
            yield from flush()

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run_ddl = "block long, numbers binary, counts binary, ids binary"
    return words.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, run_ddl)


def placed(texts: DataFrame, vocabulary, with_text: bool) -> DataFrame:
    """(key, ids, and the decoded text if asked for): block tables joined with blocks, numbers replaced by position."""
    specials = vocabulary.value.specials
    tables = encoded_words(block_words(texts, specials), vocabulary).groupBy("block").agg(F.collect_list(F.struct(*WORD_IDS[1:])).alias("words"))
    met = block_texts(texts, specials).join(tables, "block", "left").select("keys", "sizes", "codes", "words")
    kind, arrow = texts.schema["key"].dataType.simpleString(), to_arrow_type(texts.schema["key"].dataType)
    names = ["key", "ids", "text"][: 2 + with_text]

    def table_of(words: list[dict] | None, most: int) -> list[bytes]:
        if words is None and most >= 0:
            raise ValueError("a block has no word table: the texts came in another order when they were read again")
        out = [b""] * (most + 1)
        for part in words or ():
            number, ends = np.cumsum(unpack_codes(part["numbers"])), 4 * np.cumsum(unpack_codes(part["counts"]))
            ids, start = unpack_codes(part["ids"]).tobytes(), 0
            for n, end in zip(number.tolist(), ends.tolist(), strict=True):
                out[n] = ids[start:end]
                start = end
        return out

    def run(batches):
        pieces = vocabulary.value.pieces
        for b in batches:
            for row in range(len(b)):
                codes = unpack_codes(b.column("codes")[row].as_py())
                ids_of = table_of(b.column("words")[row].as_py(), int(codes.max()) if len(codes) else -1)
                text_of = [b"".join([pieces[i] for i in memoryview(x).cast("I")]) for x in ids_of] if with_text else []
                keys, sizes = b.column("keys")[row].values, b.column("sizes")[row].as_py()
                first, at, out, texts_out, size = 0, 0, [], [], 0
                for i, n in enumerate(sizes):
                    own = codes[at : at + n].tolist()
                    at += n
                    out.append(b"".join(map(ids_of.__getitem__, own)))
                    size += len(out[-1])
                    if with_text:
                        texts_out.append(b"".join(map(text_of.__getitem__, own)).decode("utf-8", "replace"))
                        size += n * 6
                    if size > OUT_BYTES or i + 1 == len(sizes):
                        columns = [keys[first : i + 1].cast(arrow), pa.array(out, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts_out, pa.string())][: 2 + with_text], names)
                        first, out, texts_out, size = i + 1, [], [], 0

    return met.mapInArrow(run, f"key {kind}, ids binary" + (", text string" if with_text else ""))


def joiner(vocabulary):
    """The Arrow function (key, ids) -> (key, ids, text)."""

    def join(batches):
        pieces = vocabulary.value.pieces
        for b in batches:
            out, size, first = [], 0, 0
            for row, ids in enumerate(b.column("ids").to_pylist()):
                text = None
                if ids is not None:
                    text = b"".join([pieces[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
                    size += len(text)
                out.append(text)
                if size > OUT_BYTES:
                    part = b.slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], ["key", "ids", "text"])
                    out, size, first = [], 0, row + 1
            if out:
                part = b.slice(first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], ["key", "ids", "text"])

    return join


def encode(texts: DataFrame, vocabulary) -> DataFrame:
    """(key, ids) of texts (key, text): the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    vocabulary is a broadcast Vocabulary. Null and empty texts give no ids.
    Keys may be of any type, null or repeated; every row is encoded by itself.
    Texts and words may be of any length; a task holds one block, or one longer
    text. texts are read twice and must come in the same order both times, as
    files do. Other columns are ignored. An empty table gives an empty table.
    """
    return placed(texts, vocabulary, with_text=False)


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """(key, ids, text) of (key, ids): every id joined with its piece, in order.

    Special tokens give their text; bytes that are no UTF-8 become U+FFFD; null
    ids give a null text. An id outside the vocabulary raises.
    """
    key = encoded.schema["key"].dataType.simpleString()
    return encoded.select("key", "ids").mapInArrow(joiner(vocabulary), f"key {key}, ids binary, text string")


def round_trip(texts: DataFrame, vocabulary) -> DataFrame:
    """encode and decode at once: (key, ids, text); each block's words are put together from their ids' pieces once."""
    return placed(texts, vocabulary, with_text=True)


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Encode every document, decode it again; ids and text as SHA-256."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(vocabulary_path))
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    return round_trip(texts, vocabulary).select(
        F.col("key").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
