"""Text chunks: headings open sections, tables and code stay whole, sentences fill chunks up to a size.

chunks() is a pure function of one text, a fold that no window expresses; it runs in mapInArrow.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import HEADING_CHARS, HEADINGS

SIZE, OVERLAP = 500, 50
TOKEN = re.compile(r"\w+|[^\w\s]")
HEADING = [re.compile(p) for p in HEADINGS]
LETTER = re.compile("[A-Za-z]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
FENCE = "```"


def count(text: str) -> int:
    return len(TOKEN.findall(text))


def is_heading(line: str) -> bool:
    """What text.is_heading tells of a column, for one stripped line."""
    if not line or len(line) > HEADING_CHARS:
        return False
    capitals = line.upper() == line and not line.endswith((".", ",")) and len(LETTER.findall(line)) >= 4
    return capitals or any(p.search(line) for p in HEADING)


def blocks(text: str):
    """(kind, text): heading, table, code or prose."""
    kind, held = None, []

    def flush():
        nonlocal held
        joined = "\n".join(held).strip("\n")
        held = []
        return [(kind, joined)] if joined.strip() else []

    for line in text.split("\n"):
        bare = line.strip()
        if kind == "code":
            held.append(line)
            if bare.startswith(FENCE):
                yield from flush()
                kind = None
            continue
        if bare.startswith(FENCE):
            yield from flush()
            kind, held = "code", [line]
        elif bare.startswith("|") and bare.endswith("|") and len(bare) > 1:
            if kind != "table":
                yield from flush()
                kind = "table"
            held.append(line)
        elif not bare:
            yield from flush()
            kind = None
        elif is_heading(bare):
            yield from flush()
            kind = None
            yield "heading", bare
        else:
            if kind != "prose":
                yield from flush()
                kind = "prose"
            held.append(line)
    yield from flush()


def split_long(text: str, size: int) -> list[str]:
    """Sentences, cut by tokens where one is longer than a chunk; nothing is lost."""
    out = []
    for s in SENTENCE.split(text):
        ends = [m.end() for m in TOKEN.finditer(s)]
        if len(ends) <= size:
            out.append(s)
            continue
        start = 0
        for k in range(size, len(ends) + size, size):
            end = ends[min(k, len(ends)) - 1] if k < len(ends) else len(s)
            out.append(s[start:end])
            start = end
    return [x for x in out if x.strip()]


def split_table(text: str, size: int) -> list[str]:
    """Rows in parts of at most `size` tokens, each under the header and its rule."""
    lines = text.split("\n")
    head = lines[:2] if len(lines) > 1 and set(lines[1]) <= set("|-: \t") else lines[:1]
    out, part, used = [], [], count("\n".join(head))
    for line in lines[len(head) :]:
        n = count(line)
        if part and used + n > size:
            out.append("\n".join(head + part))
            part, used = [], count("\n".join(head))
        part.append(line)
        used += n
    if part or not out:
        out.append("\n".join(head + part))
    return out


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, str, int]]:
    """(section, text, tokens) in order; a chunk repeats up to `overlap` tokens of whole sentences before it."""
    out: list[tuple[str, str, int]] = []
    section, fresh = "", 0
    held: list[tuple[str, int]] = []  # sentences with their tokens
    used = 0

    def flush(keep: bool) -> None:
        nonlocal held, used, fresh
        if fresh:
            out.append((section, " ".join(s for s, _ in held), used))
        start, n = len(held), 0
        while keep and start and n + held[start - 1][1] <= overlap:
            start -= 1
            n += held[start][1]
        held, used, fresh = held[start:], n, 0

    for kind, body in blocks(text.replace("\r\n", "\n").replace("\r", "\n")):
        if kind == "heading":
            flush(False)
            marker = HEADING[0].search(body)
            section = marker[1] if marker else body.lstrip("# ").rstrip(":").strip()
            used, fresh = count(body), 1
            held = [(body, used)]
        elif kind in ("table", "code"):
            flush(False)
            parts = split_table(body, size) if kind == "table" else [body]
            out.extend((section, p, count(p)) for p in parts)
        else:
            for s in split_long(body, size):
                n = count(s)
                if fresh and used + n > size:
                    flush(True)
                    if used + n > size:
                        held, used = [], 0
                held.append((s, n))
                used += n
                fresh += 1
    flush(False)
    return out


class Chunks:
    """Table function chunks(text): (chunk_index, section, text, tokens)."""

    def eval(self, text: str):
        for k, chunk in enumerate(chunks(text or "")):
            yield (k, *chunk)


def register(spark) -> None:
    """Make chunks(text) a table function of SQL, for LATERAL joins with a table of texts."""
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk_index int, section string, text string, tokens int"))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, section, text, tokens) of every text; null and blank texts give none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [
                (i, k, *c)
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for k, c in enumerate(chunks(text or "", size, overlap))
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "chunk_index", "section", "text", "tokens"]
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, chunk_index int, section string, text string, tokens int")
