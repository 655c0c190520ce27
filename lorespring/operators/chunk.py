"""The chunker: paragraphs, articles, lines packed to a length, long lines split.

Limits and positions count UTF-8 bytes; the pieces of a line that is longer than the
limit count characters. Positions are a running sum, not places in the text. The
fold over a text's lines runs in Arrow batches, one text at a time and independent of
all others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 100
_TITLE = regex.compile(r"제(?:\p{N}.| \p{N})", regex.S)
_SENTENCES = regex.compile(r"[^.?!。\n]*(?:[.?!。]+\s*|\n+|$)")
_WORDS = regex.compile(r"\s*\S+\s*?(?=\s|$)|\s+")


def is_title(line: str) -> bool:
    return _TITLE.match(line.strip()) is not None


def articles(text: str) -> list[str]:
    """Pieces that begin at article titles, trimmed."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if is_title(line) and out[-1]:
            out.append([])
        out[-1].append(line)
    return ["\n".join(lines).strip() for lines in out if lines]


def split_line(line: str, most: int) -> list[str]:
    """Pieces of up to `most` characters, at the ends of sentences if these fit, else of words, else anywhere; neighbours are merged greedily. Segmentation is by expression, not by the Unicode tables."""

    def merged(parts: list[str], finer) -> list[str]:
        out, held = [], ""
        for part in parts:
            if len(held) + len(part) <= most:
                held += part
                continue
            if held:
                out.append(held)
            held = ""
            if len(part) <= most:
                held = part
            else:
                *whole, held = finer(part)
                out += whole
        return out + [held] if held else out

    def characters(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = min(at + most, len(word))
            while end < len(word) and end > at + 1 and unicodedata.combining(word[end]):
                end -= 1
            out.append(word[at:end])
            at = end
        return out or [""]

    words = lambda s: merged([w for w in _WORDS.findall(s) if w], characters) or [""]
    return [p.strip() for p in merged([s for s in _SENTENCES.findall(line) if s], words) if p.strip()]


def chunks_of(text: str | None, max_chars: int) -> list[tuple[str, int, int]]:
    """(content, start, end) of each chunk of a text."""
    if not text:
        return []
    most, at, out = max(max_chars, LEAST), 0, []

    def put(piece: str, gap: int) -> None:
        nonlocal at
        size = len(piece.encode())
        out.append((piece, at, at + size))
        at += size + gap

    for paragraph in (p.strip() for p in text.split("\n\n")):
        for piece in articles(paragraph) if paragraph else ():
            if not piece:
                continue
            if len(piece.encode()) <= most:
                put(piece, 1)
                continue
            held = ""
            for line in (x.strip() for x in piece.split("\n")):
                if not line:
                    continue
                size = len(line.encode())
                if held and len(held.encode()) + 1 + size <= most and not is_title(line):
                    held += "\n" + line
                    continue
                if held:
                    put(held, 1)
                    held = ""
                if size <= most:
                    held = line
                else:
                    for part in split_line(line, most):
                        put(part, 0)
            if held:
                put(held, 2)
    return out


def chunked(docs: DataFrame, max_chars: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(source_id, chunk_index, content, start_pos, end_pos) of every chunk of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = [(i, n, *c) for i, t in zip(batch.column(0).slice(k, 256).to_pylist(), batch.column(1).slice(k, 256).to_pylist()) for n, c in enumerate(chunks_of(t, max_chars))]
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["source_id", "chunk_index", "content", "start_pos", "end_pos"])

    return docs.select(F.col(id_).cast("long"), text).mapInArrow(run, "source_id long, chunk_index int, content string, start_pos int, end_pos int")


def chunked_with_overlap(docs: DataFrame, max_chars: int, overlap: int = 0, **names: str) -> DataFrame:
    """chunked(): an overlap is accepted and has no effect."""
    return chunked(docs, max_chars, **names)
