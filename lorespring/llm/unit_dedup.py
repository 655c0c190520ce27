"""Substring dedup by hashing lines or paragraphs.

A text is cut into units: `line` (up to and with its newline), `paragraph` (up to and with the
blank lines after it) or, beyond the method, `sentence` (a line's parts up to the marks that end
a sentence). All units of a text, one after another, are the text. Units are normalised (words
between single spaces, A-Z in lower case) and digested to 128 bits by BLAKE2b, so two different
units share a digest with a chance of about 2**-128 a pair, and none can be made to by any
known way. Digests are grouped globally; of each group the occurrence that is first by
(doc_id, place in the text) stays and the others are removed. What is removed keeps its offsets
in the original text. A unit of any length counts, but one without a word, as blank lines are,
stays.

Each task keeps the first two occurrences of a digest before anything is sent, so a unit that a
third of all documents have is two rows a batch of a task; only occurrences of digests that
repeat (picked by a bitmap of fixed size) are joined, against one row per digest, so that a hot
digest can be split between tasks. Rows are told apart by file and place.

Cases: a null text is empty and has no units; a null doc_id comes after all others; of repeated
rows and of rows with equal doc_ids the first by file and place is the earlier; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import texts_of
from ._spark import located, picked, written

_SENTENCE = re.compile(rb"(?:(?!\xe3\x80\x82)[^.!?\n])*(?:(?:[.!?]|\xe3\x80\x82)+|\n)|(?:(?!\xe3\x80\x82)[^.!?\n])+")
_PARAGRAPH = re.compile(rb"(?:\n[\x20\x09\x0b-\x0d]*)+\n")
#: Occurrences that a task has at a time.
FLUSH = 1 << 18


def _lines(text: bytes) -> list[bytes]:
    *ended, last = text.split(b"\n")
    return [*(p + b"\n" for p in ended), *([last] if last else [])]


def _paragraphs(text: bytes) -> list[bytes]:
    cuts = [0, *(m.end() for m in _PARAGRAPH.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


UNITS: dict[str, Callable[[bytes], list[bytes]]] = {
    "line": _lines,
    "paragraph": _paragraphs,
    "sentence": _SENTENCE.findall,
}


def digests_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the units that have a word, and their digests (rows of two int64)."""
    normal = [b" ".join(p.lower().split()) for p in parts]
    solid = [i for i, p in enumerate(normal) if p]
    raw = b"".join([hashlib.blake2b(normal[i], digest_size=16).digest() for i in solid])
    return np.array(solid, np.int64), np.frombuffer(raw, np.int64).reshape(-1, 2)


_COLUMNS = ["no_id", "doc_id", "file", "row", "unit", "d1", "d2"]


def occurrences(read: DataFrame, unit: str, firsts: bool = False) -> DataFrame:
    """no_id (1: doc_id is null), doc_id, file, row, unit and two digests of every unit that has a word. firsts: of a digest that a task has more than once, its first two only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = UNITS[unit]
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            if firsts:
                rows = rows[np.lexsort(rows.T[[4, 3, 2, 1, 0, 6, 5]])]  # by digest, then as they rank
                same = (rows[1:, 5:] == rows[:-1, 5:]).all(1)
                third = np.zeros(len(rows), bool)
                third[2:] = same[1:] & same[:-1]
                rows = rows[~third]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=_COLUMNS)

        size = 0
        for batch in batches:
            ids = batch.column("doc_id")
            where = np.column_stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), batch.column("file").to_numpy(), batch.column("row").to_numpy()])
            for at, text in zip(where, texts_of(batch.column("text"))):
                units, digests = digests_of(cut(text))
                held.append(np.column_stack([np.broadcast_to(at, (len(units), 4)), units, digests]))
                size += len(units)
                if size >= FLUSH:
                    yield out()
                    size = 0
        if size:
            yield out()

    return read.mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))


def dedup(docs: DataFrame, unit: str = "line") -> DataFrame:
    """doc_id, n_units, n_removed, kept_sha256 and the spans (bytes, ends exclusive) that were removed of every row of docs."""
    placed, names = located(docs)
    file, row = (F.col(n).alias(x) for n, x in zip(names, ("file", "row")))
    read = placed.select(F.col("doc_id").cast("long").alias("doc_id"), file, row, F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.struct("no_id", "doc_id", "file", "row", "unit")).alias("first")
    groups = written(occurrences(read, unit, firsts=True).groupBy("d1", "d2").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "units")
    here = [F.col("d1"), F.col("d2")]
    removed = picked(occurrences(read, unit), here, groups, here).join(groups, ["d1", "d2"]).where("NOT (file = first.file AND row = first.row AND unit = first.unit)")
    gone = written(removed.groupBy("file", "row").agg(F.sort_array(F.collect_set(F.col("unit").cast("int"))).alias("units")), "units-gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, units in zip(texts_of(batch.column("text")), batch.column("units").to_pylist()):
                some, at, kept, starts, ends = set(units), 0, hashlib.sha256(), [], []
                for i, part in enumerate(UNITS[unit](text)):
                    if i in some:
                        starts.append(at)
                        ends.append(at + len(part))
                    else:
                        kept.update(part)
                    at += len(part)
                for column, value in zip(out, (len(some), kept.hexdigest(), starts, ends)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))], names=["file", "row", "n_removed", "cut_sha256", "span_starts", "span_ends"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            n = [len(UNITS[unit](t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "row")), pa.array(n, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "file", "row", "n_units", "whole"])

    at = [F.col("file"), F.col("row")]
    # joined in the same way at every size: the shuffle of these texts is what it costs
    texts = picked(read, at, gone, at).join(gone.hint("merge"), ["file", "row"])
    done = texts.select("file", "row", "text", "units").mapInArrow(cut, "file long, row long, n_removed long, cut_sha256 string, span_starts array<long>, span_ends array<long>")
    every = read.mapInArrow(counted, "doc_id long, file long, row long, n_units long, whole string").join(done, ["file", "row"], "left")
    none = F.array().cast("array<bigint>")
    return every.select("doc_id", "n_units", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "whole").alias("kept_sha256"), F.coalesce("span_starts", none).alias("span_starts"), F.coalesce("span_ends", none).alias("span_ends"))


def op6(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_units", "n_removed", "kept_sha256")


SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS parts FROM documents),
units AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS unit FROM split),
normal AS (SELECT doc_id, unit, part, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS u FROM units),
ranked AS (SELECT doc_id, unit, part, u <> '' AND row_number() OVER (PARTITION BY u ORDER BY doc_id NULLS LAST, unit) > 1 AS gone FROM normal),
cut AS (SELECT doc_id, count(*) AS n_units, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed, coalesce(string_agg(part, '' ORDER BY unit) FILTER (WHERE NOT gone), '') AS kept FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN cut USING (doc_id)
"""
