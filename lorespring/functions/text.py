"""Scalar functions over text, as column expressions wherever Spark has the parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMINATORS = ".?!。"


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return F.sha2(text, 256)


def truncated(text: Column, n: int) -> Column:
    """The first n code points, for display."""
    return F.substring(text, 1, n)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def utf16_length(text: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimated_tokens(length: Column) -> Column:
    """A quarter of a length, rounded up."""
    return F.ceil(length / 4).cast("long")


def bm25_tokens(text: Column) -> Column:
    """Lower-case runs of letters, numbers and underscores with at least two bytes."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}_]+")
    return F.filter(parts, lambda t: F.octet_length(t) >= 2)


def sentences(text: Column) -> Column:
    """Pieces that end in a terminator, trimmed and longer than a byte, and a non-empty rest."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+"), F.lit(0))
    return F.filter(F.transform(pieces, trimmed), lambda s: (F.octet_length(s) > 1) | ((s != "") & ~s.rlike(f"[{TERMINATORS}]$")))


def normal_sentence(sentence: Column) -> Column:
    """Lower case with single spaces: sentences that agree in it are duplicates."""
    return F.regexp_replace(trimmed(F.lower(sentence)), r"(?U)\s+", " ")


@F.pandas_udf(T.StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of UTF-8, as 16 hex digits. A batch is hashed byte position by byte position; null gives null."""
    raw = [t.encode() if t is not None else b"" for t in text]
    lengths = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    live = len(raw)
    for i in range(int(sizes[0]) if len(raw) else 0):
        while live and sizes[live - 1] <= i:
            live -= 1
        h[:live] = (h[:live] ^ data[starts[:live] + i]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), object)
    out[order] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(out).where(text.notna().to_numpy(), None)


def sentence_hash(sentence: Column) -> Column:
    return fnv1a_hex(normal_sentence(sentence))


def should_compress(text: Column, threshold: int) -> Column:
    """Whether the rough number of tokens (code points by 2 with Hangul, else by 4) is over the threshold."""
    return F.floor(F.length(text) / F.when(text.rlike("[가-힣]"), 2).otherwise(4)) > threshold


def article_title(line: Column) -> Column:
    """Whether a line opens an article: 제, perhaps a space, a number and something after."""
    return trimmed(line).rlike(r"(?s)^제(\p{N}.| \p{N})")


def bold_parts(text: Column) -> Column:
    """What stands between double asterisks."""
    return F.regexp_extract_all(text, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))


def unwrapped_response(text: Column) -> Column:
    """The inner text of a TextResponse("...") wrapper, or the text as it is."""
    pattern = r'(?s)TextResponse\("(.*)"\)$'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


@F.pandas_udf(T.StringType())
def without_repetition(text: pd.Series) -> pd.Series:
    """Cuts a text of 200 or more code points after a stretch of 40, 50 ... 100 of them that begins again within twice its length after its end. Stretches that are mostly blank don't count."""

    def clean(t: str | None) -> str | None:
        if t is None or len(t) < 200:
            return t
        for size in range(40, 101, 10):
            for at in range(len(t) - 2 * size):
                stretch, end = t[at : at + size], at + size
                if len(stretch.strip()) >= 20 and t.find(stretch, end, end + 3 * size - 1) >= 0:
                    return t[:end].strip() + "..."
        return t

    return text.map(clean)
