"""Embedding and tokenizing: providers that turn a text column into a vector column."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]


_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}_]+")


def hashed(texts: list[str | None], dim: int) -> np.ndarray:
    """Signed counts of hashed tokens, one row a text. Each different token of the texts is hashed once."""
    tokens = [_TOKEN.findall((t or "").lower()) for t in texts]
    number: dict[str, int] = {}
    at = np.array([number.setdefault(t, len(number)) for row in tokens for t in row], np.int64)
    h = np.array([zlib.crc32(t.encode()) for t in number], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(r) for r in tokens])
    sign = np.where(h // dim % 2 == 0, 1, -1)
    return np.bincount(row * dim + (h % dim)[at], sign[at], len(texts) * dim).reshape(len(texts), dim).astype(np.float32) if len(at) else np.zeros((len(texts), dim), np.float32)


def hashing(dim: int = 64) -> Embedder:
    """hashed() as an embedder: deterministic and without a model."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([v for a in range(0, len(texts), 1000) for v in hashed(texts.iloc[a : a + 1000].tolist(), dim)])  # tokens of 1000 texts at a time

    return run


@functools.cache
def _tokenizer(path: str, most: int):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.enable_truncation(most)
    return found


#: Characters, or ids, that a tokenizer gets at once: what it makes of each takes some hundred bytes until it is an array.
AT_ONCE = 1 << 17


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of about `most` in all, and one at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def ids_of(texts: list[str | None], path: str, most: int) -> list[np.ndarray]:
    """Ids of each text, AT_ONCE characters at a time."""
    texts = [t or "" for t in texts]
    return [np.array(e.ids, np.int32) for part in _slices([len(t) for t in texts], AT_ONCE) for e in _tokenizer(path, most).encode_batch_fast(texts[part])]


def texts_of(ids: list[np.ndarray], path: str, most: int) -> list[str]:
    """Text of each list of ids, AT_ONCE ids at a time."""
    return [t for part in _slices([len(i) for i in ids], AT_ONCE) for t in _tokenizer(path, most).decode_batch([np.asarray(i).tolist() for i in ids[part]], skip_special_tokens=True)]


def tokenize(path: str, most: int = 256) -> Callable[[Column], Column]:
    """Ids of a tokenizer file, with its special tokens, cut to `most`. One tokenizer a worker."""

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(ids_of(batch.tolist(), path, most))

    return run


def decode(path: str, most: int = 256) -> Callable[[Column], Column]:
    """Text of ids, without special tokens."""

    @F.pandas_udf("string")
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in ids:
            yield pd.Series(texts_of(batch.tolist(), path, most))

    return run


def vocabulary_size(path: str) -> int:
    return _tokenizer(path, 256).get_vocab_size()


@functools.cache
def _session(model: str):
    import onnxruntime

    return onnxruntime.InferenceSession(model)


def mean_pooled(output: np.ndarray, n_tokens: int) -> np.ndarray:
    """(1, tokens, dim) -> mean over tokens; (1, dim) and (dim,) as they are. Not normalised."""
    if output.ndim == 3:
        return output[0, :n_tokens].mean(0)
    return output.reshape(-1)


def onnx(model: str, tokenizer: str, most: int = 256) -> Embedder:
    """An ONNX model (ids, mask, types -> hidden states) on files that every worker can read."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                ids = np.array([_tokenizer(tokenizer, most).encode(t or "").ids], np.int64)
                feeds = dict(zip([i.name for i in _session(model).get_inputs()], (ids, np.ones_like(ids), np.zeros_like(ids))))
                out.append(mean_pooled(_session(model).run(None, feeds)[0], ids.shape[1]).astype(np.float32).tolist())
            yield pd.Series(out)

    return run


def custom(function: Callable[[list[str]], list[list[float]]]) -> Embedder:
    """A function of your own from texts to vectors, run in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(function(texts.tolist()))

    return run
