"""Language ID: multinomial naive Bayes over hashed character n-grams.

A model is a matrix of log-probabilities, one row per hash bucket and one column
per language. It is fitted by Spark: every task counts the n-grams of its rows,
the counts are added up per (language, bucket), and only that table (languages x
buckets, at most) reaches the driver. The matrix is broadcast; scoring is a sparse
gather of its rows in numpy, summed per text.

The prior is uniform: how many documents of a language there are to learn from says nothing
of the texts to come. `score` is the posterior probability under it.

Cases: a null text, or one without a letter, is `und` with score 0. A row without doc_id is
in no fold: it is scored, held_out is false, and it doesn't teach. Texts are
scored whole, however long. Equal texts get equal results. Rows whose lang is null
don't teach. Without any row to learn from, every text is `und`. Other columns,
whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import chunks

#: Fit on about this many documents of each language at most; the choice is a hash of doc_id.
FIT_PER_LANGUAGE = 2000
BUCKETS = 1 << 15
#: Numbers of the matrix that is broadcast (128 MB), which has a column for each language: past 1024 languages, n-grams are hashed to fewer buckets.
MATRIX, LEAST_BUCKETS = 1 << 25, 1 << 8
ORDERS = (1, 2, 3)
#: A text fits a language if the mean log-likelihood of its n-grams is at most MARGIN + SPREAD / sqrt(n-grams) below what is usual there: few n-grams vary more.
MARGIN, SPREAD = 1.5, 15.0
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@functools.cache
def _folded() -> np.ndarray:
    """Code point of each BMP letter in lower case, a space for anything that isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, two spaces before and one after each; where each begins."""
    joined = "  " + "   ".join(texts) + " "
    codes = _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 3, out=starts[1:])
    return codes, starts


def _grams(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: the order, the bucket of the n-gram ending at each place from order-1 on, and which of them count (those with a letter)."""
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    letter = codes != 32
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, n * 374761393 & 0xFFFFFFFF, np.uint32)
        some = np.zeros(len(h), bool)
        for j in range(n):
            part = codes[j : j + len(h)]
            h ^= part * _FACTORS[j]
            h *= np.uint32(2246822519)
            h ^= h >> np.uint32(15)
            some |= letter[j : j + len(h)]
        h *= np.uint32(2654435761)
        yield n, (h >> shift).astype(np.int32), some


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets + 1) x languages, float32; the last row is zero and stands for what doesn't count
    usual: np.ndarray  # of each language, the mean log-likelihood of an n-gram of its own texts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What predict() gives, and whether the text's n-grams are about as likely as that language's own."""
        names, scores, fits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not lettered or not self.languages:
            return names, scores, fits
        buckets = len(self.weights) - 1
        for part in chunks([len(texts[i]) for i in lettered], 1 << 18):
            rows = lettered[part]
            codes, starts = _codes([texts[i] for i in rows])
            total, grams = np.zeros((len(rows), len(self.languages))), np.zeros(len(rows))
            for n, bucket, counts in _grams(codes, buckets):
                bucket[~counts] = buckets
                first = starts[:-1] - 0
                total += np.add.reduceat(np.vstack([self.weights[bucket], np.zeros((n - 1, len(self.languages)), np.float32)]), first, axis=0, dtype=np.float64)
                grams += np.add.reduceat(np.concatenate([counts, np.zeros(n - 1, bool)]), first, dtype=np.int64)
            best = total.argmax(1)
            top = total[np.arange(len(rows)), best]
            score = 1 / np.exp(total - top[:, None]).sum(1)
            for k, i in enumerate(rows):
                names[i] = self.languages[best[k]]
            scores[rows] = score
            grams = np.maximum(grams, 1)
            fits[rows] = top / grams >= self.usual[best] - MARGIN - SPREAD / np.sqrt(grams)
        return names, scores, fits


def teaches(doc_id: Column, lang: Column, text: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 3, isn't 1, and it has text and language."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1) & lang.isNotNull() & text.isNotNull()


def fit(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """Fit on the rows of docs that teaches() allows: all of a language with up to `per_language`, else about so many, by a hash of doc_id."""
    allowed = docs.select("doc_id", "lang", "text").where(teaches(F.col("doc_id"), F.col("lang"), F.col("text")))
    rows = allowed.groupBy("lang").count().collect()  # one row a language
    while len(rows) * buckets > MATRIX and buckets > LEAST_BUCKETS:
        buckets //= 2
    have = docs.sparkSession.createDataFrame(rows, "lang string, count long")
    part = F.least(F.lit(1.0), per_language / F.col("count"))
    sample = allowed.join(F.broadcast(have), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < F.ceil(part * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for part in chunks([len(t) for t in texts], 1 << 18):
                for lang in sorted(set(langs[part])):
                    codes, _ = _codes([t for l, t in zip(langs[part], texts[part]) if l == lang])
                    into = sums.setdefault(lang, np.zeros(buckets, np.int64))
                    for _, bucket, counts in _grams(codes, buckets):
                        into += np.bincount(bucket[counts], minlength=buckets)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    table = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").to_numpy(zero_copy_only=False).astype(object)
    languages = sorted(set(names))
    counts = np.zeros((buckets, len(languages)))
    if languages:
        index = {l: i for i, l in enumerate(languages)}
        counts[table.column("bucket").to_numpy(), [index[x] for x in names]] = table.column("n").to_numpy()
    weights = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * buckets)) if languages else counts
    # each n-gram judged by the counts without itself
    sums = counts.sum(0)
    usual = (counts * np.log(np.maximum(counts - 0.5, 0.5) / (sums + 0.5 * buckets))).sum(0) / np.maximum(sums, 1)
    return Model(languages, np.vstack([weights, np.zeros((1, len(languages)))]).astype(np.float32), usual)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of docs named in keep, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, f"{schema}, lang_pred string, score double")


#: Below this posterior, without a letter, or unlike the texts of its language, a document is rejected. The posterior alone is near 1 for any longer text, in whatever language.
ACCEPT = 0.5


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The documents whose language is told with a posterior of at least `least` and whose text fits it; their columns are unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(text: pd.Series) -> pd.Series:  # only the text goes to Python
        names, scores, fits = shared.value.judge(text.tolist())
        return pd.Series([n != "und" for n in names]) & (scores >= least) & fits

    return docs.where(told(F.col("text")))


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs)
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
