"""Language identification by nearest clustered centroid (operator 1).

A text's letters, lower-cased for A-Z and with everything else as one blank, are counted as byte n-grams of one
to three bytes in ``DIMENSIONS`` hashed places.  Counts become TF-IDF vectors of length one; a language is several
centroids, found by k-means on cosine among a sample of its documents; a text takes the language of the nearest
centroid.  It is rejected when even that centroid is farther away than nearly all training texts of like length.  The
distances for that are taken apart from the centroids: those of one half of the sample to centroids of the other half,
with the sample's texts cut to each of ``LENGTHS``.  A language with fewer than ``FEWEST`` such texts has no limit.

Document frequencies cover all training documents.  Centroids are fitted on about ``SAMPLE`` documents of each
language, chosen by a hash of their id (all of them where there are fewer).

Defined results: a null or empty text or one without a letter is ``und`` with score 0 and rejected; texts count
whole; ties go to the first language in code point order; repeated rows get equal results; without training
documents every text is ``und``; an empty table gives no rows.  Only doc_id, text and lang are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlift.llm import textarrays as ta
from alertlift.llm.shipping import ship

DIMENSIONS = 4096
#: Expected sample of each language, centroids of each, and rounds of k-means.
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 8
#: Share of the training texts of like length that are nearer than the limit, and fewest texts that set one.
QUANTILE, FEWEST = 0.99, 40
#: Bytes to which the sample's texts are cut for the limits.
LENGTHS = (16, 32, 64, 128, 256, 512, 1024, 4096, 16384)
SHARPNESS = 25.0

_SAMPLED = ["lang", "cut", "doc", "v"]
_ORDERS = 3
_BLANK = 0x20
_LETTERS = np.full(256, _BLANK, dtype=np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[_LETTERS != _BLANK] = True
_ASCII_LETTER[0x80:] = False


def counts(texts: ta.Texts) -> np.ndarray:
    """n-gram counts, one row of DIMENSIONS for each text."""
    data = _LETTERS[texts.data]
    row = np.repeat(np.arange(texts.n, dtype=np.int64) * DIMENSIONS, texts.lengths())
    total = np.zeros(texts.n * DIMENSIONS, dtype=np.int64)
    code = data.astype(np.uint32)
    for order in range(1, _ORDERS + 1):
        if order > 1:
            code = code[:-1] * np.uint32(257) + data[order - 1 :]
        n = len(code)
        if n <= 0:
            break
        # Windows of blanks only say nothing; windows across two texts are not n-grams.
        inside = row[:n] == row[order - 1 :]
        inside &= data[:n] != _BLANK if order < 3 else data[1 : n + 1] != _BLANK
        place = (code * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
        total += np.bincount((row[:n] + place)[inside], minlength=len(total))
    return total.reshape(texts.n, DIMENSIONS)


def vectors(texts: ta.Texts, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (zero where there is nothing to count)."""
    weighted = np.log1p(counts(texts)) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return (weighted / np.where(norm > 0, norm, 1)).astype(np.float32)


def has_letter(texts: ta.Texts) -> np.ndarray:
    out = ta.row_sums(_ASCII_LETTER[texts.data], texts.offsets) > 0
    for i in np.flatnonzero(~out & (ta.row_sums(texts.data >= 0x80, texts.offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts.text(i))
    return out


def _small(column: pa.Array) -> Iterator[ta.Texts]:
    """Slices whose count matrix stays near 6 MB."""
    return ta.slices(column, max_rows=192)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for texts in _small(batch.column(0)):
            seen += (counts(texts) > 0).sum(axis=0)
            n += texts.n
    if n:
        place = np.append(np.arange(DIMENSIONS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.append(seen, n))], ["place", "n"])


def _sample_vectors(idf: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors of whole texts (cut null) and of their beginnings; ``doc`` is the same for all of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _small(batch.column(1)):
                langs = batch.column(0).slice(texts.first, texts.n).to_pylist()
                whole = [v.tobytes() for v in vectors(texts, idf)]
                docs = [hashlib.md5(v).digest() for v in whole]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.nulls(texts.n, pa.int64()), pa.array(docs, pa.binary()), pa.array(whole, pa.binary())], _SAMPLED)
                raw = [texts.text(i).encode("utf-8") for i in range(texts.n)]
                for cut in LENGTHS:
                    own = [i for i in range(texts.n) if len(raw[i]) >= cut]
                    begun = pa.array([raw[i][:cut].decode("utf-8", "ignore") for i in own], pa.string())
                    for part in _small(begun):
                        at = own[part.first : part.first + part.n]
                        rows = [v.tobytes() for v in vectors(part, idf)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([langs[i] for i in at], pa.string()), pa.array([cut] * part.n, pa.int64()),
                             pa.array([docs[i] for i in at], pa.binary()), pa.array(rows, pa.binary())], _SAMPLED)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _centres(x: np.ndarray) -> np.ndarray:
    """k-means on cosine; starts are farthest apart, so reruns agree."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(CENTROIDS, len(x)):
        centres = np.concatenate([centres, x[[(x @ centres.T).max(axis=1).argmin()]]])
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        own = [x[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))]
        centres = _unit(np.stack(own))
    return centres


def _cluster(members: pd.DataFrame) -> pd.DataFrame:
    """Centroids from the sample of one language, and the limit of distance for each of LENGTHS (infinite: none)."""
    members = members.sort_values(["doc", "cut", "v"])
    read = lambda found: np.stack([np.frombuffer(v, np.float32) for v in found["v"]])
    whole = members[members["cut"].isna()]
    centres = _centres(read(whole))
    # Equal texts lie in one half.
    half = lambda found: np.array([d[0] % 2 for d in found["doc"]])
    halves = [whole[half(whole) == h] for h in (0, 1)]
    limits = np.full(len(LENGTHS), np.inf)
    if min(map(len, halves)):
        other = [_centres(read(halves[1 - h])) for h in (0, 1)]
        for k, cut in enumerate(LENGTHS):
            begun = members[members["cut"] == cut]
            if len(begun) >= FEWEST:
                side, x = half(begun), read(begun)
                limits[k] = np.quantile(np.where(side == 0, *[1 - (x @ c.T).max(axis=1) for c in other]), QUANTILE)
            elif k:
                limits[k] = limits[k - 1]  # shorter texts are farther away
    return pd.DataFrame({"lang": members["lang"].iloc[0], "v": [c.astype(np.float32).tobytes() for c in centres], "limits": [limits.tolist()] * len(centres)})


class Model:
    """idf, centroids as rows, their language's place in ``langs``, and each language's limits of distance by LENGTHS."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, limits: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.limits = langs, idf, centroids, owner, limits

    def predict(self, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language (-1: none), score and rejection of each text."""
        if not self.langs:
            return np.full(texts.n, -1), np.zeros(texts.n), np.ones(texts.n, dtype=bool)
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1).astype(np.float64)
        place = best.argmax(axis=1)
        top = best[np.arange(len(place)), place]
        score = 1 / np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
        # The limit of the next shorter length; below the shortest only a text that shares nothing goes.
        length = np.searchsorted(LENGTHS, texts.lengths(), side="right") - 1
        limit = np.where(length >= 0, self.limits[place, np.maximum(length, 0)], np.inf)
        rejected = (1 - top > limit) | (top <= 0)
        none = ~has_letter(texts)
        return np.where(none, -1, place), np.where(none, 0.0, score), rejected | none


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """``train``: doc_id, text, lang; rows with a null text or lang teach nothing."""
    ship(train.sparkSession)
    train = train.filter("text is not null and lang is not null")
    frequencies = train.select("text").mapInArrow(_document_frequencies, "place int, n long")
    totals = {r["place"]: r["n"] for r in frequencies.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    seen = np.array([totals.get(i, 0) for i in range(DIMENSIONS)], dtype=np.float64)
    idf = np.log((1 + totals.get(-1, 0)) / (1 + seen)) + 1
    # One rate for each language, as many as there will be groups of centroids here; a join would shuffle the texts.
    rates = {r["lang"]: min(1.0, sample / r["n"]) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rates:
        return Model([], idf, np.zeros((0, DIMENSIONS), np.float32), np.empty(0, np.int64), np.empty((0, len(LENGTHS))))
    by_lang = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    chosen = train.filter(drawn < by_lang[F.col("lang")]).select("lang", "text")
    found = (
        chosen.mapInArrow(_sample_vectors(idf), "lang string, cut long, doc binary, v binary")
        .groupBy("lang").applyInPandas(_cluster, "lang string, v binary, limits array<double>")
        .toPandas().sort_values(["lang", "v"])
    )
    langs = sorted(found["lang"].unique())
    owner = np.array([langs.index(x) for x in found["lang"]], dtype=np.int64)
    centroids = np.stack([np.frombuffer(v, np.float32) for v in found["v"]]) if langs else np.zeros((0, DIMENSIONS), np.float32)
    limits = np.array([found.loc[found["lang"] == x, "limits"].iloc[0] for x in langs], dtype=np.float64).reshape(len(langs), len(LENGTHS))
    return Model(langs, idf, centroids, owner, limits)


def _predict(model, carried: list[str]) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _small(batch.column(0)):
                place, score, rejected = model.value.predict(texts)
                names = pa.array(["und" if p < 0 else model.value.langs[p] for p in place], pa.string())
                own = [c.slice(texts.first, texts.n) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, names, pa.array(score), pa.array(rejected)], [*carried, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred, score and rejected, from the text alone."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("_"), *carried)
    schema = T.StructType(rows.schema.fields[1:] + T.StructType.fromDDL("lang_pred string, score double, rejected boolean").fields)
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), list(carried)), schema)


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo the divisor; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(remainder(5) != 0).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")
