"""Quality score from compression with two zstandard dictionaries (operator 5).

One dictionary is built from text labelled good, one from text labelled bad.  A text is compressed with each; the
normalised difference of the two sizes says which kind it resembles.  A logistic curve, fitted on labelled texts
that built no dictionary, turns the difference into a probability of label 1.  The curve also sees how far the text
shrinks at all: a text that repeats itself is small with either dictionary, so its difference alone says little.

A long text is compressed in pieces of ``PIECE`` bytes, so that the dictionary matters throughout; all pieces count.
Dictionaries and curve are fitted on at most about ``SAMPLE`` labelled documents of each label and purpose, chosen
by a hash of their id.

Defined results: a null or empty text has difference and shrinkage 0 and gets the curve's value there; texts count
whole; repeated rows get equal scores; without labels of both kinds every score is the share of label 1 (0.5 without
any label); an empty table gives no rows.  Only doc_id, text and the label are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.language import remainder
from alertlift.llm.shipping import ship

SAMPLE = 1500
DICTIONARY_BYTES = 110 << 10
PIECE = 1024
#: Bytes of one document that may enter a dictionary's samples: every PIECE-sized piece up to here, evenly spread.
PIECES_OF_A_SAMPLE = 8
LEVEL = 3
THRESHOLD = 0.3


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def _build(members: pd.DataFrame) -> pd.DataFrame:
    """A dictionary from the sample of one label.  Samples too small to train on serve as raw content."""
    samples = []
    for text in sorted(members["text"]):
        pieces = _pieces(text.encode("utf-8"))
        step = max(1, -(-len(pieces) // PIECES_OF_A_SAMPLE))
        samples += pieces[::step]
    try:
        built = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        built = b"".join(samples)[-DICTIONARY_BYTES:]
    return pd.DataFrame({"label": [members["label"].iloc[0]], "dictionary": [built]})


class Sizes:
    """Compressed sizes with both dictionaries, divided by the text's size."""

    def __init__(self, good: bytes, bad: bytes):
        self.tools = []
        for content in (good, bad):
            built = zstandard.ZstdCompressionDict(content)
            built.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, data: bytes) -> tuple[float, float, float]:
        """Normalised difference (bad less good), and the logarithm of the shrinkage and its square."""
        good, bad = (sum(len(t.compress(p)) for p in _pieces(data)) for t in self.tools) if data else (0, 0)
        shrunk = np.log((good + 20) / (len(data) + 20))
        return (bad - good) / (bad + good + 50), shrunk, shrunk * shrunk


@dataclass
class Model:
    """Dictionaries, and weights of the three features and of a constant; empty dictionaries: the constant alone."""

    good: bytes
    bad: bytes
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -50, 50)))


def _apply(model: Model, carried: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.good and model.bad else None
        for batch in batches:
            for texts in ta.slices(batch.column(0)):
                raw, cuts = texts.data.tobytes(), texts.offsets.tolist()
                found = np.zeros((texts.n, 3))
                if sizes:
                    found[:] = [sizes.features(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                own = [c.slice(texts.first, texts.n) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*own, *(pa.array(f) for f in found.T), pa.array(model.probability(found))], [*carried, *OUT]
                )

    return run


OUT = ("difference", "shrunk", "shrunk2", "score")


def apply(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """The carried columns with the features and the score of the whole text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string"), *carried)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(_apply(model, list(carried)), f"{schema}, " + ", ".join(f"{c} double" for c in OUT))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Weights of the columns of x and of a constant, by damped Newton steps with a little ridge."""
    mean, spread = np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-12
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.clip(np.linalg.solve(curve, z.T @ (weight * (p - y)) + ridge @ w), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def draw_sample(docs: DataFrame, labels: DataFrame, sample: int, salt: int) -> tuple[DataFrame | None, dict[int, int]]:
    """Texts of about ``sample`` labelled documents of each label and purpose (``first`` or not), and rows by label.

    Chosen by a hash of the id among ids and labels alone.  What is chosen is bounded by the parameter, so it may be
    broadcast to the texts, which are not shuffled.  No sample where a label is missing.
    """
    rows = docs.select("doc_id").join(labels.select("doc_id", "label").filter("label in (0, 1)"), "doc_id")
    counted = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counted) < 2:
        return None, counted
    draw = F.xxhash64("doc_id", F.lit(salt))
    rate = F.when(F.col("label") == 1, 2.0 * sample / counted[1]).otherwise(2.0 * sample / counted[0])
    unit = F.pmod(F.shiftright(draw, 1), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(unit < rate).select("doc_id", "label", (F.pmod(draw, F.lit(2)) == 0).alias("first"))
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id"), counted


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1).  One half of the sample builds, the other calibrates."""
    ship(docs.sparkSession)
    chosen, counted = draw_sample(docs, labels, sample, 5)
    if chosen is None:
        share = 0.5 if not counted else float(1 in counted)
        odds = np.clip(share, 1e-3, 1 - 1e-3)
        return Model(b"", b"", np.array([0.0, 0.0, 0.0, np.log(odds / (1 - odds))]))
    built = chosen.filter("first").select("label", "text").groupBy("label").applyInPandas(_build, "label int, dictionary binary")
    found = {r["label"]: bytes(r["dictionary"]) for r in built.collect()}
    model = Model(found.get(1, b""), found.get(0, b""), np.zeros(4))
    held = apply(chosen.filter("not first"), model, "label").toPandas().sort_values(["label", *OUT])
    y = held["label"].to_numpy(dtype=float)
    if not len(y) or not model.good or not model.bad:
        odds = np.clip(counted[1] / (counted[0] + counted[1]), 1e-3, 1 - 1e-3)
        model.weights[-1] = np.log(odds / (1 - odds))
        return model
    # Each label counts as often as in all labelled rows, whatever its share in the sample.
    share = np.where(y == 1, counted[1] / max((y == 1).sum(), 1), counted[0] / max((y == 0).sum(), 1))
    model.weights = logistic(held[list(OUT[:3])].to_numpy(), y, share / share.sum() * len(y))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, difference, score and predicted (score >= THRESHOLD)."""
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return apply(docs, model, "doc_id").select("doc_id", "difference", "score", predicted)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = score(docs, fit(docs.filter(remainder(5) != 0), labels))
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "difference")
