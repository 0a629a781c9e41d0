"""Toxicity by subword-bag embeddings in a linear softmax (operator 10).

A word is the bag of its character n-grams (3 to 5 bytes of the lower-cased word between boundary marks) and of
itself, hashed to ``BUCKETS`` embeddings; a word's vector is their mean, a text's vector the mean of its words', and
a linear softmax over it gives two classes.  Embeddings and softmax are trained jointly with Adam in numpy, so a
misspelling that training never saw shares most n-gram vectors with the word it comes from.

The softmax is linear, so a window's log-odds are the mean of its words' log-odds; a word's is worked out once per
task.  One insult in a long text would vanish in the mean over all its words, so bags are windows of ``WINDOW``
words, and the largest window counts.  Training follows that: all windows of a clean text are clean, while a toxic
text's windows share its label in proportion to how toxic the network finds them.  A logistic curve fitted on
labelled texts that training did not see turns the largest mean into a probability.

Fitted on about ``SAMPLE`` labelled documents of each label and purpose, chosen by a hash of their id; of a training
text at most ``BAGS`` windows enter, evenly spread, while scoring reads all.

Defined results: a null or empty text, or one without words, has log-odds 0 and gets the curve's value for a text
without toxic words; texts count whole; repeated rows get equal scores; without labels of both kinds every score is
the share of label 1 (0 without any label); an empty table gives no rows.  Only doc_id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.language import remainder
from alertlift.llm.quality_zstd import draw_sample, logistic
from alertlift.llm.shipping import ship

SAMPLE, BAGS = 2000, 128
BUCKETS, WIDTH = 1 << 16, 8
ORDERS = (3, 4, 5)
WINDOW = 8
EPOCHS, RATE = 60, 0.05
#: Epochs in which all windows of a toxic text count alike, and how sharply the share follows the odds after them.
ALIKE, SHARP = 12, 1.0
THRESHOLD = 0.7
#: Logits are this times the product, which lets small steps of the embeddings matter.
SCALE = 10.0
#: Words kept with their log-odds in one task; beyond, the table starts anew.
WORDS_HELD = 500_000

_PUNCTUATION = np.frombuffer(b".,;:!?\"'()[]{}", dtype=np.uint8)
_MARK = np.uint8(1)


def strip(texts: ta.Texts) -> tuple[np.ndarray, ta.Spans]:
    """Lower-cased bytes and the words without outer punctuation (never empty: a word of marks keeps one)."""
    data = texts.lowered().data
    found = ta.words(texts)
    outer = np.isin(data, _PUNCTUATION)
    inner = np.flatnonzero(~outer)
    start, end = found.start, found.end
    if len(inner):
        after = np.searchsorted(inner, start)
        before = np.searchsorted(inner, end) - 1
        plain = (after < len(inner)) & (before >= 0)
        low = np.where(plain, inner[np.minimum(after, len(inner) - 1)], start)
        high = np.where(plain, inner[np.maximum(before, 0)] + 1, end)
        good = (low < end) & (high > start) & (low < high)
        start, end = np.where(good, low, start), np.where(good, high, start + 1)
    else:
        end = np.minimum(start + 1, end)
    return data, ta.Spans(start, end, found.row, found.before)


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words, and how many each word has (at least one, the word itself)."""
    length = end - start
    size = length + 2
    cut = np.concatenate([[0], np.cumsum(size)])
    marked = np.full(cut[-1], _MARK, dtype=np.uint8)
    inside = np.ones(cut[-1], dtype=bool)
    inside[cut[:-1]] = inside[cut[1:] - 1] = False
    from_ = np.repeat(start - cut[:-1] - 1, size) + np.arange(cut[-1])
    marked[inside] = data[from_[inside]]
    word = np.repeat(np.arange(len(start)), size)
    owner, bucket = [np.arange(len(start))], [ta.span_hashes(data, start, end)]
    values = ta.BYTE_VALUES[marked]
    for order in ORDERS:
        n = len(marked) - order + 1
        if n <= 0:
            continue
        first = np.flatnonzero(word[:n] == word[order - 1 :])
        total = np.full(len(first), order, dtype=np.uint64)
        for j in range(order):
            total += values[first + j] * ta.FACTORS[j]
        owner.append(word[first])
        bucket.append(ta.mix(total))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(start))


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of consecutive groups of rows (no group is empty)."""
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.add.reduceat(values, at, axis=0) / counts[:, None]


@dataclass
class Network:
    embeddings: np.ndarray
    softmax: np.ndarray


def train(bags: list[np.ndarray], text: np.ndarray, labels: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> Network:
    """``bags``: word numbers of each window; ``text``: the text it is from, in order; ``labels``: of each text;
    ``buckets`` and ``counts``: the n-grams of each word."""
    random = np.random.default_rng(3)
    net = Network(random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), random.normal(0, 0.1, (WIDTH, 2)).astype(np.float32))
    sizes = np.array([len(b) for b in bags])
    member = np.concatenate(bags)
    bag = np.repeat(np.arange(len(bags)), sizes)
    word = np.repeat(np.arange(len(counts)), counts)
    first_bag = np.searchsorted(text, np.arange(len(labels)))
    toxic = labels[text] == 1
    truth = np.eye(2, dtype=np.float32)[labels[text]]
    per_text = np.diff(np.append(first_bag, len(text)))
    clean_share = 1 / max((~toxic).sum(), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (net.embeddings, net.softmax)]
    for epoch in range(1, EPOCHS + 1):
        vectors = _means(net.embeddings[buckets], counts)
        mean = _means(vectors[member], sizes)
        logits = mean @ net.softmax * SCALE
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        if epoch <= ALIKE:
            share = 1 / per_text[text]
        else:
            pull = SHARP * (logits[:, 1] - logits[:, 0])
            pull = np.exp(pull - np.maximum.reduceat(pull, first_bag)[text])
            share = pull / np.add.reduceat(pull, first_bag)[text]
        weight = np.where(toxic, share / max(labels.sum(), 1), clean_share)[:, None].astype(np.float32)
        error = (odds / odds.sum(axis=1, keepdims=True) - truth) * weight
        to_mean = error @ net.softmax.T * SCALE
        to_words = np.zeros((len(counts), WIDTH), dtype=np.float32)
        to_member = (to_mean / sizes[:, None])[bag]
        to_table = np.zeros_like(net.embeddings)
        for k in range(WIDTH):
            to_words[:, k] = np.bincount(member, to_member[:, k], minlength=len(counts))
            to_table[:, k] = np.bincount(buckets, (to_words[:, k] / counts)[word], minlength=BUCKETS)
        for value, gradient, (first, second) in zip((net.embeddings, net.softmax), (to_table, mean.T @ error * SCALE), moments, strict=True):
            first *= 0.9
            first += 0.1 * gradient
            second *= 0.999
            second += 0.001 * gradient**2
            value -= RATE * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return net


def unrepeated(hashes: np.ndarray, found: ta.Spans) -> tuple[np.ndarray, ta.Spans]:
    """The words that differ from the word before them in their text: a run of one word says no more than the word."""
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (found.row[1:] != found.row[:-1])
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], ta.Spans(found.start[keep], found.end[keep], found.row[keep], kept_before[found.before])


def _window_means(odds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Largest mean of log-odds over the windows of WINDOW words of each row.

    Fewer words are one window, and count as half a window at least: one word alone is little evidence.
    """
    total = np.concatenate([[0.0], np.cumsum(odds)])
    count = np.diff(before)
    out = np.zeros(len(count))
    short = (count > 0) & (count <= WINDOW)
    out[short] = (total[before[1:]] - total[before[:-1]])[short] / np.maximum(count[short], WINDOW // 2)
    if (count > WINDOW).any():
        means = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        means = np.append(means, -np.inf)
        for i in np.flatnonzero(count > WINDOW):
            out[i] = means[before[i] : before[i + 1] - WINDOW + 1].max()
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training bags: up to BAGS windows of each text, evenly spread, as its stripped words joined by blanks."""
    for batch in batches:
        for texts in ta.slices(batch.column(2)):
            data, found = strip(texts)
            _, found = unrepeated(ta.span_hashes(data, found.start, found.end), found)
            raw = data.tobytes()
            words, rows = [], []
            for i in range(texts.n):
                a, b = found.before[i], found.before[i + 1]
                starts = np.arange(a, b, WINDOW)
                for s in starts[:: max(1, -(-len(starts) // BAGS))]:
                    e = min(b, s + WINDOW)
                    words.append(b" ".join(raw[x:y] for x, y in zip(found.start[s:e], found.end[s:e], strict=True)))
                    rows.append(texts.first + i)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(words, pa.binary())], ["doc_id", "label", "words"])


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """One bounded sample: trains, and returns the embeddings' log-odds contributions."""
    frame = frame.sort_values(["doc_id", "words"])
    number: dict[bytes, int] = {}
    bags = [np.array([number.setdefault(w, len(number)) for w in bag.split(b" ")]) for bag in frame["words"]]
    words = list(number)
    data = np.frombuffer(b"".join(words) or b" ", dtype=np.uint8)
    cut = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    buckets, counts = grams(data, cut[:-1], cut[1:])
    text = (frame["doc_id"] != frame["doc_id"].shift()).cumsum().to_numpy() - 1
    labels = frame["label"].to_numpy(dtype=np.int64)[np.searchsorted(text, np.arange(text[-1] + 1))]
    net = train(bags, text, labels, buckets, counts)
    odds = (net.embeddings @ (net.softmax[:, 1] - net.softmax[:, 0]) * SCALE).astype("<f4")
    return pd.DataFrame({"odds": [odds.tobytes()]})


@dataclass
class Model:
    """Log-odds of each bucket (empty: none learned), and the curve's slope and constant."""

    odds: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x * self.weights[0] + self.weights[1], -50, 50)))


class Scorer:
    """Log-odds of texts, with the words seen so far."""

    def __init__(self, odds: np.ndarray):
        self.odds, self.hashes, self.values = odds.astype(np.float64), np.empty(0, np.uint64), np.empty(0)

    def words(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = (at < len(self.hashes)) & (self.hashes[np.minimum(at, max(len(self.hashes) - 1, 0))] == distinct) if len(self.hashes) else np.zeros(len(distinct), bool)
        value = np.zeros(len(distinct))
        value[known] = self.values[at[known]]
        if (~known).any():
            new = first[~known]
            buckets, counts = grams(data, start[new], end[new])
            value[~known] = _means(self.odds[buckets][:, None], counts)[:, 0]
            if len(self.hashes) > WORDS_HELD:
                self.hashes, self.values = distinct, value
            else:
                both = np.concatenate([self.hashes, distinct[~known]])
                order = np.argsort(both)
                self.hashes, self.values = both[order], np.concatenate([self.values, value[~known]])[order]
        return value[back]

    def texts(self, texts: ta.Texts) -> np.ndarray:
        data, found = strip(texts)
        if not len(found.start):
            return np.zeros(texts.n)
        hashes, found = unrepeated(ta.span_hashes(data, found.start, found.end), found)
        return _window_means(self.words(hashes, data, found.start, found.end), found.before)


def _apply(model, carried: list[str]) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value.odds) if len(model.value.odds) else None
        for batch in batches:
            for texts in ta.slices(batch.column(0)):
                found = scorer.texts(texts) if scorer else np.zeros(texts.n)
                own = [c.slice(texts.first, texts.n) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found), pa.array(model.value.probability(found))], [*carried, "log_odds", "score"])

    return run


def apply(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """The carried columns with log_odds and score of the whole text."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string"), *carried)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(_apply(spark.sparkContext.broadcast(model), list(carried)), f"{schema}, log_odds double, score double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1).  One half of the sample trains, the other calibrates."""
    ship(docs.sparkSession)
    chosen, counted = draw_sample(docs, labels, sample, 10)
    if chosen is None:
        share = np.clip(float(1 in counted), 1e-3, 1 - 1e-3)
        return Model(np.empty(0, np.float32), np.array([0.0, np.log(share / (1 - share))]))
    bags = chosen.filter("first").select("doc_id", "label", "text").mapInArrow(
        _bags, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, words binary"
    )
    learned = bags.groupBy(F.lit("all").alias("sample")).applyInPandas(_fit, "odds binary").collect()
    odds = np.frombuffer(bytes(learned[0]["odds"]), "<f4") if learned else np.empty(0, np.float32)
    model = Model(odds, np.array([0.0, np.log(counted[1] / counted[0])]))
    held = apply(chosen.filter("not first"), model, "label").toPandas().sort_values(["label", "log_odds"])
    if len(held):
        y = held["label"].to_numpy(dtype=float)
        share = np.where(y == 1, counted[1] / max((y == 1).sum(), 1), counted[0] / max((y == 0).sum(), 1))
        model.weights = logistic(held[["log_odds"]].to_numpy(), y, share / share.sum() * len(y))
    return model


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label"))
    scored = apply(docs, fit(docs.filter(remainder(3) != 1), labels), "doc_id")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out, "score", predicted, "log_odds")
