"""Quality rules as a bitmask ledger (operator 9).

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
Policies are versioned masks over those bits, so a new policy, its verdicts and its ablations need no second
look at the texts.

Defined results: a null or empty text has no words (all measurements 0) and fails ``few_words``; very long
texts are measured whole; repeated rows are measured each for itself; an empty table gives an empty ledger.
The ledger has its own columns next to ``doc_id`` only, so extra columns of the input cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.shipping import ship

WINDOW = 8

#: Rules in bit order: name and what fails, in SQL over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "2 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars > 15 * n_words or word_chars < 2 * n_words)"),
    ("shouting", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
    ("few_alpha_words", "100 * n_alpha_words < 50 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: Versioned policies; a document is kept when none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of("few_words", "repeated_windows", "many_symbols", "word_length", "shouting", "few_alpha_words"),
    "v2": mask_of(*BITS),
}
DEFAULT_POLICY = "v1"

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_alpha_words",
]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
#: For words with a letter, any character beyond ASCII counts as one.
_ALPHA = _LETTER.copy()
_ALPHA[0x80:] = True


def _repeat_words(hashes: np.ndarray, found: ta.Spans) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in that row."""
    windows, first = ta.window_hashes(hashes, found, WINDOW)
    if not len(windows):
        return np.zeros(len(found.before) - 1, dtype=np.int64)
    own = ta.mix(windows + found.row[first].astype(np.uint64) * ta.FACTORS[WINDOW])
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(found.before) - 1, dtype=np.int64)
    at = np.searchsorted(twice, own)
    starts = first[twice[np.minimum(at, len(twice) - 1)] == own]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return ta.row_sums(np.cumsum(edge[:-1]) > 0, found.before)


def _dup_lines(texts: ta.Texts, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line of their row."""
    pieces = ta.lines(texts)
    words_before = np.concatenate([[0], np.cumsum(is_word, dtype=np.int64)])
    keep = words_before[pieces.end] > words_before[pieces.start]
    row = pieces.row[keep]
    n_lines = np.bincount(row, minlength=texts.n)
    hashes = ta.span_hashes(texts.data, pieces.start[keep], pieces.end[keep])
    distinct = np.unique(np.stack([row.astype(np.uint64), hashes], axis=1), axis=0)[:, 0] if len(row) else row
    return n_lines, n_lines - np.bincount(distinct.astype(np.int64), minlength=texts.n)


def measure(texts: ta.Texts) -> dict[str, np.ndarray]:
    found = ta.words(texts)
    is_word = ta._WORD[texts.data]
    bytes_before = lambda flags: ta.row_sums(flags, texts.offsets)
    n_lines, n_dup = _dup_lines(texts, is_word)
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[texts.data], dtype=np.int64)])
    return {
        "n_words": found.counts(),
        "word_chars": bytes_before(is_word & ta.characters(texts.data)),
        "n_symbols": bytes_before(_SYMBOL[texts.data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": _repeat_words(ta.span_hashes(texts.data, found.start, found.end), found),
        "n_lines": n_lines,
        "n_letters": bytes_before(_LETTER[texts.data]),
        "n_upper": bytes_before(_UPPER[texts.data]),
        "n_alpha_words": ta.row_sums(alpha[found.end] > alpha[found.start], found.before),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measure(t) for t in ta.slices(batch.column(1))]
        if parts:
            columns = [pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``fail_bits``: bit i is set when rule i fails."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _measure_batches, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def fails(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(table: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Add ``kept``: no bit of the policy is set."""
    return table.withColumn("kept", ~fails(F.col("fail_bits"), POLICIES[policy]))


def ablations(table: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """One row per rule of the policy: documents failing it, failing only it, and kept without it.

    Documents are first counted by their bits (at most 2**rules rows); all figures are bitwise sums over that.
    """
    mask = POLICIES[policy]
    by_bits = table.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = [(name, bit) for name, bit in BITS.items() if bit & mask]
    n_if = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    figures = [
        F.struct(
            F.lit(name).alias("rule"),
            n_if(fails(F.col("bits"), bit)).alias("n_failing"),
            n_if(F.col("bits") == bit).alias("n_only_this"),
            n_if(~fails(F.col("bits"), mask & ~bit)).alias("n_kept_without"),
        )
        for name, bit in rules
    ]
    return by_bits.agg(F.array(*figures).alias("all")).select(F.inline("all"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base_failed = fails(F.col("fail_bits"), POLICIES["base"])
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "fail_bits",
    )
