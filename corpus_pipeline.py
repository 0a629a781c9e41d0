"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
one's documents.  All but the last return the columns of documents, extra ones included.  These ride along in one struct, with
nothing but columns of known names beside it, so their names cannot clash and may hold dots or blanks.

Whole rows are joined with lists of keys in two stages.  Such a list grows with the documents, so these joins sort and
merge at every size instead of changing their plan where a list becomes too large to broadcast.

Defined results: documents with a null or empty text are rejected by the first stage; repeated rows count as copies and
one stays; ties between copies go to the smallest doc_id; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import bpe_trie, language, mixing, ngram_join, secrets
from alertlift.sources.staging import stage

#: Trained models and random choices are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _row(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and all columns as the struct ``_row``."""
    return docs.select(*columns, F.struct(*[F.col(secrets.quoted(c)) for c in docs.columns]).alias("_row"))


def _unpacked(rows: DataFrame) -> DataFrame:
    names = rows.schema["_row"].dataType.names
    return rows.select(*[F.col(f"_row.{secrets.quoted(c)}").alias(c) for c in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go.  Learned from the documents that state a language."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.predict(_row(docs, "text"), model, carried=("_row",))
    return _unpacked(found.filter("not rejected"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key`` and ``_row`` of every row.  The key is doc_id; rows without an id of their own get one above all ids.

    Only those rows are staged, which settles their keys for all later reads.
    """
    rows = _row(docs, "doc_id").select(F.col("doc_id").cast("long").alias("_key"), "_row")
    top, nameless = rows.agg(F.max("_key"), F.count_if(F.col("_key").isNull())).first()
    again = stage(rows.filter("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"))
    if not nameless and again.isEmpty():
        return rows
    above = lambda found, least: stage(found.select((F.monotonically_increasing_id() + F.lit(least)).alias("_key"), "_row"))
    if top is not None and top >= 1 << 62:  # no room above the ids
        return above(rows, 0)
    shared = rows.join(again, "_key", "left_semi").unionByName(rows.filter("_key is null"))
    own = rows.filter("_key is not null").join(again, "_key", "left_anti")
    return own.unionByName(above(shared, 0 if top is None else top + 1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    The one with the smallest doc_id stays, one without doc_id only where no other has one.
    """
    keyed = _keyed(docs)
    rows = ngram_join.jaccard_join(keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))).rows
    rows = rows.filter("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id")
    named = rows.join(keyed.select("_key", F.col("_row.doc_id").alias("_id")), "_key")
    # A component bears its smallest key; where an id is used repeatedly, that may not be the row with the smallest id.
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key"))["_key"].alias("_first"))
    moved = stage(first.filter("_first != component_id"))
    gone = rows.join(moved, "component_id", "left").filter("_key != coalesce(_first, component_id)").select("_key")
    return _unpacked(keyed.join(stage(gone).hint("merge"), "_key", "left_anti"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date."""
    clean = secrets.redacted(docs, secrets.infer(docs))
    if "n_chars" not in docs.columns:
        return clean
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    keyed = _keyed(docs)
    mixed = mixing.mix(keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_row.source").alias("source")))
    taken = stage(mixed.filter("copies > 0").select(F.col("doc_id").alias("_key"), F.col("copies").cast("int").alias("_copies")))
    copies = keyed.join(taken.hint("merge"), "_key").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return _unpacked(copies)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of every document (little-endian unsigned 32-bit)."""
    encoded = bpe_trie.encode(docs, bpe_trie.public_path(), "doc_id", "source")
    return encoded.select("doc_id", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
