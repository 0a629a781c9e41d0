import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from alertlift.llm import bpe_trie, token_store
from alertlift.llm import textarrays as ta
from alertlift.sources.staging import scratch_path, stage
from tests.llm.helpers import documents, prose, rows

PATH = bpe_trie.public_path()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by_table(table, texts):
    out = []
    for part in ta.slices(pa.array(texts, pa.string())):
        ids, cuts = table.texts(part)
        out += [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    return out


PIECES = ["a", "the", "ing", " ", "  ", "\n", " \n", "\t", " ", "é", "ß", "漢", "字", "😀", "́", "1", "23", "!", ".,", "'s", "'re", "'", "<|endoftext|>", "<|", "aaaa"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_both_encoders_are_the_library(texts):
    expected = [ids_of(t) for t in texts]
    trie, table = bpe_trie.trie_of(PATH)
    assert by_table(table, texts) == expected
    assert by_table(token_store._library(PATH), texts) == expected
    assert [trie.decode(np.array(x, dtype=np.int64)) for x in expected] == [LIBRARY.decode(x, skip_special_tokens=False) for x in expected]


def test_small_tables_start_anew():
    trie, _ = bpe_trie.trie_of(PATH)
    table = bpe_trie.ChunkTable(trie.words_to_bytes, trie.encode_all, list(trie.added), held=5)
    texts = [prose(i, 30) for i in range(6)]
    assert by_table(table, texts) == [ids_of(t) for t in texts]


def test_encode_decode_digests(spark):
    docs = documents(spark)
    encoded = bpe_trie.encode(docs, PATH, "doc_id")
    by_id = {x["doc_id"]: x for x in encoded.collect() if x["doc_id"]}
    texts = {r[0]: r[1] for r in rows() if r[0]}
    for i, text in texts.items():
        assert np.frombuffer(bytes(by_id[i]["ids"]), "<u4").tolist() == ids_of(text)
    back = {x["doc_id"]: x["text"] for x in bpe_trie.decode(encoded, PATH, "doc_id").collect() if x["doc_id"]}
    assert back == {i: t or "" for i, t in texts.items()}
    for x in bpe_trie.digests(docs, PATH).collect():
        if x["doc_id"]:
            ids = np.array(ids_of(texts[x["doc_id"]]), "<u4")
            assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert x["decoded_sha256"] == hashlib.sha256((texts[x["doc_id"]] or "").encode()).hexdigest()
    assert bpe_trie.digests(documents(spark, []), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 5))
def test_grammar_round_trip(ids, rounds):
    ids = np.array(ids * 3, dtype=np.uint32)
    rules, expansions, sequence = token_store.compress(ids, rounds, least=4)
    assert token_store.Grammar(rules, expansions).expand(sequence).tolist() == ids.tolist()
    shard = {"rules": rules.astype("<u4").tobytes(), "expansions": expansions.astype("<u4").tobytes(), "sequence": sequence.astype("<u4").tobytes()}
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
        assert token_store.decode_range(shard, a, b).tolist() == ids[a:b].tolist()


def test_repair_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    rules, _, sequence = token_store.compress(ids, 8)
    assert len(sequence) + rules.size < len(ids) / 10


def test_repair_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(4)
    passage, rare = r.integers(10, 60000, 700), r.integers(10, 60000, 30)
    parts = [x for k in range(64) for x in (passage, r.integers(10, 60000, 20))] + [x for k in range(6) for x in (rare, r.integers(10, 60000, 9))]
    ids = np.concatenate([*parts, np.full(1000, 7)]).astype(np.uint32)
    rules, expansions, sequence = token_store.compress(ids)
    assert token_store.Grammar(rules, expansions).expand(sequence).tolist() == ids.tolist()
    # A passage, frequent or not, becomes one nonterminal, and a run takes a few.
    assert (expansions == 700).any() and (expansions == 30).any() and expansions.max() == 700
    assert len(sequence) < 64 * 21 + 6 * 10 + 12
    places = {}
    for i, pair in enumerate(zip(sequence.tolist(), sequence[1:].tolist())):
        if not places.get(pair) or places[pair][-1] < i - 1:
            places.setdefault(pair, []).append(i)
    assert max(map(len, places.values())) < token_store.LEAST


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_store_round_trip(spark, shard_ids):
    path = scratch_path(spark, "store")
    token_store.write_store(documents(spark), path, PATH, shard_ids)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda x: (x["start"]))
    order = [x["doc_id"] for x in got]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:]) and len(order) == 19
    texts = {r[0]: r[1] for r in rows() if r[0]}
    place = 0
    for x in got:
        ids = np.frombuffer(bytes(x["ids"]), "<u4")
        assert x["start"] == place and x["n_tokens"] == len(ids)
        place += len(ids)
        if x["doc_id"]:
            assert ids.tolist() == [*ids_of(texts[x["doc_id"]]), token_store.END_ID]
            assert zlib.crc32(ids.tobytes()) == zlib.crc32(bytes(x["ids"]))


def test_empty_store(spark):
    path = scratch_path(spark, "store")
    token_store.write_store(documents(spark, []), path, PATH)
    assert token_store.read_store(spark, path).collect() == []


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = documents(spark)
    kept, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        kept = stage(step(spark, kept, sf_dir))
        seen[name] = kept.collect()
        if name != "bpe":
            assert kept.columns == docs.columns
    # Texts without letters go; one of each group of copies stays.
    assert not {5, 6, 7, 13} & {x["doc_id"] for x in seen["language_id"]}
    ids = [x["doc_id"] for x in seen["ngram_jaccard_join"] if x["doc_id"]]
    assert sorted(ids) == [1, 4, 8, 10, 12, 14, 15, 16]
    clean = next(x for x in seen["secret_scan"] if x["doc_id"] == 16)
    assert clean["text"].count("<secret>") == 3 and clean["n_chars"] == len(clean["text"])
    texts = {x["doc_id"]: x["text"] for x in seen["mixing"]}
    for x in seen["bpe"]:
        assert np.frombuffer(bytes(x["ids"]), "<u4").tolist() == ids_of(texts[x["doc_id"]])


def test_columns_of_any_name_pass_all_stages(spark, sf_dir):
    names = ["a.b", "_row", "_key", "text ", "Copies", "_copies", "fold", "_id", "_", "x`y"]
    docs = documents(spark)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    kept = docs
    for name, step in corpus_pipeline.STAGES:
        kept = stage(step(spark, kept, sf_dir))
        if name != "bpe":
            assert kept.columns == docs.columns
            assert {tuple(r)[-len(names) :] for r in kept.collect()} == {tuple(range(len(names)))}
    assert kept.count() > 0


def test_pipeline_of_no_documents(spark, sf_dir):
    kept = documents(spark, [])
    for _, step in corpus_pipeline.STAGES:
        kept = stage(step(spark, kept, sf_dir))
    assert kept.collect() == []


def shared_ids(spark):
    """Rows without an id and ids with two texts, among copies of other rows."""
    texts = [
        (None, prose(31, 40)), (None, prose(32, 40)), (None, prose(33, 40)), (None, prose(33, 40) + " end"), (None, ""), (None, None),
        (5, prose(34, 40)), (5, prose(35, 40)), (7, prose(35, 40)), (3, prose(36, 40)), (None, prose(36, 40) + " end"),
        (9, prose(37, 40)), (9, prose(36, 40)), (11, prose(38, 40)), (11, prose(38, 40)), (12, ""), (12, " "),
    ]
    own = [(i, t, "en", "abc"[k % 3], 0, 0.0, k, None, None, None, None) for k, (i, t) in enumerate(texts)]
    return documents(spark, own)


def test_copies_are_dropped_by_row_not_by_id(spark, sf_dir):
    kept = corpus_pipeline.drop_near_copies(spark, shared_ids(spark), sf_dir)
    got = sorted((x["doc_id"] or 0, x["text"] or "") for x in kept.collect())
    nameless = [(0, prose(31, 40)), (0, prose(32, 40)), (0, ""), (0, "")]
    ids = [(5, prose(34, 40)), (5, prose(35, 40)), (3, prose(36, 40)), (9, prose(37, 40)), (11, prose(38, 40)), (12, ""), (12, " ")]
    third = [x for x in got if x[0] == 0 and x[1].startswith(prose(33, 40))]
    assert len(third) == 1
    assert sorted(x for x in got if x not in third) == sorted(nameless + ids)


def test_every_taken_row_arrives(spark, sf_dir):
    r = random.Random(6)
    own = [(i if i % 3 else None, prose(i, r.randint(1, 60)), "en", "abc"[i % 3 if i % 5 else 2], 0, 0.0, i, None, None, None, None) for i in range(300)]
    own += [(1, prose(900, 30), "en", "c", 0, 0.0, 900, None, None, None, None), (None, None, "en", None, 0, 0.0, 901, None, None, None, None)]
    for given_rows in (own, [x for x in own if x[0] or x[6] == 0]):  # many rows without an id, and one
        docs = stage(documents(spark, given_rows))
        found = corpus_pipeline.mix_sources(spark, docs, sf_dir).toPandas()
        assert set(found["size"].value_counts()) <= {1, 2}
        words_of = {x[6]: len((x[1] or "").split()) for x in given_rows}
        source_of = {x[6]: x[3] for x in given_rows}
        wanted = {x["source"]: x["target"] for x in corpus_pipeline.mixing.targets(corpus_pipeline.mixing.sizes(docs)).collect()}
        longest = max(words_of.values())
        for source, target in wanted.items():
            taken = sum(words_of[i] for i in found["size"] if source_of[i] == source)
            assert abs(taken - target) <= longest, (source, taken, target)
        # Sources that are taken at the cap arrive whole, rows without an id included.
        for source, target in wanted.items():
            whole = {i for i, s in source_of.items() if s == source and words_of[i]}
            if target and target >= 2 * sum(words_of[i] for i in whole):
                assert sum(found["size"].isin(whole)) == 2 * len(whole)


def test_rounds_read_only_places_that_can_be_frequent(monkeypatch):
    ids = np.random.default_rng(5).zipf(1.3, 60_000).clip(max=40_000).astype(np.uint32)
    sizes = []
    real = np.sort
    monkeypatch.setattr(token_store.np, "sort", lambda x, *a: sizes.append(len(x)) or real(x, *a))
    rules, expansions, sequence = token_store.compress(ids)
    assert (token_store.Grammar(rules, expansions).expand(sequence) == ids).all()
    assert len(sizes) > 4 and sizes[-1] < len(sequence) / 10
    # Whole all the same: no pair is left with four places that don't overlap.
    pairs, counts = np.unique(np.stack([sequence[:-1], sequence[1:]], axis=1), axis=0, return_counts=True)
    for (left, right), n in zip(pairs[counts >= 4], counts[counts >= 4], strict=True):
        places = np.flatnonzero((sequence[:-1] == left) & (sequence[1:] == right))
        taken, last = 0, -2
        for place in places:
            if place > last + 1:
                taken, last = taken + 1, place
        assert taken < 4, (left, right, n)
