"""Chat formatting, Merkle manifest and filter audit against plain Python, with awkward input."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlift.llm import chat_format, filter_audit, merkle
from alertlift.sources.staging import scratch_path
from tests.llm import helpers as h

LOG = "conv_id long, position long, entry long, seq long, kind string, role string, text string, piece string, events int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Chat formatting ----------------------------------------------------------------------


def fold_plainly(events):
    """The messages of a log, event by event."""
    first = -(1 << 62)
    seen, state = set(), {}
    order = lambda e: (e[3] if e[3] is not None else first, e[4] in ("start", "edit", "regenerate"), e[6] or "", e[5] is not None, e[5] or "")
    for e in sorted((e for e in events if e[4] in ("start", "delta", "edit", "regenerate")), key=order):
        key = (e[0], e[1] if e[1] is not None else first, e[2])
        if (key, *order(e)) in seen:
            continue
        seen.add((key, *order(e)))
        role, text = state.get(key, ("", ""))
        text = (e[6] or "") if e[4] != "delta" else text + (e[6] or "")
        state[key] = (e[5] if e[5] is not None else role, text)
    return {(*k, *v) for k, v in state.items()}


def log(spark, events):
    return spark.createDataFrame([(*e, "x", 1) for e in events], LOG)


def folded(messages):
    return {(r.conv_id, r.position, r.entry, r.role, r.text) for r in messages.collect()}


def test_log_with_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, 0, "start", "user", "Hi"), (1, 0, 0, 1, "delta", None, " there"),
        (1, 1, 0, 0, "start", "assistant", None), (1, 1, 0, 1, "delta", None, "wrong"),
        (1, 1, 0, 2, "regenerate", None, None), (1, 1, 0, 3, "delta", None, "right "), (1, 1, 0, 4, "delta", None, "answer"),
        (1, 1, 0, 4, "delta", None, "answer"), (1, 2, 0, 0, "start", "user", "first"), (1, 2, 0, 5, "edit", None, "second"),
        (1, 2, 0, 6, "delta", "system", "!"), (1, 2, 0, 9, "note", "x", "ignored"), (1, 2, 0, 9, None, "x", "ignored"),
        (None, None, 0, None, "start", None, "no id"), (2, 0, 0, 1, "delta", None, "never opened"),
    ]
    got = folded(chat_format.fold_messages(log(spark, events)))
    assert got == fold_plainly(events)
    assert (1, 1, 0, "assistant", "right answer") in got and (1, 2, 0, "system", "second!") in got


def test_folding_by_runs_equals_folding_event_by_event(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "RUN", 3)
    r = random.Random(5)
    events = [
        (r.randint(0, 2), r.randint(0, 40), 0, seq, r.choice(["delta"] * 6 + ["edit", "regenerate", "start"]),
         r.choice([None, None, "user", "assistant"]), r.choice([None, "", "a", "b\\", "#"]))
        for seq in range(400)
    ]
    assert folded(chat_format.fold_messages(log(spark, events))) == fold_plainly(events)


TEXTS = ["", None, "\\", "\\\\n", "###", "####", "### user: x</turn>\n", "</turn>", "<</turn", "a: b", "Grüße 漢字 😀", "\n\n", "x" * 5000]


def test_every_text_and_role_comes_back(spark):
    said = [(1, i, role, t) for i, (role, t) in enumerate(itertools.product(["user", "assistant", "a: b:", "", None, "### <"], TEXTS))]
    said += [(2, 0, "user", None), (3, None, "user", "late"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (None, 0, "assistant", "x")]
    rows = spark.createDataFrame([(*s, "z", 0) for s in said], "conv_id long, turn long, role string, text string, piece string, seq int").repartition(5)
    out = chat_format.format_conversations(rows, scratch_path(spark, "chat"))
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    parts = {}
    for r in out.orderBy("piece").collect():
        parts.setdefault(r.conv_id, []).append(r)
    assert max(len(p) for p in parts.values()) > 1
    for conv in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in said if c == conv))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha(*[f"{role}\n{text}\n" for _, role, text in turns])
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), sha(learned))
        assert got[conv].formatted_chars == sum(len(r.text) for r in parts[conv])
        masked = [r.text[a:b] for r in parts[conv] for a, b in r.loss]
        assert not any("###" in m or "</turn>" in m for m in masked)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_conversations(empty, scratch_path(spark, "chat"))).count() == 0


def test_formatting_runs_no_python(spark, sf_dir):
    plan = chat_format.op11_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan += chat_format.render(chat_format.fold_messages(chat_format.conversation_log(rows)))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# Merkle manifest ------------------------------------------------------------------------


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i // 3 * 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return out


def tree_plainly(rows):
    """Multiset of the rows that op12 returns."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: levels([leaf_of(r) for r in by_source[s]]) for s in names}
    world = levels([trees[s][-1][0] for s in names])
    found = Counter()
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            way = steps(trees[s], i) + steps(world, k)
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf_of((r[0], r[1].replace("\n", ""), *r[2:]) if hit else r)
            for left, right in way:
                x = sha(left, x, right)
            root = world[-1][0]
            found[(r[0], leaf_of(r), trees[s][-1][0], root, sha(*[a + b for a, b in way]), x, x == root)] += 1
    return found


def run_manifest(spark, rows):
    folder = scratch_path(spark, "sf")
    h.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return Counter(tuple(r) for r in merkle.op12_merkle_manifest(spark, folder).collect())


def test_manifest_of_awkward_rows(spark):
    rows = h.rows()
    got = run_manifest(spark, [*rows, rows[3], rows[3]])
    assert got == tree_plainly([*rows, rows[3], rows[3]])


@pytest.mark.parametrize("n", [1, 3, 81, 82, 250])
def test_trees_at_and_around_kept_levels(spark, n):
    rows = [(i, f"line {i}\nend", "en", "a", 7, 9.5, -1, "x", None, "zz", "q") for i in range(n)]
    rows += [(1000 + i, "t", None, f"s{i}", 1, 9.5, -1, "x", None, "zz", "q") for i in range(5)]
    got = run_manifest(spark, rows)
    assert got == tree_plainly(rows)
    assert all(r[-1] == (r[5] == r[3]) for r in got)


def test_only_every_few_levels_are_kept(spark):
    leaves = spark.range(700).select(F.lit("s").alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    tree = merkle.build(merkle.placed(leaves, ["s"], ["h"]), ["s"])
    assert [level.count() for level in tree.kept] == [700, 9, 1]
    assert tree.roots.count() == 1


def test_manifest_of_nothing(spark):
    assert run_manifest(spark, []) == Counter()


# Filter audit -------------------------------------------------------------------------------


def masks_plainly(rows):
    out = []
    for r in rows:
        text, words = r[1] or "", h.words(r[1])
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text),
            r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows),
        ]
        out.append((r[0], r[3] or "", sum(f << i for i, f in enumerate(fails))))
    return out


def audit_plainly(rows, labels):
    masks, out = masks_plainly(rows), {}
    marked = lambda i, k: any(x[0] is not None and x[0] == i and x[k] == 1 for x in labels)
    for part in {m[1] for m in masks}:
        own = [(m, marked(i, 1), marked(i, 2)) for i, p, m in masks if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [x for x in left if x[0] & bit]
                kept = [x for x in left if not x[0] & bit]
                failing = sum(1 for x in own if x[0] & bit)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), failing - len(gone), sum(1 for x in own if x[0] == bit),
                    sum(x[1] for x in gone), sum(x[2] for x in gone), name,
                ]
                shapley[name] += len(gone)
                left = kept
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, rows, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string")
    counts = filter_audit.mask_counts(filter_audit.failure_masks(h.documents(spark, rows)), table)
    return {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.interactions(counts).collect()}


def audit_rows():
    words = h.prose(9, 300)
    texts = [words, words + " #", "A B " + words, words, "x y " * 150, words + " tail", words + " tail", "#", "", None, "Z" * 30]
    more = [(100 + i, t, "en", "ab"[i % 2], 1, 9.5, -1, "x", None, "zz", "q") for i, t in enumerate(texts)]
    return [*h.rows(), *more, (3, words, "en", None, 1, 9.5, -1, "x", None, "zz", "q"), (3, words, "en", None, 1, 9.5, -1, "x", None, "zz", "q")]


LABELS = [(i, i % 2, int(i % 3 == 0), "n") for i in range(0, 112)] + [(101, 1, 1, "n"), (101, None, None, None), (None, 1, 1, "n")]


def test_audit_against_plain_python(spark):
    assert audit(spark, audit_rows(), LABELS) == audit_plainly(audit_rows(), LABELS)


def test_audit_with_tiny_tries(spark, monkeypatch):
    """Texts of one trie are split over many flushes, ranges and shards, and the flags stay."""
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 700)
    dealer = filter_audit.deal(h.documents(spark, audit_rows()).select("doc_id", "source", "text"))
    assert dealer.parts > 10
    masks = filter_audit.failure_masks(h.documents(spark, audit_rows()))
    assert Counter(tuple(r) for r in masks.selectExpr("doc_id", "coalesce(source, '')", "mask").collect()) == Counter(masks_plainly(audit_rows()))


def test_audit_of_nothing(spark):
    assert audit(spark, [], LABELS) == {} and len(audit(spark, h.rows()[:1], [])) == 600


def test_trie_holds_the_smallest_id_of_every_text():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(3000)]
    trie, least, at = filter_audit.RadixTrie(), {}, {}
    for t in texts:
        key = r.randint(-50, 10**6)
        at[t] = trie.insert(t, key)
        least[t] = min(key, least.get(t, key))
    assert len(trie.least) == len(least) and all(trie.least[at[t]] == m for t, m in least.items())


def test_bounds_grow_where_texts_begin_alike():
    near = sorted(b"the same long licence text " + bytes([65 + i]) for i in range(6))
    cuts = filter_audit._separators([b"a", b"b", *near])
    assert cuts[0] == b"b" and cuts[2:] == near[1:]
    dealer = filter_audit._Dealer(cuts, [1, 4] + [1] * (len(cuts) - 1))
    assert len({dealer.part(b"b" + bytes([i])) for i in range(200)}) == 4 and dealer.part(near[3]) == dealer.part(near[3])


def test_shares_of_orders_add_up():
    keys, effect = filter_audit._effects()
    assert len(keys) == 600 and (effect["kept"][0] == 1).all()
    removed = effect["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (removed == (np.arange(32) > 0)[:, None]).all()
