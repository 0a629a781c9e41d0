import hashlib
import math
import random

import pandas as pd
import pytest

from alertlift.llm import mixing, quality_rules, secrets
from tests.llm.helpers import WORD, documents, prose, words


def measured(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i : i + 8]), []).append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def test_ledger_measures_whole_texts(spark):
    r = random.Random(1)
    own = [(i, " ".join(r.choice(["a", "Bé", "c|", "\n", "漢字"]) for _ in range(r.randint(0, 80)))) for i in range(60)]
    own += [(100, "same line\nsame line\n\nsame line "), (101, " ".join(["w"] * 9)), (102, " ".join(map(str, range(8))) * 2)]
    extra = [(i, t, None, None, 0, 0.0, 0, None, None, None, None) for i, t in own]
    got = {x["doc_id"]: x for x in quality_rules.ledger(documents(spark, extra)).collect()}
    for i, text in own:
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == measured(text), text


def test_ledger_of_awkward_and_no_rows(spark):
    table = quality_rules.apply_policy(quality_rules.ledger(documents(spark)))
    assert table.count() == 19
    empty = table.filter("doc_id in (5, 6, 7)").collect()
    assert all(x["n_words"] == 0 and x["fail_bits"] & 1 and not x["kept"] for x in empty)
    assert quality_rules.ledger(documents(spark, [])).collect() == []


def test_ablations_follow_from_the_bits(spark):
    table = quality_rules.ledger(documents(spark)).cache()
    bits = [x["fail_bits"] & quality_rules.POLICIES["v2"] for x in table.collect()]
    for row in quality_rules.ablations(table, "v2").collect():
        own = quality_rules.BITS[row["rule"]]
        assert row["n_failing"] == sum(b & own > 0 for b in bits)
        assert row["n_only_this"] == sum(b == own for b in bits)
        assert row["n_kept_without"] == sum(b & ~own == 0 for b in bits)


def shared_out(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its cap."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    r = random.Random(2)
    own = [(i, prose(i, r.randint(0, 120)), "en", f"s{min(r.randint(0, 12), 5)}") for i in range(1500)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, chunk_rows=40).toPandas()
    assert sorted(got["doc_id"]) == list(range(1500))
    size = {i: len(words(t)) for i, t, *_ in own}
    assert all(size[i] == s for i, s in zip(got["doc_id"], got["size"]))
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    names = sorted(by.index)
    expected = shared_out(by["size"].to_dict(), {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)})
    for s in names:
        assert math.isclose(by["target"][s], expected[s], rel_tol=1e-9)
        assert abs(by["taken"][s] - expected[s]) <= 120
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(docs.repartition(7), chunk_rows=40).toPandas()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_mix_of_awkward_and_no_rows(spark):
    got = mixing.mix(documents(spark)).toPandas()
    assert len(got) == 19
    assert (got[got["size"] == 0]["taken"] == 0).all()
    assert got["source"].isna().sum() == 3
    assert mixing.mix(documents(spark, [])).collect() == []


def test_exchange_keeps_mass_and_expectation():
    for u in (0.0, 0.3, 0.999):
        a, b = mixing._exchange(0.3, 0.6, 10, 4, u)
        assert math.isclose(10 * a + 4 * b, 10 * 0.3 + 4 * 0.6)
        assert a in (0.0, 1.0) or b in (0.0, 1.0)
    draws = [mixing._exchange(0.3, 0.6, 10, 4, (i + 0.5) / 1000)[0] for i in range(1000)]
    assert math.isclose(sum(draws) / 1000, 0.3, abs_tol=0.005)


def test_base_spans():
    text = 'é token: "abc" secret=ABCDEF api_key = x.y-z9 AKIA' + "Z" * 16 + " AKIAshort " + "a" * 23 + " " + "0" * 24
    spans = secrets.base_spans(text)
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b in spans] == [
        ("assign", "secret=ABCDEF"), ("assign", "api_key = x.y-z9"), ("access", "AKIA" + "Z" * 16), ("hex", "0" * 24),
    ]
    assert secrets.redact(text, spans).count("<secret>") == 4
    assert secrets.redact("plain", []) == "plain"


def credential_docs(spark):
    r = random.Random(4)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(200)]
    own = [(i, f"{prose(i, 30)} password={h[:18]} {prose(i + 500, 10)}") for i, h in enumerate(hexes)]
    own += [(1000, f"words {hexes[0][:20]} words"), (1001, prose(77, 300)), (1002, None), (1003, "")]
    return spark.createDataFrame(own, "doc_id long, text string"), hexes


def test_grammars_add_spans_and_leave_prose_alone(spark):
    docs, hexes = credential_docs(spark)
    got = {x["doc_id"]: x for x in secrets.scan(docs, secrets.infer(docs), "doc_id").collect()}
    assert len(got) == 204
    assert got[1000]["spans"] == "format:6:26" and got[1000]["n_hex"] == 0
    assert got[1001]["spans"] == got[1002]["spans"] == got[1003]["spans"] == ""
    assert got[1002]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for i in range(200):
        text = docs.filter(f"doc_id = {i}").first()["text"] if i < 2 else None
        if text:
            assert got[i]["spans"] == secrets.written(secrets.base_spans(text))
        assert got[i]["n_assign"] == 1


def test_all_of_a_token_is_scored(spark):
    docs, hexes = credential_docs(spark)
    model = secrets.infer(docs)
    secret = hexes[0][:20]
    found = lambda text: [text[a:b] for a, k, b in model.spans(text) if k == 3]
    # Behind a path of more than 64 characters, and next to a base span in one token.
    path = "/".join(["usr", "share", "common", "documents", "projects", "archives", "letters", "pictures"]) + "/"
    assert len(path) > secrets.SEEN - 20 and secret in found("x " + path * 2 + secret + " y")
    assert any(secret in x for x in found("x AKIA" + "Z" * 16 + "/" + secret + " y"))
    assert secrets.candidates("a" * 20 + "." + "b" * 9, [(5, 2, 21)], 8) == [(21, 30)]
    assert found("x " + path * 2 + " y") == []


def test_credentials_may_lack_digits(spark):
    r = random.Random(14)
    own = [(i, "password=" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20))) for i in range(300)]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    assert secrets.infer(docs).spans("x qWhZtRbNxkLpVsGdYmTc y") == [(2, 3, 22)]


def test_rare_kinds_are_learned_from_all_documents(spark):
    r = random.Random(12)
    own = [(i, prose(i, 12) + (f" AKIA{''.join(r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}" if i % 20 == 0 else "")) for i in range(800)]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    assert "access" in secrets.infer(docs, sample_docs=50).kinds


def test_automaton_merges_states():
    automaton = secrets.Automaton(["".join(random.Random(i).choice("0123456789abcdef") for _ in range(20)) for i in range(300)])
    assert len(automaton.states) < 60
    assert automaton.per_character("0a1b2c3d4e5f60718293") > automaton.per_character("ZZZZZZZZZZZZZZZZZZZZ")


def test_automata_keep_lengths_and_prefixes():
    r = random.Random(31)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    fixed = secrets.Automaton([draw("0123456789abcdef", 32) for _ in range(400)])
    assert len(fixed.states) == 33  # one state a place: all digits alike, and the end only at 32
    full, short = draw("0123456789abcdef", 32), draw("0123456789abcdef", 24)
    assert fixed.per_character(full) > fixed.per_character(short) + 0.15
    led = secrets.Automaton(["sk_" + draw("abcdefghijklmnopqrstuvwxyz", 24) for _ in range(400)])
    own = draw("ghijklmnopqrstuvwxyz", 24)
    assert len(led.states) > 20 and led.per_character("sk_" + own) > led.per_character(own + "_sk") + 0.3
    mixed = secrets.Automaton([draw("0123456789", 10) + draw("ghij", 10) if i % 2 else draw("ghij", 10) + draw("0123456789", 10) for i in range(400)])
    assert mixed.per_character("0123456789ghijghijgh") > mixed.per_character("0g1g2g3g4g5g6g7g8g9g") + 0.5


def test_plain_numbers_are_not_marked(spark):
    r = random.Random(32)
    own = [(i, f"{prose(i, 20)} {''.join(r.choice('0123456789abcdef') for _ in range(32))}") for i in range(300)]
    model = secrets.infer(spark.createDataFrame(own, "doc_id long, text string"))
    assert "hex" in model.kinds
    for n in (16, 18, 20, 22):
        assert model.spans("x " + "".join(r.choice("0123456789") for _ in range(n)) + " y") == []


def test_long_credentials_count_whole(spark):
    r = random.Random(33)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = lambda n: "".join(r.choice(letters) for _ in range(n))
    own = [(i, f"{prose(i, 20)} token={blob(r.randint(120, 160))}") for i in range(200)]
    model = secrets.infer(spark.createDataFrame(own, "doc_id long, text string"))
    string = blob(140)
    assert model.spans(f"x {string} y") == [(2, 3, 142)]
    assert (0, 140) not in model.found(string[:70] + "." * 70)


@pytest.mark.parametrize("own", [None, []])
def test_scan_awkward_and_no_rows(spark, own):
    docs = documents(spark, own)
    got = secrets.scan(docs, secrets.infer(docs), "doc_id").collect()
    assert len(got) == (19 if own is None else 0)
    for row in got:
        if row["doc_id"] == 16:
            assert (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 1)
    assert secrets.redacted(docs, secrets.infer(docs)).columns == docs.columns
