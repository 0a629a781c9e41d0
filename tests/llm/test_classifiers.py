import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertlift.llm import language, quality_zstd, toxicity
from alertlift.llm import textarrays as ta
from tests.llm.helpers import documents, prose


def slices(*texts):
    return next(ta.slices(pa.array(list(texts), pa.string())))


def test_words_lines_and_hashes():
    texts = slices("a b\n\nc", None, "", "b c ", "\x1fé ")
    found = ta.words(texts)
    assert found.counts().tolist() == [3, 0, 0, 2, 1]
    assert [texts.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)] == ["a", "b", "c", "b", "c", "\x1fé"]
    assert np.diff(ta.lines(texts).before).tolist() == [3, 1, 1, 1, 1]
    hashes = ta.span_hashes(texts.data, found.start, found.end)
    assert hashes[1] == hashes[3] and hashes[2] == hashes[4] and hashes[0] != hashes[1]
    assert len(ta.window_hashes(hashes, found, 2)[0]) == 3


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (0, 5, 9000, 1, 0, 40)] + [None]).slice(1)
    parts = list(ta.slices(column, max_bytes=10))
    assert sum(p.n for p in parts) == 6 and sum(len(p.data) for p in parts) == 9046
    assert not list(ta.slices(pa.array([], pa.string())))


@pytest.fixture(scope="module")
def model(spark):
    own = [(i, prose(i, 60, lang), lang) for i in range(120) for lang in ("en", "de")]
    return language.fit(spark.createDataFrame(own, "doc_id long, text string, lang string"))


def test_language_of_unseen_texts(spark, model):
    own = [(i, prose(i, 60, lang), lang) for i in range(500, 560) for lang in ("en", "de")]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    got = language.predict(docs, model, carried=("doc_id", "lang"))
    assert got.filter("lang = lang_pred and not rejected").count() >= 118
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_of_awkward_and_no_rows(spark, model):
    docs = documents(spark)
    got = language.predict(docs, model)
    assert got.count() == 19
    assert {x["doc_id"] for x in got.filter("lang_pred = 'und'").collect()} == {5, 6, 7, 13, None}
    assert got.filter("lang_pred = 'und' and (score != 0 or not rejected)").count() == 0
    assert language.predict(documents(spark, []), model).count() == 0
    nothing = language.fit(documents(spark, []))
    assert language.predict(docs, nothing).filter("lang_pred != 'und'").count() == 0


def test_foreign_script_is_rejected(spark, model):
    docs = spark.createDataFrame([(1, "漢字仮名交" * 40)], "doc_id long, text string")
    assert language.predict(docs, model).first()["rejected"]


def test_unlearned_texts_of_the_same_alphabet_are_rejected(spark, model):
    r = np.random.default_rng(9)
    finnish = "ja on ei se että hän oli mutta niin kuin jos vain ovat myös minä sinä tämä kaikki sitten vielä yksi kaksi näin".split()
    foreign = [" ".join(r.choice(finnish, 60)) for _ in range(40)]
    random_letters = [" ".join("".join(r.choice(list("bcdfghjklmnpqrstvwxyzjqxz"), 9)) for _ in range(40)) for _ in range(40)]
    blobs = ["".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 400)) for _ in range(40)]
    clean = [prose(700 + i, 5 + i % 30, lang) for i in range(50) for lang in ("en", "de")]
    gone = {}
    for name, texts in (("foreign", foreign), ("letters", random_letters), ("blobs", blobs), ("clean", clean)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        gone[name] = language.predict(docs, model).filter("rejected").count()
    assert gone["foreign"] >= 36 and gone["letters"] >= 38 and gone["blobs"] >= 38 and gone["clean"] <= 5, gone


def labelled(spark, toxic=False):
    own = []
    for i in range(300):
        bad = i % 4 == 0
        text = prose(i, 50)
        if bad and toxic:
            at = text.split(" ")
            at[7], at[30] = f"scumlord{i % 7}", "idiotic"
            text = " ".join(at)
        elif bad:
            text = text.upper().replace(" ", "!! | ")
        own.append((i, text, int(bad) if toxic else int(not bad)))
    return spark.createDataFrame(own, "doc_id long, text string, label int")


def test_quality_is_learned_and_calibrated(spark):
    rows = labelled(spark)
    fitted = quality_zstd.fit(rows.filter("doc_id % 3 != 0").drop("label"), rows)
    got = quality_zstd.score(rows.filter("doc_id % 3 = 0"), fitted).join(rows.select("doc_id", "label"), "doc_id")
    assert got.filter("predicted = label").count() >= 95
    odd = quality_zstd.score(documents(spark), fitted)
    assert odd.count() == 19 and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_zstd.score(documents(spark, []), fitted).count() == 0


def test_quality_without_both_labels(spark):
    docs = documents(spark)
    one = quality_zstd.fit(labelled(spark).drop("label"), labelled(spark).filter("label = 1"))
    none = quality_zstd.fit(labelled(spark).drop("label"), labelled(spark).filter("label = 7"))
    assert quality_zstd.score(docs, one).select(F.min("score")).first()[0] > 0.9
    assert quality_zstd.score(docs, none).select(F.max("score")).first()[0] == 0.5


def test_toxicity_finds_misspellings(spark):
    rows = labelled(spark, toxic=True)
    fitted = toxicity.fit(rows.drop("label"), rows)
    own = [(1, prose(901, 20) + " scumlords " + prose(902, 400)), (2, prose(903, 400)), (3, "idiotics"), (4, None), (5, "")]
    got = {x["doc_id"]: x["score"] for x in toxicity.apply(spark.createDataFrame(own, "doc_id long, text string"), fitted, "doc_id").collect()}
    assert got[1] > got[2] + 0.2  # a few dozen toxic texts teach
    assert got[4] == got[5] < 0.7
    assert toxicity.apply(documents(spark), fitted, "doc_id").count() == 19
    assert toxicity.apply(documents(spark, []), fitted, "doc_id").count() == 0


def test_repeated_words_count_once():
    texts = slices("a a a b a", "b b")
    data, found = toxicity.strip(texts)
    hashes, kept = toxicity.unrepeated(ta.span_hashes(data, found.start, found.end), found)
    assert kept.counts().tolist() == [3, 1]
