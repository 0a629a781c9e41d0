import random

import numpy as np
import pyarrow as pa
import pytest

from alertlift.llm import lattice, ngram_join
from alertlift.llm.components import components
from tests.llm.helpers import LOWER, documents, prose, smallest_reachable, words


def brute(texts, width, num, den):
    sets = {}
    for i, text in texts:
        found = words((text or "").translate(LOWER))
        sets[i] = {tuple(found[j : j + width]) for j in range(len(found) - width + 1)} or ({tuple(found)} if found else set())
    ids = [i for i in sets if sets[i]]
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    return {i: len(s) for i, s in sets.items()}, smallest_reachable(sets, links)


def variants():
    """Chains of edits: near copies, copies of copies and texts that share a long passage."""
    r = random.Random(3)
    passage = prose(99, 40)
    out = []
    for family in range(12):
        text = prose(family, r.randint(8, 90)).split(" ")
        for _ in range(r.randint(1, 9)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(["x", "Y", "the", "zz"])
    out += [passage + " " + prose(200 + i, r.randint(3, 60)) for i in range(25)] + ["", None, "a", "a", "A b", "a B"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "at_least", "block"), [(4, (85, 100), 256), (5, (80, 100), 2), (2, (50, 100), 3)])
def test_jaccard_join_against_all_pairs(spark, width, at_least, block):
    texts = variants()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sizes, expected = brute(texts, width, *at_least)
    got = {x["doc_id"]: x for x in ngram_join.jaccard_join(docs, width, at_least, block).rows.collect()}
    assert {i: x["n_shingles"] for i, x in got.items()} == sizes
    assert {i: x["component_id"] for i, x in got.items()} == expected


def links_per_row(texts, width, num, den):
    """Number of other rows that each row links with, by all pairs."""
    sets = {}
    for i, text in texts:
        found = words((text or "").translate(LOWER))
        sets[i] = {tuple(found[j : j + width]) for j in range(len(found) - width + 1)} or ({tuple(found)} if found else set())
    near = lambda x, y: bool(x) and den * len(x & y) >= num * len(x | y)
    return {i: sum(near(x, sets[j]) for j in sets if j != i) for i, x in sets.items()}


@pytest.mark.parametrize(("width", "at_least", "block"), [(4, (85, 100), 256), (5, (80, 100), 2), (2, (50, 100), 3)])
def test_all_links_are_counted(spark, width, at_least, block):
    # Different near copies of one text, most of which link by way of one leader only, and their copies.
    r = random.Random(8)
    base = prose(300, 120).split(" ")
    group = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in r.sample(range(120), 40)]
    texts = list(enumerate([t for _, t in variants()] + group + group[:5]))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = ngram_join.jaccard_join(docs, width, at_least, block, all_links=True)
    sizes, components_ = brute(texts, width, *at_least)
    got = {x["doc_id"]: x for x in found.rows.collect()}
    assert {i: x["n_links"] for i, x in got.items()} == links_per_row(texts, width, *at_least)
    assert {i: x["component_id"] for i, x in got.items()} == components_
    assert found.links.filter("a >= b").count() == 0 and found.links.distinct().count() == found.links.count()


def test_links_are_counted_across_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 3)
    monkeypatch.setattr(ngram_join, "COUNTED_TOKENS", 2)
    texts = variants()
    got = ngram_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"), 2, (50, 100), all_links=True).rows.collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == links_per_row(texts, 2, 50, 100)


def test_rows_without_id_and_ids_with_two_texts(spark):
    """A near copy without id keeps its links, and an id with two texts joins neither text's group to the other."""
    base, other = prose(400, 60).split(" "), prose(401, 60).split(" ")
    near = lambda words_, w: " ".join([*words_[:30], w, *words_[31:]])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, near(base, "n1")), (9, near(other, "n2")), (None, near(base, "n3")),
            (None, prose(402, 60)), (None, near(prose(402, 60).split(" "), "n4"))]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, (75, 100), all_links=True).rows
    told = sorted((x["doc_id"] or 0, x["component_id"] or 0, x["n_links"]) for x in got.collect())
    assert told == [(0, 0, 1), (0, 0, 1), (0, 5, 2), (5, 5, 1), (5, 5, 2), (7, 5, 2), (9, 5, 1)]


def test_jaccard_join_awkward_and_no_rows(spark):
    got = ngram_join.jaccard_join(documents(spark)).rows.toPandas()
    assert len(got) == 19
    of = dict(zip(got["doc_id"], got["component_id"]))
    assert [of[i] for i in (1, 2, 3, 8, 9, 10, 11, 15)] == [1, 1, 1, 8, 8, 10, 10, 15]
    assert [of[i] for i in (5, 6, 7)] == [5, 6, 7]
    nameless = got[got["doc_id"].isna()].sort_values("n_shingles")["component_id"].tolist()
    assert np.isnan(nameless[0]) and nameless[1] == 1
    assert ngram_join.jaccard_join(documents(spark, [])).rows.count() == 0


def test_prefixes_are_posted_without_a_shuffle_and_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 32)  # nearly every bit is taken: no class may get lost by that
    texts = [(i, prose(i % 30, 20)) for i in range(60)] + [(i, prose(i, 20)) for i in (100, 100, 101)] + [(None, prose(7, 20))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    classes = spark.createDataFrame([], "fp1 long, rep long, n_rows long")
    sketch = spark.sparkContext.broadcast(np.zeros(ngram_join.SKETCH, dtype=np.int64))
    plan = ngram_join.posted_prefixes(docs, classes, 3, (80, 100), sketch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {x["doc_id"]: x["class_id"] for x in ngram_join.jaccard_join(docs, 3, (80, 100)).rows.collect()}
    assert got == {None: 7, 100: 100, 101: 101, **{i: i % 30 for i in range(60)}}
    rows = pa.RecordBatch.from_pydict({"id": [1, 1, 1, 2, 3, 3], "size": [5] * 6, "pos": [0] * 6, "token": [7, 7, 8, 8, 9, 9]})
    for n in (1, 2, 6):
        kept = pa.Table.from_batches(list(ngram_join._drop_single(rows.slice(i, n) for i in range(0, 6, n))), rows.schema)
        assert kept.select(["id", "token"]).to_pylist() == [{"id": 1, "token": 8}, {"id": 2, "token": 8}]


def test_sets_go_only_where_they_are_needed(spark):
    homes = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (1, 0)], "id long, home long")
    apart = spark.createDataFrame([(4, 3)], "a long, b long")
    told = ngram_join.roles(homes, apart)
    assert {tuple(x) for x in told.collect()} == {
        (0, None, None, True, False), (1, 0, True, True, False), (2, 1, False, False, False), (3, 1, False, False, True),
        (4, None, None, True, True), (5, 4, True, False, False),
    }
    sets = {0: [1, 2], 1: [2, 3], 2: [2, 4], 3: [2, 3, 5], 4: [9], 5: [8, 9]}
    stored = spark.createDataFrame([(i, bytearray(np.array(s, "<u8").tobytes())) for i, s in sets.items()], "id long, set binary")
    got = {x["id"]: x for x in ngram_join.at_home(told.join(stored, "id")).collect()}
    assert {i: (x["comp"], x["overlap"]) for i, x in got.items()} == {1: (0, 1), 2: (1, 1), 3: (1, 2), 5: (4, 1)}
    # Differences only travel where two classes meet at a home.
    assert {i for i, x in got.items() if x["lacks"] or x["beyond"]} == {2, 3}


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    for n, m in ((30, 20), (60, 80), (40, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 25)]
        got = {x["node"]: x["component_id"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        nodes = {x for p in links if p[0] != p[1] for x in p}
        assert got == smallest_reachable(nodes, [p for p in links if p[0] in nodes and p[1] in nodes])


def test_lattice_points():
    steps = lattice.steps()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    y = np.random.default_rng(1).normal(size=(300, 8)) * 2
    near = lattice.nearest(y)
    distance = ((y - near) ** 2).sum(axis=1)
    assert distance.max() <= 1 + 1e-9  # covering radius
    # No neighbour is nearer, and every point is of the lattice.
    assert all((((y - near - s) ** 2).sum(axis=1) >= distance - 1e-9).all() for s in steps)
    whole = near[np.allclose(near, np.rint(near), atol=1e-9)] if False else near
    twice = np.rint(2 * whole).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (whole.sum(axis=1) % 2 == 0)).all()


def vectors():
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    rows = [x for x in base]
    for k in range(150):
        x = base[k % 20] / np.linalg.norm(base[k % 20])
        z = r.normal(size=16)
        rows.append((x + z / np.linalg.norm(z) * r.uniform(0, 0.45)) * r.uniform(0.1, 30))
    return rows + [base[3], base[3], base[4] * 2]


def test_near_duplicates_against_all_pairs(spark):
    rows = vectors()
    unit = np.stack([x / np.linalg.norm(x) for x in rows])
    close = unit @ unit.T >= lattice.AT_LEAST
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if close[a, b]]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = lattice.near_duplicates(frame.repartition(3), rows=16)[0].toPandas().set_index("vec_id").sort_index()
    found = got["n_links"].sum() / 2
    assert found <= len(links) and found >= 0.99 * len(links)
    expected = smallest_reachable(range(len(rows)), links)
    assert (got["component_id"] == [expected[i] for i in got.index]).mean() > 0.99
    assert ((got["component_id"] == got.index) == got["kept"]).all()


def test_vectors_of_every_length_link_with_their_own(spark):
    rows = vectors()
    short = [x[:7] for x in rows[:50]] + [rows[0][:7] * 3, rows[1][:7]]
    every = [*rows, *short, np.array([1.0, 2.0]), np.array([2.0, 4.0]), np.array([2.0])]
    cosine = lambda x, y: len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= lattice.AT_LEAST
    links = {(a, b) for a in range(len(every)) for b in range(a + 1, len(every)) if cosine(every[a], every[b])}
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "vec_id long, embedding array<double>")
    got = lattice.near_duplicates(frame.repartition(3), rows=40)[0].toPandas().set_index("vec_id").sort_index()
    for few in (range(len(rows), len(rows) + len(short)), range(len(every) - 3, len(every))):
        counted = [sum(i in pair for pair in links) for i in few]
        assert (got["n_links"].loc[list(few)].to_numpy() >= 0.9 * np.array(counted)).all()
        assert (got["n_links"].loc[list(few)].to_numpy() <= counted).all()
    assert got["n_links"].sum() >= 2 * 0.98 * len(links) and got["component_id"].iloc[-2] == len(every) - 3


def test_near_duplicates_awkward_and_no_rows(spark):
    x = [1.0, 2.0, 3.0]
    own = [
        (1, x), (2, x), (2, x), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]),
        (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, x), (10, [1e-200, 2e-200, 3e-200]), (11, [-1.0, -2.0, -3.0]),
    ]
    got = lattice.near_duplicates(spark.createDataFrame(own, "vec_id long, embedding array<double>"))[0].collect()
    assert len(got) == 13
    of = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got}
    assert of[1] == (3, 1, True) and of[2] == (3, 1, False) and of[10] == (3, 1, False)
    assert all(of[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11))
    assert of[None] == (0, None, True)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_duplicates(none)[0].collect() == []
